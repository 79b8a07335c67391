"""Operator 1, URL filters by a path-template tree (DataFrame functions only).

Per host, the segments of paths form a tree of the paths' own depth.  Level by
level sibling branches with support are put in order of their smoothed share
of bad labels and merged into classes of shares that do not differ
statistically.  The class that holds the siblings' middle, and every segment
without support or labels, becomes the wildcard; the other classes stay, each
as one branch.  A template is rejected when its share of bad labels, smoothed
towards the whole table's, exceeds a limit.  Rules given by hand come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import written

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, begin = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    """Segments with digit runs as ``<n>``."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "<n>"))


#: Siblings of equal smoothed share, to this precision, meet the others as one.
GRID = 1000


def _classes(stats: DataFrame, support: int, z: float, smoothing: float) -> DataFrame:
    """(host, prefix, segment, branch) of the segments that do not become ``*``.

    ``stats``: host, prefix, segment, n, labelled, bad.  Per parent at most
    ``GRID`` + 1 pre-aggregated bins are gone through in order of their share;
    a bin that differs from the class so far begins another.  The error is
    that of a typical branch, not of the sum (bins are sorted by what was
    seen), and ``z`` grows with the number of siblings tested.
    """
    by = ["host", "prefix"]
    fit = (F.col("n") >= support) & (F.col("labelled") > 0)
    whole = stats.groupBy(*by).agg(F.try_divide(F.sum("bad"), F.sum("labelled")).alias("rate"))
    tested = stats.where(fit).join(whole, by)
    smoothed = (F.col("bad") + smoothing * F.col("rate")) / (F.col("labelled") + smoothing)
    tested = tested.select(*by, "segment", "labelled", "bad", F.floor(smoothed * GRID).cast("int").alias("bin"))
    bins = tested.groupBy(*by, "bin").agg(F.sum("labelled").cast("double").alias("lab"), F.sum("bad").cast("double").alias("bad"), F.count("*").cast("double").alias("k"))
    parent = bins.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "lab", "bad", "k"))).alias("bins"), F.sum("k").alias("m"), F.sum("lab").alias("all"))
    limit = F.sqrt(F.lit(z * z) + 2 * F.log("m"))

    def step(a: Column, x: Column) -> Column:
        rate, other = a["bad"] / a["lab"], x["bad"] / x["lab"]
        pooled = (a["bad"] + x["bad"]) / (a["lab"] + x["lab"])
        error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-6)) * (a["k"] / a["lab"] + x["k"] / x["lab"]))
        new = (a["lab"] > 0) & (F.abs(rate - other) > limit * error)
        add = lambda c: F.when(new, x[c]).otherwise(a[c] + x[c]).alias(c)
        cls = F.when(new, a["cls"] + 1).otherwise(a["cls"])
        seen = a["seen"] + x["lab"]
        # the class in which half of the labels are reached
        middle = F.when((a["seen"] < F.col("all") / 2) & (seen >= F.col("all") / 2), cls).otherwise(a["middle"])
        return F.struct(add("lab"), add("bad"), add("k"), cls.alias("cls"), seen.alias("seen"), middle.alias("middle"), F.concat(a["out"], F.array(F.struct(x["bin"].alias("bin"), cls.alias("cls")))).alias("out"))

    zero = F.lit(0.0)
    start = F.struct(*(zero.alias(c) for c in ("lab", "bad", "k")), F.lit(0).alias("cls"), zero.alias("seen"), F.lit(0).alias("middle"), F.array().cast("array<struct<bin:int,cls:int>>").alias("out"))
    done = parent.select(*by, F.aggregate("bins", start, step).alias("a"))
    classes = done.select(*by, "a.middle", F.inline("a.out")).where("cls <> middle").select(*by, "bin", "cls")
    kept = tested.select(*by, "bin", F.when(F.col("segment") == "*", "#*").otherwise(F.col("segment")).alias("name"), "segment").join(classes, [*by, "bin"])
    names = kept.groupBy(*by, "cls").agg(F.min("name").alias("first"), F.max("name").alias("last"))
    name = F.when(F.col("first") == F.col("last"), F.col("first")).otherwise(F.concat("first", F.lit("#"), "last"))
    return kept.join(names, [*by, "cls"]).select(*by, "segment", F.concat("prefix", F.lit("/"), name).alias("branch"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    support: int = 20,
    z: float = 2.6,
    smoothing: float = 10.0,
    reject: float = 0.5,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, purity.

    ``labels``: doc_id, quality; a page is bad where its id has quality 0
    (any of several labels).  Branches with ``support`` pages and a label are
    merged while their shares lie within ``z`` standard errors (more for many
    siblings), however many they are and however deep.  In a template ``*`` is
    a wildcard, ``first#last`` a merged class by its first and last segment.
    Null or malformed urls have empty host and path, no rule, and the method's
    verdict on the empty host like any other.  Null ids have no label.
    Repeated rows are judged each.  Other columns are not read; without labels
    no template is rejected; an empty table gives no rows.
    """
    host, path = host_and_path(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    bad = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    rows = rows.join(bad, "page_id", "left").withColumn("segments", _segments(F.col("path"))).withColumn("prefix", F.lit(""))
    live, ended = written(rows, "urls"), []
    prior = live.agg(F.avg("bad")).first()[0] or 0.0

    counts = (F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    depth = 0
    while True:
        segment = F.get("segments", F.lit(depth))
        stats = live.where(F.size("segments") > depth).groupBy("host", "prefix", segment.alias("segment")).agg(*counts)
        stats = written(stats, "stats")
        # a branch below, also of a wildcard, has no more pages than its parent here
        parents = stats.groupBy("host", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= support).select("host", "prefix")
        if parents.isEmpty():
            break
        kept = _classes(stats, support, z, smoothing)
        longer = live.withColumn("segment", segment).join(parents.withColumn("goes", F.lit(True)), ["host", "prefix"], "left")
        longer = longer.withColumn("goes", F.col("goes").isNotNull() & F.col("segment").isNotNull()).join(kept, ["host", "prefix", "segment"], "left")
        prefix = F.when(F.col("goes"), F.coalesce("branch", F.concat("prefix", F.lit("/*")))).otherwise(F.col("prefix"))
        # who ends here is not gone through again: only the rows that go on are written with the next level
        step = written(longer.withColumn("prefix", prefix).select(*rows.columns, "goes"), "urls")
        ended.append(step.where(~F.col("goes")).select(*rows.columns, F.lit(depth).alias("depth")))
        live = step.where("goes").select(*rows.columns)
        depth += 1

    rows = live.withColumn("depth", F.lit(depth))
    for one in ended:
        rows = rows.unionByName(one)
    rest = F.repeat(F.lit("/*"), F.greatest(F.size("segments") - F.col("depth"), F.lit(0)))
    rows = rows.withColumn("template", F.concat("prefix", rest))
    purity = rows.groupBy("host", "template").agg(*counts).select("host", "template", ((F.col("bad") + smoothing * prior) / (F.col("labelled") + smoothing)).alias("bad_share"))
    judged = rows.join(purity, ["host", "template"])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_share") > reject, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "template", (1 - F.col("bad_share")).alias("purity"))

"""Operator 7, mixing to target weights by soft membership.

A naive Bayes classifier, learned from a labelled table, gives each document a
posterior over domains.  Document rates r >= 0 then minimise

    sum_k w_k (sum_d r_d n_d p_dk - T_k)^2 / 2 + ridge sum_d n_d (r_d - 1)^2 / 2

by projected gradient: n tokens, p posteriors, T target token totals, w the
inverse of a domain's own mass.  A step needs only the domains' totals from
the documents, so the driver sees a few numbers a round, and a rate is a chain
of ``greatest`` over a document's posteriors.  Steps have Nesterov's momentum
and end when the projected gradient's norm is small.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.llm.common import written

WORDS = r"[\x20\x09-\x0D]+"
#: Labelled rows that the classifier is fitted on, at most, a domain.
ROWS_PER_DOMAIN = 2000
#: Words that speak for a domain, at most, and the share of the domain's
#: documents that has each at least.
WORDS_PER_DOMAIN, CUE_SHARE = 64, 0.02
#: Upper edges of the bins of the measures, and of the share of a domain's cue
#: words.  Quantiles of the labelled rows in their place cost clean documents:
#: what tells the rare domains apart lies beyond the others' quantiles.
EDGES = {"upper": (0.005, 0.03, 0.1, 0.3), "symbol": (0.001, 0.01, 0.05, 0.15), "distinct": (0.2, 0.4, 0.6, 0.8, 0.95), "size": (20, 100, 400, 1600)}
CUE_EDGES = (0, 0.003, 0.01)
#: The only domain where nothing is labelled; every rate is 1 then.
UNKNOWN = "unknown"
#: Norm of the projected gradient, in rates, beside the ridge's own pull, at
#: which the fit ends; after so many rounds it ends with a warning.
TOLERANCE, MOST_ROUNDS = 1e-3, 300


def _bin(value: Column, edges) -> Column:
    out = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        out = F.when(value <= e, F.lit(i)).otherwise(out)
    return out


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _word_list(text: Column) -> Column:
    """Words of the text; a null or empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORDS), lambda w: w != "")


def features(text: Column, cues: list[list[str]]) -> Column:
    """struct(n: words, f: a bin for each measure and each domain's cue words).

    A cue value is the domain's share among the text's different words: a
    long text has some of its cue words by chance.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))

    def of(w: Column) -> Column:
        return _let(F.array_distinct(w), lambda u: both(w, u))

    def both(w: Column, u: Column) -> Column:
        # white space at an end leaves an empty entry there, no text leaves one
        ends = (F.get(w, F.lit(0)) == "").cast("int") + ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")
        n = F.size(w) - ends
        values = [
            F.regexp_count(text, F.lit("[A-ZÀ-Þ]")) / chars,
            F.regexp_count(text, F.lit("[#*$%&|<>!]")) / chars,
            F.size(u) / F.greatest(F.size(w), F.lit(1)),
            n.cast("double"),
            *(F.size(F.array_intersect(u, F.array(*map(F.lit, words)))) / F.size(u) if words else F.lit(0.0) for words in cues),
        ]
        bins = (_bin(v, e) for v, e in zip(values, [*EDGES.values(), *[CUE_EDGES] * len(cues)]))
        return F.struct(n.cast("long").alias("n"), F.array(*bins).alias("f"))

    return _let(F.split(text, WORDS), of)


#: The domain whose documents a draw can keep for sure.
SURE_DOMAIN = "clean"


@dataclass
class MixingModel:
    """What a rate needs: cue words, log tables, and the steps taken."""

    domains: list[str]
    cues: list[list[str]]
    prior: list[float]
    tables: list[list[list[float]]]  # feature, domain, bin: log probability
    steps: list[list[float]]
    step_size: float = 0.0
    ridge: float = 0.0
    most: float | None = None
    #: The steps that settled which documents stay for sure.
    settled: list[list[float]] | None = None

    def posteriors(self, f: Column) -> Column:
        """Probabilities of the domains, in their order, from feature bins."""

        def log(i: int) -> Column:
            parts = (F.element_at(F.array(*map(F.lit, t[i])), F.element_at(f, j + 1) + 1) for j, t in enumerate(self.tables))
            return sum(parts, F.lit(self.prior[i]))

        def normal(e: Column) -> Column:
            return _let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda whole: F.transform(e, lambda x: x / whole))

        return _let(F.array(*map(log, range(len(self.domains)))), lambda logs: _let(F.array_max(logs), lambda top: _let(F.transform(logs, lambda x: F.exp(x - top)), normal)))

    def _replay(self, p: Column, steps: list[list[float]]) -> Column:
        """struct(r: the rate after the steps, y: the point of the next gradient)."""
        start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
        if not steps:
            return start

        def step(a: Column, pull: Column) -> Column:
            # the last entry of a step is its momentum
            drift = F.aggregate(F.zip_with(p, F.slice(pull, 1, len(self.domains)), lambda x, g: x * g), F.lit(0.0), lambda s, x: s + x)
            out = F.greatest(F.lit(0.0), a["y"] + self.step_size * (self.ridge * (1 - a["y"]) - drift))
            out = F.least(F.lit(float(self.most)), out) if self.most is not None else out
            return _let(out, lambda r: F.struct(r.alias("r"), (r + F.element_at(pull, -1) * (r - a["r"])).alias("y")))

        return F.aggregate(F.array(*(F.array(*map(F.lit, g)) for g in steps)), start, step)

    def rate(self, p: Column, steps: list[list[float]] | None = None) -> Column:
        """The document's rate after all steps, from its posteriors."""
        return self._replay(p, self.steps if steps is None else steps)["r"]

    def stays(self, p: Column, sure: float) -> Column:
        """Whether ``SURE_DOMAIN`` leads and the rate before any draw is ``sure`` or more."""
        if SURE_DOMAIN not in self.domains:
            return F.lit(False)
        leads = F.array_position(p, F.array_max(p)) == self.domains.index(SURE_DOMAIN) + 1
        return leads & (self.rate(p, self.settled) >= sure)

    def drawn(self, p: Column, sure: float) -> Column:
        """The rate that a draw uses: 1 for what stays for sure."""
        return F.when(self.stays(p, sure), F.lit(1.0)).otherwise(self.rate(p))


def _sample(docs: DataFrame, labelled: DataFrame, rows_per_domain: int) -> tuple[DataFrame, dict[str, int]]:
    """(domain, text) of up to ``rows_per_domain`` labelled rows of each domain,
    by hash order, and the number of labels of each domain.

    A hash range that holds too few has a chance far below 1e-100 at the shipped
    2000 rows (under 1e-30 at any number); a domain then has a few rows less.
    """
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    shares = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    if shares:
        # the lowest hashes only, some twice as many as are taken, meet in a domain's task
        reach = {d: min(1.0, (2 * rows_per_domain + 100) / n) for d, n in shares.items()}
        low = F.create_map(*(F.lit(x) for dr in reach.items() for x in dr))
        known = known.where((F.xxhash64("doc_id", F.lit(7)) / 2.0**64 + 0.5) <= F.element_at(low, F.col("domain")))
    place = F.row_number().over(W.partitionBy("domain").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id"))
    picked = known.withColumn("place", place).where(F.col("place") <= rows_per_domain).select("doc_id", "domain")
    return written(docs.join(F.broadcast(picked), "doc_id").select("domain", "text"), "labelled"), shares


def _cues(sample: DataFrame, size: dict[str, int]) -> dict[str, list[str]]:
    """Words that a domain's labelled documents have far more often than others."""
    whole = sum(size.values())
    mine = F.element_at(F.create_map(*(F.lit(x) for kv in size.items() for x in kv)), F.col("domain"))
    words = sample.select("domain", F.explode(F.array_distinct(_word_list(F.col("text")))).alias("w")).groupBy("domain", "w").agg(F.count("*").alias("have"))
    words = words.withColumn("every", F.sum("have").over(W.partitionBy("w")))
    inside, outside = (F.col("have") + 0.1) / (mine + 1), (F.col("every") - F.col("have") + 0.1) / (whole - mine + 1)
    told = words.where((F.col("have") >= F.greatest(F.lit(3.0), CUE_SHARE * mine)) & (inside > 4 * outside))
    told = told.select("domain", "w", (F.col("have") * F.log(inside / outside)).alias("gain"))
    place = F.row_number().over(W.partitionBy("domain").orderBy(F.desc("gain"), "w"))
    out: dict[str, list[str]] = {d: [] for d in size}
    for r in told.withColumn("place", place).where(F.col("place") <= WORDS_PER_DOMAIN).orderBy("domain", "place").collect():
        out[r.domain].append(r.w)
    return out


def _classifier(docs: DataFrame, labelled: DataFrame, rows_per_domain: int) -> MixingModel:
    """Naive Bayes over binned measures and cue words of the labelled rows."""
    sample, shares = _sample(docs, labelled, rows_per_domain)
    domains = sorted(shares)
    if not domains:
        return MixingModel([UNKNOWN], [[]], [0.0], [], [])
    size = {d: 0 for d in domains} | {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    said = _cues(sample, size)
    cues = [said[d] for d in domains]
    bins = [len(e) + 1 for e in [*EDGES.values(), *[CUE_EDGES] * len(cues)]]
    seen = sample.select("domain", F.posexplode(features(F.col("text"), cues)["f"]).alias("f", "b"))
    count = {(r.domain, r.f, r.b): r["count"] for r in seen.groupBy("domain", "f", "b").count().collect()}
    tables = [[[math.log((count.get((d, j, b), 0) + 1.0) / (size[d] + n)) for b in range(n)] for d in domains] for j, n in enumerate(bins)]
    total = sum(shares.values())
    return MixingModel(domains, cues, [math.log(shares[d] / total) for d in domains], tables, [])


def measured(docs: DataFrame, model: MixingModel) -> DataFrame:
    """(row, n, f): every row of ``docs`` as a struct with its words and bins.

    A written table, read by the fit (n and f), the rates and the draw, so
    that no text is measured twice.
    """
    x = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    x = x.select("row", features(F.col("text"), model.cues).alias("x"))
    return written(x.select("row", "x.n", "x.f"), "features")


def _descend(model: MixingModel, table: DataFrame, whole: float, goal: np.ndarray, weight: np.ndarray) -> None:
    """Steps until the projected gradient's norm is below ``TOLERANCE``, and
    the ridge: what it pulls at rates that meet the targets anyhow settles in
    thousands of rounds.

    Goes on from the model's steps.  ``table``: n, p, sure; rows that are sure
    keep rate 1.
    """
    held = lambda r: F.when(F.col("sure"), F.lit(1.0)).otherwise(r)
    taken, t = len(model.steps), 1.0
    while True:
        now, before = (model._replay(F.col("p"), x) for x in (model.steps, model.steps[:-1]))
        rated = table.select("n", "p", held(now["r"]).alias("r"), held(now["y"]).alias("y"), held(before["y"]).alias("b"))
        got = rated.agg(F.sum(F.col("n") * F.pow(F.col("r") - F.col("b"), F.lit(2.0))), *(F.sum(F.col("n") * F.element_at("p", i + 1) * F.col("y")) for i in range(len(goal)))).first()
        if len(model.steps) > taken and math.sqrt(got[0] / whole) / model.step_size <= TOLERANCE + model.ridge:
            break
        if len(model.steps) == taken + MOST_ROUNDS:
            warnings.warn(f"rates had not settled after {MOST_ROUNDS} rounds", stacklevel=3)
            break
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        model.steps.append([*(weight * (np.array(got[1:], float) / whole - goal)).tolist(), (t - 1) / after])
        t = after


def fit_rates(model: MixingModel, table: DataFrame, targets: dict[str, float], of_own: bool = False, ridge: float = 0.001, most: float | None = None, sure: float | None = None) -> MixingModel:
    """Projected gradient on ``measured`` rows; the steps go into the model.

    With ``sure`` the rates settle which documents stay for sure, and then go
    on to make up for them.
    """
    if model.domains == [UNKNOWN]:
        return model
    k = len(model.domains)
    # documents alike in their bins have equal posteriors, hence equal rates
    table = table.groupBy("f").agg(F.sum("n").cast("double").alias("n"))
    table = written(table.select("n", model.posteriors(F.col("f")).alias("p")), "posteriors")
    one = table.select("n", "p", F.posexplode("p").alias("i", "a")).select("n", "i", "a", F.posexplode("p").alias("j", "b"))
    cross = {(r.i, r.j): r.s for r in one.groupBy("i", "j").agg(F.sum(F.col("n") * F.col("a") * F.col("b")).alias("s")).collect()}
    m = np.array([[cross.get((i, j), 0.0) for j in range(k)] for i in range(k)])
    own, whole = m.sum(axis=1), float(m.sum())  # posteriors of a row sum to one
    if not whole:
        return model
    m, own = m / whole, own / whole
    want = np.array([targets.get(d, 0.0) for d in model.domains], float)
    goal = want * own if of_own else want / (want.sum() or 1.0)
    weight = 1 / np.maximum(own, 1e-6)
    model.step_size = float(1 / (np.linalg.eigvals(weight[:, None] * m).real.max() + ridge))
    model.ridge, model.most, model.steps, model.settled = ridge, most, [], None
    _descend(model, table.withColumn("sure", F.lit(False)), whole, goal, weight)
    if sure is not None:
        model.settled = list(model.steps)
        _descend(model, table.withColumn("sure", model.stays(F.col("p"), sure)), whole, goal, weight)
    return model


def fit_mixing(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], rows_per_domain: int = ROWS_PER_DOMAIN, **how) -> tuple[MixingModel, DataFrame]:
    """Fit classifier and rates; returns the model and the measured rows.

    ``docs``: doc_id, text and any others.  ``labelled``: doc_id, domain; rows
    without either are no labels, and of several labels of an id the first
    counts.  Where there are none, the only domain is ``unknown`` and every
    rate 1.  ``targets`` are weights of the whole token count (normalised), or
    with ``of_own`` shares of each domain's own expected tokens; a domain
    without one gets none.  ``most`` bounds rates from above.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = _classifier(text, labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")), rows_per_domain)
    table = measured(docs, model)
    return fit_rates(model, table, targets, **how), table


def mixing_rates(table: DataFrame, model: MixingModel) -> DataFrame:
    """One row per ``measured`` row: doc_id, n_tokens, domain, p_<domain>..., rate.

    n_tokens counts words.  Null and empty texts have none, and a rate like
    any other of their posterior.  Null ids and repeated rows get rows of
    their own.  Other columns are not read; an empty table gives no rows.
    """
    rows = table.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n", model.posteriors(F.col("f")).alias("p"))
    best = F.array_position("p", F.array_max("p")).cast("int")
    each = (F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(model.domains))
    return rows.select("doc_id", F.col("n").alias("n_tokens"), F.element_at(F.array(*map(F.lit, model.domains)), best).alias("domain"), *each, model.rate(F.col("p")).alias("rate"))


def resample(table: DataFrame, model: MixingModel, sure: float = 1.0, seed: int = 7) -> DataFrame:
    """Rows of ``measured`` drawn at their rates (at most 1), with their own columns.

    A row stays when a uniform number from the hash of its id is below its
    rate, at rate 0 never; one that ``SURE_DOMAIN`` leads stays for sure from
    the rate ``sure`` on.  A rerun draws the same rows; those of one id share
    their lot.
    """
    uniform = F.shiftrightunsigned(F.xxhash64(F.col("row.doc_id").cast("long"), F.lit(seed)), 11) / float(1 << 53)
    rate = _let(model.posteriors(F.col("f")), lambda p: model.drawn(p, sure))
    return table.where(uniform < rate).select("row.*")


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of a table of quality and toxic labels: clean, junk or toxic."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))

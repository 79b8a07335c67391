"""Text functions as Columns: no Python on the way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the sentence score, the CJK ranges counted as
# one token and a half, and the trimmed white space of the source format.
CONDENSE_STOPWORDS = (
    "a an and are as at be but by for from has have he her his i if in is it its "
    "not of on or our she so that the their them they this to was we were will with "
    "dan atau yang dari ke di dan untuk pada dengan tidak apakah saya kamu kita ini itu yang "
    "sudah akan bisa mau apa siapa kapan mana lebih"
).split()
CJK = r"[一-鿿぀-ヿ가-힯]"
BLANK = r"[\s ﻿  -     　]"


def units(c: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each astral one."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, r"^﻿", "")


def estimate_tokens(c: Column) -> Column:
    """ceil(1.5 per CJK character) + ceil(a quarter of the other units)."""
    cjk = F.regexp_count(c, F.lit(CJK))
    return (F.ceil(cjk * 1.5) + F.ceil((units(c) - cjk) / 4)).cast("int")


def estimate_tokens_from_chars(n: Column) -> Column:
    return F.when(n > 0, F.ceil(n / 4)).otherwise(0).cast("long")


def content_hash(content: Column, scope: Column | None = None) -> Column:
    """SHA-256 hex of ``scope``, a zero byte and the content."""
    return F.sha2(content if scope is None else F.concat(scope, F.lit("\0"), content), 256)


def token_set(c: Column) -> Column:
    """Distinct lower-case runs of letters and numbers, longer than one."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)), lambda t: F.length(t) > 1)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters of the basic plane."""
    codes = F.transform(F.split(c, ""), lambda x: F.expr("0L") + F.ascii(x))
    step = lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.when(c == "", F.array().cast("array<bigint>")).otherwise(codes), F.lit(2166136261).cast("long"), step)


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def clamp_importance(c: Column) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.5).otherwise(clamp(c, 0.0, 1.0))


def decay(last: Column, created: Column, now_ms: int, half_life_days: float) -> Column:
    """Half for every half-life since the last recall, or else the creation."""
    return F.pow(F.lit(0.5), (F.lit(now_ms) - F.coalesce(last, created)) / (half_life_days * 86_400_000.0))


def parse_tags(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def sentences(c: Column) -> Column:
    """Cut after .!?…: and white space, and at line ends; trimmed, none empty."""
    parts = F.split(c, r"(?<=[.!?…:])\s+|\n+")
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def sentence_score(s: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), 0)
    stop = F.array(*(F.lit(w) for w in dict.fromkeys(CONDENSE_STOPWORDS)))
    telling = F.filter(tokens, lambda t: (F.length(t) >= 4) & ~F.array_contains(stop, t) & ~t.rlike(r"^\d+$"))
    return F.size(telling) + F.least(F.size(tokens), F.lit(8)) / 10


def condense(c: Column, min_chars: int = 120, ratio: float = 0.35) -> Column:
    """Keep the most telling sentences, in order, up to a share of the length.

    A sentence is chosen while the ones with a higher score (ties: earlier)
    have fewer characters than the target together; one expression per row,
    without a shuffle.
    """
    text = trimmed(c)
    cut = sentences(text)
    target = F.greatest(F.floor(units(text) * ratio + 0.5), F.least(F.lit(min_chars), units(text)))
    scored = F.transform(cut, lambda s, i: F.struct((-sentence_score(s) - (i == 0).cast("int")).alias("k"), i.alias("i"), s.alias("s")))
    empty = F.struct(F.lit(0).cast("long").alias("kept"), F.array().cast("array<int>").alias("chosen"))

    def take(acc: Column, x: Column) -> Column:
        more = F.struct((acc["kept"] + units(x["s"])).alias("kept"), F.concat(acc["chosen"], F.array(x["i"])).alias("chosen"))
        return F.when(acc["kept"] < target, more).otherwise(acc)

    chosen = F.aggregate(F.array_sort(scored), empty, take, lambda a: F.array_sort(a["chosen"]))
    joined = F.array_join(F.transform(chosen, lambda i: F.get(cut, i)), " ")
    return F.when((units(text) <= min_chars) | (F.size(cut) <= 1), text).otherwise(trimmed(joined))


def query_tokens(query: str, most: int = 10) -> list[str]:
    """Lower-case runs of letters, numbers, _ and -; the first ten."""
    import regex

    return regex.sub(r"[^\p{L}\p{N}_-]+", " ", query.lower()).split()[:most]

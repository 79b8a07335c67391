"""Overlapping chunks of texts, as Columns: no Python on the way.

The cutter is a state machine over a text's lines, then over its sentences;
both are folds over arrays (``aggregate``).  Lengths are UTF-16 units: a
character beyond the basic plane is followed by a mark on the way, so that it
counts as two, and a cut between the two leaves a replacement character each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_DDL = "array<struct<idx:int,text:string,token_count:int>>"
# White space, ends of sentences, what may close one, CJK characters.
SPACE = r"\t\n\x0B\f\r\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BLANKS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ENDS, CLOSERS = ".!?。！？", r"\"')\]}»”"
CJK = r"[一-鿿぀-ヿ가-힯]"
WORDY = r"^[[\p{L}\p{N}_]&&[\x{0000}-\x{FFFF}]]"
#: Marks of a character's second unit, of a whole one and of a decimal point: no characters.
SECOND, BOTH, POINT = "\ufdd0", "\ufdd1", "\ufdd2"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _push(items: Column, one: Column) -> Column:
    return F.concat(items, F.array(one))


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines; a fence keeps its blank lines."""
    lines = F.split(text, r"\r?\n")

    def step(s: Column, line: Column) -> Column:
        fenced = s["fenced"] != line.rlike(f"^[{SPACE}]*(```|~~~)")
        stays = fenced | line.rlike(f"[^{SPACE}]")
        begun = s["start"] >= 0
        start = F.when(~stays, -1).when(begun, s["start"]).otherwise(s["i"])
        run = F.struct(s["start"].alias("a"), (s["i"] - s["start"]).alias("n"))
        return F.struct((s["i"] + 1).alias("i"), fenced.alias("fenced"), start.alias("start"), F.when(~stays & begun, _push(s["runs"], run)).otherwise(s["runs"]).alias("runs"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(False).alias("fenced"), F.lit(-1).alias("start"), F.array().cast("array<struct<a:int,n:int>>").alias("runs"))

    def closed(s: Column) -> Column:
        last = F.struct(s["start"].alias("a"), (s["i"] - s["start"]).alias("n"))
        return F.when(s["start"] >= 0, _push(s["runs"], last)).otherwise(s["runs"])

    def cut(ls: Column) -> Column:
        runs = F.aggregate(ls, zero, step, closed)
        return F.transform(runs, lambda r: F.rtrim(F.array_join(F.slice(ls, r["a"] + 1, r["n"]), "\n"), F.lit(BLANKS)))

    return _let(lines, cut)


def sentences(block: Column) -> Column:
    """Cut after every terminator and the closers behind it, decimals apart."""
    marked = F.regexp_replace(block, r"(?<=[0-9])\.(?=[0-9])", POINT)
    found = F.regexp_extract_all(marked, F.lit(f"[^{ENDS}]*+[{ENDS}][{CLOSERS}]*+|[^{ENDS}]+$"), F.lit(0))
    return F.filter(F.transform(found, lambda s: trim(F.replace(s, F.lit(POINT), F.lit(".")))), lambda s: s != "")


def long_pieces(text: Column, most: int) -> Column:
    """Cut a long text at the last good break past 60% of the budget."""
    floor = int(most * 0.6)

    def cut_at(head: Column) -> Column:
        # a greedy prefix ends where the last break begins
        good = F.length(F.regexp_extract(head, "(?s)^(.*)(?:\\. |\\.\\n|。|\\n|, )", 1))
        blank = F.length(F.regexp_extract(head, f"(?s)^.*[{SPACE}]", 0))
        return F.when(good > floor, good + 1).when(blank > floor + 1, blank).otherwise(most)

    def step(s: Column, _: Column) -> Column:
        rest = s["rest"]
        more = _let(cut_at(F.substring(rest, 1, most)), lambda n: F.struct(F.substr(rest, n + 1).alias("rest"), _push(s["out"], trim(F.substr(rest, F.lit(1), n))).alias("out")))
        return F.when(F.length(rest) > most, more).otherwise(s)

    # every cut takes more than the floor
    steps = F.sequence(F.lit(0), (F.length(text) / (floor + 1)).cast("int"))
    end = lambda s: F.when(trim(s["rest"]) != "", _push(s["out"], trim(s["rest"]))).otherwise(s["out"])
    return F.aggregate(steps, F.struct(text.alias("rest"), _no_strings().alias("out")), step, end)


def overlap_tail(text: Column, size: int) -> Column:
    """The last ``size`` characters, without a word cut at their beginning."""
    if size <= 0:
        return F.lit("")
    body = F.ltrim(F.right(text, F.lit(size)), F.lit(BLANKS))
    before = F.when(F.length(text) > size, F.substr(text, F.length(text) - size, F.lit(1))).otherwise("")
    cut = before.rlike(WORDY)
    # from the first white space on; a body of one word stays
    return _let(body, lambda b: F.when(cut & b.rlike(WORDY) & b.rlike(f"[{SPACE}]"), F.regexp_replace(b, f"^[^{SPACE}]+[{SPACE}]+", "")).otherwise(b))


def glue(left: Column, right: Column) -> Column:
    none = (left == "") | left.endswith("\n") | right.startswith("\n")
    return F.when(none, "").when(left.contains("\n") | right.contains("\n"), "\n").otherwise(" ")


def _windows(pieces: Column, most: int, overlap: int) -> Column:
    """Pieces glued together up to ``most`` characters, each text beginning
    with the end of the one before it."""

    def step(s: Column, p: Column) -> Column:
        w = s["w"]
        over = (w != "") & (F.length(w) + F.length(glue(w, p)) + F.length(p) > most)
        full = lambda k: F.struct(F.concat(k, glue(k, p), p).alias("w"), _push(s["out"], trim(w)).alias("out"))
        return F.when(over, _let(overlap_tail(w, overlap), full)).otherwise(F.struct(F.concat(w, glue(w, p), p).alias("w"), s["out"].alias("out")))

    zero = F.struct(F.lit("").alias("w"), _no_strings().alias("out"))
    return F.aggregate(pieces, zero, step, lambda s: _push(s["out"], trim(s["w"])))


def _pairs(text: Column) -> Column:
    return F.when(text.rlike(ASTRAL), F.regexp_replace(text, f"({ASTRAL})", f"$1{SECOND}")).otherwise(text)


def _whole(c: Column) -> Column:
    """Characters again: a half without its other one is replaced."""
    kept = F.regexp_replace(c, f"({ASTRAL}){SECOND}", f"$1{BOTH}")
    lone = F.regexp_replace(kept, f"{ASTRAL}(?!{BOTH})|{SECOND}", "\ufffd")
    return F.when(c.rlike(f"{ASTRAL}|{SECOND}"), F.regexp_replace(lone, BOTH, "")).otherwise(c)


def _tokens(c: Column) -> Column:
    cjk = F.regexp_count(c, F.lit(CJK))
    return (F.ceil(cjk * 1.5) + F.ceil((F.length(c) - cjk) / 4)).cast("int")


def chunks(text: Column, max_chars: int = 900, overlap_chars: int = 120) -> Column:
    """(idx, text, token_count) of each chunk of a text, none longer than
    ``max_chars`` units; a null text gives null."""
    if not max_chars >= 1 or max_chars == float("inf"):
        raise ValueError("max_chars must be at least 1")
    if not 0 <= overlap_chars < float("inf"):
        raise ValueError("overlap_chars must be at least 0")
    most, overlap = int(max_chars), int(min(overlap_chars, max_chars // 2))

    def pieces(block: Column) -> Column:
        said = _let(sentences(block), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(block)))
        return F.when(F.length(block) > most, long_pieces(block, most)).otherwise(said)

    def cut(t: Column) -> Column:
        blocks = F.filter(paragraphs(t), lambda b: trim(b) != "")
        texts = _windows(F.flatten(F.transform(blocks, pieces)), most, overlap)
        parts = F.flatten(F.transform(texts, lambda c: F.when(F.length(c) > most, long_pieces(c, most)).otherwise(F.array(c))))
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p, i: F.struct(i.alias("idx"), _whole(p).alias("text"), _tokens(p).alias("token_count")))

    return F.when(text.isNotNull(), _let(_pairs(text), cut)).cast(CHUNK_DDL)

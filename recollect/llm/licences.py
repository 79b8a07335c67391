"""Operator 12, licence scans by a positional index of rare words (DataFrame functions only).

Templates are phrases and notices of licences, as words with their positions.
A word's weight is its inverse document frequency in the corpus.  Of each
template so many of its rarest words are indexed that no text can share enough
weight with it and hold none of them at its place; a text's words are looked up
in that index, a posting's place less the template's gives the place where the
template would begin, and there the words that stand at their relative
positions are weighed and the mandatory key phrases verified.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases with their labels; then notices, as label, wording
# and the key phrases that must stand in it.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
NOTICES = (
    ("agpl-3.0", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsl-1.0", "boost software license version 1 0", ("boost software license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0-1.0", "creative commons cc0 1 0 universal", ("cc0 1 0",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]  # begin and end of the mandatory phrases
    share: float  # of the words' weight that must stand in place
    base: bool


def split(text: str) -> tuple[str, ...]:
    return tuple(re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER))))


def templates(phrases=PHRASES, notices=NOTICES, share: float = 0.7) -> list[Template]:
    """Base phrases, which must stand whole, and notices."""
    out = [Template(label, w := split(text), ((0, len(w)),), 1.0, True) for text, label in phrases]
    for label, text, keys in notices:
        w = split(text)
        at = []
        for k in map(split, keys):
            begin = next((i for i in range(len(w)) if w[i : i + len(k)] == k), None)
            if begin is None:
                raise ValueError(f"the notice of {label} does not hold its key phrase {' '.join(k)}")
            at.append((begin, begin + len(k)))
        out.append(Template(label, w, tuple(at), share, False))
    if any(not t.words for t in out):
        raise ValueError("a template without words")
    return out


def weight(n_docs: int, df: int) -> float:
    """Inverse document frequency; above zero for a word of every document."""
    return math.log((n_docs + 1) / (df + 0.5))


def index(found: list[Template], idf: dict[str, float]) -> list[tuple[str, int, int]]:
    """(word, template, position) of the words to look up: of each template the
    rarest ones, until the others weigh less than a match must."""
    out = []
    for t, x in enumerate(found):
        left = total = sum(idf[w] for w in x.words)
        for i in sorted(range(len(x.words)), key=lambda i: (-idf[x.words[i]], x.words[i], i)):
            out.append((x.words[i], t, i))
            left -= idf[x.words[i]]
            if left < x.share * total - 1e-9 * total:
                break
    return out


#: A candidate is one number: the template, and the place where it begins, which
#: may lie before the text.
_SPAN, _BEFORE = 1 << 40, 1 << 20


def _matches(words: Column, found: list[Template], idf: dict[str, float]) -> Column:
    """array<struct<t, start, share>> of all verified places of templates."""
    postings = index(found, idf)
    anchors = sorted({w for w, _, _ in postings})
    names = F.array(*map(F.lit, anchors))
    listed = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(t * _SPAN + _BEFORE - at).cast("long").alias("base")) for w, t, at in postings))
    total = [sum(idf[w] for w in x.words) for x in found]
    lits = lambda xs, kind: F.array(*map(F.lit, xs)).cast(f"array<{kind}>")
    known = F.array(
        *(
            F.struct(
                lits(x.words, "string").alias("words"),
                lits([idf[w] / total[t] for w in x.words], "double").alias("weights"),
                lits([i for a, z in x.keys for i in range(a, z)], "int").alias("keys"),
                F.lit(x.share - 1e-9).alias("least"),
            )
            for t, x in enumerate(found)
        )
    )
    # where the text has a rare word of the index; most texts have none
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*anchors), i)), lambda i: i.isNotNull())
    places = F.when(F.arrays_overlap(words, names), places).otherwise(F.array().cast("array<int>"))
    begins = F.flatten(F.transform(places, lambda i: F.transform(F.filter(listed, lambda p: p["w"] == F.get(words, i)), lambda p: p["base"] + i)))
    place = lambda c: F.struct((c / _SPAN).cast("int").alias("t"), (c % _SPAN - _BEFORE).cast("int").alias("start"))

    def weigh(c: Column) -> Column:
        stands = lambda i: F.coalesce(F.get(words, c["start"] + i) == F.get(x["words"], i), F.lit(False))
        x = F.get(known, c["t"])
        shared = F.aggregate(F.transform(x["weights"], lambda v, i: F.when(stands(i), v).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
        verified = F.forall(x["keys"], stands)
        return F.struct(c["t"].alias("t"), c["start"].alias("start"), F.when(verified & (shared >= x["least"]), F.least(shared, F.lit(1.0))).alias("share"))

    return F.filter(F.transform(F.transform(F.array_distinct(begins), place), weigh), lambda m: m["share"].isNotNull())


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, share: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score.

    Words are runs of a-z, 0-9 and all characters beyond ASCII, after
    lower-casing A-Z.  A base phrase counts wherever its words stand
    consecutively, overlaps included; first_word and last_word are the smallest
    and largest word at which one begins, null where none does.  A notice counts
    where its key phrases stand at their places and words of ``share`` of its
    weight do.  ``labels`` has those of both, ``score`` the largest share of a
    template found (1 for a base phrase, 0 for none).  A null or empty text has
    no words and empty label lists.  Repeated rows and null ids stay rows of
    their own; other columns are not read; an empty table gives no rows.
    """
    found = templates(phrases, notices, share)
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    vocabulary = sorted({w for x in found for w in x.words})
    # the empty word, which no text has, counts the rows; as many rows come back as templates have words
    seen = rows.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", F.array(*map(F.lit, vocabulary))))).alias("word"))
    df = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    idf = {w: weight(df.get("", 0), df.get(w, 0)) for w in vocabulary}

    labels = F.array(*(F.lit(x.label) for x in found))
    n_base = sum(x.base for x in found)  # base templates come first
    out = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), _matches(F.col("words"), found, idf).alias("matches"))
    starts = F.transform(F.filter("matches", lambda m: m["t"] < n_base), lambda m: m["start"].cast("long"))
    out = out.select("doc_id", "n_words", "matches", starts.alias("starts"))
    named = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: F.get(labels, m["t"])))), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        named(F.filter("matches", lambda m: m["t"] < n_base)).alias("base_labels"),
        named(F.col("matches")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)), 6).alias("score"),
    )


def oracle(share: float = 0.7) -> str:
    """The same by comparing every word of every text with every template."""
    found = templates(share=share)
    said = lambda rows: ", ".join(f"({', '.join(map(repr, r))})" for r in rows)
    kinds = said([(t, x.label, int(x.base), x.share - 1e-9) for t, x in enumerate(found)])
    postings = said([(t, i, w) for t, x in enumerate(found) for i, w in enumerate(x.words)])
    keys = said([(t, i) for t, x in enumerate(found) for a, z in x.keys for i in range(a, z)])
    return f"""WITH kind(t, label, base, least) AS (VALUES {kinds}), post(t, i, w) AS (VALUES {postings}), keyed(t, i) AS (VALUES {keys}),
        d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
        w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM d),
        near AS MATERIALIZED (SELECT * FROM w WHERE w IN (SELECT w FROM post)),
        idf AS (SELECT w, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 0.5)) AS v FROM (SELECT DISTINCT w FROM post) LEFT JOIN (SELECT w, count(DISTINCT r) AS df FROM near GROUP BY w) USING (w)),
        total AS (SELECT t, sum(v) AS v FROM post JOIN idf USING (w) GROUP BY t),
        laid AS (SELECT r, t, place - i AS start, sum(v) AS v, list(i) AS stood FROM near JOIN post USING (w) JOIN idf USING (w) GROUP BY ALL),
        need AS (SELECT t, list(i) AS must FROM keyed GROUP BY t),
        hit AS (SELECT r, start, label, base, laid.v / total.v AS share FROM laid JOIN total USING (t) JOIN kind USING (t) JOIN need USING (t) WHERE laid.v / total.v >= least AND list_has_all(stood, must)),
        s AS (SELECT r, count(*) FILTER (base = 1) AS n_base, min(start) FILTER (base = 1) AS first_word, max(start) FILTER (base = 1) AS last_word,
            array_to_string(list_sort(list(DISTINCT label) FILTER (base = 1)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM hit GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
            coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(least(coalesce(score, 0), 1), 6)::DOUBLE AS score FROM d LEFT JOIN s USING (r)"""

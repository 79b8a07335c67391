"""Vector codes and licence scans against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import licences, vector_codes

LOW = str.maketrans(licences.UPPER, licences.LOWER)


def lloyd(rows, entries, rounds, parts=4):
    """Every part against every entry, in whole Python numbers."""
    kept = [(i, l, [math.floor(1024 * x) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max([len(v) for *_, v in kept], default=0) // parts))
    cut = lambda v: [tuple((v + [0] * (width * parts))[p * width : (p + 1) * width]) for p in range(parts)]
    kept = sorted(((i, l, v, cut(v)) for i, l, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    books = [[r[3][p] for r in kept[:entries]] for p in range(parts)]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (off(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for r in kept:
                held.setdefault(nearest(p, r[3][p]), []).append(r[3][p])
            books[p] = [tuple(sum(c) // len(held[e]) for c in zip(*held[e])) if e in held else b for e, b in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(r[0], r[1], [nearest(p, r[3][p]) for p in range(parts)], r[3]) for r in kept]
    out = [(i, l, "".join(f"{c:02x}" for c in code), sum(off(x, books[p][c]) for p, (x, c) in enumerate(zip(v, code)))) for i, l, code, v in coded]
    return [(i, code, e, sum(y[3] for y in out if y[1] == l), digest) for i, l, code, e in out]


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, part int, v string, of int"


def vectors(n=900, seed=3, dim=16):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.4, (12, dim))
    rows = [(int(i), [float(x) for x in np.float32(middles[rng.integers(12)] + rng.normal(0, 0.05, dim))], int(rng.integers(5))) for i in rng.permutation(n)]
    same_text = rows[7][1]
    odd = [(5000, None, 1), (5001, [1.0, None] * 8, 1), (5002, [float("nan")] + [0.0] * 15, 2), (5003, [float("inf")] * 16, 2), (None, same_text, None), (None, [-0.5] * 16, None)]
    short = [(5004, [0.25, -0.75, 1.0], 3), (5005, [], None)]
    return [*rows, *odd, *short, rows[3], rows[3], *((6000 + i, same_text, 9) for i in range(400))]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "c", 1, 2, "v", 3) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("entries", [7, 40])
def test_op11_equals_brute_force(spark, entries):
    rows = vectors()
    same(vector_codes.compress_vectors(frame(spark, rows), entries=entries).collect(), lloyd(rows, entries, 4))


def test_op11_does_not_depend_on_blocks(spark, monkeypatch):
    rows = vectors(300)
    want = vector_codes.compress_vectors(frame(spark, rows, 1), entries=20).collect()
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 50)
    same(vector_codes.compress_vectors(frame(spark, rows, 5), entries=20).collect(), want)


def test_op11_few_rows_ties_and_none(spark):
    ties = [(i, [0.5, 0.5, 0.5, 0.5] if i % 2 else [0.0, 0.0, 0.0, 0.0], None) for i in range(8)]
    same(vector_codes.compress_vectors(frame(spark, ties)).collect(), lloyd(ties, 256, 4))
    assert vector_codes.compress_vectors(frame(spark, [])).count() == 0
    assert vector_codes.compress_vectors(frame(spark, [(1, None, 1)])).count() == 0
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress_vectors(frame(spark, [(1, [1e30] * 4, 1)]))


def test_op11_trees_settle_whole_subtrees():
    """Clustered parts are assigned by nodes; both ways give what brute force does."""
    rng = np.random.default_rng(1)
    points = (rng.integers(0, 6, (4000, 1)) * 10_000 + rng.integers(-50, 50, (4000, 4))).astype(np.int64)
    entries = np.array([[k * 10_000] * 4 for k in range(6)] + [[0, 0, 0, 1]])
    order, low, high, total = vector_codes.build(points)
    assert sorted(order.tolist()) == list(range(4000))
    book, laid = vector_codes.Book(entries, 60_000), points[order]
    got, by_node = np.full(4000, -1), 0
    for node, a, z, entry in vector_codes.send_down(book, laid, low, high):
        assert (got[a:z] == -1).all()
        got[a:z] = entry
        if isinstance(entry, int):
            by_node += z - a
            assert (total[node] == laid[a:z].sum(axis=0)).all()
    want = ((laid[:, None, :] - entries) ** 2).sum(axis=2).argmin(axis=1)
    assert (got == want).all() and by_node > 2000
    # beyond exact doubles the same comes out of whole numbers
    wide = vector_codes.Book(entries * 1000, 60_000_000)
    assert wide.kind is np.int64
    for _, a, z, entry in vector_codes.send_down(wide, laid * 1000, low * 1000, high * 1000):
        assert (want[a:z] == entry).all()


# Licences


def scan(rows, phrases=licences.PHRASES, notices=licences.NOTICES, share=0.7):
    """Every template at every place of every text."""
    found = licences.templates(phrases, notices, share)
    split = [(i, re.findall(licences.WORD, (t or "").translate(LOW))) for i, t in rows]
    idf = {w: math.log((len(rows) + 1) / (sum(w in set(ws) for _, ws in split) + 0.5)) for x in found for w in x.words}
    out = []
    for i, ws in split:
        hits = []
        for x in found:
            total = sum(idf[w] for w in x.words)
            for start in range(-len(x.words), len(ws)):
                stands = [0 <= start + j < len(ws) and ws[start + j] == w for j, w in enumerate(x.words)]
                part = sum(idf[w] for w, s in zip(x.words, stands) if s) / total
                if part >= x.share - 1e-9 and all(all(stands[a:z]) for a, z in x.keys):
                    hits.append((x, start, min(1.0, part)))
        base = [s for x, s, _ in hits if x.base]
        name = lambda xs: ",".join(sorted({x.label for x in xs}))
        out.append((i, len(ws), len(base), min(base, default=None), max(base, default=None), name(x for x, *_ in hits if x.base), name(x for x, *_ in hits), round(max((p for *_, p in hits), default=0.0), 6)))
    return out


def licence_texts():
    rng = random.Random(5)
    vocabulary = sorted({w for x in licences.templates() for w in x.words}) + ["Ünder", "日本", "zz", "q9"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    notices = [n for _, n, _ in licences.NOTICES] + [p for p, _ in licences.PHRASES]
    texts = ["", None, "   ", "cc by", "CC-BY cc by", "cc_by", "CC By cc by cc by", "MIT  License", "the mitlicense mit\tlicense.", "Apache\nLicense, Version 2.0", "version 2 0 of the apache license version 2 0", "a" * 100_000]
    texts += [f"{say(rng.randint(0, 30))} {rng.choice(notices)}, {say(rng.randint(0, 30))}" for _ in range(60)]
    for _ in range(80):  # notices with words changed or cut off
        w = rng.choice(notices).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w[rng.randint(0, 3) :]))
    texts += [say(200) for _ in range(30)] + ["cc by " * 5000 + "end"]
    return texts


def test_op12_equals_brute_force(spark):
    rows = list(enumerate(licence_texts())) + [(None, "mit license"), (3, "cc by")]
    frame = spark.createDataFrame([(*r, "x", 1, [2], 3.0) for r in rows], "doc_id long, text string, words string, n_words int, matches array<int>, starts double").repartition(4)
    got = licences.license_scan(frame)
    want = scan(rows)
    assert sum(bool(w[6]) and not w[5] for w in want) >= 5 and sum(0 < w[7] < 1 for w in want) >= 3
    same(got.collect(), want)
    assert licences.license_scan(frame.limit(0)).count() == 0


def test_op12_index_misses_no_match():
    """Whatever holds a share of a template's weight holds an indexed word of it."""
    rng = random.Random(2)
    found = licences.templates()
    idf = {w: rng.choice([0.01, 1.0, 5.0]) * rng.random() for x in found for w in x.words}
    chosen = licences.index(found, idf)
    for t, x in enumerate(found):
        left = sum(idf[w] for w in x.words) - sum(idf[w] for w, u, _ in chosen if u == t)
        assert left < x.share * sum(idf[w] for w in x.words)
    with pytest.raises(ValueError, match="key phrase"):
        licences.templates(notices=(("x", "some words", ("other",)),))


def test_op12_plan_has_no_python(spark):
    frame = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = licences.license_scan(frame.where(F.col("doc_id") > 0))._jdf.queryExecution().toString()
    assert not re.search("python|pandas|arrow", plan, re.IGNORECASE)

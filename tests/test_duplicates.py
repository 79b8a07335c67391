"""Near-duplicates in large groups and long chains."""

import random

from pyspark.sql import functions as F

from recollect.functions.embedding import LocalEmbedder
from recollect.operators import memory

SCHEMA = "id string, content string, importance double, created_at long"


def sequential(pairs, n):
    gone = set()
    for b in range(n):
        if any((a, b) in pairs and a not in gone for a in range(b)):
            gone.add(b)
    return gone


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(2000)], "a int, b int")
    rounds = []
    settle = memory.settle
    monkeypatch.setattr(memory, "settle", lambda df: rounds.append(1) or settle(df))
    got = {r.id for r in memory.removed_by(chain).collect()}
    assert got == set(range(1, 2001, 2)) and len(rounds) < 20
    # with no task allowed to go through many, the rounds come to the same
    short = spark.createDataFrame([(i, i + 1) for i in range(24)], "a int, b int")
    assert {r.id for r in memory.removed_by(short, local_pairs=0).collect()} == set(range(1, 25, 2))


def test_one_task_decides_as_the_pass_does(spark, monkeypatch):
    monkeypatch.setattr(memory, "ROUNDS", 0)
    rng = random.Random(4)
    for kind in ("int", "string"):
        pairs = {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.12}
        rows = [(a, b) if kind == "int" else (f"{a:02}", f"{b:02}") for a, b in pairs]
        got = {int(r.id) for r in memory.removed_by(spark.createDataFrame(rows, f"a {kind}, b {kind}")).collect()}
        assert got == sequential(pairs, 40)


def test_a_large_group_is_settled_by_its_first_row(spark, monkeypatch):
    """A thousand variants of one text: comparisons linear in them."""
    base = " ".join(f"word{i} again{i}" for i in range(40))
    rows = [(f"m{i:04}", f"{base} unique{i}", 0.5, i) for i in range(1000)] + [("other", "something else altogether", 0.5, 0)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    compared = []
    alike = memory._alike
    monkeypatch.setattr(memory, "_alike", lambda pairs, *a: compared.append(pairs.count()) or alike(pairs, *a))
    gone = {r.id for r in memory.duplicates(table, LocalEmbedder()).collect()}
    assert gone == {f"m{i:04}" for i in range(1, 1000)}
    assert sum(compared) <= 2000


def test_lengths_at_the_edge_of_a_band_meet(spark):
    """Sets of 4 n and 5 n tokens overlap by exactly 0.8."""
    rows = []
    for n in range(1, 9):
        small = " ".join(f"s{n}x{i}" for i in range(4 * n))
        rows += [(f"a{n}", small, 0.9, 0), (f"b{n}", small + " " + " ".join(f"t{n}y{i}" for i in range(n)), 0.5, 0)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.array(F.lit(1.0)))
    got = {(r.a, r.b): round(r.overlap, 6) for r in memory.near_duplicates(table).collect()}
    assert got == {(f"a{n}", f"b{n}"): 0.8 for n in range(1, 9)}


def test_unlike_texts_of_common_words_are_not_compared(spark, monkeypatch):
    """Texts of one small vocabulary, where each word is in many: candidates are
    few, and yet no pair of overlap 0.8 is missed."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(300)]
    texts = [rng.sample(words, rng.choice((1, 2, 3, 6, 14, 40, 80, 120))) for _ in range(400)]
    for said in texts[:200]:
        near = said[rng.randint(0, len(said) // 8) :] + [f"own{rng.randint(0, 9)}" for _ in range(rng.randint(0, len(said) // 8))]
        texts.append(near or said)
    rows = [(f"m{i:03}", " ".join(said), 0.5, 0) for i, said in enumerate(texts)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.array(F.lit(1.0)))
    compared = []
    alike = memory._alike
    monkeypatch.setattr(memory, "_alike", lambda pairs, *a: compared.append(pairs.count()) or alike(pairs, *a))
    got = {(r.a, r.b) for r in memory.near_duplicates(table).collect()}
    first = {}
    for id, text, *_ in rows:
        first.setdefault(text, id)
    held = {id: set(text.split()) for text, id in first.items()}
    wanted = {(a, b) for a in held for b in held if a < b and 5 * len(held[a] & held[b]) >= 4 * len(held[a] | held[b])}
    assert got == wanted and len(wanted) > 80
    assert sum(compared) <= 4 * len(wanted), compared


def test_keys_are_fewer_than_tokens_by_half(spark):
    rng = random.Random(3)
    rows = [(i, [rng.getrandbits(60) for _ in range(rng.choice((20, 90, 190, 350, 900)))]) for i in range(200)]
    sets = spark.createDataFrame(rows, "id int, tokens array<long>")
    assert memory._rare_keys(sets).count() <= 0.55 * sum(len(t) for _, t in rows)


def test_sets_at_the_limit_share_a_key_and_pass_the_sketches(spark):
    """Around the sizes where bands and sketches change; unlike sets do not pass."""
    rng = random.Random(5)
    rows, pairs = [], []
    for n in (1, 2, 3, 4, 5, 8, 9, 12, 51, 52, 63, 64, 65, 80, 81, 103, 128, 129, 160, 161, 257, 1025):
        some = [rng.getrandbits(60) for _ in range(n)]
        for less in {0, n // 10, n // 5}:
            more = 5 * (n - less) // 4 - n
            other = some[less:] + [rng.getrandbits(60) for _ in range(more)]
            pairs.append((2 * len(pairs), 2 * len(pairs) + 1))
            rows += [(pairs[-1][0], some), (pairs[-1][1], rng.sample(other, len(other)))]
    sets = spark.createDataFrame(rows, "id long, tokens array<long>")
    keys = {}
    for r in memory._rare_keys(sets).collect():
        keys.setdefault(r.id, set()).add(r.key)
    assert all(keys[p] & keys[q] for p, q in pairs)
    apart = [(p, q + 6) for p, q in pairs if q + 6 < len(rows) and len(rows[p][1]) > 4]
    passed = {tuple(r) for r in memory._screened(spark.createDataFrame(pairs + apart, "p long, q long"), memory._sketches(sets)).collect()}
    assert passed == set(pairs)


def test_a_few_ids_are_met_without_a_shuffle_of_the_rows(spark, monkeypatch):
    table, ids = spark.range(1000).withColumn("text", F.lit("said")), memory.settle(spark.range(0, 20, 2))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, word in ((1000, "BroadcastHashJoin"), (3, "SortMergeJoin")):
            monkeypatch.setattr(memory, "FEW", most)
            assert word in plan(memory.among(table, ids)) and memory.among(table, ids).count() == 10
            assert memory.among(table, ids, "left_anti").count() == 990
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_candidates_come_once_in_order_and_are_compared_by_blocks(spark, monkeypatch):
    """Variants of one text beside unlike ones: pairs of many shared keys are told
    once, the earlier one first; small blocks come to what all pairs do."""
    monkeypatch.setattr(memory, "BLOCK", 4)
    rng = random.Random(11)
    base, rows = [f"word{i}" for i in range(60)], []
    for i in range(80):
        said = base[rng.randint(0, 6) :] if i % 2 else rng.sample(base, 30)
        rows.append((f"m{i:02}", " ".join([*said, f"one{i}", *(f"own{rng.randint(0, 40)}" for _ in range(rng.randint(0, 3)))]), rng.choice((0.2, 0.5)), rng.randint(0, 3)))
    table = spark.createDataFrame(rows, SCHEMA)
    # vectors of unlike lengths are not alike
    table = table.withColumn("embedding", F.when(F.col("id") < "m60", F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0))))
    before, held = {r[0]: (-r[2], r[3], r[0]) for r in rows}, {r[0]: set(r[1].split()) for r in rows}
    sets = memory._token_sets(table, memory.duplicate_classes(table))
    met = [tuple(r) for r in memory._candidates(sets).collect()]
    near = {(a, b) for a in held for b in held if before[a] < before[b] and 5 * len(held[a] & held[b]) >= 4 * len(held[a] | held[b])}
    assert len(met) == len(set(met)) and near <= set(met) and all(before[p] < before[q] for p, q in met)
    got = {(r.a, r.b): round(r.overlap, 6) for r in memory.near_duplicates(table).collect()}
    assert got == {(a, b): round(len(held[a] & held[b]) / len(held[a] | held[b]), 6) for a, b in near if (a < "m60") == (b < "m60")} and len(got) > 100

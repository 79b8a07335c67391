"""Search, ingest, memories, sessions, the store, sync and the command line."""

import json
import os
import random
import sqlite3
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recollect import cli, config
from recollect.functions.embedding import LocalEmbedder
from recollect.operators import ingest, memory, search, session
from recollect.plans import store as store_module
from recollect.plans.pages import document_pages
from recollect.plans.schema import TABLES
from recollect.plans.store import Store
from recollect.sources import chatdb, chattail, logtail, readers
from recollect.streaming.sync import sync_batch, sync_chats, sync_logs

ROWS = "content string, title string, source string, content_type string, metadata string, scope string"
E = LocalEmbedder()


def test_bm25_is_fts5(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gammas", "deltaic", "aaa", "aaaa", "über", "x"]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(content, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram tokenizer")
    db.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", enumerate(docs))
    df = spark.createDataFrame(list(enumerate(docs)), "id int, content string")
    for q in ("alpha", "alpha beta", "gamma x", "beta beta", "aaa", "über deltaic", "zz", "nothing"):
        tokens = [t for t in q.split() if len(t) > 2]
        want = dict(db.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ?", (" ".join(f'"{t}"' for t in tokens),))) if tokens else {}
        got = {r.id: r.bm25 for r in search.keyword_search(df, q, 1000).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def legs(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.3)], "id string, score double")
    k = spark.createDataFrame([("b", 4.0), ("d", 2.0)], "id string, bm25 double")
    return v, k


def test_fusion_closed_forms(spark):
    v, k = legs(spark)
    got = {r.id: r for r in search.fuse(v, k, 10, 0.0).collect()}
    assert abs(got["b"].rrf_score - (1 / 62 + 1 / 61)) < 1e-12 and got["b"].rank == 0 and got["b"].legs == ["vector", "keyword"]
    assert got["d"].score == pytest.approx(1 - 1 / 3) and got["b"].score == 1.0 and got["b"].keyword_score == 1.0
    assert [r.id for r in sorted(got.values())] == ["b", "a", "d", "c"]
    blend = {r.id: r.score for r in search.fuse(v, k, 10, 0.0, alpha=0.25).collect()}
    assert blend == pytest.approx({"a": 0.225, "b": 0.2 + 0.75, "c": 0.075, "d": 0.375})
    # the cut comes before the threshold
    assert [r.id for r in search.fuse(v, k, 2, 0.95).collect()] == ["b"]
    assert [r.id for r in search.fuse(None, k, 2, 0.0).collect()] == ["b", "d"]
    with pytest.raises(ValueError):
        search.fuse(v, k, alpha=1.5)


def rows(spark, *items):
    return spark.createDataFrame([(c, t, s, None, None, scope) for c, t, s, scope in items], ROWS)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", E)


def put(store, spark, *items, now=1000):
    got = ingest.ingest(rows(spark, *items), store.read("documents"), E, now)
    report = got.report.collect()
    if not got.documents.isEmpty():
        store.add(got)
    return report


def test_ingest_search_and_maintenance(spark, store, tmp_path):
    r = put(store, spark, ("The zzzqx engine stores vectors.", "one", "s1", None), ("A purple sky over hills.", "two", "s2", None), ("A purple sky over hills.", "again", "s2", None), (" ", "blank", None, None), (None, "null", None, None))
    assert sorted((x.title, x.deduplicated, x.error) for x in r) == [("again", False, None), ("blank", False, "empty text"), ("null", False, "empty text"), ("one", False, None), ("two", True, None)]
    assert put(store, spark, ("A purple sky over hills.", "later", None, None))[0].deduplicated
    assert store.read("documents").count() == 2
    # scopes keep equal texts apart
    put(store, spark, ("ok", "a", "s", "sess-a:1"), ("ok", "b", "s", "sess-b:1"))
    assert not put(store, spark, ("ok", "c", "s", "sess-c:1"))[0].deduplicated and put(store, spark, ("ok", "d", "s", "sess-a:1"))[0].deduplicated
    chunks, documents = store.read("chunks"), store.read("documents")
    for mode in ("hybrid", "keyword", "vector"):
        hits = search.search_chunks(chunks, "zzzqx", E.query("zzzqx"), mode=mode)
        top = search.hydrate(hits, chunks, documents).orderBy("rank").first()
        assert top.doc_title == "one"
    only = search.search_chunks(chunks, "sky", E.query("sky"), allowed=F.col("doc_id") == "nothing")
    assert only.count() == 0
    assert store.integrity().where("violations > 0").count() == 0
    stats = ingest.document_stats(documents, chunks).first()
    assert stats.documents == 5 == store.stats()["documents"] and stats.tokens == chunks.agg(F.sum("token_count")).first()[0]
    # backup, damage, restore
    store.backup(f"file://{tmp_path}/copy")
    with pytest.raises(FileExistsError):
        store.backup(f"file://{tmp_path}/copy")
    store.clear()
    assert store.read("documents").count() == 0 and store.stats()["integrity"] == "ok"
    store.restore(f"file://{tmp_path}/copy")
    assert store.read("documents").count() == 5
    d, c = ingest.delete_document(store.read("documents"), store.read("chunks"), documents.where("title = 'one'").first().id)
    store.commit({"documents": d, "chunks": c})
    assert store.read("chunks").count() == 4 and store.integrity().where("violations > 0").count() == 0
    assert [x.title for x in ingest.list_documents(store.read("documents"), 0).collect()] != []


def test_reindex_guard(spark, store):
    put(store, spark, ("some text", "t", None, None))

    class Other(LocalEmbedder):
        model = "other"

    other = Store(spark, store.path, Other())
    with pytest.raises(RuntimeError):
        other.check()
    assert other.reindex().first().chunks == 1
    other.check()
    with pytest.raises(RuntimeError):
        store.check()

    class Broken(LocalEmbedder):
        def column(self, text):
            raise OSError("no model")

    with pytest.raises(OSError):
        Store(spark, store.path, Broken()).reindex()
    with pytest.raises(RuntimeError, match="reindex"):
        other.check()


def test_reindex_goes_on_where_it_broke_off(spark, store):
    """Of three segments one cannot be embedded; the next run embeds that one only."""
    put(store, spark, ("first text", "a", None, None))
    put(store, spark, ("second text", "b", None, None), now=2000)
    gone = store.read("documents").where("title = 'a'").select("id", F.col("id").alias("doc_id"))
    store.change(drop={"documents": gone, "chunks": gone})
    store.commit({"memories": plain(spark, ["m"])}, append=True)

    class Other(LocalEmbedder):
        model, calls, broken = "other", 0, True

        def column(self, text):
            self.calls += 1
            if self.broken and self.calls == 4:
                raise OSError("no model")
            return super().column(text)

    e = Other()
    other = Store(spark, store.path, e)
    with pytest.raises(OSError):
        other.reindex()
    with pytest.raises(RuntimeError, match="reindex"):
        other.check()
    e.broken, e.calls = False, 0
    done = other.reindex().first()
    assert done.reused == 3 and e.calls == 1 and (done.chunks, done.memories) == (1, 1)
    other.check()
    assert [r.content for r in other.read("chunks").collect()] == ["second text"]
    assert other.integrity().where("violations > 0").count() == 0


def plain(spark, names, importance=0.5):
    got = [(n, "fact", n, importance, [1.0], ["t"], 0, None, 1, 1) for n in names]
    return spark.createDataFrame(got, TABLES["memories"])


def test_changes_are_keyed(spark, store, monkeypatch):
    """Random appends, replacements and removals against a dict, put together
    after every second segment; the store then holds few segments."""
    monkeypatch.setattr(store_module, "MOST_SEGMENTS", 3)
    rng, want = random.Random(4), {}
    for n in range(14):
        new = [f"m{n}-{i}" for i in range(8 if n == 0 else rng.randint(0, 2))]
        put = rng.sample(sorted(want), min(len(want), rng.randint(0, 3)))
        drop = rng.sample(sorted(want), min(len(want), rng.randint(0, 2))) + ["unknown"]
        if n % 3 == 2:
            store.change({"memories": plain(spark, put, n / 100)}, {"memories": spark.createDataFrame([(x,) for x in [*drop, None]], "id string")})
            want.update(dict.fromkeys(put, n / 100))
            for x in drop:
                want.pop(x, None)
        elif n % 3 == 1 and put:
            # a row that comes back after its removal
            store.change(drop={"memories": spark.createDataFrame([(x,) for x in put], "id string")})
            store.commit({"memories": plain(spark, put, n / 100)}, append=True)
            want.update(dict.fromkeys(put, n / 100))
        else:
            store.commit({"memories": plain(spark, new)}, append=True)
            want.update(dict.fromkeys(new, 0.5))
        assert sorted((r.id, r.importance) for r in store.read("memories").collect()) == sorted(want.items())
        assert len(store.manifest()["tables"]["memories"]) <= 3
    assert store.read("memories").columns == [f.split()[0] for f in TABLES["memories"].split(", ")]


def test_few_changes_rewrite_no_base(spark, store, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_SEGMENTS", 3)
    store.commit({"memories": plain(spark, [f"{random.Random(i).random()}" * 9 for i in range(3000)])})
    base = store.manifest()["tables"]["memories"]
    one = store.read("memories").orderBy("id").limit(1)
    for n in range(5):
        store.change({"memories": one.withColumn("recall_count", F.lit(n).cast("int"))})
    at = store.manifest()["tables"]["memories"]
    assert at[0] == base[0] and len(at) <= 3
    got = store.read("memories")
    assert got.count() == 3000 and got.agg(F.max("recall_count")).first()[0] == 4
    # what no segment lies in goes, once it is old
    folders = lambda: {x.name for x in Path(store.path.removeprefix("file://")).glob("v*")}
    assert store.vacuum() == 0 and len(folders()) == 6
    assert store.vacuum(0.0) == 6 - len(folders()) > 0 and store.read("memories").count() == 3000


def test_a_dead_writers_lock_is_broken(spark, store):
    store.commit({"memories": plain(spark, ["a"])})
    lock = Path(store.path.removeprefix("file://")) / "writer.lock"
    lock.write_text("someone")
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit({"memories": plain(spark, ["b"])})
    assert lock.read_text() == "someone"
    os.utime(lock, (1, 1))
    store.commit({"memories": plain(spark, ["b"])})
    assert not lock.exists() and [r.id for r in store.read("memories").collect()] == ["b"]
    # a holder renews its lock, and does not commit once it has lost it
    quick = Store(spark, store.path, E, lock_s=0.4)
    with quick._locked() as me:
        os.utime(lock, (1, 1))
        time.sleep(0.5)
        with pytest.raises(RuntimeError, match="another writer"):
            quick.commit({"memories": plain(spark, ["c"])})
        (lock.parent / ".writer.lock.crc").unlink(missing_ok=True)
        lock.write_text("thief")
        with pytest.raises(RuntimeError, match="took"):
            quick._commit(me, {"memories": plain(spark, ["c"])}, "replace")
    assert lock.read_text() == "thief" and [r.id for r in store.read("memories").collect()] == ["b"]


def test_writes_are_decided_under_the_lock(spark, store):
    """Two writers that prepared their work from one version."""
    one, two = Store(spark, store.path, E), Store(spark, store.path, E)
    store.commit({"memories": plain(spark, ["a", "b"])}, **store._space())
    hits = spark.createDataFrame([("a",)], "id string")
    one.recalled(hits, 5)
    two.recalled(hits, 6)
    assert {r.id: (r.recall_count, r.last_recalled) for r in store.read("memories").collect()} == {"a": (2, 6), "b": (0, None)}
    text = rows(spark, ("One text for two writers.", "t", "s", None))
    first, second = (ingest.ingest(text, store.read("documents"), E, n) for n in (1, 2))
    one.add(first)
    two.add(second)
    assert store.read("documents").count() == 1 and store.read("chunks").count() == 1
    assert [r.deduplicated for r in two.ingest(text, 3).collect()] == [True]
    assert [r.deduplicated for r in one.ingest(rows(spark, ("Another text.", "t", "s", None)), 3).collect()] == [False]
    wrong = {r.invariant for r in store.integrity().where("violations > 0").collect()}
    assert wrong <= {"memories.embedding size"} and store.read("documents").count() == 2  # the memories here have vectors of one number


def test_a_writer_waits_for_another(spark, store):
    store.commit({"memories": plain(spark, ["a"])})
    patient = Store(spark, store.path, E, wait_s=20.0)
    with store._locked():
        late = threading.Thread(target=lambda: patient.commit({"memories": plain(spark, ["b"])}))
        late.start()
        time.sleep(1.0)
        assert [r.id for r in store.read("memories").collect()] == ["a"]
    late.join()
    assert [r.id for r in store.read("memories").collect()] == ["b"]


def test_a_text_said_often_is_one_tasks_row(spark):
    """Equal texts, titles and sources included: one row counts, the others are duplicates."""
    items = [("same text", "t", "s", None)] * 5 + [("same text", "a", "s", None), ("other", "t", None, None)]
    got = ingest.ingest(rows(spark, *items).repartition(3), spark.createDataFrame([], TABLES["documents"]), E, 1)
    assert sorted((r.title, r.deduplicated) for r in got.report.collect()) == [("a", False)] + [("t", False)] + [("t", True)] * 5
    assert got.documents.count() == 2


def documents_of(spark, ids, at=lambda i: i % 3):
    return spark.createDataFrame([(f"d{i:03}", "t", "s", "text", "{}", 0, 1, at(i), f"h{i}") for i in ids], TABLES["documents"])


def test_pages_are_of_one_version(spark, store):
    """A writer adds, changes and removes between pages: none repeats, none is lost."""
    store.commit({"documents": documents_of(spark, range(25))})
    want = [r.id for r in store.read("documents").orderBy(F.desc("updated_at"), "id").collect()]
    got, cursor, n = [], None, 0
    while n == 0 or cursor:
        page, cursor = document_pages(store, 4, cursor)
        got += [r["id"] for r in page]
        store.commit({"documents": documents_of(spark, [100 + n])}, append=True)
        store.change(put={"documents": documents_of(spark, [n], lambda i: 9)}, drop={"documents": documents_of(spark, [24 - n])})
        n += 1
    assert got == want and n == 7
    assert document_pages(store, 1)[0][0]["updated_at"] == 9
    with pytest.raises(ValueError, match="cursor"):
        document_pages(store, 4, "bm8=")


def test_a_look_up_reads_no_other_row_groups(spark, store):
    """Ids in the range of a segment's, but not in it: its Bloom filter says so."""
    store.commit({"memories": plain(spark, [f"m{i * 2:06}" for i in range(4000)])})

    def scanned(id):
        rows = memory.get_memory(store.read("memories"), id)
        rows.collect()
        p = rows._jdf.queryExecution().executedPlan()
        p = p.executedPlan() if "Adaptive" in p.nodeName() else p
        return p.collectLeaves().apply(0).metrics().apply("numOutputRows").value(), len(rows.collect())

    assert scanned("m000011") == (0, 0)
    read, found = scanned("m000010")
    assert found == 1 and 0 < read


def test_a_page_comes_with_its_total(spark):
    docs = spark.createDataFrame([(f"d{i}", "t", "s", "text", "{}", 1, i, i % 3, "h") for i in range(7)], TABLES["documents"])
    page = ingest.document_page(docs, 3, 2).collect()
    assert len(page) == 3 and {r.total for r in page} == {7}


def mem(spark, items):
    schema = "id string, type string, content string, importance double, tags array<string>, recall_count int, last_recalled long, created_at long, updated_at long"
    df = spark.createDataFrame(items, schema)
    return df.withColumn("embedding", E.column(F.col("content")))


DAY = 86_400_000


def test_memories(spark):
    m = mem(
        spark,
        [
            ("a", "fact", "deploy with blue green strategy", 0.9, ["ops", "x"], 0, None, 0, 5),
            ("b", "odd", "deploy with blue green strategy", 0.5, None, 6, None, 1, 4),
            ("c", "task", "buy milk", float("nan"), ["opsy"], 0, 390 * DAY, 2, 4),
            ("d", "task", "old and idle note", 0.1, [], 0, None, 0, 1),
            ("e", "task", "recalled note stays", 0.1, [], 5, None, 0, 1),
        ],
    )
    assert [r.id for r in memory.list_memories(m).collect()] == ["a", "c", "b", "e", "d"]
    assert [r.id for r in memory.list_memories(m, tag="ops").collect()] == ["a"]
    fixed = {r.id: r for r in memory.list_memories(m).collect()}
    assert fixed["b"].type == "fact" and fixed["c"].importance == 0.5 and fixed["b"].tags == []
    now = 400 * DAY
    fresh = memory.recall(m, E.query("deploy with blue green strategy"), DAY, 3, 0.1).collect()
    assert [r.id for r in fresh[:2]] == ["b", "a"] and fresh[0].score < 1
    # full match, but older than the floor allows
    assert "a" not in [r.id for r in memory.recall(m, E.query("deploy with blue green strategy"), now).collect()]
    bumped = {r.id: r for r in memory.bump(m, m.where("id = 'a'"), now).collect()}
    assert bumped["a"].recall_count == 1 and bumped["a"].last_recalled == now and bumped["b"].recall_count == 6
    after, report = memory.consolidate(m, now, prune=True)
    assert report.first()[:4] == (1, 1, 1, False)
    assert {r.id: r.importance for r in after.where("id <> 'c'").collect()} == {"a": 0.9, "e": 0.2}
    again, report2 = memory.consolidate(after.where("id <> 'e'"), now)
    assert report2.first()[:3] == (0, 0, 0)
    assert memory.consolidate(m, now, max_vectors=2, enforce_ceiling=True)[1].first().skipped_dedup
    patched = {r.id: r for r in memory.update_memory(m, "d", {"content": "new", "importance": 3.0}, 77, E).collect()}
    assert patched["d"].content == "new" and patched["d"].importance == 1.0 and patched["d"].updated_at == 77 and patched["a"].updated_at == 5
    assert memory.update_memory(m, "d", {}, 77) is m and memory.forget(m, "d").count() == 4
    line = memory.memory_context(memory.recall(m, E.query("buy milk"), now, 1)).first().context
    assert line.endswith("buy milk") and line.startswith("[task, importance")


def test_near_duplicates_need_both_gates(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    twice = " ".join([base] * 6)
    items = [("p", twice, 0.9), ("q", twice + " tau", 0.5), ("r", twice.replace("alpha", "alpha2", 1) + " " + " ".join(f"w{i}" for i in range(9)), 0.4), ("s", "something else", 0.3), ("t", "", 0.2)]
    m = mem(spark, [(i, "fact", c, w, [], 0, None, k, 0) for k, (i, c, w) in enumerate(items)])
    got = {(r.a, r.b) for r in memory.near_duplicates(m).collect()}
    rows = {r.id: r for r in m.collect()}
    import re

    sets = {i: {t for t in re.findall(r"[^\W_]+", c.lower()) if len(t) > 1} for i, c, _ in items}
    cos = lambda x, y: sum(a * b for a, b in zip(rows[x].embedding, rows[y].embedding))
    jac = lambda x, y: len(sets[x] & sets[y]) / max(1, len(sets[x] | sets[y]))
    ids = [i for i, _, _ in items]
    want = {(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :] if sets[x] and sets[y] and cos(x, y) >= 0.92 and jac(x, y) >= 0.8}
    assert got == want and ("p", "q") in got
    assert cos("p", "r") >= 0.92 and jac("p", "r") < 0.8


def test_consolidate_is_the_sequential_pass(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(12)) + f" w{i}" for i in range(6)]
    texts = [rng.choice(base) + rng.choice(["", "", " extra", " extra word"]) for _ in range(40)] + ["", "-", "x", None, "日本", "日本"]
    m = mem(spark, [(f"m{i:02}", "fact", t, rng.choice([0.2, 0.5]), [], 0, None, rng.randint(0, 3), 0) for i, t in enumerate(texts)]).cache()
    rows = sorted((r for r in m.collect() if r.embedding is not None), key=lambda r: (-r.importance, r.created_at, r.id))
    import re

    sets = {r.id: {t for t in re.findall(r"[^\W_]+", r.content.lower()) if len(t) > 1} for r in rows}
    match = lambda x, y: sets[x.id] and sets[y.id] and len(sets[x.id] & sets[y.id]) / len(sets[x.id] | sets[y.id]) >= 0.8 and sum(a * b for a, b in zip(x.embedding, y.embedding)) >= 0.92
    left = []
    for r in rows:
        if not any(match(s, r) for s in left):
            left.append(r)
    want = {r.id for r in left} | {r.id for r in m.collect() if r.embedding is None}
    assert len(want) < len(texts) - 10
    for table, e in ((m, None), (m.drop("embedding"), E)):
        assert {r.id for r in memory.consolidate(table, 0, embedder=e)[0].collect()} == want
        classes = {r.id: r.class_id for r in memory.duplicate_classes(table).collect()}
        assert set(classes) == {r.id for r in rows if sets[r.id]}
        pairs = memory.near_duplicates(table, embedder=e).collect()
        assert pairs and all(classes[r.a] == r.a and classes[r.b] == r.b for r in pairs)


def test_removal_is_the_sequential_one(spark):
    rng = random.Random(8)
    for _ in range(6):
        n = 14
        pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.15}
        gone = set()
        for b in range(n):
            if any((a, b) in pairs and a not in gone for a in range(b)):
                gone.add(b)
        df = spark.createDataFrame(sorted(pairs) or [(0, 1)], "a int, b int")
        if pairs:
            assert {r.id for r in memory.removed_by(df).collect()} == gone


def test_sessions(spark):
    s = "id string, title string, directory string, time_updated long, time_archived long, parent_id string"
    one = spark.createDataFrame([("a", "t", "C:\\w\\", 5, None, None), ("b", "t", "/x", 9, 1, None), ("c", None, "/x", 9, None, None), ("k", "t", "/x", 9, None, "a")], s)
    two = spark.createDataFrame([("a", "other", "/y", 99, None, None), ("d", "t", "/y/", 7, None, None)], s)
    got = session.list_sessions([one, two]).collect()
    assert [(r.id, r.title) for r in got] == [("d", "t"), ("a", "t")]
    assert [r.id for r in session.list_sessions([one, two], directory="C:/w").collect()] == ["a"]
    assert session.latest_session(session.list_sessions([one, two]), 90 * DAY).first().id == "d"
    with pytest.raises(ValueError, match="time_updated"):
        session.list_sessions([one.drop("time_updated")])
    messages = spark.createDataFrame([("m1", "s", 2, '{"role":"user"}'), ("m2", "s", 1, '{"role":"user"}'), ("m3", "s", 3, '{"role":"assistant"}'), ("m4", "s", 4, "{bad"), ("m5", "s", 5, '{"role":"user"}')], "id string, session_id string, time_created long, data string")
    parts = spark.createDataFrame([("p2", "m1", '{"type":"text","text":"two"}'), ("p1", "m1", '{"type":"text","text":"one"}'), ("p3", "m2", '{"type":"text","text":"first"}'), ("p4", "m2", '{"type":"tool","text":"no"}'), ("p5", "m3", '{"type":"text","text":"bot"}'), ("p6", "m5", '{"type":"text","text":"  "}')], "id string, message_id string, data string")
    got = session.transcript(messages, parts, "s").collect()
    assert [(r.ts, r.content) for r in got] == [(1, "first"), (2, "one\ntwo")]
    assert [r.content for r in session.transcript(messages, parts, "s", limit=1).collect()] == ["first"]
    bad = (messages.drop("data"), parts)
    assert session.first_transcript([bad, (messages, parts)], "s").count() == 2
    with pytest.raises(ValueError):
        session.first_transcript([bad], "s")
    with pytest.raises(LookupError, match="no such"):
        session.first_transcript([(messages, parts)], "zz")
    with pytest.raises(LookupError, match="no user text"):
        session.first_transcript([(messages, parts.limit(0))], "s")


def chat_file(path, sessions, messages=(), parts=()):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE session (id TEXT PRIMARY KEY, title TEXT, directory TEXT, time_updated INTEGER, time_archived INTEGER)")
    db.execute("CREATE TABLE message (id TEXT PRIMARY KEY, session_id TEXT, time_created INTEGER, data TEXT, other BLOB)")
    db.execute("CREATE TABLE part (id TEXT PRIMARY KEY, message_id TEXT, data TEXT)")
    db.executemany("INSERT INTO session VALUES (?, ?, ?, ?, ?)", sessions)
    db.executemany("INSERT INTO message VALUES (?, ?, ?, ?, NULL)", messages)
    db.executemany("INSERT INTO part VALUES (?, ?, ?)", parts)
    db.commit()
    db.close()


def test_chat_stores(spark, tmp_path, monkeypatch):
    good, bad = tmp_path / "chat.db", tmp_path / "bad.db"
    messages = [(f"m{i:03}", "s1", i, json.dumps({"role": "user" if i % 2 else "assistant"})) for i in range(40)]
    parts = [(f"p{i:03}", f"m{i:03}", json.dumps({"type": "text", "text": f"message number {i}"})) for i in range(40)]
    chat_file(good, [("s1", "talk", "/w", 50, None), ("s2", "old", "/x", 40, None), ("s3", "gone", "/w", 90, 1), ("s4", None, "/w", 95, None)], messages, parts)
    bad.write_text("this is no database, only a text that is long enough to be one" * 20)
    assert chatdb.chat_stores({"OPENCODE_DB": str(bad), "OPENCODE_DB_LOCAL": str(good)}, str(tmp_path)) == [str(bad), str(good)]
    assert chatdb.chat_stores({"OPENCODE_DB": str(tmp_path / "none")}, str(tmp_path)) == []
    table = chatdb.chat_table(spark, str(good), "message", rows_per_task=7)
    assert table.rdd.getNumPartitions() == 6 and table.columns == ["id", "session_id", "time_created", "data"]
    assert sorted(map(tuple, table.collect())) == sorted(messages)
    with pytest.raises(ValueError, match="session has no column"):
        session.list_sessions([chatdb.chat_table(spark, str(bad), "session")])
    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.setenv("OPENCODE_DB", str(good))
    run = lambda *a: cli.run(spark, ["--db", f"file://{tmp_path}/db", *a], 100)
    assert [(r["id"], r["time_updated"]) for r in run("sessions")] == [("s1", 50), ("s2", 40)]
    assert [r["id"] for r in run("sessions", "--dir", "/x/")] == ["s2"]
    want = {"session_id": "s1", "messages": 20, "new_docs": 20, "deduplicated": 0, "skipped": 0}
    assert run("sync-latest") == {"found": True, **want}
    assert run("sync-session", "s1") == want | {"new_docs": 0, "deduplicated": 20}
    assert run("doc-stats")[0]["documents"] == 20 and run("sync-latest", "--dir", "/nowhere") == {"found": False}
    # a broken store does not hide a good one
    monkeypatch.setenv("OPENCODE_DB", str(bad))
    monkeypatch.setenv("OPENCODE_DB_LOCAL", str(good))
    assert run("sync-session", "s1", "--limit", "3")["messages"] == 3
    with pytest.raises(LookupError, match="no such session"):
        run("sync-session", "zz")


def test_chats_are_followed(spark, store, tmp_path):
    """A message added to a session that was read arrives alone; one that has grown comes whole."""
    path = tmp_path / "chat.db"
    part = lambda i, m, text, kind="text": (f"p{i:03}", f"m{m}", json.dumps({"type": kind, "text": text}))
    message = lambda m, role="user": (f"m{m}", "s1", m, json.dumps({"role": role}))
    chat_file(path, [("s1", "talk", "/w", 50, None)], [message(1), message(2, "assistant"), message(3)], [part(1, 1, "one"), part(2, 2, "no user's"), part(3, 1, "more of one"), part(4, 3, " "), part(5, 1, "a tool", "tool")])
    seen, real = [], store.ingest
    store.ingest = lambda rows, now: seen.append(sorted(r.content for r in rows.collect())) or real(rows, now)

    def follow(checkpoint="c"):
        seen.clear()
        sync_chats(store, str(path), f"file://{tmp_path}/{checkpoint}", now_ms=5).awaitTermination()
        return [x for batch in seen for x in batch]

    assert follow() == ["one\nmore of one"] and follow() == []
    with sqlite3.connect(path) as db:
        db.execute("INSERT INTO message VALUES (?, ?, ?, ?, NULL)", message(4))
        db.executemany("INSERT INTO part VALUES (?, ?, ?)", [part(6, 4, "fresh"), part(7, 3, "late text")])
    assert sorted(follow()) == ["fresh", "late text"]
    assert store.read("documents").count() == 3
    follow("another")  # a lost checkpoint is harmless
    assert store.read("documents").count() == 3 and sorted(r.content for r in store.read("chunks").collect()) == ["fresh", "late text", "one\nmore of one"]
    # ranges: each message comes once, from the range of its first new part
    reader = chattail.ChatTail({"path": str(path), "rows_per_task": 2})
    ranges = reader.partitions({"part": 0}, reader.latestOffset())
    rows = [r for x in ranges for r in reader.read(x)]
    assert len(ranges) == 4 and len(rows) == len(set(rows)) == 7
    assert [x for r in reader.partitions(reader.latestOffset(), reader.latestOffset()) for x in reader.read(r)] == []


LOG = [
    '{"session":"session-number-one","ts":1,"content":"hello there"}',
    "",
    "not json",
    '{"sessionId":"two","time":"7","text":" hello there "}',
    '{"content":"no session"}',
    '{"session":"x","content":"   "}',
]


def test_logs_sync_once(spark, store, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text("\n".join(LOG))
    entries = readers.read_jsonl(spark, f"file://{logs}/*.jsonl")
    assert sorted((r.session_id, r.ts, r.content) for r in entries.collect()) == [("a", "0", "no session"), ("session-number-one", "1", "hello there"), ("two", "7", "hello there")]
    assert sync_batch(store, entries, "log", 5) == {"messages": 3, "new_docs": 3, "deduplicated": 0, "skipped": 0}
    assert sync_batch(store, entries, "log", 6) == {"messages": 3, "new_docs": 0, "deduplicated": 3, "skipped": 0}
    assert {r.title for r in store.read("documents").collect()} == {"a-0", "n-number-one-1"[-14:], "two-7"}
    meta = json.loads(store.read("documents").where("title = 'two-7'").first().metadata)
    assert meta == {"source": "log", "session_id": "two", "ts": "7", "condensed": False}
    (logs / "b.jsonl").write_text('{"session":"s3","ts":9,"content":"fresh entry"}')
    for checkpoint in ("c1", "c1", "c2"):  # a lost checkpoint is harmless
        sync_logs(store, f"file://{logs}", f"file://{tmp_path}/{checkpoint}").awaitTermination()
        assert store.read("documents").count() == 4
    with open(logs / "b.jsonl", "a") as f:
        f.write('\n{"session":"s3","ts":10,"content":"appended entry"}\n{"session":"s3","ts":11,"con')
    assert _synced(store, logs, tmp_path) == 5  # the last line is not whole yet
    with open(logs / "b.jsonl", "a") as f:
        f.write('tent":"its end"}\n')
    assert _synced(store, logs, tmp_path) == 6
    assert _synced(store, tmp_path / "missing", tmp_path, "c3") == 6


def _synced(store, logs, tmp_path, checkpoint="c1"):
    before = store.manifest()["version"]
    sync_logs(store, f"file://{logs}", f"file://{tmp_path}/{checkpoint}").awaitTermination()
    assert store.manifest()["version"] <= before + 1
    return store.read("documents").count()


def test_log_ranges(tmp_path):
    """Every cut into ranges gives every line once, from any whole offset."""
    lines = [json.dumps({"content": "x" * (i % 7)}) for i in range(9)] + [""]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(lines))
    for size in (1, 7, 16, 40, 1000):
        tail = logtail.LogTail({"path": str(tmp_path), "bytes_per_task": str(size)})
        end = tail.latestOffset()
        assert end == {str(path): path.stat().st_size}
        for first in range(0, 9, 2):
            start = {str(path): sum(len(x) + 1 for x in lines[:first])}
            got = [v.rstrip("\n") for p in tail.partitions(start, end) for v, _ in tail.read(p)]
            assert got == lines[first:9]
    with open(path, "a") as f:
        f.write('{"half')
    assert tail.latestOffset() == end
    path.write_text('{"content":"anew"}')  # valid without a newline; shorter than the offset
    assert [v for p in tail.partitions(end, tail.latestOffset()) for v, _ in tail.read(p)] == ['{"content":"anew"}']


def test_read_files(spark, tmp_path):
    for name, body in {"a.md": "﻿# A", "b.TS": "let x", "c.txt": "y" * 5000, "d.bin": "no", ".git/e.md": "no", "node_modules/f.ts": "no", "sub/g.py": "print(1)"}.items():
        f = tmp_path / "d" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    root = f"file://{tmp_path}/d"
    rows, report = readers.read_files(spark, root, max_mb=0.001)
    assert sorted((r.title, r.content, r.content_type) for r in rows.collect()) == [("a.md", "# A", "markdown"), ("b.TS", "let x", "typescript"), ("g.py", "print(1)", "python")]
    assert report.first()[:3] == (4, 4, 1)
    assert readers.read_files(spark, root, max_files=2)[1].first()[:3] == (4, 2, 2)
    with pytest.raises(PermissionError):
        readers.read_files(spark, root, dirs=(f"{tmp_path}/e",))
    assert readers.allowed(root, (f"{tmp_path}",)) and not readers.allowed(root + "x", (f"{tmp_path}/d",))
    assert not readers.allowed(f"{root}/../e/f", (f"{tmp_path}/d",)) and readers.allowed(f"{root}/sub/../a.md", (f"{tmp_path}/d/",))
    assert readers.allowed("hdfs://n/a/b", ("hdfs://n/a",)) and not readers.allowed("hdfs://n/a/../b", ("hdfs://n/a",)) and not readers.allowed("hdfs://m/a", ("hdfs://n/a",))
    (tmp_path / "out.md").write_text("outside")
    (tmp_path / "d" / "link.md").symlink_to(tmp_path / "out.md")
    rows, report = readers.read_files(spark, root, max_mb=0.001, dirs=(f"{tmp_path}/d",))
    assert rows.count() == 3 and report.first().skipped == 2
    assert [r.split(" (")[1][:7] for r in report.first().reasons] == ["too lar", "outside"]
    with pytest.raises(PermissionError):
        readers.read_file(spark, f"{root}/link.md", dirs=(f"{tmp_path}/d",))


def test_read_file(spark, tmp_path):
    odd = tmp_path / "a[1] {x}*.log"
    odd.write_bytes(b"\xff plain")
    (tmp_path / "a1 x.log").write_text("another")
    (row,) = readers.read_file(spark, f"file://{odd}").collect()
    assert (row.title, row.content, row.content_type) == (odd.name, "\ufffd plain", "log")
    odd.write_text("y" * 5000)
    for error, path in ((ValueError, odd), (FileNotFoundError, tmp_path / "none"), (IsADirectoryError, tmp_path)):
        with pytest.raises(error):
            readers.read_file(spark, f"file://{path}", max_mb=0.001)
    with pytest.raises(NotADirectoryError):
        readers.read_files(spark, f"file://{odd}")


def test_config():
    c = config.from_env({"RAG_RRF_K": "-1", "RAG_SESSION_CONDENSE_MIN_CHARS": "20", "RAG_PRUNE": "true", "SEARCH_MODE": "vector", "RAG_ALLOWED_DIRS": "/a;/b|/c", "RAG_SESSION_CONDENSE": "0"})
    assert (c.rrf_k, c.condense_min_chars, c.prune, c.search_mode, c.allowed_dirs, c.condense) == (60, 120, True, "vector", ("/a", "/b", "/c"), False)
    text = "export A='x y'\n# B=1\nB=2 # note\nC=3\nD=\"q#z\" # t\n"
    assert config.parse_env_file(text, {"A", "B", "D"}) == {"A": "x y", "B": "2", "D": "q#z"}


def test_environment_file(tmp_path):
    (tmp_path / ".env").write_text("export RAG_RRF_K = 30 # less\nSEARCH_MODE='vector'\nPATH=/nowhere\nEMBEDDING_PROVIDER=transformers\n")
    got = config.environment({"SEARCH_MODE": "keyword", "PATH": "/bin"}, str(tmp_path))
    assert got == {"RAG_RRF_K": "30", "SEARCH_MODE": "keyword", "PATH": "/bin", "EMBEDDING_PROVIDER": "transformers"}
    assert config.from_env(got).rrf_k == 30 and config.from_env(got).embedding_provider == "transformers"
    assert config.environment({"A": "1"}, str(tmp_path / "none")) == {"A": "1"}
    with pytest.raises(OSError):
        config.environment({"RAG_ENV_FILE": str(tmp_path / "none")})


def test_command_line(spark, tmp_path):
    db = f"file://{tmp_path}/db"
    run = lambda *a: cli.run(spark, ["--db", db, *a], 10 * DAY)
    assert run("ingest-text", "The quick brown fox jumps.", "fox")[0]["deduplicated"] is False
    doc = run("list")[0]
    run("ingest-text", "A slow green turtle.", "turtle")
    assert run("search", "quick fox")[0]["doc_title"] == "fox"
    told = run("retrieve", "quick fox", "--doc-id", doc["id"])[0]
    assert "[fox#0]" in told["context"] and [r["doc_title"] for r in told["chunks"]] == ["fox"]
    assert "legs" not in run("search", "fox")[0]
    assert run("search", "quick fox", "--explain", "--doc-id", doc["id"])[0]["legs"]
    assert run("search", "quick fox", "--source", "nothing") == []
    assert run("list", "--total", "--limit", "1")["total"] == 2
    for bad in (("search", ""), ("search", "x" * 2001), ("search", "x", "--top-k", "51"), ("retrieve", "x", "--top-k", "0"), ("memory-recall", "x", "--top-k", "31"), ("search", "x", "--min-score", "1.5"), ("search", "x", "--alpha", "-0.1"), ("memory-remember", "y" * 20_001), ("memory-get", "i" * 201)):
        with pytest.raises(ValueError):
            run(*bad)
    assert run("document-stats")[0]["documents"] == 2 and run("stats")["integrity"] == "ok"
    run("memory-remember", "prefers tabs over spaces", "--type", "preference")
    assert run("memory-recall", "tabs or spaces")[0]["recall_count"] == 1
    one = run("memory-list")[0]
    assert one["recall_count"] == 1 and run("memory-get", one["id"])[0]["type"] == "preference"
    run("memory-update", one["id"], "--importance", "0.9")
    assert run("memory-list", "--min-importance", "0.8")[0]["importance"] == 0.9
    assert "tabs" in run("memory-context", "tabs")[0]["context"]
    assert run("memory-consolidate")[0]["removed"] == 0 and run("memory-stats")[0]["count"] == 1
    run("memory-forget", one["id"])
    run("delete", doc["id"])
    assert run("memory-list") == [] and len(run("list")) == 1
    assert run("reindex")[0]["chunks"] == 1

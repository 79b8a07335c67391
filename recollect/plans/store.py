"""A versioned store: Parquet directories and a manifest swapped whole.

A version is a list of segments for each table; the manifest names the current
ones with the vector space's model, dimension and state.  A segment is rows, or
changes: rows that replace all earlier ones of their keys, or take them out.
So a change of a few rows writes a few rows, and many small segments are put
together as they come.  Readers see the version they opened; one writer at a
time commits the next.  Paths are any that Hadoop's file systems know.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.ingest import ingest
from recollect.operators.memory import bump
from recollect.plans.schema import KEYS, TABLES

#: Rows by table, or what gives them.
Rows = dict[str, DataFrame] | Callable[[], dict[str, DataFrame]]

#: So many segments of a table are put together; the first one too, when the
#: others have a fourth of its bytes.
MOST_SEGMENTS, REWRITE = 16, 4


class Store:
    def __init__(self, spark: SparkSession, path: str, embedder, lock_s: float = 600.0, wait_s: float = 0.0) -> None:
        """A writer's lock that was not renewed for ``lock_s`` is a dead one's;
        a live one's is waited for, ``wait_s`` at most."""
        self.lock_s, self.wait_s = lock_s, wait_s
        self.spark, self.path, self.embedder = spark, path.rstrip("/"), embedder
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifest

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self) -> dict:
        if not self._fs.exists(self._p("manifest.json")):
            return {"version": 0, "tables": {}, "embed_model": None, "embed_dim": None, "embed_state": "ready"}
        text = self.spark.read.text(f"{self.path}/manifest.json", wholetext=True).first()[0]
        return json.loads(text)

    def _swap(self, manifest: dict) -> None:
        """Put the manifest in place of the last one, in one rename."""
        tmp, live = self._p(f".manifest-{uuid.uuid4().hex}"), self._p("manifest.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        over = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.java.lang.Enum.valueOf(over, "OVERWRITE")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        context.rename(tmp, live, options)

    @contextmanager
    def _locked(self) -> Iterator[str]:
        """Hold the writer's lock, renewed until it is given back."""
        lock, me, done = self._p("writer.lock"), uuid.uuid4().hex, threading.Event()
        until = time.time() + self.wait_s
        while not (taken := self._take(lock, me)) and time.time() < until:
            time.sleep(0.2)
        if not taken:
            age = time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000 if self._fs.exists(lock) else 0
            if age > self.lock_s:
                self._fs.rename(lock, self._p(f".dead-{me}"))
                self._fs.delete(self._p(f".dead-{me}"), False)
            if age <= self.lock_s or not self._take(lock, me):
                raise RuntimeError("another writer holds the store")

        def renew() -> None:
            while not done.wait(self.lock_s / 4):
                if self._holder() == me:
                    self._fs.setTimes(lock, int(time.time() * 1000), -1)

        beat = threading.Thread(target=renew, daemon=True)
        beat.start()
        try:
            yield me
        finally:
            done.set()
            beat.join()
            if self._holder() == me:
                self._fs.delete(lock, False)

    def _take(self, lock, me: str) -> bool:
        try:
            out = self._fs.create(lock, False)
        except Py4JJavaError as e:
            # it may have been given back since
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self._fs.exists(lock):
                return False
            raise
        out.write(bytearray(me.encode()))
        out.close()
        return True

    def _holder(self) -> str | None:
        try:
            got = self._fs.open(self._p("writer.lock"))
        except Py4JJavaError:
            return None
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(got, "UTF-8")
        finally:
            got.close()

    # tables

    def read(self, table: str) -> DataFrame:
        return self.read_segments(table, self.manifest()["tables"].get(table) or [])

    def read_segments(self, table: str, at: list) -> DataFrame:
        """The table as these segments, of this version or a former one, tell it."""
        if not at:
            return self.spark.createDataFrame([], TABLES[table])
        return self._live(table, at)

    def _stamped(self, table: str, at: list) -> DataFrame:
        """Rows of the segments that no later change replaced, those that say
        ``gone`` included; ``changed`` tells the kind of their segment."""
        runs: list[tuple[bool, list[str]]] = []
        for x in at:
            changed = not isinstance(x, str)
            if changed or not runs or runs[-1][0]:
                runs.append((changed, []))
            runs[-1][1].append(x["changes"] if changed else x)
        rows = changes = None
        for n, (changed, paths) in enumerate(runs):
            one = self.spark.read.schema(TABLES[table] + (", gone boolean" if changed else "")).parquet(*paths)
            one = one.withColumns({"seq": F.lit(n), "changed": F.lit(changed)} | ({} if changed else {"gone": F.lit(False)}))
            rows = one if rows is None else rows.unionByName(one)
            if changed:
                keys = one.select(KEYS[table], "seq")
                changes = keys if changes is None else changes.unionByName(keys)
        if changes is None:
            return rows
        last = changes.groupBy(KEYS[table]).agg(F.max("seq").alias("last"))
        return rows.join(last, KEYS[table], "left").where(F.col("last").isNull() | (F.col("seq") >= F.col("last")))

    def _live(self, table: str, at: list) -> DataFrame:
        if all(isinstance(x, str) for x in at):
            return self.spark.read.schema(TABLES[table]).parquet(*at)
        return self._stamped(table, at).where(~F.col("gone")).select(*self._columns(table))

    @staticmethod
    def _columns(table: str) -> list[str]:
        return [f.strip().split(" ")[0] for f in TABLES[table].split(", ")]

    def _bytes(self, segment) -> int:
        path = self._jvm.org.apache.hadoop.fs.Path(segment if isinstance(segment, str) else segment["changes"])
        return self._fs.getContentSummary(path).getLength()

    def _compact(self, table: str, at: list, folder: str) -> list:
        """At most three segments that read as the given ones.

        All but the first become one of changes and one of added rows: a row
        added after a change of its key stands, and one added before is gone.
        """
        first, rest = at[0], at[1:]
        write = lambda df, name: self._write(df, table, f"{folder}/{name}", name.endswith("-whole"))
        if not isinstance(first, str) or sum(map(self._bytes, rest)) * REWRITE >= self._bytes(first):
            write(self._live(table, at), f"{table}-whole")
            return [f"{folder}/{table}-whole"]
        columns, now = self._columns(table), self._stamped(table, rest)
        write(now.where(~F.col("changed")).select(*columns), f"{table}-added")
        if all(isinstance(x, str) for x in rest):
            return [first, f"{folder}/{table}-added"]
        write(now.where("changed").select(*columns, "gone"), f"{table}-changed")
        return [first, {"changes": f"{folder}/{table}-changed"}, f"{folder}/{table}-added"]

    @staticmethod
    def _write(rows: DataFrame, table: str, path: str, whole: bool) -> None:
        """A segment in order of its keys; one of a whole table with Bloom
        filters of these, so that a look-up of a key reads the row groups that
        may hold it (in a small one they would outweigh the rows)."""
        out = rows.sortWithinPartitions(KEYS[table]).write.mode("errorifexists")
        for key in {"id", KEYS[table]} if whole else ():
            out = out.option(f"parquet.bloom.filter.enabled#{key}", "true")
        out.parquet(path)

    def _commit(self, holder: str, new: dict[str, DataFrame], how: str, **meta) -> dict:
        m = self.manifest()
        m["version"] += 1
        folder = f"{self.path}/v{m['version']}-{uuid.uuid4().hex[:8]}"
        for name, df in new.items():
            where = f"{folder}/{name}"
            self._write(df.select(*self._columns(name), *["gone"] * (how == "change")), name, where, how == "replace")
            one = {"changes": where} if how == "change" else where
            m["tables"][name] = [one] if how == "replace" else [*m["tables"].get(name, []), one]
            if len(m["tables"][name]) > MOST_SEGMENTS:
                m["tables"][name] = self._compact(name, m["tables"][name], folder)
        m.update(meta)
        if self._holder() != holder:
            raise RuntimeError("another writer took the store over")
        self._swap(m)
        return m

    def commit(self, new: dict[str, DataFrame], append: bool = False, **meta) -> dict:
        """Write tables and make them current, all at once."""
        with self._locked() as me:
            return self._commit(me, new, "append" if append else "replace", **meta)

    def change(self, put: Rows | None = None, drop: Rows | None = None) -> dict:
        """Replace all rows of the keys in ``put`` and take out those of the
        keys in ``drop``, in one commit that writes no other rows.

        ``drop`` wins over ``put``; a null key changes nothing.  Given as
        functions they are called under the writer's lock: what they read is
        what the change goes on, whoever wrote before.
        """
        with self._locked() as me:
            put, drop = (x() if callable(x) else x for x in (put, drop))
            new: dict[str, DataFrame] = {}
            for name in {**(put or {}), **(drop or {})}:
                key, parts = KEYS[name], []
                if drop and name in drop:
                    parts.append(drop[name].select(key).where(F.col(key).isNotNull()).distinct())
                if put and name in put:
                    rows = put[name].where(F.col(key).isNotNull())
                    rows = rows.join(parts[0], key, "left_anti") if parts else rows
                    parts.append(rows.select(*self._columns(name), F.lit(False).alias("gone")))
                if drop and name in drop:
                    parts[0] = self.spark.createDataFrame([], TABLES[name]).unionByName(parts[0], allowMissingColumns=True).withColumn("gone", F.lit(True))
                new[name] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            return self._commit(me, new, "change")

    def vacuum(self, keep_hours: float = 24.0) -> int:
        """Delete folders that no current segment lies in and that are older
        than ``keep_hours``, in which readers of former versions may go on."""
        with self._locked():
            used = {(x if isinstance(x, str) else x["changes"]).split("/")[-2] for at in self.manifest()["tables"].values() for x in at}
            before = (time.time() - keep_hours * 3600) * 1000
            old = [s.getPath() for s in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.path)) if s.isDirectory() and s.getPath().getName().startswith("v") and s.getPath().getName() not in used and s.getModificationTime() < before]
            for path in old:
                self._fs.delete(path, True)
            return len(old)

    # guards

    def check(self) -> None:
        m = self.manifest()
        if m["embed_state"] != "ready":
            raise RuntimeError("vectors are being recomputed, or that was broken off: run reindex")
        if m["embed_model"] not in (None, self.embedder.model) or m["embed_dim"] not in (None, self.embedder.dim):
            raise RuntimeError(f"the store holds {m['embed_model']} ({m['embed_dim']}), not {self.embedder.model} ({self.embedder.dim}): run reindex")

    def _space(self) -> dict:
        return {"embed_model": self.embedder.model, "embed_dim": self.embedder.dim}

    def ingest(self, rows: DataFrame, now_ms: int, **options) -> DataFrame:
        """Add texts, decided under the writer's lock; returns the report.

        A text that another writer brought meanwhile is a duplicate.
        """
        self.check()
        with self._locked() as me:
            got = ingest(rows, self.read("documents"), self.embedder, now_ms, known_chunks=self.read("chunks"), **options)
            if not got.documents.isEmpty():
                self._commit(me, {"documents": got.documents, "chunks": got.chunks}, "append", **self._space())
        return got.report

    def add(self, ingested) -> dict:
        """Append what ``ingest`` made, in one commit, less the texts that the
        store has got since."""
        self.check()
        with self._locked() as me:
            known = self.read("documents").select("content_hash")
            documents = ingested.documents.join(known, "content_hash", "left_anti")
            chunks = ingested.chunks.join(documents.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
            return self._commit(me, {"documents": documents, "chunks": chunks}, "append", **self._space())

    def recalled(self, ids: DataFrame, now_ms: int) -> dict:
        """Count a recall of the memories ``ids``, from what they are now."""

        def bumped() -> dict[str, DataFrame]:
            told = self.read("memories").join(ids.select("id"), "id", "left_semi")
            return {"memories": bump(told, ids, now_ms)}

        return self.change(put=bumped)

    def add_memories(self, memories: DataFrame) -> dict:
        self.check()
        return self.commit({"memories": memories}, append=True, **self._space())

    # maintenance

    def reindex(self) -> DataFrame:
        """Embed everything anew, segment by segment; a failure leaves the
        state to be repaired.

        A run that broke off is gone on with: segments that it had embedded
        with this model are taken as they are (``reused``).
        """
        began, reused = time.time(), 0
        with self._locked() as me:
            m = self.manifest()
            self._swap(m | {"embed_state": "reindexing"})
            folder = f"{self.path}/v{m['version'] + 1}-{hashlib.sha256(f'{self.embedder.model} {self.embedder.dim}'.encode()).hexdigest()[:8]}"
            tables = dict(m["tables"])
            for name in [t for t in ("chunks", "memories") if t in tables]:
                new = []
                for x in tables[name]:
                    changed = not isinstance(x, str)
                    path = x["changes"] if changed else x
                    where = f"{folder}/{name}-{hashlib.sha256(path.encode()).hexdigest()[:16]}"
                    if self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")):
                        reused += 1
                    else:
                        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(where), True)
                        rows = self.spark.read.schema(TABLES[name] + (", gone boolean" if changed else "")).parquet(path)
                        self._write(rows.withColumn("embedding", self.embedder.column(F.col("content"))), name, where, not changed)
                    new.append({"changes": where} if changed else where)
                tables[name] = new
            if self._holder() != me:
                raise RuntimeError("another writer took the store over")
            space = self._space() if tables.keys() & {"chunks", "memories"} else {}
            self._swap(m | {"tables": tables, "version": m["version"] + 1, "embed_state": "ready", **space})
        n = [self.read(t).count() for t in ("chunks", "memories")]
        return self.spark.createDataFrame([(*n, m["embed_dim"], self.manifest()["embed_dim"], reused, time.time() - began)], "chunks long, memories long, dim_before int, dim_after int, reused int, seconds double")

    def backup(self, to: str) -> DataFrame:
        """Copy the current version to a new folder; never over another."""
        other = Store(self.spark, to, self.embedder)
        if other.path == self.path or other._fs.exists(other._p("manifest.json")):
            raise FileExistsError(f"{to} holds a store")
        m = self.manifest()
        other.commit({t: self.read(t) for t in m["tables"]}, **{k: m[k] for k in ("embed_model", "embed_dim", "embed_state")})
        return other.counts()

    def restore(self, source: str) -> DataFrame:
        """Make a backup's tables current, after checking them."""
        other = Store(self.spark, source, self.embedder)
        if not other._fs.exists(other._p("manifest.json")):
            raise FileNotFoundError(f"{source} holds no store")
        if other.integrity().where("violations > 0").count():
            raise ValueError(f"{source} is damaged")
        m = other.manifest()
        self.commit({t: other.read(t) for t in TABLES}, **{k: m[k] for k in ("embed_model", "embed_dim", "embed_state")})
        return self.counts()

    def clear(self) -> None:
        self.commit({t: self.spark.createDataFrame([], s) for t, s in TABLES.items()}, embed_model=None, embed_dim=None, embed_state="ready")

    def counts(self) -> DataFrame:
        c = [self.read(t).agg(F.lit(t).alias("table"), F.count("*").alias("rows")) for t in TABLES]
        return c[0].unionByName(c[1]).unionByName(c[2])

    def integrity(self) -> DataFrame:
        """(invariant, violations): keys, references, dimensions, counts."""
        d, c, m = (self.read(t) for t in TABLES)
        dim = self.manifest()["embed_dim"]
        twice = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
        off = lambda df: df.where(F.col("embedding").isNotNull() & (F.size("embedding") != F.lit(dim))) if dim else df.limit(0)
        found = {
            "documents.id unique": twice(d, "id"),
            "documents.content_hash unique": twice(d, "content_hash"),
            "chunks.id unique": twice(c, "id"),
            "memories.id unique": twice(m, "id"),
            "chunks.doc_id known": c.join(d, c["doc_id"] == d["id"], "left_anti"),
            "chunk_count right": d.join(c.groupBy("doc_id").agg(F.count("*").alias("n")), d["id"] == F.col("doc_id"), "left").where(F.coalesce("n", F.lit(0)) != F.col("chunk_count")),
            "chunks.embedding size": off(c),
            "memories.embedding size": off(m),
        }
        out = None
        for name, rows in found.items():
            one = rows.agg(F.lit(name).alias("invariant"), F.count("*").alias("violations"))
            out = one if out is None else out.unionByName(one)
        return out

    def stats(self, deferred_above: int = 100_000, warn_mb: int = 256) -> dict:
        """What ``system_stats`` tells; integrity is left out for large stores."""
        m = self.manifest()
        rows = {r["table"]: r["rows"] for r in self.counts().collect()}
        vector_mb = (rows["chunks"] + rows["memories"]) * (m["embed_dim"] or 0) * 8 / (1 << 20)
        large = rows["chunks"] > deferred_above
        bad = None if large else [r.invariant for r in self.integrity().where("violations > 0").collect()]
        return {**rows, "version": m["version"], "embed_model": m["embed_model"], "embed_dim": m["embed_dim"], "embed_state": m["embed_state"], "vector_mb": vector_mb, "vector_warning": vector_mb >= warn_mb, "integrity": "deferred" if large else bad or "ok"}

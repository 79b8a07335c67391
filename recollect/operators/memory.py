"""Long-term memories: list, recall with decay, consolidate, promote, prune.

Reads are pure; a write is a new version of the table, left to the caller.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import clamp_importance, decay, dot, estimate_tokens_from_chars, token_set
from recollect.operators.search import vector_search
from recollect.plans.scratch import settle, tidy

MEMORY_TYPES = ("fact", "preference", "decision", "instruction", "task", "insight", "conversation")
SIMILARITY, OVERLAP = 0.92, 0.8
DAY = 86_400_000
LISTED = ("id", "type", "content", "importance", "tags", "recall_count", "last_recalled", "created_at", "updated_at")


def repaired(memories: DataFrame) -> DataFrame:
    """Unknown type reads as fact, a bad importance as 0.5, no tags as none."""
    finite = F.col("importance").isNotNull() & ~F.isnan("importance") & (F.abs("importance") != float("inf"))
    return memories.withColumns(
        {
            "type": F.when(F.col("type").isin(*MEMORY_TYPES), F.col("type")).otherwise(F.lit("fact")),
            "importance": F.when(finite, F.col("importance")).otherwise(0.5),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
        }
    )


def list_memories(memories: DataFrame, type: str | None = None, tag: str | None = None, min_importance: float | None = None, limit: int = 100) -> DataFrame:
    keep = F.lit(True)
    if type is not None:
        keep = keep & (F.col("type") == type)
    if tag is not None:
        keep = keep & F.coalesce(F.array_contains("tags", tag), F.lit(False))
    if min_importance is not None:
        keep = keep & (F.col("importance") >= min_importance)
    # filters see stored values, the listing repaired ones
    top = memories.where(keep).select(*LISTED).orderBy(F.desc("updated_at"), F.desc("id")).limit(max(1, min(500, limit)))
    return repaired(top)


def get_memory(memories: DataFrame, id) -> DataFrame:
    return repaired(memories.where(F.col("id") == id).select(*LISTED).limit(1))


def memory_stats(memories: DataFrame) -> DataFrame:
    """One row: count, mean importance, estimated tokens, and counts by type."""
    by_type = memories.groupBy("type").agg(F.count("*").alias("count"))
    types = by_type.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "count")))).alias("by_type"))
    total = memories.agg(F.count("*").alias("count"), F.coalesce(F.avg("importance"), F.lit(0.0)).alias("avg_importance"), estimate_tokens_from_chars(F.coalesce(F.sum(F.length("content")), F.lit(0))).alias("tokens"))
    return total.crossJoin(F.broadcast(types))  # one row beside one row


def remember(spark, rows: list[dict], now_ms: int, embedder) -> DataFrame:
    """New memories as rows of the table; embedded, never recalled."""
    schema = "id string, type string, content string, importance double, tags array<string>"
    got = [(r.get("id"), r.get("type", "fact"), r["content"], float(r.get("importance", 0.5)), list(r.get("tags", []))) for r in rows]
    df = spark.createDataFrame(got, schema)
    return df.select(
        F.coalesce("id", F.sha2(F.concat_ws("\0", "content", F.lit(str(now_ms))), 256)).alias("id"),
        "type",
        "content",
        clamp_importance(F.col("importance")).alias("importance"),
        embedder.column(F.col("content")).alias("embedding"),
        "tags",
        F.lit(0).alias("recall_count"),
        F.lit(None).cast("long").alias("last_recalled"),
        F.lit(now_ms).cast("long").alias("created_at"),
        F.lit(now_ms).cast("long").alias("updated_at"),
    )


def recall(memories: DataFrame, query_vector: list[float], now_ms: int, top_k: int = 8, min_score: float = 0.1, half_life_days: float = 14.0) -> DataFrame:
    """Nearest 2 k by cosine, decayed by age, cut by score, best k."""
    near = vector_search(memories, query_vector, 2 * top_k, min_score)
    hits = memories.drop("embedding").join(F.broadcast(near.withColumnRenamed("score", "cosine")), "id")
    faded = decay(F.col("last_recalled"), F.col("created_at"), now_ms, half_life_days)
    hits = hits.withColumn("decay", faded).withColumn("score", F.col("cosine") * F.col("decay"))
    return hits.where(F.col("score") >= min_score).orderBy(F.desc("score"), F.desc("cosine"), "id").limit(top_k)


def bump(memories: DataFrame, recalled: DataFrame, now_ms: int) -> DataFrame:
    """The table after a recall: its rows counted once more and dated now."""
    hit = recalled.select("id", F.lit(True).alias("hit"))
    rows = memories.join(F.broadcast(hit), "id", "left")
    said = F.col("hit").isNotNull()
    rows = rows.withColumns({"recall_count": F.when(said, F.col("recall_count") + 1).otherwise(F.col("recall_count")), "last_recalled": F.when(said, F.lit(now_ms)).otherwise(F.col("last_recalled"))})
    return rows.select(*memories.columns)


def update_memory(memories: DataFrame, id, patch: dict, now_ms: int, embedder=None) -> DataFrame:
    """The table with the patched columns of one row; nothing for no patch."""
    patch = {k: v for k, v in patch.items() if v is not None}
    if not patch:
        return memories
    mine = F.col("id") == id
    new: dict[str, Column] = {}
    for k, v in patch.items():
        value = F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else clamp_importance(F.lit(float(v))) if k == "importance" else F.lit(v)
        new[k] = F.when(mine, value).otherwise(F.col(k))
    if "content" in patch and embedder is not None and "embedding" in memories.columns:
        fresh = F.array(*map(F.lit, embedder.query(patch["content"])))
        new["embedding"] = F.when(mine & ~F.col("content").eqNullSafe(F.lit(patch["content"])), fresh).otherwise(F.col("embedding"))
    new["updated_at"] = F.when(mine, F.lit(now_ms)).otherwise(F.col("updated_at"))
    return memories.withColumns(new)


def forget(memories: DataFrame, id) -> DataFrame:
    return memories.where(~F.col("id").eqNullSafe(F.lit(id)))


def due() -> Column:
    """Recalled often enough to rise in importance."""
    return (F.col("recall_count") >= 5) & (F.col("importance") < 1)


def promote(memories: DataFrame) -> DataFrame:
    return memories.withColumn("importance", F.when(due(), F.least(F.lit(1.0), F.col("importance") + 0.1)).otherwise(F.col("importance")))


def prunable(now_ms: int, min_importance: float = 0.2, age_days: float = 90.0) -> Column:
    idle = F.coalesce("last_recalled", "created_at") <= now_ms - int(age_days * DAY)
    return (F.col("importance") < min_importance) & (F.col("recall_count") == 0) & idle


def _before(side: str = "") -> Column:
    """The order in which memories are looked at: the first of a kind stays."""
    c = lambda n: F.col(f"{side}{n}")
    return F.struct((-c("importance")).alias("i"), c("created_at").alias("c"), c("id").alias("d"))


def _classed(memories: DataFrame) -> DataFrame:
    """The rows that can match any, themselves included."""
    keyed = memories.where(F.col("content").rlike(r"[\p{L}\p{N}]{2}"))
    if "embedding" in memories.columns:
        norm = dot(F.col("embedding"), F.col("embedding"))
        keyed = keyed.where((norm > 0) & ~F.isnan(norm))
    return keyed


def duplicate_classes(memories: DataFrame) -> DataFrame:
    """(id, class_id): memories of equal content and vector, by their first one.

    Members match each other in both gates and match the same others, so only
    first ones need to meet.  Rows that match nothing, themselves included
    (no token, no vector or a zero one), have no class.  A hot class is
    combined map-side; the adaptive skew join splits it on the way back.
    """
    key = [F.sha2("content", 256).alias("text_key")]
    if "embedding" in memories.columns:
        key.append(F.xxhash64("embedding").alias("vector_key"))
    keyed = _classed(memories).select("id", "importance", "created_at", *key)
    by = keyed.columns[3:]
    first = keyed.groupBy(*by).agg(F.min_by("id", _before()).alias("class_id"))
    return keyed.join(first, by).select("id", "class_id")


#: Ids that are sent to all tasks at most; more are met by a shuffle.
FEW = 1 << 19


def among(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of (or with left_anti, without) some ids: a few spare the shuffle of the rows."""
    few = ids.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(ids) if few else ids, "id", how)


def _hashes() -> Column:
    """The token set of a memory; tokens are 64-bit hashes, as long as a few
    characters and the same at any length."""
    return F.array_distinct(F.transform(token_set(F.col("content")), lambda t: F.xxhash64(t)))


def _token_sets(memories: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, importance, created_at, tokens) of the first of each class."""
    copies = classes.where("id <> class_id").select("id").distinct()
    first = among(_classed(memories).where(F.col("id").isNotNull()), copies, "left_anti")
    return settle(first.select("id", "importance", "created_at", _hashes().alias("tokens")).where(F.size("tokens") > 0))


#: Tokens of a part on the mean, and tokens told apart by their frequency; all others count as rarer.
PART, RANKED = 2.5, 1 << 17
#: The least sizes of bands of sets; sets that overlap by 0.8 are of one band or of adjacent ones.
BANDS = np.unique(np.ceil(1.5 ** np.arange(1, 100)).clip(1, 1 << 40).astype(np.int64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(32)


def _part_keys(n: np.ndarray, token: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of sets of n tokens that lie one after another."""
    # two sets meet in the parts of the smaller one's band: the larger one's own or the next lower
    band = np.searchsorted(BANDS, n, "right")
    lower = np.searchsorted(BANDS, -(-4 * n // 5), "right")
    again = np.flatnonzero(lower < band)
    of = np.concatenate([np.arange(len(n)), again])
    least = np.where(band > 0, BANDS[np.maximum(band, 1) - 1], 1)
    # the most that it differs by from larger ones, or from those below its band
    differ = np.concatenate([n + 5 * n // 4, (n + least - 1)[again]]) // 9
    top = BANDS[np.concatenate([band, lower[again]])]
    parts = np.maximum((top / PART).astype(np.int64), (top + 5 * top // 4) // 9 + 1)
    begin = np.cumsum(parts) - parts
    first, size = (np.cumsum(n) - n)[of], n[of]
    row = np.repeat(np.arange(len(of)), size)
    token, rarity = (x[np.arange(len(row)) + np.repeat(first - (np.cumsum(size) - size), size)] for x in (token, rarity))
    place = begin[row] + (token % parts.astype(np.uint64)[row]).astype(np.int64)
    rare = np.bincount(place, weights=rarity, minlength=parts.sum())
    key = np.zeros(parts.sum(), np.uint64)
    np.add.at(key, place, _mixed(token))
    row = np.repeat(np.arange(len(of)), parts)
    key = _mixed(key + _mixed((np.arange(len(key)) - begin[row] + (parts[row] << 32)).astype(np.uint64)))
    order = np.lexsort((key, -rare, row))
    kept = order[np.arange(len(order)) - begin[row] <= differ[row]]
    return of[row[kept]], key[kept].view(np.int64)


def _rare_keys(sets: DataFrame) -> DataFrame:
    """(id, key, size): what two sets of overlap 0.8 have in common.

    Tokens are dealt into parts by their hash.  Sets of n and m tokens that
    overlap by 0.8 differ by (n + m) / 9 tokens at most, so all parts but that
    many are the same in both, and of the rarest parts of a set, one more than
    that many, one is among the other's: those are its keys.  Parts of rare
    tokens come first, so unlike sets seldom share a key.
    """
    each = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    told = each.where("df > 1").orderBy(F.desc("df"), "t").limit(RANKED).toArrow()
    order = np.argsort(told["t"].to_numpy())
    known, often = told["t"].to_numpy()[order], told["df"].to_numpy()[order]
    # whole numbers, so that sums do not depend on the order of tokens
    most = 2 * often.max(initial=1)
    worth = np.rint(64 * np.log2(most / often)).astype(np.int64) + 1
    unknown = worth.max(initial=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 256):
                batch = whole.slice(begin, 256)
                tokens = batch.column("tokens")
                token = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                rarity = np.full(len(token), unknown)
                if len(known):
                    place = np.minimum(np.searchsorted(known, token), len(known) - 1)
                    rarity = np.where(known[place] == token, worth[place], unknown)
                size = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                at, key = _part_keys(size, token.view(np.uint64), rarity)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(key), pa.array(size[at].astype(np.int32))], names=["id", "key", "size"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "tokens").mapInArrow(run, f"id {kind}, key long, size int")


def _near(x: str, y: str) -> Column:
    """Whether sets of these sizes can overlap by 0.8."""
    return 5 * F.least(f"{x}size", f"{y}size") >= 4 * F.greatest(f"{x}size", f"{y}size")


def _sketches(sets: DataFrame) -> DataFrame:
    """(id, ..., size, bits) for the tokens: each turns over one bit of some as
    many as the set has tokens (0.7 to 1.4 of them), a power of two times 64."""
    rest = [f for f in sets.schema.fields if f.name != "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 256):
                batch = whole.slice(begin, 256)
                tokens = batch.column("tokens")
                token = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                size = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words = np.int64(1) << np.frexp(np.maximum(7 * size // 10 - 1, 0) // 64)[1].astype(np.int64)
                ends = np.cumsum(words)
                row = np.repeat(np.arange(len(size)), size)
                # other bits of the hash than parts are told by
                bit = (_mixed(token) >> np.uint64(20)) & (64 * words[row] - 1).astype(np.uint64)
                bits = np.zeros(words.sum(), np.uint64)
                np.bitwise_xor.at(bits, (ends - words)[row] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(bits.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(size.astype(np.int32)), lists], names=[*(f.name for f in rest), "size", "bits"])

    return sets.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest), "size int, bits array<long>"]))


def _passes(x: str, y: str) -> Column:
    """Whether two sets can overlap by 0.8: they differ by their unlike bits at least."""
    a, b, n = F.col(f"{x}bits"), F.col(f"{y}bits"), F.col(f"{x}size") + F.col(f"{y}size")
    unlike = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    # sizes as near as these differ by one power at most
    words = F.least(F.size(a), F.size(b))
    fold = lambda c: F.when(F.size(c) == words, c).otherwise(unlike(F.slice(c, F.lit(1), words), F.slice(c, words + 1, words)))
    return _near(x, y) & (9 * F.aggregate(unlike(fold(a), fold(b)), F.lit(0), lambda n, w: n + F.bit_count(w)) <= n)


def _screened(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (p, q) whose sketches pass."""
    both = pairs
    for x in "pq":
        both = both.join(sketches.select(F.col("id").alias(x), F.col("size").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits")), x)
    return both.where(_passes("p_", "q_")).select("p", "q")


def _shared(keys: DataFrame) -> DataFrame:
    """The keys that bring anybody together, by one shuffle of them all."""
    return settle(keys.withColumn("rows", F.count("*").over(W.partitionBy("key"))).where("rows > 1").drop("rows"))


#: The least keys that are told of each set, so that a pair that shares many is found at one of them.
TOLD = ("least0", "least1")


def _candidates(sets: DataFrame) -> DataFrame:
    """(p, q) of the sets that share a key and whose sketches pass, each once; p
    comes first in the order.

    Sketches travel to the keys, so pairs are screened where they meet: rows
    that are shuffled grow with the sets, and with the pairs that pass, not with
    those of unlike sets.  A pair counts at the least key that both are told to
    have; all lesser ones would be told too.
    """
    shared = _shared(_rare_keys(sets))
    tidy(sets.sparkSession)
    held = shared.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    rows = held.join(_sketches(sets.withColumns({"before_i": -F.col("importance"), "before_c": F.col("created_at")}).select("id", "before_i", "before_c", "tokens")), "id")
    rows = rows.select("id", "before_i", "before_c", "size", "bits", *(F.get("keys", F.lit(i)).alias(c) for i, c in enumerate(TOLD)), F.explode("keys").alias("key"))
    met = rows.alias("x").join(rows.alias("y"), "key")
    order = lambda s: F.struct(*(F.col(f"{s}.{c}").alias(c) for c in ("before_i", "before_c", "id")))
    both = (F.when(F.col(f"x.{c}").isin(*(F.col(f"y.{d}") for d in TOLD)), F.col(f"x.{c}")) for c in TOLD)
    met = met.where((order("x") < order("y")) & _near("x.", "y.") & (F.coalesce(*both, "key") == F.col("key")))
    # unlike a condition, this is not drawn into the join, whose other ones are compiled
    pair = F.array(F.struct(F.col("x.id").alias("p"), F.col("y.id").alias("q")))
    return settle(met.select(F.inline(F.when(_passes("x.", "y."), pair))).distinct())


#: Memories of a block; those of two blocks at most are compared by one task at a time.
BLOCK = 1 << 10


def _compared(pairs: pa.Table, rows: pa.Table) -> pa.Table:
    """The pairs of a tile that pass both gates; the narrow one first."""
    at = pd.Index(rows.column("id").to_pandas())
    rows, at = rows.filter(pa.array(~at.duplicated())), at[~at.duplicated()]
    flat = lambda c: (rows.column(c).combine_chunks(), rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False))
    (lists, tokens), (vectors, values) = flat("tokens"), flat("embedding")
    size, width = (np.asarray(x.value_lengths().fill_null(0), np.int64) for x in (lists, vectors))
    begin, (known, token) = np.cumsum(size) - size, np.unique(tokens, return_inverse=True)
    vector = np.zeros((len(at), width.max(initial=0)))
    vector[np.arange(vector.shape[1]) < width[:, None]] = values
    norm = np.sqrt(np.einsum("ij,ij->i", vector, vector))
    p, q = (at.get_indexer(pairs.column(c).to_pandas()) for c in "pq")
    order = np.flatnonzero((p >= 0) & (q >= 0))
    order = order[np.argsort(p[order], kind="stable")]
    found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    for run in np.split(order, np.flatnonzero(np.diff(p[order])) + 1) if len(order) else []:
        one, many = p[run[0]], q[run]
        has = np.zeros(len(known), bool)
        has[token[begin[one] : begin[one] + size[one]]] = True
        first = np.cumsum(size[many]) - size[many]
        their = token[np.arange(size[many].sum()) + np.repeat(begin[many] - first, size[many])]
        shared = np.add.reduceat(has[their], first, dtype=np.int64)
        overlap = shared / (size[one] + size[many] - shared)
        kept = overlap >= OVERLAP
        run, many, overlap = run[kept], many[kept], overlap[kept]
        with np.errstate(all="ignore"):
            length = norm[one] * norm[many]
            cos = np.where((length > 0) & (width[many] == width[one]), vector[many] @ vector[one] / length, 0.0)
        kept = (cos >= SIMILARITY) | np.isnan(cos)  # as Spark compares
        found.append((run[kept], overlap[kept], cos[kept]))
    run, overlap, cos = map(np.concatenate, zip(*found))
    pairs = pairs.take(pa.array(run))
    return pa.table({"p": pairs.column("p"), "q": pairs.column("q"), "overlap": overlap, "cosine": cos})


def _alike(pairs: DataFrame, memories: DataFrame, embedder) -> DataFrame:
    """(p, q, overlap, cosine) of the candidates (p, q) that pass both gates.

    Memories that meet the same first one lie in blocks; a memory's tokens and
    vector travel once for each pair of blocks in which it has a partner, and
    not for each partner.
    """
    least = F.least("p", "q").alias("by")
    near = pairs.select(F.col("p").alias("id"), least).unionByName(pairs.select(F.col("q").alias("id"), least)).groupBy("id").agg(F.min("by").alias("by"))
    dealt = near.repartitionByRange("by", "id").sortWithinPartitions("by", "id")
    block = settle(dealt.select("id", (F.monotonically_increasing_id() / BLOCK).cast("long").alias("block")))
    tiled = pairs
    for x in "pq":
        tiled = tiled.join(block.select(F.col("id").alias(x), F.col("block").alias(f"{x}_block")), x)
    tiled = settle(tiled.select("p", "q", F.least("p_block", "q_block").alias("s"), F.greatest("p_block", "q_block").alias("t")))
    places = tiled.select(F.col("p").alias("id"), "s", "t").unionByName(tiled.select(F.col("q").alias("id"), "s", "t")).distinct()
    places = settle(places.groupBy("id").agg(F.collect_list(F.struct("s", "t")).alias("tiles")))
    vector = F.col("embedding") if "embedding" in memories.columns else embedder.column(F.col("content"))
    rows = among(memories, places, "inner").select("id", _hashes().alias("tokens"), vector.cast("array<double>").alias("embedding"), "tiles")
    rows = rows.select("id", "tokens", "embedding", F.inline("tiles"))
    kind = pairs.schema["p"].dataType.simpleString()
    return tiled.groupBy("s", "t").cogroup(rows.groupBy("s", "t")).applyInArrow(_compared, f"p {kind}, q {kind}, overlap double, cosine double")


def near_duplicates(memories: DataFrame, classes: DataFrame | None = None, embedder=None) -> DataFrame:
    """(a, b, cosine, overlap): pairs of class representatives alike in both
    gates; b is the one to go.  ``duplicate_classes`` has the members.

    Where ``memories`` has no vectors, ``embedder`` makes those of rows that
    have a candidate.
    """
    classes = duplicate_classes(memories) if classes is None else classes
    pairs = _candidates(_token_sets(memories, settle(classes)))
    tidy(memories.sparkSession)
    found = _alike(pairs, memories, embedder)
    return found.select(F.col("p").alias("a"), F.col("q").alias("b"), "cosine", "overlap")


#: Pairs that one task decides at most, and rounds that are tried before.
LOCAL_PAIRS, ROUNDS = 1_000_000, 3


def removed_by(pairs: DataFrame, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """Ids to go, as the sequential pass would have it: a row goes if an
    earlier row that stays matches it.

    A round decides all rows without an undecided earlier match, and the later
    matches of those that stay.  Few rounds leave only chains; once these are
    ``local_pairs`` or fewer one task goes through them in order, and else the
    rounds go on.  Each round's undecided pairs are checkpointed.
    """
    pairs = settle(pairs.select("a", "b").distinct())
    gone = pairs.select(F.col("b").alias("id")).limit(0)
    for n in itertools.count(1):
        left = pairs.count()
        if not left:
            return gone
        if n > ROUNDS and left <= local_pairs:
            kind = pairs.schema["a"].dataType.simpleString()
            return gone.unionByName(pairs.coalesce(1).mapInPandas(_in_order, f"id {kind}"))
        waits = pairs.select(F.col("b").alias("a")).distinct()
        stays = pairs.select("a").distinct().join(waits, "a", "left_anti")
        out = settle(pairs.join(stays, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        gone = gone.unionByName(out)
        gone = gone if n % 16 else settle(gone)  # else the plan grows with the rounds
        rest = pairs.join(out, pairs["b"] == out["id"], "left_anti")
        pairs = settle(rest.join(out, rest["a"] == out["id"], "left_anti").join(stays, "a", "left_anti"))


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sequential pass over bounded pairs (a before b): ids that go."""
    pairs = pd.concat([*batches, pd.DataFrame({"a": [], "b": []})])
    later, waits = defaultdict(list), Counter(pairs["b"])
    for a, b in zip(pairs["a"], pairs["b"]):
        later[a].append(b)
    decided, gone = [a for a in later if not waits[a]], set()
    while decided:
        a = decided.pop()
        for b in later.get(a, ()):
            if a not in gone:
                gone.add(b)
            waits[b] -= 1
            if not waits[b]:
                decided.append(b)
    yield pd.DataFrame({"id": pd.Series(sorted(gone), dtype=pairs["b"].dtype)})


#: Passes over rows without an earlier candidate before all pairs are compared.
LEADER_PASSES = 2


def duplicates(memories: DataFrame, embedder=None) -> DataFrame:
    """(id) of the memories that go as near-duplicates of one that stays.

    All but the first of a class go: whatever takes the first one takes them,
    and else it does.  A row that is no candidate's later one stays, and its
    matches go: passes over such rows settle large groups by comparisons that
    are linear in their members.  Then the pairs of what is left are compared
    and decided in order.
    """
    classes = settle(duplicate_classes(memories))
    gone = classes.where("id <> class_id").select("id")
    pairs = _candidates(_token_sets(memories, classes))
    for _ in range(LEADER_PASSES):
        tidy(memories.sparkSession)
        if pairs.isEmpty():
            return settle(gone)
        later = pairs.select(F.col("q").alias("id")).distinct()
        leads = settle(pairs.select(F.col("p").alias("id")).distinct().join(later, "id", "left_anti"))
        side = lambda df, x: df.withColumnRenamed("id", x)
        led = settle(pairs.join(side(leads, "p"), "p", "left_semi"))
        out = settle(_alike(led, memories, embedder).select(F.col("q").alias("id")).distinct())
        gone = gone.unionByName(out)
        left = pairs.join(side(out, "q"), "q", "left_anti").join(side(leads.unionByName(out), "p"), "p", "left_anti")
        pairs = settle(left.select("p", "q"))
    found = _alike(pairs, memories, embedder)
    return settle(gone.unionByName(removed_by(found.select(F.col("p").alias("a"), F.col("q").alias("b")))))


def consolidate(memories: DataFrame, now_ms: int, max_vectors: int = 500, prune: bool = False, min_importance: float = 0.2, age_days: float = 90.0, enforce_ceiling: bool = False, embedder=None) -> tuple[DataFrame, DataFrame]:
    """(table after, one-row report).  Near-duplicates go, then promote, prune.

    The ceiling on vectors protected a quadratic loop; the join here needs
    none, so it applies only with ``enforce_ceiling``.
    """
    skipped = enforce_ceiling and memories.where(F.col("embedding").isNotNull()).count() > max_vectors
    gone = memories.select("id").limit(0) if skipped else duplicates(memories, embedder)
    left = among(memories, gone, "left_anti")
    risen = left.where(due())
    after = promote(left)
    pruned = after.where(prunable(now_ms, min_importance, age_days)) if prune else after.limit(0)
    if prune:
        after = after.where(~F.coalesce(prunable(now_ms, min_importance, age_days), F.lit(False)))
    report = memories.sparkSession.createDataFrame([(gone.count(), risen.count(), pruned.count(), skipped)], "removed long, promoted long, pruned long, skipped_dedup boolean")
    return after, report


def memory_context(recalled: DataFrame) -> DataFrame:
    """One row: recalled memories as lines, best first."""
    line = F.format_string("[%s, importance %s] %s", F.col("type"), F.format_number("importance", 2), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "id", line.alias("line"))))
    return recalled.agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("context"))

"""Named queries over whole tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.chunking import chunks
from recollect.functions.embedding import PAIR_STOPWORDS, LocalEmbedder, bucket_column
from recollect.functions.text import CONDENSE_STOPWORDS, condense, content_hash, estimate_tokens, parse_tags, token_set
from recollect.operators import ingest, keyword_index, memory, search, session, vector_blocks
from recollect.plans.scratch import passing_dir

KEYWORDS, KEYWORD_SOURCE = "ouent thor", "src0"
QUERY = "the thinging of onerst and heation"
DAY = 86_400_000
EPOCH = 1_704_067_200_000
NOW = EPOCH + 31 * DAY
#: The vector that vector queries look for: the stored one of this id.
QUERY_VECTOR = 7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs derived from the driver's tables; each whole.

MEMORIES_SQL = f"""
    SELECT conv_id * 1000 + turn AS id,
           ['fact','preference','decision','instruction','task','insight','conversation'][((conv_id * 1000 + turn) % 7 + 1)::INT] AS type,
           text AS content, ((conv_id * 37 + turn * 11) % 101) / 100.0::DOUBLE AS importance,
           [role, 'c' || (conv_id % 10)] AS tags, ((conv_id + turn) % 7)::INT AS recall_count,
           {EPOCH} + ((conv_id + turn) % 30) * {DAY} AS created_at,
           CASE WHEN turn % 3 = 0 THEN {EPOCH} + ((conv_id + turn) % 30) * {DAY} + {DAY} END AS last_recalled,
           {EPOCH} + ((conv_id + turn) % 30) * {DAY} + (turn % 5) * 3600000 AS updated_at
    FROM conversations"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    id = F.col("conv_id") * 1000 + F.col("turn")
    created = F.lit(EPOCH) + ((F.col("conv_id") + F.col("turn")) % 30) * DAY
    types = F.array(*map(F.lit, memory.MEMORY_TYPES))
    return c.select(
        id.alias("id"),
        F.element_at(types, (id % 7 + 1).cast("int")).alias("type"),
        F.col("text").alias("content"),
        (((F.col("conv_id") * 37 + F.col("turn") * 11) % 101) / 100.0).alias("importance"),
        F.array("role", F.concat(F.lit("c"), F.col("conv_id") % 10)).alias("tags"),
        ((F.col("conv_id") + F.col("turn")) % 7).cast("int").alias("recall_count"),
        created.alias("created_at"),
        F.when(F.col("turn") % 3 == 0, created + DAY).alias("last_recalled"),
        (created + (F.col("turn") % 5) * 3_600_000).alias("updated_at"),
    )


def features_sql(source: str) -> str:
    """CTEs that end in ``buckets(id, bucket, cnt)`` for ``source(id, content)``.

    Feature hashing as SQL: words, word pairs and character grams by FNV-1a;
    the tables have no CJK text.
    """
    stop = ", ".join(f"'{w}'" for w in sorted(PAIR_STOPWORDS))
    return f"""
    low AS (SELECT id, lower(content) AS c, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM {source}),
    grams AS (
        SELECT id, unnest(list_filter(w, lambda x: len(x) >= 2)) AS f FROM low
        UNION ALL SELECT id, 'w2:' || a || ':' || b FROM (SELECT id, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM low WHERE len(w) > 1)
            WHERE len(a) >= 2 AND len(b) >= 2 AND a NOT IN ({stop}) AND b NOT IN ({stop})
        UNION ALL SELECT id, 'g2:' || substring(c, i::INT, 2) FROM (SELECT id, c, unnest(range(1, length(c))) AS i FROM low)
        UNION ALL SELECT id, 'g3:' || substring(c, i::INT, 3) FROM (SELECT id, c, unnest(range(1, length(c) - 1)) AS i FROM low)),
    counted AS (SELECT id, f, count(*) AS n FROM grams GROUP BY ALL),
    hashed AS (SELECT f, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(f, ''), lambda x: ord(x)::BIGINT)),
                   lambda h, x: (xor(h, x) * 16777619) % 4294967296) % 1024 AS bucket FROM (SELECT DISTINCT f FROM counted)),
    buckets AS (SELECT id, bucket, sum(n)::BIGINT AS cnt FROM counted JOIN hashed USING (f) GROUP BY ALL),
    sizes AS (SELECT id, sum(cnt) AS total FROM buckets GROUP BY id)"""


def cosine_sql(source: str, text: str) -> str:
    """CTEs that end in ``cosines(id, cosine)`` of ``source`` with a text."""
    return f"""both_ AS (SELECT id, content FROM {source} UNION ALL SELECT -1, '{text}'), {features_sql("both_")},
    cosines AS (SELECT a.id, sum(sqrt(a.cnt * b.cnt)) / sqrt(any_value(x.total) * any_value(y.total)) AS cosine
        FROM buckets a JOIN buckets b ON a.bucket = b.bucket AND b.id = -1 JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = -1
        WHERE a.id <> -1 GROUP BY a.id)"""


# Keyword search


def bm25_sql(table: str, id: str, tokens: list[str], where: str = "true") -> str:
    low = "lower(text)"
    tf = ", ".join(f"(length({low}) - length(replace({low}, '{x}', ''))) / {len(x)} AS tf{i}" for i, x in enumerate(tokens))
    has = " AND ".join(f"tf{i} > 0" for i in range(len(tokens)))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(tokens)))
    idf = lambda i: f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN 0 ELSE 1e-6 END)"
    score = " + ".join(f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * d / avg_d))" for i in range(len(tokens)))
    return f"""b AS (SELECT *, greatest(length({low}) - 2, 0) AS d, {tf} FROM {table}),
    s AS (SELECT count(*) AS n, avg(d) AS avg_d, {df} FROM b),
    scored AS (SELECT {id} AS id, {score} AS bm25 FROM b, s WHERE {has} AND {where})"""


@query(f"WITH {bm25_sql('documents', 'doc_id', KEYWORDS.split())} SELECT id, round(bm25, 6) AS bm25 FROM scored ORDER BY scored.bm25 DESC, id LIMIT 60")
def keyword_bm25_topk(spark, sf_dir):
    hits = search.keyword_search(t(spark, sf_dir, "documents"), KEYWORDS, id_col="doc_id", text_col="text")
    return hits.select("id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {bm25_sql('documents', 'doc_id', KEYWORDS.split()[:1], f"source = '{KEYWORD_SOURCE}'")} SELECT id, round(bm25, 6) AS bm25 FROM scored ORDER BY scored.bm25 DESC, id LIMIT 60")
def keyword_filtered(spark, sf_dir):
    allowed = F.col("source") == KEYWORD_SOURCE
    hits = search.keyword_search(t(spark, sf_dir, "documents"), KEYWORDS.split()[0], id_col="doc_id", text_col="text", allowed=allowed)
    return hits.select("id", F.round("bm25", 6).alias("bm25"))


# The same through an index, which is built over all texts first


def _indexed(spark, sf_dir) -> keyword_index.KeywordIndex:
    path = passing_dir(spark, "keywords")
    keyword_index.add(t(spark, sf_dir, "documents"), path, id_col="doc_id", text_col="text")
    return keyword_index.read(spark, path, "long")


@query(ORACLE["keyword_bm25_topk"])
def keyword_index_topk(spark, sf_dir):
    return keyword_index.indexed_search(_indexed(spark, sf_dir), KEYWORDS).select("id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {bm25_sql('documents', 'doc_id', ['the'], 'doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)')} SELECT id, round(bm25, 6) AS bm25 FROM scored ORDER BY scored.bm25 DESC, id LIMIT 60")
def keyword_index_filtered(spark, sf_dir):
    """A token that very many words contain, among documents labelled good."""
    good = t(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return keyword_index.indexed_search(_indexed(spark, sf_dir), "the", allowed=good).select("id", F.round("bm25", 6).alias("bm25"))


# Vector search

_DOTS = f"""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = {QUERY_VECTOR}),
    d AS (SELECT vec_id AS id, label, least(1, greatest(-1, list_dot_product(embedding::DOUBLE[], e))) AS score FROM embeddings, q)"""


def _query_vector(vectors: DataFrame) -> list[float]:
    return [float(x) for x in vectors.where(F.col("vec_id") == QUERY_VECTOR).first()["embedding"]]


def _vector(spark, sf_dir, top_k, min_score, allowed=None):
    v = t(spark, sf_dir, "embeddings")
    hits = search.vector_search(v, _query_vector(v), top_k, min_score, "vec_id", allowed=allowed)
    return hits.select("id", F.round("score", 6).alias("score"))


@query(f"{_DOTS} SELECT id, round(score, 6) AS score FROM d WHERE score >= 0.08 ORDER BY d.score DESC, id LIMIT 10")
def vector_topk(spark, sf_dir):
    return _vector(spark, sf_dir, 10, 0.08)


@query(f"{_DOTS} SELECT id, round(score, 6) AS score FROM d WHERE score >= 0.25 ORDER BY d.score DESC, id LIMIT 60")
def vector_min_score(spark, sf_dir):
    return _vector(spark, sf_dir, 60, 0.25)


@query(f"{_DOTS} SELECT id, round(score, 6) AS score FROM d WHERE score >= 0.0 AND label IN (2, 5) ORDER BY d.score DESC, id LIMIT 20")
def vector_label_filter(spark, sf_dir):
    return _vector(spark, sf_dir, 20, 0.0, F.col("label").isin(2, 5))


# The same through blocks of vectors, of which only those that can win are read


def _blocked(spark, sf_dir, top_k, min_score, allowed=None):
    v, path = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"), passing_dir(spark, "vectors")
    vector_blocks.fit(v, path)
    vector_blocks.add(v, path)
    query = [float(x) for x in v.where(F.col("id") == QUERY_VECTOR).first()["embedding"]]
    some = None if allowed is None else v.where(allowed)
    hits, report = vector_blocks.blocked_search(vector_blocks.read(spark, path, "long"), query, top_k, min_score, some)
    return hits, report


@query(ORACLE["vector_topk"])
def vector_blocks_topk(spark, sf_dir):
    return _blocked(spark, sf_dir, 10, 0.08)[0].select("id", F.round("score", 6).alias("score"))


@query(ORACLE["vector_label_filter"])
def vector_blocks_filtered(spark, sf_dir):
    return _blocked(spark, sf_dir, 20, 0.0, F.col("label").isin(2, 5))[0].select("id", F.round("score", 6).alias("score"))


# Fusion, over the benchmark's passages as chunks

HYBRID = "ouent the"


BENCHMARK_ITEMS = "WITH items AS (SELECT item_id AS id, text AS content, text FROM benchmark)"


def _fused_sql(order: str, score: str, floor: float, columns: str, k: int = 10, items: str = BENCHMARK_ITEMS) -> str:
    """``items``: what ends in ``items(id, content, text)``, with its WITH."""
    tokens = [x for x in HYBRID.split() if len(x) >= 3]
    return f"""{items}, {cosine_sql("items", HYBRID)},
    {bm25_sql("items", "id", tokens)},
    v AS (SELECT id, cosine AS vs, row_number() OVER (ORDER BY cosine DESC, id) - 1 AS vr FROM
        (SELECT * FROM cosines WHERE cosine >= 0.08 ORDER BY cosine DESC, id LIMIT 60)),
    k AS (SELECT id, bm25, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS kr, count(*) OVER () AS n, bm25 / max(bm25) OVER () AS ks FROM
        (SELECT * FROM scored ORDER BY bm25 DESC, id LIMIT 60)),
    f AS (SELECT coalesce(v.id, k.id) AS id, vs, vr, ks, kr, coalesce(1 / (60.0 + vr + 1), 0) + coalesce(1 / (60.0 + kr + 1), 0) AS rrf,
        coalesce(1 - kr / (n + 1.0), 0) AS decay FROM v FULL JOIN k ON v.id = k.id),
    top AS (SELECT *, {score} AS score FROM f ORDER BY {order} DESC, vr NULLS LAST, kr NULLS LAST, id LIMIT {k}),
    r AS (SELECT *, row_number() OVER (ORDER BY {order} DESC, vr NULLS LAST, kr NULLS LAST, id) - 1 AS rank FROM top)
    SELECT {columns} FROM r WHERE score >= {floor}"""


def _hybrid(spark, sf_dir, **kw):
    items = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    e = LocalEmbedder()
    rows = items.withColumn("embedding", e.column(F.col("content")))
    return search.search_chunks(rows, HYBRID, e.query(HYBRID), **kw)


_RRF = _fused_sql("rrf", "greatest(coalesce(vs, 0), decay)", 0.08, "rank::INT AS rank, id, round(score, 6) AS score, round(rrf, 6) AS rrf_score")


@query(_RRF)
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("rank", "id", F.round("score", 6).alias("score"), F.round("rrf_score", 6).alias("rrf_score"))


@query(_fused_sql("score", "0.7 * coalesce(vs, 0) + (1 - 0.7) * coalesce(ks, 0)", 0.2, "rank::INT AS rank, id, round(score, 6) AS score"))
def hybrid_alpha(spark, sf_dir):
    return _hybrid(spark, sf_dir, alpha=0.7, min_score=0.2).select("rank", "id", F.round("score", 6).alias("score"))


_LEGS = "CASE WHEN vr IS NULL THEN 'keyword' WHEN kr IS NULL THEN 'vector' ELSE 'vector,keyword' END AS legs"


@query(_fused_sql("rrf", "greatest(coalesce(vs, 0), decay)", 0.08, f"rank::INT AS rank, id, round(vs, 6) AS vector_score, round(ks, 6) AS keyword_score, vr::INT AS vector_rank, kr::INT AS keyword_rank, {_LEGS}", 20))
def hybrid_explain(spark, sf_dir):
    hits = _hybrid(spark, sf_dir, top_k=20)
    return hits.select("rank", "id", F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"), "vector_rank", "keyword_rank", F.array_join("legs", ",").alias("legs"))


@query(f"WITH items AS (SELECT item_id AS id, text AS content FROM benchmark), {features_sql('items')} SELECT id, bucket::INT AS bucket, cnt, round(sqrt(cnt / total) * CASE WHEN bucket % 2 = 1 THEN 1 ELSE -1 END, 9) AS value FROM buckets JOIN sizes USING (id)")
def local_embed_buckets(spark, sf_dir):
    items = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.inline(bucket_column(F.col("text"))))
    sizes = F.sum("count")
    total = items.groupBy("id").agg(sizes.alias("total"))
    value = F.sqrt(F.col("count") / F.col("total")) * F.when(F.col("bucket") % 2 == 1, 1).otherwise(-1)
    return items.join(total, "id").select("id", "bucket", F.col("count").alias("cnt"), F.round(value, 9).alias("value"))


@query(
    f"""WITH r AS ({_fused_sql("rrf", "greatest(coalesce(vs, 0), decay)", 0.08, "rank, id, score", 6)})
    SELECT string_agg('--- [item#' || id || '] (' || format('{{:.3f}}', score) || ') ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
           sum(ceil(length(text) / 4.0))::BIGINT AS total_tokens FROM r JOIN benchmark ON item_id = id"""
)
def context_block(spark, sf_dir):
    items = t(spark, sf_dir, "benchmark")
    hits = F.broadcast(_hybrid(spark, sf_dir, top_k=6)).join(items, F.col("id") == F.col("item_id"))
    hits = hits.select("rank", "score", F.lit("item").alias("doc_title"), F.col("id").alias("chunk_index"), F.col("text").alias("content"), estimate_tokens(F.col("text")).alias("token_count"))
    return search.context_block(hits)


# Ingest


@query("SELECT content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, sha256(text) AS content_hash FROM documents) GROUP BY content_hash")
def doc_dedup_first_wins(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT content_hash, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(source || chr(0) || text) AS content_hash FROM documents) GROUP BY content_hash")
def dedup_scoped(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text"), F.col("source")).alias("content_hash"))
    return ingest.first_wins(d, "content_hash", "doc_id")


@query("SELECT doc_id FROM documents WHERE lang <> 'en' AND text NOT IN (SELECT text FROM documents WHERE lang = 'en')")
def dedup_anti_join(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", content_hash(F.col("text")).alias("h"))
    return d.where("lang <> 'en'").join(d.where("lang = 'en'"), "h", "left_anti").select("doc_id")


def _cut_sql(name: str, source: str, most: int) -> str:
    """CTEs that end in ``name(id, n, part, piece)``: texts of ``source(id, n,
    piece)`` cut at the last good break past 60% of ``most`` characters."""
    floor = int(most * 0.6)
    return f"""{name}_cut AS (
        SELECT id, n, 0 AS part, NULL::VARCHAR AS piece, piece AS rest FROM {source}
        UNION ALL SELECT id, n, part + 1, trim(left(rest, cut), {_BLANKS}), substr(rest, cut + 1) FROM (
            SELECT *, CASE WHEN good > {floor} THEN good + 1 WHEN blank - 1 > {floor} THEN blank ELSE {most} END AS cut FROM (
                SELECT *, length(regexp_extract(left(rest, {most}), '(?s)^(.*)(?:\\. |\\.\\n|。|\\n|, )', 1)) AS good, length(regexp_extract(left(rest, {most}), '(?s)^.*\\s')) AS blank
                FROM {name}_cut WHERE length(rest) > {most}))),
    {name} AS (SELECT id, n, part, piece FROM {name}_cut WHERE part > 0
        UNION ALL SELECT id, n, part + 1, trim(rest, {_BLANKS}) FROM {name}_cut WHERE length(rest) <= {most} AND trim(rest, {_BLANKS}) <> '')"""


_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def chunks_sql(most: int = 900, overlap: int = 120) -> str:
    """CTEs that end in ``chunked(doc_id, idx, text, token_count)``.

    Another way to the same chunks: sentences by a pattern, the cuts and the
    window by recursion, a row a step.  For one block a text: the tables have
    no blank line, fence, nor character beyond the basic plane.
    """
    cjk = "length(regexp_replace(piece, '[^一-鿿぀-ヿ가-힯]', '', 'g'))"
    glue = lambda w: f"CASE WHEN {w} = '' OR ends_with({w}, chr(10)) OR starts_with(piece, chr(10)) THEN '' WHEN contains({w} || piece, chr(10)) THEN chr(10) ELSE ' ' END"
    wordy = "'[\\p{L}\\p{N}_]'"
    return f"""blocks AS (SELECT doc_id AS id, 0 AS n, rtrim(replace(text, chr(13) || chr(10), chr(10)), {_BLANKS}) AS piece FROM documents WHERE trim(text, {_BLANKS}) <> ''),
    long_blocks AS (SELECT * FROM blocks WHERE length(piece) > {most}), {_cut_sql("long_pieces", "long_blocks", most)},
    marked AS (SELECT id, piece, regexp_replace(regexp_replace(piece, '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g') AS m FROM blocks WHERE length(piece) <= {most}),
    sentences AS (SELECT id, piece, list_filter(list_transform(regexp_extract_all(m, '[^.!?。！？]*[.!?。！？]["''\\)\\]}}»”]*|[^.!?。！？]+$'), lambda x: trim(replace(x, chr(1), '.'), {_BLANKS})), lambda x: x <> '') AS ss FROM marked),
    pieces AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY part) AS n, piece FROM long_pieces
        UNION ALL SELECT id, unnest(range(1, len(ss) + 1)), unnest(ss) FROM sentences),
    steps AS (
        SELECT id, 0::BIGINT AS n, ''::VARCHAR AS w, NULL::VARCHAR AS full_ FROM blocks
        UNION ALL SELECT id, n, kept || {glue("kept")} || piece, CASE WHEN over THEN w END FROM (
            SELECT *, CASE WHEN NOT over THEN w WHEN {overlap} = 0 THEN '' WHEN regexp_full_match(before, {wordy}) AND regexp_full_match(body[1], {wordy}) AND regexp_matches(body, '\\s') THEN regexp_replace(body, '^\\S+\\s+', '') ELSE body END AS kept FROM (
                SELECT p.id, p.n, s.w, p.piece, s.w <> '' AND length(s.w) + length({glue("s.w")}) + length(p.piece) > {most} AS over,
                    ltrim(right(s.w, {overlap}), {_BLANKS}) AS body, CASE WHEN length(s.w) > {overlap} THEN s.w[length(s.w) - {overlap}] ELSE '' END AS before
                FROM steps s JOIN pieces p ON p.id = s.id AND p.n = s.n + 1))),
    windows AS (SELECT id, n, trim(full_, {_BLANKS}) AS piece FROM steps WHERE full_ IS NOT NULL
        UNION ALL SELECT id, max(n) + 1, trim(arg_max(w, n), {_BLANKS}) FROM steps GROUP BY id),
    {_cut_sql("whole", "windows", most)},
    chunked AS (SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY n, part) - 1)::INT AS idx, piece AS text,
        (ceil({cjk} * 1.5) + ceil((length(piece) - {cjk}) / 4.0))::INT AS token_count FROM whole WHERE piece <> '')"""


@query(f"WITH RECURSIVE {chunks_sql()} SELECT doc_id, idx, text, token_count FROM chunked")
def chunk_documents(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.inline(chunks(F.col("text")))).select("doc_id", "idx", "text", "token_count")


@query(f"WITH RECURSIVE {chunks_sql()} SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, max(length(text))::INT AS longest FROM chunked")
def chunk_stats(spark, sf_dir):
    return chunk_documents(spark, sf_dir).agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max(F.length("text")).alias("longest"))


def _chunk_table(spark, sf_dir) -> DataFrame:
    c = chunk_documents(spark, sf_dir)
    return c.select(F.concat("doc_id", F.lit("#"), "idx").alias("id"), "doc_id", "idx", F.col("text").alias("content"), "token_count")


@query(f"WITH RECURSIVE {chunks_sql()} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, sum(token_count)::BIGINT AS tokens FROM chunked")
def store_document_stats(spark, sf_dir):
    return ingest.document_stats(t(spark, sf_dir, "documents"), _chunk_table(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {chunks_sql()}, parts AS (SELECT doc_id || '#' || idx AS id, doc_id, idx, text FROM chunked), {bm25_sql("parts", "id", KEYWORDS.split())},
    k AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS kr, count(*) OVER () AS n FROM (SELECT * FROM scored ORDER BY bm25 DESC, id LIMIT 60))
    SELECT kr::INT AS rank, k.id, source, idx AS chunk_index, round(1 - kr / (n + 1.0), 6)::DOUBLE AS score, parts.text AS content
    FROM k JOIN parts USING (id) JOIN documents USING (doc_id) WHERE kr < 10"""
)
def hydrated_hits(spark, sf_dir):
    path, d = passing_dir(spark, "chunks"), t(spark, sf_dir, "documents")
    cut = _chunk_table(spark, sf_dir)
    cut.write.parquet(path)
    parts = spark.read.schema(cut.schema).parquet(path)
    hits = search.search_chunks(parts, KEYWORDS, None, mode="keyword")
    hits = search.hydrate(hits, parts, d.select(F.col("doc_id").alias("id"), F.lit("").alias("title"), "source"))
    return hits.select("rank", "id", "source", "chunk_index", F.round("score", 6).alias("score"), "content")


@query("SELECT doc_id, ceil(length(text) / 4.0)::INT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT source, count(*) AS documents, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents GROUP BY source")
def documents_stats(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum(estimate_tokens(F.col("text"))).alias("tokens"))


@query("SELECT doc_id AS id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id OFFSET 20 LIMIT 100")
def docs_page(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    page = d.select(F.col("doc_id").alias("id"), F.lit("").alias("title"), "source", F.lit("text").alias("content_type"), F.lit(1).alias("chunk_count"), F.lit(0).alias("created_at"), F.col("n_chars").alias("updated_at"))
    return ingest.list_documents(page, 100, 20).select("id", "source", F.col("updated_at").alias("n_chars"))


@query("SELECT doc_id AS id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC, doc_id OFFSET 40 LIMIT 50")
def docs_page_total(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    page = d.select(F.col("doc_id").alias("id"), F.lit("").alias("title"), "source", F.lit("text").alias("content_type"), F.lit(1).alias("chunk_count"), F.lit(0).alias("created_at"), F.col("n_chars").alias("updated_at"))
    return ingest.document_page(page, 50, 40).select("id", F.col("updated_at").alias("n_chars"), "total")


@query(f"WITH RECURSIVE {chunks_sql()} SELECT 'documents' AS kind, doc_id, 1::BIGINT AS rows FROM documents WHERE doc_id <> 5 UNION ALL SELECT 'chunks', doc_id, count(*) FROM chunked WHERE doc_id <> 5 GROUP BY doc_id")
def delete_document_cascade(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    kept, parts = ingest.delete_document(d, _chunk_table(spark, sf_dir).select("doc_id"), 5)
    rows = kept.select(F.lit("documents").alias("kind"), F.col("id").alias("doc_id")).unionByName(parts.select(F.lit("chunks").alias("kind"), "doc_id"))
    return rows.groupBy("kind", "doc_id").agg(F.count("*").alias("rows"))


@query("SELECT page_id, CASE WHEN lower(url) LIKE '%.html' THEN 'html' ELSE 'text' END AS content_type FROM pages")
def content_types(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", ingest.content_type(F.col("url")).alias("content_type"))


# Fusion over the chunks of all documents

CHUNK_ITEMS = f"WITH RECURSIVE {chunks_sql()}, items AS MATERIALIZED (SELECT min(doc_id * 100000 + idx) AS id, text AS content, text FROM chunked GROUP BY text)"


def _hybrid_chunks(spark, sf_dir, **kw):
    """Chunks, of equal ones the first, are cut and embedded once, and both legs
    read them as written."""
    e, path = LocalEmbedder(), passing_dir(spark, "chunks")
    c = chunk_documents(spark, sf_dir).select((F.col("doc_id") * 100_000 + F.col("idx")).alias("id"), F.col("text").alias("content"))
    c = c.groupBy("content").agg(F.min("id").alias("id")).select("id", "content")
    c.withColumn("embedding", e.column(F.col("content"))).write.parquet(path)
    return search.search_chunks(spark.read.schema("id long, content string, embedding array<double>").parquet(path), HYBRID, e.query(HYBRID), **kw)


@query(_fused_sql("rrf", "greatest(coalesce(vs, 0), decay)", 0.08, "rank::INT AS rank, id, round(score, 6) AS score, round(rrf, 6) AS rrf_score", items=CHUNK_ITEMS))
def hybrid_chunks_rrf(spark, sf_dir):
    return _hybrid_chunks(spark, sf_dir).select("rank", "id", F.round("score", 6).alias("score"), F.round("rrf_score", 6).alias("rrf_score"))


@query(_fused_sql("score", "0.7 * coalesce(vs, 0) + (1 - 0.7) * coalesce(ks, 0)", 0.2, f"rank::INT AS rank, id, round(score, 6) AS score, {_LEGS}", 20, CHUNK_ITEMS))
def hybrid_chunks_alpha(spark, sf_dir):
    hits = _hybrid_chunks(spark, sf_dir, alpha=0.7, min_score=0.2, top_k=20)
    return hits.select("rank", "id", F.round("score", 6).alias("score"), F.array_join("legs", ",").alias("legs"))


# Sessions

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(CONDENSE_STOPWORDS))


@query(
    f"""WITH b AS (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS c FROM conversations WHERE role = 'user'),
    cut AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(c, '([.!?…:])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS ss FROM b),
    e AS (SELECT conv_id, turn, c, i, ss[i] AS s, regexp_extract_all(lower(ss[i]), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM cut)),
    p AS (SELECT *, len(list_filter(w, lambda x: length(x) >= 4 AND x NOT IN ({_STOP}) AND NOT regexp_full_match(x, '\\d+'))) + least(len(w), 8) / 10.0 + (i = 1)::INT AS score FROM e),
    q AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY conv_id, turn ORDER BY score DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept FROM p),
    r AS (SELECT conv_id, turn, string_agg(s, ' ' ORDER BY i) AS condensed FROM q WHERE kept < greatest(floor(length(c) * 0.35 + 0.5), least(120, length(c))) GROUP BY ALL)
    SELECT conv_id, turn, CASE WHEN length(c) <= 120 OR len(ss) <= 1 THEN c ELSE condensed END AS condensed FROM cut LEFT JOIN r USING (conv_id, turn)"""
)
def condense_sessions(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", condense(F.col("text")).alias("condensed"))


@query("SELECT conv_id AS session_id, count(*) AS messages, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations WHERE role = 'user' GROUP BY conv_id")
def session_transcripts(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").where(F.col("role") == "user")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("messages"), F.array_join(F.transform(turns, lambda x: x["text"]), "\n").alias("content"))


@query("SELECT turn AS ts, text AS content FROM conversations WHERE conv_id = 3 AND role = 'user' AND trim(text) <> ''")
def session_transcript(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    messages = c.select(key.alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("time_created"), F.to_json(F.struct("role")).alias("data"))
    parts = c.select(key.alias("message_id"), F.to_json(F.struct(F.lit("text").alias("type"), "text")).alias("data"))
    return session.transcript(messages, parts, 3).select("ts", "content")


def _sessions(spark, sf_dir) -> list[DataFrame]:
    c = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    one = c.select(F.col("conv_id").alias("id"), F.lit("chat").alias("title"), F.concat(F.lit("/home/"), F.col("conv_id") % 2, F.lit("/")).alias("directory"), (F.col("turns") * 1000 + F.col("conv_id")).alias("time_updated"))
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    two = e.select(F.col("user_id").alias("id"), F.lit("log").alias("title"), F.lit("\\home\\1").alias("directory"), F.col("n").alias("time_updated"))
    return [one, two]


_SESSIONS = """WITH one AS (SELECT conv_id AS id, 'chat' AS title, '/home/' || (conv_id % 2) || '/' AS directory, max(turn) * 1000 + conv_id AS time_updated FROM conversations GROUP BY conv_id ORDER BY time_updated DESC, id LIMIT 50),
    two AS (SELECT user_id AS id, 'log' AS title, '\\home\\1' AS directory, count(*) AS time_updated FROM events GROUP BY user_id ORDER BY time_updated DESC, id LIMIT 50),
    u AS (SELECT * FROM one UNION ALL SELECT * FROM two WHERE id NOT IN (SELECT id FROM one))"""


@query(f"{_SESSIONS} SELECT id, title, time_updated FROM u ORDER BY time_updated DESC, id LIMIT 40")
def sessions_union(spark, sf_dir):
    return session.list_sessions(_sessions(spark, sf_dir), 40).select("id", "title", "time_updated")


@query(f"{_SESSIONS} SELECT id, title, time_updated FROM u WHERE regexp_replace(replace(directory, '\\', '/'), '/+$', '') = '/home/1' ORDER BY time_updated DESC, id LIMIT 1")
def latest_session(spark, sf_dir):
    return session.latest_session(session.list_sessions(_sessions(spark, sf_dir), 50, "/home/1"), NOW).select("id", "title", "time_updated")


@query("SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events WHERE json_valid(props) AND (props->>'$.k')::INT >= 50")
def events_json_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(spark, sf_dir, "events").where(k >= 50).select("event_id", "event_type", k.alias("k"))


# Memories


@query(f"WITH m AS ({MEMORIES_SQL}) SELECT id, type, content, importance FROM m WHERE type = 'decision' AND importance >= 0.3 ORDER BY updated_at DESC, id DESC LIMIT 50")
def memory_list(spark, sf_dir):
    return memory.list_memories(memories(spark, sf_dir), type="decision", min_importance=0.3, limit=50).select("id", "type", "content", "importance")


@query(f"WITH m AS ({MEMORIES_SQL}) SELECT id, updated_at FROM m WHERE list_contains(tags, 'c7') ORDER BY updated_at DESC, id DESC LIMIT 500")
def memory_tag_filter(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("tags", parse_tags(F.to_json("tags")))
    return memory.list_memories(m, tag="c7", limit=500).select("id", "updated_at")


@query(f"WITH m AS ({MEMORIES_SQL}) SELECT type, count(*) AS n, round(avg(importance), 6) AS avg_importance, ceil(sum(length(content)) / 4.0)::BIGINT AS tokens FROM m GROUP BY type UNION ALL SELECT 'all', count(*), round(avg(importance), 6), ceil(sum(length(content)) / 4.0)::BIGINT FROM m")
def memory_stats(spark, sf_dir):
    m = memories(spark, sf_dir)
    whole = memory.memory_stats(m).select(F.lit("all").alias("type"), F.col("count").alias("n"), F.round("avg_importance", 6).alias("avg_importance"), "tokens")
    each = m.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("avg_importance"), F.ceil(F.sum(F.length("content")) / 4).alias("tokens"))
    return each.unionByName(whole)


_RECALL = f"""WITH m AS ({MEMORIES_SQL}), {cosine_sql("m", QUERY)},
    near AS (SELECT id, cosine FROM cosines WHERE cosine >= 0.1 ORDER BY cosine DESC, id LIMIT 16),
    s AS (SELECT m.id, type, importance, content, cosine, cosine * pow(0.5, ({NOW} - coalesce(last_recalled, created_at)) / (14 * {DAY}.0)) AS score FROM near JOIN m USING (id)),
    hit AS (SELECT * FROM s WHERE score >= 0.1 ORDER BY s.score DESC, s.cosine DESC, id LIMIT 8)"""


def _recalled(spark, sf_dir) -> DataFrame:
    e = LocalEmbedder()
    m = memories(spark, sf_dir).withColumn("embedding", e.column(F.col("content")))
    return memory.recall(m, e.query(QUERY), NOW)


@query(f"{_RECALL} SELECT id, round(cosine, 6) AS cosine, round(score, 6) AS score FROM hit")
def memory_recall_decay(spark, sf_dir):
    return _recalled(spark, sf_dir).select("id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@query(f"{_RECALL} SELECT string_agg('[' || type || ', importance ' || format('{{:.2f}}', importance) || '] ' || content, chr(10) ORDER BY score DESC, id) AS context FROM hit")
def memory_context_lines(spark, sf_dir):
    return memory.memory_context(_recalled(spark, sf_dir))


@query(f"WITH m AS ({MEMORIES_SQL}) SELECT id, CASE WHEN recall_count >= 5 AND importance < 1 THEN round(least(1, importance + 0.1), 6) ELSE importance END AS importance FROM m")
def memory_promote(spark, sf_dir):
    return memory.promote(memories(spark, sf_dir)).select("id", F.round("importance", 6).alias("importance"))


@query(f"WITH m AS ({MEMORIES_SQL}) SELECT id FROM m WHERE importance < 0.2 AND recall_count = 0 AND coalesce(last_recalled, created_at) <= {NOW - 10 * DAY}")
def memory_prune(spark, sf_dir):
    return memories(spark, sf_dir).where(memory.prunable(NOW, 0.2, 10)).select("id")


@query(f"WITH m AS ({MEMORIES_SQL}) SELECT id, CASE WHEN id = 2001 THEN 'task' ELSE type END AS type, CASE WHEN id = 2001 THEN 0.75 ELSE importance END AS importance, CASE WHEN id = 2001 THEN {NOW} ELSE updated_at END AS updated_at FROM m")
def update_memory_patch(spark, sf_dir):
    m = memory.update_memory(memories(spark, sf_dir), 2001, {"type": "task", "importance": 0.75}, NOW)
    return m.select("id", "type", "importance", "updated_at")


_ALL = "every AS (SELECT doc_id AS id, text AS content, ((doc_id * 37) % 101) / 100.0::DOUBLE AS importance, doc_id % 50 AS created_at FROM documents)"


def pairs_sql() -> str:
    """CTEs and the select of pairs (a, b, cosine, overlap) of ``every``: all
    pairs of unlike contents that share a token and are of near enough size are
    counted, with no filter that the code's own could share a mistake with."""
    return f"""m AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY content ORDER BY importance DESC, created_at, id) = 1),
    tok AS MATERIALIZED (SELECT DISTINCT id, unnest(list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1)) AS t FROM m),
    size AS (SELECT id, count(*) AS u FROM tok GROUP BY id),
    sized AS MATERIALIZED (SELECT id, u, t FROM tok JOIN size USING (id)),
    shared AS (SELECT a.id AS p, b.id AS q, any_value(a.u) AS pu, any_value(b.u) AS qu, count(*) AS n FROM sized a JOIN sized b ON b.t = a.t AND a.id < b.id AND a.u >= 0.79 * b.u AND b.u >= 0.79 * a.u GROUP BY a.id, b.id),
    c AS MATERIALIZED (SELECT p, q, n / (pu + qu - n)::DOUBLE AS overlap FROM shared WHERE n / (pu + qu - n)::DOUBLE >= 0.8),
    x AS (SELECT id, content FROM m WHERE id IN (SELECT p FROM c UNION SELECT q FROM c)), {features_sql("x")},
    z AS (SELECT p, q, overlap, coalesce(sum(sqrt(a.cnt * b.cnt)), 0) / sqrt(any_value(sa.total) * any_value(sb.total)) AS cosine
          FROM c JOIN buckets a ON a.id = p JOIN buckets b ON b.id = q AND b.bucket = a.bucket JOIN sizes sa ON sa.id = p JOIN sizes sb ON sb.id = q GROUP BY p, q, overlap),
    o AS (SELECT z.*, (-a.importance, a.created_at, a.id) < (-b.importance, b.created_at, b.id) AS first FROM z JOIN m a ON a.id = p JOIN m b ON b.id = q WHERE cosine >= 0.92)
    SELECT CASE WHEN first THEN p ELSE q END AS a, CASE WHEN first THEN q ELSE p END AS b, round(cosine, 6) AS cosine, round(overlap, 6) AS overlap FROM o"""


def removed_sql() -> str:
    """CTEs that end in ``removed(id)``: the sequential pass over ``every`` by
    its matches ``pairs(a, b)``, a row a step."""
    return """later AS (SELECT id FROM every WHERE regexp_matches(content, '[\\p{L}\\p{N}]{2}') QUALIFY row_number() OVER (PARTITION BY content ORDER BY importance DESC, created_at, id) > 1),
    firsts AS MATERIALIZED (SELECT a, bs, row_number() OVER (ORDER BY importance DESC, created_at, a) AS k FROM (SELECT a, list(b) AS bs FROM pairs GROUP BY a) JOIN every ON id = a),
    pass AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone
        UNION ALL SELECT f.k, CASE WHEN list_contains(gone, f.a) THEN gone ELSE list_concat(gone, f.bs::BIGINT[]) END FROM pass JOIN firsts f ON f.k = pass.k + 1),
    removed AS (SELECT id FROM later UNION SELECT unnest(gone) FROM (SELECT gone FROM pass ORDER BY k DESC LIMIT 1))"""


def _document_memories(spark, sf_dir) -> DataFrame:
    """Documents as memories; vectors are made of those that need one."""
    d = t(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        (((F.col("doc_id") * 37) % 101) / 100.0).alias("importance"),
        (F.col("doc_id") % 50).alias("created_at"),
        (F.col("doc_id") % 7).cast("int").alias("recall_count"),
        F.lit(None).cast("long").alias("last_recalled"),
    )


@query(f"WITH {_ALL}, {pairs_sql()}")
def near_dup_pairs(spark, sf_dir):
    p = memory.near_duplicates(_document_memories(spark, sf_dir), embedder=LocalEmbedder())
    return p.select("a", "b", F.round("cosine", 6).alias("cosine"), F.round("overlap", 6).alias("overlap"))


@query(
    f"""WITH {_ALL} SELECT id, first_value(id) OVER (PARTITION BY content ORDER BY importance DESC, created_at, id) AS class_id
    FROM every WHERE regexp_matches(content, '[\\p{{L}}\\p{{N}}]{{2}}')"""
)
def near_dup_members(spark, sf_dir):
    return memory.duplicate_classes(_document_memories(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_ALL}, pairs AS MATERIALIZED (WITH {pairs_sql()}), {removed_sql()}
    SELECT id, CASE WHEN id % 7 >= 5 AND importance < 1 THEN round(least(1, importance + 0.1), 6) ELSE importance END AS importance
    FROM every WHERE id NOT IN (SELECT id FROM removed) AND NOT (importance < 0.2 AND id % 7 = 0)"""
)
def consolidate_survivors(spark, sf_dir):
    left, _ = memory.consolidate(_document_memories(spark, sf_dir), 20 * DAY, prune=True, age_days=10, embedder=LocalEmbedder())
    return left.select("id", F.round("importance", 6).alias("importance"))


@query(f"SELECT conv_id, turn, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1))) AS n_tokens FROM conversations")
def token_sets(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(token_set(F.col("text"))).cast("long").alias("n_tokens"))

"""The jobs as queries over whole tables, with their SQL.

Each runs its job twice into one new folder of the shared directory, where the
files stay, and returns the output as it stands then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import corpus_index, memory_upkeep
from recollect.operators.memory import DAY
from recollect.plans.queries import chunks_sql, pairs_sql, removed_sql
from recollect.plans.scratch import fresh_dir

NOW = "2024-02-01"


def job1_corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_dir(spark, "job1")
    for _ in range(2):
        corpus_index.run(spark, f"{sf_dir}/documents.parquet", f"{at}/corpus", f"{at}/checkpoint")
    return corpus_index.read(spark, f"{at}/corpus")


def job2_memory_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_dir(spark, "job2")
    for _ in range(2):
        memory_upkeep.run(spark, f"{sf_dir}/conversations.parquet", f"{sf_dir}/events.parquet", f"{at}/memories", NOW)
    return memory_upkeep.read(spark, f"{at}/memories")


JOB1 = f"""WITH RECURSIVE {chunks_sql()},
    firsts AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
    mine AS MATERIALIZED (SELECT c.*, source FROM chunked c JOIN firsts USING (doc_id) JOIN documents USING (doc_id)),
    said AS (SELECT doc_id, idx, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]{{3,}}')) AS w FROM mine),
    counted AS (SELECT doc_id, idx, count(DISTINCT w) AS n_words, count(*) AS n_said FROM said GROUP BY doc_id, idx)
    SELECT doc_id, source, idx, text, token_count, coalesce(n_words, 0) AS n_words, coalesce(n_said, 0) AS n_said FROM mine LEFT JOIN counted USING (doc_id, idx)"""

_EVERY = """use AS (SELECT user_id, count(*) AS recall_count, max(epoch_ms(ts)) AS last_recalled, min(epoch_ms(ts)) AS created_at, avg(value) AS value FROM events GROUP BY user_id),
    every AS MATERIALIZED (SELECT conv_id * 100000 + turn AS id, text AS content, CASE role WHEN 'user' THEN 'conversation' WHEN 'assistant' THEN 'insight' WHEN 'system' THEN 'instruction' ELSE 'fact' END AS type,
        round(least(1, greatest(0, coalesce(value / 500, 0.1))), 6)::DOUBLE AS importance, coalesce(recall_count, 0) AS recall_count, last_recalled, coalesce(created_at, (SELECT min(epoch_ms(ts)) FROM events)) AS created_at
        FROM conversations LEFT JOIN use ON user_id = conv_id WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')"""

JOB2 = f"""WITH RECURSIVE {_EVERY}, pairs AS MATERIALIZED (WITH {pairs_sql()}), {removed_sql()},
    risen AS (SELECT *, CASE WHEN recall_count >= 5 AND importance < 1 THEN least(1, importance + 0.1) ELSE importance END AS now FROM every WHERE id NOT IN (SELECT id FROM removed)),
    judged AS (SELECT *, now < 0.2 AND recall_count = 0 AND coalesce(last_recalled, created_at) <= epoch_ms(TIMESTAMP '2024-02-01') - {10 * DAY} AS pruned FROM risen)
    SELECT id, CASE WHEN NOT pruned THEN type END AS type, CASE WHEN NOT pruned THEN round(now, 6) END AS importance, CASE WHEN pruned THEN 'pruned' END AS reason FROM judged
    UNION ALL SELECT id, NULL, NULL, 'duplicate' FROM every WHERE id IN (SELECT id FROM removed)"""

QUERIES = {f.__name__: f for f in (job1_corpus_index, job2_memory_upkeep)}
ORACLE = {"job1_corpus_index": JOB1, "job2_memory_upkeep": JOB2}

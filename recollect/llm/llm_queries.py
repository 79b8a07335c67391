"""The operators as queries over whole tables, with SQL where it can say them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import exact_dedup, licences, mixing, packing, quality, repetition, secrets, simhash, substring_dedup, token_counts, url_filter, vector_codes
from recollect.llm.common import table

#: The tokenizer's file; give another by this setting of the session.
VOCABULARY_SETTING = "spark.recollect.vocabulary"


def vocabulary(spark: SparkSession) -> str:
    import public_tokenizers

    return spark.conf.get(VOCABULARY_SETTING, None) or os.fspath(public_tokenizers.path("byte_bpe_50k.json"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary(spark))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), vocabulary(spark))


#: Shares of the training tokens that each domain is to have.
MIX = {"clean": 0.9, "junk": 0.06, "toxic": 0.04}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, measured = mixing.fit_mixing(docs, mixing.label_domains(table(spark, sf_dir, "labels")), MIX)
    return mixing.mixing_rates(measured, model)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"), secrets.train(spark), path_col="source")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_filters, op2_substring_dedup, op3_exact_dedup, op4_best_fit_packing, op5_simhash_dedup, op6_token_counts, op7_mixing, op8_quality_classifier, op9_secret_scan, op10_quality_rules, op11_vector_codes, op12_license_scan, pipeline)
    return {f.__name__: f for f in ops}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def vector_codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds by comparing every part with every entry."""
    ctes = ["""q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, * FROM (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        """p AS MATERIALIZED (SELECT r, part, x, list_dot_product(x, x) AS norm FROM (
            SELECT r, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)]::DOUBLE[] AS x FROM q, range(4) AS s(part)))""",
        "b0 AS (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 256)"]
    for i in range(rounds + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (SELECT r, part, any_value(x) AS x, min((norm + list_dot_product(c, c) - 2 * list_dot_product(x, c))::BIGINT * 256 + entry) AS best
            FROM p JOIN b{i} USING (part) GROUP BY r, part)"""
        )
        if i < rounds:
            ctes.append(
                f"""b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN (
            SELECT part, entry, list(floor(s / n)::DOUBLE ORDER BY i) AS c FROM (
                SELECT part, best % 256 AS entry, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{i}) GROUP BY ALL)
            GROUP BY part, entry) m USING (part, entry))"""
            )
    last = rounds
    ctes.append(f"z AS (SELECT r, string_agg(lpad(to_hex(best % 256), 2, '0'), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a{last} GROUP BY r)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})")
    return f"""WITH {", ".join(ctes)}
        SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
        FROM z JOIN q USING (r), h"""


ORACLE = {
    "op11_vector_codes": vector_codes_sql(),
    "op12_license_scan": licences.oracle(),
    "op3_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY low ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(low) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS low FROM documents)
        WINDOW g AS (PARTITION BY low)""",
}


def oracle_sql() -> dict[str, str]:
    out = dict(ORACLE)
    import corpus_pipeline

    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out

"""The training-data operators as queries over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from splatframe.llm import bpe, decontaminate, licenses, linededup, neardup, quality, secrets, sharding, toxicity, urls
from splatframe.llm.common import fresh_dir, table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.train(urls.seed_urls()))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), ids=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.judge(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.ShardStore(spark, fresh_dir(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum()
    return sharding.digest(store.read())


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents"))).drop("spans")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), model)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(
        decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_quality_rules": op2_quality_rules,
    "op3_bpe": op3_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_sharding": op7_sharding,
    "op8_license_scans": op8_license_scans,
    "op9_secret_scans": op9_secret_scans,
    "op10_decontamination": op10_decontamination,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE: dict[str, str] = {
    "op7_sharding": """
        SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256,
               CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes
        FROM documents
    """,
    "op10_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        windows AS (
            SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS t
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
        ),
        places AS (
            SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS t
            FROM (
                SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
            )
        ),
        met AS (SELECT r, i, places.n, item FROM places JOIN windows USING (n, t)),
        hit AS (
            SELECT r, count(DISTINCT k) AS n_hit
            FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM met)) GROUP BY r
        ),
        names AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT r, item FROM met) GROUP BY r
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN names USING (r)
    """,
}

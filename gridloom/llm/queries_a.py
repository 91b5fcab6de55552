"""Thin queries of the document operators, part one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.mixing import mix
from gridloom.llm.packing import pack
from gridloom.llm.quality import quality
from gridloom.llm.rlz import substring_dedup
from gridloom.llm.setsketch import near_duplicates
from gridloom.llm.sharding import histogram_shards


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=3, percent=85).drop("print")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality(documents(spark, sf_dir)).select("doc_id", "measures.*", F.col("quality").alias("quality_probability"), "kept")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("kept")).alias("kept"), "quality_probability"
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), window=50, texts=False).drop("spans")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(documents(spark, sf_dir), shards=24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    each = mixed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), window=2048, end_id=1)


QUERIES = {"op1_quality_rules": op1, "op3_histogram_shards": op3, "op4_pivotal_mixing": op4, "op9_slack_packing": op9, "op2_rlz_substring_dedup": op2, "op10_setsketch_near_dedup": op10}
ORACLES: dict[str, str] = {
    "op2_rlz_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
m AS (SELECT h, min(doc_id) AS lowest FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, list(i) AS starts FROM g JOIN m USING (h) WHERE lowest < doc_id GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT doc_id, unnest(starts) AS i FROM s)),
r AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [ws[j] FOR j IN range(1, len(ws) + 1) IF NOT list_contains(gone, j)] END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
""",
}

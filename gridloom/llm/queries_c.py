"""Thin queries of the operators on benchmarks and vectors, part three."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.decontamination import contamination
from gridloom.llm.negatives import hard_negatives
from gridloom.llm.queries_a import documents
from gridloom.llm.whitening import whiten


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``embeddings`` whose vectors are there and hold finite numbers only, those as doubles in ``c``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("embedding").isNotNull() & finite).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("c"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _numbers(spark, sf_dir).select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("c", lambda c: F.floor(256 * c)).alias("x"))
    return hard_negatives(rows, rows.where("id % 100 = 0"), positives=5, negatives=5, low=(80, 100))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir).select(F.col("vec_id").alias("id"), F.transform("c", lambda c: F.floor(64 * c) + 1000000).alias("x"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "one")
    white = whiten(rows, components=16).select("id", "n", "deviation", "identity_error", each)
    component, deviation = (F.col("k") + 1).alias("component"), F.col("deviation").try_cast("long").alias("deviation")
    return white.select(F.col("id").alias("vec_id"), component, "n", deviation, F.col("one.whitened").alias("whitened"), F.col("one.explained").alias("explained"), "identity_error")


QUERIES = {"op11_prefix_decontamination": op11, "op12_secondary_sort_negatives": op12, "op13_bit_sliced_whitening": op13}
ORACLES: dict[str, str] = {
    "op11_prefix_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT item_id, m, array_to_string(ws[p:p + m - 1], ' ') AS t FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM (SELECT *, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0))),
l AS (SELECT DISTINCT m FROM w),
g AS (SELECT doc_id, m, p, array_to_string(ws[p:p + m - 1], ' ') AS t FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, l WHERE len(ws) >= m)),
h AS (SELECT doc_id, p, m, item_id FROM g JOIN w USING (m, t)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, list(DISTINCT item_id::VARCHAR ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
""",
    "op12_secondary_sort_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.x) = len(r.x)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 80 * p.score AND 100 * p.score
QUALIFY rank <= 5
""",
}

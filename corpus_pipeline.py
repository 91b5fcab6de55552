"""A corpus from documents: quality rules, near-duplicates, repeated passages, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.mixing import mix
from gridloom.llm.packing import pack
from gridloom.llm.quality import keep_good
from gridloom.llm.rlz import without_duplicates
from gridloom.llm.setsketch import near_duplicates
from gridloom.llm.store import saved

#: SQL cannot express the label model, the sketches, the draws or the tokens; tests compare each stage with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model holds good; the others go."""
    return keep_good(docs)


def _keyed(docs: DataFrame) -> DataFrame:
    """``row, doc_id, print, source``: documents as one struct, whatever their columns, with what names a text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.col("source").cast("string").alias("source"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), the one with the smallest doc_id, and all without a doc_id.

    Texts that share a doc_id are judged each by itself. Of rows with one doc_id and one text one stays: the one whose columns
    have the least hash.
    """
    stay = near_duplicates(docs, k=5, percent=80).where("kept AND doc_id IS NOT NULL").select("doc_id", "print").distinct()
    rows = _keyed(docs)
    order = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    named = rows.where("doc_id IS NOT NULL").join(stay, ["doc_id", "print"], "left_semi").groupBy("doc_id", "print").agg(F.min_by("row", order).alias("row"))
    return named.select("row").unionByName(rows.where("doc_id IS NULL").select("row")).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a document with a smaller doc_id has too; n_chars follows the text."""
    left = without_duplicates(docs, window=50)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of sources takes."""
    plan = mix(docs).where("copies > 0").select(F.struct("doc_id", "print", "source").alias("key"), "copies")
    taken = _keyed(docs).select("row", F.struct("doc_id", "print", "source").alias("key")).join(plan, "key")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048."""
    return pack(docs, window=2048, end_id=1)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages documents are written as Parquet in the shared folder and read again."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = saved(out, f"stage-{name}")
    return out

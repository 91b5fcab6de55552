"""Thin queries of the other operators, part two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.lattice import score
from gridloom.llm.pq import near_vectors
from gridloom.llm.queries_a import documents
from gridloom.llm.tools import Argument, link_calls
from gridloom.llm.toxicity import toxicity


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.93)


SCHEMAS = {"reply": (Argument("query", "string", least=1, most=1500), Argument("words", "integer", least=2, most=150))}


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as tool calls: a user's turn calls the tool ``reply`` and may depend on the user's turn of half its number, an
    assistant's turn is the result of the turn before it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")

    def name(turn):
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))

    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    arguments = F.create_map(F.lit("query"), F.col("text"), F.lit("words"), words.cast("string"))
    calls = turns.where("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(F.col("turn") > 0, name(F.floor(F.col("turn") / 2))).alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return link_calls(calls, results, SCHEMAS)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity(documents(spark, sf_dir), labels, ("low_quality", "toxic"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


QUERIES = {"op5_pq_near_vectors": op5, "op6_tool_call_linking": op6, "op7_toxicity_chain": op7, "op8_lattice_scores": op8}
ORACLES: dict[str, str] = {
    "op6_tool_call_linking": r"""
WITH RECURSIVE calls AS (
  SELECT DISTINCT conv_id, turn, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         CASE WHEN turn > 0 THEN conv_id::VARCHAR || ':' || (turn // 2)::VARCHAR END AS depends_on
  FROM conversations WHERE role = 'user'),
firsts AS (SELECT call_id, min(struct_pack(turn := turn, text := text)) AS f FROM calls GROUP BY call_id),
answers AS (SELECT conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS call_id, min(struct_pack(turn := turn, text := text)) AS a FROM conversations WHERE role = 'assistant' GROUP BY 1),
walk AS (
  SELECT call_id, depends_on, 0 AS level FROM calls
  UNION ALL
  SELECT w.call_id, c.depends_on, level + 1 FROM walk w JOIN calls c ON c.call_id = w.depends_on WHERE level < 64),
ordered AS (SELECT call_id, max(level)::INTEGER AS level FROM walk GROUP BY call_id),
checked AS (
  SELECT *, concat_ws('; ', CASE WHEN text IS NULL THEN 'query: missing' WHEN length(text) < 1 THEN 'query: too small' WHEN length(text) > 1500 THEN 'query: too large' END,
                            CASE WHEN words IS NULL THEN 'words: missing' WHEN words < 2 THEN 'words: too small' WHEN words > 150 THEN 'words: too large' END) AS problems
  FROM calls JOIN firsts USING (call_id) LEFT JOIN answers USING (call_id) JOIN ordered USING (call_id))
SELECT conv_id, turn, call_id, 'reply' AS name, level,
       CASE WHEN f.text IS DISTINCT FROM text OR f.turn <> turn THEN 'duplicate' WHEN a IS NULL THEN 'unanswered' ELSE 'answered' END AS status, problems,
       '{"arguments":{"query":' || to_json(text)::VARCHAR || ',"words":' || words || '},"id":"' || call_id || '","name":"reply"' || CASE WHEN a IS NOT NULL THEN ',"result":' || to_json(a.text)::VARCHAR ELSE '' END || '}' AS json
FROM checked
UNION ALL
SELECT conv_id, turn, conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR, NULL, NULL, 'orphan', '', '{"id":"' || conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR || '","result":' || to_json(text)::VARCHAR || '}'
FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'assistant') r
WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.call_id = r.conv_id::VARCHAR || ':' || (r.turn - 1)::VARCHAR)
UNION ALL
SELECT conv_id, turn, a.call_id, NULL, NULL, 'extra', '', '{"id":"' || a.call_id || '","result":' || to_json(text)::VARCHAR || '}'
FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'assistant') r JOIN answers a ON a.call_id = r.conv_id::VARCHAR || ':' || (r.turn - 1)::VARCHAR
WHERE EXISTS (SELECT 1 FROM calls c WHERE c.call_id = a.call_id) AND text IS DISTINCT FROM a.a.text
""",
}

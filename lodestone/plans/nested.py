"""Queries on scored documents, bundles and nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scorers
from lodestone.operators import bundles
from lodestone.plans.registry import Registry
from lodestone.tables import table

R = Registry()
_PROXY = "CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0 THEN 5.0 * length(regexp_replace(text, '[^\\p{Ll}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) ELSE 0 END"


@R.query(f"SELECT md5(text) AS h, length(text)::INTEGER AS length, round(s, 6) AS score, round_even(greatest(0.0, least(s, 5.0)), 0)::INTEGER AS int_score FROM (SELECT text, {_PROXY} AS s FROM documents) WHERE round_even(greatest(0.0, least(s, 5.0)), 0) >= 3")
def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bundles.scored_documents(table(spark, sf_dir, "documents"), scorers.proxy_quality(F.col("text")), 3)
    return out.select(F.md5(F.col("text").cast("binary")).alias("h"), "length", F.round("score", 6).alias("score"), "int_score")


@R.query("SELECT doc_id, (length(text) % 7)::DOUBLE AS score FROM documents")
def batch_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model, loaded once a task."""
    load = lambda: lambda texts: [float(len(t) % 7) for t in texts]
    return table(spark, sf_dir, "documents").select("doc_id", scorers.scored(F.col("text"), load).alias("score"))


@R.query("SELECT conv_id::VARCHAR AS repo_name, md5(string_agg(text || '<|endoftext|>', '' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id")
def repo_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("repo_name"), F.col("turn").alias("path"), "text")
    return bundles.bundles(files).select("repo_name", F.md5(F.col("text").cast("binary")).alias("h"))


@R.query("""WITH f AS (SELECT conv_id, turn, text, round_even(least((length(text) % 60) / 10.0, 5.0), 0) AS s FROM conversations)
SELECT conv_id, md5(string_agg(text || '<|endoftext|>', '' ORDER BY turn)) AS h, count(*)::INTEGER AS n FROM f WHERE s > 2 GROUP BY conv_id""")
def filtered_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("path"), "text")
    whole = bundles.bundles(files, "conv_id")
    kept = bundles.filtered_bundle(F.col("text"), F.transform(bundles.bundle_files(F.col("text")), lambda p: (F.length(p) % 60) / F.lit(10.0)))
    return whole.select("conv_id", kept.alias("k")).where(F.size("k.results") > 0).select("conv_id", F.md5(F.col("k.text").cast("binary")).alias("h"), F.size("k.results").alias("n"))


@R.query("SELECT doc_id, source, lang FROM documents")
def lifted_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.struct("doc_id", "source", "lang").alias("train"))
    return bundles.lifted(d, "train")


@R.query('SELECT doc_id, source AS "meta.source", lang AS "meta.inner.lang" FROM documents')
def flattened_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct("source", F.struct("lang").alias("inner")).alias("meta"))
    return bundles.flattened(d)


@R.query("SELECT l_linenumber AS token, count(*) AS n, sum(l_linenumber + 1)::BIGINT AS n_bytes FROM lineitem GROUP BY 1")
def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = spark.createDataFrame([(i, bytearray(b"x" * (i + 1))) for i in range(1, 8)], "id int, bytes binary")
    stream = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("token"))
    return bundles.byte_lengths(stream, vocabulary).groupBy("token").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


@R.query("SELECT p_partkey, p_name FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')")
def chosen_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "label")
    known = [r["label"] for r in tasks.where(F.col("label").isin("Brand#11", "Brand#12")).select("label").distinct().collect()]
    return bundles.chosen_tasks(tasks, known).select("p_partkey", "p_name")


@R.query("SELECT item_id, md5('<|bos|>' || text) AS plain, md5('<|bos|><|user_start|>' || text || '<|user_end|><|assistant_start|>') AS chat FROM benchmark")
def simple_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "benchmark").select("item_id", h(bundles.simple_prompt(F.col("text"), False)).alias("plain"), h(bundles.simple_prompt(F.col("text"), True)).alias("chat"))


@R.query("SELECT o_orderkey, 'it/''s/-/|/-1/234 ' || n[1:3] || '/' || n[4:6] AS parts FROM (SELECT o_orderkey, (100000 + o_orderkey % 100000)::VARCHAR AS n FROM orders)")
def phrase_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("it's-|-1234 "), (100000 + F.col("o_orderkey") % 100000).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(bundles.phrase_parts(t), "/").alias("parts"))

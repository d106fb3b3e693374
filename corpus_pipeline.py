"""The corpus pipeline: quality filter, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written as Parquet and read again, so a stage that reads its input several times doesn't repeat the
stages before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_dedup as lines
from lodestone.llm import minhash, mixing, packing, quality_knn
from lodestone.llm.common import cut, if_small, remove_table, shared_table
from lodestone.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote takes for good ones (score 0.3 or more).

    A text without words, null or empty ones included, scores the labelled share and stays while that is so high.
    Repeated rows score alike. Without labels all score 0.5 and stay. An empty table stays empty; columns other than
    those of documents go.
    """
    model = quality_knn.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_knn.quality_scores(docs.select(*COLUMNS), model, keep=True)
    return scored.where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines, of whatever length, that an earlier line of the corpus equals or nearly equals; n_chars follows the text. Empty lines stay."""
    out = lines.line_dedup(docs.select(*COLUMNS), min_chars=1)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 80 % of five-word shingles: that with the least (id, hash of the text), null ids last.

    Null, empty and wordless texts are linked with nothing and stay. Rows with one id and different texts are documents of
    their own; of rows that repeat an id and its text one stays. An empty table stays empty.
    """
    found = cut(minhash.near_dedup(docs, with_first=True).select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "first"))
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (minhash.text_hash("text") == F.col("f_hash"))
    left = docs.select(*COLUMNS).join(if_small(cut(found.where("not first").select("f_id", "f_hash").distinct()), 16), same, "left_anti")
    again = cut(found.where("first").groupBy("f_id", "f_hash").agg(F.count("*").alias("n")).where("n > 1").select("f_id", "f_hash"))
    if again.isEmpty():
        return left
    again = if_small(again, 16)
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mixture's rates say; some not at all.

    Tokens are those that `pack` counts. Null and empty texts have one token and the posteriors of the bias. Repeated
    rows are rounded each for itself. Without labels all rates are alike. An empty table stays empty.
    """
    model = mixing.train(docs, table(spark, sf_dir, "labels"))
    return mixing.mixed(docs.select(*COLUMNS), model, tokenizer_path=public_tokenizers.path(TOKENIZER))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids. Null and empty texts are the end mark alone; repeated rows are packed once each; an empty table gives no piece."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]
#: Stages 1, 4 and 5 can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from documents. Tables between stages go when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove_table(before)
        before = docs
    return docs

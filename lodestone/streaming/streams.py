"""Structured Streaming: corpora that arrive file by file."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.text import pretokens
from lodestone.operators.selection import indexed
from lodestone.operators.tokens import pretoken_counts
from lodestone.session import materialised


def document_stream(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 16) -> DataFrame:
    """Rows of the Parquet files that come into a folder, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def table_stream(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """The rows of a Parquet table, a folder or one file, as a stream."""
    table = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    one_file = all(f.endswith(f"/{name}") for f in table.inputFiles())
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_at_once)
    return reader.option("pathGlobFilter", name).parquet(folder) if one_file else reader.parquet(path)


def pretoken_stream(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos and pretoken of each document, as it arrives; no state."""
    return docs.select(key, F.posexplode(pretokens(F.col(text))).alias("pos", "pretoken"))


def running_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """pretoken and cnt so far; for the complete and update modes. State is a row for each distinct piece."""
    return docs.select(F.explode(pretokens(F.col(text))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("cnt"))


def write_table(rows: DataFrame, path: str, checkpoint: str, all_now: bool = True) -> StreamingQuery:
    """Appends a stream's rows to a table of Parquet files. Its log says which files count, so a query that stopped half-way and is started again on the checkpoint leaves no row out and none twice.

    `all_now`: the query ends when what is there now is read; else it goes on until it is stopped.
    """
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if all_now else writer).start()


def stopped_after_a_batch(query: StreamingQuery, most_seconds: float = 300) -> None:
    """Stops a query once it has committed a batch, wherever it is then."""
    end = time.time() + most_seconds
    while query.isActive and time.time() < end and not any(p["numInputRows"] for p in query.recentProgress):
        time.sleep(0.05)
    query.stop()


def write_counts(docs: DataFrame, path: str, checkpoint: str, text: str = "text", all_now: bool = True) -> StreamingQuery:
    """The histogram of pre-tokens of each batch, in a folder of its own that a repeated batch replaces; `counts_so_far` adds them up. No state is kept and nothing passes the driver."""

    def sink(batch: DataFrame, number: int) -> None:
        pretoken_counts(batch, text).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if all_now else writer).start()


def counts_so_far(spark: SparkSession, path: str) -> DataFrame:
    """pretoken and cnt over all batches that `write_counts` has written."""
    return spark.read.schema("pretoken string, cnt long").parquet(path).groupBy("pretoken").agg(F.sum("cnt").alias("cnt"))


def write_shards(docs: DataFrame, path: str, checkpoint: str, rows: int, order: list[str]) -> StreamingQuery:
    """Shards <path>/shards/batch=<b>/shard=<k>/... of exactly `rows` rows, in the order within what each batch has. Rows that don't fill a shard wait in <path>/open for the next batch; `close_shards` writes the last.

    Each batch leaves its own state, the rows that wait and the next shard's number, and begins with that of the batch before it, so a batch that
    is repeated after a failure writes the same again.
    """

    def sink(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, path, rows, order)

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def _state(spark: SparkSession, path: str, number: int) -> tuple[int, int]:
    """The next shard's number and how many rows wait after a batch."""
    if number < 0:
        return 0, 0
    return tuple(spark.read.schema("next long, waiting long").parquet(f"{path}/state/batch={number}").first())


def write_batch(batch: DataFrame, number: int, path: str, rows: int, order: list[str]) -> None:
    """One batch of `write_shards`."""
    spark = batch.sparkSession
    first, waiting = _state(spark, path, number - 1)
    placed = indexed(batch, order, "__place").withColumn("__place", F.col("__place") + waiting)
    if waiting:
        placed = placed.unionByName(spark.read.schema(placed.schema).parquet(f"{path}/open/batch={number - 1}"))
    placed = materialised(placed)
    full = placed.count() // rows
    dealt = placed.withColumn("shard", F.floor(F.col("__place") / rows) + first)
    ready = dealt.where(F.col("shard") < first + full).repartition("shard").sortWithinPartitions("shard", "__place").drop("__place")
    ready.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{path}/shards/batch={number}")
    left = placed.where(F.col("__place") >= full * rows).withColumn("__place", F.col("__place") - full * rows)
    left.write.mode("overwrite").parquet(f"{path}/open/batch={number}")
    spark.createDataFrame([(first + full, left.count())], "next long, waiting long").coalesce(1).write.mode("overwrite").parquet(f"{path}/state/batch={number}")


def close_shards(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Writes the rows that wait as the last, short shard. Called again it writes the same."""
    done = spark.read.parquet(f"{path}/state").agg(F.max("batch")).first()[0]
    number, waiting = _state(spark, path, done)
    if waiting:
        left = spark.read.schema(schema.add("__place", "long") if "__place" not in schema.names else schema).parquet(f"{path}/open/batch={done}")
        left.repartition(1).sortWithinPartitions("__place").drop("__place").withColumn("shard", F.lit(number)).write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{path}/shards/batch={done + 1}")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all shards, with batch and shard."""
    return spark.read.option("basePath", f"{path}/shards").parquet(f"{path}/shards/*/*")


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of events by window and type, for events at most `late` behind."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def write_windows(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All windows of `event_windows` so far after each batch, in a folder of its own that a repeated batch replaces; `windows_so_far` reads the last. Nothing passes the driver."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return event_windows(events).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def windows_so_far(spark: SparkSession, path: str) -> DataFrame:
    """window_start, event_type, n and total after the last batch that `write_windows` has written."""
    written = spark.read.schema("window_start timestamp, event_type string, n long, total double, batch long").parquet(path)
    return written.where(F.col("batch") == written.agg(F.max("batch")).scalar()).drop("batch")

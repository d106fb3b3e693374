"""Sinks."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.selection import indexed
from lodestone.sources.ranges import output, put


def resumed(df: DataFrame, done: DataFrame, key: str = "source_path") -> DataFrame:
    """Rows whose source isn't among those written already; how the finished ones are joined is left to the planner."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def write_by_source(df: DataFrame, path: str, key: str = "source_path") -> None:
    """A partition for each source; writing one again replaces it and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_shards(df: DataFrame, path: str, rows: int) -> None:
    """Zstandard Parquet files of at most `rows` rows; each task's last may be short. `write_full_shards` has only one short one."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def write_full_shards(df: DataFrame, path: str, rows: int, order: list[str]) -> None:
    """Zstandard Parquet files <path>/shard=<k>/..., each of exactly `rows` rows in the order (which should leave no ties), but for the last; a file a shard, by as many tasks as there are shards.

    A row's shard is told from its place, in two levels, so that no task has all rows.
    """
    placed = indexed(df, order, "__place").withColumn("shard", F.floor(F.col("__place") / rows))
    dealt = placed.repartition("shard").sortWithinPartitions("shard", "__place").drop("__place")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)


def write_tokens(df: DataFrame, path: str, key: str = "doc_id") -> None:
    """A ragged token store: key, tokens, n_tokens."""
    df.select(key, "tokens", F.size("tokens").alias("n_tokens")).write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_files(df: DataFrame, path: str) -> None:
    """A text file <path>/<folder>/<name> for each row (folder, name, content), by the tasks that have them; an attempt that is repeated writes the same again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for part in parts:
            for folder, name, content in zip(part["folder"], part["name"], part["content"], strict=True):
                put(f"{path}/{folder}/{name}", content.encode())
            n += len(part)
        yield pd.DataFrame({"n": [n]})

    df.select("folder", "name", "content").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def write_halves(spark: SparkSession, folder: str, path: str) -> None:
    """The first half of each file of a folder, under its name in another, as writers leave behind that stop half-way; a file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                put(f"{path}/{name}", head)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    files.select(F.element_at(F.split("path", "/"), -1), F.expr("substring(content, 1, length(content) div 2)")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_archives(df: DataFrame, path: str, key: str) -> None:
    """<path>/<key>.tar.gz for each value of the key, with its rows' files (root, path, content in bytes) in the order of their paths, packed row by row as they come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, tar, n = None, None, None, 0

        def add(name: str, content: bytes | None) -> None:
            entry = tarfile.TarInfo(name)
            if content is None:
                entry.type = tarfile.DIRTYPE
            else:
                entry.size = len(content)
            tar.addfile(entry, None if content is None else io.BytesIO(content))

        def close() -> None:
            if tar is not None:
                tar.close()
                out.close()

        for batch in batches:
            for name, root, below, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tar is None or name != now:
                    close()
                    now, out, n = name, output(f"{path}/{name}.tar.gz"), n + 1
                    tar = tarfile.open(fileobj=out, mode="w|gz")
                    add(root, None)
                add(f"{root}/{below}", content)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = df.select(F.col(key).cast("string").alias("key"), "root", "path", "content").repartition("key").sortWithinPartitions("key", "root", "path")
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def report(scores: DataFrame) -> DataFrame:
    """value: a fixed-width line for each task (task, accuracy, centred)."""
    return scores.select(F.format_string("%-35s, %-10s, %-10s", "task", F.format_string("%.6f", "accuracy"), F.format_string("%.6f", "centred")).alias("value"))


def result_document(results: DataFrame, task: str = "task") -> DataFrame:
    """value: one JSON object {results: {task: the row's other fields}, tasks: how many}."""
    fields = F.struct(*[c for c in results.columns if c != task])
    pairs = F.array_sort(F.collect_list(F.struct(F.col(task).alias("key"), fields.alias("value"))))
    return results.agg(F.to_json(F.struct(F.map_from_entries(pairs).alias("results"), F.count("*").alias("tasks"))).alias("value"))


def append_batch(df: DataFrame, path: str, number: int) -> None:
    """Part `number` of a growing table; writing one again replaces it, so a run that stopped goes on where it was."""
    df.write.mode("overwrite").parquet(f"{path}/part={number}")


def as_json(df: DataFrame) -> DataFrame:
    """value: each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))

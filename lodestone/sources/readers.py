"""Sources. Every reader takes paths that Spark can read and gives a lazy DataFrame with an explicit schema where one is known."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import END_OF_TEXT, repaired_utf8
from lodestone.operators.tokens import running_start
from lodestone.session import ship
from lodestone.sources.ranges import BATCH_BYTES, opened

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
SFT_ROW = T.StructType([
    T.StructField("index", T.LongType()), T.StructField("input", T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))])),
    T.StructField("output", T.StringType()), T.StructField("generated_outputs", T.ArrayType(T.StringType())),
    T.StructField("reward", T.ArrayType(T.DoubleType())), T.StructField("safety_class", T.ArrayType(T.StringType())),
    T.StructField("loss", T.DoubleType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def _names(spark: SparkSession, folder: str, pattern: str, deep: bool) -> list[str]:
    """Names of the files below a folder that match; by Spark's own listing, which only reads names."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if deep:
        reader = reader.option("recursiveFileLookup", "true")
    return sorted(r["path"] for r in reader.load(folder).select("path").collect())  # names only


def discover(spark: SparkSession, folder: str) -> tuple[str, list[str]]:
    """('parquet', files) of all Parquet files below the folder if there are any, else ('jsonl', its own *.jsonl.gz files)."""
    found = _names(spark, folder, "*.parquet", True)
    return ("parquet", found) if found else ("jsonl", _names(spark, folder, "*.jsonl.gz", False))


def documents(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """Documents of a folder with source_path, where each row came from. Corrupt compressed files are passed over, one by one; `ranges.json_lines` tells which."""
    kind, files = discover(spark, folder)
    if not files:
        raise FileNotFoundError(f"neither Parquet nor compressed JSON lines in {folder}")
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(*files) if kind == "parquet" else reader.option("ignoreCorruptFiles", "true").json(files)
    return rows.withColumn("source_path", F.input_file_name())


def delimited_text(spark: SparkSession, path: str, mark: str = END_OF_TEXT) -> DataFrame:
    """text of each document of files whose documents end with a marker. Files are split at markers, so none is cut or lost; empty ones are left out."""
    return spark.read.option("lineSep", mark).text(path).select(F.col("value").alias("text")).where(F.length("text") > 0)


def raw_text(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """path and text of whole files; invalid UTF-8 is replaced, or dropped."""
    return spark.read.format("binaryFile").load(path).select("path", repaired_utf8(F.col("content"), drop_invalid).alias("text"))


def sft_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines of conversations; missing fields are null, blank lines are passed over."""
    return spark.read.schema(SFT_ROW).json(path)


def csv_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table with a header; quoted fields may hold newlines."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def solutions(spark: SparkSession, path: str) -> DataFrame:
    """task_id (the folder's name; `evaluation.matched_samples` finds the problem it means), solution and identifier of the files <task_id>/*.py of a folder.

    The driver lists the folder alone; each folder in it is listed and read by a task, through Arrow's file systems as in `ranges`.
    """
    fs, at = opened(path)
    below = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.Directory and not f.base_name.startswith(("_", "."))]
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(path)
        for batch in batches:
            for folder, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, contents, held = [], [], 0
                for f in fs.get_file_info(pafs.FileSelector(folder, recursive=deep)):
                    inner = f.path.removeprefix(at).strip("/").split("/")
                    if f.type != pafs.FileType.File or not f.base_name.endswith(".py") or any(p.startswith(("_", ".")) for p in inner):
                        continue
                    with fs.open_input_file(f.path) as opened_file:
                        contents.append(opened_file.read())
                    names.append(f.path)
                    held += len(contents[-1])
                    if held >= BATCH_BYTES or len(names) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                        names, contents, held = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    folders = spark.createDataFrame([(at, False), *((f, True) for f in below)], "folder string, deep boolean").repartition(1 + len(below))
    rows = folders.mapInArrow(run, "path string, content binary")
    folder = F.element_at(F.split("path", "/"), -2)
    return rows.select(folder.alias("task_id"), F.col("content").cast("string").alias("solution"), F.concat_ws("/", folder, F.element_at(F.split("path", "/"), -1)).alias("identifier"))


def solutions_file(spark: SparkSession, path: str) -> DataFrame:
    """The records of files of JSON lines with identifier, the file's name and the record's place in it from 0; an error for one without completion and solution. Blank lines have no place."""
    schema = "task_id string, completion string, solution string"
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    rows = spark.read.text(path).select("value", *at).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), "path", "block", "at", F.lit(1).alias("one"))
    placed = running_start(rows, ["block", "at"], "one", "i", ["path"])
    checked = F.when(F.col("r.completion").isNull() & F.col("r.solution").isNull(), F.raise_error(F.lit("a record has neither completion nor solution")).cast("string")).otherwise(F.col("r.task_id"))
    identifier = F.concat_ws(":", F.element_at(F.split("path", "/"), -1), F.col("i").cast("string"))
    return placed.select(checked.alias("task_id"), "r.completion", "r.solution", identifier.alias("identifier"))


def yaml_list(spark: SparkSession, path: str, key: str) -> list[dict]:
    """The list under a key of a YAML document, such as the tasks of an evaluation; a configuration, so it is read by the driver."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    found = (yaml.safe_load(text["value"]) or {}).get(key) if text else None
    if not isinstance(found, list):
        raise ValueError(f"{path} has no list {key}")
    return found


def evaluation_bundle(spark: SparkSession, config: str, data: str, baselines: str) -> tuple[DataFrame, DataFrame]:
    """Items (label, task_type, num_fewshot, item as JSON) of all tasks that a YAML list names, each from its own file of JSON lines, and the baselines (task, baseline) of a table in CSV."""
    tasks = yaml_list(spark, config, "icl_tasks")
    rows = None
    for t in tasks:
        one = spark.read.text(f"{data}/{t['dataset_uri']}").where(F.trim("value") != "")
        one = one.select(F.lit(t["label"]).alias("label"), F.lit(t["icl_task_type"]).alias("task_type"), F.lit(int(t["num_fewshot"][0])).alias("num_fewshot"), F.col("value").alias("item"))
        rows = one if rows is None else rows.unionByName(one)
    table = csv_rows(spark, baselines).select(F.col("Eval Task").alias("task"), F.col("Random baseline").cast("double").alias("baseline"))
    return rows, table


def split(spark: SparkSession, folder: str, name: str, part: str) -> DataFrame:
    """One split of a local data set: <folder>/<name>/<part>, Parquet or JSON lines; an error names the splits that are there."""
    below = f"{folder}/{name}"
    found = sorted({f.rpartition("/")[0].rpartition("/")[2] for f in _names(spark, below, "*", True) if not f.rpartition("/")[2].startswith(("_", "."))})
    if part not in found:
        raise ValueError(f"{name} has no split {part}; it has {', '.join(found)}")
    kind, files = discover(spark, f"{below}/{part}")
    return spark.read.parquet(*files) if kind == "parquet" else spark.read.json(f"{below}/{part}")


def data_mix(spark: SparkSession, path: str) -> DataFrame:
    """path and budget of a JSON object {path: tokens}."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("path", "budget"))


def python_literal(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with a column of Python literals parsed; literals only, nothing is run. What doesn't parse is null."""
    import ast
    import json

    def parse(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                return None if v is None else json.dumps(ast.literal_eval(v))
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None

        return values.map(one)

    return df.withColumn(column, F.from_json(F.pandas_udf(parse, "string")(F.col(column)), schema))

"""Making this library importable where Python runs for Spark, and tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


#: Bytes that go to Python in one Arrow batch, where the session has Spark's own default: sets and blocks of texts make rows of megabytes.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark application; their Python may not have its folder. Bounds Arrow batches of the session."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:  # asked with a value for want of one, it gives that and not Spark's default
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir. Where none is set, a session in one process, as in tests, gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))


def materialised(df: DataFrame) -> DataFrame:
    """`df` as it is now, in the shared checkpoint folder: its rows and their partitions stay what they are, whatever reads them, and lost executors don't matter."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: The most bytes that are broadcast on purpose.
BROADCAST_BYTES = 32 << 20


def if_small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its counted rows, at `row_bytes` each, stay under `most`; else as it is, to be joined by shuffle. `df` should be cheap to count."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def dealt(df: DataFrame) -> DataFrame:
    """`df`, its rows dealt anew to all tasks if one partition has more than twice its share of them, as with few large row groups; rows are counted by partition, without reading a column."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    rows = [n for (n,) in df.groupBy(F.spark_partition_id()).count().select("count").toLocalIterator()]
    return df.repartition(max(4 * tasks, len(rows))) if rows and max(rows) * tasks > 2 * sum(rows) else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to a new place in the shared checkpoint folder, and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder or a file, wherever Spark can."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def remove_table(df: DataFrame) -> None:
    """Delete the files of a table that `shared_table` gave."""
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove_path(df.sparkSession, parent)

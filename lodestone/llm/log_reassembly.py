"""Transaction log reassembly: which changes of interleaved transactions last, and what one shared store holds after each epoch.

Two secondary sorts of an RDD. The first is by (stream, place), each partition read backwards by a state machine: what becomes
of a change hangs on the records after it, so backwards nothing waits in memory but the open rollbacks of the
transaction at hand. Partitions are ranges whose bounds are records that end a transaction, so a hot stream is cut between its
transactions and no transaction is. The second is by (key, commit, place), where each change overwrites the one before it;
its ranges are bounded by (key, epoch), so a hot key is cut between epochs, and the only thing that crosses a bound, the
value before it, is one row a partition. Texts don't move: a change carries its place in the log and a number for its value.

Nulls: a null stream is a stream of its own; a null value deletes its key; records without a place are left out. Records of
one place in one stream are taken by op, key and value, null first; repeated records count each. Commits of one place are taken
by stream. An empty log has no rows. Other columns of the tables are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut
from lodestone.operators.selection import in_ranges, indexed

COMMIT, ABORT, SAVEPOINT, ROLLBACK, CHANGE = range(5)
#: Keys sampled for each bound between partitions. Bounds are for balance; no result hangs on them.
SAMPLED = 20
FATES = "fate string, at long, undone_by long, key long, value long, stream string, commit_at long, commit_seq int"
DELTAS = "part int, key long, epoch long, at long, value long, known boolean, before long, first boolean, last boolean"


@dataclass(frozen=True)
class Reassembled:
    """undone: fate (rollback or abort), at, undone_by (null: the log's end) and key of each undone change. deltas: key, epoch, at (the change whose value the key has from then on), value and before, null for no value. states: epoch, n_keys and total (of values) after each."""

    undone: DataFrame
    deltas: DataFrame
    states: DataFrame


def text_log(docs: DataFrame, deleting: DataFrame, keys: int = 300) -> DataFrame:
    """The log that a table (doc_id, text, source) is read as: stream, at, op, key and value, the CRC-32 of `key:text`; null for null texts and ids in `deleting` (doc_id).

    The id's CRC-32 h says what a row is: h mod 23 below 2 a commit, 2 an abort, 3 and 4 a savepoint, 5 and 6 a rollback, else a
    change of the key (h div 100) mod `keys`. Rows without an id are left out; ids that `deleting` repeats count once.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    kind, key = h % 23, F.floor(h / 100) % keys
    op = F.when(kind < 2, COMMIT).when(kind == 2, ABORT).when(kind < 5, SAVEPOINT).when(kind < 7, ROLLBACK).otherwise(CHANGE)
    rows = docs.where("doc_id IS NOT NULL").select(
        F.col("source").cast("string").alias("stream"), F.col("doc_id").cast("long").alias("at"), op.alias("op"), F.when(kind >= 7, key).cast("long").alias("key"),
        F.when(kind >= 7, F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text")).cast("binary"))).alias("value"),
    )
    gone = deleting.select(F.col("doc_id").cast("long").alias("at")).distinct().withColumn("gone", F.lit(True))
    return rows.join(gone.hint("merge"), "at", "left").select("stream", "at", "op", "key", F.when(F.col("gone").isNull(), F.col("value")).alias("value"))


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bounds(rows: DataFrame, columns: list[str], partitions: int) -> list[tuple]:
    """At most partitions - 1 of the rows, by their columns, at about equal distances: quantiles of about SAMPLED rows a partition, chosen by hash."""
    every = max(1, rows.count() // (SAMPLED * partitions))
    found = rows.where(F.pmod(F.xxhash64(*columns, F.lit(5)), F.lit(every)) == 0).select(*columns).limit(4 * SAMPLED * partitions).collect()
    sample = sorted(tuple(r) for r in found)
    return sorted({sample[len(sample) * i // partitions] for i in range(1, partitions)}) if sample else []


def _fates(records: Iterator[tuple]) -> Iterator[tuple]:
    """The state machine, over keys (stream, -place, -op, -key, no value, -value) in ascending order, that is over the streams' records backwards.

    A rollback waits until the savepoint that it goes back to, or the start of the transaction. A change is undone by the rollback
    that began to wait last, which is the first after it in the log, else by the abort that ends the transaction.
    """
    now, end, end_at, waiting, seq = None, ABORT, None, [], 0
    for (stream, before, op, key, none, value), _ in records:
        at, op = -before, -op
        if stream != now:
            now, end, end_at, waiting, seq = stream, ABORT, None, [], 0
        if op in (COMMIT, ABORT):
            seq = seq - 1 if end_at == at else 0  # of ends at one place the last has 0
            end, end_at, waiting = op, at, []
            if op == COMMIT:
                yield "commit", None, None, None, None, stream, at, seq
        elif op == ROLLBACK:
            waiting.append(at)
        elif op == SAVEPOINT:
            if waiting:
                waiting.pop()
        elif waiting or end == ABORT:
            yield "rollback" if waiting else "abort", at, waiting[-1] if waiting else end_at, -key, None, None, None, None
        else:
            yield "change", at, None, -key, None if none else -value, stream, end_at, seq


def fates(log: DataFrame) -> DataFrame:
    """What becomes of each change (it lasts as a `change` of a commit, or a rollback or an abort undoes it) and every commit: the columns of FATES."""
    partitions = _partitions(log.sparkSession)
    named = F.when(F.col("stream").isNull(), "").otherwise(F.concat(F.lit("s"), "stream")).alias("stream")
    log = cut(log.where("at IS NOT NULL").select(named, "at", "op", F.coalesce("key", F.lit(0)).alias("key"), "value"))
    bounds = _bounds(log.where(F.col("op").isin(COMMIT, ABORT)), ["stream", "at"], partitions)
    keyed = log.rdd.map(lambda r: ((r[0], -r[1], -r[2], -r[3], r[4] is None, -(r[4] or 0)), None))
    ordered = keyed.repartitionAndSortWithinPartitions(partitions, lambda k: bisect_left(bounds, (k[0], -k[1])))
    return cut(log.sparkSession.createDataFrame(ordered.mapPartitions(_fates), FATES, verifySchema=False))


def _deltas(part: int, rows: Iterator[tuple], bounds: list[tuple]) -> Iterator[tuple]:
    """The deltas of one partition of keys (key, epoch, commit, place, has a value, value) in order. What was before the first isn't known if its key may stand in the partition before as well."""
    held: list | None = None  # key, epoch, at, value, known, before, first
    for (key, epoch, _, at, there, value), _ in rows:
        value = value if there else None
        if held is not None and held[:2] == [key, epoch]:
            held[2:4] = at, value
            continue
        before = None
        if held is not None:
            yield part, *held, False
            before = held[3] if held[0] == key else None
        held = [key, epoch, at, value, held is not None or part == 0 or bounds[part - 1][0] != key, before, held is None]
    if held is not None:
        yield part, *held, True


def overwrites(changes: DataFrame) -> DataFrame:
    """key, epoch, at, value and before of changes (key, epoch, commit, at, value), where epochs follow the order of commits: the last change of each key in each epoch, by (commit, at), and the value that it overwrites."""
    spark = changes.sparkSession
    partitions = _partitions(spark)
    changes = cut(changes.select("key", "epoch", "commit", "at", "value"))
    bounds = _bounds(changes, ["key", "epoch"], partitions)
    keyed = changes.rdd.map(lambda r: ((r[0], r[1], r[2], r[3], r[4] is not None, r[4] or 0), None))
    ordered = keyed.repartitionAndSortWithinPartitions(partitions, lambda k: bisect_left(bounds, k[:2]))
    found = cut(spark.createDataFrame(ordered.mapPartitionsWithIndex(lambda i, rows: _deltas(i, rows, bounds)), DELTAS, verifySchema=False))
    ends = found.where("last").select("key", F.lead("part").over(Window.orderBy("part")).alias("part"), F.col("value").alias("left"))  # a row a partition
    known = found.join(F.broadcast(ends.withColumn("first", F.lit(True))), ["part", "key", "first"], "left")
    return known.select("key", "epoch", "at", "value", F.when(F.col("known"), F.col("before")).otherwise(F.col("left")).alias("before"))


def _running(epochs: DataFrame, names: list[str]) -> DataFrame:
    """epoch and the sums of the columns up to it, in two levels: within ranges of epochs, plus the sums of the ranges before."""
    ranged = in_ranges(epochs, ["epoch"])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(*[F.sum(c).alias(c) for c in names])
    starts = sums.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in names])  # a row a range
    within = Window.partitionBy("__part").orderBy("epoch")
    summed = ranged.select("__part", "epoch", *[F.sum(c).over(within).alias(c) for c in names])
    return summed.join(F.broadcast(starts), "__part").select("epoch", *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in names])


def reassemble(log: DataFrame, commits_an_epoch: int = 4) -> Reassembled:
    """The transactions of a log (stream, at, op, key, value; ops as numbered here) put together again, and the states of the store that their commits change.

    A transaction of a stream ends with a commit or an abort; the log's end aborts the last. A rollback undoes what its transaction
    has left since its latest savepoint, or its start, and removes the savepoint. Commits are applied by their place, to one store.
    """
    found = fates(log)
    commits = indexed(found.where("fate = 'commit'").select("commit_at", "stream", "commit_seq"), ["commit_at", "stream", "commit_seq"], "commit")
    commits = cut(commits.withColumn("epoch", F.floor(F.col("commit") / commits_an_epoch) + 1))
    changes = found.where("fate = 'change'").join(commits.hint("merge"), ["commit_at", "stream", "commit_seq"])
    deltas = cut(overwrites(changes))
    one = lambda c: F.col(c).isNotNull().cast("long")
    moved = deltas.groupBy("epoch").agg(F.sum(one("value") - one("before")).alias("n_keys"), F.sum(F.coalesce("value", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("total"))
    every = commits.select("epoch", F.lit(0).cast("long").alias("n_keys"), F.lit(0).cast("long").alias("total")).distinct()
    states = _running(every.unionByName(moved).groupBy("epoch").agg(F.sum("n_keys").alias("n_keys"), F.sum("total").alias("total")), ["n_keys", "total"])
    undone = found.where(F.col("fate").isin("rollback", "abort")).select("fate", "at", "undone_by", "key")
    return Reassembled(undone, deltas, states)


def stored_texts(deltas: DataFrame, docs: DataFrame, epoch: int) -> DataFrame:
    """key, doc_id and text of what the store holds after an epoch, from the deltas and the documents of the log. Of rows that repeat an id one that has a text is given."""
    last = deltas.where(F.col("epoch") <= epoch).groupBy("key").agg(F.max_by(F.struct("at", "value"), "epoch").alias("x"))
    last = last.where("x.value IS NOT NULL").select("key", F.col("x.at").alias("doc_id"), F.col("x.value").alias("value"))
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    met = last.join(texts, "doc_id").where(F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("text")).cast("binary")) == F.col("value"))
    return met.groupBy("key", "doc_id").agg(F.first("text").alias("text"))


def events(found: Reassembled) -> DataFrame:
    """kind, id, n and value: a `state` row for each epoch (its number, keys, total), a row for each undone change (its place, what undid it, its key)."""
    states = found.states.select(F.lit("state").alias("kind"), F.col("epoch").cast("long").alias("id"), F.col("n_keys").alias("n"), F.col("total").alias("value"))
    return states.unionByName(found.undone.select(F.col("fate").alias("kind"), F.col("at").alias("id"), F.col("undone_by").alias("n"), F.col("key").alias("value")))

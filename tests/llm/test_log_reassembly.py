"""Transaction logs against a plain machine that holds everything in memory."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import log_reassembly as R
from lodestone.llm import queries
from tests.conftest import SF
from tests.llm.fixtures import frame

OPS = ["commit", "abort", "savepoint", "rollback", "change"]


def plain(records, each=4):
    """records: (stream, at, op, key, value). undone and states, in memory, as the rules say it."""
    undone, commits, streams = [], [], defaultdict(list)
    for stream, at, op, key, value in sorted(records, key=lambda r: (r[1], r[2], r[3] or 0, r[4] is not None, r[4] or 0)):
        streams[stream].append((at, op, key, value))
    for stream, rows in streams.items():
        left, saved = [], []
        for n, (at, op, key, value) in enumerate(rows):
            if op == R.CHANGE:
                left.append((at, key, value))
            elif op == R.SAVEPOINT:
                saved.append(len(left))
            elif op == R.ROLLBACK:
                to = saved.pop() if saved else 0
                undone += [("rollback", a, at, k) for a, k, _ in left[to:]]
                del left[to:]
            else:
                if op == R.ABORT:
                    undone += [("abort", a, at, k) for a, k, _ in left]
                else:
                    commits.append((at, "" if stream is None else f"s{stream}", n, left))
                left, saved = [], []
        undone += [("abort", a, None, k) for a, k, _ in left]
    store, states = {}, []
    commits.sort(key=lambda c: c[:3])
    for i, c in enumerate(commits, 1):
        for _, key, value in c[3]:
            store.pop(key, None)
            if value is not None:
                store[key] = value
        if i % each == 0 or i == len(commits):
            states.append(("state", -(-i // each), len(store), sum(store.values())))
    return sorted([*undone, *states], key=repr)


def of_documents(rows, toxic):
    out = []
    for doc_id, text, source in rows:
        if doc_id is None:
            continue
        h = zlib.crc32(str(doc_id).encode())
        kind = h % 23
        op = R.COMMIT if kind < 2 else R.ABORT if kind == 2 else R.SAVEPOINT if kind < 5 else R.ROLLBACK if kind < 7 else R.CHANGE
        key = h // 100 % 300 if op == R.CHANGE else None
        value = None if op != R.CHANGE or text is None or doc_id in toxic else zlib.crc32(f"{key}:{text}".encode())
        out.append((source, doc_id, op, key, value))
    return out


def got(df):
    return sorted([tuple(r) for r in df.select("kind", "id", "n", "value").collect()], key=repr)


@pytest.mark.parametrize("seed, partitions, n_streams", [(1, 4, 3), (2, 7, 1), (3, 1, 40)])
def test_random_logs(spark, seed, partitions, n_streams):
    rng = random.Random(seed)
    weights = [3, 2, 4, 4, 12]
    records = []
    for at in range(900):
        op = rng.choices(range(5), weights)[0]
        stream = rng.choice([None, *range(n_streams)])
        for _ in range(1 + (rng.random() < 0.05)):  # some records come twice
            records.append((None if stream is None else str(stream), at - 40, op, rng.randrange(6) if op == R.CHANGE else None, rng.choice([None, rng.randrange(100)]) if op == R.CHANGE else None))
    rng.shuffle(records)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        log = spark.createDataFrame(records, "stream string, at long, op int, key long, value long")
        assert got(R.events(R.reassemble(log))) == plain(records)
        assert got(R.events(R.reassemble(log, 7))) == plain(records, 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bounds_end_transactions_and_hot_stream_is_cut(spark):
    log = spark.range(4000).select(F.lit("one").alias("stream"), F.col("id").alias("at"), F.when(F.col("id") % 5 == 4, R.COMMIT).otherwise(R.CHANGE).alias("op"), (F.col("id") % 3).alias("key"), F.col("id").alias("value"))
    bounds = R._bounds(log.where(F.col("op") == R.COMMIT), ["stream", "at"], 4)
    assert len(bounds) == 3 and all(at % 5 == 4 for _, at in bounds)
    assert max(b[1] - a[1] for a, b in zip([("", 0), *bounds], [*bounds, ("", 4000)], strict=True)) < 2000
    found = R.reassemble(log)
    assert found.undone.count() == 0 and found.states.count() == 200
    last = found.states.orderBy(F.desc("epoch")).first()
    assert (last["n_keys"], last["total"]) == (3, 3996 + 3997 + 3998)


def test_log_ends_and_no_commits(spark):
    kinds = "stream string, at long, op int, key long, value long"
    only = [(None, 1, R.ROLLBACK, None, None), (None, 2, R.CHANGE, 5, 6), ("", 3, R.CHANGE, 5, 7), ("", 4, R.ABORT, None, None), ("", 5, R.ABORT, None, None)]
    assert got(R.events(R.reassemble(spark.createDataFrame(only, kinds)))) == [("abort", 2, None, 5), ("abort", 3, 4, 5)]
    assert got(R.events(R.reassemble(spark.createDataFrame([], kinds)))) == []
    commit = [("a", 1, R.COMMIT, None, None)]
    assert got(R.events(R.reassemble(spark.createDataFrame(commit, kinds)))) == [("state", 1, 0, 0)]


def test_query_against_plain_machine(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert got(queries.op12_log_reassembly(spark, SF)) == plain(of_documents(rows, toxic))


def test_odd_rows_and_texts_of_the_store(spark):
    rng = random.Random(8)
    rows = [(None, "no id", "a"), *[(i, rng.choice([None, "", f"text {i}", "x" * 9000, "é" * 70]), rng.choice([None, "a", "b"])) for i in range(700)]]
    rows += rows[10:14]  # repeated rows
    docs = frame(spark, rows).withColumnRenamed("n", "at")  # a name that the operator uses
    toxic = {i for i in range(700) if i % 9 == 0}
    deleting = spark.createDataFrame([(i,) for i in [*toxic, 0, 9]], "doc_id long")
    found = R.reassemble(R.text_log(docs, deleting))
    want = plain(of_documents(rows, toxic))
    assert got(R.events(found)) == want
    epoch, n, total = next((w[1:]) for w in want if w[0] == "state" and w[1] == 5)
    held = R.stored_texts(found.deltas, docs, epoch).collect()
    assert len(held) == n and sum(zlib.crc32(f"{r['key']}:{r['text']}".encode()) for r in held) == total
    assert got(R.events(R.reassemble(R.text_log(docs.limit(0), deleting)))) == []

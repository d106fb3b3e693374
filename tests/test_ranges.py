"""Sources and sinks that read and write by position, and streams that stop and go on."""

from __future__ import annotations

import datetime
import gzip
import io
import json
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.plans import files
from lodestone.sources import ranges, readers, writers
from lodestone.streaming import streams


@pytest.mark.parametrize("range_bytes", [1, 3, 7, 50, 1 << 20])
def test_ranges_cut_and_lose_nothing(spark, tmp_path, range_bytes):
    rng, want = random.Random(2), []
    for name in ("a", "b", "c"):
        docs = ["".join(rng.choice("xy<é\n") for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(12)]
        raw = "<|>".join(docs) + rng.choice(["", "<|>"])
        (tmp_path / name).write_bytes(raw.encode())
        want += [d for d in docs if d]
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"no")
    df = ranges.delimited(spark, str(tmp_path), "<|>", range_bytes)
    rows = df.collect()
    assert sorted(r["text"] for r in rows) == sorted(want)
    for r in rows:
        raw = open(r["file"], "rb").read()
        assert raw[r["start"] :].startswith(r["text"].encode()) and (r["start"] == 0 or raw[: r["start"]].endswith(b"<|>"))
    if range_bytes == 50:
        assert df.rdd.getNumPartitions() > 4


def test_ranges_through_small_blocks_and_marks_that_overlap(spark, tmp_path):
    docs = ["a" * 70, "b", "c" * 200, "|" * 9, "<" * 40]
    (tmp_path / "f").write_text("<|>".join(docs))
    reader = ranges._Delimited({"path": str(tmp_path), "mark": "<|>", "rangebytes": "33", "blockbytes": "4"})
    fs, _ = ranges.opened(str(tmp_path))
    got = [bytes(t.as_py()).decode() for p in reader.partitions() for b in reader.rows(fs, p) for t in b.column(2)]
    assert got == docs
    with pytest.raises(ValueError, match="overlap"):
        ranges.delimited(spark, str(tmp_path), "aba")


def test_byte_range_beyond_the_end(spark, tmp_path):
    (tmp_path / "x").write_bytes("aé".encode())
    assert ranges.byte_range(spark, str(tmp_path), 1, 2).first()["text"] == "�"
    assert ranges.byte_range(spark, str(tmp_path), 1, 99).first()["text"] == "é"
    assert ranges.byte_range(spark, str(tmp_path), 7, 99).first()["text"] == ""


@pytest.mark.parametrize("kind", ["<u2", "<i4", "<i8", ">i4"])
def test_arrays_of_numpy_are_read_by_slices(spark, tmp_path, kind):
    a, b = np.arange(1000).astype(kind), np.arange(5).astype(kind)
    np.save(tmp_path / "0.npy", a)
    np.save(tmp_path / "1.npy", b)
    np.save(tmp_path / "offsets_0.npy", np.array([0, 400, 1000]))
    rows = ranges.token_arrays(spark, str(tmp_path), 7).orderBy("file", "start").collect()
    assert [t for r in rows for t in r["tokens"]] == [*range(1000), *range(5)] and max(len(r["tokens"]) for r in rows) == 7
    assert ranges.offset_arrays(spark, str(tmp_path)).first()["offsets"] == [0, 400, 1000]
    np.save(tmp_path / "2.npy", np.zeros((2, 2)))
    with pytest.raises(Exception, match="one dimension"):
        ranges.token_arrays(spark, str(tmp_path)).collect()


def test_arrays_written_by_tasks_and_left_alone_by_a_failed_job(spark, tmp_path):
    docs = [list(range(i, i + i % 9)) for i in range(60)]
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<int>").coalesce(3)
    to = str(tmp_path / "store")
    ranges.write_token_arrays(df, to, "uint16", file_tokens=50)
    files = sorted(p.name for p in (tmp_path / "store").glob("*.npy"))
    arrays = [f for f in files if not f.startswith("offsets_")]
    assert len(arrays) > 4 and files == sorted([*arrays, *[f"offsets_{f}" for f in arrays]])
    got = []
    for f in arrays:
        tokens, ends = np.load(tmp_path / "store" / f), np.load(tmp_path / "store" / f"offsets_{f}")
        assert tokens.dtype == np.uint16 and ends[0] == 0 and ends[-1] == len(tokens)
        got += [tokens[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == docs
    failing = df.unionByName(spark.sql("SELECT array(1, 70000) AS tokens"))
    with pytest.raises(Exception, match="fit"):
        ranges.write_token_arrays(failing, to, "uint16", file_tokens=50)
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == files
    ranges.write_token_arrays(df.limit(1), to)
    assert [p.name for p in sorted((tmp_path / "store").glob("*.npy"))] == ["000000-000000.npy", "offsets_000000-000000.npy"]


def test_lines_of_a_cut_file_are_told(spark, tmp_path):
    lines = [json.dumps({"doc_id": i, "text": "é" * (i % 50)}) for i in range(3000)]
    (tmp_path / "good.jsonl.gz").write_bytes(gzip.compress("\n".join(lines[:2000]).encode()) + gzip.compress(("\n\n" + "\n".join(lines[2000:]) + "\n").encode()))
    (tmp_path / "cut.jsonl.gz").write_bytes(gzip.compress("\n".join(lines).encode())[:-30])
    (tmp_path / "none.jsonl.gz").write_bytes(b"no gzip")
    (tmp_path / "empty.jsonl.gz").write_bytes(gzip.compress(b""))
    rows, faults = ranges.json_lines(spark, str(tmp_path), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in rows.collect()) == list(range(3000))
    assert {r["source_path"].rpartition("/")[2]: r["error"].split(":")[0] for r in faults.collect()} == {"cut.jsonl.gz": "EOFError", "none.jsonl.gz": "error"}


def test_archives_are_read_once(spark, tmp_path):
    def pack(name, entries):
        with tarfile.open(tmp_path / name, "w:gz") as tar:
            for path, content in entries:
                entry = tarfile.TarInfo(path)
                entry.size = len(content)
                tar.addfile(entry, io.BytesIO(content))

    pack("one.tar.gz", [("r/a.py", b"x"), ("r/deep/b.py", "é".encode()), ("r/image", b"\xff\xfe")])
    pack("two.tar.gz", [])
    assert sorted((r["root"], r["path"], r["text"]) for r in ranges.archives(spark, str(tmp_path)).collect()) == [("r", "a.py", "x"), ("r", "deep/b.py", "é")]


def test_places_of_records_by_file(spark, tmp_path):
    for f in ("f1", "f2"):
        (tmp_path / f).write_text('{"task_id": "a", "completion": "x"}\n\n{"task_id": "b", "solution": "y"}\n')
    rows = readers.solutions_file(spark, str(tmp_path)).collect()
    assert sorted((r["identifier"], r["task_id"]) for r in rows) == [("f1:0", "a"), ("f1:1", "b"), ("f2:0", "a"), ("f2:1", "b")]


def test_full_shards_by_several_tasks(spark, tmp_path):
    df = spark.range(103).select(F.col("id"), F.lit("t").alias("text")).repartition(7)
    writers.write_full_shards(df, str(tmp_path / "s"), 10, ["id"])
    sizes = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").agg(F.count("*").alias("n"), F.min("id").alias("a")).orderBy("shard").collect()
    assert [(r["n"], r["a"]) for r in sizes] == [(10, 10 * i) for i in range(10)] + [(3, 100)]
    assert len(list((tmp_path / "s").glob("shard=*/*.parquet"))) == 11
    writers.write_full_shards(df.limit(0), str(tmp_path / "none"), 10, ["id"])


def test_stream_of_shards_keeps_the_open_one(spark, tmp_path):
    path, schema = str(tmp_path / "o"), "id long, text string"
    batches = [spark.createDataFrame([(i, "t") for i in r], schema) for r in (range(7), range(7, 9), range(9, 9), range(9, 25), range(25, 26))]
    for k, b in enumerate(batches):
        streams.write_batch(b, k, path, 5, ["id"])
        if k == 3:  # as after a failure
            streams.write_batch(b, k, path, 5, ["id"])
    for _ in range(2):
        streams.close_shards(spark, path, batches[0].schema)
    got = streams.shards(spark, path).groupBy("shard").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy("shard").collect()
    assert [r["ids"] for r in got] == [list(range(5 * i, min(26, 5 * i + 5))) for i in range(6)]


def test_stream_stops_and_goes_on(spark, tmp_path):
    schema = "doc_id long, text string"
    for k in range(4):
        spark.createDataFrame([(i, f"word{i % 3} and more") for i in range(5 * k, 5 * k + 5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = streams.document_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    to, progress = str(tmp_path / "out"), str(tmp_path / "cp")
    streams.stopped_after_a_batch(streams.write_table(rows, to, progress, all_now=False))
    assert 5 <= spark.read.parquet(to).count()
    again = streams.write_table(rows, to, progress)
    again.awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(to).collect()) == list(range(20))
    counts = streams.write_counts(rows, str(tmp_path / "counts"), str(tmp_path / "cp2"))
    counts.awaitTermination()
    assert {r["pretoken"]: r["cnt"] for r in streams.counts_so_far(spark, str(tmp_path / "counts")).collect()}[" more"] == 20


def test_windows_of_a_stream_are_those_after_its_last_batch(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 5, 59)
    for k in range(2):
        rows = [(at + datetime.timedelta(minutes=k * i), "a", 1.5) for i in range(4)]
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = streams.table_stream(spark, str(tmp_path / "in"), 1)
    streams.write_windows(events, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = streams.windows_so_far(spark, str(tmp_path / "out"))
    assert sorted((r["window_start"].hour, r["n"], r["total"]) for r in got.collect()) == [(5, 5, 7.5), (6, 3, 4.5)]


def test_short_ranges_share_a_task(tmp_path):
    for k in range(300):
        (tmp_path / f"{k:03d}.txt").write_text("word<|endoftext|>" * 3)
    reader = ranges._Delimited({"path": str(tmp_path), "mark": "<|endoftext|>", "rangebytes": "7"})
    tasks = reader.partitions()
    assert len(tasks) <= 300 and sum(b.num_rows for t in tasks for b in reader.read(t)) == 900


def test_documents_arrive_in_files_of_several_tasks(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(i, "x") for i in range(k, 40, 4)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    arriving = files._arriving(spark, str(tmp_path), str(tmp_path / "to"))
    there = spark.read.parquet(str(tmp_path / "to/in"))
    assert arriving.isStreaming and there.count() == 40 and len(there.inputFiles()) > 3


def test_halves_of_files_are_cut_by_tasks(spark, tmp_path):
    for k in range(3):
        (tmp_path / "whole").mkdir(exist_ok=True)
        (tmp_path / f"whole/part-{k}.gz").write_bytes(bytes(range(10 * k, 10 * k + 9)))
    writers.write_halves(spark, str(tmp_path / "whole"), str(tmp_path / "half"))
    assert {f.name: f.read_bytes() for f in (tmp_path / "half").iterdir()} == {f"part-{k}.gz": bytes(range(10 * k, 10 * k + 4)) for k in range(3)}


def test_solutions_are_listed_by_tasks(spark, tmp_path):
    for name in ("a b/0.py", "c/d/1.py", "2.py", "_no/3.py", "c/.4.py", "c/5.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"x = '{name}'")
    got = readers.solutions(spark, str(tmp_path))
    assert got.inputFiles() == []  # the plan has no list of files
    want = [("a b", "a b/0.py", "a b/0.py"), ("d", "d/1.py", "c/d/1.py"), (tmp_path.name, f"{tmp_path.name}/2.py", "2.py")]
    assert sorted((r["task_id"], r["identifier"], r["solution"]) for r in got.collect()) == sorted((t, i, f"x = '{n}'") for t, i, n in want)

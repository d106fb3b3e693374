"""Operators on small tables worked out by hand, or against plain Python."""

from __future__ import annotations

import gzip
import json
import random
import tarfile
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import session
from lodestone.functions import text
from lodestone.operators import bpe, bpe_index, evaluation, filters, selection, templates, tokens
from lodestone.session import dealt
from lodestone.sources import ranges, readers, writers
from lodestone.streaming import streams


def turns(*roles_and_texts):
    return [(1, i, r, t) for i, (r, t) in enumerate(roles_and_texts)]


def truncated(spark, rows, limit, literal=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return [r["turn"] for r in filters.truncated_turns(df, limit, literal).orderBy("turn").collect()]


def test_truncation(spark):
    talk = turns(("user", "aaaa"), ("assistant", "bbbb"), ("user", "cc"), ("assistant", "dd"), ("user", "e"))
    assert truncated(spark, talk, 3) == []
    assert truncated(spark, talk, 8) == [0]
    assert truncated(spark, talk, 13) == [0, 1, 2, 3, 4]
    assert truncated(spark, talk, 12) == [0, 1, 2]
    with_system = turns(("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"))
    assert truncated(spark, with_system, 100) == [1, 2, 3]
    assert truncated(spark, with_system, 100, literal=True) == [0]


def test_strict_thresholds_and_unknown_stage(spark):
    df = spark.createDataFrame([("x/finemath/1", 3.7), ("x/finemath/2", 3.71), ("x/finemath/3", None), ("other", 0.0)], "path string, score double")
    kept = df.where(filters.source_rule(F.col("path"), 1, {"score": F.col("score")})).select("path").collect()
    assert sorted(r[0] for r in kept) == ["other", "x/finemath/2"]
    edu = spark.createDataFrame([("dclm-edu/1", 5.0)], "path string, edu_score double")
    with pytest.raises(Exception, match="no threshold"):
        edu.where(filters.source_rule(F.col("path"), 3, {"edu_score": F.col("edu_score")})).collect()


def test_stage_three_length_counts_code_points(spark):
    df = spark.createDataFrame([(1, "😀" * 4000), (2, "😀" * 4001)], "i int, text string")
    assert [r["i"] for r in filters.filter_sources(df, F.lit("p"), 3, F.col("text"), {}).collect()] == [2]


def test_repo_share(spark):
    f = lambda *langs: [{"path": str(i), "language": x} for i, x in enumerate(langs)]
    rows = [("a", "C", f("Python", "Python", "Python", "C")), ("b", "C", f("Python", "Python", "Python", "Python", "C")), ("c", None, f("Python")), ("d", "Python", f()), ("e", "C", f())]
    df = spark.createDataFrame(rows, "repo_name string, gha_language string, files array<struct<path:string,language:string>>")
    assert sorted(r[0] for r in filters.repos_in_language(df).collect()) == ["b", "c", "d"]


def test_loss_band_is_strict(spark):
    losses = [1.0] * 10 + [0.95, 1.5, 1.75, 0.9, 1.6, float("nan"), None]
    df = spark.createDataFrame([(x,) for x in losses], "loss double")
    assert sorted((r["loss"], r["band"]) for r in filters.loss_band(df, 0.5).collect()) == [(0.9, 0), (1.6, 1)]


def test_budget_keeps_the_crossing_file(spark):
    df = spark.createDataFrame([(i, 5) for i in range(4)], "i int, n long")
    assert tokens.token_budget(df, F.lit(10), ["i"], "n").count() == 3


@pytest.mark.parametrize(("limit", "want"), [(10, 10), (9, 5), (11, 10), (4, 0)])
def test_validation_boundary(spark, limit, want):
    df = spark.createDataFrame([(i, 5) for i in range(4)], "i long, n long")
    rows = tokens.validation_split(df, "i", "n", limit).collect()
    assert sum(r["n"] for r in rows if r["part"] == "val") == want
    assert sorted(r["start"] for r in rows if r["part"] == "train") == list(range(0, 20 - want, 5))


def ragged(spark, n, sizes=(5, 0, 1, 7, 40)):
    """A store of the numbers below n, in documents of these sizes again and again."""
    rows, at, k = [], 0, 0
    while at < n:
        size = min(sizes[k % len(sizes)], n - at)
        rows.append((k, list(range(at, at + size)), at))
        at, k = at + size, k + 1
    return spark.createDataFrame(rows, "doc_id long, tokens array<int>, start long")


@pytest.mark.parametrize(("extra", "want"), [(0, 0), (3, 0), (4, 1)])
def test_sequential_batches_need_what_follows(spark, extra, want):
    context, batch = 3, 2
    total = batch * (context + 1) + extra
    w = tokens.blocks(ragged(spark, total), context + 1)
    rows = tokens.sequential_batches(w, context, batch, F.lit(total)).collect()
    assert len({r["batch"] for r in rows}) == want
    assert all(r["target"][:-1] == r["input"][1:] for r in rows)


def test_random_windows_cross_documents(spark):
    docs = spark.createDataFrame([(0, list(range(7)), 0), (1, list(range(7, 10)), 7), (2, list(range(10, 40)), 10)], "doc_id long, tokens array<int>, start long")
    rows = tokens.random_windows(docs, 40, 8, 25, 3).collect()
    assert len(rows) == 25 and all(r["tokens"] == list(range(r["pos"], r["pos"] + 9)) for r in rows)
    only = tokens.random_windows(docs, 9, 8, 3, 3).collect()
    assert {r["pos"] for r in only} == {0}


def naive_merges(words, n, tie):
    words = {w if isinstance(w, tuple) else tuple(bytes([b]) for b in w): c for w, c in words.items()}
    out = []
    for _ in range(n):
        pairs = {}
        for w, c in words.items():
            for p in zip(w, w[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + c
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p) if tie == "tuple" else (pairs[p], p[0] + p[1], p))
        out.append(best)
        fresh = {}
        for w, c in words.items():
            new, i = [], 0
            while i < len(w):
                if w[i : i + 2] == best:
                    new.append(w[i] + w[i + 1])
                    i += 2
                else:
                    new.append(w[i])
                    i += 1
            fresh[tuple(new)] = fresh.get(tuple(new), 0) + c
        words = fresh
    return out


@pytest.mark.parametrize("tie", ["tuple", "concat"])
def test_bpe_training_equals_the_naive_one(tie):
    rng = random.Random(5)
    words = {"".join(rng.choice("aabbc ") for _ in range(rng.randint(1, 9))).encode(): rng.randint(1, 20) for _ in range(120)}
    assert bpe.train(words, 80, tie) == naive_merges(words, 80, tie)


def test_bpe_tie_rules():
    words = {b"az": 2, b"abab": 4, b"aba": 2}
    assert bpe.train(words, 30, "tuple")[0] == (b"a", b"b")
    pairs = {b"az": 3, b"xy": 3}
    assert bpe.train(pairs, 1)[0] == (b"x", b"y")


@pytest.mark.parametrize("tie", ["tuple", "concat"])
def test_bpe_training_over_the_bound_counts_all_words(spark, tie):
    rng = random.Random(7)
    text = [" ".join("".join(rng.choice("aaabcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(40)) for _ in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    assert bpe.train_on(docs, 7, tie=tie, most_bytes=3).merges == bpe.train_on(docs, 7, tie=tie).merges


def test_bpe_index_through_compactions(spark, monkeypatch):
    monkeypatch.setattr(bpe_index, "COMPACT", 2)
    rng = random.Random(11)
    words = {"".join(rng.choice("aaabbcdefg") for _ in range(rng.randint(1, 12))).encode(): rng.randint(1, 30) for _ in range(200)}
    table = spark.createDataFrame([([bytes([b]) for b in w], c) for w, c in words.items()], "symbols array<binary>, cnt long")
    monkeypatch.setattr(bpe_index, "FOLDER_WORDS", 70)
    assert bpe_index.train_distributed(table, 10) == bpe.train(words, 10)
    few = {b"ab": 1, b"b": 4}
    table = spark.createDataFrame([([bytes([b]) for b in w], c) for w, c in few.items()], "symbols array<binary>, cnt long")
    assert bpe_index.train_distributed(table, 60) == [(b"a", b"b")]
    assert bpe_index.train_distributed(table.limit(0), 5) == []


def test_bpe_resumed_training_joins_words(spark):
    docs = spark.createDataFrame([(1, "of the best. of the best of the rest, of the least"), (2, "at the end of the day. of the")], "doc_id long, text string")
    v = bpe.train_on(docs, 12)
    store = bpe.encode(docs, v)
    ends = [i for i, t in enumerate(v.tokens()) if t in (b".", b",")]
    spans = tokens.boundary_spans(store, ends, most_percent=99)
    rows = {tuple(v.tokens()[i] for i in r["tokens"]): r["cnt"] for r in spans.collect()}
    more = bpe.resume(v, spans, 5)
    assert more.merges[:12] == v.merges and more.merges[12:] == naive_merges(rows, 5, "tuple")
    assert any(b" " in t.strip() for t in more.tokens()[256 + len(v.specials) :])
    assert bpe.resume(v, spans, 5, most_bytes=1) == more


def many_words(seed, n=300):
    rng = random.Random(seed)
    return {"".join(rng.choice("aaabbcdefg") for _ in range(rng.randint(1, 12))).encode(): rng.randint(1, 30) for _ in range(n)}


def histogram(spark, words):
    return spark.createDataFrame([([bytes([b]) for b in w], c) for w, c in words.items()], "symbols array<binary>, cnt long")


def test_bpe_training_on_tables_takes_few_jobs(spark):
    words = many_words(5)
    spark.sparkContext.setJobGroup("few-jobs", "training")
    assert bpe_index.train_distributed(histogram(spark, words), 60) == bpe.train(words, 60)
    spark.sparkContext.setJobGroup("others", "others")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 40


@pytest.mark.parametrize("tie", ["tuple", "concat"])
def test_bpe_training_doesnt_depend_on_the_sample(spark, monkeypatch, tie):
    monkeypatch.setattr(bpe_index, "SAMPLE_WORDS", 3)
    monkeypatch.setattr(bpe_index, "SAMPLE_SYMBOLS", 4)
    monkeypatch.setattr(bpe_index, "SLICE_SYMBOLS", 50)
    monkeypatch.setattr(bpe_index, "COMPACT", 3)
    words = many_words(6)
    assert bpe_index.train_distributed(histogram(spark, words), 12, tie) == bpe.train(words, 12, tie)


@pytest.mark.parametrize("named", [True, False])
def test_bpe_changes_of_counts_equal_a_recount(named):
    rng = random.Random(4)
    for _ in range(60):
        words = [[rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(8)]
        counts = [rng.randint(1, 9) for _ in words]
        merges = [(rng.randrange(3 + k), rng.randrange(3 + k), 3 + k) for k in range(6)]
        merges.append(merges[0])
        block = bpe_index.Block(np.array([-1, *(x for w in words for x in [*w, -1])], np.int32), np.array(counts), merges if named else [])
        for left, right, new in merges:
            before = Counter()
            for w, c in zip(words, counts, strict=True):
                before.update({p: c * n for p, n in Counter(zip(w, w[1:], strict=False)).items()})
                k = 0
                while k + 1 < len(w):
                    if w[k : k + 2] == [left, right]:
                        w[k : k + 2] = [new]
                    k += 1
            after = Counter()
            for w, c in zip(words, counts, strict=True):
                after.update({p: c * n for p, n in Counter(zip(w, w[1:], strict=False)).items()})
            got = block.merge(left, right, new) or ((), (), ())
            assert {(a, b): n for a, b, n in zip(*got, strict=True)} == {p: after[p] - before[p] for p in before | after if after[p] != before[p]}


def test_bpe_merges_that_can_be_taken_at_once():
    pairs = [(b"a", b"b", 9), (b"c", b"d", 8), (b"e", b"f", 7), (b"b", b"c", 7), (b"g", b"h", 6)]
    assert bpe_index.safe_batch(pairs, False) == [(b"a", b"b"), (b"c", b"d")]
    assert bpe_index.safe_batch([(b"a", b"a", 9), (b"c", b"d", 8)], False) == [(b"a", b"a")]
    assert bpe_index.safe_batch([(b"a", b"b", 9), (b"c", b"d", 8)], True) == [(b"a", b"b")]


def test_bpe_merges_that_make_a_token_there_is_end_a_batch():
    pairs = [(b"a", b"b", 9), (b"c", b"de", 8), (b"f", b"g", 7)]
    assert bpe_index.safe_batch(pairs, False) == [(b"a", b"b"), (b"c", b"de"), (b"f", b"g")]
    assert bpe_index.safe_batch(pairs, False, {b"cde"}) == [(b"a", b"b")]
    assert bpe_index.safe_batch([(b"a", b"bc", 9), (b"ab", b"c", 8)], False) == [(b"a", b"bc")]
    assert bpe_index.safe_batch([(b"abc", b"d", 9), (b"a", b"bc", 8)], False) == [(b"abc", b"d")]


@pytest.mark.parametrize("tie", ["tuple", "concat"])
def test_bpe_rounds_take_merges_foreseen_in_another_order(spark, monkeypatch, tie):
    monkeypatch.setattr(bpe_index.Training, "foreseen", lambda self, most: [(b"c", b"d"), (b"a", b"b"), (b"e", b"f")][:most])
    words = {b"ab": 4, b"cd": 3, b"ef": 2, b"xab": 1}
    training = bpe_index.Training(spark.createDataFrame([list(map(bytes, bpe_packed(words)))], "ids binary, words binary"), [bytes([b]) for b in range(256)], tie)
    training.begin()
    assert training.round(3) == bpe.train(words, 3, tie)


def bpe_packed(words):
    flat, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([*map(len, words)])
    batch = bpe_index.packed(flat, sizes, np.array([*words.values()]))
    assert batch.num_rows == 1
    return batch.column(0)[0].as_py(), batch.column(1)[0].as_py()


def test_bpe_blocks_have_bounded_rows(monkeypatch):
    monkeypatch.setattr(bpe_index, "ROW_SYMBOLS", 50)
    rng = random.Random(8)
    sizes, counts = np.array([rng.choice([2, 3, 9, 70]) for _ in range(200)]), np.arange(200)
    batch = bpe_index.packed(np.arange(sizes.sum()), sizes, counts)
    rows = [np.frombuffer(b, np.int32) for b in batch.column(0).to_pylist()]
    assert max(x.size for x in rows) <= 50 + 72 and all(x[0] == -1 and x[-1] == -1 for x in rows)
    assert [x for r in rows for x in r.tolist() if x >= 0] == list(range(sizes.sum()))
    assert b"".join(batch.column(1).to_pylist()) == counts.tobytes()
    ((ids, words),) = bpe_index._arrays([batch])
    assert np.diff(np.flatnonzero(ids == -1)).tolist() == (sizes + 1).tolist() and words.tolist() == counts.tolist()


def test_bpe_encodes_many_words_as_it_does_one(monkeypatch):
    rng = random.Random(3)
    for trial in range(30):
        words = {"".join(rng.choice("aabbcé ") for _ in range(rng.randint(1, 9))).encode(): rng.randint(1, 9) for _ in range(80)}
        v = bpe.Vocabulary(merges=bpe.train(words, rng.choice([0, 5, 40])))
        if trial % 5 == 4:
            rng.shuffle(v.merges)
        monkeypatch.setattr(bpe, "ENCODED_PIECES", rng.choice([1, 10, 200]))
        rank, ids = {p: i for i, p in reversed(list(enumerate(v.merges)))}, v.ids()
        rows = [[rng.choice(v.specials) if rng.random() < 0.1 else rng.choice([*words]).decode() for _ in range(rng.choice([0, 0, 1, 5, 30]))] for _ in range(rng.choice([0, 1, 20]))]
        want = [[i for w in r for i in ([ids[w.encode()]] if w in v.specials else [ids[t] for t in bpe.encode_word(w.encode(), rank)])] for r in rows]
        assert [x for part in bpe.Encoder(v).lists(pa.array(rows, pa.list_(pa.string()))) for x in part.to_pylist()] == want


def test_spans_take_time_in_proportion_to_their_tokens(spark):
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(150_000)), lambda i: (i % 2).cast("int")).alias("tokens"))
    began = time.time()
    assert [tuple(r) for r in tokens.boundary_spans(long, [1], most_percent=99).collect()] == [([1, 0], 75_000)]
    assert time.time() - began < 20


@pytest.mark.parametrize("percent", [None, 90])
def test_spans_equal_those_found_one_by_one(spark, monkeypatch, percent):
    monkeypatch.setattr(tokens, "SPAN_TOKENS", 40)
    rng = random.Random(9)
    docs = [[rng.choice([1, 2, 3, 4, 9, None]) for _ in range(rng.choice([0, 1, 30]))] for _ in range(40)]
    spans = []
    for d in docs:
        for i, t in enumerate(d):
            if i == 0 or t in (3, 9):
                spans.append([])
            if t not in (9, None):
                spans[-1].append(t)
    spans = [tuple(x) for x in spans if len(x) > 1]
    most = 99 if percent is None else int(np.percentile([*map(len, spans)], percent))
    want = Counter(x[:most] for x in spans)
    store = spark.createDataFrame([(d,) for d in [*docs, None]], "tokens array<int>")
    assert {tuple(r["tokens"]): r["cnt"] for r in tokens.boundary_spans(store, [3], 9, most_percent=percent).collect()} == want
    single = tokens.boundary_spans(store, [3], 9, most_percent=percent, counted=False).collect()
    assert Counter(tuple(r["tokens"]) for r in single) == want and {r["cnt"] for r in single} == {1}


def test_bpe_resumes_on_spans_that_come_again(spark):
    docs = spark.createDataFrame([(i % 3, "of the best. of the best of the rest, of the least") for i in range(9)], "doc_id long, text string")
    v = bpe.train_on(docs, 12)
    both = [bpe.resume(v, tokens.boundary_spans(bpe.encode(docs, v), [46], most_percent=99, counted=c), 5, most_bytes=b) for c in (True, False) for b in (1, 10**6)]
    assert all(x == both[0] for x in both) and len(both[0].merges) == 17


def test_arrow_batches_are_bounded(spark):
    kept = spark.conf.get(session.BATCH_KEY)
    spark.conf.unset(session.BATCH_KEY)
    session.ship(spark)
    assert spark.conf.get(session.BATCH_KEY) == session.BATCH_BYTES
    spark.conf.set(session.BATCH_KEY, "3m")
    session.ship(spark)
    assert spark.conf.get(session.BATCH_KEY) == "3m"
    spark.conf.set(session.BATCH_KEY, kept)


def test_rows_of_one_partition_are_dealt(spark):
    one = spark.range(0, 1000, 1, 1)
    shared = dealt(one)
    assert shared.rdd.getNumPartitions() >= 16 and max(shared.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 200
    assert sorted(r[0] for r in shared.collect()) == list(range(1000))
    even = spark.range(0, 1000, 1, 4)
    assert dealt(even) is even


def test_bpe_encodes_by_rank_and_comes_back(spark):
    docs = spark.createDataFrame([(1, "low lower lowest<|endoftext|>new newer"), (2, ""), (3, None), (4, "naïve 😀 low")], "doc_id long, text string")
    v = bpe.train_on(docs.where("doc_id in (1, 4)"), 20)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, v), v).collect()}
    assert back[1] == "low lower lowest<|endoftext|>new newer" and back[4] == "naïve 😀 low" and back[2] == ""
    rank = {p: i for i, p in enumerate(v.merges)}
    for word in (b"lower", b" newest", b"aaa"):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.encode_word(word, rank) == parts
    assert v.tokens()[256] == b"<|endoftext|>"


def test_bpe_rows_of_one_key_stay_apart(spark):
    rows = [(1, "low lower"), (1, "newest"), (None, "lowest<|endoftext|>"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    v = bpe.train_on(docs, 12)
    store = bpe.encode(docs, v)
    assert store.count() == 4
    assert sorted((str(r["doc_id"]), r["text"]) for r in bpe.decode(store, v).collect()) == sorted((str(d), t or "") for d, t in rows)


def test_bpe_saved_and_naive(spark, tmp_path):
    docs = spark.createDataFrame([(1, "low lower lowest new newer newest 😀 low")], "doc_id long, text string")
    v = bpe.train_on(docs, 15)
    bpe.save(spark, v, str(tmp_path / "v"))
    assert bpe.load(spark, str(tmp_path / "v")) == v
    rank = {p: i for i, p in enumerate(v.merges)}
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("lowernst ") for _ in range(rng.randint(1, 12))).encode()
        assert bpe.encode_word(word, rank) == bpe.naive_encode(word, v)


def test_places_with_many_partitions_and_wide_rows(spark):
    """The adaptive planner may put partitions together in one branch of a plan and not in another."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        n = 400_000
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.md5(F.col("id").cast("string").cast("binary")), 8).alias("wide"))
        out = selection.indexed(df, ["k"])
        assert out.where("idx <> k").count() == 0 and out.agg(F.count_distinct("idx")).first()[0] == n and out.count() == n
        sums = tokens.running_start(df.withColumn("n", F.lit(3)), "k", "n")
        assert sums.where("start <> 3 * k").count() == 0 and sums.count() == n
        by = tokens.running_start(df.withColumn("g", F.when(F.col("k") % 3 > 0, "hot").otherwise(F.lit(None))), ["k"], "k", "s", ["g"])
        got = {(r["g"], r["k"]): r["s"] for r in by.where("k > 399990").collect()}
        for (g, k), s in got.items():
            assert s == sum(x for x in range(k) if (x % 3 > 0) == (g == "hot"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_attached_needs_as_many_rows(spark):
    a, b = spark.range(5), spark.range(4).withColumnRenamed("id", "x")
    with pytest.raises(ValueError, match="can't be attached"):
        selection.attached(a, b, ["id"], ["x"], ["x"])


def test_head_fraction_by_group(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 70, "a").when(F.col("id") < 95, F.lit(None)).otherwise("c").alias("g"))
    got = sorted(r["id"] for r in filters.head_fraction(df, ["id"], 0.2, 0.5, ["g"]).collect())
    assert got == [*range(14, 35), *range(75, 82), *range(96, 97)]
    assert sorted(r["id"] for r in filters.head_fraction(df, ["id"], 0.0, 0.1).collect()) == list(range(10))


def test_locate_by_buckets(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 3, 500, 20000]) for _ in range(300)]
    starts = np.cumsum([0, *sizes])
    m = spark.createDataFrame([(i, n, int(s)) for i, (n, s) in enumerate(zip(sizes, starts, strict=False))], "file long, n_tokens long, start long")
    pos = [rng.randrange(int(starts[-1])) for _ in range(500)]
    out = tokens.locate(spark.createDataFrame([(p,) for p in pos], "pos long"), m, 8).collect()
    assert len(out) == len(pos) and all(starts[r["file"]] <= r["pos"] < starts[r["file"] + 1] and r["local"] == r["pos"] - starts[r["file"]] for r in out)


@pytest.mark.parametrize(("left", "right"), [(1, 2), (1, 1)])
def test_merged_pairs_equal_a_loop(spark, left, right):
    from lodestone.functions.arrays import merged_pair

    rng = random.Random(left + right)
    rows = [[], [1], [1, 1], [1] * 7, [2, 1, 1, 1, 2]] + [[rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(0, 25))] for _ in range(60)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, ids array<int>")
    for r in df.select("i", merged_pair(F.col("ids"), F.lit(left), F.lit(right), F.lit(9)).alias("x")).collect():
        want, k, ids = [], 0, rows[r["i"]]
        while k < len(ids):
            both = ids[k : k + 2] == [left, right]
            want.append(9 if both else ids[k])
            k += 2 if both else 1
        assert r["x"] == want


def test_merged_pairs_of_a_long_list_take_linear_time(spark):
    import time

    from lodestone.functions.arrays import merged_pair

    long = F.transform(F.sequence(F.lit(0), F.col("n").cast("int")), lambda i: F.when(i % 4 < 3, 1).otherwise(2))
    start = time.time()
    got = spark.range(1).select((F.lit(59_999) + F.col("id")).alias("n")).select(long.alias("ids")).select(F.size(merged_pair(F.col("ids"), F.lit(1), F.lit(1), F.lit(9))).alias("n")).first()["n"]
    assert got == 45_000 and time.time() - start < 60


@pytest.mark.parametrize("n", [1, 30])
def test_permutation_is_a_bijection(n):
    p = selection.permutation(n, 1337)
    want = list(range(n))
    random.Random(1337).shuffle(want)
    assert p == want and sorted(p) == list(range(n))


def test_few_shots_are_those_of_the_standard_generator(spark):
    items = spark.range(9).select(F.col("id").alias("idx"), (F.col("id") * 10).alias("x"))
    got = {r["idx"]: [e["x"] for e in r["examples"]] for r in selection.few_shots(items, 9, 3, ["x"]).collect()}
    for i in range(9):
        others = [j for j in range(9) if j != i]
        assert got[i] == [10 * j for j in random.Random(1234 + i).sample(others, 3)]
    with pytest.raises(ValueError, match="fewer"):
        selection.few_shots(items, 3, 3, ["x"])


def test_greedy_cover_equals_brute_force():
    x = np.random.default_rng(1).normal(size=(25, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    sim = d.max() - d
    want, best = [], np.zeros(len(x))
    for _ in range(10):
        gains = [np.maximum(sim[i] - best, 0).sum() if i not in want else -1 for i in range(len(x))]
        want.append(int(np.argmax(gains)))
        best = np.maximum(best, sim[want[-1]])
    assert selection.greedy_cover(x, 10) == want


def test_mixture_repeats_a_task(spark):
    a = spark.range(5).select(F.col("id").alias("idx"))
    rows = selection.mixture([a, a], 42).collect()
    assert sorted(r["place"] for r in rows) == list(range(10)) and sorted((r["task"], r["local"]) for r in rows) == [(k, i) for k in (0, 1) for i in range(5)]


def test_ema_and_single_checkpoint(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(8)] + [("b", 0, 3.0)], "m string, it int, x double")
    got = {r["m"]: r["ema"] for r in evaluation.ema(df, ["m"], "it", "x").collect()}
    want = 2.0
    for i in range(3, 8):
        want = 0.8 * want + 0.2 * i
    assert got["a"] == pytest.approx(want) and got["b"] == 3.0


def test_pass_rates_need_enough_samples(spark):
    rows = [("t", "pass", "fail")] * 2 + [("t", "fail", "pass")]
    df = spark.createDataFrame(rows, "task_id string, base_status string, plus_status string")
    got = evaluation.pass_rates(evaluation.task_totals(df), (1, 10)).collect()
    assert [(r["k"], round(r["base"], 6), r["plus"]) for r in got] == [(1, 0.666667, 0.0)]


def test_centred_at_the_baseline(spark):
    a = spark.createDataFrame([("t", 0.25)], "task string, accuracy double")
    b = spark.createDataFrame([("t", 25.0)], "task string, baseline double")
    assert evaluation.centred_scores(a, b).first()["centred"] == 0


def test_training_text(spark):
    rows = ["a", "q\n<think>r", "q\n<think>r\n<think>s", "<think>x"]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select(templates.training_text(F.col("t"), 3).alias("x"))
    chat = lambda q, r: f"<|bos|><|user_start|>{q}<|user_end|><|assistant_start|>{r}<|assistant_end|><|endoftext|>"
    assert [r["x"] for r in df.collect()] == ["<|bos|>a<|endoftext|>", chat("q", "\n<think>r"), chat("q", "\n<think>r\n<think>s"), "<|bos|><think>x<|endoftext|>"]


def test_chat_text_tells_the_system_message_once(spark):
    m = [("system", "S"), ("user", "a"), ("assistant", None), ("tool", "t"), ("user", "b")]
    df = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    want = "<|bos|><|user_start|>S\n\na<|user_end|><|assistant_start|><|assistant_end|><|user_start|>b<|user_end|><|endoftext|>"
    assert df.select(templates.chat_text(F.col("m"))).first()[0] == want


def test_sources(spark, tmp_path):
    (tmp_path / "d.txt").write_text("one<|endoftext|>two\nlines<|endoftext|><|endoftext|>three")
    assert [r["text"] for r in readers.delimited_text(spark, str(tmp_path / "d.txt")).collect()] == ["one", "two\nlines", "three"]
    (tmp_path / "j").mkdir()
    with gzip.open(tmp_path / "j/a.jsonl.gz", "wt") as f:
        f.write('{"text": "x", "score": 1.5}\n\n{"text": "y", "score": 2.5}\n')
    assert sorted(r["text"] for r in readers.documents(spark, str(tmp_path / "j")).collect()) == ["x", "y"]
    spark.createDataFrame([("p",)], "text string").write.parquet(str(tmp_path / "j/deep/p.parquet"))
    assert [r["text"] for r in readers.documents(spark, str(tmp_path / "j")).collect()] == ["p"]
    with pytest.raises(Exception, match="neither"):
        (tmp_path / "none").mkdir()
        readers.documents(spark, str(tmp_path / "none"))
    (tmp_path / "mix.json").write_text(json.dumps({"a": 5, "b": 7}))
    assert sorted(map(tuple, readers.data_mix(spark, str(tmp_path / "mix.json")).collect())) == [("a", 5), ("b", 7)]
    (tmp_path / "root").mkdir()
    (tmp_path / "root/f.py").write_text("print(1)")
    with tarfile.open(tmp_path / "r.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "root", "root")
    assert [(r["root"], r["path"], r["text"]) for r in ranges.archives(spark, str(tmp_path / "r.tar.gz")).collect()] == [("root", "f.py", "print(1)")]
    (tmp_path / "s/T_1").mkdir(parents=True)
    (tmp_path / "s/T_1/0.py").write_text("x = 1")
    assert [tuple(r) for r in readers.solutions(spark, str(tmp_path / "s")).collect()] == [("T_1", "x = 1", "T_1/0.py")]
    assert ranges.byte_range(spark, str(tmp_path / "d.txt"), 3, 16).first()["text"] == "<|endoftext|>"
    df = spark.createDataFrame([("[{'path': 'a', 'language': None}]",), ("oops(",)], "files string")
    got = [r["files"] for r in readers.python_literal(df, "files", "array<struct<path:string,language:string>>").collect()]
    assert got[0][0]["path"] == "a" and got[1] is None


def test_sinks(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("source_path"))
    writers.write_by_source(df, str(tmp_path / "o"))
    writers.write_by_source(df.where("source_path = 1").limit(1), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 6
    assert writers.resumed(df, spark.read.parquet(str(tmp_path / "o")).where("source_path = 1")).count() == 5
    writers.write_shards(df.coalesce(1), str(tmp_path / "s"), 4)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 3
    writers.write_lines(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 10


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 3} and more") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    s = streams.document_stream(spark, str(tmp_path / "in"), docs.schema, 1)
    streams.running_counts(s).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, tokens.pretoken_counts(docs).collect()))
    streams.write_shards(streams.document_stream(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "out"), str(tmp_path / "cp"), 6, ["doc_id"]).awaitTermination()
    streams.close_shards(spark, str(tmp_path / "out"), docs.schema)
    assert sorted(r["count"] for r in streams.shards(spark, str(tmp_path / "out")).groupBy("shard").count().collect()) == [2, 6, 6, 6]
    assert streams.pretoken_stream(docs).where("doc_id = 0").orderBy("pos").first()["pretoken"] == "word"


def test_special_markers_are_fixed():
    assert text.SPECIALS[0] == "<|endoftext|>" and len(text.SPECIALS) == 9

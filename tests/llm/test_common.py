"""Hashing of words and shingles, hashed terms, components, and the guard of the driver contract."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, text_arrays
from lodestone.llm.components import components
from lodestone.llm.features import Terms, Vocabulary

TEXTS = ["The Cat sat\ton\x0bthe  mat", "", None, "one", " \n ", "the cat Sat", "É é ß x" * 3, "a b", "a  b c"]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])


def expected(t, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [1, 2, 5])
@pytest.mark.parametrize("most", [1, 8, 1 << 20])
def test_shingles_equal_sets_of_words(k, most):
    rng = random.Random(k)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    got = []
    for _, data, offsets in text_arrays.slices(batch(texts), "text", most):
        got += list(text_arrays.shingles(data, offsets, k))
    want = [expected(t, k) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_slices_of_a_sliced_batch():
    b = batch(TEXTS).slice(3, 4)
    parts = list(text_arrays.slices(b, "text", 5))
    assert sum(p.num_rows for p, _, _ in parts) == 4
    assert b"".join(bytes(d) for _, d, _ in parts).decode() == "".join(t or "" for t in TEXTS[3:7])


def test_terms_of_empty_texts():
    for _, data, offsets in text_arrays.slices(batch(["", None]), "text"):
        t = Terms(data, offsets)
        assert t.n_docs == 2 and not t.n_words.any() and not t.repeated.any()


def test_vocabulary_finds_full_hashes_only():
    chosen = np.array([5, 5 + (1 << 30), 9], np.uint64)
    v = Vocabulary(chosen)
    assert v.find(np.array([5, 9, 5 + (1 << 30), 5 + (1 << 40), 0], np.uint64)).tolist() == [0, 1, 2, -1, -1]
    assert Vocabulary(np.zeros(0, np.uint64)).find(chosen).tolist() == [-1] * 3


@pytest.mark.parametrize("seed, short", [(1, 0), (2, 0), (3, 10_000)])
def test_components(spark, monkeypatch, seed, short):
    monkeypatch.setattr("lodestone.llm.components.SHORT", short)
    rng = random.Random(seed)
    edges = [(rng.randint(-30, 30), rng.randint(-30, 30)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_hot_join_deals_hot_keys_alone(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, 1).when(F.col("id") < 5990, F.col("id")).cast("long").alias("k"), F.col("id"))
    keyed = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("k <> 5500")
    inner = common.hot_join(rows, keyed, ["k"], F.col("id"), "inner", "n")
    assert inner.count() == 5989 and inner.where("k = 1 and least = 0").count() == 5000
    assert common.hot_join(rows, keyed, ["k"], F.col("id"), "left", "n").where("least is null").count() == 11
    assert common.hot_join(rows, keyed.limit(0), ["k"], F.col("id"), "inner", "n").count() == 0


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0

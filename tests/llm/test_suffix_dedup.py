from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import suffix_dedup
from lodestone.llm.difference_cover import suffix_ranks
from tests.llm.fixtures import corpus, frame, prose


def brute(rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    out = []
    for (d, _, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()) if len(t) else 0
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_ranks_order_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(120):
        n = int(rng.integers(1, 200))
        t = rng.integers(1, int(rng.integers(2, 5)), n)
        if trial % 3 == 0:
            t = np.tile(t[: max(1, n // 5)], 6)[:n]
        for depth in (1, 2, 3):
            order = np.argsort(suffix_ranks(t, depth), kind="stable")
            prefixes = [tuple(t[i : i + 3**depth]) for i in order]
            assert prefixes == sorted(prefixes)
    assert len(suffix_ranks(np.zeros(0, int), 3)) == 0


@pytest.mark.parametrize(("broadcast_bytes", "hot"), [(32 << 20, 2000), (0, 2000), (32 << 20, 1)])
def test_equals_brute_force(spark, broadcast_bytes, hot):
    rows = corpus()
    assert got(suffix_dedup.suffix_dedup(frame(spark, rows), broadcast_bytes=broadcast_bytes, hot=hot)) == brute(rows)


def test_lengths_about_the_limit(spark):
    rng = random.Random(4)
    s = "".join(rng.choice("abcdefgh") for _ in range(400))
    rows = [(1, "A" + s[:199] + "B", None), (2, "C" + s[:199] + "D", None), (3, "E" + s[200:400] + "F", None), (4, s[200:400], None), (5, "z" * 200, None), (6, "z" * 201, None)]
    assert got(suffix_dedup.suffix_dedup(frame(spark, rows))) == brute(rows)


def test_passage_in_many_texts(spark):
    rng = random.Random(6)
    passage = prose(rng, 80)
    rows = [(i, f"{prose(rng, 10)}{passage}{prose(rng, 10)}", None) for i in range(60)]
    assert got(suffix_dedup.suffix_dedup(frame(spark, rows), hot=5)) == brute(rows)


def _groups(spark, monkeypatch, n, hot):
    """The rows of the largest group that one task sorts out, for one passage in n texts."""
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(600))
    rows = [(i, f"{rng.random()}{passage}{rng.random()}", None) for i in range(n)]
    seen = spark.sparkContext.accumulator(0)

    class Largest:
        def __call__(self, texts):
            top = texts.groupBy("g").count().agg({"count": "max"}).first()[0]
            seen.add(max(0, (top or 0) - seen.value))
            return real(texts)

    real = suffix_dedup._sorted_out
    monkeypatch.setattr(suffix_dedup, "_sorted_out", Largest())
    out = got(suffix_dedup.suffix_dedup(frame(spark, rows), hot=hot))
    monkeypatch.setattr(suffix_dedup, "_sorted_out", real)
    return rows, out, seen.value


def test_groups_do_not_grow_with_a_passage(spark, monkeypatch):
    rows, out, small = _groups(spark, monkeypatch, 400, 50)
    assert out == brute(rows)
    rows, out, large = _groups(spark, monkeypatch, 2000, 50)
    assert out == brute(rows) and small <= 50 and large <= 50


def test_one_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    data = np.frombuffer("".join(t or "" for _, t, _ in corpus()).encode(), np.uint8)
    offsets = np.array([0, 1000, 1000, len(data)])
    b = suffix_dedup.anchors(data, offsets)
    assert b["n"].sum() == sum(max(0, x - 199) for x in np.diff(offsets))
    order = np.lexsort((b["s"], b["doc"]))
    for d in (0, 2):
        s, n = b["s"][order][b["doc"][order] == d], b["n"][order][b["doc"][order] == d]
        assert (s[1:] == (s + n)[:-1]).all()


def test_spans_are_real(spark):
    rows = corpus()
    for r in suffix_dedup.suffix_dedup(frame(spark, rows), with_spans=True).collect():
        assert sum(x["e"] - x["s"] for x in r["spans"]) == r["n_removed"]


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "ab" * 150, None), (1, "ab" * 150, None), (None, "q" * 10, None)]
    out = suffix_dedup.suffix_dedup(frame(spark, rows)).collect()
    assert sorted(r["n_removed"] for r in out) == [0, 300, 300]
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0

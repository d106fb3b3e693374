from __future__ import annotations

import random

import pytest

from lodestone.llm import minhash
from tests.llm.fixtures import corpus, edited, frame, prose
from tests.llm.test_common import expected


def brute(rows, shingle, percent=80):
    sets = [expected(t, shingle) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _, _) in enumerate(rows))


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("shingle", [2, 5])
def test_equals_brute_force(spark, shingle):
    rows = corpus()
    assert got(minhash.near_dedup(frame(spark, rows), shingle=shingle)) == brute(rows, shingle)


def test_group_of_near_copies_without_a_hub(spark):
    """A chain: each copy is linked with a few others only, and the pivots don't meet all links."""
    rng = random.Random(8)
    text, rows = prose(rng, 150), []
    for i in range(120):
        rows.append((i, text, None))
        text = edited(rng, text, 0.015)
    rng.shuffle(rows)
    assert got(minhash.near_dedup(frame(spark, rows), shingle=2)) == brute(rows, 2)


def test_dense_group(spark):
    rng = random.Random(9)
    text = prose(rng, 120)
    rows = [(i, edited(rng, text, rng.choice([0.02, 0.05, 0.08, 0.12])), None) for i in range(150)]
    assert got(minhash.near_dedup(frame(spark, rows), shingle=2)) == brute(rows, 2)


def test_repeated_rows_and_ids(spark):
    rows = [(3, "a b c d", None), (3, "a b c d", None), (1, "a b c d", None), (3, "w x y z", None)]
    assert got(minhash.near_dedup(frame(spark, rows), shingle=2)) == [(1, 3, 1, True), (3, 3, 1, False), (3, 3, 1, False), (3, 3, 3, True)]


def test_rows_without_an_id_are_linked(spark):
    a, b = "a b c d e f g h i j k l", "a b c d e f g h i j k m"
    rows = [(5, a, None), (None, b, None), (None, a, None), (None, "q r s", None)]
    df = minhash.near_dedup(frame(spark, rows), shingle=2, with_first=True).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"], r["first"]) for r in df) == [("5", "5", True, True), ("None", "5", False, False), ("None", "5", False, False), ("None", "None", True, True)]


def test_bridge_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    x, y, z = words, [*words[:57], "a", "b", "c"], [*"defg", *words[4:57], "a", "b", "c"]
    rows = [(1, " ".join(x), None), (None, " ".join(y), None), (2, " ".join(z), None)]
    assert {r["component_id"] for r in minhash.near_dedup(frame(spark, rows), shingle=2).collect()} == {1}


def test_texts_join_by_shuffle_too(spark):
    rows = corpus()[:60]
    assert got(minhash.near_dedup(frame(spark, rows), shingle=2, broadcast_bytes=0)) == brute(rows, 2)


def test_empty_table(spark):
    assert minhash.near_dedup(frame(spark, [])).count() == 0


def test_posterior_bound_grows_with_the_matches_seen():
    limits = minhash.least_matches(80, 160, 1e-6)
    assert limits[-1][0] == 160 and all(m < 0.8 * n for n, m in limits)
    shares = [m / n for n, m in limits]
    assert shares == sorted(shares)


def test_copies_below_the_limit_meet_once(spark, monkeypatch):
    """Copies that share buckets in many bands and aren't linked: each signature goes to a few blocks, not to one for each bucket."""
    rng = random.Random(10)
    text = prose(rng, 200)
    rows = [(i, edited(rng, text, 0.055), None) for i in range(200)]
    moved, promising = [], minhash._promising

    def counted(met, *others):
        moved.append(met.selectExpr("sum(size(x) + size(y)) AS n").first()["n"] or 0)
        return promising(met, *others)

    monkeypatch.setattr(minhash, "_promising", counted)
    assert got(minhash.near_dedup(frame(spark, rows), shingle=2)) == brute(rows, 2)
    assert len(moved) == 1 and 0 < moved[0] <= 4 * len(rows)


def test_regions_that_would_move_more_are_left_to_their_buckets(spark):
    dense = [(k, 10, 1000, n, n) for k in range(5) for n in range(1000, 1010)]
    chain = [(100 + k, 2, k, k + d, k + d) for k in range(600) for d in (0, 1)]
    rows = minhash._dealt(spark.createDataFrame(dense + chain, "key long, n long, first long, node long, comp long")).distinct().collect()
    assert {(r["kind"], r["node"] >= 1000) for r in rows} == {(1, False), (2, True)}
    assert sorted(r["node"] for r in rows if r["kind"] == 2) == list(range(1000, 1010)) and {r["n"] for r in rows if r["kind"] == 2} == {10}
    assert sorted((r["g"], r["node"]) for r in rows if r["kind"] == 1) == sorted((k, n) for k, _, _, n, _ in chain)

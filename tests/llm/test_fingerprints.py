"""Fingerprints against sets of paragraphs in memory."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from lodestone.llm import fingerprints as P
from lodestone.llm import queries
from tests.conftest import SF
from tests.llm.fixtures import corpus, frame


def cut_up(text):
    return set(re.findall(rf"[^\n]{{1,{P.PIECE}}}[^\n.!?]*[.!?]*", text))


def alike(a, b):
    a, b = cut_up(a), cut_up(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next) of (doc_id, text) with distinct ids."""
    rows = sorted((d, t or "") for d, t in rows)
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), round(alike(t, new), 9), round(alike(t, after), 9)))
    return out


def got(df):
    rows = df.select("doc_id", "n_chars", "edited_sha256", F.round("near_edited", 9), F.round("near_next", 9)).collect()
    return sorted([tuple(r) for r in rows], key=lambda r: (r[0] is None, r[0] or 0))


def test_query_against_sets(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op13_fingerprints(spark, SF)) == plain(rows)


def test_odd_rows_and_gaps_in_ids(spark):
    rng = random.Random(5)
    rows = [(d * rng.choice([1, 1, 40]) * 7 - 300 + 1000 * d, t, s) for d, t, s in corpus()]
    rows += [(10**15, "\n".join(f"line {i}" for i in range(3000)), None), (-(10**12), "\n".join(f"line {i}" for i in range(1500, 4500)) + "\n\n", "x"), (10**15 + 1, "é" * 5000, "y")]
    df = frame(spark, rows).repartition(6)
    assert got(P.edit_fingerprints(df)) == plain([r[:2] for r in rows])
    found = {r["doc_id"]: r["fingerprint"] for r in P.edit_fingerprints(df).collect()}
    by_text = {}
    for d, t, _ in rows:
        assert by_text.setdefault(t or "", found[d]) == found[d]
    assert len(set(by_text.values())) >= len({frozenset(cut_up(t)) for t in by_text})


def test_repeated_ids_null_ids_one_and_no_document(spark):
    kinds = "doc_id long, text string"
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c"), (None, "x\ny"), (None, None)], kinds)
    rows = P.edit_fingerprints(twice).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in rows) == [(False, 1), (False, 3), (False, 3), (True, 0), (True, 3)]
    alone = [r for r in rows if r["doc_id"] is None and r["n_chars"] == 3]
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"x\n").hexdigest() and alone[0]["near_next"] == 0.0
    assert got(P.edit_fingerprints(spark.createDataFrame([(7, "abcd")], kinds))) == [(7, 4, hashlib.sha256(b"abab").hexdigest(), 0.0, 1.0)]
    assert P.edit_fingerprints(spark.createDataFrame([], kinds)).collect() == []


def test_peeling_finds_all_differences_and_grows(spark):
    cases = [(n, shared) for n in (0, 1, 3, 10, 30, 200, 1500) for shared in (0, n // 2, n)]
    rows = [(i, [f"s{j}" for j in range(s)] + [f"a{j}" for j in range(n - s)], [f"s{j}" for j in range(s)] + [f"b{j}" for j in range(n - s)]) for i, (n, s) in enumerate(cases)]
    df = spark.createDataFrame([(i, "\n".join(a), "\n".join(b)) for i, a, b in rows], "id int, a string, b string")
    out = P.compared(P.fingerprints(df, ["a", "b"]), "a", "b", "near").withColumn("diff", P.differing(F.col("a_digests"), F.col("b_digests"), F.col("a_cells"), F.col("b_cells")))
    for r in out.collect():
        n, s = cases[r["id"]]
        assert r["diff"] is not None and len(r["near_only_a"]) == len(r["near_only_b"]) == n - s
        assert set(r["near_only_a"]) <= set(r["a_digests"]) and not set(r["near_only_a"]) & set(r["b_digests"])
    small = df.where("id = 12").select(P.peeled(P.sketch(P.paragraphs(F.col("a")), F.lit(0)), F.lit(0)).alias("x")).first()["x"]
    assert not small["ok"]  # too many for the smallest


def test_plan_has_no_python_and_one_shuffle_of_texts(spark):
    df = P.edit_fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

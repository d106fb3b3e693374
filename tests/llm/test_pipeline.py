from __future__ import annotations

import importlib
import sys

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_near_dedup import brute


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, before = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        if name != "pack":
            assert out.columns == list(corpus_pipeline.COLUMNS) and out.dtypes == docs.dtypes
        rows = out.collect()
        if name == "near_dedup":
            given = [(r["doc_id"], r["text"], None) for r in before.collect()]
            assert sorted(r["doc_id"] for r in rows) == [d for d, _, _, kept in brute(given, 5) if kept]
        if name == "line_dedup":
            assert len(rows) == sizes[-1] and all(r["n_chars"] == len(r["text"]) for r in rows)
        sizes.append(len(rows))
        if name != "pack":
            before = spark.createDataFrame(rows, docs.schema)
    # the lines of near copies go in the stage before, so few or none of them are left here; in the documents as they are there are some
    assert sizes[1] < sizes[0] and sizes[3] <= sizes[2]
    assert corpus_pipeline.near_dedup(spark, docs, SF).count() < sizes[0]


def test_run_equals_the_stages_in_columns(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 100


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13)] * 3 + [(2, "a b c d e f g", "en", "s", 13), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 3]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, f_id long, own_0 int, first string"


def odd(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0 if t is None else len(t), 1.0, 2, 3, "x") for d, t in rows], SCHEMA)


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    x, z = "a b c d e f g", "q r s t u v w"
    out = corpus_pipeline.near_dedup(spark, odd(spark, [(1, x), (3, x), (3, z), (None, z), (None, None), (4, "")]), SF)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == [("1", x), ("3", z), ("4", ""), ("None", "")]
    both = [(3, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (3, "a b c d e f g h i j k l m n o p q r s t u v w x y zz")]
    assert corpus_pipeline.near_dedup(spark, odd(spark, both), SF).count() == 1


def test_stages_take_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing names; and no rows at all."""
    rows = [(None, None), (None, "one two three"), (1, ""), (2, None), (3, " \n"), (4, "word " * 30000), (5, "a plain text of a few words"), (5, "a plain text of a few words")]
    given = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, given.where("false"), SF)
        out = stage(spark, given, SF)
        assert none.count() == 0 and none.columns == out.columns
        got = out.collect()
        if name != "pack":
            assert out.columns == list(corpus_pipeline.COLUMNS) and {r["doc_id"] for r in got} <= {d for d, _ in rows}
        if name == "line_dedup":
            assert len(got) == len(rows)
        if name == "near_dedup":
            assert len(got) == 7
        if name == "pack":
            assert sum(r["length"] for r in got if r["doc_id"] == 5) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 5)
            assert {r["doc_id"] for r in got} == {d for d, _ in rows}


def test_line_dedup_takes_short_lines(spark):
    rows = [(1, "All rights reserved.\nok", "en", "s", 23), (2, "All rights reserved.\n\n\nAll rights reservd.\nno more", "en", "s", 51), (3, "ok\nother", "en", "s", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert out == {1: ("All rights reserved.\nok", 23), 2: ("\n\nno more", 9), 3: ("other", 5)}


def test_contract_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__

    with monkeypatch.context():
        entry = importlib.reload(__spark_entry__)
        assert "pretoken_counts" in entry.queries() and not [q for q in entry.queries() if q.startswith("op")]
    monkeypatch.undo()
    assert "pipeline" in importlib.reload(__spark_entry__).queries()

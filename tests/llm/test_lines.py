from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, line_dedup, line_frequency
from tests.llm.fixtures import corpus, frame, prose


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_dedup(rows, least=30, edits=1):
    rows = sorted(enumerate(rows), key=lambda x: x[1][0])
    lines, out = [], {}
    for i, (d, t, _) in rows:
        kept = []
        for line in (t or "").split("\n"):
            gone = len(line) >= least and any(line == x or (edits and within_one(line, x)) for x in lines)
            if len(line) >= least:
                lines.append(line)
            if not gone:
                kept.append(line)
        out[i] = (d, None if t is None else "\n".join(kept))
    return [out[i] for i in range(len(out))]


def line_edits(seed):
    rng = random.Random(seed)
    rows, base = [], [prose(rng, n).replace("\n", " ") for n in (6, 9, 15, 40, 90)] + ["a" * 30, "a" * 31, "é" * 40, "😀" * 33, "ab" * 20]
    for i in range(160):
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            p = rng.randrange(len(s) + 1)
            what = rng.choice(["add", "del", "sub"])
            if what == "add":
                s.insert(p, rng.choice("xé😀 a"))
            elif p < len(s):
                if what == "del":
                    del s[p]
                else:
                    s[p] = rng.choice("xé😀 a")
        rows.append((i, "".join(s) if i % 3 else "short\n" + "".join(s) + "\n\nshort", None))
    return rows


def test_dedup_without_broadcasts(spark, monkeypatch):
    """The way that large tables take: bitmaps, and shuffles of what they let through."""
    rows = line_edits(4) + corpus()[:40] + [(None, "a line without an id, long enough\nx", None)] * 2
    want = sorted((str(r["doc_id"]), str(r["text"])) for r in line_dedup.line_dedup(frame(spark, rows)).collect())
    for module in (line_dedup, common):
        monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    out = line_dedup.line_dedup(frame(spark, rows))
    assert out.columns == [*frame(spark, []).columns, "n_lines", "n_removed"]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == want
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_sieve_lets_all_keys_through(spark):
    keys = spark.range(5000).select((F.col("id") * 7919 - 3).alias("k"))
    rows = spark.range(100_000).select((F.col("id") * 7919 - 3).alias("k"))
    left = common.sifted(rows, common.sieve(keys, "k"), "k")
    assert left.join(keys, "k", "left_semi").count() == 5000 and left.count() < 5100
    told = common.sifted(rows, common.sieve(keys, "k"), "k", keep_others=True)
    assert told.count() == 100_000 and told.where("own_hit").count() == left.count()
    assert common.sifted(rows, common.sieve(keys.where("false"), "k"), "k").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dedup_equals_brute_force(spark, seed):
    rows = line_edits(seed)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == dict(brute_dedup(rows))


def test_dedup_of_the_corpus_keeps_columns(spark):
    rows = corpus()
    df = line_dedup.line_dedup(frame(spark, rows))
    assert df.columns == [*frame(spark, []).columns, "n_lines", "n_removed"]
    assert {r["doc_id"]: r["text"] for r in df.collect()} == dict(brute_dedup(rows))
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, rows), max_edits=0).collect()}
    assert got == dict(brute_dedup(rows, edits=0))


def test_short_lines_equal_brute_force(spark):
    """Lines from one character on, whose blocks may be empty."""
    rng = random.Random(6)
    rows = [(i, "\n".join("".join(rng.choice("abcdefé😀 ") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 7, 8, 11, 12, 13]))) for _ in range(3)), None) for i in range(150)]
    base = [t for _, t, _ in rows[::5]]
    rows += [(200 + i, t[:p] + rng.choice(["", "x", "é"]) + t[p + rng.choice([0, 1]) :], None) for i, t in enumerate(base) for p in [rng.randrange(len(t) + 1)]]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, rows), min_chars=1).collect()}
    assert got == dict(brute_dedup(rows, least=1))


def test_repeated_rows_keep_the_same_lines(spark):
    line = "a line that is long enough to count"
    rows = [(1, line, None), (1, line, None), (2, f"{line}\n{line}", None)]
    assert sorted(r["text"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()) == ["", line, line]
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams, hit = {}, set()
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            hit.update(j for i in at for j in (i, i + 1, i + 2))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_rules_equal_brute_force(spark):
    rows = corpus() + [(900, "a b c a b c a b", "s"), (901, "x\n x\nx\n\r\nx|<>#", "s"), (902, "a a a a", "s"), (903, "ｆ 😀\x0b|\x1f|\x85 z", "s")]
    got = {r["doc_id"]: r for r in line_frequency.quality_rules(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(t), d


def test_common_lines_by_host(spark):
    rng = random.Random(2)
    rows = [(i, f"Same  line\n{prose(rng, 60)}", "a") for i in range(30)] + [(100 + i, "same LINE", "a") for i in range(3)] + [(200, "same line", "b"), (201, "same line", None)]
    rows += [(300 + i, "same line\nsame line", "a") for i in range(2)]
    v = {r["id"]: r for r in line_frequency.line_frequency(frame(spark, rows), min_docs=10, host_share=0.0).collect()}
    assert v[0]["n_common"] == 1 and v[0]["kept"] and not v[100]["kept"] and v[200]["kept"] and v[201]["kept"]
    assert v[300]["n_common"] == 2 and not v[300]["kept"]
    at_limit = line_frequency.line_frequency(frame(spark, rows), min_docs=35, host_share=0.0)
    assert at_limit.where("n_common > 0").count() == 0
    by_share = line_frequency.line_frequency(frame(spark, rows), min_docs=1, host_share=2.0)
    assert by_share.where("n_common > 0").count() == 0


def test_common_lines_leave_the_texts(spark):
    rng = random.Random(4)
    own = [prose(rng, 60) for _ in range(30)]
    rows = [(i, f"Same  line\n\n{t}\nsame LINE \nend", "a") for i, t in enumerate(own)] + [(50, f"same line\n{own[0]}", "b"), (51, None, "a"), (52, "same line", "a"), (53, f"same line\n{own[1]}", None)]
    rows += [(54, f"same line\n{own[2]}", "a")] * 2
    out = line_frequency.without_common_lines(frame(spark, rows), min_docs=31, host_share=0.0)
    assert out.columns == [*(c for c in frame(spark, []).columns if c != "kept"), "n_removed", "kept"] and out.count() == len(rows)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["kept"]) for r in out.collect()}
    assert all(got[i] == (f"\n{t}\nend", 2, True) for i, t in enumerate(own))
    assert got[50] == (rows[30][1], 0, True) and got[51] == (None, 0, False) and got[52] == ("", 1, False)
    assert got[53] == (rows[33][1], 0, True) and got[54] == (own[2], 1, True)
    verdict = {r["doc_id"]: r["kept"] for r in line_frequency.quality_rules(frame(spark, rows), min_docs=31, host_share=0.0).collect()}
    assert verdict == {k: v[2] for k, v in got.items()}
    assert line_frequency.without_common_lines(frame(spark, [])).count() == 0


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "l\n" * 3, "a")] * 5
    assert line_frequency.quality_rules(frame(spark, rows), min_docs=2).select("doc_id", "kept", "n_common").distinct().count() == 1
    assert line_frequency.quality_rules(frame(spark, rows), min_docs=2).count() == 5
    assert line_frequency.quality_rules(frame(spark, [])).count() == 0


def test_documents_are_counted_and_not_rows(spark):
    """Against a plain count of distinct documents, with ids that repeat, once with another text, and rows without one."""
    rng = random.Random(9)
    rows = [(1, f"again\n{prose(rng, 60)}", "a")] * 25 + [(1, f"again\n{prose(rng, 60)}", "a")]
    rows += [(None, f"nameless\n{prose(rng, 60)}", "a") for _ in range(3)] + [(None, "nameless\nx", "a")] * 4
    rows += [(10 + i, f"shared\nshared\n{prose(rng, 60)}", "a") for i in range(5)]
    held: dict[str, set] = {}
    for d, t, _ in rows:
        for line in t.split("\n"):
            held.setdefault(line, set()).add((d, t if d is None else None))
    want = {(d, t): sum(len(held[x]) > 3 for x in t.split("\n")) for d, t, _ in rows}
    found = line_frequency.line_frequency(frame(spark, rows), min_docs=3, host_share=0.0)
    texts = {r["h"]: r["text"] for r in frame(spark, rows).select(F.xxhash64("text").alias("h"), "text").collect()}
    got = found.collect()
    assert {(r["id"], texts[r["text_hash"]]): r["n_common"] for r in got} == want and len(got) == len(want)
    assert {n for (d, _), n in want.items() if d == 1} == {0} and {n for (d, _), n in want.items() if d is None} == {1}


def test_names_that_the_operators_use(spark):
    names = ["gone", "__gone", "__id", "__hash", "id", "hash", "host", "own_id", "own_gone", "own_salt", "n_lines", "n_removed"]
    line = "a line that is there twice, and long enough"
    df = spark.createDataFrame([(i, f"{line}\n{i}", "s", *["x"] * len(names)) for i in (1, 2)], ["doc_id", "text", "source", *names])
    out = line_dedup.line_dedup(df)
    assert out.columns == [*[c for c in df.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["text"], r["own_gone"], r["__gone"]) for r in out.collect()) == [(1, f"{line}\n1", "x", "x"), (2, "2", "x", "x")]
    out = line_frequency.without_common_lines(df, min_docs=1, host_share=0.0)
    assert sorted((r["doc_id"], r["text"], r["own_host"] if "own_host" in out.columns else "x", r["gone"]) for r in out.collect()) == [(1, "1", "x", "x"), (2, "2", "x", "x")]


def test_native(spark):
    """No Python on the main path of the operators that are to be native."""
    from lodestone.llm.secret_scan import digest, secret_scan

    df = frame(spark, corpus()[:12])
    for out in (line_frequency.quality_rules(df), line_dedup.line_dedup(df), digest(secret_scan(df))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert F is not None


def test_repeated_rows_of_one_document_leave_the_limit_as_it_is(spark):
    rows = [(i, f"own line {i}\n" + ("shared by a quarter" if i < 25 else f"another {i}"), "h") for i in range(100)]
    one = (1000, "an unrelated text", "h")
    for repeats in (0, 1, 3000):
        found = line_frequency.line_frequency(frame(spark, rows + [one] * repeats))
        assert found.where("n_common = 1").count() == 25


def test_lines_of_many_documents_are_common_in_hosts_of_any_size(spark):
    rows = [(i, f"own line {i}\n" + ("in sixty" if i < 60 else f"another {i}"), "h") for i in range(8000)]
    assert line_frequency.line_frequency(frame(spark, rows), most_docs=50).where("n_common = 1").count() == 60
    assert line_frequency.line_frequency(frame(spark, rows)).where("n_common = 1").count() == 0

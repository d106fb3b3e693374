"""Edge cases of functions, against values worked out by hand or by plain Python."""

from __future__ import annotations

import math

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import arrays, numbers, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("t", "want"),
    [
        ("Hello world's 12345  end\n\n  x", ["Hello", " world", "'s", " ", "123", "45", " ", " end", "\n\n", " ", " x"]),
        ("a  b 　c", ["a", " ", " b", " ", "　c"]),
        (" a​b\x1c\x85z", [" a", "​b", "\x1c", "\x85z"]),
        ("", []),
    ],
)
def test_pretokens(spark, t, want):
    assert value(spark, text.pretokens(F.lit(t))) == want


def test_pretokens_equal_the_pattern_in_python(spark):
    pattern = regex.compile(text.PRETOKEN)
    samples = ["I'll go, NOW!!\r\n\tok", "naïve façade—“quoted” 12²", "日本語 テキスト x", "a_b-c__d  \n \n e", "́x 9٠١٢٣"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select(text.pretokens(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in rows] == [pattern.findall(s) for s in samples]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab '\n1. é", max_size=30))
def test_pretokens_lose_nothing(spark, t):
    assert "".join(value(spark, text.pretokens(F.lit(t)))) == t


@pytest.mark.parametrize(("x", "want"), [(0.5, 0), (1.5, 2), (2.5, 2), (3.5, 4), (-1.0, 0), (7.2, 5), (math.nan, 0)])
def test_int_score(spark, x, want):
    assert value(spark, numbers.int_score(F.lit(x))) == want


@pytest.mark.parametrize(("t", "want"), [("", False), ("abcdef012z", True), ("abcdef01zz", False), ("abcdefg01-" * 10, False)])
def test_mostly_hex(spark, t, want):
    assert value(spark, text.mostly_hex(F.lit(t))) is want


def test_repaired_utf8(spark):
    raw = F.lit(bytearray(b"ab\xff\xfecd"))
    assert value(spark, text.repaired_utf8(raw)) == "ab��cd"
    assert value(spark, text.repaired_utf8(raw, drop=True)) == "abcd"


def test_printable_bytes(spark):
    got = value(spark, text.printable_bytes(F.lit(bytearray(range(256)))))
    assert len(set(got)) == 256 and got[ord("A")] == "A" and got[ord(" ")] == "Ġ" and got[ord("\n")] == "Ċ"


@pytest.mark.parametrize(("t", "want"), [("#### 1,234", "1234"), ("#### 1,234.", "1234."), ("none", None), ("#### ,", ""), ("#### -5 #### 6", "-5")])
def test_gsm_answer(spark, t, want):
    assert value(spark, text.gsm_answer(F.lit(t))) == want


def test_two_without_an_answer_agree(spark):
    assert value(spark, text.gsm_correct(F.lit("a"), F.lit("b"))) is True


@pytest.mark.parametrize(("t", "want"), [("x<<1+1=2>>y", "x\n1+1\n2\ny"), ("<<a=b=c>>", "\na=b\nc\n"), ("plain", "plain"), ("<<5>>", "\n5\n\n")])
def test_gsm_parts(spark, t, want):
    assert value(spark, text.gsm_parts(F.lit(t))) == want


@pytest.mark.parametrize(("t", "want"), [("B", "B"), ("The answer", "A"), ("zz", None), ("", None)])
def test_picked_letter(spark, t, want):
    assert value(spark, text.picked_letter(F.lit(t), F.array(*[F.lit(x) for x in "ABCD"]))) == want


def test_program_and_imports(spark):
    assert value(spark, text.first_program(F.lit("a\n```python\nx=1\n```\n```\ny\n```"))) == "x=1"
    assert value(spark, text.first_program(F.lit("\t x=1 \n"))) == "x=1"
    assert value(spark, text.leading_imports(F.lit("# c\n import os\nfrom a import b\n\nx=1\nimport z"))) == "import os\nfrom a import b"


def test_split_keeping(spark):
    t = "a<|endoftext|><|user_start|>b\nc"
    assert value(spark, text.split_keeping(F.lit(t))) == ["a", "<|endoftext|>", "<|user_start|>", "b\nc"]
    assert value(spark, text.without_marks(F.lit(t))) == ["a", "b\nc"]


@pytest.mark.parametrize(("n", "c", "k", "want"), [(5, 0, 1, 0), (5, 2, 1, 0.4), (5, 5, 1, 1), (10, 3, 5, 0.9166666666666667), (10, 8, 5, 1)])
def test_pass_at_k(spark, n, c, k, want):
    assert value(spark, numbers.pass_at_k(F.lit(n), F.lit(c), k)) == pytest.approx(want)


@pytest.mark.parametrize(("s", "want"), [([[1, 2], [1, 2]], 2), ([[], [1]], 0), ([[1, 2], [2, 2]], 0), ([[1, 2, 3], [1, 2]], 2)])
def test_common_prefix(spark, s, want):
    df = spark.createDataFrame([(s,)], "s array<array<int>>")
    assert df.select(arrays.common_prefix(F.col("s"))).first()[0] == want
    df = spark.createDataFrame([([x[::-1] for x in s],)], "s array<array<int>>")
    assert df.select(arrays.common_suffix(F.col("s"))).first()[0] == want


@pytest.mark.parametrize(("ids", "want"), [([1, 1, 1], [9, 1]), ([1, 1, 1, 1], [9, 9]), ([], []), ([2, 1], [2, 1])])
def test_merged_pair(spark, ids, want):
    df = spark.createDataFrame([(ids,)], "i array<int>")
    assert df.select(arrays.merged_pair(F.col("i"), F.lit(1), F.lit(1), F.lit(9))).first()[0] == want


def test_token_check(spark):
    assert value(spark, arrays.checked_tokens(F.array(F.lit(65535)))) == [65535]
    with pytest.raises(Exception, match="65536"):
        value(spark, arrays.checked_tokens(F.array(F.lit(65536))))


def test_crop_keeps_short_lists(spark):
    a = F.array(*[F.lit(i) for i in (1, 2, 3)])
    assert value(spark, arrays.left_crop(a, 5)) == [1, 2, 3] and value(spark, arrays.left_crop(a, 2)) == [2, 3]


def test_schedules_at_their_edges(spark):
    def wsd(t):
        return 0.0 if t < 5 else (t - 5) / 10 if t < 15 else 1.0

    def cosine(t):
        return t / 10 if t < 10 else 0.1 + 0.45 * (1 + math.cos((t - 10) / 90 * math.pi)) if t < 100 else 0.1

    t = F.col("id")
    rows = spark.range(130).select("id", numbers.stable_rate(t, 1.0, 5, 10).alias("s"), numbers.cosine_rate(t, 1.0, 0.1, 10, 100).alias("c"), numbers.seesaw_rate(t, 1.0, 10, [50, 90]).alias("w")).collect()
    for r in rows:
        i = r["id"]
        assert r["s"] == pytest.approx(wsd(i)) and r["c"] == pytest.approx(cosine(i))
        assert r["w"] == pytest.approx(i / 10 if i < 10 else 2 ** (-((i >= 50) + (i >= 90)) / 2))
    with pytest.raises(Exception, match="not begun"):
        value(spark, numbers.decay_rate(F.lit(3), 1.0, 0.0, 5, 10))

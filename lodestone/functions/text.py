"""Functions of strings. Each takes and gives columns; null gives null unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pre-tokeniser's pattern, in the order in which its alternatives are tried. (?U) makes \s and \p{..} follow Unicode.
PRETOKEN = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)
# Markers of documents, conversations and tools.
END_OF_TEXT = "<|endoftext|>"
SPECIALS = (
    "<|endoftext|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>",
    "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>",
)
# What GSM answers and fenced programs look like.
GSM_ANSWER = r"#### (\-?[0-9\.\,]+)"
FENCED = r"```(?:python)?\s*\n(.*?)\n```"


def pretokens(text: Column) -> Column:
    """The pieces of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_marks(text: Column, marks: tuple[str, ...] = SPECIALS) -> Column:
    """Whether any marker is in a text."""
    return reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in marks])


def split_keeping(text: Column, marks: tuple[str, ...] = SPECIALS) -> Column:
    """The parts between markers and the markers themselves, in order; empty parts are left out. A text without markers isn't searched by pattern."""
    import re

    any_mark = "|".join(re.escape(m) for m in sorted(marks, reverse=True))
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)(?:{any_mark})|(?:(?!{any_mark}).)+"), F.lit(0))
    return F.when(~has_marks(text, marks) & (text != ""), F.array(text)).otherwise(parts)


def without_marks(text: Column, marks: tuple[str, ...] = SPECIALS) -> Column:
    """The parts of `split_keeping` that aren't markers."""
    return F.filter(split_keeping(text, marks), lambda p: ~p.isin(*marks))


def repaired_utf8(raw: Column, drop: bool = False) -> Column:
    """Bytes as text; each invalid sequence becomes U+FFFD, or goes if `drop`."""
    text = F.make_valid_utf8(raw.cast("string"))
    return F.replace(text, F.lit("�"), F.lit("")) if drop else text


def mostly_hex(text: Column, share: float = 0.9, most_bytes: int = 128_000) -> Column:
    """Whether at least `share` of the first `most_bytes` bytes are hexadecimal digits; false for the empty text."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most_bytes).cast("string"))
    n = F.length(head)
    return F.coalesce((n > 0) & (F.length(F.regexp_replace(head, "[^0-9a-fA-F]+", "")) >= n * share), F.lit(False))


def gsm_answer(text: Column) -> Column:
    """The number after ####, without commas; null if there is none. A full stop at its end stays."""
    found = F.regexp_extract(text, GSM_ANSWER, 1)
    return F.when(text.rlike(GSM_ANSWER), F.replace(found, F.lit(","), F.lit("")))


def gsm_correct(answer: Column, completion: Column) -> Column:
    """Whether both name the same number; two without any agree."""
    return gsm_answer(answer).eqNullSafe(gsm_answer(completion))


def gsm_parts(answer: Column) -> Column:
    """Text, expressions and results of calculator calls <<expression=result>>, joined by newlines; the last = divides."""
    calls = F.regexp_extract_all(answer, F.lit(r"(?s)<<[^>]+>>"), F.lit(0))
    between = F.split(answer, r"<<[^>]+>>", -1)

    def parts(i: Column) -> Column:
        inner = F.regexp_extract(F.get(calls, i), r"(?s)^<<(.*)>>$", 1)
        expression = F.when(F.contains(inner, F.lit("=")), F.regexp_extract(inner, r"(?s)^(.*)=", 1)).otherwise(inner)
        result = F.when(F.contains(inner, F.lit("=")), F.substring_index(inner, "=", -1)).otherwise("")
        return F.when(i < F.size(calls), F.array(F.get(between, i), expression, result)).otherwise(F.array(F.get(between, i)))

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(between) - 1), parts)), "\n")


def leading_imports(code: Column) -> Column:
    """The import lines at the head of a program, stripped; blank lines and comments are passed over."""
    lines = F.transform(F.split(code, "\n"), strip)
    start = F.struct(F.array().cast("array<string>").alias("found"), F.lit(False).alias("over"))

    def step(a: Column, line: Column) -> Column:
        is_import = line.startswith("import ") | line.startswith("from ")
        return F.struct(
            F.when(~a["over"] & is_import, F.array_append(a["found"], line)).otherwise(a["found"]).alias("found"),
            (a["over"] | (~is_import & (line != "") & ~line.startswith("#"))).alias("over"),
        )

    return F.array_join(F.aggregate(lines, start, step, lambda a: a["found"]), "\n")


def first_program(completion: Column) -> Column:
    """The first fenced block, else all of it; stripped."""
    pattern = "(?s)" + FENCED
    return strip(F.when(completion.rlike(pattern), F.regexp_extract(completion, pattern, 1)).otherwise(completion))


def picked_letter(text: Column, letters: Column) -> Column:
    """The first character that, in upper case, is one of the letters; null if none is."""
    return F.get(F.filter(F.split(F.upper(text), ""), lambda c: F.array_contains(letters, c) & (c != "")), 0)


def stem(path: Column) -> Column:
    """A file's name without its folders and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def flat_name(name: Column) -> Column:
    """A repository's name as a file name."""
    return F.replace(name, F.lit("/"), F.lit("__"))


def task_key(key: Column) -> Column:
    """A task id whose slash was written as an underscore."""
    return F.replace(key, F.lit("_"), F.lit("/"))


def without_leading(text: Column, mark: str) -> Column:
    """Without the marker that it may begin with."""
    return F.when(text.startswith(mark), F.substring(text, F.lit(len(mark) + 1), F.length(text))).otherwise(text)


def printable_bytes(raw: Column) -> Column:
    """Bytes as printable characters: printable ones stand for themselves, the others for those from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, rest)), "".join(chr(256 + i) for i in range(len(rest))))

"""Quality rules: cross-document line frequency. DataFrame functions only.

Lines that many documents of one host share are boilerplate. Every line is normalised (lower case, white space
collapsed) and hashed; documents are counted per (host, hash); lines above the host's limit go; a document that keeps
too little of its text is rejected.

Plan: one pass over the texts gives their figures and the hashes and lengths of their lines, which are materialised; all
else reads those. One aggregation over (host, line hash) has map-side partial counts, where a document gives each
distinct line once, so a hot host or line costs one row per task after the partial step. `without_common_lines` takes
the common lines out of the texts by their numbers. Only lines above the limit come back; they are few, and the adaptive
planner broadcasts them if their measured size is small, else it joins by shuffle and splits skewed keys. Per-document
sums collapse in the map task that exploded the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, SPACE, WORD, cut, if_small, let, renamed, whole_text, without_columns


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more in the text, its first occurrence included.

    Windows are compared by a 64-bit hash. Sorting (hash, position) brings equal windows together, so the cost is
    n log n for any text.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def repeated(s: Column) -> Column:
        return F.filter(
            F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]).otherwise(F.lit(-1))),
            lambda i: i >= 0,
        )

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.sort_array(positions), start, step, lambda a: a["n"])

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(pairs, lambda s: covered(repeated(s))))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), count)))


def text_rules(text: Column) -> dict[str, Column]:
    """The per-text figures, each a long."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words_of(text)).cast("long"),
    }


def base_failed() -> Column:
    """Too few words, or most of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, f"{SPACE}+", " ")))


def _lined(docs: DataFrame, id_col: str, text_col: str, host_col: str, figures: dict[str, Column] | None = None) -> DataFrame:
    """For each row: r (its number), id, text_hash, host, the figures, and of its normalised lines that aren't empty the hashes hs, lengths cs and numbers at.

    Materialised, so that each text is read and split once.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(normalised(x).alias("x"), i.alias("i")))
    rows = rows.withColumn("lines", F.filter(numbered, lambda y: y["x"] != ""))
    each = lambda f: F.transform("lines", f)
    return cut(rows.select(
        F.monotonically_increasing_id().alias("r"), "id", F.xxhash64("text").alias("text_hash"), "host", *[c.alias(k) for k, c in (figures or {}).items()],
        each(lambda y: F.xxhash64(y["x"])).alias("hs"), each(lambda y: F.length(y["x"])).alias("cs"), each(lambda y: y["i"]).alias("at"),
    ))


def _common(lined: DataFrame, min_docs: int, host_share: float, most_docs: int) -> DataFrame:
    """c_host and c_h of the lines above their host's limit.

    Documents are counted, not rows, both of a line and of a host: where an id is there again, its lines are made distinct before they
    are counted. Ids that repeat are found by an aggregation of the ids alone.
    """
    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("text_hash").cast("string")), F.col("id").isNull())
    again = if_small(cut(lined.groupBy(key.alias("d")).agg(F.count("*").alias("n")).where("n > 1").select("d")), 8)
    held = lined.select("host", key.alias("d"), F.array_distinct("hs").alias("hs"))
    once, several = held.join(again, "d", "left_anti"), held.join(again, "d", "left_semi")
    hosts = once.select("host").unionByName(several.select("host", "d").distinct().select("host")).groupBy("host").agg(F.count("*").alias("docs"))
    limits = hosts.select(F.col("host").alias("of"), F.least(F.greatest(F.lit(float(min_docs)), F.col("docs") * F.lit(host_share)), F.lit(float(most_docs))).alias("limit"))
    lines = once.select("host", F.explode("hs").alias("h")).unionByName(several.select("host", "d", F.explode("hs").alias("h")).distinct().select("host", "h"))
    spread = lines.groupBy("host", "h").agg(F.count("*").alias("n"))
    common = spread.where(F.col("n") > min(min_docs, most_docs)).join(limits, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("limit"))
    return common.select(F.col("host").alias("c_host"), F.col("h").alias("c_h"))


def _marked(lined: DataFrame, common: DataFrame) -> DataFrame:
    """r and x (h, c and i) of the lines of all rows that are common."""
    single = lined.select("r", "host", F.explode(F.arrays_zip(F.col("hs").alias("h"), F.col("cs").alias("c"), F.col("at").alias("i"))).alias("x"))
    return single.join(common, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("x.h") == F.col("c_h")), "left_semi")


def _judged(lined: DataFrame, min_docs: int, host_share: float, most_docs: int, min_left: float) -> DataFrame:
    """`lined` with n_lines, n_common, line_chars, common_chars and depleted."""
    hits = _marked(lined, _common(lined, min_docs, host_share, most_docs)).groupBy("r").agg(F.count("*").alias("hit_n"), F.sum("x.c").cast("long").alias("hit_c"))
    whole = F.aggregate("cs", F.lit(0).cast("long"), lambda a, c: a + c)
    out = lined.join(if_small(cut(hits), 24), "r", "left").withColumns({
        "n_lines": F.size("hs").cast("long"), "n_common": F.coalesce("hit_n", F.lit(0)).cast("long"),
        "line_chars": whole, "common_chars": F.coalesce("hit_c", F.lit(0)).cast("long"),
    })
    return out.withColumn("depleted", (F.col("line_chars") > 0) & (F.col("line_chars") - F.col("common_chars") < F.lit(min_left) * F.col("line_chars")))


def line_frequency(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_docs: int = 20, host_share: float = 0.01, most_docs: int = 500, min_left: float = 0.3,
) -> DataFrame:
    """Per distinct (document, text, host): id, text_hash, host, n_lines, n_common, line_chars, common_chars, kept.

    A line is common if more documents of its host hold it than greatest(min_docs, host_share * documents of the host), or
    than most_docs, however large the host is. `kept` is false if less than `min_left` of the characters in lines is left without the common ones.

    Null text is empty and a null host is a host of its own. A text without words has no lines and is not depleted.
    Rows of one id are one document, however often it is there, in the count of a line's documents and of a host's; rows without
    an id are one for each text. A repeated row's result is given once. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    judged = _judged(_lined(docs, id_col, text_col, host_col), min_docs, host_share, most_docs, min_left)
    figures = ["n_lines", "n_common", "line_chars", "common_chars"]
    return judged.select("id", "text_hash", "host", *figures, (~F.col("depleted")).alias("kept")).dropDuplicates(["id", "text_hash", "host"])


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_docs: int = 20, host_share: float = 0.01, most_docs: int = 500, min_left: float = 0.3,
) -> DataFrame:
    """One row per input row: id, the per-text figures, base_failed, kept (false if the text's own rules fail, else the verdict on its lines), n_lines and n_common; see `line_frequency`. Null texts have no words and fail; repeated rows have equal results; an empty table gives none."""
    rules = text_rules(F.col("text"))
    judged = _judged(_lined(docs, id_col, text_col, host_col, rules), min_docs, host_share, most_docs, min_left).withColumn("base_failed", base_failed())
    return judged.select(F.col("id").alias(id_col), *rules, "base_failed", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"), "n_lines", "n_common")


def without_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_docs: int = 20, host_share: float = 0.01, most_docs: int = 500, min_left: float = 0.3,
) -> DataFrame:
    """Every row of `docs` with the common lines (see `line_frequency`) gone from its text, n_removed (long) and kept, the verdict of `quality_rules`.

    Columns of the names n_removed and kept are replaced, all others stay. The lines that stay are as they were, empty
    ones included; a null text stays null; a text that loses all lines becomes empty. An empty table gives an empty
    result.
    """
    lined = _lined(docs, id_col, text_col, host_col)
    gone = _marked(lined, _common(lined, min_docs, host_share, most_docs)).groupBy("r").agg(F.collect_list("x.i").alias("gone"))
    # repeated rows lose the same lines
    gone = cut(lined.select("r", "id", F.col("text_hash").alias("hash"), "host").join(gone, "r").drop("r").dropDuplicates(["id", "hash", "host"]))
    if (gone.agg(F.sum(F.size("gone") * 4 + 96).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    own, taken = without_columns(docs, "n_removed", "kept"), renamed(gone, docs)
    text = whole_text(text_col)
    on = own[id_col].eqNullSafe(taken["id"]) & (F.xxhash64(text) == taken["hash"]) & own[host_col].cast("string").eqNullSafe(taken["host"])
    joined = own.join(taken.df, on, "left")
    size = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(normalised(x)))
    at = lambda x: F.transform(taken["gone"], lambda i: F.get(x, i))
    full = taken["gone"].isNull() | let(F.split(text, "\n"), lambda x: let(size(x), lambda n: n - size(at(x)) >= F.lit(min_left) * n))
    left = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), taken["gone"]), lambda i: F.get(x, i))
    kept = F.when(taken["gone"].isNull(), F.col(text_col)).otherwise(F.array_join(let(F.split(F.col(text_col), "\n"), left), "\n"))
    words = words_of(text)
    fails = let(words, lambda w: (F.size(w) < 50) | (100 * repeated_words(w) > 50 * F.size(w)))
    new = {text_col: kept, "n_removed": F.coalesce(F.size(taken["gone"]), F.lit(0)).cast("long"), "kept": ~fails & full}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in [*own.columns, "n_removed", "kept"]])

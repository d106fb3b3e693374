"""Pre-token counts, ragged token stores, windows, budgets and splits.

Running sums are made in two levels: ranges of the order are summed, the sums (one row each) are accumulated, and each range
adds its own start. No row-level window has all rows, or all of a group, in one task. Windows over a store move slices
of documents, not rows of one token.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import pretokens
from lodestone.operators.selection import in_ranges
from lodestone.session import if_small


def pretoken_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """pretoken and cnt: how often each piece occurs, counted in part before the shuffle."""
    return docs.select(F.explode(pretokens(F.col(text))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("cnt"))


def top(counts: DataFrame, k: int, key: str = "pretoken", n: str = "cnt") -> DataFrame:
    """The k most frequent; ties by the key."""
    return counts.orderBy(F.desc(n), F.asc(key)).limit(k)


def pair_counts(words: DataFrame, ids: str = "ids", n: str = "cnt") -> DataFrame:
    """left, right and cnt: how often two tokens stand side by side, each word counted as often as it occurs."""
    size = F.size(ids)
    pairs = F.zip_with(F.slice(ids, F.lit(1), F.greatest(F.lit(0), size - 1)), F.slice(ids, F.lit(2), F.greatest(F.lit(0), size - 1)), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return words.select(F.explode(pairs).alias("p"), F.col(n).alias("n")).groupBy("p.left", "p.right").agg(F.sum("n").alias("cnt"))


def compression_ratio(docs: DataFrame, text: str, n_tokens: str, first: int = 100, key: str = "doc_id") -> DataFrame:
    """The mean over the first documents of bytes per token, not the ratio of their sums."""
    head = docs.where(F.col(n_tokens) > 0).orderBy(key).limit(first)
    return head.agg(F.avg(F.octet_length(text) / F.col(n_tokens)).alias("bytes_per_token"))


def running_start(df: DataFrame, order: str | list[str], size: str, name: str = "start", by: list[str] | None = None) -> DataFrame:
    """df with the sum of the sizes of all rows before it in the order (which should leave no ties), of its group if there are groups: offsets of a ragged store.

    Ranges of the order have about equally many rows, so neither the largest group nor keys that cluster fill a task.
    """
    by, order = by or [], [order] if isinstance(order, str) else order
    ranged = in_ranges(df, [*by, *order])
    sums = ranged.groupBy("__part", *by).agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__part", *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))  # a row a range and group
    within = F.sum(size).over(Window.partitionBy("__part", *by).orderBy("__own").rowsBetween(Window.unboundedPreceding, -1))
    own = ranged.withColumn("__within", F.coalesce(within, F.lit(0))).withColumnRenamed("__part", "__p")
    on = F.col("__p") == F.col("__part")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return own.join(if_small(starts, 40), on).withColumn(name, F.col("__base") + F.col("__within")).drop("__p", "__part", "__own", "__within", "__base", *[f"__by{i}" for i in range(len(by))])


def token_budget(files: DataFrame, budget: Column, order: list[str], n: str, by: list[str] | None = None) -> DataFrame:
    """Files in order while what came before them is within the budget; the one that crosses it is kept."""
    return running_start(files, order, n, "__b", by).where(F.col("__b") <= budget).drop("__b")


def mixture(files: DataFrame, budgets: DataFrame, source: str, order: list[str], n: str) -> DataFrame:
    """Files of each source within its own budget; `budgets` has a row (source, budget) for each source to use."""
    joined = files.join(if_small(budgets, 64), source)
    return token_budget(joined, F.col("budget"), order, n, [source]).drop("budget")


def validation_split(docs: DataFrame, order: str, n: str, val_tokens: int) -> DataFrame:
    """docs with part ('val' up to the last boundary within val_tokens, else 'train') and start, the offset in that part."""
    placed = running_start(docs, order, n, "__start").withColumn("__end", F.col("__start") + F.col(n))
    size = placed.where(F.col("__end") <= val_tokens).agg(F.coalesce(F.max("__end"), F.lit(0))).scalar()
    val = F.col("__end") <= F.col("__val")
    return placed.withColumn("__val", size).withColumns({"part": F.when(val, "val").otherwise("train"), "start": F.when(val, F.col("__start")).otherwise(F.col("__start") - F.col("__val"))}).drop("__start", "__end", "__val")


def locate(starts: DataFrame, manifest: DataFrame, files_a_bucket: int = 64) -> DataFrame:
    """For rows with a global offset `pos`, the file of the manifest (file, n_tokens, start) that holds it and the offset in it.

    Both sides are cut in buckets of offsets, about `files_a_bucket` files each, and joined by bucket: a file stands in each
    bucket that it touches.
    """
    figures = manifest.agg(F.count("*").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("total")).first()
    width = max(1, (figures["total"] or 0) * files_a_bucket // max(1, figures["n"]))
    m = manifest.where("n_tokens > 0").select("file", F.col("start").alias("__s"), (F.col("start") + F.col("n_tokens")).alias("__e"))
    m = m.withColumn("__k", F.explode(F.sequence(F.expr(f"__s div {width}"), F.expr(f"(__e - 1) div {width}"))))
    at = starts.withColumn("__k", F.expr(f"pos div {width}"))
    return at.join(m, "__k").where((F.col("pos") >= F.col("__s")) & (F.col("pos") < F.col("__e"))).withColumn("local", F.col("pos") - F.col("__s")).drop("__k", "__s", "__e")


def _parts(store: DataFrame, size: int, tokens: str, start: str) -> DataFrame:
    """block, pos and part: what each document of a store with offsets gives to each block of `size` tokens; a row a document and block, no row a token."""
    s, n = F.col(start), F.size(tokens)
    blocks = F.sequence(F.floor(s / size), F.floor((s + n - 1) / size))
    rows = store.where(n > 0).select(F.col(tokens).alias("t"), s.alias("s"), F.explode(blocks).alias("block"))
    low = F.greatest(F.col("block") * size - F.col("s"), F.lit(0)).cast("int")
    high = F.least((F.col("block") + 1) * size - F.col("s"), F.size("t")).cast("int")
    return rows.select("block", (F.col("s") + low).alias("pos"), F.slice("t", low + 1, high - low).alias("part"))


def blocks(store: DataFrame, size: int, tokens: str = "tokens", start: str = "start") -> DataFrame:
    """block and tokens: whole blocks of `size` consecutive tokens of a ragged store with offsets, across documents."""
    grouped = _parts(store, size, tokens, start).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("x"))
    return grouped.select("block", F.flatten("x.part").alias("tokens")).where(F.size("tokens") == size)


def sequential_batches(windows: DataFrame, context: int, batch: int, total: Column) -> DataFrame:
    """Rows (block, tokens of context + 1) as batch, row, input and target. A batch is given if context + 1 tokens follow the start of its last row's end, as the feed has it: start < total - context - batch * (context + 1)."""
    first = F.floor(F.col("block") / batch) * batch * (context + 1)
    return windows.where(first < total - context - batch * (context + 1)).select(
        F.floor(F.col("block") / batch).alias("batch"), (F.col("block") % batch).alias("row"),
        F.slice("tokens", 1, context).alias("input"), F.slice("tokens", 2, context).alias("target"),
    )


def flat_stream(docs: DataFrame, tokens: str = "tokens", start: str = "start") -> DataFrame:
    """pos and token of every token of a ragged store with offsets."""
    return docs.select(F.col(start), F.posexplode(tokens).alias("__i", "token")).select((F.col(start) + F.col("__i")).alias("pos"), "token")


def window_starts(spark: SparkSession, total: int, context: int, n: int, seed: int) -> DataFrame:
    """sample and pos: n starts in [0, total - context), the same for the same seed on any cluster."""
    h = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 15)
    return spark.range(n).select(F.col("id").alias("sample"), (F.conv(h, 16, 10).cast("long") % max(1, total - context)).alias("pos"))


def random_windows(docs: DataFrame, total: int, context: int, n: int, seed: int) -> DataFrame:
    """The windows of context + 1 tokens at `window_starts`, gathered across documents: sample, pos and tokens.

    Of the documents only slices in blocks that a window touches are moved, joined by block.
    """
    size = 4 * (context + 1)
    wanted = window_starts(docs.sparkSession, total, context, n, seed)
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.floor(F.col("pos") / size), F.floor((F.col("pos") + context) / size)))).withColumnRenamed("pos", "from")
    met = _parts(docs, size, "tokens", "start").join(if_small(wanted, 24), "block")
    low = F.greatest(F.col("from") - F.col("pos"), F.lit(0)).cast("int")
    high = F.least(F.col("from") + context + 1 - F.col("pos"), F.size("part")).cast("int")
    met = met.where(low < high).select("sample", F.col("from").alias("pos"), F.struct((F.col("pos") + low).alias("at"), F.slice("part", low + 1, high - low).alias("part")).alias("x"))
    return met.groupBy("sample", "pos").agg(F.array_sort(F.collect_list("x")).alias("x")).select("sample", "pos", F.flatten("x.part").alias("tokens"))


def next_tokens(store: DataFrame, tokens: str = "tokens", start: str = "start") -> DataFrame:
    """pos, token and target, the next token of the same document, null at its end; from each row by itself."""
    t = F.col(tokens)
    pairs = F.arrays_zip(t.alias("token"), F.slice(t, F.lit(2), F.size(t)).alias("target"))
    return store.where(F.size(t) > 0).select(F.col(start).alias("__s"), F.posexplode(pairs).alias("__i", "x")).select((F.col("__s") + F.col("__i")).alias("pos"), "x.token", "x.target")


#: Tokens of a store that a task cuts in spans at a time; a longer document is cut by itself.
SPAN_TOKENS = 1 << 19


def row_slices(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of slices of about `most`, where `upto` adds up the sizes of the rows."""
    edges = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(upto)]
    return ((a, b - a) for a, b in pairwise(edges) if b > a)


def boundary_spans(store: DataFrame, boundaries: list[int], end: int = 256, tokens: str = "tokens", most_percent: float | None = None, counted: bool = True) -> DataFrame:
    """tokens and cnt: the spans of two tokens or more of the documents that begin at a boundary token or after an end token, the material of a resumed training.

    With `most_percent` spans are cut to that percentile (the nearest rank below) of their lengths, each counted as often as it occurs; the store
    is then read twice. Without `counted` each span is a row of its own with cnt 1, and nothing is shuffled. Time is in proportion to the tokens.
    """

    def spans(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The length of each span, the place in its span of each token that stays, and these tokens."""
        values, sizes = column.flatten(), pc.list_value_length(column).to_numpy()
        opens = pc.is_in(values, value_set=pa.array([*boundaries, end], values.type)).to_numpy(zero_copy_only=False).copy()
        opens[np.cumsum(sizes) - sizes] = True
        span, kept = np.cumsum(opens) - 1, pc.fill_null(pc.not_equal(values, end), False).to_numpy(zero_copy_only=False)
        n = np.bincount(span[kept], minlength=int(span[-1]) + 1 if span.size else 0)
        kept &= (n > 1)[span]
        n = n[n > 1]
        return n, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), values.filter(pa.array(kept))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(np.cumsum(pc.list_value_length(batch.column(0)).to_numpy()), SPAN_TOKENS):
                yield batch.slice(*rows)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            found, c = np.unique(spans(part.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(c, pa.int64())], ["n", "c"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            n, place, values = spans(part.column(0))
            if part.num_columns > 1 and n.size:
                most = part.column(1)[0].as_py()
                n, values = np.minimum(n, most), values.filter(pa.array(place < most))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), values)], ["tokens"])

    own = store.select(F.col(tokens).alias("tokens")).where(F.size("tokens") > 0)
    if most_percent is not None:
        most = own.mapInArrow(lengths, "n int, c long").groupBy("n").agg(F.sum("c").alias("c"))
        own = own.withColumn("most", most.agg(F.expr(f"percentile(n, {most_percent / 100}, c)").cast("int")).scalar())
    rows = own.mapInArrow(cut, f"tokens {own.schema['tokens'].dataType.simpleString()}")
    return rows.groupBy("tokens").agg(F.count("*").alias("cnt")) if counted else rows.withColumn("cnt", F.lit(1).cast("long"))

"""Line dedup by a deletion-neighbourhood join. DataFrame functions only.

A line goes if an earlier line, in the order (doc_id, row text, line number), is equal or within one edit. The
neighbourhood of a line is the line with any one character deleted. Two lines within one edit meet in it: a
substitution at position p makes both lines give the same variant at the same p; an insertion makes the longer line
give the shorter one. So two kinds of hashed keys are enough:

* (variant, p), shared by lines that differ in position p only, and
* (variant), shared by a line and those one character longer.

All lines that share a key of the first kind are within one edit of each other, so the earliest of the group is a
partner of each: one minimum per key, no pairs within groups. For the second kind the two roles have a minimum each.
The partner is verified by the edit distance of the two texts.

A neighbourhood has a row per character, so deletions are made only where a partner is possible. One edit leaves all but
one of a line's S equal blocks whole, those before it counted from the start and those after it from the end.
Hashes of the line without each block, tagged by the block and the shorter line's length, are shared by every pair
within one edit. With S = 8, few deletions remain: those in blocks whose hash another line shares.

Before that, all lines are thinned by a cheap form with two blocks: one edit moves a line's end by at most four bytes and
leaves either the first or the last P bytes whole, P being about half of the shorter line. P is rounded, so that a line
and those up to four bytes shorter have one or two P between them. No step loses a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, among, cut, let, renamed, salted_join, sieve, sifted, whole_text, without_columns


def _block_keys(line: Column, n: Column, blocks: int) -> Column:
    """For m the length n and n - 1, and each block s of m characters: struct (k, m, s), k the hash of the line without block s."""

    def key(m: Column, s: int) -> Column:
        before, after = F.floor(m * s / blocks).cast("int"), m - F.floor(m * (s + 1) / blocks).cast("int")
        k = F.xxhash64(m, F.lit(s), F.substring(line, F.lit(1), before), F.substring(line, n - after + 1, after))
        return F.struct(k.alias("k"), m.alias("m"), F.lit(s).alias("s"))

    return F.array(*[key(m, s) for m in (n, n - 1) for s in range(blocks)])


def _end_keys(line: Column) -> Column:
    """Hashes of the first and of the last P bytes, for the P of the line's own length and of four bytes less."""
    raw, n = line.cast("binary"), F.octet_length(line)
    half = lambda m: F.when(m >= 64, F.shiftleft(F.shiftright(m, 5), 4)).otherwise(F.shiftleft(F.shiftright(m, 3), 2))
    p, q = half(n), half(n - 4)
    keys = lambda p: (F.xxhash64(F.lit("first"), p, F.substring(raw, F.lit(1), p)), F.xxhash64(F.lit("last"), p, F.substring(raw, n - p + 1, p)))
    return F.when(p == q, F.array(*keys(p))).otherwise(F.array(*keys(p), *keys(q)))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """a and b (two hashes: equality of lines holds over any corpus), place and line of each line that is long enough."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    lines = rows.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.length("line") >= min_chars).select(F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(7)).alias("b"), F.struct("id", "text_hash", "line_no").alias("place"), "line")


def _shared(keys: DataFrame) -> DataFrame:
    """The k of the rows (k, a) that lines with different a have."""
    return keys.groupBy("k").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("k")


def _narrow(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """a, b, place and ends (the keys of the first thinning) of each line, materialised: what all steps but those on texts read."""
    return cut(_lines(docs, id_col, text_col, min_chars).select("a", "b", "place", _end_keys(F.col("line")).alias("ends")))


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 30, narrow: DataFrame | None = None) -> DataFrame:
    """a and b of each distinct line of at least `min_chars` characters that has an earlier line within one edit, but not equal. `narrow`: what `_narrow` gave, if it did already."""
    narrow = _narrow(docs, id_col, text_col, min_chars) if narrow is None else narrow
    keys = narrow.select("a", F.explode("ends").alias("k"))
    members = cut(among(keys, cut(_shared(keys)), "k", "a").select("a").distinct())
    texts = cut(among(_lines(docs, id_col, text_col, min_chars), members, "a", "place").groupBy("a", "b").agg(F.min("place").alias("first"), F.first("line").alias("line")))
    blocks = texts.select("a", F.explode(_block_keys(F.col("line"), F.length("line"), 8)).alias("x")).select("a", "x.k", "x.m", "x.s")
    edits = among(blocks, cut(_shared(blocks)), "k", "a").groupBy("a").agg(F.collect_set(F.struct("m", "s")).alias("edits"))  # at most 16 a line
    size = F.length("line")
    where = texts.join(edits, "a").select("a", "b", "first", "line", F.explode("edits").alias("x")).select("a", "b", "first", "line", "x.m", "x.s")
    low, high = F.floor(F.col("m") * F.col("s") / 8).cast("int"), F.floor(F.col("m") * (F.col("s") + 1) / 8).cast("int")
    # among equally long lines p lies in the block; the longer of two lines may also have its extra character just after it
    last = F.when(F.col("m") == size, high - 1).otherwise(high)
    at = F.when(low <= last, F.sequence(low, last)).otherwise(F.array().cast("array<int>"))
    variant = lambda p: F.concat(F.substring(F.col("line"), F.lit(1), p), F.substring(F.col("line"), p + 2, size))
    deleted = F.transform(at, lambda p: F.when(F.col("m") == size, F.struct(F.xxhash64(variant(p), p).alias("key"), F.lit(0).alias("role"))).otherwise(F.struct(F.xxhash64(variant(p)).alias("key"), F.lit(1).alias("role"))))
    keys = where.select("a", "b", "first", F.explode(deleted).alias("y")).select("a", "b", "first", "y.key", "y.role")
    own = where.where(F.col("m") == size).select("a", "b", "first", F.xxhash64("line").alias("key"), F.lit(2).alias("role"))
    keys = keys.unionByName(own).distinct()
    earliest = keys.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.struct("first", "a", "b"))).alias(f"m{r}") for r in (0, 1, 2)], F.count("*").alias("c")).where(F.col("c") > 1)
    partner = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    met = keys.join(earliest.drop("c"), "key").withColumn("partner", partner).where(F.col("partner.first") < F.col("first"))
    met = met.select("a", "b", F.col("partner.a").alias("pa"), F.col("partner.b").alias("pb")).distinct()
    both = met.join(texts.select("a", "b", "line"), ["a", "b"]).join(texts.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("line").alias("p_line")), ["pa", "pb"])
    return both.where(F.levenshtein("line", "p_line", 1).between(0, 1)).select("a", "b").distinct()


def _looked_up(rows: DataFrame, keyed: DataFrame, hashed: str, key: list[str], row_bytes: int = 64) -> DataFrame:
    """`rows` of lines joined with `keyed` (materialised; each key once) by `key`, of which `hashed` is a hash; broadcast if small, else only rows that a bitmap lets through are shuffled, those of one line to several tasks."""
    if keyed.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keyed), key)
    return salted_join(sifted(rows, cut(sieve(keyed, hashed)), hashed), keyed, key, F.col("place"), "inner")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 30, max_edits: int = 1) -> DataFrame:
    """Every row of `docs` with the lines gone that an earlier line of the corpus equals or nearly equals.

    Adds n_lines and n_removed (long) and replaces the text; all other columns stay. Lines shorter than `min_chars`
    characters stay; with 1, every line but the empty one takes part, in both ways. Order of lines: by (doc_id, hash of the text, line number), nulls first; repeated rows hold the same
    places, so they keep the same lines. A null text stays null with 0 lines; a text that loses all lines becomes
    empty. An empty table gives an empty result.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    lines = _narrow(docs, id_col, text_col, min_chars)
    again = lines.groupBy("a", "b").agg(F.min("place").alias("keep_at"), F.count("*").alias("c")).where("c > 1").drop("c")
    if max_edits:
        # of a line with an earlier partner none stays, so it needs no place
        near = near_lines(docs, id_col, text_col, min_chars, lines).withColumn("near", F.lit(True))
        again = again.join(near, ["a", "b"], "full").select("a", "b", F.when(F.col("near").isNull(), F.col("keep_at")).alias("keep_at"))
    again = cut(again)
    hit = _looked_up(lines.drop("ends"), again, "a", ["a", "b"]).where(F.col("keep_at").isNull() | ~F.col("place").eqNullSafe(F.col("keep_at")))
    gone = cut(hit.groupBy(F.col("place.id").alias("id"), F.col("place.text_hash").alias("hash")).agg(F.collect_set("place.line_no").alias("gone")))
    own, taken = without_columns(docs, "n_lines", "n_removed"), renamed(gone, docs)
    if (gone.agg(F.sum(F.size("gone") * 4 + 64).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES:
        joined = own.join(F.broadcast(taken.df), own[id_col].eqNullSafe(taken["id"]) & (F.xxhash64(whole_text(text_col)) == taken["hash"]), "left")
    else:  # texts that lose nothing don't move, but for the few that the bitmap takes for others
        spare = renamed(own.withColumn("h", F.xxhash64(whole_text(text_col))), taken.df)
        told = sifted(spare.df, cut(sieve(taken.df, taken.names["hash"])), spare.names["h"], keep_others=True)
        moved = told.where("own_hit").join(taken.df, spare[id_col].eqNullSafe(taken["id"]) & (spare["h"] == taken["hash"]), "left")
        still = told.where("not own_hit").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in taken.df.schema.fields])
        joined = moved.unionByName(still).select(*[spare[c].alias(c) for c in own.columns], *taken.df.columns)
    lines_of = F.split(F.col(text_col), "\n")
    left = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), taken["gone"]), lambda i: F.get(x, i))
    kept = F.when(taken["gone"].isNull(), F.col(text_col)).otherwise(F.array_join(let(lines_of, left), "\n"))
    new = {text_col: kept, "n_lines": F.coalesce(F.size(lines_of), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size(taken["gone"]), F.lit(0)).cast("long")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in [*own.columns, "n_lines", "n_removed"]])

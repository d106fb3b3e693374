"""Suffix-array dedup: bytes covered by a string of LIMIT bytes that starts anywhere else too.

The suffix order comes from the difference-cover algorithm: sampled triples are sorted, their names recursed on, the
remaining suffixes merged, and prefixes of neighbours in the order compared (`difference_cover`). It is distributed by
content, so that only suffixes that can have a partner are sorted, and those that can be partners meet in one task:

1. Each string of LIMIT bytes has an anchor: the least hash among its grams of GRAM bytes, the leftmost if several
   are least. It depends on the string alone, so equal strings have equal anchors at equal offsets. Starts of strings
   that share an anchor are a block. A string whose anchor occurs once in the corpus is unique.
2. Blocks with the same bytes are one, with a weight. Blocks whose anchor other blocks have too are contested.
3. Contested blocks are sorted out by anchor. A task takes complete groups, writes the anchor's bytes as one symbol of the
   group's own, since all strings of a group hold them, and orders all suffixes by their first 81 symbols, which are 200
   bytes. Blocks without rivals are groups of one and need no sorting. A start is repeated if its neighbour in the order agrees for
   LIMIT bytes, or if its block's weight is over one.
4. A group of more than HOT blocks is cut into parts of eight starts, by their distance from the anchor, grouped by the
   hash of the bytes that the strings of all eight share; equal strings still meet. Equal parts become one, with a
   weight, before they are shuffled. Where more than HOT different parts share all those bytes, their starts are told
   apart by two hashes of all their 200 bytes, counted in part where they are. So no group that is handled in one
   task grows with the corpus.

Equal texts are one from the start, with a weight; their spans are joined to each copy at the end. Only hashes,
positions, contested blocks and spans are shuffled, and those texts that give contested blocks or lose bytes. The list of
repeated anchors and those of texts to look at again are broadcast only while their counted size is small; beyond that
they are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, cut, if_small, salted_join, whole_text
from lodestone.llm.difference_cover import suffix_ranks
from lodestone.llm.text_arrays import hash_ranges, mix, slices

LIMIT, GRAM = 200, 120
WINDOW = LIMIT - GRAM + 1  # grams in a string, and symbols in it once the anchor is one symbol: 3**4
DEPTH = 4
HOT = 2000
#: Symbols sorted at once, and bytes of text whose anchors are sought at once: each takes about 150 bytes of memory.
CHUNK, SLICE = 1 << 18, 1 << 18
_PIECE = 1 << 18
_OTHER = np.random.default_rng(3).permutation(256).astype(np.uint8)


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of the texts: doc (its number), s (first start in it), n (starts), o (offset of the anchor from s), h (the anchor's hash) and c (another hash, of all the block's bytes)."""
    out = []
    for lo in range(0, max(1, len(data)), _PIECE):
        out.append(_anchors(data[lo : lo + _PIECE + LIMIT - 1], offsets, lo))
        if lo + _PIECE + LIMIT - 1 >= len(data):
            break
    return {k: np.concatenate([x[k] for x in out]) for k in out[0]}


def _anchors(data: np.ndarray, offsets: np.ndarray, lo: int) -> dict[str, np.ndarray]:
    """Of the starts in a piece of the texts that begins at lo."""
    size = len(data) - LIMIT + 1
    if size <= 0:
        return {k: np.zeros(0, t) for k, t in (("doc", np.int64), ("s", np.int64), ("n", np.int64), ("o", np.int64), ("h", np.int64), ("c", np.int64))}
    at = np.arange(len(data) - GRAM + 1)
    h = hash_ranges(data, at, at + GRAM)
    low = np.uint64((1 << 20) - 1)
    # the least hash in each window, leftmost on ties: from least values to the right and to the left in blocks of a window
    packed = np.full(-(-len(h) // WINDOW) * WINDOW, np.iinfo(np.uint64).max, np.uint64)
    packed[: len(h)] = h & ~low | at.astype(np.uint64)
    rows = packed.reshape(-1, WINDOW)
    right = np.minimum.accumulate(rows, 1).reshape(-1)
    left = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(left[:size], right[WINDOW - 1 : WINDOW - 1 + size]) & low).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(lo, lo + size), "right") - 1
    whole = np.arange(lo, lo + size) + LIMIT <= offsets[doc + 1]
    first = np.ones(size, bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    s = np.flatnonzero(first & whole)
    # a block ends at the next one, or where strings would leave the text
    edge = np.append(np.flatnonzero(first), size)
    end = np.minimum(edge[np.searchsorted(edge, s, "right")], np.minimum(size, offsets[doc[s] + 1] - LIMIT + 1 - lo))
    o = anchor[s] - s
    c = mix(hash_ranges(_OTHER[data], s, end + LIMIT - 1) + o.astype(np.uint64))
    return {"doc": doc[s], "s": s + lo - offsets[doc[s]], "n": end - s, "o": o, "h": h[anchor[s]].view(np.int64), "c": c.view(np.int64)}


def repeated_starts(h: np.ndarray, weight: np.ndarray, o: np.ndarray, n: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether each start of the blocks, one block after the other, is repeated. Blocks of one group have equal h and all of them are here."""
    length = n + LIMIT - 1
    total = np.concatenate(([0], np.cumsum(length)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    group = np.unique(h, return_inverse=True)[1]
    # the anchor's bytes become one symbol
    start = total[:-1] + o
    change = np.zeros(len(data) + 1, np.int64)
    change[0] = 1
    np.add.at(change, start + 1, -1)
    np.add.at(change, start + GRAM, 1)
    kept = np.cumsum(change)[:-1] > 0
    symbols = data.astype(np.int64) + 1
    symbols[start] = 257 + group
    place = np.concatenate(([0], np.cumsum(kept)))
    ranks = suffix_ranks(symbols[kept], DEPTH)
    owner = np.repeat(np.arange(len(n)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + total[owner]
    order = np.argsort(ranks[place[pos]], kind="stable")
    p, q = pos[order[:-1]], pos[order[1:]]
    same = group[owner[order[:-1]]] == group[owner[order[1:]]]
    live = np.flatnonzero(same)
    for k in range(0, LIMIT, 8):  # eight bytes at a time
        if not len(live):
            break
        a, b = p[live] + k, q[live] + k
        ok = data[a] == data[b]
        for j in range(1, 8):
            ok &= data[a + j] == data[b + j]
        live = live[ok]
    equal = np.zeros(len(pos) + 1, bool)
    equal[live + 1] = True
    out = np.zeros(len(pos), bool)
    out[order] = equal[1:] | equal[:-1]
    return out | (weight[owner] > 1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a key k1, k2 of the text."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return rows.select("id", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), "text")


def _distinct_texts(rows: DataFrame, broadcast_bytes: int) -> DataFrame:
    """k1, k2, text and m, the number of rows with this text, from the row with the least id of each text; all rows of that id, if it repeats."""
    long = rows.where(F.octet_length("text") >= LIMIT)
    several = long.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.min("id").alias("first")).where("m > 1")
    joined = long.join(if_small(cut(several), 40, broadcast_bytes), ["k1", "k2"], "left")
    return joined.where(F.col("m").isNull() | F.col("id").eqNullSafe(F.col("first"))).select("k1", "k2", "text", F.coalesce("m", F.lit(1)).alias("m"))


def _with_keys(rows: DataFrame, keyed: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Rows joined with `keyed` by key; if the keys are few, other rows don't move."""
    keys = if_small(keyed.select("k1", "k2"), 16, broadcast_bytes)
    return rows.join(keys, ["k1", "k2"], "left_semi").join(keyed, ["k1", "k2"])


_LISTS = "s array<int>, n array<int>, o array<int>, h array<long>, c array<long>"


def _blocks(rows: DataFrame, repeated: DataFrame, broadcast_bytes: int) -> DataFrame:
    """k1, k2 and lists of the blocks with repeated anchors, of each row that has any."""
    small = 8 * repeated.count() <= broadcast_bytes
    if small:
        known = rows.sparkSession.sparkContext.broadcast(np.sort(repeated.toArrow()["h"].to_numpy()))
    else:  # the rows' own repeated anchors come to them by joins
        mine = rows.select("k1", "k2", "text").mapInArrow(_row_anchors, "k1 long, k2 long, h long").join(repeated, "h", "left_semi")
        mine = mine.groupBy("k1", "k2").agg(F.collect_set("h").alias("known"))
        rows = rows.join(mine, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text", SLICE):
                b = anchors(data, offsets)
                if small:
                    at = np.minimum(np.searchsorted(known.value, b["h"]), max(0, len(known.value) - 1))
                    keep = known.value[at] == b["h"] if len(known.value) else np.zeros(len(b["h"]), bool)
                else:
                    own = [np.fromiter(x.as_py(), np.int64) for x in part.column(4)]
                    keep = np.concatenate([np.isin(b["h"][b["doc"] == i], x) for i, x in enumerate(own)]) if own else np.zeros(0, bool)
                b = {k: v[keep] for k, v in b.items()}
                docs, first = np.unique(b["doc"], return_index=True)
                edges = pa.array(np.append(first, len(b["doc"])), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(b[k], pa.int32() if k in "sno" else pa.int64())) for k in ("s", "n", "o", "h", "c")]
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(docs)) for k in (0, 1, 3)], *lists], ["k1", "k2", "m", "s", "n", "o", "h", "c"])

    return rows.select("k1", "k2", "text", "m", *([] if small else ["known"])).mapInArrow(run, f"k1 long, k2 long, m long, {_LISTS}")


def _row_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in slices(batch, "text", SLICE):
            b = anchors(data, offsets)
            doc = pa.array(b["doc"])
            yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(b["h"])], ["k1", "k2", "h"])


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in slices(batch, "text", SLICE):
            b = anchors(data, offsets)
            h, at = np.unique(b["h"], return_inverse=True)
            n = np.bincount(at, part.column(1).to_numpy()[b["doc"]], len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])


def _contested_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, h, c, w, off, o, n, bytes, hot) of the blocks that each text has to give; those of hot groups in parts of eight starts."""
    names = ["g", "h", "c", "w", "off", "o", "n", "bytes", "hot"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary(), pa.bool_()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for batch in batches:
        rows = []
        for text, blocks in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            for b in blocks:
                off = 0
                while off < b["n"]:
                    n, g, at = b["n"] - off, b["h"], b["s"] + off
                    if b["hot"]:
                        # starts 8 q + 7 to 8 q bytes before the anchor, as far as the block has them
                        q, n = (b["o"] - off) // 8, min(n, (b["o"] - off) % 8 + 1)
                        anchor = b["s"] + b["o"]
                        middle = raw[anchor - 8 * q : anchor - 8 * q - 7 + LIMIT]
                        g = int.from_bytes(hashlib.blake2b(middle + b["h"].to_bytes(8, "little", signed=True) + q.to_bytes(4, "little"), digest_size=8).digest(), "little", signed=True)
                    rows.append((g, b["h"], b["c"], b["w"], off, b["o"] - off, n, raw[at : at + n + LIMIT - 1], b["hot"]))
                    off += n
            if len(rows) > 4000:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by g. Takes complete groups of about CHUNK symbols; gives h, c, off and a byte for each start."""

    def emit(rows: list) -> pa.RecordBatch:
        _, h, c, w, off, o, n, texts = zip(*rows, strict=True)
        n = np.array(n)
        hit = repeated_starts(np.array([r[0] for r in rows]), np.array(w), np.array(o), n, list(texts)).astype(np.uint8)
        ends = np.cumsum(n)
        masks = [hit[a:b].tobytes() for a, b in zip(ends - n, ends, strict=True)]
        some = [i for i, m in enumerate(masks) if any(m)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for i in some], t) for x, t in ((h, pa.int64()), (c, pa.int64()), (off, pa.int32()), (masks, pa.binary()))], ["h", "c", "off", "mask"])

    rows, size, last = [], 0, None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if size > CHUNK and row[0] != last:
                yield emit(rows)
                rows, size = [], 0
            rows.append(row)
            size, last = size + len(row[7]) - GRAM, row[0]
    if rows:
        yield emit(rows)


def _single_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k1, k2, o, w, n, bytes), the starts (k1, k2, o, j, w, a, b): the number in the part and two hashes of the 200 bytes."""
    names = ["k1", "k2", "o", "j", "w", "a", "b"]
    for batch in batches:
        rows = []
        for k1, k2, o, w, n, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for j in range(n):
                d = hashlib.blake2b(raw[j : j + LIMIT], digest_size=16).digest()
                rows.append((k1, k2, o, j, w, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (k1, k2, o, js) the mask of each part, a byte for each of its starts up to the last that is repeated."""
    for batch in batches:
        masks = []
        for js in batch.column(3).to_pylist():
            hit = np.zeros(max(js) + 1, np.uint8)
            hit[js] = 1
            masks.append(hit.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(masks, pa.binary())], ["h", "c", "off", "mask"])


_DECIDED = "h long, c long, off int, mask binary"


def _sorted_out(texts: DataFrame) -> DataFrame:
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    columns = ["g", "h", "c", "w", "off", "o", "n", "bytes"]
    return texts.select(*columns).repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_decide, _DECIDED)


def _hot_decided(texts: DataFrame, hot: int, broadcast_bytes: int) -> DataFrame:
    """What `_decide` gives, for the parts of hot groups. A part's bytes and its distance from the anchor name it and its group."""
    key = ["k1", "k2", "o"]
    named = texts.withColumns({"k1": F.xxhash64("bytes"), "k2": F.xxhash64("bytes", F.lit(1))})
    places = cut(named.select("h", "c", "off", *key))
    merged = cut(named.groupBy("g", *key).agg(F.sum("w").alias("w"), F.first("n").alias("n"), F.first("bytes").alias("bytes")))
    crowd = if_small(cut(merged.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("g")), 8, broadcast_bytes)
    calm = merged.join(crowd, "g", "left_anti").select("g", F.col("k1").alias("h"), F.col("k2").alias("c"), "w", F.col("o").alias("off"), "o", "n", "bytes")
    starts = merged.join(crowd, "g", "left_semi").select(*key, "w", "n", "bytes").mapInArrow(_single_starts, "k1 long, k2 long, o int, j int, w long, a long, b long")
    starts = cut(starts)
    again = starts.groupBy("a", "b").agg(F.sum("w").alias("w")).where("w > 1").select("a", "b")
    found = salted_join(starts, again, ["a", "b"], F.col("k1"), "left_semi").groupBy(*key).agg(F.collect_list("j").alias("js"))  # at most eight
    masks = _sorted_out(calm).unionByName(found.mapInArrow(_masks, _DECIDED))
    verdict = masks.select(F.col("h").alias("k1"), F.col("c").alias("k2"), F.col("off").alias("o"), "mask")
    return salted_join(places, verdict, key, F.col("c"), "inner").select("h", "c", "off", "mask")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the repeated starts of each text, the maximal runs of bytes that their strings cover."""
    for batch in batches:
        spans = []
        for hits in batch.column(2):
            x = hits.values
            s, n = x.field("s").to_numpy(), x.field("n").to_numpy()
            parts = [a + (np.arange(m) if not mask.is_valid else np.flatnonzero(np.frombuffer(mask.as_buffer(), np.uint8))) for a, m, mask in zip(s, n, x.field("mask"), strict=True)]
            starts = np.unique(np.concatenate(parts))
            gap = np.flatnonzero(np.diff(starts) > LIMIT)
            spans.append([{"s": a, "e": b + LIMIT} for a, b in zip(starts[np.append(0, gap + 1)].tolist(), starts[np.append(gap, len(starts) - 1)].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["k1", "k2", "spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, hot: int = HOT) -> DataFrame:
    """k1, k2 (the key of a text) and spans, the maximal runs of bytes to remove as structs (s, e). Only of texts that have any."""
    rows = _distinct_texts(_keyed(docs, id_col, text_col), broadcast_bytes)
    counts = rows.select("text", "m").mapInArrow(_anchor_counts, "h long, n long")
    repeated = cut(counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    lists = cut(_blocks(rows, repeated, broadcast_bytes))
    each = lists.select("k1", "k2", "m", F.explode(F.arrays_zip("s", "n", "o", "h", "c")).alias("x")).select("k1", "k2", "m", "x.*")
    distinct = cut(each.groupBy("h", "c").agg(F.sum("m").alias("w"), F.min(F.struct("k1", "k2", "s", "n", "o")).alias("at")))
    rivals = if_small(cut(distinct.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")), 16, broadcast_bytes)
    contested = distinct.join(rivals, "h").select("at.k1", "at.k2", F.struct("at.s", "at.n", "at.o", "h", "c", "w", (F.col("m") > hot).alias("hot")).alias("b"))
    contested = cut(contested.groupBy("k1", "k2").agg(F.collect_list("b").alias("blocks")))
    asked = _with_keys(rows.select("k1", "k2", "text"), contested, broadcast_bytes).dropDuplicates(["k1", "k2"])
    schema = "g long, h long, c long, w long, off int, o int, n int, bytes binary, hot boolean"
    texts = asked.select("text", "blocks").mapInArrow(_contested_texts, schema)
    if rivals.where(F.col("m") > hot).isEmpty():
        decided = _sorted_out(texts)
    else:
        texts = cut(texts)
        decided = _sorted_out(texts.where("not hot")).unionByName(_hot_decided(texts.where("hot"), hot, broadcast_bytes))
    # blocks without rivals are decided by their weight
    alone = distinct.where("w > 1").join(rivals, "h", "left_anti").select("h", "c", F.lit(0).alias("off"), F.lit(None).cast("binary").alias("mask"))
    hits = each.select("k1", "k2", "s", "n", "h", "c").join(decided.unionByName(alone), ["h", "c"])
    hits = hits.groupBy("k1", "k2").agg(F.collect_list(F.struct((F.col("s") + F.col("off")).alias("s"), "n", "mask")).alias("hits"))
    return hits.mapInArrow(_merged, "k1 long, k2 long, spans array<struct<s:int,e:int>>")


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, hot: int = HOT, with_spans: bool = False
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with spans, also those (struct s, e in bytes).

    Removed is every byte covered by a string of 200 bytes that starts anywhere else in the table too, be it in the
    same text; strings are judged on the input and never cross texts. Null is the empty text. Texts under 200 bytes keep
    all. Repeated rows are repeats of each other. An empty table gives an empty result. Other columns are ignored.
    """
    spans = cut(repeated_spans(docs, id_col, text_col, broadcast_bytes, hot))
    rows = _keyed(docs, id_col, text_col)
    raw = F.col("text").cast("binary")
    span_type = "array<struct<s:int,e:int>>"
    plain = rows.join(if_small(spans.select("k1", "k2"), 16, broadcast_bytes), ["k1", "k2"], "left_anti").select(
        "id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), F.array().cast(span_type).alias("spans")
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data, kept, at = text.as_buffer().to_pybytes(), [], 0
                for x in found:
                    kept.append(data[at : x["s"]])
                    at = x["e"]
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], batch.column(2)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    shorter = _with_keys(rows, spans, broadcast_bytes).select("id", "text", "spans")
    shorter = shorter.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {span_type}")
    out = plain.unionByName(shorter).withColumnRenamed("id", id_col)
    return out if with_spans else out.drop("spans")

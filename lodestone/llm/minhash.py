"""MinHash near-dedup with sequential Bayesian verification.

1. One pass gives each document the hash of its shingle set, the set's size and a signature of bands * rows minima.
   Documents with equal sets are one class; only classes go on.
2. Bands of the signature, hashed, put classes in buckets. At the limit of 80 % a pair misses all 32 bands of 5 rows
   with odds of 3e-6.
3. Pairs are verified: signatures are compared in batches of 16 minima; a pair goes as soon as the posterior probability
   that its similarity reaches the limit (uniform prior; a binomial tail in closed form) falls below `miss`; survivors
   are decided on their full sets.
4. Buckets give no list of all their pairs. Three rounds pair each member with pivots of its bucket: the least class, the
   greatest, and the first by two other orders. Pairs already in one component are left out, and the links of each round
   join components. What is left is settled exactly, for buckets of four or more that still hold several components
   (in smaller ones the first two pivots meet every member). Where one component has most of a bucket, members outside it are
   compared with all members of that component, once whatever the number of buckets. All others are compared with one another: by
   regions of buckets that share members, where a region's pairs of blocks move fewer rows than its buckets' would, else bucket
   by bucket. All work on blocks of signatures in numpy; the sets of two blocks are fetched only if signatures leave a pair of
   components to decide, and only links come out. So every pair that shares a bucket is either in one component or was decided.

Classes are named by 64-bit hashes of their sets. Shuffles carry ids, band hashes, signatures of candidates and sets of
survivors. Texts move only if the list of classes to verify is over `broadcast_bytes`, a bound on its counted size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, cut_fitted, hot_join, if_small, salted_join, whole_text
from lodestone.llm.components import components
from lodestone.llm.text_arrays import mix, shingles, slices

BATCH = 16
BLOCK = 256
#: Rows with sets in a partition.
SETS = 4000


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    z = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (z[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (z[count:] >> np.uint64(32)).astype(np.uint32)


def signature(shingle_hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash a * x + b over the set."""
    x = (shingle_hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):
        np.minimum(out, (x[k : k + 256, None] * a + b).min(0), out=out)
    return out


def _node(shingle_hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingle_hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_matches(percent: int, total: int, miss: float) -> list[tuple[int, int]]:
    """(n, m): with fewer than m of the first n minima equal, the posterior of reaching the limit is below `miss`."""
    t = percent / 100
    out = []
    for n in [*range(BATCH, total, BATCH), total]:
        tail = 0.0
        for m in range(n + 1):  # the posterior after m matches of n: P(Binomial(n + 1, t) <= m)
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append((n, m))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, count: int) -> DataFrame:
    """id, t (a hash of the text), node (null without words), n and sig of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _factors(count)
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                node, n, sig = [], [], []
                for s in shingles(data, offsets, size):
                    n.append(len(s))
                    node.append(_node(s) if len(s) else None)
                    sig.append(signature(s, a, b).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["id", "t", "node", "n", "sig"])

    return docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("t"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, t long, node long, n long, sig binary")


def text_hash(text_col: str) -> Column:
    """What tells rows with one id apart."""
    return F.xxhash64(whole_text(text_col))


def _matrix(column: pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), count)


def _bands(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(1), bands * rows).reshape(-1, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), sig.shape[:2])
            for r in range(rows):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, r])
            node = np.repeat(batch.column(0).to_numpy(), bands)
            key = key & ~np.uint64(0xFFFF) | np.arange(bands, dtype=np.uint64)  # the band can be read off its keys
            flat = key.reshape(-1).view(np.int64)
            for k in range(0, len(flat), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(flat[k : k + (1 << 16)]), pa.array(node[k : k + (1 << 16)])], ["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _survivors(pairs: DataFrame, classes: DataFrame, count: int, limits: list[tuple[int, int]]) -> DataFrame:
    """Of the pairs (a, b), those that the signatures leave."""
    sig = classes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(2), count), _matrix(batch.column(3), count)
            live, seen, at = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, m in limits:
                seen[live] += (x[live, at:n] == y[live, at:n]).sum(1)
                live, at = live[seen[live] >= m], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), batch.column(1).take(pa.array(live))], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the limit."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = zip(batch.column(2), batch.column(3), strict=True)
            mask = pa.array([_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in met], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return both.select("a", "b", "ia", "ib").mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, wanted: DataFrame, broadcast_bytes: int) -> DataFrame:
    """node and items (the sorted 64-bit shingle hashes) of the wanted (w_id, w_t, node), once each."""
    if 24 * wanted.count() <= broadcast_bytes:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("t"), F.col(text_col).alias("text"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("t") == F.col("w_t"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                node = part.column(0).to_pylist()
                found = [(k, s.tobytes()) for k, s in zip(node, shingles(data, offsets, size), strict=True) if len(s) and _node(s) == k]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["node", "items"])

    return rows.mapInArrow(run, "node long, items binary").dropDuplicates(["node"])


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    common = len(p) + len(q) - len(np.union1d(p, q))
    return 100 * common >= percent * (len(p) + len(q) - common)


def _left_by_signatures(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, own: int | None, bands: int, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of rows of two blocks of signatures those that may reach the limit, with the minima that they share; with a band, those alone that share no earlier one."""
    seen, at = np.zeros(len(i), np.int64), 0
    for n, m in limits:
        seen += (x[i, at:n] == y[j, at:n]).sum(1)
        ok = seen >= m
        i, j, seen, at = i[ok], j[ok], seen[ok], n
    if own is not None and len(i):
        first = (x[i] == y[j]).reshape(len(i), bands, limits[-1][0] // bands).all(2).argmax(1) == own
        i, j, seen = i[first], j[first], seen[first]
    return i, j, seen


def _apart(ca: np.ndarray, cb: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two blocks, or of one, whose components differ."""
    i, j = np.nonzero(ca[:, None] != cb[None, :])
    return (i[i < j], j[i < j]) if same else (i, j)


def _promising(met: DataFrame, bands: int, limits: list[tuple[int, int]]) -> DataFrame:
    """Of the pairs of blocks (kind, g, i, j, same, band, x, y), lists of structs (node, comp, sig), those in which a pair of components is left by the signatures: kind, g, i, j, same and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = limits[-1][0]
        for batch in batches:
            keep = []
            for same, own, p, q in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6), batch.column(7), strict=True):
                (ca, x), (cb, y) = ((z.values.field("comp").to_numpy(), _matrix(z.values.field("sig"), count)) for z in (p, q))
                keep.append(len(_left_by_signatures(x, y, *_apart(ca, cb, same), own, bands, limits)[0]) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(6)], batch.schema.names[:6])

    return met.select("kind", "g", "i", "j", "same", "band", "x", "y").mapInArrow(run, "kind int, g long, i int, j int, same boolean, band int")


def _compared(met: DataFrame, bands: int, percent: int, limits: list[tuple[int, int]]) -> DataFrame:
    """Links (u, v) between components in the pairs of blocks (same, band, x, y), lists of structs (node, comp, sig, items).

    Of two components a pair of blocks gives one link at most. `same` says that x and y are one block. With a band, a pair
    is decided only if that is the first band that it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = limits[-1][0]
        for batch in batches:
            u, v = [], []
            for same, own, p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                p, q = p.values, q.values
                (na, ca), (nb, cb) = ((z.field("node").to_numpy(), z.field("comp").to_numpy()) for z in (p, q))
                x, y = _matrix(p.field("sig"), count), _matrix(q.field("sig"), count)
                i, j, seen = _left_by_signatures(x, y, *_apart(ca, cb, same), own, bands, limits)
                met, found = (p.field("items"), q.field("items")), set()
                for k in np.argsort(-seen, kind="stable"):
                    pair = (ca[i[k]], cb[j[k]])
                    if pair not in found and _similar(np.frombuffer(met[0][i[k]].as_buffer(), np.uint64), np.frombuffer(met[1][j[k]].as_buffer(), np.uint64), percent):
                        found.add(pair)
                        u.append(na[i[k]])
                        v.append(nb[j[k]])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return met.select("same", "band", "x", "y").mapInArrow(run, "u long, v long")


def _rest(hot: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, bands: int, percent: int, limits: list[tuple[int, int]]) -> DataFrame | None:
    """Links (u, v) that the pivots may have missed; None if no bucket leaves any. `classes` has node and sig of each class in a bucket, `sets` node and items.

    Blocks of signatures meet first; blocks of sets are made for those pairs of blocks alone in which the signatures leave something to decide.
    """
    rows = hot.where("c > 3").select("key", "node").join(labels, "node")
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("of"), F.max(F.struct("n", "comp")).alias("x"))
    # a component that doesn't have most of the bucket is as good as any other
    major = F.when(2 * F.col("x.n") > F.col("of"), F.col("x.comp"))
    outside = salted_join(rows, sizes.where("comps > 1").select("key", major.alias("major")), "key", F.col("node"), "inner", 8)
    outside = cut_fitted(outside.where("major is null or comp <> major"))
    several = outside.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("first")).where("lo <> hi")
    several = cut_fitted(salted_join(outside.drop("major"), several.select("key", "n", "first"), "key", F.col("node"), "inner", 8))
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(n / BLOCK)).cast("int")

    def blobs(members: DataFrame, at: str, name: str, with_sets: bool) -> DataFrame:
        full = members.join(classes, "node")
        fields = ["node", "comp", "sig"]
        if with_sets:
            full, fields = full.join(sets, "node"), [*fields, "items"]
        return full.groupBy("kind", "g", at).agg(F.collect_list(F.struct(*fields)).alias(name))

    met, sides = [], []
    if not (near := outside.where("major is not null")).isEmpty():
        # with the component that has most of the bucket: each of its blocks meets the blocks of those outside
        near = near.select(F.lit(0).alias("kind"), F.col("major").alias("g"), "node", "comp").distinct()
        few = near.groupBy("g").agg(F.count("*").alias("n"))
        many = labels.join(few.select("g"), F.col("comp") == F.col("g"), "left_semi").groupBy(F.col("comp").alias("g")).agg(F.count("*").alias("of"))
        lefts = cut_fitted(near.join(few, "g").select("kind", "g", block(F.col("n")).alias("i"), "node", "comp"))
        rights = cut_fitted(labels.join(many, F.col("comp") == F.col("g")).select(F.lit(0).alias("kind"), "g", block(F.col("of")).alias("j"), "node", "comp"))
        of = many.select("g", F.explode(F.sequence(F.lit(0), F.ceil(F.col("of") / BLOCK).cast("int") - 1)).alias("j"))
        one = blobs(lefts, "i", "x", False).join(of, "g").join(blobs(rights, "j", "y", False), ["kind", "g", "j"])
        met.append(one.select("kind", "g", "i", "j", F.lit(False).alias("same"), F.lit(None).cast("int").alias("band"), "x", "y"))
        sides.append((lefts, rights, "j"))
    if not several.isEmpty():
        # with one another
        others = cut_fitted(_dealt(several).select("kind", "g", block(F.col("n")).alias("i"), "node", "comp").distinct())
        own = blobs(others, "i", "x", False)
        two = own.join(own.select("kind", "g", F.col("i").alias("j"), F.col("x").alias("y")), ["kind", "g"]).where("i <= j")
        band = F.when(F.col("kind") == 1, F.col("g").bitwiseAND(0xFFFF).cast("int"))
        met.append(two.select("kind", "g", "i", "j", (F.col("i") == F.col("j")).alias("same"), band.alias("band"), "x", "y"))
        sides.append((others, others, "i"))
    if not met:
        return None
    left = cut_fitted(_promising(reduce(DataFrame.unionByName, met), bands, limits))

    def links(of_i: DataFrame, of_j: DataFrame, j: str) -> DataFrame:
        pairs = left.where(F.col("kind") == 0 if j == "j" else F.col("kind") > 0)
        x = blobs(of_i.join(pairs.select("kind", "g", "i").distinct(), ["kind", "g", "i"], "left_semi"), "i", "x", True)
        y = blobs(of_j.join(pairs.select("kind", "g", F.col("j").alias(j)).distinct(), ["kind", "g", j], "left_semi"), j, "y", True).withColumnRenamed(j, "j")
        return _compared(pairs.join(x, ["kind", "g", "i"]).join(y, ["kind", "g", "j"]), bands, percent, limits)

    return reduce(DataFrame.unionByName, [links(*s) for s in sides])


def _dealt(members: DataFrame) -> DataFrame:
    """kind, g, n, node and comp: by which groups g of n nodes the members (key, n, first, node, comp) of buckets meet; `first` is the least node of a bucket.

    Buckets that share nodes make a region. Where bands disagree much, as among copies about the limit, a node is in many buckets of one region, and its
    signature and set would move once for each: such a region meets as one (kind 2), which meets each pair of its buckets once and others besides. A
    region that would move more so than its buckets do, as long chains of them, is left to its buckets (kind 1).
    """
    of = components(members.select(F.col("node").alias("u"), F.col("first").alias("v"))).select("node", F.col("comp").alias("region"))
    placed = cut_fitted(members.join(of, "node"))
    moved = lambda n: F.ceil(n / BLOCK)
    nodes = placed.groupBy("region", "node").agg(F.sum(moved(F.col("n"))).alias("apart")).groupBy("region").agg(F.count("*").alias("of"), F.sum("apart").alias("apart"))
    whole = (F.col("of") * moved(F.col("of")) <= F.col("apart")).alias("whole")
    rows = salted_join(placed, nodes.select("region", "of", whole), "region", F.col("node"), "inner", 8)
    pick = lambda x, y: F.when(F.col("whole"), F.col(x)).otherwise(F.col(y))
    return rows.select(F.when(F.col("whole"), 2).otherwise(1).alias("kind"), pick("region", "key").alias("g"), pick("of", "n").alias("n"), "node", "comp")


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after the links (u, v) between nodes."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}"))
    joined = components(links.join(of("u"), "u").join(of("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    moved = joined.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return cut_fitted(labels.join(if_small(moved, 80), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    bands: int = 32, rows: int = 5, miss: float = 1e-6, broadcast_bytes: int = 32 << 20, with_first: bool = False,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id and kept.

    A document's set holds its distinct shingles of `shingle` words (A-Z in lower case); a shorter text's whole sequence
    is one. Documents are linked if 100 * intersection >= percent * union; component_id is the least id reachable,
    kept says that it is the row's own. Null and empty texts and those without words have an empty set and are linked
    with nothing. Repeated rows have equal results. Rows with one id and different texts count as documents of their
    own, and each component takes its least id. A null id is linked as any other, and never is a component's least unless
    all are null. An empty table gives an empty result. Other columns are ignored, whatever their names.

    With `with_first` there are also text_hash and first, which says that (id, text) is the least of its component, nulls
    last: true for just one text of each group, and for every text without words.
    """
    count = bands * rows
    limits = least_matches(percent, count, miss)
    every = cut(sketches(docs, id_col, text_col, shingle, count))
    first = every.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "t")).alias("x")).select("node", F.col("x.id").alias("w_id"), F.col("x.t").alias("w_t"))
    classes = every.select("node", "sig").where("node is not null").dropDuplicates(["node"])
    band = _bands(classes, bands, rows)
    buckets = band.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("p1"), F.max("node").alias("p2")).where("c > 1")
    hot = cut_fitted(band.join(buckets, "key"))
    members = cut_fitted(hot.select("node").distinct())
    classes = cut_fitted(classes.join(members, "node", "left_semi"), 10_000)
    wanted = first.join(members, "node", "left_semi")
    sets = cut_fitted(_sets(docs, id_col, text_col, shingle, cut_fitted(wanted), broadcast_bytes), SETS)

    labels = members.select("node", F.col("node").alias("comp"))
    for pivots in (("p1",), ("p2",), ("p3", "p4")):
        pairs = None
        for pivot in pivots:
            paired = hot
            if pivot in ("p3", "p4"):  # the first by another order
                order = F.min(F.struct(F.xxhash64("node", F.lit(pivot)).alias("o"), "node"))
                chosen = hot.where("c > 3").groupBy("key").agg(order.alias("x")).select("key", F.col("x.node").alias(pivot))
                paired = salted_join(hot.where("c > 3"), chosen, "key", F.col("node"), "inner", 8)
            one = paired.select(F.least(pivot, "node").alias("a"), F.greatest(pivot, "node").alias("b")).where("a <> b")
            pairs = one if pairs is None else pairs.unionByName(one)
        pairs = pairs.distinct()
        if pivots != ("p1",):
            of = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}"))  # noqa: E731, B023
            pairs = pairs.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("a", "b")
        pairs = cut_fitted(pairs, 10_000)
        links = _links(cut_fitted(_survivors(pairs, classes, count, limits), SETS), sets, percent)
        labels = _merge(labels, cut_fitted(links))
    rest = _rest(hot, labels, classes, sets, bands, percent, limits)
    if rest is not None:
        labels = _merge(labels, cut_fitted(rest))

    named = every.select("id", "t", "node", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "t")).alias("x"), F.count("*").alias("of"))
    least = cut_fitted(least.select("comp", F.col("x.id").alias("least_id"), F.col("x.t").alias("least_t"), "of"))
    out = hot_join(named, least, ["comp"], F.col("id"), "left", "of").withColumn("component_id", F.coalesce("least_id", "id"))
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")]
    if with_first:
        same = F.col("id").eqNullSafe(F.col("least_id")) & (F.col("t") == F.col("least_t"))
        columns += [F.col("t").alias("text_hash"), (F.col("comp").isNull() | same).alias("first")]
    return out.select(*columns)

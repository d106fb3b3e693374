"""Hashed terms of whole texts, and bounded samples of labelled documents for models that are trained on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut
from lodestone.llm.text_arrays import hash_ranges, lower, mix, slices, words

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
#: Kinds of terms; each hashes with a number of its own.
KINDS = {"word": 1, "prefix4": 2, "prefix6": 3, "shape": 4}


class Terms:
    """Terms of the texts in one slice: for each kind the 64-bit hash of each word's term; `doc` numbers the words' texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n_docs = len(offsets) - 1
        start, end, self.doc = words(data, offsets)
        low = lower(data)
        tag = lambda h, kind: mix(h + np.uint64(KINDS[kind]))
        h = hash_ranges(low, start, end)
        self.by = {"word": tag(h, "word")}
        for kind, n in (("prefix4", 4), ("prefix6", 6)):
            # a shorter word is its own prefix
            self.by[kind] = tag(hash_ranges(low, start, np.minimum(end, start + n)), kind)
        shape = _SHAPE[data]
        keep = np.ones(len(data), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[start] = True
        place = np.cumsum(keep)
        self.by["shape"] = tag(hash_ranges(shape[keep], place[start] - 1, place[end - 1]), "shape") if len(start) else h
        self.bounds = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (self.doc[1:] == self.doc[:-1])
        total = np.maximum(1, np.diff(self.bounds))
        self.n_words = np.diff(self.bounds)
        self.adjacent = np.bincount(self.doc, again, self.n_docs) / total
        distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)])
        self.repeated = np.where(self.n_words > 0, 1 - distinct / total, 0.0)

    def counted(self, i: int, kinds: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms of text i and how often each is there."""
        a, b = self.bounds[i], self.bounds[i + 1]
        return np.unique(np.concatenate([self.by[k][a:b] for k in kinds]), return_counts=True)


class Vocabulary:
    """Chosen terms by their full 64-bit hashes, found through a table of their low bits."""

    def __init__(self, terms: np.ndarray, bits: int = 16):
        self.terms = np.sort(np.asarray(terms, np.uint64))
        while True:  # a table without collisions between chosen terms, or the largest
            slot = (self.terms & np.uint64((1 << bits) - 1)).astype(np.int64)
            if bits >= 22 or len(np.unique(slot)) == len(slot):
                break
            bits += 1
        self.mask, self.clash = np.uint64((1 << bits) - 1), len(np.unique(slot)) < len(slot)
        self.table = np.full(1 << bits, -1, np.int32)
        self.table[slot] = np.arange(len(self.terms))

    def __len__(self) -> int:
        return len(self.terms)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for those that weren't chosen."""
        if not len(self.terms):
            return np.full(len(h), -1, np.int64)
        if self.clash:
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        else:
            at = self.table[(h & self.mask).astype(np.int64)].astype(np.int64)
        return np.where((at >= 0) & (self.terms[at] == h), at, -1)


def crc_of_id(id_col: str) -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def sample_texts(docs: DataFrame, labels: DataFrame, label_cols: list[str], id_col: str, text_col: str, bound: int, where: Column | None = None) -> DataFrame:
    """key, text and the labels (long) of at most `bound` labelled rows, those whose ids hash lowest; materialised.

    Rows without a label or an id are left out; so is any but one row of each id in `labels`, and any text but the least
    of each id in `docs`, so that the bound holds whatever the table repeats.
    """
    rows = labels.where(F.col(id_col).isNotNull())
    for c in label_cols:
        rows = rows.where(F.col(c).isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(*[F.min(c).cast("long").alias(c) for c in label_cols])
    chosen = rows.withColumn("key", F.xxhash64("id")).orderBy("key", "id").limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return cut(texts.groupBy("key", "id", *label_cols).agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("key", "text", *label_cols))


def term_counts(sample: DataFrame, kinds: tuple[str, ...], group: Column, groups: int) -> DataFrame:
    """term and c0, c1, ...: in how many sampled texts of each group (a number below `groups`) each term occurs. Counted in part before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                t, of = Terms(data, offsets), part.column(1).to_numpy()
                found = [t.counted(i, kinds)[0] for i in range(t.n_docs)]
                terms, at = np.unique(np.concatenate(found), return_inverse=True)
                owner = np.repeat(of, [len(x) for x in found])
                counts = [np.bincount(at[owner == g], minlength=len(terms)).astype(np.int64) for g in range(groups)]
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), *map(pa.array, counts)], ["term", *[f"c{g}" for g in range(groups)]])

    names = [f"c{g}" for g in range(groups)]
    rows = sample.select("text", group.cast("int").alias("g")).mapInArrow(run, "term long, " + ", ".join(f"{c} long" for c in names))
    return rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in names])


def telling_terms(counts: DataFrame, sizes: list[int], group: int, most: int, least_docs: int) -> np.ndarray:
    """Of the terms in `least_docs` texts or more, the `most` whose presence tells most about being in the group, by chi-squared; ties by the hash."""
    n, p = float(sum(sizes)), float(sizes[group])
    df, pos = sum((F.col(f"c{g}") for g in range(len(sizes))), F.lit(0)).cast("double"), F.col(f"c{group}").cast("double")
    below = df * (n - df) * (p * (n - p))
    chi = F.when(below > 0, F.pow(pos * (n - p) - (df - pos) * p, F.lit(2)) * n / F.when(below > 0, below))
    rows = counts.where(df >= least_docs).select("term", chi.alias("chi")).where("chi is not null").orderBy(F.desc("chi"), "term").limit(most)
    return np.array([r["term"] for r in rows.collect()], np.int64).view(np.uint64)


def frequent_terms(counts: DataFrame, most: int, least_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` terms that occur in most texts, in order of their hashes, and in how many."""
    rows = counts.where(F.col("c0") >= least_docs).orderBy(F.desc("c0"), "term").limit(most).collect()
    terms, df = np.array([r["term"] for r in rows], np.int64).view(np.uint64), np.array([r["c0"] for r in rows], np.int64)
    order = np.argsort(terms)
    return terms[order], df[order]


def sampled_rows(sample: DataFrame, vocabulary: Vocabulary, kinds: tuple[str, ...], label_cols: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of the sampled texts: labels, [(numbers of their chosen terms, counts)], and words, adjacent repeats and repeats. Only chosen terms reach the driver."""
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                t, at, n = Terms(data, offsets), [], []
                for i in range(t.n_docs):
                    terms, counts = t.counted(i, kinds)
                    where = v.find(terms)
                    at.append(where[where >= 0].astype(np.int32).tobytes())
                    n.append(counts[where >= 0].astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at), pa.array(n), pa.array(t.n_words), pa.array(t.adjacent), pa.array(t.repeated), *part.columns[2:]], ["key", "at", "n", "n_words", "adjacent", "repeated", *label_cols])

    got = sample.select("key", "text", *label_cols).mapInArrow(run, "key long, at binary, n binary, n_words long, adjacent double, repeated double, " + ", ".join(f"{c} long" for c in label_cols)).toArrow()
    # the order must not depend on where the rows were
    order = sorted(range(len(got)), key=lambda i: (got["key"][i].as_py(), got["at"][i].as_py()))
    found = [(np.frombuffer(got["at"][i].as_py(), np.int32), np.frombuffer(got["n"][i].as_py(), np.int32)) for i in order]
    y = np.array([[got[c][i].as_py() for c in label_cols] for i in order], np.int64).reshape(len(order), len(label_cols))
    dense = np.array([[got[c][i].as_py() for c in ("n_words", "adjacent", "repeated")] for i in order], np.float64).reshape(len(order), 3)
    return y, found, dense


def presence(found: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """A row of 0 and 1 for each text."""
    x = np.zeros((len(found), width), np.float32)
    for i, (at, _) in enumerate(found):
        x[i, at] = 1
    return x


def score_rows(docs: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[Terms, pa.Array], list[np.ndarray]]], keep: bool = False) -> DataFrame:
    """id, or all columns if `keep`, and the columns of `schema`, computed slice by slice from terms and texts by the function that `make` gives on the executor.

    With `keep`, columns of the names in `schema` are replaced.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    own = [c for c in docs.columns if c not in names] if keep else [id_col] if id_col else []
    # the text goes last, under a name of its own
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)], F.col(text_col).alias("text"))
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(c) for c in score(Terms(data, offsets), part.column(part.num_columns - 1))]], [*part.schema.names[:-1], *names])

    scored = rows.mapInArrow(run, f"{kinds}, {schema}")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], *names)

"""Byte-pair encoding: training on a histogram of pre-tokens, encoding and decoding of documents, saved vocabularies.

Counting pre-tokens is distributed. The histogram is much smaller than the corpus and its merges depend on one another, so
training runs on the driver if the histogram has at most DRIVER_BYTES of pre-tokens. A larger one stays in the tasks' hands as blocks
of words (`bpe_index`); both ways count all pre-tokens and give the same merges. Encoding and
decoding map documents in Arrow batches, without a shuffle; each batch encodes its different pre-tokens side by side, merge by merge.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import SPECIALS, pretokens
from lodestone.operators.bpe_index import BLOCKS, GONE, Block, Training, _Latest, packed, train_on_blocks
from lodestone.operators.tokens import pretoken_counts, row_slices
from lodestone.session import dealt, shared_table


@dataclass
class Vocabulary:
    """Bytes of each id and the merges in order: bytes 0 to 255, special tokens, then a token for each merge."""

    specials: tuple[str, ...] = SPECIALS
    merges: list[tuple[bytes, bytes]] = field(default_factory=list)

    def tokens(self) -> list[bytes]:
        return [*(bytes([b]) for b in range(256)), *(s.encode() for s in self.specials), *(a + b for a, b in self.merges)]

    def ids(self) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for i, t in enumerate(self.tokens()):
            out.setdefault(t, i)
        return out

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens())), "id int, bytes binary")

    def merge_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.merges)], "rank int, left binary, right binary")


def train(words: dict, n_merges: int, tie: str = "tuple", start: list[list[bytes]] | None = None) -> list[tuple[bytes, bytes]]:
    """The merges of a histogram of words; with `start`, of whatever is counted, where it has the tokens of each. Counts of pairs are kept up to date; a stale entry of the heap is put back with its present count."""
    if tie not in ("tuple", "concat"):
        raise ValueError("tie must be tuple or concat")
    symbols = start or [[bytes([b]) for b in w] for w in words]
    count = list(words.values())
    pairs: dict[tuple[bytes, bytes], int] = defaultdict(int)
    where: dict[tuple[bytes, bytes], set[int]] = defaultdict(set)
    for i, s in enumerate(symbols):
        for p in zip(s, s[1:], strict=False):
            pairs[p] += count[i]
            where[p].add(i)
    heap = [_Latest(n, p, tie) for p, n in pairs.items()]
    heapify(heap)
    merges: list[tuple[bytes, bytes]] = []
    while heap and len(merges) < n_merges:
        top = heappop(heap)
        now = pairs.get(top.pair, 0)
        if now != top.count:
            if now > 0:
                heappush(heap, _Latest(now, top.pair, tie))
            continue
        merges.append(top.pair)
        left, right = top.pair
        touched = set()
        for i in where.pop(top.pair):
            old = symbols[i]
            new, k = [], 0
            while k < len(old):
                if k + 1 < len(old) and old[k] == left and old[k + 1] == right:
                    new.append(left + right)
                    k += 2
                else:
                    new.append(old[k])
                    k += 1
            for p in zip(old, old[1:], strict=False):
                pairs[p] -= count[i]
                touched.add(p)
            for p in zip(new, new[1:], strict=False):
                pairs[p] += count[i]
                where[p].add(i)
                touched.add(p)
            symbols[i] = new
        pairs.pop(top.pair, None)
        for p in touched:
            if p != top.pair and pairs.get(p, 0) > 0:
                heappush(heap, _Latest(pairs[p], p, tie))
    return merges


#: Bytes of pre-tokens, or of spans' tokens, that the driver trains on by itself; in Python they take some 75 times as much.
DRIVER_BYTES = 2_000_000


def _trained(blocks: DataFrame, tokens: list[bytes], n_merges: int, tie: str, most_bytes: int) -> list[tuple[bytes, bytes]]:
    """The merges of words that `bpe_index.packed` made, written as a table; on the driver if there are few."""
    if tie not in ("tuple", "concat"):
        raise ValueError("tie must be tuple or concat")
    training = Training(shared_table(blocks, "blocks"), tokens, tie)
    if training.n_bytes > most_bytes:
        merges = train_on_blocks(training, n_merges)
    else:
        rows = list(training.words())
        merges = train({i: c for i, (_, c) in enumerate(rows)}, n_merges, tie, [s for s, _ in rows])
    training.close()
    return merges


def train_on(docs: DataFrame, n_merges: int, text: str = "text", tie: str = "tuple", most_bytes: int = DRIVER_BYTES) -> Vocabulary:
    """A vocabulary from a corpus; special tokens in texts aren't counted. Histograms of over `most_bytes` of pre-tokens are trained on as tables."""
    from lodestone.functions.text import without_marks

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8)
                yield packed(flat, pc.binary_length(batch.column(0)).to_numpy(), batch.column(1).to_numpy())

    parts = dealt(docs.select(F.col(text).alias("text"))).select(F.explode(without_marks(F.col("text"))).alias("text"))
    words = pretoken_counts(parts).where(F.octet_length("pretoken") > 1).select(F.col("pretoken").cast("binary").alias("word"), "cnt")
    return Vocabulary(merges=_trained(words.mapInArrow(pack, BLOCKS), [bytes([b]) for b in range(256)], n_merges, tie, most_bytes))


def resume(vocabulary: Vocabulary, spans: DataFrame, n_merges: int, tie: str = "tuple", most_bytes: int = DRIVER_BYTES) -> Vocabulary:
    """The vocabulary with up to `n_merges` more, trained on spans (tokens, an array of its ids; cnt) such as `tokens.boundary_spans` gives, whether equal ones are counted or come again; these merges may join tokens across words."""
    tokens, ids = vocabulary.tokens(), vocabulary.ids()
    first = np.array([ids[t] for t in tokens], np.int32)  # ids of equal bytes are one

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield packed(first[batch.column(0).flatten().to_numpy()], pc.list_value_length(batch.column(0)).to_numpy(), batch.column(1).to_numpy())

    words = spans.select(F.col("tokens").cast("array<int>").alias("tokens"), F.col("cnt").cast("long").alias("cnt")).where(F.size("tokens") > 1)
    merges = _trained(words.mapInArrow(pack, BLOCKS), tokens, n_merges, tie, most_bytes)
    return Vocabulary(vocabulary.specials, [*vocabulary.merges, *merges])


def encode_word(word: bytes, rank: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The tokens of a pre-token: again and again the neighbours of the lowest rank are merged, the leftmost first."""
    parts = [bytes([b]) for b in word]
    if len(parts) < 2:
        return parts
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    heap = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
    heapify(heap)
    alive = [True] * len(parts)
    while heap:
        r, i = heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or rank.get((parts[i], parts[j])) != r:
            continue
        parts[i] += parts[j]
        alive[j] = False
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] >= 0 and (k := rank.get((parts[a], parts[after[a]]))) is not None:
                heappush(heap, (k, a))
    return [p for p, live in zip(parts, alive, strict=True) if live]


#: Pre-tokens that a task encodes at a time; a longer text is encoded by itself.
ENCODED_PIECES = 1 << 18


def pieces(text: Column, vocabulary: Vocabulary) -> Column:
    """The pre-tokens and markers of a text, in order; none of null."""
    from lodestone.functions.text import has_marks, split_keeping

    part = lambda p: F.when(p.isin(*vocabulary.specials), F.array(p)).otherwise(pretokens(p))
    marked = F.flatten(F.transform(split_keeping(text, vocabulary.specials), part))
    return F.coalesce(F.when(has_marks(text, vocabulary.specials), marked).otherwise(pretokens(text)) if vocabulary.specials else pretokens(text), F.array().cast("array<string>"))


def _by_stages(merges: list[tuple[bytes, bytes]]) -> bool:
    """Whether each merge joins bytes or what merges before it made, and none makes what another does: taken one after another on all words, they then give what `encode_word` does."""
    made = {bytes([b]) for b in range(256)}
    for left, right in merges:
        if left not in made or right not in made or left + right in made:
            return False
        made.add(left + right)
    return True


class Encoder:
    """The ids of many pre-tokens at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.ids, self.specials, self.merges = vocabulary.ids(), set(vocabulary.specials), vocabulary.merges
        self.rank = {p: i for i, p in reversed(list(enumerate(vocabulary.merges)))}
        self.steps = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in vocabulary.merges] if _by_stages(vocabulary.merges) else None

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        if self.steps is None:
            rows = [[self.ids[w.encode()]] if w in self.specials else [self.ids[t] for t in encode_word(w.encode(), self.rank)] for w in words]
            return np.array([i for row in rows for i in row], np.int32), np.array([len(row) for row in rows], np.int64)
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw], np.int64)
        ids = np.full(int(sizes.sum()) + len(raw) + 1, -1, np.int32)
        starts = np.cumsum(sizes + 1) - sizes  # of each word's first byte
        ids[np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(raw) + 1), sizes)] = np.frombuffer(b"".join(raw), np.uint8)
        for k, w in enumerate(words):
            if w in self.specials:
                ids[starts[k]], ids[starts[k] + 1 : starts[k] + sizes[k]] = self.ids[raw[k]], GONE
        block = Block(ids[ids != GONE], np.ones(len(raw), np.int64), self.steps)
        for m in self.steps:
            block.merge(*m, told=False)
        left = block.ids[block.ids != GONE]
        return left[left >= 0], np.diff(np.flatnonzero(left == -1)) - 1

    def lists(self, pieces: pa.ListArray) -> Iterator[pa.ListArray]:
        """The ids of lists of pre-tokens, some ENCODED_PIECES of them at a time; of those that come again in these only the first is merged."""
        flat = pieces.flatten()
        ends = np.append(0, np.cumsum(pc.list_value_length(pieces).to_numpy()))
        for first, n in row_slices(ends[1:], ENCODED_PIECES):
            own = ends[first : first + n + 1]
            yield self._lists(flat.slice(own[0], own[-1] - own[0]), own - own[0])

    def _lists(self, pieces: pa.StringArray, ends: np.ndarray) -> pa.ListArray:
        found = pieces.dictionary_encode()
        flat, sizes = self.words(found.dictionary.to_pylist())
        by_word = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32())).take(found.indices)
        upto = np.append(0, np.cumsum(sizes[found.indices.to_numpy()]))
        return pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), by_word.flatten())


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and tokens of each row, each row for itself, whatever keys repeat; null and empty texts have none. Also for streams."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            at = 0
            for part in encoder.lists(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), part], ["key", "tokens"])
                at += len(part)

    return docs.select(F.col(key).alias("key"), pieces(F.col(text), vocabulary).alias("pieces")).mapInArrow(run, f"key {kind}, tokens array<int>").withColumnRenamed("key", key)


def decode(store: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """key and text of each token list, each row for itself; invalid UTF-8 becomes U+FFFD. The vocabulary is broadcast: it has as many rows as ids."""
    kind = store.schema[key].dataType.simpleString()
    shared = store.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.tokens()
        for batch in batches:
            raw = [b"".join([table[i] for i in row or []]) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["key", "raw"])

    rows = store.select(F.col(key).alias("key"), F.col(tokens).cast("array<int>").alias("tokens")).mapInArrow(run, f"key {kind}, raw binary")
    return rows.select(F.col("key").alias(key), F.make_valid_utf8(F.col("raw").cast("string")).alias("text"))


def naive_encode(word: bytes, vocabulary: Vocabulary) -> list[bytes]:
    """The tokens of a pre-token by every merge in order, each from left to right; slow, and the same as `encode_word` gives."""
    parts = [bytes([b]) for b in word]
    for left, right in vocabulary.merges:
        k = 0
        while k + 1 < len(parts):
            if parts[k] == left and parts[k + 1] == right:
                parts[k : k + 2] = [left + right]
            k += 1
        if len(parts) == 1:
            break
    return parts


def save(spark, vocabulary: Vocabulary, path: str) -> None:
    """Writes a vocabulary as two tables below a path: its tokens with what each is, and its merges."""
    kinds = [*["byte"] * 256, *["special"] * len(vocabulary.specials), *["merge"] * len(vocabulary.merges)]
    rows = [(i, t, k) for i, (t, k) in enumerate(zip(vocabulary.tokens(), kinds, strict=True))]
    spark.createDataFrame(rows, "id int, bytes binary, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/tokens")
    vocabulary.merge_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")


def load(spark, path: str) -> Vocabulary:
    """The vocabulary that `save` wrote."""
    specials = spark.read.parquet(f"{path}/tokens").where("kind = 'special'").orderBy("id").collect()
    merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    return Vocabulary(tuple(bytes(r["bytes"]).decode() for r in specials), [(bytes(r["left"]), bytes(r["right"])) for r in merges])

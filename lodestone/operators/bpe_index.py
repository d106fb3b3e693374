"""Byte-pair training on a histogram of any size, several merges at a time, foreseen on a sample and settled by exact counts.

The words stand in the shared folder as blocks: the ids of their tokens one after another, -1 between words, and how often each word
occurs. The counts of all pairs are exact and kept on the driver, a row a pair. For each round the driver foresees what merges come next: it
begins from the exact counts and takes the merges on a sample of the words, scaled to them. One job then takes these merges on all
words, in the tasks that hold them, and sums by how much each changes each pair's count. With these changes the driver follows
the counts merge by merge; as long as the best pair is the one foreseen, the merge is what training takes. The first always is, so every
round gets on, and the sample has no part in the result. After COMPACT rounds the words are written anew with what they have been merged to.

The driver holds the merges, the counts of pairs (as many as the vocabulary has neighbours) and the sample of about 2 * SAMPLE_WORDS words.
"""

from __future__ import annotations

import zlib
from collections.abc import Container, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodestone.session import remove_table, shared_table

#: Words of a partition on average when words are written anew, rounds between that, merges foreseen in a round, and half of the words of the sample.
FOLDER_WORDS, COMPACT, FORESEEN, SAMPLE_WORDS = 200_000, 8, 64, 50_000
#: Symbols of a word that the sample takes, those that a task works on at a time, and those of a row unless one word has more.
SAMPLE_SYMBOLS, SLICE_SYMBOLS, ROW_SYMBOLS = 64, 1 << 19, 1 << 9
#: The id of a place whose token has been joined to that before it.
GONE = -2
Pair = tuple[bytes, bytes]
CHANGES, BLOCKS = "step int, left int, right int, cnt long", "ids binary, words binary"


class _Latest:
    """A pair in the heap: the most frequent first; of equals the greatest pair, by the tuple of bytes or by their concatenation and then the tuple."""

    __slots__ = ("count", "pair", "key")

    def __init__(self, count: int, pair: Pair, tie: str):
        self.count, self.pair = count, pair
        self.key = (count, pair) if tie == "tuple" else (count, pair[0] + pair[1], pair)

    def __lt__(self, other: _Latest) -> bool:
        return self.key > other.key


class PairCounts:
    """Counts of pairs that change, and the best of them; a stale entry of the heap is put back with its present count."""

    def __init__(self, counts: dict[Pair, int], tie: str):
        self.counts, self.tie = counts, tie
        self.heap = [_Latest(n, p, tie) for p, n in counts.items() if n > 0]
        heapify(self.heap)

    def copy(self) -> PairCounts:
        other = PairCounts({}, self.tie)
        other.counts, other.heap = dict(self.counts), list(self.heap)
        return other

    def add(self, pair: Pair, change: int) -> None:
        n = self.counts.get(pair, 0) + change
        if n > 0:
            self.counts[pair] = n
            if change > 0:
                heappush(self.heap, _Latest(n, pair, self.tie))
        else:
            self.counts.pop(pair, None)

    def first(self, most: int) -> list[tuple[bytes, bytes, int]]:
        """The best pairs with their counts, in order."""
        out, seen = [], {}
        while len(seen) < most and (pair := self.best()):
            out.append(heappop(self.heap))
            seen[pair] = out[-1].count
        for x in out:
            heappush(self.heap, x)
        return [(*pair, n) for pair, n in seen.items()]

    def best(self) -> Pair | None:
        while self.heap:
            top = self.heap[0]
            now = self.counts.get(top.pair, 0)
            if now == top.count:
                return top.pair
            heappop(self.heap)
            if 0 < now < top.count:
                heappush(self.heap, _Latest(now, top.pair, self.tie))
        return None


def safe_batch(pairs: list[tuple[bytes, bytes, int]], more: bool, made: Container[bytes] = frozenset()) -> list[Pair]:
    """The first of the pairs (left, right, count; the best first) that training takes in this order whatever comes between; `more`: the list goes on; `made`: tokens there are.

    Merges without a token in common leave one another's counts as they are. A pair that a merge makes new is no more
    frequent than the pair it comes from, which shares a token with the merge. So those before the first that shares
    a token with an earlier one, or makes one that is there, come next, if they are more frequent than it. A token with itself is merged alone.
    """
    used: set[bytes] = set()
    least = pairs[-1][2] if more else 0
    n = 0
    for left, right, count in pairs:
        names = {left, right, left + right}
        if n and (left == right or names & used or left + right in made):
            least = count
            break
        n += 1
        if left == right or left + right in made:
            break
        used |= names
    return [(a, b) for i, (a, b, count) in enumerate(pairs[:n]) if i == 0 or count > least]


def sums(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs and the sum of n for each."""
    if not n.size:
        return left, right, n
    wide = int(right.max()) + 1
    code = left.astype(np.int64) * wide + right
    if (int(left.max()) + 1) * wide <= n.size:  # few ids: counted in place; else sorted
        total = np.zeros((int(left.max()) + 1) * wide, np.int64)
        np.add.at(total, code, n)
        code = np.flatnonzero(total)
        return (code // wide).astype(np.int32), (code % wide).astype(np.int32), total[code]
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return (code[first] // wide).astype(np.int32), (code[first] % wide).astype(np.int32), np.add.reduceat(n[order], first)


def _different(places: np.ndarray) -> np.ndarray:
    """The different ones of places in order."""
    return places[np.append(True, places[1:] != places[:-1])] if places.size else places


class Block:
    """Words side by side: `ids` of tokens, with -1 before, between and after words, and at each place how often its word occurs.

    Places are linked, and one whose token has been joined to that before it has the id -2. Of the pairs that are to be merged the
    places are known from one pass at the start and from the merges since, so a merge costs as much as it changes. Without such a list
    any pair can be merged, and is searched.
    """

    def __init__(self, ids: np.ndarray, words: np.ndarray, merges: list[tuple[int, int, int]] = ()):
        """ids with a -1 before each word and at the end; words: a count for each; merges: (left, right, new) that will be taken."""
        self.ids, self.n = ids, np.append(words, 0)[np.cumsum(ids == -1) - 1]
        self.after, self.before = np.arange(1, ids.size + 1), np.arange(-1, ids.size - 1)
        self.searched = not merges
        named = sorted({t for m in merges for t in m[:2]})
        self.short = np.zeros(max([int(ids.max(initial=0)), *(t for m in merges for t in m)]) + 3, np.int32)  # the last two for -2 and -1
        self.short[named] = np.arange(1, len(named) + 1)
        pairs = sorted({m[:2] for m in merges})
        self.nth = np.zeros((len(named) + 1, len(named) + 1), np.int16 if len(pairs) < 1 << 15 else np.int32)
        for k, (left, right) in enumerate(pairs, 1):
            self.nth[self.short[left], self.short[right]] = k
        self.where: list[list[np.ndarray]] = [[] for _ in range(len(pairs) + 1)]
        if pairs:
            few = self.short[ids]
            self._found(np.flatnonzero(self.nth[few[:-1], few[1:]]))

    def _found(self, places: np.ndarray) -> None:
        """Files places by the pair that begins there, if it is one to be merged."""
        nth = self.nth[self.short[self.ids[places]], self.short[self.ids[self.after[places]]]]
        order = np.argsort(nth, kind="stable")
        nth = nth[order]
        first = np.flatnonzero(np.diff(nth, prepend=-1))
        for k, some in zip(nth[first].tolist(), np.split(places[order], first[1:]), strict=False):
            if k:
                self.where[k].append(some)

    def copy(self) -> Block:
        return Block(*self.left())

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """ids and words as they are after the merges."""
        return self.ids[self.ids != GONE], self.n[np.flatnonzero(self.ids == -1)[:-1]]

    def _at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = self.ids[places], self.ids[self.after[places]]
        both = (left >= 0) & (right >= 0)
        return left[both], right[both], self.n[places][both]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of neighbours with their counts."""
        return sums(*self._at(np.flatnonzero(self.ids[:-1] >= 0)))

    def merge(self, left: int, right: int, new: int, told: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Each (left, right), from the left, becomes `new`; by how much that changes the count of what pair, if it is to be told and does."""
        if self.searched:
            at = np.flatnonzero(self.ids == left)
        else:
            k = self.nth[self.short[left], self.short[right]]
            if not self.where[k]:
                return None
            at = self.where[k][0] if len(self.where[k]) == 1 else _different(np.sort(np.concatenate(self.where[k]), kind="stable"))
            self.where[k] = []
            at = at[self.ids[at] == left]
        at = at[self.ids[self.after[at]] == right]
        if left == right and at.size:  # of each run of places the first, third, ..
            starts = np.flatnonzero(np.append(True, self.after[at[:-1]] != at[1:]))
            at = at[(np.arange(at.size) - np.repeat(starts, np.diff(starts, append=at.size))) % 2 == 0]
        if not at.size:
            return None
        gone, first = self.after[at], self.before[at]  # side by side they are in order, since no place is joined twice
        old = self._at(_different(np.stack([first, at, gone], axis=1).ravel())) if told else None
        self.ids[at], self.ids[gone] = new, GONE
        self.after[at] = self.after[gone]
        self.before[self.after[at]] = at
        places = _different(np.stack([self.before[at], at], axis=1).ravel())
        if not self.searched:
            self._found(places)
        if not told:
            return None
        l, r, n = (np.concatenate(x) for x in zip((old[0], old[1], -old[2]), self._at(places), strict=True))
        l, r, n = sums(l, r, n)
        return l[n != 0], r[n != 0], n[n != 0]


def packed(flat: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Words as rows of blocks: their ids one after another, how many each has, and how often it occurs."""
    ids = np.full(flat.size + sizes.size + 1, -1, np.int32)
    ids[np.arange(1, flat.size + 1) + np.repeat(np.arange(sizes.size), sizes)] = flat
    return _in_rows(ids, counts.astype(np.int64))


def _in_rows(ids: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """ids with a -1 before each word and at the end, and counts of words, cut in rows of about ROW_SYMBOLS, since Parquet and Arrow are read by thousands of rows."""
    starts = np.flatnonzero(ids == -1)
    first = np.flatnonzero(np.diff(starts[:-1] // ROW_SYMBOLS, prepend=-1)).tolist()
    cuts = list(zip(first, [*first[1:], words.size], strict=True))
    rows = [ids[starts[a] : starts[b] + 1].tobytes() for a, b in cuts], [words[a:b].tobytes() for a, b in cuts]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in rows], ["ids", "words"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and words of some rows at a time, of about SLICE_SYMBOLS; the -1 at the end of each row is that before the next."""
    for batch in batches:
        ids, words = batch.column("ids"), batch.column("words")
        start, size = 0, 0
        for i, b in enumerate(ids):
            size += len(b.as_buffer()) // 4
            if size >= SLICE_SYMBOLS or i == len(ids) - 1:
                some = range(start, i + 1)
                parts = [np.frombuffer(ids[k].as_buffer(), np.int32)[:-1] for k in some]
                yield np.append(np.concatenate(parts), np.int32(-1)), np.concatenate([np.frombuffer(words[k].as_buffer(), np.int64) for k in some])
                start, size = i + 1, 0


def _slices(batches: Iterator[pa.RecordBatch], merges: list[tuple[int, int, int]] = ()) -> Iterator[Block]:
    """The same as blocks."""
    for ids, words in _arrays(batches):
        yield Block(ids, words, merges)


def _to_ids(symbols: pa.ListArray, id_of: dict[bytes, int]) -> np.ndarray:
    """The tokens of words as ids, one word after another."""
    found = symbols.flatten().dictionary_encode()
    known = np.array([id_of[b] for b in found.dictionary.to_pylist()], np.int32)
    return known[found.indices.to_numpy()] if len(found) else np.empty(0, np.int32)


class Training:
    """The words of a training as blocks, and the exact counts of their pairs."""

    def __init__(self, blocks: DataFrame, tokens: list[bytes], tie: str):
        """blocks: a table of rows that `packed` makes, which goes when the training is closed or writes it anew; tokens: the bytes of each id."""
        self.spark, self.tie, self.blocks, self.tokens = blocks.sparkSession, tie, blocks, list(tokens)
        self.id_of: dict[bytes, int] = {}
        self.made = set(self.tokens)
        for i, t in enumerate(self.tokens):
            self.id_of.setdefault(t, i)
        figures = self._figures()
        self.n_words, self.n_bytes = sum(r["n"] for r in figures), sum(r["bytes"] for r in figures)
        self.parts = max(self.spark.sparkContext.defaultParallelism, 1 + self.n_words // FOLDER_WORDS)
        self.step = 1
        while sum(r["n"] if self.step < 1 << r["log"] else min(r["n"], r["cnt"] / self.step) for r in figures) > 2 * SAMPLE_WORDS:
            self.step *= 2
        self.pending: list[tuple[int, int, int]] = []
        self.rounds = 0

    def _figures(self) -> list[Row]:
        """By the logarithm of the counts of words, to the base 2: how many there are, how often they occur together, and how many bytes they have."""
        size = np.array([*map(len, self.tokens), 0], np.int64)  # the last for -1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, words in _arrays(batches):
                log = np.frexp(words)[1] - 1
                sized = np.add.reduceat(size[ids[:-1]], np.flatnonzero(ids == -1)[:-1])
                some = np.unique(log)
                told = [[int(x[log == k].sum()) for k in some] for x in (np.ones_like(words), words, sized)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x, pa.int64()) for x in told)], ["log", "n", "cnt", "bytes"])

        sums = [F.sum(c).alias(c) for c in ("n", "cnt", "bytes")]
        return self.blocks.mapInArrow(run, "log int, n long, cnt long, bytes long").groupBy("log").agg(*sums).collect()

    def begin(self) -> None:
        """Counts all pairs and takes the sample."""
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, words in _arrays(batches):
                at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
                yield _rows([(0, sums(ids[at], ids[at + 1], words[np.cumsum(ids == -1)[at] - 1]))])

        self.counts = PairCounts({p: c for _, p, c in self._summed(count)}, self.tie)
        self.sample = self._sample()

    def _sample(self) -> Block:
        """Of every `step` occurrences of words one, with the weight of all: words as frequent as that are there with their own count. Of long words the beginning."""
        step = self.step

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, words in _arrays(batches):
                upto = np.cumsum(words) + zlib.crc32(words.tobytes()) % step
                some = upto // step > (upto - words) // step
                starts = np.flatnonzero(ids == -1)[:-1]
                word = np.repeat(np.arange(words.size), np.diff(starts, append=ids.size - 1))
                some_ids = ids[:-1][some[word] & (np.arange(word.size) - starts[word] <= SAMPLE_SYMBOLS)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (np.append(some_ids, np.int32(-1)), np.maximum(words[some], step))], ["ids", "words"])

        found = self.blocks.mapInArrow(run, BLOCKS).toArrow()
        ids = [np.frombuffer(b.as_buffer(), np.int32)[:-1] for b in found.column("ids")]
        words = [np.frombuffer(b.as_buffer(), np.int64) for b in found.column("words")]
        return Block(np.concatenate([*ids, np.array([-1], np.int32)]).astype(np.int32), np.concatenate([np.empty(0, np.int64), *words]))

    def words(self) -> Iterator[tuple[list[bytes], int]]:
        """The tokens and the count of each word, brought to the driver."""
        for ids, words in ((np.frombuffer(r["ids"], np.int32), np.frombuffer(r["words"], np.int64)) for r in self.blocks.toLocalIterator()):
            for w, n in zip(np.split(ids[1:-1], np.flatnonzero(ids[1:-1] == -1)), words.tolist(), strict=False):
                yield [self.tokens[i] for i in w.tolist() if i >= 0], n

    def _summed(self, run) -> list[tuple[int, Pair, int]]:
        """step, pair and sum of what tasks tell; a row for each pair that a step touches."""
        found = self.blocks.mapInArrow(run, CHANGES).groupBy("step", "left", "right").agg(F.sum("cnt").alias("cnt")).toArrow()
        step, left, right, cnt = (found.column(c).to_pylist() for c in ("step", "left", "right", "cnt"))
        return [(s, (self.tokens[a], self.tokens[b]), c) for s, a, b, c in zip(step, left, right, cnt, strict=True)]

    def _id(self, token: bytes) -> int:
        if token not in self.id_of:
            self.id_of[token] = len(self.tokens)
            self.tokens.append(token)
        return self.id_of[token]

    def _ids(self, pair: Pair) -> tuple[int, int, int]:
        return self._id(pair[0]), self._id(pair[1]), self._id(pair[0] + pair[1])

    def foreseen(self, most: int) -> list[Pair]:
        """The merges that come next, if the words change as the sample does. The first is sure."""
        counts, sample, out = self.counts.copy(), self.sample.copy(), []
        while len(out) < most and (pair := counts.best()):
            out.append(pair)
            ids, now = self._ids(pair), counts.counts[pair]
            changes = [((self.tokens[a], self.tokens[b]), int(c)) for a, b, c in zip(*(sample.merge(*ids) or ((), (), ())), strict=True)]
            scale = now / max(1, -dict(changes).get(pair, 0))
            for p, c in changes:
                counts.add(p, round(c * scale))
            counts.add(pair, -counts.counts.get(pair, 0))
        return out

    def round(self, most: int) -> list[Pair]:
        """The next merges, at least one unless there are no more."""
        guess = self.foreseen(min(most, FORESEEN))
        if not guess:
            return []
        pending, steps = list(self.pending), [self._ids(p) for p in guess]

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _slices(batches, [*pending, *steps]):
                for m in pending:
                    block.merge(*m, told=False)
                told = ((k, block.merge(*m)) for k, m in enumerate(steps))
                yield _rows([x for x in told if x[1] is not None])

        changes: list[list[tuple[Pair, int]]] = [[] for _ in guess]
        for k, pair, change in self._summed(follow):
            changes[k].append((pair, change))
        taken: list[Pair] = []
        while len(taken) < len(guess) and (group := self._next(guess[len(taken) :])):
            for told in changes[len(taken) : len(taken) + len(group)]:
                for p, c in told:
                    self.counts.add(p, c)
            taken += group
            self.made |= {a + b for a, b in group}
        for m in steps[: len(taken)]:
            self.sample.merge(*m, told=False)
        self.pending += steps[: len(taken)]
        self.rounds += 1
        return taken

    def _next(self, guess: list[Pair]) -> list[Pair]:
        """The merges that come next, if the guess begins with them: the best pair, or several that are next in an order of their own but leave one another's counts alone, so that their changes may be added up."""
        if self.counts.best() == guess[0]:
            return guess[:1]
        first = self.counts.first(len(guess) + 1)
        sure = safe_batch(first[: len(guess)], len(first) > len(guess), self.made)
        ahead: set[Pair] = set()
        for n, pair in enumerate(sure, 1):
            ahead.add(pair)
            if ahead == set(guess[:n]):
                return sure[:n]
        return []

    def rewrite(self) -> None:
        """Writes the words anew, as they are after all merges so far, without those of one token."""
        pending, before = list(self.pending), self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _slices(batches, pending):
                for m in pending:
                    block.merge(*m, told=False)
                yield _in_rows(*block.left())

        self.blocks = shared_table(before.mapInArrow(run, BLOCKS).repartition(self.parts), "blocks")
        self.pending = []
        remove_table(before)

    def close(self) -> None:
        remove_table(self.blocks)


def _rows(told: list[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
    """Changes of steps as rows."""
    step = [np.full(x[0].size, k, np.int32) for k, x in told]
    columns = [np.concatenate([np.empty(0, t), *c]).astype(t) for t, c in ((np.int32, step), *((t, [x[i] for _, x in told]) for i, t in enumerate((np.int32, np.int32, np.int64))))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["step", "left", "right", "cnt"])


def train_on_blocks(training: Training, n_merges: int) -> list[Pair]:
    """The next merges of a training, whatever its size."""
    training.begin()
    merges: list[Pair] = []
    while len(merges) < n_merges and (taken := training.round(n_merges - len(merges))):
        merges += taken
        if training.rounds % COMPACT == 0 and len(merges) < n_merges:
            training.rewrite()
    return merges


def train_distributed(words: DataFrame, n_merges: int, tie: str = "tuple") -> list[Pair]:
    """The merges of a histogram table (symbols, an array of binary; cnt) of any size, as `bpe.train` has them."""
    if tie not in ("tuple", "concat"):
        raise ValueError("tie must be tuple or concat")
    words = words.where(F.size("symbols") > 1).select("symbols", F.col("cnt").cast("long").alias("cnt"))

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten().unique()], ["symbol"])

    tokens = sorted(bytes(r[0]) for r in words.select("symbols").mapInArrow(different, "symbol binary").distinct().collect())
    id_of = {t: i for i, t in enumerate(tokens)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield packed(_to_ids(batch.column(0), id_of), pc.list_value_length(batch.column(0)).to_numpy(), batch.column(1).to_numpy())

    training = Training(shared_table(words.mapInArrow(pack, BLOCKS), "blocks"), tokens, tie)
    merges = train_on_blocks(training, n_merges)
    training.close()
    return merges

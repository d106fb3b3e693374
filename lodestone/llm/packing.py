"""Packing of documents into token windows by order-preserving dynamic programming.

The documents of a partition, in their order, are one stream of tokens. A window is at most `window` tokens of it; its
cut lies at a document's end, else at a sentence's end, else at one of every few tokens. The total of padding and
penalties for cuts within documents is least: with f(j) the least cost of a stream cut at j,

    f(j) = penalty(j) + window - j + min of f(i) + i over the cuts i in [j - window, j),

where the minimum of that sliding range is at the head of a monotone queue, so each candidate costs constant time. The stream
is handled in stretches of about `stretch` tokens; the last window of a stretch goes on into the next, so memory is
bounded (a longer text is a stretch of its own) and no padding is due to stretches. Nothing is shuffled.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_arrays import slices

#: What a cut costs in tokens of padding: at a sentence's end, and elsewhere within a document.
SENTENCE, ELSEWHERE = 2, 6
#: Cuts elsewhere are at multiples of so many tokens.
GRID = 16


class Tokenizer:
    """Ids of a byte-level BPE as the file of the library `tokenizers` defines them, by a faster library with the same ranks."""

    def __init__(self, path: str):
        import tiktoken
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        char = byte_characters()
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            if token not in self.special:
                ranks[bytes(char[c] for c in token)] = number
        # Fixed value: how byte-level vocabularies of this kind split a text.
        pattern = "'(?:s|t|re|ve|m|ll|d)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(max(ranks.values()), 1) + 2 + len(self.special), bool)
        for token, number in ranks.items():
            self.ends[number] = token[-1:] in (b".", b"!", b"?", b"\n")

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def best_cuts(position: np.ndarray, penalty: np.ndarray, window: int, last: bool) -> list[int]:
    """Chosen cuts of a stream that begins at 0, from candidates in order; the last candidate is its end. If not `last`, the end is left out, and what follows the last cut, at most a window, is open."""
    pos, pen = [0, *position.tolist()], [0, *penalty.tolist()]
    value, back = [0] * len(pos), [0] * len(pos)
    queue: deque[int] = deque([0])
    for j in range(1, len(pos)):
        while pos[j] - pos[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        # kept as f(j) + j, which is what later cuts compare
        value[j] = f = pen[j] + window + value[i]
        while queue and value[queue[-1]] >= f:
            queue.pop()
        queue.append(j)
    at = len(pos) - 1
    if not last:
        at = least_cost(value, pos, window)
    out = []
    while at > 0:
        out.append(pos[at])
        at = back[at]
    return out[::-1]


def least_cost(value: list[int], pos: list[int], window: int) -> int:
    """Of the candidates within a window of the end, but the end itself, the one that costs least so far; the last on ties. What follows it is packed later."""
    end = len(pos) - 1
    first = bisect_left(pos, pos[end] - window)
    return min(range(first, end), key=lambda i: (value[i] - pos[i], -i))


class Packer:
    """Feeds of (doc, ids), in order; gives pieces (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, ends: np.ndarray, stretch: int, first_sequence: int):
        self.window, self.ends, self.stretch, self.sequence = window, ends, stretch, first_sequence
        self.held: list[tuple] = []  # (doc, start, ids, doc_tokens)
        self.size = 0

    def feed(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        self.held.append((doc, 0, ids, len(ids)))
        self.size += len(ids)
        if self.size >= self.stretch:
            yield from self.cut(False)

    def cut(self, last: bool) -> Iterator[tuple]:
        if not self.size:
            return
        stream = np.concatenate([x[2] for x in self.held])
        after = np.cumsum([len(x[2]) for x in self.held])
        penalty = np.full(len(stream) + 1, 255, np.int64)
        penalty[GRID::GRID] = ELSEWHERE
        penalty[1:][self.ends[np.minimum(stream, len(self.ends) - 1)]] = SENTENCE
        penalty[after] = 0
        position = np.flatnonzero(penalty[1:] < 255) + 1
        cuts = best_cuts(position, penalty[position], self.window, last)
        k, base = 0, 0
        doc, start, ids, total = self.held[0] if self.held else (None,) * 4
        for c in cuts:
            offset = 0
            while base < c:
                take = min(len(ids), c - base)
                if take:
                    yield doc, start, ids[:take], total, self.sequence, offset
                offset, base, start, ids = offset + take, base + take, start + take, ids[take:]
                if not len(ids):
                    k += 1
                    doc, start, ids, total = self.held[k] if k < len(self.held) else (None, 0, np.zeros(0, np.uint32), 0)
            self.sequence += 1
        self.held = [x for x in [(doc, start, ids, total), *self.held[k + 1 :]] if len(x[2])]
        self.size = sum(len(x[2]) for x in self.held)


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048,
    end_id: int = 1, stretch: int = 1 << 18, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset; with ids, also the piece's ids (list of ints).

    Each document is its tokens and then `end_id`; null and empty texts are that id alone. Every id lies in one piece.
    Documents keep the order that they have in their partition; sequences don't cross partitions, so each partition ends
    with one that may be short. Offsets within a sequence are without gaps from 0. Repeated rows are packed once
    each. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path)
        packer = Packer(window, t.ends, stretch, TaskContext.get().partitionId() << 36)
        id_type = None

        def made(pieces: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*pieces, strict=True)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            columns = [pa.array(doc, id_type), *[pa.array(c, pa.int64()) for c in (start, [len(x) for x in ids], crc, total, sequence, offset)]]
            if with_ids:
                edges = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids).astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                id_type, pieces = part.column(0).type, []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = t.ids(text or "")
                    ids.append(end_id)
                    pieces += packer.feed(doc, np.array(ids, np.uint32))
                if pieces:
                    yield made(pieces)
        if rest := list(packer.cut(True)):
            yield made(rest)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import packing
from tests.llm.fixtures import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library():
    t = packing.Tokenizer(PATH)
    rng = random.Random(1)
    texts = ["", " ", "Hello  world's\n\n 12345 x", "naïve 😀 日本語　x", "a<|endoftext|>b", "x" * 3000, "\x00\x85​\t\r\n "]
    texts += ["".join(rng.choice("ab '\n1.é😀\t—") for _ in range(60)) for _ in range(60)]
    for x in texts:
        assert t.ids(x) == t.slow.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("seed", range(6))
def test_cuts_cost_least(seed):
    rng = random.Random(seed)
    window = 12
    pos = sorted({*rng.sample(range(1, 60), 25), *range(6, 60, 6), 60})
    pen = [rng.choice([0, 2, 6]) for _ in pos]
    cuts = packing.best_cuts(np.array(pos), np.array(pen), window, True)
    best = {0: 0}
    for j, p in zip(pos, pen, strict=True):
        best[j] = min(best[i] + p + window - (j - i) for i in best if j - i <= window)
    edges = [0, *cuts]
    assert cuts[-1] == 60 and all(b - a <= window for a, b in zip(edges, cuts, strict=False))
    assert sum(window - (b - a) + pen[pos.index(b)] for a, b in zip(edges, cuts, strict=False)) == best[60]


@pytest.mark.parametrize("stretch", [1, 300, 1 << 18])
def test_pieces_cover_each_document_once(spark, stretch):
    rows = corpus()
    t = packing.Tokenizer(PATH)
    ids = {d: np.array([*t.ids(x or ""), 1], "<u4") for d, x, _ in rows}
    out = packing.pack(frame(spark, rows).coalesce(2), PATH, window=256, stretch=stretch, with_ids=True).collect()
    at, sequences = dict.fromkeys(ids, 0), {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["length"] > 0 and r["ids"] == part.tolist()
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    assert at == {d: len(x) for d, x in ids.items()}
    size = 0
    for pieces in sequences.values():
        end = 0
        for offset, n, _ in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 256
        size += end
        assert [d for _, _, d in sorted(pieces)] == sorted(d for _, _, d in pieces)
    assert stretch == 1 or 1 - size / (256 * len(sequences)) < 0.08  # windows can't be chosen well one document at a time


def test_empty_table_and_null(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0
    r = packing.pack(frame(spark, [(5, None, None)]), PATH).first()
    assert (r["length"], r["ids_crc32"], r["offset"]) == (1, zlib.crc32(np.array([1], "<u4").tobytes()), 0)

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import jpeg
from lodestone.llm.media_columns import media_columns, store_texts, stored_digest
from tests.llm.fixtures import corpus, frame


def payloads():
    rng = np.random.default_rng(0)
    out = [b"", b"a", b"\xff" * 300, bytes(range(256)) * 3, b"\x00" * 500 + b"z", b"a" + b"\x00" * 62 + b"b", b"\xc3\x88" * 2000]
    for n in rng.integers(0, 4000, 80):
        out.append((rng.integers(0, 256, int(n)) * (rng.random(int(n)) < rng.random())).astype(np.uint8).tobytes())
    return out


def test_round_trip():
    given = payloads()
    media = jpeg.write([np.frombuffer(p, np.uint8) for p in given])
    for p, (image, blocks) in zip(given, jpeg.read(media), strict=True):
        want = p + bytes(max(64, -(-len(p) // 64) * 64) - len(p))
        assert blocks.astype(np.uint8).tobytes()[: len(want)] == want and not blocks.astype(np.uint8).tobytes()[len(want) :].strip(b"\x00")
        assert image.comment == b"payload %d" % len(p)


def encode_plain(blocks, order, tables, restart=0):
    """A slow writer of any layout: blocks of 64 coefficients in scan order, `order` the component of each block of an MCU."""
    bits, out, last, mcu = "", bytearray(), {}, 0

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            b = int(bits[k : k + 8], 2)
            out.append(b)
            if b == 0xFF:
                out.append(0)
        bits = ""

    def put(table, symbol, value, size):
        nonlocal bits
        code, length = jpeg.codes(table)
        assert length[symbol]
        bits += f"{int(code[symbol]):0{length[symbol]}b}"
        if size:
            bits += f"{value if value > 0 else value + (1 << size) - 1:0{size}b}"

    for i, b in enumerate(blocks):
        if i % len(order) == 0:
            if restart and mcu and mcu % restart == 0:
                flush()
                out += bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
                last = {}
            mcu += 1
        c = order[i % len(order)]
        dc, ac = tables[c]
        d = int(b[0]) - last.get(c, 0)
        last[c] = int(b[0])
        put(dc, abs(d).bit_length(), d, abs(d).bit_length())
        run = 0
        for v in map(int, b[1:]):
            if v == 0:
                run += 1
                continue
            while run > 15:
                put(ac, 0xF0, 0, 0)
                run -= 16
            put(ac, run << 4 | abs(v).bit_length(), v, abs(v).bit_length())
            run = 0
        if run:
            put(ac, 0, 0, 0)
    flush()
    return bytes(out)


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_colour_image_with_subsampling(restart):
    rng = random.Random(restart)
    dc = jpeg.code_lengths({s: 4 for s in range(12)})
    ac = jpeg.code_lengths({0: 3, 0xF0: 6} | {run << 4 | size: 9 for run in range(16) for size in range(1, 11)})
    width, height = 37, 20
    across, down = -(-width // 16), -(-height // 16)
    order = [0, 0, 0, 0, 1, 2]
    blocks = [[rng.randint(-900, 900)] + [rng.choice([0] * 9 + [rng.randint(-500, 500)]) for _ in range(63)] for _ in range(across * down * 6)]
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    media = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0]) + bytes([8] * 64)) + seg(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    media += seg(0xC4, b"\x00" + dc) + seg(0xC4, b"\x10" + ac) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
    media += encode_plain(blocks, order, {c: (dc, ac) for c in range(3)}, restart) + b"\xff\xd9"
    (image, got), broken = jpeg.read([media, media[: len(media) // 2]])
    assert got.tolist() == blocks and isinstance(broken, ValueError)
    grid = jpeg.thumbnail(image, got)
    assert grid.shape == (3, 5)
    first = blocks[0][0] + 128
    assert grid[0, 0] == min(255, max(0, first)) and grid[1, 0] == min(255, max(0, blocks[2][0] + 128)) and grid[0, 2] == min(255, max(0, blocks[6][0] + 128))


def test_digest_of_texts(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in stored_digest(store_texts(frame(spark, rows))).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    by_text = {}
    for d, t, _ in rows:
        assert by_text.setdefault(t or "", got[d]["media_sha256"] + got[d]["feature"]) == got[d]["media_sha256"] + got[d]["feature"]


def test_columns_of_bad_media(spark):
    good = jpeg.write([np.frombuffer(b"hello", np.uint8)])[0]
    df = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"\xff\xd8junk")), (4, bytearray(good)), (5, bytearray(good[:-10])), (4, bytearray(good))], "doc_id long, media binary")
    got = sorted(media_columns(df).collect(), key=lambda r: r["doc_id"])
    assert got[0]["error"] is None and got[0]["width"] is None
    assert got[1]["error"] and got[2]["error"] and (got[5]["error"] or got[5]["width"])
    assert (got[3]["width"], got[3]["height"], got[3]["thumb_width"], got[3]["error"]) == (8, 8, 1, None) and got[3] == got[4]
    assert media_columns(df.limit(0)).count() == 0 and store_texts(frame(spark, [])).count() == 0


def test_digest_of_other_media(spark):
    """Null, bytes that aren't an image, and an image that no text was stored in."""
    plain = jpeg.write([np.frombuffer(b"abc", np.uint8)])[0]
    at = plain.index(jpeg.COMMENT)
    foreign = plain[:at] + b"x" * len(jpeg.COMMENT) + plain[at + len(jpeg.COMMENT) :]
    df = spark.createDataFrame([(1, None), (2, b"no image"), (3, foreign), (4, plain), (5, b"")], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in stored_digest(df).collect()}
    assert set(got[1].asDict().values()) == {1, None}
    assert got[2]["media_bytes"] == 8 and got[2]["n_bytes"] is None and got[5]["media_bytes"] == 0
    assert got[3]["n_bytes"] is None and got[3]["media_bytes"] == len(foreign) and got[3]["feature"] is None
    assert got[4]["n_bytes"] == 3 and got[4]["payload_bytes"] == 64
    assert stored_digest(df.where("false")).count() == 0

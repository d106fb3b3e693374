"""Baseline JPEG in numpy: a writer that keeps its coefficients, and a reader of markers, scans and DC thumbnails.

The reader takes any sequential Huffman-coded 8-bit image (SOF0, and SOF1 with 8 bits) with up to four components in
one scan. Segments between restart markers are decoded side by side: one numpy step decodes one symbol of every segment.

The writer stores bytes as the 64 coefficients of grey 8x8 blocks in zigzag order, one block per restart interval. So
the stored coefficients, not the samples, hold the bytes, and nothing is lost. The blocks form a near-square image; the
length of the payload stands in a comment.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

DC_STEP = 4  # the quantiser's step of DC; all other steps are 1
COMMENT = b"payload "


def code_lengths(symbols: dict[int, int]) -> bytes:
    """The body of a DHT table: how many codes have each length from 1 to 16, then the symbols in order of length."""
    order = sorted(symbols, key=lambda s: (symbols[s], s))
    return bytes(sum(1 for s in order if symbols[s] == n) for n in range(1, 17)) + bytes(order)


#: Lengths that suit text: small letters have seven bits, space and digits six, bytes beyond ASCII eight.
_FREQUENT = {7: 1, 6: 2, 8: 3, 4: 5, 0: 5, 1: 8, 2: 8, 3: 8, 5: 8}
DC_TABLE = code_lengths(_FREQUENT)
AC_TABLE = code_lengths(_FREQUENT | {0xF0: 8} | {run << 4 | size: 12 for run in range(1, 16) for size in range(1, 9)})


@lru_cache(64)
def codes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol; length 0 if it has none."""
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    value, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            code[table[at]], length[table[at]] = value, n
            value, at = value + 1, at + 1
        value <<= 1
    return code, length


@lru_cache(64)
def lookup(table: bytes) -> np.ndarray:
    """For every 16 bits: length << 8 | symbol of the code they begin with, 0 if none."""
    out, value, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            if value >= 1 << n or at >= len(table):
                raise ValueError("bad Huffman table")
            out[value << (16 - n) : (value + 1) << (16 - n)] = n << 8 | table[at]
            value, at = value + 1, at + 1
        value <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(width: int, height: int, n_bytes: int) -> bytes:
    return b"".join((
        b"\xff\xd8", _segment(0xFE, COMMENT + str(n_bytes).encode()), _segment(0xDB, bytes([0, DC_STEP]) + bytes([1]) * 63),
        _segment(0xC0, b"\x08" + (8 * height).to_bytes(2, "big") + (8 * width).to_bytes(2, "big") + b"\x01\x01\x11\x00"),
        _segment(0xC4, b"\x00" + DC_TABLE), _segment(0xC4, b"\x10" + AC_TABLE), _segment(0xDD, b"\x00\x01"), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


_BITS = np.array([int(x).bit_length() for x in range(256)], np.int64)


def write(payloads: list[np.ndarray]) -> list[bytes]:
    """A JPEG for each payload of bytes, which is padded by zeros to a positive multiple of 64."""
    sizes = np.array([len(p) for p in payloads])
    blocks = np.maximum(1, -(-sizes // 64))
    wide = np.ceil(np.sqrt(blocks)).astype(np.int64)
    high = -(-blocks // wide)
    if len(wide) and wide.max() > 8191:
        raise ValueError("a payload is too long for one image")
    first = np.concatenate(([0], np.cumsum(wide * high)))
    coef = np.zeros((first[-1], 64), np.uint8)
    flat = coef.reshape(-1)
    for p, f in zip(payloads, first[:-1], strict=True):
        flat[64 * f : 64 * f + len(p)] = p
    dc_code, dc_len = codes(DC_TABLE)
    ac_code, ac_len = codes(AC_TABLE)
    # events: DC, each AC that isn't zero with the zero runs before it, and the end of block
    block, k = np.nonzero(coef[:, 1:])
    value = coef[block, k + 1]
    same = np.concatenate(([False], block[1:] == block[:-1]))
    run = k - np.where(same, np.concatenate(([0], k[:-1])) + 1, 0)
    size = _BITS[value]
    n_ac = np.bincount(block, minlength=len(coef))
    ends = coef[:, 63] == 0
    offset = np.concatenate(([0], np.cumsum(1 + n_ac + ends)))
    bits, length = np.zeros(offset[-1], np.uint64), np.zeros(offset[-1], np.int64)
    dc = coef[:, 0]
    bits[offset[:-1]] = dc_code[_BITS[dc]] << _BITS[dc].astype(np.uint64) | dc
    length[offset[:-1]] = dc_len[_BITS[dc]] + _BITS[dc]
    at = np.arange(len(block)) + block + 1 + np.concatenate(([0], np.cumsum(ends)))[block]
    symbol = (run & 15) << 4 | size
    x, n = ac_code[symbol] << size.astype(np.uint64) | value, ac_len[symbol] + size
    for _ in range(3):  # a run of sixteen zeros each
        more = run >= 16
        if not more.any():
            break
        x[more] |= ac_code[0xF0] << n[more].astype(np.uint64)
        n[more] += ac_len[0xF0]
        run = run - 16 * more
    bits[at], length[at] = x, n
    last = offset[1:][ends] - 1
    bits[last], length[last] = ac_code[0], ac_len[0]
    total = np.add.reduceat(length, offset[:-1])
    taken = -(-total // 8)
    begin = np.concatenate(([0], np.cumsum(taken)))
    before = np.cumsum(length) - length
    pos = before - np.repeat(before[offset[:-1]], np.diff(offset)) + 8 * np.repeat(begin[:-1], np.diff(offset))
    # the rest of a block's last byte is ones
    fill = 8 * taken - total
    pos = np.concatenate((pos, 8 * begin[1:] - fill))
    bits = np.concatenate((bits, (np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1)))
    length = np.concatenate((length, fill))
    byte, shift = pos >> 3, (64 - (pos & 7) - length)
    aligned = np.where(length > 0, bits << np.minimum(shift, 63).astype(np.uint64), np.uint64(0))
    out = np.zeros(begin[-1] + 8, np.float64)
    reach = (pos & 7) + length
    for j in range(8):
        live = reach > 8 * j
        if not live.any():
            break
        if j == 0:
            out[: begin[-1] + 8] += np.bincount(byte, (aligned >> np.uint64(56)).astype(np.float64), begin[-1] + 8)
        else:
            out += np.bincount(byte[live] + j, (aligned[live] >> np.uint64(56 - 8 * j) & np.uint64(255)).astype(np.float64), begin[-1] + 8)
    raw = out[: begin[-1]].astype(np.uint8)
    # a zero after each byte of ones, then a marker after each block: a restart, or the end of the image
    full = raw == 0xFF
    shifted = np.arange(len(raw)) + np.cumsum(full) - full + 2 * np.repeat(np.arange(len(coef)), taken)
    stop = begin[1:] + np.cumsum(full)[begin[1:] - 1] + 2 * np.arange(len(coef))
    stream = np.zeros(len(raw) + int(full.sum()) + 2 * len(coef), np.uint8)
    stream[shifted] = raw
    number = np.arange(len(coef)) - np.repeat(first[:-1], wide * high)
    stream[stop], stream[stop + 1] = 0xFF, 0xD0 + number % 8
    stream[stop[first[1:] - 1] + 1] = 0xD9
    edges = np.concatenate(([0], stop[first[1:] - 1] + 2))
    return [_header(int(w), int(h), len(p)) + stream[a:b].tobytes() for w, h, p, a, b in zip(wide, high, payloads, edges[:-1], edges[1:], strict=True)]


@dataclass
class Image:
    """What the markers of an image say; `scan` is where its entropy-coded bytes begin."""

    width: int = 0
    height: int = 0
    components: tuple = ()  # id, horizontal and vertical sampling, quantiser
    steps: dict | None = None
    layout: tuple = ()  # (component number, DC table, AC table) in order of the scan
    restart: int = 0
    comment: bytes = b""
    scan: int = 0

    def mcus(self) -> tuple[int, int]:
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.layout) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def blocks(self) -> list[int]:
        """The scan's component number of each block of an MCU."""
        if len(self.layout) == 1:
            return [0]
        return [i for i, (c, _, _) in enumerate(self.layout) for _ in range(self.components[c][1] * self.components[c][2])]


def parse(media: bytes) -> Image:
    """Read the markers up to the scan."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    out, tables, at = Image(steps={}), {}, 2
    while True:
        if at + 4 > len(media) or media[at] != 0xFF:
            raise ValueError("bad marker")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(media[at + 2 : at + 4], "big")
        body = media[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("short segment")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.steps[body[0] & 15] = int.from_bytes(body[1:3], "big") if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not 8 bits")
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.components = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5]))
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = bytes(body[1:n])
                body = body[n:]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            out.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            out.comment = bytes(body)
        elif marker == 0xDA:
            ids = [c[0] for c in out.components]
            if not out.width or not out.height or body[0] != len(ids):
                raise ValueError("no frame, or several scans")
            out.layout = tuple((ids.index(body[1 + 2 * i]), tables[body[2 + 2 * i] >> 4], tables[0x10 | body[2 + 2 * i] & 15]) for i in range(body[0]))
            out.scan = at
            return out


def coefficients(images: list[Image], scans: list[np.ndarray]) -> list[np.ndarray]:
    """The blocks of each image in order of the scan, 64 coefficients in zigzag order; all images share layout, sampling and restart interval."""
    if not images:
        return []
    kind, order = images[0], images[0].blocks()
    total = np.array([np.prod(i.mcus()) * len(order) for i in images], np.int64)
    per = kind.restart * len(order) if kind.restart else int(total.max())
    data = np.concatenate(scans)
    edge = np.concatenate(([0], np.cumsum([len(s) for s in scans])))
    follows = np.concatenate(([0], data[:-1]))
    follows[edge[:-1][edge[:-1] < len(data)]] = 0
    stuffed = (follows == 0xFF) & (data == 0)
    second = (follows == 0xFF) & (data >= 0xD0) & (data <= 0xD7)
    keep = ~stuffed & ~second
    keep[np.flatnonzero(second) - 1] = False
    place = np.concatenate(([0], np.cumsum(keep)))
    data = data[keep]
    lanes = -(-total // per)
    marks = np.flatnonzero(second)
    found = np.searchsorted(marks, edge)
    if (np.diff(found) != lanes - 1).any():
        raise ValueError("restart markers are missing")
    start = np.empty(int(lanes.sum()), np.int64)
    head = np.concatenate(([0], np.cumsum(lanes)))
    rest = np.ones(len(start), bool)
    rest[head[:-1]] = False
    start[head[:-1]], start[rest] = place[edge[:-1]], place[marks + 1]
    own = np.arange(len(start)) - np.repeat(head[:-1], lanes)
    count = np.minimum(per, np.repeat(total, lanes) - own * per)
    base = np.concatenate(([0], np.cumsum(total)))
    begin = np.repeat(base[:-1], lanes) + own * per
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    n = len(data) + 3
    window = padded[:n] << np.uint64(56)
    for j in range(1, 5):
        window |= padded[j : n + j] << np.uint64(56 - 8 * j)
    limit = 8 * (len(data) + 2)
    out = np.zeros((base[-1], 64), np.int32)
    pos, last = 8 * start, np.zeros((len(kind.layout), len(start)), np.int64)

    def symbols(at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(at) and at.max() > limit:
            raise ValueError("the scan ends early")
        w = window[at >> 3] << (at & 7).astype(np.uint64)
        found = table[(w >> np.uint64(48)).astype(np.int64)]
        length = found >> 8
        if not length.all():
            raise ValueError("no such code")
        size = found & 15
        extra = ((w << length.astype(np.uint64)) >> (64 - size).astype(np.uint64)).astype(np.int64)
        extra[size == 0] = 0
        return found & 255, np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra), at + length + size

    for j in range(int(count.max())):
        live = np.flatnonzero(count > j)
        c = order[j % len(order)]
        _, dc_table, ac_table = kind.layout[c]
        dc, ac = lookup(dc_table), lookup(ac_table)
        _, diff, pos[live] = symbols(pos[live], dc)
        last[c, live] += diff
        row, at = begin[live] + j, pos[live]
        out[row, 0] = last[c, live]
        k, left = np.zeros(len(live), np.int64), np.arange(len(live))
        while len(left):
            s, v, at_next = symbols(at[left], ac)
            at[left] = at_next
            k[left] += np.where(s == 0xF0, 16, np.where(s == 0, 64, (s >> 4) + 1))
            some = (s & 15) > 0
            hit = left[some]
            if (k[hit] > 63).any():
                raise ValueError("too many coefficients")
            out[row[hit], k[hit]] = v[some]
            left = left[k[left] < 63]
        pos[live] = at
    return [out[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """The luminance of each 8x8 block from its DC: one pixel a block."""
    order = image.blocks()
    across, down = image.mcus()
    number, h, v, step = (image.layout[0][0], 1, 1, 0)
    _, h, v, step = image.components[number]
    if len(order) == 1:
        h = v = 1
    first = blocks.reshape(down * across, len(order), 64)[:, : h * v, 0].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    grid = first[: -(-image.height // 8), : -(-image.width // 8)] * (image.steps[step] / 8) + 128
    return np.clip(np.rint(grid), 0, 255).astype(np.uint8)


def average_hash(grid: np.ndarray) -> int:
    """64 bits: whether each cell of the grid, resampled to 8 by 8, is above the mean."""
    rows = np.arange(8) * grid.shape[0] // 8
    cols = np.arange(8) * grid.shape[1] // 8
    if grid.shape[0] >= 8 and grid.shape[1] >= 8:
        small = np.add.reduceat(np.add.reduceat(grid.astype(np.float64), rows, 0), cols, 1)
        small /= np.outer(np.diff(np.append(rows, grid.shape[0])), np.diff(np.append(cols, grid.shape[1])))
    else:
        small = grid[np.ix_(rows, cols)].astype(np.float64)
    return int.from_bytes(np.packbits(small.reshape(-1) > small.mean()).tobytes(), "big")


def read(media: list[bytes]) -> list[tuple[Image, np.ndarray] | ValueError]:
    """Image and blocks of each JPEG, or the error that it gives."""
    out: list = [None] * len(media)
    kinds: dict = {}
    for i, m in enumerate(media):
        try:
            image = parse(m)
            kinds.setdefault((image.layout, image.components, image.restart if image.restart else -i - 1), []).append((i, image))
        except (ValueError, KeyError, IndexError) as e:
            out[i] = ValueError(str(e))
    for group in kinds.values():
        scans = []
        for i, image in group:
            end = media[i].rfind(b"\xff\xd9")
            scans.append(np.frombuffer(media[i], np.uint8)[image.scan : end if end >= image.scan else None])
        try:
            for (i, image), blocks in zip(group, coefficients([g for _, g in group], scans), strict=True):
                out[i] = (image, blocks)
        except (ValueError, IndexError):
            for (i, image), s in zip(group, scans, strict=True):
                try:
                    out[i] = (image, coefficients([image], [s])[0])
                except (ValueError, IndexError) as e:
                    out[i] = ValueError(str(e))
    return out


def thumbnail_hash(grid: np.ndarray) -> str:
    return f"{average_hash(grid):016x}-{hashlib.sha256(grid.tobytes()).hexdigest()[:16]}"

"""Media columns: baseline JPEG images to dimensions, DC luminance thumbnails and their hashes; and texts as such images.

Both steps map Arrow batches in place, slice by slice, without a shuffle; nothing outlives its slice.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import jpeg
from lodestone.llm.text_arrays import SLICE_BYTES, slices

COLUMNS = "width int, height int, thumb_width int, thumb_height int, thumbnail binary, thumbnail_hash string, error string"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and media: the UTF-8 bytes of each text, with zeros up to a positive multiple of 64, as an image's coefficients. Null is the empty text; repeated rows give repeated results."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                media = jpeg.write([data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["id", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """ids, and (media, what reading it gives) of some rows at a time; None for null."""
    for batch in batches:
        media, start = batch.column(1).to_pylist(), 0
        while start < len(media):
            stop, size = start, 0
            while stop < len(media) and (stop == start or size + len(media[stop] or b"") <= SLICE_BYTES):
                size, stop = size + len(media[stop] or b""), stop + 1
            there = [m for m in media[start:stop] if m is not None]
            found = iter(jpeg.read(there))
            yield batch.column(0).slice(start, stop - start), [(m, None if m is None else next(found)) for m in media[start:stop]]
            start = stop


def media_columns(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, width, height, thumb_width, thumb_height, thumbnail (bytes, a pixel a block), thumbnail_hash and error.

    A null image gives nulls throughout. Bytes that aren't a whole baseline JPEG, the empty ones included, give nulls
    and an error. Equal images give equal values. Other columns are ignored, whatever their names.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _decoded(batches):
            rows = []
            for _, x in found:
                if x is None:
                    rows.append((None,) * 7)
                elif isinstance(x, ValueError):
                    rows.append((None,) * 6 + (str(x),))
                else:
                    grid = jpeg.thumbnail(*x)
                    rows.append((x[0].width, x[0].height, grid.shape[1], grid.shape[0], grid.tobytes(), jpeg.thumbnail_hash(grid), None))
            kinds = [pa.int32()] * 4 + [pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], ["id", *[c.split()[0] for c in COLUMNS.split(", ")]])

    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_col)


def _stored_bytes(x) -> tuple | None:
    """The stored text's length, the image and its blocks; None if `store_texts` didn't write what was read."""
    if isinstance(x, ValueError) or not x[0].comment.startswith(jpeg.COMMENT):
        return None
    said = x[0].comment.removeprefix(jpeg.COMMENT)
    return (int(said), *x) if said.isdigit() and int(said) <= x[1].size else None


def stored_digest(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """For images of `store_texts`, read back: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature (dimensions and thumbnail hash).

    A null image gives nulls throughout. Bytes that no whole baseline JPEG is, and images that `store_texts` didn't write,
    give the figures of the media alone. Equal images give equal values; an empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _decoded(batches):
            rows = []
            for media, x in found:
                if x is None:
                    rows.append((None,) * 7)
                    continue
                stored = _stored_bytes(x)
                if stored is None:
                    rows.append((None,) * 4 + (len(media), hashlib.sha256(media).hexdigest(), None))
                    continue
                n, image, blocks = stored
                payload = blocks.astype(np.uint8).reshape(-1)[: 64 * max(1, -(-n // 64))].tobytes()
                feature = f"{image.width}x{image.height}:{jpeg.thumbnail_hash(jpeg.thumbnail(image, blocks))}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], ["id", *names])

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, schema).withColumnRenamed("id", id_col)

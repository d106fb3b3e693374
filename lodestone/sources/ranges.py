"""Data sources and a sink that read and write files by position, task by task: byte ranges at delimiters, token arrays, archives, compressed lines.

A file is cut in ranges when a query is planned, from names and sizes alone; each task opens the file and reads its range, block by block,
so a task's memory is a block and the longest document (array slice, archive member, line), whatever the size of the file. Paths are those that
Arrow's file systems open (local and shared folders, hdfs, s3, gs); a store that only Spark reads has `readers.delimited_text` for
delimited files.
"""

from __future__ import annotations

import ast
import posixpath
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lodestone.functions.text import END_OF_TEXT, repaired_utf8
from lodestone.session import ship

#: Bytes of a range, of a read, and of the texts of one batch; tokens of a slice, and of a file that a task writes.
RANGE_BYTES, BLOCK_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 8 << 20
SLICE_TOKENS, FILE_TOKENS = 1 << 16, 1 << 24
#: Bytes of ranges that one task reads one after another, for how many a range counts at least, and tasks that there are before ranges share one.
TASK_BYTES, LEAST_BYTES, FEW_TASKS = 4 << 20, 1 << 16, 256


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def output(path: str):
    """A new file to write to, in folders that are made where they are missing."""
    fs, at = opened(path)
    fs.create_dir(posixpath.dirname(at), recursive=True)
    return fs.open_output_stream(at, compression=None)  # not told from the name


def put(path: str, content: bytes) -> None:
    with output(path) as out:
        out.write(content)


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Names and sizes of the file, or of the files below a folder, in order of their names; hidden ones are passed over."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    below = lambda f: f.path[len(at) :] if f is not info else f.base_name
    shown = [f for f in found if f.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in below(f).split("/"))]
    return sorted((f.path, f.size) for f in shown if f.path.endswith(suffix))


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    number: int = 0

    def __post_init__(self):
        super().__init__(self.number)


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads."""

    ranges: list[Range]
    number: int

    def __post_init__(self):
        super().__init__(self.number)


class _Reader(DataSourceReader):
    """A reader of ranges: `cut` gives those of a file, `one` the batches of one; short ones are read by one task, so tasks grow with the bytes and not with files or ranges."""

    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]

    def ranges(self) -> list[Range]:
        return [r for file, size in listed(self.path, self.options.get("suffix", "")) for r in self.cut(file, size)]

    def partitions(self) -> list[Ranges]:
        ranges = self.ranges()
        sizes = [max(LEAST_BYTES, r.end - r.start) for r in ranges]
        most = min(TASK_BYTES, sum(sizes) // FEW_TASKS)
        tasks, held = [], most
        for r, size in zip(ranges, sizes, strict=True):
            if held >= most:
                tasks.append(Ranges([], len(tasks)))
                held = 0
            tasks[-1].ranges.append(r)
            held += size
        return tasks

    def rows(self, fs: pafs.FileSystem, part: Ranges) -> Iterator[pa.RecordBatch]:
        for r in part.ranges:
            yield from self.one(fs, r)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        yield from self.rows(fs, partition)


class _Delimited(_Reader):
    def cut(self, file: str, size: int) -> list[Range]:
        step = int(self.options.get("rangebytes", RANGE_BYTES))
        return [Range(file, a, min(a + step, size)) for a in range(0, size, step)]

    def one(self, fs: pafs.FileSystem, part: Range) -> Iterator[pa.RecordBatch]:
        """The documents that begin in the range. The first begins at the file's start, or behind the first mark that ends in the range or at its start."""
        mark = self.options["mark"].encode()
        block = max(int(self.options.get("blockbytes", BLOCK_BYTES)), len(mark))
        starts, texts, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.file] * len(texts)), pa.array(starts, pa.int64()), pa.array(texts, pa.binary())], ["file", "start", "content"])

        with fs.open_input_file(part.file) as f:
            base = max(0, part.start - len(mark))  # where the buffer begins in the file
            f.seek(base)
            buffer, searched, begin, ended = bytearray(), 0, 0 if part.start == 0 else None, False
            while True:
                at = buffer.find(mark, searched)
                if at < 0 and not ended:
                    searched = max(0, len(buffer) - len(mark) + 1)
                    if begin is None and searched:  # nothing begins here yet
                        del buffer[:searched]
                        base, searched = base + searched, 0
                    more = f.read(block)
                    ended = not more
                    buffer += more
                    continue
                stop = at if at >= 0 else len(buffer)
                if begin is not None and stop > begin:
                    starts.append(base + begin)
                    texts.append(bytes(buffer[begin:stop]))
                    held += stop - begin
                    if held >= BATCH_BYTES:
                        yield batch()
                        starts, texts, held = [], [], 0
                if at < 0:
                    break
                begin = at + len(mark)
                if base + begin >= part.end:
                    break
                if base + begin < part.start:
                    begin, searched = None, at + len(mark)
                    continue
                del buffer[:begin]
                base, begin, searched = base + begin, 0, 0
        if texts:
            yield batch()


class DelimitedRanges(DataSource):
    """file, start and content of the documents of files that a mark ends or parts."""

    @classmethod
    def name(cls) -> str:
        return "delimited_ranges"

    def schema(self) -> str:
        return "file string, start long, content binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Delimited(dict(self.options))


class _Bytes(_Reader):
    def cut(self, file: str, size: int) -> list[Range]:
        start, end = int(self.options["start"]), min(int(self.options["end"]), size)
        return [Range(file, start, max(start, end))]

    def one(self, fs: pafs.FileSystem, part: Range) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(part.file) as f:
            content = f.read_at(part.end - part.start, part.start) if part.end > part.start else b""
        yield pa.RecordBatch.from_arrays([pa.array([part.file]), pa.array([content], pa.binary())], ["file", "content"])


class ByteRange(DataSource):
    """file and content of the bytes [start, end) of each file; nothing else of it is read."""

    @classmethod
    def name(cls) -> str:
        return "byte_range"

    def schema(self) -> str:
        return "file string, content binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Bytes(dict(self.options))


def array_header(f) -> tuple[int, np.dtype, int]:
    """Where the items of an .npy file begin, their type and number; an error if it isn't an array of one dimension."""
    head = f.read_at(12, 0)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    wide = head[6] > 1
    length = struct.unpack("<I", head[8:12])[0] if wide else struct.unpack("<H", head[8:10])[0]
    begin = (12 if wide else 10) + length
    said = ast.literal_eval(f.read_at(length, begin - length).decode("latin1"))
    if len(said["shape"]) != 1 or np.dtype(said["descr"]).hasobject:
        raise ValueError("not an array of numbers of one dimension")
    return begin, np.dtype(said["descr"]), said["shape"][0]


class _Arrays(_Reader):
    def ranges(self) -> list[Range]:
        fs, _ = opened(self.path)
        step, out = int(self.options.get("slicetokens", SLICE_TOKENS)) * int(self.options.get("slices", 64)), []
        for file, _ in listed(self.path, ".npy"):
            if posixpath.basename(file).startswith("offsets_"):
                continue
            with fs.open_input_file(file) as f:
                n = array_header(f)[2]
            out += [Range(file, a, min(a + step, n)) for a in range(0, n, step)]
        return out

    def one(self, fs: pafs.FileSystem, part: Range) -> Iterator[pa.RecordBatch]:
        step = int(self.options.get("slicetokens", SLICE_TOKENS))
        with fs.open_input_file(part.file) as f:
            begin, kind, _ = array_header(f)
            for a in range(part.start, part.end, step):
                b = min(a + step, part.end)
                items = np.frombuffer(f.read_at((b - a) * kind.itemsize, begin + a * kind.itemsize), kind).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.array(items))
                yield pa.RecordBatch.from_arrays([pa.array([part.file]), pa.array([a], pa.int64()), tokens], ["file", "start", "tokens"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where it is, and where it goes


def _array_bytes(items: np.ndarray) -> bytes:
    said = f"{{'descr': '{items.dtype.str}', 'fortran_order': False, 'shape': ({len(items)},), }}"
    length = -(-(len(said) + 11) // 64) * 64 - 10
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", length) + said.ljust(length - 1).encode() + b"\n" + items.tobytes()


class _ArrayWriter(DataSourceArrowWriter):
    """Writes pairs of files of whole documents beside the store and moves them into it when all tasks are done; a failed job leaves the store as it was."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.most, self.overwrite = options["path"], np.dtype(options.get("dtype", "int32")), int(options.get("filetokens", FILE_TOKENS)), overwrite
        self.beside = f"{self.path.rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        number, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, to = opened(self.beside)
        fs.create_dir(to, recursive=True)
        files, parts, sizes, held = [], [], [], 0

        def flush() -> None:
            nonlocal parts, sizes, held
            name = f"{number:06d}-{len(files) // 2:06d}.npy"
            tokens = np.concatenate(parts) if parts else np.zeros(0, self.kind)
            for prefix, items in (("", tokens), ("offsets_", np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))):
                at = f"{to}/{prefix}{attempt}-{name}"
                with fs.open_output_stream(at) as out:
                    out.write(_array_bytes(items))
                files.append((at, f"{prefix}{name}"))
            parts, sizes, held = [], [], 0

        info = np.iinfo(self.kind)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("tokens")).fill_null([])
            offsets, items = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            if len(items) and (items.min() < info.min or items.max() > info.max):
                raise ValueError(f"a token doesn't fit {self.kind}")
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                parts.append(items[a:b].astype(self.kind))
                sizes.append(b - a)
                held += b - a
                if held >= self.most:
                    flush()
        if sizes:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, to = opened(self.path)
        if self.overwrite:
            for file, _ in listed(self.path, ".npy"):
                fs.delete_file(file)
        for at, name in [f for m in messages if m is not None for f in m.files]:
            fs.move(at, f"{to}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, to = opened(self.beside)
        if fs.get_file_info(to).type != pafs.FileType.NotFound:
            fs.delete_dir(to)


class TokenArrays(DataSource):
    """A store of token arrays: <name>.npy with the tokens of many documents on end, and offsets_<name>.npy with where each begins and the last ends. Reads file, start and tokens of slices; writes tokens, a row a document."""

    @classmethod
    def name(cls) -> str:
        return "token_arrays"

    def schema(self) -> str:
        return "file string, start long, tokens array<int>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Arrays(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ArrayWriter(dict(self.options), overwrite)


class _Members(_Reader):
    def cut(self, file: str, size: int) -> list[Range]:
        return [Range(file, 0, size)]

    def one(self, fs: pafs.FileSystem, part: Range) -> Iterator[pa.RecordBatch]:
        """The archive is read once, from front to back, as it is unpacked."""
        root, rows, held = None, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["archive", "root", "path", "text"])

        with fs.open_input_stream(part.file, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz") as tar:
            for m in tar:
                root = m.name.split("/")[0] if root is None else root
                if not m.isfile():
                    continue
                try:
                    text = tar.extractfile(m).read().decode()
                except UnicodeDecodeError:
                    continue
                rows.append((part.file, root, m.name.removeprefix(f"{root}/"), text))
                held += m.size
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class ArchiveMembers(DataSource):
    """archive, root (its first folder), path and text of the files in tar.gz archives; those that aren't UTF-8 are left out."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, root string, path string, text string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Members({"suffix": ".tar.gz"} | dict(self.options))


class _Lines(_Reader):
    def cut(self, file: str, size: int) -> list[Range]:
        return [Range(file, 0, size)]

    def one(self, fs: pafs.FileSystem, part: Range) -> Iterator[pa.RecordBatch]:
        """The lines as far as they can be unpacked; then, if that is not to the end, a row with the error."""
        lines: list[str | None] = []
        held, rest, error, first = 0, b"", None, 0

        def batch(errors: list[str | None]) -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string()), pa.array(errors, pa.string())], ["file", "nth", "line", "error"])

        try:
            with fs.open_input_stream(part.file, compression=None) as f:
                unpack, block = zlib.decompressobj(31), f.read(BLOCK_BYTES)
                while block:
                    found = unpack.decompress(block, BLOCK_BYTES)
                    *whole, rest = (rest + found).split(b"\n")
                    lines += [x.decode() for x in whole]
                    held += len(found)
                    if held >= BATCH_BYTES:
                        yield batch([None] * len(lines))
                        first, lines, held = first + len(lines), [], 0
                    if unpack.eof:  # another member may follow
                        block = unpack.unused_data or f.read(BLOCK_BYTES)
                        unpack = zlib.decompressobj(31) if block else unpack
                    else:
                        block = unpack.unconsumed_tail or f.read(BLOCK_BYTES)
                if not unpack.eof:
                    raise EOFError("the file ends in the middle of its compressed data")
                lines += [rest.decode()] if rest else []
        except (zlib.error, EOFError, UnicodeDecodeError, OSError) as e:
            error = f"{type(e).__name__}: {e}"
        if lines or error:
            lines.append(None)
            yield batch([None] * (len(lines) - 1) + [error]).slice(0, len(lines) - (error is None))


class CompressedLines(DataSource):
    """file, nth, line and error of gzip files of lines: every line that can be unpacked, and one row with the error of each file that can't be to its end."""

    @classmethod
    def name(cls) -> str:
        return "compressed_lines"

    def schema(self) -> str:
        return "file string, nth long, line string, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Lines(dict(self.options))


def _registered(spark: SparkSession, source: type[DataSource]) -> str:
    ship(spark)
    spark.dataSource.register(source)
    return source.name()


def delimited(spark: SparkSession, path: str, mark: str = END_OF_TEXT, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, start (a byte offset) and text of the documents of files in which a mark parts documents; empty ones are left out, invalid UTF-8 is replaced.

    Files are cut in ranges of about `range_bytes`, each moved to the next mark, so no document is cut, lost or read twice. A mark that
    can overlap with itself would leave open where documents end, and is an error.
    """
    raw = mark.encode()
    if not raw or any(raw[:k] == raw[-k:] for k in range(1, len(raw))):
        raise ValueError("a mark must not be empty, or overlap with itself")
    rows = spark.read.format(_registered(spark, DelimitedRanges)).option("mark", mark).option("rangeBytes", range_bytes).load(path)
    return rows.select("file", "start", repaired_utf8(F.col("content")).alias("text"))


def byte_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """path and text of the bytes [start, end) of each file, by a positioned read; invalid UTF-8 is replaced."""
    rows = spark.read.format(_registered(spark, ByteRange)).option("start", start).option("end", end).load(path)
    return rows.select(F.col("file").alias("path"), repaired_utf8(F.col("content")).alias("text"))


def token_arrays(spark: SparkSession, path: str, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """file, start and tokens of slices of the arrays of a store, in any integer type; offsets_* files aren't arrays of tokens."""
    return spark.read.format(_registered(spark, TokenArrays)).option("sliceTokens", slice_tokens).load(path)


def offset_arrays(spark: SparkSession, path: str) -> DataFrame:
    """file and offsets of the offsets_*.npy files of a store, one a row."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "offsets_*.npy").load(path).select(F.col("path").alias("file"), "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = pa.BufferReader(raw)
                begin, kind, n = array_header(f)
                items = np.frombuffer(raw, kind, n, begin).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(items))], ["file", "offsets"])

    return rows.mapInArrow(parse, "file string, offsets array<long>")


def write_token_arrays(df: DataFrame, path: str, dtype: str = "int32", file_tokens: int = FILE_TOKENS, mode: str = "overwrite") -> None:
    """Writes documents (tokens) as arrays of about `file_tokens` tokens, never cutting a document, with their offsets; by tasks that are committed together."""
    rows = df.select(F.col("tokens").cast("array<int>").alias("tokens"))
    rows.write.format(_registered(df.sparkSession, TokenArrays)).option("dtype", dtype).option("fileTokens", file_tokens).mode(mode).save(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, root, path and text of the files in tar.gz archives, unpacked as they are read; those that aren't UTF-8 are left out. An archive is one task's."""
    return spark.read.format(_registered(spark, ArchiveMembers)).load(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, suffix: str = ".jsonl.gz") -> tuple[DataFrame, DataFrame]:
    """The rows of gzip files of JSON lines with source_path, and beside them the files that can't be read to their end, with source_path and error. No row of such a file is given. Blank lines are passed over."""
    found = spark.read.format(_registered(spark, CompressedLines)).option("suffix", suffix).load(path)
    faults = found.where("error IS NOT NULL").select(F.col("file").alias("source_path"), "error")
    good = found.where("error IS NULL AND trim(line) <> ''").join(faults.select(F.col("source_path").alias("file")), "file", "left_anti")
    return good.select(F.from_json("line", schema).alias("r"), F.col("file").alias("source_path")).select("r.*", "source_path"), faults

"""Large files that hold one JSON array of objects, read by many tasks.

A byte range of such a file doesn't tell whether it starts within a string or a record. So a data source lists the ranges of the files and
gives a row for each: how braces and brackets go in it if it starts outside a string, and if it starts inside one. Put
together in order, file by file, these rows tell how each range starts. Then ranges are read again: each one's records that start
there, and on to the end of the last one. Ranges may be small: a task takes so many of them that tasks don't grow in number as ranges do, and what
lies beyond a range is read in small steps.

Between records white space and commas are skipped, also repeated ones; anything else there is an error, and so is an end without the closing
bracket. What comes after it is not looked at. Compressed files are one range. Paths are URIs that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from math import ceil
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, which are also those of a task's ranges together if these are smaller; bytes of the pieces in which a range is read, and of the first piece after it.
RANGE, PIECE, BEYOND = 32 << 20, 4 << 20, 4 << 10
_LEVELS = "map<int,long>"
#: For both ways that a range may start: the strings' parity at its end, the change of depth, and by depth relative to the start how many records
#: start there and where the first bracket closes.
RANGES = "path string, file int, start long, stop long, first long, first_byte int, ends array<int>, change array<int>, " + f"opened array<{_LEVELS}>, closed array<{_LEVELS}>"
_STARTS = "path string, file int, start long, stop long, quoted boolean, depth int, place long, upto long"
_RECORDS = "path string, file int, place long, offset long, value string"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_SKIPPED = _SPACE.copy()
_SKIPPED[ord(",")] = True


def _opened(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files but for those whose names start with a dot or an underscore."""
    fs, at = _opened(path)
    info = fs.get_file_info(at)
    if info.type == pf.FileType.NotFound:
        fs, at = _opened(unquote(path))
        info = fs.get_file_info(at)
    if info.type == pf.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pf.FileType.File:
        return [(path, info.size)]
    found = [x for x in fs.get_file_info(pf.FileSelector(at)) if x.type == pf.FileType.File and not x.base_name.startswith((".", "_"))]
    return sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found)


class _Bytes:
    """Pieces of a file from ``start``; a compressed file starts at 0 only. One piece ends at ``upto``, and from there on they are small first."""

    def __init__(self, path: str):
        self.fs, self.at = _opened(path)
        self.packed = path.endswith(".gz")

    def pieces(self, start: int, upto: int | None = None) -> Iterator[np.ndarray]:
        with self.fs.open_input_stream(self.at, compression="gzip") if self.packed else self.fs.open_input_file(self.at) as f:
            if not self.packed:
                f.seek(start)
            left = start
            while self.packed and left and (skipped := f.read(min(left, PIECE))):
                left -= len(skipped)
            at, beyond = start, BEYOND
            while True:
                within = PIECE if upto is None else min(PIECE, upto - at)
                if within <= 0:
                    within, beyond = min(PIECE, beyond), beyond * 2
                if not (piece := f.read(within)):
                    return
                yield np.frombuffer(piece, np.uint8)
                at += len(piece)

    def escaped(self, start: int) -> bool:
        """Whether an odd number of backslashes stands before ``start``."""
        n = 0
        if start and not self.packed:
            with self.fs.open_input_file(self.at) as f:
                while start > n:
                    some = f.read_at(min(1024, start - n), max(0, start - n - 1024))
                    run = len(some) - len(some.rstrip(b"\\"))
                    n += run
                    if run < len(some):
                        break
        return n % 2 == 1


def _quotes(b: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Places of quotes that no backslash escapes, and whether a backslash is open at the end. ``escaped``: one is open at the start."""
    slash = b == 0x5C
    at = np.flatnonzero(slash)
    if not len(at):
        q = np.flatnonzero(b == 0x22)
        return (q[q > 0] if escaped else q), False if len(b) else escaped
    starts = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))  # of runs of backslashes
    size = np.diff(np.append(starts, len(at)))
    first = at[starts]
    odd = (size + ((first == 0) & escaped)) % 2 == 1
    after = (first + size)[odd]
    q = b == 0x22
    q[after[after < len(b)]] = False
    if escaped and not slash[0]:
        q[0] = False
    return np.flatnonzero(q), bool(len(after) and after[-1] == len(b))


def _marks(b: np.ndarray, quoted: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool, bool]:
    """Places of braces and closing brackets outside strings, the bytes there, the depth's step at each, and the state at the end."""
    quotes, open_ = _quotes(b, escaped)
    at = np.flatnonzero((b == 0x7B) | (b == 0x7D) | (b == 0x5D))
    outside = (np.searchsorted(quotes, at) + quoted) % 2 == 0
    at = at[outside]
    kind = b[at]
    return at, kind, (kind == 0x7B).astype(np.int64) - (kind == 0x7D), (len(quotes) + quoted) % 2 == 1, open_


def _summary(path: str, file: int, start: int, stop: int | None) -> tuple:
    """A row of ``RANGES``; ``file`` is the file's number."""
    source = _Bytes(path)
    escaped, quoted, depth = source.escaped(start), [False, True], [0, 0]
    opened, closed, first, first_byte, at = [{}, {}], [{}, {}], None, None, start
    for b in source.pieces(start, stop):
        if at == stop:
            break
        if first is None and len(solid := np.flatnonzero(~_SPACE[b])):
            first, first_byte = at + int(solid[0]), int(b[solid[0]])
        for k in (0, 1):
            where, kind, step, quoted[k], last = _marks(b, quoted[k], escaped)
            before = depth[k] + np.cumsum(step) - step
            for d, n in zip(*np.unique(before[kind == 0x7B], return_counts=True), strict=True):
                opened[k][int(d)] = opened[k].get(int(d), 0) + int(n)
            end = kind == 0x5D
            for d, i in zip(*np.unique(before[end], return_index=True), strict=True):
                closed[k].setdefault(int(d), at + int(where[end][i]))
            depth[k] += int(step.sum())
        escaped = last
        at += len(b)
    return path, file, start, stop, first, first_byte, [int(q) for q in quoted], depth, opened, closed


def _runs(path: str, size: int, tasks: int) -> list[list[tuple[str, int, int, int | None]]]:
    """The ranges, of ``size`` bytes, of the files at ``path`` as (path, file, start, stop), by task: ``tasks`` shares, or more if these are of over ``RANGE``. A compressed file is a share."""
    files = _files(path)
    share = min(RANGE, ceil(sum(n for _, n in files) / tasks))
    out, run, held = [], [], 0
    for file, (at, n) in enumerate(files):
        if at.endswith(".gz"):
            out.append([(at, file, 0, None)])
            continue
        for start in range(0, max(1, n), size):
            stop = min(n, start + size)
            run.append((at, file, start, stop))
            held += stop - start
            if held >= share:
                out.append(run)
                run, held = [], 0
    return [*out, run] if run else out


class _Ranges(InputPartition):
    def __init__(self, run: list[tuple[str, int, int, int | None]]):
        self.run = run


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.tasks = options["path"], int(options.get("rangebytes", RANGE)), int(options.get("tasks", 1))

    def partitions(self):
        return [_Ranges(run) for run in _runs(self.path, self.size, self.tasks)] or [_Ranges([])]

    def read(self, partition):
        for r in partition.run:
            yield _summary(*r)


class JsonArrayRanges(DataSource):
    """``spark.read.format("json_array_ranges").option("rangeBytes", n).option("tasks", k).load(path)``: a row for each byte range, read by ``k`` tasks, or more if these have over ``RANGE`` bytes."""

    @classmethod
    def name(cls):
        return "json_array_ranges"

    def schema(self):
        return RANGES

    def reader(self, schema):
        return _RangeReader({k.lower(): v for k, v in self.options.items()})


def _starts(ranges: pa.Table) -> pa.Table:
    """How each range of a file starts; ranges after the array's end are left out. A file that is no array is an error."""
    rows = sorted(ranges.to_pylist(), key=lambda r: r["start"])
    out, quoted, depth, place, begun, end = [], 0, 0, 0, False, None
    for r in rows:
        if not begun and r["first"] is not None:
            if r["first_byte"] != ord("["):
                raise ValueError(f"{r['path']} is no array: byte {r['first']} is not an opening bracket")
            begun = True
        opened, closed = dict(r["opened"][quoted]), dict(r["closed"][quoted])
        end = closed.get(-depth)
        if not begun:
            continue
        start = r["start"] if out else r["first"] + 1
        out.append((r["path"], r["file"], start, r["stop"], bool(quoted), depth, place, end))
        if end is not None:
            break
        place += opened.get(-depth, 0)
        quoted, depth = r["ends"][quoted], depth + r["change"][quoted]
    if end is None:
        raise ValueError(f"{rows[0]['path']} ends before its array's closing bracket")
    schema = pa.schema([("path", pa.string()), ("file", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("quoted", pa.bool_()), ("depth", pa.int32()), ("place", pa.int64()), ("upto", pa.int64())])
    return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)


def _records(path: str, file: int, start: int, stop: int | None, quoted: bool, depth: int, place: int, upto: int | None) -> Iterator[tuple[int, int, bytes]]:
    """(place, offset, bytes) of the records that start from ``start`` on, before ``stop`` and before the array's end ``upto``."""
    source = _Bytes(path)
    escaped = source.escaped(start)
    last = upto if stop is None else stop if upto is None else min(stop, upto)
    at, held, since = start, [], None  # the open record's bytes so far, and where it starts
    for b in source.pieces(start, last):
        if depth == 0 and last is not None and at >= last:
            return
        where, kind, step, quoted, escaped = _marks(b, quoted, escaped)
        after = depth + np.cumsum(step)
        begins, ends = where[(after == 1) & (step == 1)], where[(after == 0) & (step == -1)] + 1
        if (after < 0).any() and (last is None or at + where[np.argmax(after < 0)] < last):
            raise ValueError(f"{path}: a brace closes nothing at {at + int(where[np.argmax(after < 0)])}")
        # bytes between records, as far as this range goes: records begin and end in turn
        left = ends if depth > 0 else np.append(0, ends)
        size = np.append(begins, len(b))[: len(left)] - left
        between = np.arange(size.sum()) + np.repeat(left - np.cumsum(size) + size, size)
        odd = between[~_SKIPPED[b[between]]]
        if len(odd) and (last is None or at + odd[0] < last):
            raise ValueError(f"{path}: unexpected {chr(b[odd[0]])!r} at {at + int(odd[0])}")
        raw = b.tobytes()
        if depth > 0:  # what is open is ours only if it started here
            if len(ends):
                if since is not None:
                    yield place, since, b"".join(held) + raw[: ends[0]]
                    place += 1
                held, since, ends = [], None, ends[1:]
            elif since is not None:
                held.append(raw)
        for s, e in zip(begins, ends, strict=False):
            if last is not None and at + s >= last:
                return
            yield place, at + int(s), raw[s:e]
            place += 1
        if len(begins) > len(ends):
            s = int(begins[-1])
            if last is not None and at + s >= last:
                return
            held, since = [raw[s:]], at + s
        depth = int(after[-1]) if len(after) else depth
        at += len(b)
        if since is None and last is not None and at >= last:
            return
    if since is not None:
        raise ValueError(f"{path} ends within a record")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("file", pa.int32()), ("place", pa.int64()), ("offset", pa.int64()), ("value", pa.string())])
    rows, size = [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
    for b in batches:
        for r in b.to_pylist():
            for place, offset, value in _records(**r):
                rows.append((r["path"], r["file"], place, offset, value.decode("utf-8", "replace")))
                size += len(value) + 64
                if size >= PIECE:
                    yield pack()
                    rows, size = [], 0
    yield pack()


def read_array_texts(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(path, file, place, offset, value): each record of the arrays at ``path`` as text, with the file's number, its own within the file, and the byte where it starts."""
    spark.dataSource.register(JsonArrayRanges)
    cores = spark.sparkContext.defaultParallelism
    ranges = spark.read.format("json_array_ranges").option("rangeBytes", range_bytes).option("tasks", cores).load(path)
    starts = ranges.groupBy("path").applyInArrow(_starts, _STARTS)
    return starts.repartition(max(cores, len(_runs(path, range_bytes, cores)))).mapInArrow(_read, _RECORDS)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, range_bytes: int = RANGE) -> DataFrame:
    """Records of the arrays at ``path`` by ``schema``, with ``file``, the file's number, and ``place``, the one within the file. A record that does not fit ends the job."""
    texts = read_array_texts(spark, path, range_bytes)
    return texts.select("file", "place", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "place", "r.*")


def write_json_arrays(df: DataFrame, folder: str) -> DataFrame:
    """(path, records): rows as JSON arrays, a file for each of ``df``'s partitions, in ``folder``, which is there. What a lost task wrote is not in the list."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n = f"{folder}/{uuid.uuid4().hex}.json", 0
        fs, at = _opened(path)
        with fs.open_output_stream(at) as out:
            out.write(b"[")
            for b in batches:
                texts = b.column(0).to_pylist()
                if texts:
                    out.write(((",\n" if n else "\n") + ",\n".join(texts)).encode())
                n += len(texts)
            out.write(b"\n]\n")
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(write, "path string, records long")


cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark data source ``tensorarchive``.

Views (option ``view``): ``catalog`` has a row per tensor and reads headers alone; ``blocks`` has a row per run of at
most ``block_bytes`` bytes. Option ``names`` (a JSON list), ``rows`` (``start:stop`` along dimension 0) and ``index`` (a slice for each dimension) prune before
any data is read. The driver deals byte ranges of files by their sizes; headers are read by the tasks. With option ``pushdown`` true, filters on path, name and dtype (equality, IN, prefix) prune too; Spark 4.1
keeps what was pushed with the DataFrame it was pushed through, so use that only for a DataFrame that is filtered once.
Paths must be reachable by ``open`` on every executor (a shared mount); for a store that only Spark reads, load the files with
``binaryFile`` and use :func:`catalog_of_binary`.
"""

from __future__ import annotations

import bisect
import fnmatch
import itertools
import json
import math
import mmap
import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader, StringStartsWith, WriterCommitMessage

from tensorfold.errors import DuplicateTensor, TensorInvalidInfo, UnexpectedEOF
from tensorfold.functions.dtypes import dtype, native_shape, native_slice, nbytes
from tensorfold.sources.header import ALIGNMENT, Entry, Header, from_buffer, read_header, render

CATALOG = "path string, name string, dtype string, shape array<bigint>, ndim int, nelem bigint, nbytes bigint, off_start bigint, off_end bigint, header_length bigint, file_size bigint, aligned boolean, metadata map<string,string>"
BLOCKS = "path string, name string, dtype string, shape array<bigint>, block_id int, elem_start bigint, elem_count bigint, payload binary"
TENSOR_ROWS = "path string, name string, dtype string, shape array<bigint>, payload binary"
BLOCK_BYTES = 8 << 20
PARTITION_BYTES = 128 << 20
#: Bytes from which a file is parted so that all cores have some.
LEAST_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
FILES_TOGETHER = 256
#: Bytes of a row from which a small part of it is read alone.
STRIDED_ROW = 1 << 16
SUFFIX = ".safetensors"


def is_remote(path: str | list[str]) -> bool:
    """Whether a path has a scheme that only Spark can open."""
    return any("://" in p and not p.startswith("file://") for p in ([path] if isinstance(path, str) else path))


def discover(path: str | list[str]) -> list[str]:
    """Archive files under files, folders and patterns, each once: in the order of the list, and sorted where one entry stands for several."""
    out: dict[str, None] = {}
    for p in [path] if isinstance(path, str) else path:
        p = p if is_remote(p) else p.removeprefix("file://").removeprefix("file:")
        if is_remote(p):
            found = [p]
        elif os.path.isdir(p):
            found = sorted(os.path.join(d, x) for d, _, names in os.walk(p) for x in names if x.endswith(SUFFIX))
        elif any(c in p for c in "*?["):
            top = os.path.dirname(p)
            found = sorted(os.path.join(top, x) for x in os.listdir(top) if fnmatch.fnmatch(x, os.path.basename(p)))
        else:
            found = [p]
        out |= dict.fromkeys(found)
    return list(out)


def header_of(path: str) -> Header:
    with open(path, "rb") as f:
        return read_header(f, os.fstat(f.fileno()).st_size, path)


def catalog_rows(h: Header) -> Iterator[tuple]:
    for x in h.entries:
        yield (h.path, x.name, x.dtype, list(x.shape), len(x.shape), x.nelem, x.nbytes, x.start, x.end, h.header_length, h.file_size, h.aligned, h.metadata)


def catalog_of_binary(files: DataFrame) -> DataFrame:
    """The catalog of a DataFrame (path, content) of whole files, such as ``binaryFile`` gives."""

    def parse(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = [dict(zip(CATALOG_NAMES, r, strict=True)) for r in catalog_rows(from_buffer(content.as_py(), path))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, CATALOG_ARROW)

    return files.select("path", "content").mapInArrow(parse, CATALOG)


def blocks_of_binary(files: DataFrame, block_bytes: int = BLOCK_BYTES, names: list[str] | None = None, index: list | None = None) -> DataFrame:
    """The blocks of a DataFrame (path, content) of whole files, such as ``binaryFile`` gives."""
    options = {"block_bytes": str(block_bytes)} | ({"names": json.dumps(names)} if names is not None else {}) | ({"index": json.dumps(index)} if index is not None else {})

    def parse(batches):
        reader = ArchiveReader(options)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = content.as_buffer()
                for some in _together(list(reader.runs(from_buffer(raw, path))), BATCH_BYTES):
                    yield _block_batch(path, some, *_payloads(None, raw, path, some))

    return files.select("path", "content").mapInArrow(parse, BLOCKS)


def read_any_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The catalog of files, whichever way they can be opened."""
    return catalog_of_binary(spark.read.format("binaryFile").load(paths)) if is_remote(paths) else read_catalog(spark, paths)


CATALOG_NAMES = [x.split()[0] for x in CATALOG.replace("map<string,string>", "map").split(", ")]
CATALOG_ARROW = pa.schema(
    [("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("ndim", pa.int32())]
    + [(x, pa.int64()) for x in ("nelem", "nbytes", "off_start", "off_end", "header_length", "file_size")]
    + [("aligned", pa.bool_()), ("metadata", pa.map_(pa.string(), pa.string()))]
)
BLOCKS_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("block_id", pa.int32()), ("elem_start", pa.int64()), ("elem_count", pa.int64()), ("payload", pa.binary())])


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Ranges(InputPartition):
    """Byte ranges of files; a task reads the blocks that begin in them."""

    ranges: list[tuple[str, int, int]]


@dataclass(slots=True)
class Run:
    """A block: some rows along dimension 0 of a tensor, or of a slice of it."""

    entry: Entry
    shape: list[int]
    block_id: int
    elem_start: int
    elem_count: int
    offset: int
    length: int
    rows: range | None = None
    index: tuple[slice, ...] = ()


def native_index(entry: Entry, index: list) -> tuple[slice, ...]:
    """A slice for each stored dimension (packed values: in bytes), of [start, stop, step] lists; dimensions without one are whole."""
    if len(index) > len(entry.shape):
        raise IndexError(f"{len(index)} slices for {len(entry.shape)} dimensions of {entry.name}")
    full = tuple(slice(*(index[d] or ())) if d < len(index) and index[d] is not None else slice(None) for d in range(len(entry.shape)))
    return native_slice(entry.dtype, list(entry.shape), full)


class ArchiveReader(DataSourceReader):
    """Headers are read by the tasks: the driver lists files and their sizes, and deals byte ranges."""

    def __init__(self, options: dict):
        self.paths = options.get("path", "")
        self.view = options.get("view", "blocks").lower()
        self.block_bytes = int(options.get("block_bytes", BLOCK_BYTES))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.cores = int(options.get("cores", 0))
        self.mapped = options.get("mapped", "false").lower() == "true"
        self.index = json.loads(options["index"]) if options.get("index") else []
        if options.get("rows"):
            start, stop = (int(v) if v else None for v in options["rows"].split(":")[:2])
            self.index = [[start, stop, None]]
            self.places = True
        else:
            self.places = not self.index  # elem_start counts in the whole tensor, not in the slice
        self.tests: list[tuple[str, str, object]] = []
        if options.get("names"):
            self.tests.append(("name", "in", set(json.loads(options["names"]))))

    def passes(self, **values: str) -> bool:
        return all(values[k].startswith(v) if how == "prefix" else values[k] in v for k, how, v in self.tests if k in values)

    def partitions(self) -> list[InputPartition]:
        paths = [p for p in discover(self.paths.split(",")) if self.passes(path=p)]
        if self.view == "catalog":
            return [Files(paths[i : i + 16]) for i in range(0, len(paths), 16)] or [Files([])]
        most = self.partition_bytes
        if self.cores:
            most = min(most, max(LEAST_BYTES, -(-sum(map(os.path.getsize, paths)) // self.cores)))
        return [Ranges(r) for r in byte_ranges(paths, most)] or [Files([])]

    def runs(self, h: Header, low: int = 0, high: int = 1 << 62) -> Iterator[Run]:
        """The blocks of a file's wanted tensors that begin in a byte range, in the file's order; those before and after it are not counted through."""
        for x in h.entries:
            if not self.passes(name=x.name, dtype=x.dtype):
                continue
            kind = dtype(x.dtype)
            stored = native_shape(x.dtype, list(x.shape)) if self.index and x.shape else list(x.shape)
            packed = stored != list(x.shape)
            size = 1 if packed else kind.size  # bytes of a stored element
            index = native_index(x, self.index) if self.index and x.shape else ()
            if index:
                kept = [range(n)[i] for n, i in zip(stored, index, strict=True)]
                shape = [len(r) for r in kept]
                rows, wide = kept[0], math.prod(stored[1:])
                each = math.prod(shape[1:])
                most = max(1, int(self.block_bytes / size) // max(1, wide))
                if not each:
                    continue
                inner = index[1:] if any(r != range(n) for r, n in zip(kept[1:], stored[1:], strict=True)) else ()
                times = 2 if packed else 1
                shown = list(x.shape) if self.places else [*shape[:-1], shape[-1] * times]
                base = h.header_length + x.start

                def place(k, rows=rows, most=most, base=base, each_row=wide * size):
                    own = rows[k * most : (k + 1) * most]
                    return base + int(min(own[0], own[-1]) * each_row)

                for k in _within(-(-len(rows) // most), place, low, high):
                    at = k * most
                    own = rows[at : at + most]
                    below, above = min(own[0], own[-1]), max(own[0], own[-1]) + 1
                    first = own[0] if self.places else at
                    yield Run(x, shown, k, first * each * times, len(own) * each * times, place(k), int((above - below) * wide * size), own if inner or abs(own.step) != 1 or own.step < 0 else None, inner)
                continue
            wide = max(1, x.nelem // x.shape[0]) if x.shape and x.shape[0] else 1
            step = max(1, int(self.block_bytes / size) // wide) * wide if wide * size <= self.block_bytes else int(self.block_bytes / size) // 2 * 2
            step, shape, base = max(1, step), list(x.shape), h.header_length + x.start
            for k in _within(-(-x.nelem // step), lambda k, step=step, base=base, size=size: base + int(k * step * size), low, high):
                at = k * step
                n = min(step, x.nelem - at)
                yield Run(x, shape, k, at, n, base + int(at * size), int(n * size))

    def read(self, partition):
        if isinstance(partition, Files):
            for path in partition.paths:
                for row in catalog_rows(header_of(path)):
                    if self.passes(name=row[1], dtype=row[2]):
                        yield row
            return
        for path, low, high in partition.ranges:
            h = header_of(path)
            wanted = self.runs(h, low, high)
            if (first := next(wanted, None)) is None:
                continue
            with open(path, "rb") as f:
                data = pa.py_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)) if self.mapped else None
                for some in _together(itertools.chain([first], wanted), BATCH_BYTES):
                    yield _block_batch(path, some, *_payloads(f, data, path, some))


class PushingReader(ArchiveReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: lambda f: {f.value}, In: lambda f: set(f.value), StringStartsWith: lambda f: f.value}
        for f in filters:
            if type(f) in kinds and f.attribute in (("path",), ("name",), ("dtype",)):
                self.tests.append((f.attribute[0], "prefix" if isinstance(f, StringStartsWith) else "in", kinds[type(f)](f)))
            else:
                yield f


def byte_ranges(paths: list[str], most: int) -> list[list[tuple[str, int, int]]]:
    """Files cut to ranges of at most ``most`` bytes, small files together."""
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for p in paths:
        size = os.path.getsize(p)
        for low in range(0, max(size, 1), most):
            part = (p, low, min(size, low + most) if low + most < size else 1 << 62)
            n = min(most, size - low)
            if n > room or len(out[-1]) >= FILES_TOGETHER:
                out.append([])
                room = most
            out[-1].append(part)
            room -= n
    return out


def _within(n: int, offset: Callable[[int], int], low: int, high: int) -> range:
    """Which of ``n`` blocks have their offset in [low, high); the offsets rise with the number, or fall."""
    ks = range(n)
    if n and offset(n - 1) < offset(0):
        return ks[bisect.bisect_right(ks, -high, key=lambda k: -offset(k)) : bisect.bisect_right(ks, -low, key=lambda k: -offset(k))]
    return ks[bisect.bisect_left(ks, low, key=offset) : bisect.bisect_left(ks, high, key=offset)]


def _together(runs: Iterable[Run], most: int) -> Iterator[list[Run]]:
    """Runs whose payloads go in one batch."""
    held: list[Run] = []
    size = 0
    for r in runs:
        if held and (size + r.length > most or r.rows is not None or held[-1].rows is not None):
            yield held
            held, size = [], 0
        held.append(r)
        size += r.length
    if held:
        yield held


def _payloads(f, data: pa.Buffer | None, path: str, runs: list[Run]) -> tuple[list[int], pa.Buffer]:
    """Bounds of the payloads, and their bytes: one read (or none, when the file is mapped) where they lie back to back."""
    if runs[0].rows is not None:
        raw = _sliced(f, data, path, runs[0])
        return [0, len(raw)], pa.py_buffer(raw)
    bounds = [0]
    for r in runs:
        bounds.append(bounds[-1] + r.length)
    if all(a.offset + a.length == b.offset for a, b in itertools.pairwise(runs)):
        return bounds, _bytes(f, data, path, runs[0].offset, bounds[-1], runs[0].entry.name)
    return bounds, pa.py_buffer(b"".join(memoryview(_bytes(f, data, path, r.offset, r.length, r.entry.name)) for r in runs))


def _bytes(f, data: pa.Buffer | None, path: str, offset: int, length: int, name: str) -> pa.Buffer:
    if data is not None:
        found = data.slice(offset, max(0, min(length, data.size - offset)))
    else:
        raw = bytearray(length)
        f.seek(offset)
        at, view = 0, memoryview(raw)
        while at < length and (n := f.readinto(view[at:])):
            at += n
        found = pa.py_buffer(raw).slice(0, at)
    if found.size != length:
        raise UnexpectedEOF(f"{path}: {found.size} of {length} bytes of {name}")
    return found


def _sliced(f, data, path: str, r: Run) -> bytes:
    """The bytes of a block of a slice: the span of its rows is read and cut, or, where little of wide rows is wanted, each row's part alone."""
    x = r.entry
    stored = native_shape(x.dtype, list(x.shape))
    kind = np.dtype("u1") if stored != list(x.shape) else np.dtype(dtype(x.dtype).carrier)
    inner = [range(n)[i] for n, i in zip(stored[1:], r.index or (slice(None),) * len(stored[1:]), strict=True)]
    wide = math.prod(stored[1:])
    low = min(r.rows[0], r.rows[-1])
    if inner and inner[0] and all(q == range(n) for q, n in zip(inner[1:], stored[2:], strict=True)) and inner[0].step == 1:
        below = math.prod(stored[2:]) * kind.itemsize
        part, row = len(inner[0]) * below, wide * kind.itemsize
        if row >= STRIDED_ROW and part * 4 <= row:
            base = r.offset - low * row
            return b"".join(memoryview(_bytes(f, data, path, base + i * row + inner[0].start * below, part, x.name)) for i in r.rows)
    whole = np.frombuffer(_bytes(f, data, path, r.offset, r.length, x.name), kind).reshape(-1, *stored[1:])
    cut = whole[np.array(r.rows) - low]
    return np.ascontiguousarray(cut[(slice(None), *r.index)] if r.index else cut).tobytes()


def _block_batch(path: str, runs: list[Run], bounds: list[int], payload: pa.Buffer) -> pa.RecordBatch:
    payloads = pa.Array.from_buffers(pa.binary(), len(runs), [None, pa.py_buffer(np.array(bounds, np.int32)), payload])
    n, first = len(runs), runs[0]
    alike = all(r.entry is first.entry and r.shape == first.shape for r in runs)
    shown = [pa.repeat(pa.scalar(v, t), n) if alike else pa.array([f(r) for r in runs], t) for v, t, f in ((first.entry.name, pa.string(), lambda r: r.entry.name), (first.entry.dtype, pa.string(), lambda r: r.entry.dtype), (first.shape, pa.list_(pa.int64()), lambda r: r.shape))]
    counts = [pa.array([r.block_id for r in runs], pa.int32()), pa.array([r.elem_start for r in runs], pa.int64()), pa.array([r.elem_count for r in runs], pa.int64())]
    return pa.RecordBatch.from_arrays([pa.repeat(path, n), *shown, *counts, payloads], schema=BLOCKS_ARROW)


@dataclass
class Written(WriterCommitMessage):
    path: str
    final: str
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """One archive per task, of tensors or blocks of them: (name, dtype, shape, elem_start, payload), blocks of a tensor in order.

    Payloads go to a spill file beside the archive as they come, so a task holds a batch at a time. Files are named by job, so an append adds
    to what is there; names are held against those of the files there. With overwrite the files of before go once the new ones are in place.
    """

    def __init__(self, options: dict, overwrite: bool = False):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.metadata = {k.removeprefix("metadata."): v for k, v in options.items() if k.startswith("metadata.")}
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        final = os.path.join(self.path, f"part-{self.job}-{part.partitionId():05d}{SUFFIX}")
        temporary = f"{final}.{part.taskAttemptId()}.tmp"
        parts: dict[str, tuple[str, list[int], list[tuple[int, int]]]] = {}  # name: type, shape, ranges in the spill file
        held: dict[str, int] = {}
        try:
            with open(f"{temporary}.spill", "w+b") as spill:
                for b in batches:
                    starts = b.column("elem_start").to_pylist() if "elem_start" in b.schema.names else [None] * b.num_rows
                    for name, kind, shape, start, payload in zip(b.column("name").to_pylist(), b.column("dtype").to_pylist(), b.column("shape").to_pylist(), starts, b.column("payload"), strict=True):
                        raw = payload.as_buffer()
                        if name in parts and not start:
                            raise DuplicateTensor(f"tensors that come twice: {name}")
                        own = parts.setdefault(name, (kind, shape, []))[2]
                        if start is not None and int(start * dtype(kind).size) != held.get(name, 0):
                            raise TensorInvalidInfo(f"{name}: a block begins at element {start}, after {held.get(name, 0)} bytes")
                        at = spill.tell()
                        spill.write(raw)
                        held[name] = held.get(name, 0) + raw.size
                        if own and own[-1][1] == at:
                            own[-1] = (own[-1][0], at + raw.size)
                        else:
                            own.append((at, at + raw.size))
                if not parts:
                    return Written("", "", [])
                order = sorted(parts, key=lambda n: (-dtype(parts[n][0]).size, n))  # wide types first keep every tensor aligned
                for n in order:
                    if held[n] != nbytes(parts[n][0], parts[n][1]):
                        raise TensorInvalidInfo(f"{n} is {parts[n][0]} {parts[n][1]} in {held[n]} bytes")
                spill.flush()
                with open(temporary, "wb") as f:
                    f.write(render([(n, *parts[n][:2]) for n in order], self.metadata))
                    f.flush()
                    for n in order:
                        for a, z in parts[n][2]:
                            copy_range(spill.fileno(), f.fileno(), a, z - a)
        finally:
            if os.path.exists(f"{temporary}.spill"):
                os.remove(f"{temporary}.spill")
        return Written(temporary, final, list(parts))

    def commit(self, messages: list[Written]) -> None:
        put_in_place(self.path, [m for m in messages if m and m.path], self.overwrite)

    def abort(self, messages: list[Written]) -> None:
        remove([m for m in messages if m and m.path])


def put_in_place(folder: str, written: list[Written], overwrite: bool) -> None:
    """Gives finished files their names, unless a tensor is in two of them or, for an append, in a file that is there; with overwrite the files of before go."""
    before = discover(folder) if os.path.isdir(folder) else []
    names = [n for m in written for n in m.names]
    if not overwrite:
        names += [x.name for p in before for x in header_of(p).entries]
    if twice := sorted(_twice(names)):
        remove(written)
        raise DuplicateTensor(f"tensors that come twice: {', '.join(twice[:5])}")
    for m in written:
        os.replace(m.path, m.final)
    if overwrite:
        for p in before:
            os.remove(p)


def remove(written: list[Written]) -> None:
    for m in written:
        if os.path.exists(m.path):
            os.remove(m.path)


def block_spans(b: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Buffer]]:
    """(first, count, bytes) of a batch's rows that follow one another in a tensor; their bytes lie together, so nothing is copied."""
    n = b.num_rows
    if not n:
        return
    starts, payload = b.column("elem_start").fill_null(0).to_numpy(), b.column("payload")
    bounds = np.frombuffer(payload.buffers()[1], np.int64 if pa.types.is_large_binary(payload.type) else np.int32)[payload.offset : payload.offset + n + 1]
    kinds = b.column("dtype").dictionary_encode()
    codes = kinds.indices.to_numpy()
    sizes = np.array([dtype(k).size for k in kinds.dictionary.to_pylist()])[codes]
    shapes = b.column("shape")
    wide = np.diff(shapes.offsets.to_numpy())
    if (wide == wide[0]).all():
        shown = shapes.flatten().to_numpy().reshape(n, -1)
        same = (shown[1:] == shown[:-1]).all(axis=1)
    else:
        every = shapes.to_pylist()
        same = np.array([x == y for x, y in itertools.pairwise(every)])
    names = b.column("name").dictionary_encode().indices.to_numpy()
    same &= (names[1:] == names[:-1]) & (codes[1:] == codes[:-1]) & (starts[1:] == starts[:-1] + np.diff(bounds)[:-1] / sizes[:-1])
    cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), n]
    for i, j in itertools.pairwise(cuts):
        yield i, j - i, payload.buffers()[2].slice(int(bounds[i]), int(bounds[j] - bounds[i])) if bounds[j] > bounds[i] else pa.py_buffer(b"")


def _write_blocks(blocks: DataFrame, folder: str, files: int, metadata: dict[str, str], overwrite: bool, layout: list[tuple[str, str, list[int]]] | None) -> None:
    """Files whose headers the driver writes; each task puts its blocks where they belong in them, so no block is sent anywhere and no task holds or reads a tensor.

    What was written is told as byte spans, whose starts and ends must pair off but for a tensor's first and last: so each byte came once. A task
    that runs again writes the same bytes to the same place.
    """
    folder, job = folder.removeprefix("file://").removeprefix("file:"), uuid.uuid4().hex[:12]
    layout = [(r[0], r[1], list(r[2])) for r in blocks.select("name", "dtype", "shape").distinct().collect()] if layout is None else layout
    dealt: dict[int, list] = {}
    for x in layout:
        dealt.setdefault(zlib.crc32(x[0].encode()) % files, []).append(x)
    os.makedirs(folder, exist_ok=True)
    written, at = [], {}
    try:
        for k, own in sorted(dealt.items()):
            own.sort(key=lambda x: (-dtype(x[1]).size, x[0]))  # wide types first keep every tensor aligned
            final = os.path.join(folder, f"part-{job}-{k:05d}{SUFFIX}")
            at[k] = f"{final}.tmp"
            written.append(Written(at[k], final, [x[0] for x in own]))
            header = render(own, metadata)
            with open(at[k], "wb") as f:
                f.write(header)
                f.truncate(len(header) + sum(nbytes(kind, shape) for _, kind, shape in own))

        def place(batches):
            opened: dict[int, tuple] = {}
            try:
                for b in batches:
                    told = []
                    for i, _, raw in block_spans(b):
                        name, kind, shape, start = (b.column(c)[i].as_py() for c in ("name", "dtype", "shape", "elem_start"))
                        k = zlib.crc32(name.encode()) % files
                        if k not in opened and k in at:
                            h = header_of(at[k])
                            opened[k] = (os.open(at[k], os.O_WRONLY), h.header_length, {x.name: x for x in h.entries})
                        fd, base, entries = opened.get(k, (None, 0, {}))
                        x, low = entries.get(name), (start or 0) * dtype(kind).size
                        if x is None or (x.dtype, list(x.shape)) != (kind, shape) or low != int(low) or not 0 <= low <= low + raw.size <= x.nbytes:
                            raise TensorInvalidInfo(f"{name}: a block of {raw.size} bytes at element {start} of {kind} {shape} has no place in {x}")
                        low, done, view = int(low), 0, memoryview(raw)
                        while done < raw.size:
                            done += os.pwrite(fd, view[done:], base + x.start + low + done)
                        told += [(name, low, 1), (name, low + raw.size, -1)] if raw.size else []
                    yield pa.RecordBatch.from_arrays([pa.array([t[c] for t in told], kind) for c, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["name", "at", "w"])
            finally:
                for fd, *_ in opened.values():
                    os.close(fd)

        ends = blocks.mapInArrow(place, "name string, at bigint, w bigint").groupBy("name", "at").agg(F.sum("w").alias("w")).where("w <> 0")
        sizes, kinds = {name: n for name, kind, shape in layout if (n := nbytes(kind, shape))}, {name: dtype(kind).size for name, kind, _ in layout}
        found = {(r[0], r[1]): r[2] for r in ends.take(2 * len(sizes) + 1)}
        right = {(n, 0): 1 for n in sizes} | {(n, z): -1 for n, z in sizes.items()}
        if wrong := sorted(k for k in found.keys() | right.keys() if found.get(k) != right.get(k)):
            if twice := sorted({n for n, _ in wrong if found.get((n, 0), 0) > 1}):
                raise DuplicateTensor(f"tensors that come twice: {', '.join(twice[:5])}")
            raise TensorInvalidInfo("; ".join(f"{n} of {sizes[n]} bytes: " + (f"a block {'begins' if found[n, b] > 0 else 'ends'} at element {b // kinds[n]:g}, where no other meets it" if (n, b) in found else f"no block has byte {min(b, sizes[n] - 1)}") for n, b in wrong[:5]))
    except BaseException:
        remove(written)
        raise
    put_in_place(folder, written, overwrite)


def copy_range(source: int, target: int, offset: int, length: int) -> None:
    """Bytes of one open file to the place where another stands, without passing through Python where the system can."""
    while length:
        n = os.sendfile(target, source, offset, length)
        if not n:
            raise UnexpectedEOF(f"{length} bytes are missing")
        offset, length = offset + n, length - n


def _twice(names: list[str]) -> set[str]:
    seen: set[str] = set()
    return {n for n in names if n in seen or seen.add(n)}


class ArchiveStream(SimpleDataSourceStreamReader):
    """The files of a batch of ``world_size`` a trigger, in the order of the list; the offset is the batch's number. Tasks read what is in them (``read_stream``)."""

    def __init__(self, options: dict):
        self.files = discover(options.get("path", "").split(","))
        self.width = int(options.get("world_size", 1))

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        k = start["batch"]
        return self.batch(k), {"batch": k + 1} if k * self.width < len(self.files) else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for k in range(start["batch"], end["batch"]) for r in self.batch(k)])

    def batch(self, k: int) -> Iterator[tuple]:
        return iter([(k, rank, path) for rank, path in enumerate(self.files[k * self.width : (k + 1) * self.width])])


STREAM = f"batch int, rank int, ordinal int, {TENSOR_ROWS}"


def _tensors_of_files(batches):
    """Whole tensors of each listed file, a tensor a batch."""
    for b in batches:
        for k, rank, path in zip(*(b.column(c).to_pylist() for c in ("batch", "rank", "path")), strict=True):
            h = header_of(path)
            with open(path, "rb") as f:
                for ordinal, x in enumerate(h.entries):
                    raw = _bytes(f, None, path, h.header_length + x.start, x.nbytes, x.name)
                    row = (k, rank, ordinal, path, x.name, x.dtype, list(x.shape))
                    payload = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], np.int32)), raw])
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip(row, STREAM_ARROW, strict=False)), payload], schema=STREAM_ARROW)


STREAM_ARROW = pa.schema([("batch", pa.int32()), ("rank", pa.int32()), ("ordinal", pa.int32()), ("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("payload", pa.binary())])


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensorarchive"

    def schema(self) -> str:
        view = self.options.get("view", "blocks").lower()
        return {"catalog": CATALOG, "blocks": BLOCKS, "stream": "batch int, rank int, path string"}[view]

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else ArchiveReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)

    def simpleStreamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``format("tensorarchive")`` known to a session. Its settings are left alone: option ``pushdown`` needs ``spark.sql.python.filterPushdown.enabled``."""
    spark.dataSource.register(ArchiveSource)


def read_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    register(spark)
    return spark.read.format("tensorarchive").option("view", "catalog").load(paths if isinstance(paths, str) else ",".join(paths))


def read_blocks(spark: SparkSession, paths: str | list[str], rows: str | None = None, block_bytes: int = BLOCK_BYTES, names: list[str] | None = None, pushdown: bool = False, index: list | None = None, mapped: bool = False, partition_bytes: int | None = None) -> DataFrame:
    """Blocks of tensors. ``rows`` keeps a range of dimension 0 with places in the whole tensor; ``index`` (a [start, stop, step] or None for each dimension)
    gives the slice as a tensor of its own. Only bytes of wanted rows are read; ``mapped`` maps files instead of reading them. Without ``partition_bytes`` a task has at most 128 MiB, and less where cores would have nothing."""
    register(spark)
    r = spark.read.format("tensorarchive").option("view", "blocks").option("block_bytes", block_bytes).option("pushdown", pushdown).option("mapped", mapped)
    r = r.option("cores", spark.sparkContext.defaultParallelism) if partition_bytes is None else r.option("partition_bytes", partition_bytes)
    r = r.option("names", json.dumps(names)) if names is not None else r
    r = r.option("index", json.dumps(index)) if index is not None else r
    return (r.option("rows", rows) if rows else r).load(paths if isinstance(paths, str) else ",".join(paths))


def read_stream(spark: SparkSession, paths: str | list[str], world_size: int = 1) -> DataFrame:
    """Whole tensors of the files, a batch of ``world_size`` files a trigger. The driver hands out paths; tasks, one a rank, read headers and bytes."""
    register(spark)
    files = spark.readStream.format("tensorarchive").option("view", "stream").option("world_size", world_size).load(paths if isinstance(paths, str) else ",".join(paths))
    return files.repartition(world_size, "rank").mapInArrow(_tensors_of_files, STREAM)


def write_archive(tensors: DataFrame, path: str, files: int = 1, metadata: dict[str, str] | None = None, mode: str = "append", layout: list[tuple[str, str, list[int]]] | None = None) -> None:
    """Writes tensors (name, dtype, shape, payload), or blocks of them (with elem_start, in any order), as archives, spread over files by name. Archive data starts at multiples of
    16 bytes. ``append`` adds files and refuses names that are there; ``overwrite`` replaces the archives of the folder. Whole tensors are dealt to a task a file. Blocks are
    written where they are by all tasks, into the same files, which the mount must allow; with ``layout``, the (name, dtype, shape) of all tensors, they are made only once."""
    if "elem_start" in tensors.columns:
        if mode not in ("append", "overwrite"):
            raise ValueError(f"mode {mode!r} is neither append nor overwrite")
        _write_blocks(tensors.select("name", "dtype", "shape", F.col("elem_start").cast("bigint").alias("elem_start"), "payload"), path, files, metadata or {}, mode == "overwrite", layout)
        return
    register(tensors.sparkSession)
    rows = tensors.select("name", "dtype", "shape", F.lit(None).cast("bigint").alias("elem_start"), "payload")
    w = rows.repartition(files, F.xxhash64("name")).write.format("tensorarchive")
    for k, v in (metadata or {}).items():
        w = w.option(f"metadata.{k}", v)
    w.mode(mode).save(path)


def realign_file(source: str, target: str) -> bool:
    """Writes an archive again with its data at a multiple of 16, by way of the file system's own copy; False, and nothing written, if it lies there already."""
    h = header_of(source)
    if h.aligned:
        return False
    with open(source, "rb") as f, open(f"{target}.tmp", "wb") as out:
        out.write(render([(x.name, x.dtype, list(x.shape)) for x in h.entries], h.metadata))
        out.flush()
        copy_range(f.fileno(), out.fileno(), h.header_length, h.file_size - h.header_length)
    os.replace(f"{target}.tmp", target)
    return True


def realign(spark: SparkSession, paths: str | list[str], folder: str) -> DataFrame:
    """(path, target, rewritten) of archives, each realigned by a task into a folder under its own name."""
    folder = folder.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        for b in batches:
            found = b.column("path").to_pylist()
            targets = [os.path.join(folder, os.path.basename(p)) for p in found]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(targets), pa.array([realign_file(p, t) for p, t in zip(found, targets, strict=True)])], names=["path", "target", "rewritten"])

    files = discover(paths)
    return spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, len(files))).mapInArrow(run, "path string, target string, rewritten boolean")


__all__ = ["ALIGNMENT", "ArchiveSource", "catalog_of_binary", "discover", "read_blocks", "read_catalog", "read_stream", "realign", "realign_file", "register", "write_archive"]

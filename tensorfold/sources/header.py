"""Headers of tensor archives: u64 length, JSON, then the tensors' bytes back to back."""

from __future__ import annotations

import io
import json
import struct
from dataclasses import dataclass, field
from typing import BinaryIO

from tensorfold import errors as E
from tensorfold.functions.dtypes import DTYPES, nbytes, nelem

# Fixed values of the format.
LENGTH_BYTES = 8
MAX_HEADER = 100_000_000
ALIGNMENT = 16
META = "__metadata__"


@dataclass(frozen=True)
class Entry:
    """One tensor of a header."""

    name: str
    dtype: str
    shape: tuple[int, ...]
    start: int
    end: int

    @property
    def nelem(self) -> int:
        return nelem(list(self.shape))

    @property
    def nbytes(self) -> int:
        return self.end - self.start


@dataclass(frozen=True)
class Header:
    path: str
    header_length: int
    file_size: int
    entries: tuple[Entry, ...]
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def aligned(self) -> bool:
        return self.header_length % ALIGNMENT == 0


def read_exact(f: BinaryIO, length: int, path: str) -> bytes:
    """That many bytes, over as many short reads as it takes."""
    out = bytearray()
    while len(out) < length:
        if not (got := f.read(length - len(out))):
            raise E.UnexpectedEOF(f"{path}: it ends after {len(out)} of {length} bytes")
        out += got
    return bytes(out)


def read_header(f: BinaryIO, file_size: int, path: str) -> Header:
    if file_size < LENGTH_BYTES:
        raise E.HeaderTooSmall(f"{path}: {file_size} bytes")
    (n,) = struct.unpack("<Q", read_exact(f, LENGTH_BYTES, path))
    if n > MAX_HEADER:
        raise E.HeaderTooLarge(f"{path}: a header of {n} bytes; the most is {MAX_HEADER}")
    if n > file_size - LENGTH_BYTES:
        raise E.InvalidHeaderLength(f"{path}: a header of {n} bytes in a file of {file_size}")
    return parse(read_exact(f, n, path), file_size, path)


def from_buffer(data: bytes, path: str = "") -> Header:
    return read_header(io.BytesIO(data), len(data), path)


def parse(text: bytes, file_size: int, path: str = "") -> Header:
    """Checks a header: each tensor's size, no gaps or overlaps, and an end within the file. Bytes after the last tensor may follow."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise E.InvalidHeader(f"{path}: {e}") from None
    if not isinstance(found, dict):
        raise E.InvalidHeader(f"{path}: the header is not an object")
    metadata = found.pop(META, None) or {}
    try:
        entries = [Entry(k, v["dtype"], tuple(map(int, v["shape"])), *map(int, v["data_offsets"])) for k, v in found.items()]
    except (KeyError, TypeError, ValueError) as e:
        raise E.TensorInvalidInfo(f"{path}: {e!r}") from None
    entries.sort(key=lambda x: (x.start, x.end))
    at, header_length = 0, LENGTH_BYTES + len(text)
    for x in entries:
        if x.start != at or x.end < x.start:
            raise E.InvalidOffset(f"{path}: {x.name} lies at [{x.start}, {x.end}); {at} was next")
        if x.dtype not in DTYPES or any(s < 0 for s in x.shape) or nbytes(x.dtype, list(x.shape)) != x.nbytes:
            raise E.TensorInvalidInfo(f"{path}: {x.name} is {x.dtype} {list(x.shape)} in {x.nbytes} bytes")
        at = x.end
    if header_length + at > file_size:
        raise E.MetadataIncompleteBuffer(f"{path}: its tensors end at {header_length + at}, the file at {file_size}")
    return Header(path, header_length, file_size, tuple(entries), metadata)


def render(tensors: list[tuple[str, str, list[int]]], metadata: dict[str, str] | None = None) -> bytes:
    """Length and JSON of a header for tensors in this order, with spaces so that the data starts at a multiple of 16."""
    body: dict = {META: metadata} if metadata else {}
    at = 0
    for name, dtype, shape in tensors:
        if name in body or name == META:
            raise E.DuplicateTensor(f"tensor {name} comes twice")
        size = nbytes(dtype, list(shape))
        body[name] = {"dtype": dtype, "shape": list(shape), "data_offsets": [at, at + size]}
        at += size
    text = json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()
    text += b" " * (-(LENGTH_BYTES + len(text)) % ALIGNMENT)
    return struct.pack("<Q", len(text)) + text


def realign(data: bytes, path: str = "") -> bytes:
    """The same archive with its data at a multiple of 16; unchanged if it is there already."""
    h = from_buffer(data, path)
    if h.aligned:
        return data
    return render([(x.name, x.dtype, list(x.shape)) for x in h.entries], h.metadata) + data[h.header_length :]


def header_of_bytes(f: BinaryIO, path: str = "") -> Header:
    """The header of an open, seekable file."""
    f.seek(0, io.SEEK_END)
    size = f.tell()
    f.seek(0)
    return read_header(f, size, path)

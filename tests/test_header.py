import io
import json
import struct

import pytest

from tensorfold import errors as E
from tensorfold.sources import header as H


def raw(body, data=b"", n=None):
    text = json.dumps(body).encode() if not isinstance(body, bytes) else body
    return struct.pack("<Q", len(text) if n is None else n) + text + data


A = {"dtype": "F16", "shape": [2, 2], "data_offsets": [0, 8]}


def test_parse():
    h = H.from_buffer(raw({"__metadata__": {"k": "v"}, "b": {"dtype": "U8", "shape": [], "data_offsets": [8, 9]}, "a": A}, bytes(12)))
    assert [e.name for e in h.entries] == ["a", "b"]
    assert h.metadata == {"k": "v"} and h.entries[1].nelem == 1
    assert H.from_buffer(raw({"__metadata__": {}})).metadata == {}


@pytest.mark.parametrize(
    "data, error",
    [
        (b"abcd", E.HeaderTooSmall),
        (raw(b"", n=100_000_001), E.HeaderTooLarge),
        (raw(bytes(42), n=100), E.InvalidHeaderLength),
        (raw({"a": {**A, "data_offsets": [4, 12]}}, bytes(12)), E.InvalidOffset),
        (raw({"a": A, "b": {**A, "data_offsets": [6, 14]}}, bytes(20)), E.InvalidOffset),
        (raw({"a": {**A, "shape": [3, 2]}}, bytes(8)), E.TensorInvalidInfo),
        (raw({"a": {**A, "dtype": "Q7"}}, bytes(8)), E.TensorInvalidInfo),
        (raw({"a": {"dtype": "F16"}}, bytes(8)), E.TensorInvalidInfo),
        (raw({"a": A}, bytes(7)), E.MetadataIncompleteBuffer),
        (raw(b"[]"), E.InvalidHeader),
        (raw(b"{"), E.InvalidHeader),
    ],
)
def test_errors(data, error):
    with pytest.raises(error):
        H.from_buffer(data)


def test_empty_tensors_tie():
    z = {"dtype": "F16", "shape": [0], "data_offsets": [0, 0]}
    assert [e.name for e in H.from_buffer(raw({"a": A, "z": z}, bytes(8))).entries] == ["z", "a"]


def test_short_reads():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 3))

    assert H.read_exact(Slow(b"0123456789"), 10, "") == b"0123456789"
    with pytest.raises(E.UnexpectedEOF):
        H.read_exact(Slow(b"01"), 3, "")


def test_render_and_realign():
    text = H.render([("a", "F16", [2, 2]), ("b", "F4", [2, 2])], {"k": "v"})
    h = H.from_buffer(text + bytes(10))
    assert h.aligned and h.metadata == {"k": "v"} and h.entries[1].nbytes == 2
    odd = raw({"a": A}, b"12345678")
    fixed = H.realign(odd if not H.from_buffer(odd).aligned else raw({"aa": A}, b"12345678"))
    assert H.from_buffer(fixed).aligned and fixed.endswith(b"12345678")
    assert H.realign(fixed) == fixed
    with pytest.raises(E.DuplicateTensor):
        H.render([("a", "F16", [1]), ("a", "F16", [1])])

import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tensorfold import errors as E
from tensorfold.functions import dtypes as D


def test_bf16_is_the_upper_half_of_f32():
    codes = np.arange(1 << 16, dtype="<u2")
    got = D.decode("BF16", codes.tobytes()).view("<u4")
    assert (got == codes.astype("u4") << 16).all()


def test_f16_matches_struct():
    codes = np.arange(1 << 16, dtype="<u2").tobytes()
    want = np.array(struct.unpack(f"<{1 << 16}e", codes))
    assert np.array_equal(D.decode("F16", codes), want.astype("f4"), equal_nan=True)


def fields(code, e, m, bias):
    sign, exp, man = code >> (e + m), code >> m & ((1 << e) - 1), code & ((1 << m) - 1)
    return (-1) ** sign * (man / 2**m * 2 ** (1 - bias) if exp == 0 else (1 + man / 2**m) * 2.0 ** (exp - bias)), exp, man


def test_small_floats_all_patterns():
    every = bytes(range(256))
    e4, e5, e8 = (D.decode(k, every) for k in ("F8_E4M3", "F8_E5M2", "F8_E8M0"))
    for c in range(256):
        v, exp, man = fields(c, 4, 3, 7)
        assert np.isnan(e4[c]) if (exp, man) == (15, 7) else e4[c] == v
        v, exp, man = fields(c, 5, 2, 15)
        assert (np.isnan(e5[c]) if man else np.isinf(e5[c])) if exp == 31 else e5[c] == v
        assert np.isnan(e8[c]) if c == 255 else e8[c] == np.float32(2.0 ** (c - 127))
    low = [0, 0.5, 1, 1.5, 2, 3, 4, 6]
    assert list(D.TABLES["F4"]) == low + [-x for x in low]
    assert list(D.decode("F4", bytes([0x21]))) == [0.5, 1]


@pytest.mark.parametrize("name", [k for k in D.DTYPES if k not in ("F8_E8M0",)])
def test_encode_undoes_decode(name):
    raw = bytes(range(256)) * 8
    values = D.decode(name, raw)
    again = D.decode(name, D.encode(name, values))
    assert np.array_equal(values, again, equal_nan=values.dtype.kind == "f")


@given(st.sampled_from(sorted(D.DTYPES)), st.lists(st.integers(0, 9), max_size=4))
def test_sizes(name, shape):
    assert D.nelem([]) == 1
    assert D.nbytes(name, shape) == int(np.prod(shape, dtype=float) * D.dtype(name).size)


def test_casts():
    assert D.cast_allowed("F32", "F16") == "F16"
    assert D.cast_allowed("F16", "BF16") == "BF16"
    assert D.cast_allowed("F16", D.AUTO) == "F16"
    assert D.cast_allowed("F16", "F64", "free") == "F64"
    with pytest.raises(E.EnlargingCast):
        D.cast_allowed("F16", "F32")
    assert list(D.decode("I8", D.convert("F32", np.array([2.7, -2.7], "<f4").tobytes(), "I8"))) == [2, -2]
    with pytest.raises(E.UnknownDType):
        D.dtype("F12")


def test_packed_shapes_and_slices():
    assert D.native_shape("F4", [8, 16]) == [8, 8]
    assert D.native_shape("F16", [8, 16]) == [8, 16]
    assert D.native_slice("F4", [8, 16], (slice(0, 2), slice(4, 8))) == (slice(0, 2), slice(2, 4, 1))
    for bad in (slice(1, 4), slice(0, 3), slice(0, 8, 2)):
        with pytest.raises(E.OddPackedExtent):
            D.native_slice("F4", [8, 16], (slice(0, 2), bad))
    with pytest.raises(E.OddPackedExtent):
        D.native_shape("F4", [8, 15])

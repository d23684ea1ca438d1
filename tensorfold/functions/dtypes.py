"""The seventeen storage types of an archive: width, NumPy carrier, Spark type, decoding and encoding."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import types as T

from tensorfold.errors import EnlargingCast, OddPackedExtent, UnknownDType

#: Keeps the stored type where a conversion could be asked for.
AUTO = "AUTO"


@dataclass(frozen=True)
class DType:
    name: str
    size: float
    carrier: str
    spark: T.DataType


# The names and widths of the archive format's types.
DTYPES: dict[str, DType] = {
    d.name: d
    for d in (
        DType("BOOL", 1, "<u1", T.BooleanType()),
        DType("I8", 1, "<i1", T.ByteType()),
        DType("I16", 2, "<i2", T.ShortType()),
        DType("I32", 4, "<i4", T.IntegerType()),
        DType("I64", 8, "<i8", T.LongType()),
        DType("U8", 1, "<u1", T.ShortType()),
        DType("U16", 2, "<u2", T.IntegerType()),
        DType("U32", 4, "<u4", T.LongType()),
        DType("U64", 8, "<u8", T.DecimalType(20, 0)),
        DType("F16", 2, "<f2", T.FloatType()),
        DType("BF16", 2, "<u2", T.FloatType()),
        DType("F32", 4, "<f4", T.FloatType()),
        DType("F64", 8, "<f8", T.DoubleType()),
        DType("F8_E5M2", 1, "<u1", T.FloatType()),
        DType("F8_E4M3", 1, "<u1", T.FloatType()),
        DType("F8_E8M0", 1, "<u1", T.FloatType()),
        DType("F4", 0.5, "<u1", T.FloatType()),
    )
}


# Integer types whose bytes carry small and packed floats.
CARRIERS = {"F8_E5M2": "I8", "F8_E4M3": "I8", "F8_E8M0": "U8", "F4": "U8"}


def carrier_of(name: str) -> str:
    return CARRIERS.get(name, dtype(name).name)


def dtype(name: str) -> DType:
    """The type of that name; UnknownDType names the known ones."""
    try:
        return DTYPES[name]
    except KeyError:
        raise UnknownDType(f"dtype {name!r} is unknown; known: {', '.join(DTYPES)}") from None


def nelem(shape: list[int]) -> int:
    """Elements of a shape; a scalar's shape is empty and has one."""
    return prod(shape)


def nbytes(name: str, shape: list[int]) -> int:
    return int(prod(shape) * dtype(name).size)


def native_shape(name: str, shape: list[int]) -> list[int]:
    """The shape in stored bytes: two packed values share a byte along the last dimension."""
    if name != "F4" or not shape:
        return list(shape)
    if shape[-1] % 2:
        raise OddPackedExtent(f"the last extent of a packed 4-bit tensor is {shape[-1]}; it must be even")
    return [*shape[:-1], shape[-1] // 2]


def native_slice(name: str, shape: list[int], index: tuple) -> tuple:
    """A logical index over packed values as an index over bytes: even bounds and step 1 along the last dimension."""
    if name != "F4" or len(index) < len(shape) or not shape:
        return index
    start, stop, step = index[-1].indices(shape[-1]) if isinstance(index[-1], slice) else (index[-1], index[-1] + 1, 1)
    if step != 1 or start % 2 or stop % 2:
        raise OddPackedExtent(f"[{start}:{stop}:{step}] does not fall on byte bounds of a packed 4-bit tensor")
    return (*index[:-1], slice(start // 2, stop // 2, 1))


def _small_float(exponent_bits: int, mantissa_bits: int, bias: int) -> np.ndarray:
    """Values of all patterns of a sign, exponent and mantissa format without infinities."""
    codes = np.arange(1 << (1 + exponent_bits + mantissa_bits))
    mantissa = codes & ((1 << mantissa_bits) - 1)
    exponent = (codes >> mantissa_bits) & ((1 << exponent_bits) - 1)
    scale = np.where(exponent == 0, 1, exponent) - bias
    value = np.ldexp(mantissa / (1 << mantissa_bits) + (exponent > 0), scale)
    return np.where(codes >> (exponent_bits + mantissa_bits), -value, value).astype(np.float32)


def _tables() -> dict[str, np.ndarray]:
    e4m3 = _small_float(4, 3, 7)
    e4m3[[0x7F, 0xFF]] = np.nan
    e8m0 = np.ldexp(np.float64(1), np.minimum(np.arange(256), 254) - 127).astype(np.float32)
    e8m0[255] = np.nan
    e5m2 = (np.arange(256, dtype="<u2") << 8).view("<f2").astype(np.float32)
    return {"F8_E4M3": e4m3, "F8_E5M2": e5m2, "F8_E8M0": e8m0, "F4": _small_float(2, 1, 1)}


TABLES = _tables()


def decode(name: str, raw: bytes) -> np.ndarray:
    """The values of raw bytes, in the widened NumPy type that the Spark type holds."""
    data = np.frombuffer(raw, dtype(name).carrier)
    if name == "BOOL":
        return data != 0
    if name == "BF16":
        return (data.astype("<u4") << 16).view("<f4")
    if name == "F4":
        return TABLES[name][np.stack([data & 15, data >> 4], axis=1).reshape(-1)]
    if name in TABLES:
        return TABLES[name][data]
    return data.astype({"U8": "i2", "U16": "i4", "U32": "i8", "F16": "f4"}.get(name, data.dtype))


def bits(name: str, raw: bytes) -> np.ndarray:
    """The stored bit pattern of each element as an int64 (of U64, two's complement)."""
    data = np.frombuffer(raw, f"<u{max(1, int(dtype(name).size))}")
    if name == "F4":
        data = np.stack([data & 15, data >> 4], axis=1).reshape(-1)
    return data.astype("u8").view("i8")


def encode(name: str, values: np.ndarray) -> bytes:
    """Bytes of values in a type; ties go to the even pattern, and small floats take the nearest value."""
    values = np.asarray(values)
    if name == "BF16":
        wide = values.astype("<f4").view("<u4").astype("u8")
        rounded = (wide + 0x7FFF + ((wide >> 16) & 1)) >> 16
        return np.where(np.isnan(values.astype("f4")), (wide >> 16) | 0x40, rounded).astype("<u2").tobytes()
    if name in TABLES:
        codes = _nearest(TABLES[name], values.astype("f8"))
        if name == "F4":
            if codes.size % 2:
                raise OddPackedExtent("an odd count of packed 4-bit values")
            codes = codes[0::2] | (codes[1::2] << 4)
        return codes.astype("u1").tobytes()
    if name == "BOOL":
        return (values != 0).astype("u1").tobytes()
    return values.astype(dtype(name).carrier).tobytes()


def _nearest(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    codes = np.flatnonzero(np.isfinite(table))
    codes = codes[np.lexsort((np.signbit(table[codes]), table[codes]))]
    kept = np.r_[True, np.diff(table[codes]) != 0]
    codes, ladder = codes[kept], table[codes[kept]].astype("f8")
    high = np.clip(np.searchsorted(ladder, values), 1, len(ladder) - 1)
    below, above = values - ladder[high - 1], ladder[high] - values
    up = (above < below) | ((above == below) & (codes[high] % 2 == 0))
    out = np.where(up, codes[high], codes[high - 1])
    for end in np.flatnonzero(np.isinf(table)):
        out = np.where(values == table[end], end, out)
    missing = np.flatnonzero(np.isnan(table))
    return np.where(np.isnan(values), missing[0] if len(missing) else 0, out)


def cast_allowed(source: str, target: str, mode: str = "load") -> str:
    """The type that a cast gives; on load it must not be wider than the stored one."""
    if target == AUTO or target == source:
        return source
    if mode == "load" and dtype(target).size > dtype(source).size:
        raise EnlargingCast(f"{source} can't become {target} on load: {dtype(target).size:g} bytes are more than {dtype(source).size:g}")
    return dtype(target).name


def convert(name: str, raw: bytes, target: str, mode: str = "load") -> bytes:
    """Bytes of a stored tensor, converted to another type under the rule of the mode."""
    if cast_allowed(name, target, mode) == name:
        return raw
    values = decode(name, raw)
    if target[0] in "IU" and values.dtype.kind == "f":
        values = np.trunc(values)
    return encode(target, values)

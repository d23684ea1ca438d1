"""Index arithmetic of row-major arrays, for the driver and as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorfold.errors import ShapeMismatch


def ceil_div(a, b):
    return -(-a // b)


def shard_bounds(size: int, world: int) -> list[tuple[int, int]]:
    """Each rank's half-open range: equal blocks, of which the last may be short or empty."""
    block = ceil_div(size, world) if world else 0
    return [(min(r * block, size), min((r + 1) * block, size)) for r in range(world)]


@dataclass(frozen=True)
class Frame:
    """A view of an array: extents, strides and offset in elements."""

    shape: tuple[int, ...]
    strides: tuple[int, ...]
    offset: int = 0

    @classmethod
    def of(cls, shape) -> Frame:
        strides, step = [], 1
        for n in reversed(tuple(shape)):
            strides.append(step)
            step *= n
        return cls(tuple(shape), tuple(reversed(strides)))

    def __getitem__(self, index) -> Frame:
        """Slices as Python lists do; an integer keeps its dimension with extent 1. Slices of slices compose."""
        index = index if isinstance(index, tuple) else (index,)
        if len(index) > len(self.shape):
            raise IndexError(f"{len(index)} indices for {len(self.shape)} dimensions")
        shape, strides, offset = list(self.shape), list(self.strides), self.offset
        for d, (i, n) in enumerate(zip(index, self.shape, strict=False)):
            if isinstance(i, int):
                if not -n <= i < n:
                    raise IndexError(f"index {i} of extent {n} in dimension {d}")
                i = slice(i % n, i % n + 1)
            r = range(n)[i]
            shape[d] = len(r)
            offset += r.start * self.strides[d] if len(r) else 0
            strides[d] = self.strides[d] * r.step
        return replace(self, shape=tuple(shape), strides=tuple(strides), offset=offset)

    def positions(self):
        """Places of the view's elements in the array, in order."""
        out = [self.offset]
        for n, s in zip(self.shape, self.strides, strict=True):
            out = [p + k * s for p in out for k in range(n)]
        return out


def resolved_shape(shape, to) -> list[int]:
    """A shape to take the elements of another one in, with an extent of -1 filled in."""
    have = 1
    for n in shape:
        have *= n
    known = 1
    for n in to:
        known *= n if n >= 0 else 1
    out = [n if n >= 0 else have // max(known, 1) for n in to]
    total = 1
    for n in out:
        total *= n
    if total != have or sum(n < 0 for n in to) > 1:
        raise ShapeMismatch(f"{list(shape)} has {have} elements and can't become {list(to)}")
    return out


def nelem(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)


def strides(shape: Column) -> Column:
    return F.transform(shape, lambda _, i: F.aggregate(F.slice(shape, i + 2, F.size(shape)), F.lit(1).cast("bigint"), lambda a, x: a * x))


def unravel(pos: Column, shape: Column) -> Column:
    """The index of a place in a row-major array of that shape."""
    return F.transform(F.arrays_zip(shape.alias("n"), strides(shape).alias("s")), lambda z: F.pmod(F.floor(pos / z["s"]), z["n"]))


def in_slice(i: Column, start: int, stop: int, step: int, size: int) -> tuple[Column, Column]:
    """Whether a place is in a slice of a dimension of that size, and its place in the slice."""
    r = range(*slice(start, stop, step).indices(size))
    lo, hi = (r.start, r.stop) if r.step > 0 else (r.stop + 1, r.start + 1)
    return (i >= lo) & (i < hi) & (F.pmod(i - r.start, F.lit(abs(r.step))) == 0), F.expr("null") if not len(r) else ((i - r.start) / r.step).cast("bigint")

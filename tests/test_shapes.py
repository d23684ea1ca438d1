import itertools

import pytest
from pyspark.sql import functions as F

from tensorfold.functions import shapes as S

BOUNDS = [None, -7, -5, -2, -1, 0, 1, 3, 4, 5, 7]


def test_all_slices_like_lists():
    base = S.Frame.of((5, 6))
    whole = list(range(30))
    for start, stop, step in itertools.product(BOUNDS, BOUNDS, [None, 1, 2, 3, -1, -2]):
        got = base[start:stop:step]
        want = [x for r in range(5)[start:stop:step] for x in whole[r * 6 : r * 6 + 6]]
        assert got.positions() == want
    for i in range(-5, 5):
        assert base[i].shape == (1, 6) and base[i].positions() == whole[i % 5 * 6 :][:6]
    assert base[()] == base
    assert base[1:-1, ::2].shape == (3, 3)
    assert base[::2][1].positions() == whole[12:18]


def test_slice_errors():
    base = S.Frame.of((5, 6))
    for bad in (5, -6, (0, 0, 0)):
        with pytest.raises(IndexError):
            base[bad]
    with pytest.raises(ValueError):
        base[::0]


@pytest.mark.parametrize("size", range(21))
def test_shards_cover(size):
    for world in range(1, 9):
        bounds = S.shard_bounds(size, world)
        assert [x for lo, hi in bounds for x in range(lo, hi)] == list(range(size))
        assert all(hi - lo <= -(-size // world) for lo, hi in bounds)
    assert [b - a for a, b in S.shard_bounds(5, 4)] == [2, 2, 1, 0]


def test_columns(spark):
    df = spark.createDataFrame([([2, 3, 4],), ([],)], "shape array<bigint>")
    got = df.select(S.nelem(F.col("shape")), S.strides(F.col("shape")), S.unravel(F.lit(17), F.col("shape"))).collect()
    assert [list(r) for r in got] == [[24, [12, 4, 1], [1, 1, 1]], [1, [], []]]

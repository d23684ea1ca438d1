"""From blocks to rows and elements, and slices, casts, bit views, reshapes and comparisons of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorfold.errors import TensorInvalidInfo
from tensorfold.functions import dtypes as D
from tensorfold.functions.shapes import resolved_shape, unravel
from tensorfold.sources.archive import block_spans

ELEMENTS = "path string, name string, pos bigint, value double, raw bigint"
#: Elements of a batch.
SLICE = 1 << 16
#: Bytes that a task takes from a shuffle of payloads, on average.
TASK_BYTES = 32 << 20


def _labels(value: str, n: int) -> pa.Array:
    """One string for n rows, built without a Python object a row."""
    raw = value.encode()
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * len(raw)), pa.py_buffer(raw * n)])


def _parts(block: dict, width: int = 1):
    """(first element, type, bytes) of a block in runs of about ``SLICE`` elements, whole multiples of ``width``."""
    size = D.dtype(block["dtype"]).size
    step = max(1, SLICE // width) * width
    step += step % 2  # packed values come in pairs
    raw = memoryview(block["payload"])
    for at in range(0, block["elem_count"], step):
        yield at, raw[int(at * size) : int(min(at + step, block["elem_count"]) * size)]


def _rows_of(b: pa.RecordBatch):
    """A batch's rows as dicts; payloads are not copied."""
    fixed = b.drop_columns(["payload"]).to_pylist()
    for r, payload in zip(fixed, b.column("payload"), strict=True):
        yield r | {"payload": payload.as_buffer()}


def elements(blocks: DataFrame, cast: str = D.AUTO, mode: str = "load") -> DataFrame:
    """A row per element: place, value as double and stored bits. Wide integers above 2^53 lose digits in ``value``; ``raw`` holds all bits."""

    def decode(batches):
        for b in batches:
            for r in _rows_of(b):
                for at, raw in _parts(r):
                    kind = r["dtype"]
                    if cast != D.AUTO:
                        raw, kind = D.convert(kind, raw, cast, mode), cast
                    values = D.decode(kind, raw).astype("f8")
                    n = len(values)
                    yield pa.RecordBatch.from_arrays(
                        [_labels(r["path"], n), _labels(r["name"], n), pa.array(np.arange(n) + (r["elem_start"] + at), pa.int64()), pa.array(values), pa.array(D.bits(kind, raw), pa.int64())],
                        names=["path", "name", "pos", "value", "raw"],
                    )

    return blocks.mapInArrow(decode, ELEMENTS)


def rows(blocks: DataFrame) -> DataFrame:
    """(name, row, vec) of the tensors with two dimensions. Blocks of whole rows are decoded where they are; the bytes of other blocks are put together by stripes of rows first."""

    def decode(batches):
        for b in batches:
            for r in _rows_of(b):
                wide = r["shape"][1]
                for at, raw in _parts(r, wide):
                    values = D.decode(r["dtype"], raw).astype("f8")
                    n = len(values) // wide
                    vecs = pa.ListArray.from_arrays(np.arange(n + 1, dtype="i4") * wide, values)
                    yield pa.RecordBatch.from_arrays([_labels(r["name"], n), pa.array(np.arange(n) + (r["elem_start"] + at) // wide, pa.int64()), vecs], names=["name", "row", "vec"])

    def cut(batches):
        for b in batches:
            for i, _, raw in block_spans(b):
                name, kind, wide, start = b.column("name")[i].as_py(), b.column("dtype")[i].as_py(), b.column("shape")[i].as_py()[1], b.column("elem_start")[i].as_py()
                size, stripe = D.dtype(kind).size, max(1, ROWS_STRIPE // wide) * wide
                edges = _stripes(start, int(raw.size / size), stripe)
                m = len(edges) - 1
                payload = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(((edges - start) * size).astype(np.int32)), raw])
                yield pa.RecordBatch.from_arrays([_labels(name, m), _labels(kind, m), pa.array(np.full(m, wide, np.int64)), pa.array(edges[:-1] // stripe), pa.array(edges[:-1]), payload], names=["name", "dtype", "wide", "k", "start", "payload"])

    def join(key, t):
        name, kind, wide, _ = (k.as_py() for k in key)
        t = t.sort_by("start")
        parts = [D.decode(kind, x.as_buffer()).astype("f8") for x in t.column("payload")]
        row = np.concatenate([np.arange(s, s + len(v)) for s, v in zip(t.column("start").to_pylist(), parts, strict=True)]) // wide
        bounds = np.r_[0, np.flatnonzero(np.diff(row)) + 1, len(row)]
        vecs = pa.ListArray.from_arrays(bounds.astype("i4"), np.concatenate(parts))
        return pa.Table.from_arrays([_labels(name, len(vecs)), pa.array(row[bounds[:-1]]), vecs], names=["name", "row", "vec"])

    wide = F.element_at("shape", 2)
    flat = blocks.where((F.size("shape") == 2) & (F.get("shape", F.lit(1)) > 0))
    aligned = (F.col("elem_start") % wide == 0) & (F.col("elem_count") % wide == 0)
    whole = flat.where(aligned).mapInArrow(decode, "name string, row bigint, vec array<double>")
    parts = flat.where(~aligned).mapInArrow(cut, "name string, dtype string, wide bigint, k bigint, start bigint, payload binary")
    return whole.unionByName(parts.groupBy("name", "dtype", "wide", "k").applyInArrow(join, "name string, row bigint, vec array<double>"))


#: Elements of the rows that are put together at once.
ROWS_STRIPE = 1 << 18


def cast_blocks(blocks: DataFrame, target: str, mode: str = "load") -> DataFrame:
    """The same blocks in another type; on load a wider type raises EnlargingCast."""

    def change(batches):
        for b in batches:
            kinds = b.column("dtype").to_pylist()
            for k, kind in enumerate(kinds):
                raw, shown = D.convert(kind, b.column("payload")[k].as_buffer(), target, mode), D.cast_allowed(kind, target, mode)
                fresh = {"payload": pa.array([memoryview(raw)], b.schema.field("payload").type), "dtype": pa.array([shown])}
                yield pa.RecordBatch.from_arrays([fresh.get(f.name, b.column(f.name).slice(k, 1)) for f in b.schema], schema=b.schema)

    return blocks.mapInArrow(change, blocks.schema)


def carrier_blocks(blocks: DataFrame) -> DataFrame:
    """The same bytes of small and packed floats under the integer type that carries them (``carrier_of``); others stay. For consumers that know no such type."""
    shown = F.create_map(*[F.lit(x) for kv in D.CARRIERS.items() for x in kv])
    packed = F.col("dtype") == "F4"
    halved = F.transform("shape", lambda n, i: F.when(i == F.size("shape") - 1, F.floor(n / 2)).otherwise(n))
    return blocks.withColumns({"shape": F.when(packed, halved).otherwise(F.col("shape")), "elem_start": F.when(packed, F.floor(F.col("elem_start") / 2)).otherwise(F.col("elem_start")), "elem_count": F.when(packed, F.floor(F.col("elem_count") / 2)).otherwise(F.col("elem_count")), "dtype": F.coalesce(shown[F.col("dtype")], F.col("dtype"))})


def view_blocks(blocks: DataFrame, target: str) -> DataFrame:
    """The same bytes under another type of the same width."""
    same = {k for k, d in D.DTYPES.items() if d.size == D.dtype(target).size}
    return blocks.withColumn("dtype", F.when(F.col("dtype").isin(*sorted(same)), F.lit(target)).otherwise(F.raise_error(F.concat(F.lit(f"no view as {target} of "), "dtype"))))


def slice_rows(df: DataFrame, index: str, start: int | None, stop: int | None, step: int | None, size: int, out: str = "out_row") -> DataFrame:
    """Rows of a slice along dimension 0, by a filter that reaches the scan. ``size`` is the extent, for negative and open bounds."""
    r = range(*slice(start, stop, step).indices(size))
    if not len(r):
        return df.where(F.lit(False)).withColumn(out, F.lit(0).cast("bigint"))
    lo, hi, i = min(r[0], r[-1]), max(r[0], r[-1]), F.col(index)
    return df.where((i >= lo) & (i <= hi) & (F.pmod(i - r[0], F.lit(abs(r.step))) == 0)).withColumn(out, F.expr(f"({index} - {r[0]}) div {r.step}"))


def explode_vector(df: DataFrame, vec: str, dim: str = "d", value: str = "value") -> DataFrame:
    return df.select("*", F.posexplode(vec).alias(dim, value)).withColumn(dim, F.col(dim).cast("bigint")).drop(vec)


def slice_vector(vec: Column, start: int | None, stop: int | None, step: int | None, size: int | None = None) -> Column:
    """Elements of a slice along a row's vector, with their places in the slice, before anything is exploded. Open and negative bounds and steps need the vector's ``size``."""
    r = range(start, stop, step) if size is None else range(*slice(start, stop, step).indices(size))
    lo, hi = (r.start, r.stop) if r.step > 0 else (r.stop + 1, r.start + 1)
    kept = F.filter(F.transform(vec, lambda x, d: F.struct(d.cast("bigint").alias("d"), x.alias("value"))), lambda z: (z["d"] >= lo) & (z["d"] < hi) & (F.pmod(z["d"] - r.start, F.lit(abs(r.step))) == 0))
    return kept if r.step > 0 else F.reverse(kept)


def slice_elements(elems: DataFrame, shape: list[int], index: tuple[slice, ...]) -> DataFrame:
    """Elements of an n-d slice: those in it, with ``pos`` their place in the slice. The same as reading with ``index``, for elements that are at hand."""
    ranges = [range(n)[index[d] if d < len(index) else slice(None)] for d, n in enumerate(shape)]
    if not all(map(len, ranges)):
        return elems.where(F.lit(False))
    inside, pos, step, below = F.lit(True), F.lit(0).cast("bigint"), 1, 1
    for r, n in zip(reversed(ranges), reversed(shape), strict=True):
        i = F.pmod(F.expr(f"pos div {below}"), F.lit(n))
        lo, hi = min(r[0], r[-1]), max(r[0], r[-1])
        inside = inside & (i >= lo) & (i <= hi) & (F.pmod(i - r[0], F.lit(abs(r.step))) == 0)
        pos = pos + F.floor((i - r[0]) / r.step) * step
        step, below = step * len(r), below * n
    return elems.where(inside).withColumn("pos", pos.cast("bigint"))


def reshape(elems: DataFrame, shape: list[int], to: list[int]) -> DataFrame:
    """Elements with the index that their place has in another shape of as many elements (one extent may be -1)."""
    to = resolved_shape(shape, to)
    return elems.withColumn("index", unravel(F.col("pos"), F.array(*[F.lit(n).cast("bigint") for n in to])))


def reshape_rows(df: DataFrame, row: str, vec: str, wide: int, to: int) -> DataFrame:
    """(row, col, value) of a [N, wide] array as [.., to]."""
    at = F.col("__pos")
    return df.select(F.col(row).alias("__row"), F.posexplode(vec).alias("__d", "value")).withColumn("__pos", F.col("__row") * wide + F.col("__d")).select(F.floor(at / to).alias("row"), (at % to).alias("col"), "value")


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of either side that have no equal in the other, by stored bits."""
    a, b = (x.select("name", "pos", F.col("raw").alias(k)) for x, k in ((a, "__a"), (b, "__b")))
    return a.join(b, ["name", "pos"], "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b"))).select("name", "pos")


def is_equal(a: DataFrame, b: DataFrame) -> bool:
    return differs(a, b).isEmpty()


def side_by_side(columns: dict[str, tuple[DataFrame, str]], n: int, stripe: int = SLICE) -> DataFrame:
    """(pos, a column each) of tensors with ``n`` elements each, given as blocks and a type: ``double`` for values, ``bigint`` or ``int`` for stored bits. Equal to a join of
    their elements by place, but what is shuffled are bytes, by stripes of places."""
    parts = "k bigint, column int, start bigint, dtype string, payload binary"

    def cut(column):
        def pieces(batches):
            for b in batches:
                for i, _, raw in block_spans(b):
                    kind, start = b.column("dtype")[i].as_py(), b.column("elem_start")[i].as_py()
                    size = D.dtype(kind).size
                    edges = _stripes(start, int(raw.size / size), stripe)
                    m = len(edges) - 1
                    payload = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(((edges - start) * size).astype(np.int32)), raw])
                    yield pa.RecordBatch.from_arrays([pa.array(edges[:-1] // stripe), pa.array(np.full(m, column, np.int32)), pa.array(edges[:-1]), _labels(kind, m), payload], names=["k", "column", "start", "dtype", "payload"])

        return pieces

    def beside(key, t):
        low = key[0].as_py() * stripe
        count = min(stripe, n - low)
        out, starts, of = [pa.array(np.arange(count) + low)], t.column("start").to_numpy(), t.column("column").to_numpy()
        kinds, payloads = t.column("dtype").to_pylist(), t.column("payload").to_pylist()
        for c, (name, kind) in enumerate(wanted.items()):
            own = sorted(np.flatnonzero(of == c), key=lambda r: starts[r])
            held = [(starts[r], len(payloads[r]) / D.dtype(kinds[r]).size) for r in own]
            if count < 0 or [s for s, _ in held] != [low + sum(m for _, m in held[:j]) for j in range(len(held))] or sum(m for _, m in held) != count:
                raise TensorInvalidInfo(f"{name}: its blocks do not cover elements {low} to {low + count} once")
            raw = b"".join(payloads[r] for r in own)
            out.append(pa.array(D.decode(kinds[own[0]], raw).astype("f8")) if kind == "double" else pa.array(D.bits(kinds[own[0]], raw).astype("i4" if kind == "int" else "i8")))
        return pa.Table.from_arrays(out, names=["pos", *wanted])

    dealt = reduce(DataFrame.unionAll, [blocks.select("name", "dtype", "shape", "elem_start", "payload").mapInArrow(cut(c), parts) for c, (blocks, _) in enumerate(columns.values())])
    wanted = {name: kind for name, (_, kind) in columns.items()}
    shown = ", ".join(f"`{name}` {kind}" for name, kind in wanted.items())
    return dealt.repartition(_tasks(n * 8 * len(wanted)), "k").groupBy("k").applyInArrow(beside, f"pos bigint, {shown}")


def _stripes(start: int, count: int, stripe: int) -> np.ndarray:
    """Bounds of the parts of a run of elements that lie in one stripe each."""
    return np.unique(np.r_[start, np.arange(start // stripe + 1, -(-(start + count) // stripe)) * stripe, start + count]).astype(np.int64)


def random_tensor(spark, name: str, shape: list[int], seed: int = 0) -> DataFrame:
    return spark.range(D.nelem(shape)).select(F.lit("").alias("path"), F.lit(name).alias("name"), F.col("id").alias("pos"), F.randn(seed).alias("value"))


def _tasks(size: float) -> int:
    """Partitions for so many bytes, whatever the session's count of shuffle partitions."""
    return max(1, -(-int(size) // TASK_BYTES))


def pack_vectors(df: DataFrame, name: str, index: str, vec: str, wide: int, n: int, dtype: str = "F32", rows_a_block: int = 1 << 14) -> DataFrame:
    """(name, dtype, shape, elem_start, payload): blocks of an [n, wide] tensor, of rows with a dense place ``index`` from 0 and their vector. A task holds one block."""

    def pack(key, t):
        t = t.sort_by("i")
        values = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"name": [name], "dtype": [dtype], "shape": pa.array([[n, wide]], pa.list_(pa.int64())), "elem_start": pa.array([key[0].as_py() * rows_a_block * wide], pa.int64()), "payload": pa.array([D.encode(dtype, values)], pa.binary())})

    dealt = df.select(F.col(index).cast("bigint").alias("i"), F.col(vec).alias("v"), F.expr(f"{index} div {rows_a_block}").alias("k")).repartition(_tasks(D.nbytes(dtype, [n, wide])), "k")
    return dealt.groupBy("k").applyInArrow(pack, TENSOR_BLOCKS)


def pack_columns(df: DataFrame, index: str, columns: list[tuple[str, str]], n: int, rows_a_block: int = 1 << 18) -> DataFrame:
    """Blocks of [n] tensors, one for each (column, dtype), of rows with a dense place ``index`` from 0. One shuffle serves all columns."""

    def pack(key, t):
        t = t.sort_by("__i")
        k = key[0].as_py()
        raw = [D.encode(kind, t.column(c).to_numpy()) for c, kind in columns]
        return pa.table({"name": [c for c, _ in columns], "dtype": [kind for _, kind in columns], "shape": pa.array([[n]] * len(columns), pa.list_(pa.int64())), "elem_start": pa.array([k * rows_a_block] * len(columns), pa.int64()), "payload": pa.array(raw, pa.binary())})

    dealt = df.select(F.col(index).cast("bigint").alias("__i"), *[c for c, _ in columns], F.expr(f"{index} div {rows_a_block}").alias("__k"))
    dealt = dealt.repartition(_tasks(n * sum(D.dtype(kind).size for _, kind in columns)), "__k")
    return dealt.groupBy("__k").applyInArrow(pack, TENSOR_BLOCKS)


def pack_column(df: DataFrame, name: str, index: str, value: str, n: int, dtype: str, rows_a_block: int = 1 << 20) -> DataFrame:
    """Blocks of an [n] tensor, of rows with a dense place ``index`` from 0 and a value."""
    return pack_columns(df.select(index, F.col(value).alias(name)), index, [(name, dtype)], n, rows_a_block)


def pack_each(df: DataFrame, name: Column, value: str, dtype: str) -> DataFrame:
    """(name, dtype, shape, payload): each row's vector, string or bytes as a tensor of its own."""

    def pack(batches):
        for b in batches:
            raw = [D.encode(dtype, np.frombuffer(v, np.uint8) if isinstance(v, bytes) else np.array(v)) for v in b.column("value").to_pylist()]
            size = D.dtype(dtype).size
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([dtype] * len(raw)), pa.array([[int(len(r) / size)] for r in raw], pa.list_(pa.int64())), pa.array(raw, pa.binary())], names=["name", "dtype", "shape", "payload"])

    kind = dict(df.dtypes)[value]
    return df.select(name.alias("name"), (F.encode(value, "UTF-8") if kind == "string" else F.col(value)).alias("value")).mapInArrow(pack, "name string, dtype string, shape array<bigint>, payload binary")


TENSOR_BLOCKS = "name string, dtype string, shape array<bigint>, elem_start bigint, payload binary"


def tensor_rows(elems: DataFrame, dtype: str, shape: list[int]) -> DataFrame:
    """(name, dtype, shape, payload): the rows that the archive writer takes, from elements; a tensor must fit in a task."""

    def pack(key, t):
        t = t.sort_by("pos")
        return pa.table({"name": [key[0].as_py()], "dtype": [dtype], "shape": pa.array([shape], pa.list_(pa.int64())), "payload": pa.array([D.encode(dtype, t.column("value").to_numpy())], pa.binary())})

    return elems.groupBy("name").applyInArrow(pack, "name string, dtype string, shape array<bigint>, payload binary")

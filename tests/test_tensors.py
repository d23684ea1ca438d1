"""Writing, slicing, sharding and joining tensors of archives against NumPy."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorfold import errors as E
from tensorfold.functions import dtypes as D
from tensorfold.operators import tensors as T
from tensorfold.operators.indexing import numbered
from tensorfold.plans import perf
from tensorfold.plans.config import Config, under_mount
from tensorfold.plans.session import open_tensors
from tensorfold.plans.weights import Weights
from tensorfold.sources import archive as A
from tensorfold.sources.header import render
from tensorfold.streaming import pipeline as S


def save(path, tensors, metadata=None):
    with open(path, "wb") as f:
        f.write(render([(n, k, list(s)) for n, k, s, _ in tensors], metadata) + b"".join(x for *_, x in tensors))


def blocks(df):
    return {(r["name"], r["elem_start"]): bytes(r["payload"]) for r in df.collect()}


def content(spark, path):
    return blocks(A.read_blocks(spark, path))


def test_append_and_overwrite(spark, tmp_path):
    one = lambda n: spark.createDataFrame([(n, "U8", [3], bytearray(b"abc"))], "name string, dtype string, shape array<bigint>, payload binary")
    path = str(tmp_path / "out")
    A.write_archive(one("a"), path)
    A.write_archive(one("b"), path)
    assert content(spark, path).keys() == {("a", 0), ("b", 0)}
    with pytest.raises(Exception, match="twice"):
        A.write_archive(one("a"), path)
    assert content(spark, path).keys() == {("a", 0), ("b", 0)}
    A.write_archive(one("a"), path, mode="overwrite")
    assert content(spark, path).keys() == {("a", 0)}
    assert sorted(x.suffix for x in (tmp_path / "out").iterdir()) == [".safetensors"]
    with pytest.raises(Exception, match="in 3 bytes"):
        A.write_archive(one("z").withColumn("shape", F.array(F.lit(4).cast("bigint"))), str(tmp_path / "short"))


def test_blocks_of_one_tensor_are_joined(spark, tmp_path):
    values = np.arange(3000, dtype="<i4")
    df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(values)], "i bigint, v int")
    pairs = df.select("i", F.array("v", "v").alias("v"))
    packed = T.pack_column(df, "x", "i", "v", 3000, "I32", 128).unionByName(T.pack_vectors(pairs, "y", "i", "v", 2, 3000, "F32", 128))
    A.write_archive(packed, str(tmp_path / "o"), 1)
    got = content(spark, str(tmp_path / "o"))
    assert got[("x", 0)] == values.tobytes() and got[("y", 0)] == np.repeat(values, 2).astype("<f4").tobytes()
    with pytest.raises(Exception, match="begins at element"):
        A.write_archive(packed.where("elem_start <> 128"), str(tmp_path / "gap"), 1)


def shuffled(spark):
    """Bytes that tasks have read from shuffles in all."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleReadBytes() for k in range(stages.size()))


def test_blocks_are_written_where_they_are(spark, tmp_path):
    """No task takes a tensor's blocks from the others, whatever their order."""
    data = np.random.default_rng(0).integers(0, 256, 4 << 20, dtype=np.uint8)
    step = 1 << 18
    rows = [("x", "U8", [len(data)], at, bytearray(data[at : at + step].tobytes())) for at in range(0, len(data), step)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows[::-1], 4), "name string, dtype string, shape array<bigint>, elem_start bigint, payload binary")
    before = shuffled(spark)
    A.write_archive(df, str(tmp_path / "o"), layout=[("x", "U8", [len(data)])])
    assert shuffled(spark) - before < 100_000
    assert content(spark, str(tmp_path / "o")) == {("x", 0): data.tobytes()}
    for wrong, match in ((df.unionByName(df.limit(1)), "begins at element|ends at element"), (df.unionByName(df.where("elem_start = 0")), "twice"), (df.withColumn("elem_start", F.col("elem_start") + 1), "has no place"), (df.where("elem_start > 0"), "begins at element")):
        with pytest.raises(Exception, match=match):
            A.write_archive(wrong, str(tmp_path / "o"), mode="overwrite")
    with pytest.raises(E.DuplicateTensor):
        A.write_archive(df, str(tmp_path / "o"))
    assert content(spark, str(tmp_path / "o")) == {("x", 0): data.tobytes()} and len(list((tmp_path / "o").iterdir())) == 1


def test_rows_are_numbered_without_a_shuffle(spark):
    df = spark.range(0, 1000, 1, 7).where("id % 3 <> 0 and (id < 400 or id > 600)")
    got, n = numbered(df, "at")
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert [r["at"] for r in got.orderBy("id").collect()] == list(range(n)) and n == df.count()
    none, n = numbered(df.where("id < 0"))
    assert n == 0 and none.count() == 0


def test_rows_wider_than_a_block(spark, tmp_path):
    wide = np.arange(30, dtype="<f4").reshape(3, 10)
    save(tmp_path / "w.safetensors", [("w", "F32", (3, 10), wide.tobytes())])
    for size in (8, 12, 28, 40, 44, 1 << 20):
        got = {r["row"]: r["vec"] for r in T.rows(A.read_blocks(spark, str(tmp_path), block_bytes=size)).collect()}
        assert got == {k: wide[k].tolist() for k in range(3)}


def test_a_task_counts_through_its_own_blocks_only(tmp_path):
    """Many ranges over small blocks make each block once, in the same order as one pass, also backwards and where tensors follow one another."""
    save(tmp_path / "m.safetensors", [("a", "F32", (1000, 7), bytes(28_000)), ("b", "F4", (500, 6), bytes(1500)), ("c", "U8", (), b"x")])
    h = A.header_of(f"{tmp_path}/m.safetensors")
    for options in ({}, {"index": "[[null, null, -3]]", "names": '["a"]'}, {"rows": "17:900", "names": '["a"]'}, {"index": "[[5, 800, 7], [1, 3, null]]", "names": '["a"]'}):
        reader = A.ArchiveReader({"path": "", "block_bytes": "100"} | options)
        every = [(r.entry.name, r.block_id, r.elem_start, r.elem_count, r.offset, r.length) for r in reader.runs(h)]
        assert len(every) > 10
        found = [[(r.entry.name, r.block_id, r.elem_start, r.elem_count, r.offset, r.length) for r in reader.runs(h, at, at + 513)] for at in range(0, h.file_size, 513)]
        assert max(map(len, found)) <= 30 and sorted(x for own in found for x in own) == sorted(every)


def test_rows_of_many_small_blocks(spark, tmp_path):
    """Blocks that cut rows are put together by bytes, in any order and with gaps between them."""
    data = np.random.default_rng(0).normal(size=(9000, 33)).astype("<f4")
    save(tmp_path / "r.safetensors", [("r", "F32", data.shape, data.tobytes()), ("v", "U8", (5,), b"12345")])
    blocks = A.read_blocks(spark, str(tmp_path), block_bytes=100, partition_bytes=100_000)
    got = {r["row"]: r["vec"] for r in T.rows(blocks.repartition(5, "block_id").where("block_id not in (2, 3, 4)")).collect()}
    flat = data.reshape(-1).tolist()
    assert len(got) == 8999 and (got[0], got[1], got[3]) == (flat[:33], flat[33:48], flat[120:132])  # elements 48 to 120 are missing
    assert all(got[k] == data[k].tolist() for k in range(4, 9000))
    before = shuffled(spark)
    assert T.rows(blocks).where(F.size("vec") == 33).count() == 9000
    assert shuffled(spark) - before < 1.3 * data.nbytes


def test_columns_side_by_side(spark, tmp_path):
    n = 1000
    f, i = np.random.default_rng(0).normal(size=n), np.arange(n, dtype="<i4") * 7 - 100
    save(tmp_path / "c.safetensors", [("f", "F64", (n,), f.tobytes()), ("i", "I32", (n,), i.tobytes())])
    of = lambda name, size: A.read_blocks(spark, str(tmp_path), block_bytes=size, names=[name])
    for stripe in (7, 64, 5000):
        got = T.side_by_side({"a": (of("f", 100), "double"), "b": (of("i", 1000), "int"), "c": (of("f", 1 << 20), "bigint")}, n, stripe)
        assert "Join" not in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.collect())) == list(zip(range(n), f.tolist(), i.tolist(), f.view("i8").tolist(), strict=True))
    with pytest.raises(Exception, match="do not cover"):
        T.side_by_side({"a": (of("f", 100).where("elem_start <> 12"), "double"), "b": (of("i", 100), "int")}, n, 64).collect()


def test_large_blocks_of_one_byte_types(spark, tmp_path):
    n = 3 << 20
    data = np.arange(n, dtype=np.uint8)
    save(tmp_path / "big.safetensors", [("f8", "F8_E4M3", (n,), data.tobytes()), ("f4", "F4", (n,), data[: n // 2].tobytes()), ("u8", "U8", (n,), data.tobytes())])
    got = {r["name"]: (r["n"], r["top"], r["raw"]) for r in T.elements(A.read_blocks(spark, str(tmp_path))).groupBy("name").agg(F.count("*").alias("n"), F.max("pos").alias("top"), F.sum("raw").alias("raw")).collect()}
    low, high = data[: n // 2] & 15, data[: n // 2] >> 4
    assert got == {"f8": (n, n - 1, int(data.sum(dtype="i8"))), "u8": (n, n - 1, int(data.sum(dtype="i8"))), "f4": (n, n - 1, int(low.sum(dtype="i8") + high.sum(dtype="i8")))}


@pytest.fixture(scope="module")
def cube(tmp_path_factory):
    top = tmp_path_factory.mktemp("cube")
    a = np.arange(4 * 5 * 6, dtype="<i2").reshape(4, 5, 6)
    b = np.random.default_rng(1).integers(0, 256, (5, 4), dtype=np.uint8)
    wide = np.arange(6 * 40_000, dtype="<i4").reshape(6, 40_000)
    save(top / "x.safetensors", [("wide", "I32", wide.shape, wide.tobytes()), ("a", "I16", a.shape, a.tobytes()), ("s", "F64", (), np.float64(2.5).tobytes()), ("p", "F4", (5, 8), b.tobytes()), ("none", "I8", (0, 3), b"")])
    return str(top), {"a": a, "wide": wide, "p": D.decode("F4", b.tobytes()).reshape(5, 8)}


SLICES = [(slice(1, 3),), (slice(None, None, -1),), (slice(None), slice(1, 5, 2)), (slice(-3, None, 2), slice(None), slice(5, None, -2)), (2,), (-1, 0, slice(2, 4)), (slice(3, 0, -2), slice(None), slice(1, 2)), (slice(2, 2),)]


@pytest.mark.parametrize("index", SLICES, ids=str)
def test_slices_read_what_numpy_gives(spark, cube, index):
    path, arrays = cube
    keep = tuple(slice(i % n, i % n + 1) if isinstance(i, int) else i for i, n in zip(index, (4, 5, 6), strict=False))
    want = arrays["a"][keep].reshape(-1).tolist()
    for size in (24, 1 << 20):
        with open_tensors(spark, path, config=Config(block_bytes=size)) as t:
            got = sorted((r["pos"], r["value"]) for r in t.slice("a", index).collect())
            assert got == list(enumerate(want))
            again = T.slice_elements(t.tensor("a"), [4, 5, 6], keep)
            assert sorted((r["pos"], r["value"]) for r in again.collect()) == got


def test_slices_of_other_shapes(spark, cube):
    path, arrays = cube
    read = lambda df: [r["value"] for r in df.orderBy("pos").collect()]
    with open_tensors(spark, path, world_size=3) as t:
        assert read(t.slice("p", (slice(1, 4), slice(2, 6)))) == arrays["p"][1:4, 2:6].reshape(-1).tolist()
        with pytest.raises(Exception, match="byte bounds"):
            t.slice("p", (slice(None), slice(1, 4))).collect()
        with pytest.raises(IndexError):
            t.slice("a", (9,))
        assert t.item("s") == 2.5 and t.frame("a").strides == (30, 6, 1)
        with pytest.raises(ValueError, match="one element"):
            t.item("a")
        for rank in range(3):
            assert read(t.shard("a", 1, rank)) == arrays["a"][:, 2 * rank : 2 * rank + 2].reshape(-1).tolist()
            # A small part of wide rows is read alone.
            assert read(t.slice("wide", (slice(None, None, 2), slice(5000 * rank, 5000 * rank + 4)))) == arrays["wide"][::2, 5000 * rank : 5000 * rank + 4].reshape(-1).tolist()
        assert t.shard("a", 0, 2).count() == 0 and t.shard("a", -1, 1).count() == 120
        again = T.reshape(t.tensor("a"), [4, 5, 6], [20, -1]).collect()
        assert all(r["index"] == [r["pos"] // 6, r["pos"] % 6] for r in again)
    with pytest.raises(E.ShapeMismatch):
        T.reshape(spark.range(1), [4, 5], [3, -1])


def test_only_wanted_rows_are_read(cube):
    path, _ = cube
    reader = A.ArchiveReader({"path": path, "names": '["wide"]', "index": "[[2, 3, null]]"})
    runs = list(reader.runs(A.header_of(A.discover(path)[0])))
    assert [r.length for r in runs] == [160_000] and runs[0].elem_start == 0


def test_vectors_slice_like_lists(spark):
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(9)).alias("v"))
    for start, stop, step in [(None, None, None), (None, None, -1), (-3, None, None), (8, 2, -2), (1, 9, 3), (5, 5, 1)]:
        got = df.select(T.slice_vector(F.col("v"), start, stop, step, 10).alias("z")).first()["z"]
        assert [z["value"] for z in got] == list(range(10))[start:stop:step]


def test_other_ways_to_read(spark, cube):
    path, arrays = cube
    want = content(spark, path)
    assert blocks(A.read_blocks(spark, path, mapped=True)) == want
    assert blocks(A.blocks_of_binary(spark.read.format("binaryFile").load(path))) == want
    assert blocks(A.read_blocks(spark, path, partition_bytes=1000)) == want
    for name in ("mapped", "spark", "base"):
        with open_tensors(spark, path, config=Config(source=name)) as t:
            assert blocks(t.blocks("a")) == {("a", 0): arrays["a"].tobytes()}
    assert under_mount("store://x/y.safetensors", "/m", "store://") == "/m/x/y.safetensors" and under_mount("y", "/m") == "/m/y" and under_mount("/y", "/m") == "/y"
    folder = path.rsplit("/", 1)[0]
    with open_tensors(spark, path, config=Config(source="mount", sections={"mount": {"mount_point": folder, "scheme": "store://"}})) as t:
        assert blocks(t.blocks("a")) == {("a", 0): arrays["a"].tobytes()}


@pytest.mark.parametrize("world", [1, 2, 3, 5, 8])
@pytest.mark.parametrize("dim", [0, 1, 2])
def test_joined_columns_of_any_dimension(spark, tmp_path_factory, world, dim):
    rng = np.random.default_rng(dim)
    shapes = [[3, 4, 5], [3, 4, 5], [3, 4, 5]]
    for s, n in zip(shapes, (3, 7, 1), strict=True):
        s[dim] = n
    arrays = [rng.integers(0, 1000, s).astype("<i4") for s in shapes]
    top = tmp_path_factory.mktemp("joined")
    for k, a in enumerate(arrays):
        save(top / f"{k}.safetensors", [(f"t{k}", "I32", a.shape, a.tobytes())])
    with open_tensors(spark, {0: [str(top / f"{k}.safetensors") for k in range(3)]}, world) as t:
        got = {}
        for r in t.multi_cols(["t0", "t1", "t2"], dim).collect():
            got.setdefault(r["rank"], {})[r["pos"]] = r["value"]
    for rank in range(world):
        parts = [np.take(a, range(*slice(rank * -(-a.shape[dim] // world), (rank + 1) * -(-a.shape[dim] // world)).indices(a.shape[dim])), axis=dim) for a in arrays]
        want = np.concatenate(parts, axis=dim).reshape(-1).tolist()
        assert [v for _, v in sorted(got.get(rank, {}).items())] == want and sorted(got.get(rank, {})) == list(range(len(want)))


@pytest.mark.parametrize("world", [1, 3, 8])
def test_tiny_model_shards(spark, tmp_path_factory, world):
    """The layers of a small model, each sharded by its rule, as NumPy shards them."""
    top = tmp_path_factory.mktemp("tiny")
    own = {}
    for layer in range(12):
        for k, (name, shape) in enumerate([("mlp.c_proj.weight", (8, 16)), ("mlp.c_fc.weight", (16, 8)), ("attn.c_proj.weight", (8, 8)), ("attn.c_proj.bias", (8,))]):
            own[f"h.{layer}.{name}"] = (np.arange(int(np.prod(shape))) + 1000 * layer + 100 * k).astype("<f2").reshape(shape)
    save(top / "m.safetensors", [(n, "F16", a.shape, a.tobytes()) for n, a in own.items()])
    rule = lambda n: 1 if "mlp.c_proj.weight" in n else 0 if n.endswith(("c_fc.weight", "attn.c_proj.weight")) else -1
    with open_tensors(spark, str(top), world) as t:
        assert len(t.keys()) == 48
        for n in [n for n in own if ".0." in n or ".11." in n]:
            got = {}
            for r in t.sharded(n, rule(n)).collect():
                got.setdefault(r["rank"], []).append((r["pos"], r["value"]))
            dim = rule(n)
            for rank in range(world):
                size = own[n].shape[dim]
                part = own[n] if dim < 0 else np.take(own[n], range(*slice(rank * -(-size // world), (rank + 1) * -(-size // world)).indices(size)), axis=dim)
                assert [v for _, v in sorted(got.get(rank, []))] == part.reshape(-1).tolist()


def test_realign_files(spark, tmp_path):
    body = json.dumps({"x": {"dtype": "U8", "shape": [5], "data_offsets": [0, 5]}, "__metadata__": {"k": "v"}}).encode()
    body += b" " * (3 - len(body) % 4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "odd.safetensors").write_bytes(struct.pack("<Q", len(body)) + body + b"hello")
    assert not A.header_of(str(tmp_path / "in" / "odd.safetensors")).aligned
    got = A.realign(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert [r["rewritten"] for r in got] == [True]
    h = A.header_of(got[0]["target"])
    assert h.aligned and h.metadata == {"k": "v"} and content(spark, str(tmp_path / "out")) == {("x", 0): b"hello"}
    assert not A.realign_file(got[0]["target"], str(tmp_path / "no")) and not (tmp_path / "no").exists()


def test_weights(spark, tmp_path):
    rng = np.random.default_rng(3)
    own = {f"{p}.{k}": rng.integers(0, 99, s).astype("<i4") for p in "qk" for k, s in {"qweight": (8, 4), "qzeros": (2, 4), "scales": (2, 4)}.items()}
    own |= {f"{p}.g_idx": (np.arange(16) // 8).astype("<i4") for p in "qk"} | {"o.g_idx": rng.permutation(16).astype("<i4"), "o.qweight": own["q.qweight"], "o.qzeros": own["q.qzeros"], "o.scales": own["q.scales"]}
    own |= {"gptq_bits": np.int32(4), "gptq_groupsize": np.int32(8), "q.weight": own["q.qweight"] + 1, "k.weight": own["k.qweight"] + 2}
    save(tmp_path / "m.safetensors", [(n, "I32", np.shape(a), np.asarray(a, "<i4").tobytes()) for n, a in own.items()])
    by_rank = lambda df: {r: [x["value"] for x in sorted(df.where(F.col("rank") == r).collect(), key=lambda x: x["pos"])] for r in range(2)}
    with open_tensors(spark, str(tmp_path), world_size=2) as t:
        w = Weights(t, {"alias.weight": ["none", "q.weight"]})
        assert w.name("alias.weight") == "q.weight" and w.shape("alias.weight") == [8, 4] and w.push("q.weight", 1).where("rank = 1").count() == 32
        with pytest.raises(E.UnknownTensor):
            w.name("zz")
        plain = by_rank(w.columns(["q", "k"], dim=0))
        assert plain[1] == np.concatenate([own["q.weight"][4:], own["k.weight"][4:]]).reshape(-1).tolist()
        cols = w.columns(["q", "k"], "gptq")
        assert (cols.bits, cols.groupsize) == (4, 8)
        assert by_rank(cols.qweight)[0] == np.concatenate([own["q.qweight"][:, :2], own["k.qweight"][:, :2]], axis=1).reshape(-1).tolist()
        with pytest.raises(E.UnequalTensors):
            w.columns(["q", "o"], "gptq")
        rows = w.rows("q", "gptq")
        assert rows.in_order and rows.g_idx is None and by_rank(rows.scales)[1] == own["q.scales"][1].tolist()
        odd = w.rows("o", "gptq")
        assert not odd.in_order and by_rank(odd.scales)[1] == own["o.scales"].reshape(-1).tolist() and by_rank(odd.g_idx)[1] == own["o.g_idx"][8:].tolist()
        assert by_rank(w.rows("q"))[1] == own["q.weight"][:, 2:].reshape(-1).tolist()
    save(tmp_path / "n.safetensors", [("z.weight", "U8", (2,), b"ab")])
    with open_tensors(spark, str(tmp_path / "n.safetensors")) as t:
        w = Weights(t)
        with pytest.raises(E.UnknownTensor):
            w.gptq_params()
        (tmp_path / "quantize_config.json").write_text('{"bits": 4, "group_size": 128}')
        w.read_params({}, str(tmp_path))
        assert w.gptq_params() == (4, 128)
        w.read_params({"quantization_config": {"bits": 8, "group_size": -1}})
        assert w.gptq_params() == (8, -1)


def test_measures(spark, cube, tmp_path):
    path, arrays = cube
    total = sum(x.nbytes for x in A.header_of(A.discover(path)[0]).entries)
    read, seen = perf.metered(A.read_blocks(spark, path))
    read.write.format("noop").mode("overwrite").save()
    assert seen.get["nbytes"] == total and seen.get["largest"] == arrays["wide"].nbytes
    assert S.bandwidth(perf.read_timings(spark, path, 2), "rank", "t0", "t1", "nbytes").first()["nbytes"] == total
    per = {r["rank"]: r["nbytes"] for r in perf.mapped_timings(spark, path, 2, [("wide", 1)]).collect()}
    assert sum(per.values()) == 2 * total - arrays["wide"].nbytes
    link = tmp_path / "again.safetensors"
    link.symlink_to(A.discover(path)[0])
    assert [r["nbytes"] for r in perf.drop_cache(spark, [path, str(link)]).collect()] == [A.header_of(A.discover(path)[0]).file_size]
    rand = T.random_tensor(spark, "r", [50, 40], 3)
    assert rand.count() == 2000 and abs(rand.agg(F.avg("value")).first()[0]) < 0.2
    rows = spark.createDataFrame([(0, 1, "p", bytearray(b"xy")), (0, 1, "p", bytearray(b"z"))], "batch int, rank int, path string, payload binary")
    assert S.batch_metrics(rows).first().asDict() == {"batch": 0, "rank": 1, "files": 1, "tensors": 2, "nbytes": 3}


def test_carriers(spark, cube):
    b = A.read_blocks(spark, cube[0], names=["p", "a"])
    got = {r["name"]: (r["dtype"], r["shape"], r["elem_count"]) for r in T.carrier_blocks(b).collect()}
    assert got == {"p": ("U8", [5, 4], 20), "a": ("I16", [4, 5, 6], 120)}
    assert T.elements(T.carrier_blocks(b.where("name = 'p'"))).count() == 20


def test_sessions_follow_the_configuration_and_are_reused(spark, cube, monkeypatch, tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"source": "mapped", "show_progress": False}))
    save(tmp_path / "y.safetensors", [("y", "U8", (2,), b"ab")])
    monkeypatch.setenv("TENSORFOLD_CONFIG", str(tmp_path / "own.json"))
    with open_tensors(spark, cube[0]) as t:
        assert t.config.source == "mapped" and t.tensor("a").count() == 120
        t.reset({0: [str(tmp_path / "y.safetensors")]})
        assert t.keys() == ["y"]


def test_tour(spark, tmp_path):
    import importlib.util
    from pathlib import Path

    spec = importlib.util.spec_from_file_location("tour", Path(__file__).parent.parent / "examples" / "tour.py")
    tour = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(tour)
    paths = tour.samples(spark, str(tmp_path))
    assert tour.single(spark, paths) == 8 * sum(range(16))
    whole, dealt = tour.parallel(spark, paths)
    sizes = lambda df: {r["rank"]: r["count"] for r in df.groupBy("rank").count().collect()}
    assert sizes(whole) == {0: 128, 1: 128} and sizes(dealt) == {0: 64, 1: 64}
    assert tour.reuse(spark, paths) == [["a0"], ["b0"]]
    assert tour.by_configuration(spark, paths) == [(0, "a0", 256), (1, "b0", 256)]

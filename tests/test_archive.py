import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorfold import errors as E
from tensorfold.functions import dtypes as D
from tensorfold.operators import catalog as C
from tensorfold.operators import tensors as T
from tensorfold.plans import placement as P
from tensorfold.plans.config import Config
from tensorfold.plans.session import open_tensors
from tensorfold.sources import archive as A
from tensorfold.sources.header import render
from tensorfold.streaming import pipeline as S


def save(path, tensors, metadata=None):
    with open(path, "wb") as f:
        f.write(render([(n, k, list(s)) for n, k, s, _ in tensors], metadata) + b"".join(x for *_, x in tensors))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("archives")
    rng = np.random.default_rng(0)
    for x in "abc":
        ramp = np.repeat(np.arange(16), 8).astype("<f2").tobytes()
        wide = rng.normal(size=(6, 4)).astype("<f4").tobytes()
        save(top / f"{x}.safetensors", [(f"{x}0", "F16", (16, 8), ramp), (f"{x}1", "F32", (6, 4), wide), (f"{x}4", "F4", (4, 8), bytes(range(16)))], {"origin": x})
    return str(top)


def test_catalog_and_pushdown(spark, files):
    cat = A.read_catalog(spark, files)
    assert cat.count() == 9 and C.require_unique(cat) is cat
    assert C.shape_of(cat, "b1") == [6, 4]
    with pytest.raises(E.UnknownTensor):
        C.shape_of(cat, "zz")
    assert {r["key"]: r["value"] for r in C.file_metadata(cat).collect()} .keys() == {"origin"}
    assert C.gaps(cat).isEmpty()
    one = A.read_blocks(spark, files, names=["a1"])
    assert one.rdd.getNumPartitions() == 1
    assert one.collect()[0]["elem_count"] == 24
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    everything = A.read_blocks(spark, files, pushdown=True, partition_bytes=100)
    one_file = A.read_blocks(spark, files, pushdown=True, partition_bytes=100).where(F.col("path") == f"{files}/b.safetensors")
    assert one_file.rdd.getNumPartitions() < everything.rdd.getNumPartitions()
    assert sorted(r["name"] for r in one_file.collect()) == ["b0", "b1", "b4"]
    assert A.read_blocks(spark, files, pushdown=True).where("name like 'b%'").count() == 3
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    binary = spark.read.format("binaryFile").load(files)
    assert sorted(map(str, A.catalog_of_binary(binary).drop("path").collect())) == sorted(map(str, cat.drop("path").collect()))


def test_blocks_split_and_row_ranges(spark, files):
    small = A.read_blocks(spark, files, block_bytes=64).where("name = 'a0'")
    assert [r[0] for r in small.orderBy("block_id").select("elem_count").collect()] == [32] * 4
    some = T.rows(A.read_blocks(spark, files, rows="2:5").where("name = 'a0'")).collect()
    assert sorted((r["row"], r["vec"][0]) for r in some) == [(2, 2.0), (3, 3.0), (4, 4.0)]


def test_elements_cast_view_equal(spark, files):
    b = A.read_blocks(spark, files)
    f4 = T.elements(b.where("name = 'a4'")).orderBy("pos").collect()
    assert [r["value"] for r in f4] == list(D.decode("F4", bytes(range(16))))
    half = T.elements(T.cast_blocks(b.where("name = 'a1'"), "F16"))
    full = T.elements(b.where("name = 'a1'"))
    pair = half.alias("h").join(full.alias("f"), "pos").select("h.value", "f.value").collect()
    assert all(np.float32(np.float16(y)) == x for x, y in pair)
    with pytest.raises(Exception, match="EnlargingCast"):
        T.cast_blocks(b.where("name = 'a0'"), "F32").collect()
    seen = T.elements(T.view_blocks(b.where("name = 'a0'"), "U16"))
    assert {r["raw"] for r in seen.collect()} == set(np.arange(16).astype("<f2").view("<u2").tolist())
    assert T.is_equal(full, full) and not T.is_equal(full, half)


def test_write_round_trip(spark, files, tmp_path):
    b = A.read_blocks(spark, files)
    A.write_archive(b.select("name", "dtype", "shape", "payload"), str(tmp_path / "out"), 2, {"made": "here"})
    again = A.read_blocks(spark, str(tmp_path / "out"))
    assert sorted((r["name"], bytes(r["payload"])) for r in again.collect()) == sorted((r["name"], bytes(r["payload"])) for r in b.collect())
    assert A.read_catalog(spark, str(tmp_path / "out")).where("not aligned").isEmpty()
    packed = T.tensor_rows(T.elements(b.where("name = 'a1'")), "F32", [6, 4]).collect()[0]
    assert bytes(packed["payload"]) == bytes(b.where("name = 'a1'").collect()[0]["payload"])
    with pytest.raises(Exception, match="twice"):
        A.write_archive(b.unionByName(b).select("name", "dtype", "shape", "payload"), str(tmp_path / "twice"))


def test_truncated_file_fails(spark, files, tmp_path):
    with open(f"{files}/a.safetensors", "rb") as f:
        data = f.read()
    (tmp_path / "t.safetensors").write_bytes(data[:-1])
    with pytest.raises(Exception, match="MetadataIncompleteBuffer|its tensors end"):
        A.read_catalog(spark, str(tmp_path / "t.safetensors")).collect()


def test_session(spark, files):
    with open_tensors(spark, files, world_size=2) as t:
        assert t.keys() == ["a0", "a1", "a4", "c0", "c1", "c4", "b0", "b1", "b4"]
        assert t.filename("b0").endswith("b.safetensors") and t.filename("zz") == ""
        assert list(t.metadata().values())[0] == {"origin": "a"}
        sizes = lambda df: {r[0]: r[1] for r in df.groupBy("rank").count().collect()}
        assert sizes(t.sharded("a0", 0)) == {0: 64, 1: 64}
        assert sizes(t.sharded("a1", 1)) == {0: 12, 1: 12}
        assert sizes(t.sharded("a1", -1)) == {0: 24, 1: 24}
        assert sizes(t.pushed("a1", 1)) == {1: 24}
        assert sizes(t.multi_cols(["b1", "a1"], 0)) == {0: 24, 1: 24}
        assert [r["name"] for r in t.multi_cols(["b1", "a1"], 0).select("part", "name").distinct().orderBy("part").collect()] == ["a1", "b1"]
        with pytest.raises(E.DimMismatch):
            t.multi_cols(["a0", "a1"], 0)
        with pytest.raises(E.UnknownTensor):
            t.tensor("zz")
        assert t.as_dict({"a0": 0}).keys() == {"a0"}
    with pytest.raises(E.ReleasedTensor):
        t.keys()


def test_duplicate_names(spark, files, tmp_path):
    save(tmp_path / "other.safetensors", [("a0", "U8", (1,), b"x")])
    with pytest.raises(E.DuplicateTensor):
        open_tensors(spark, {0: [f"{files}/a.safetensors"], 1: [str(tmp_path / "other.safetensors")]}, 2)


def test_alias_and_rules(spark, files):
    cat = A.read_catalog(spark, files)
    want = spark.createDataFrame([("a0",), ("x",), ("y",)], "name string")
    alias = spark.createDataFrame([("x", "b1", 1), ("x", "b0", 0), ("y", "none", 0)], "name string, alias string, ord int")
    assert {r[0]: r[1] for r in C.resolve_alias(want, alias, cat).collect()} == {"a0": "a0", "x": "b0", "y": "y"}
    manifest = {"m": {"world_size_2": {"rank_0": ["p"], "rank_1": ["q"]}, "world_size_0": {"rank_0": ["z"]}, "keys": {"all": ["wte"], "dim_0": ["c_fc"], "layer_prefix": "h."}}}
    assert C.manifest_files(manifest, "m", 2) == {0: ["p"], 1: ["q"]} and C.manifest_files(manifest, "m", 3) == {0: ["z"]}
    names = spark.createDataFrame([("h.c_fc.w",), ("h.wte",), ("other",)], "name string")
    assert {r[0]: r[1] for r in names.select("name", C.dim_rule(F.col("name"), C.key_rules(manifest, "m"))).collect()} == {"h.c_fc.w": 0, "h.wte": -1, "other": -1}


def test_stream_and_iterate(spark, files, tmp_path):
    seen = []
    S.for_each_batch(spark, files, lambda df, k: seen.append((k, sorted(r["name"] for r in df.collect()))), str(tmp_path / "ck"), 2)
    assert [n for _, n in seen if n] == [["a0", "a1", "a4", "b0", "b1", "b4"], ["c0", "c1", "c4"]]
    got = [(k, name) for k, name, *_ in S.iterate(spark, files, 2)]
    want = [(0, "a0"), (0, "a1"), (0, "a4"), (0, "b0"), (0, "b1"), (0, "b4"), (1, "c0"), (1, "c1"), (1, "c4")]
    assert got == want
    for config in (Config(use_pipeline=False), Config(queue_size=2), Config(block_bytes=64)):
        found = list(S.iterate(spark, files, 2, config))
        assert [x[:2] for x in found] == want and [x[4] for x in found if x[1] == "b4"] == [bytes(range(16))]
    backwards = [f"{files}/{x}.safetensors" for x in "cba"]
    assert [name for _, name, *_ in S.iterate(spark, backwards, 1)][::3] == ["c0", "b0", "a0"]
    some = S.iterate(spark, files, 1, Config(queue_size=1))
    assert next(some)[1] == "a0"
    some.close()  # the loading thread ends with it
    with pytest.raises(Exception, match="none.safetensors"):
        list(S.iterate(spark, [str(tmp_path / "none.safetensors")], 1, Config(queue_size=1)))


def test_progress_is_told(spark, files, caplog):
    with caplog.at_level("INFO", "tensorfold"):
        list(S.iterate(spark, files, 2))
    assert [r.getMessage() for r in caplog.records] == [" 50% | 1 of 2 batches", "100% | 2 of 2 batches"]
    caplog.clear()
    with caplog.at_level("INFO", "tensorfold"):
        list(S.iterate(spark, files, 2, Config(show_progress=False)))
    assert not caplog.records


def test_stamps(spark):
    from time import localtime, strftime

    assert S.stamp(1_700_000_000.25) == strftime("%Y-%m-%d %H:%M:%S", localtime(1_700_000_000)) + ".250"
    assert spark.range(1).select(S.stamp_of(F.lit(0.125))).first()[0] == "1970-01-01 00:00:00.125"
    with S.timed("nothing", 1e9):
        pass


def test_placement():
    assert P.batches(["a", "b"], 1) == [["a"], ["b"]]
    assert P.interleave({0: ["a", "c"], 1: ["b"]}) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    assert P.round_robin(["z/a", "y/b", "x/c"], 2, by_name=True) == {0: ["z/a", "x/c"], 1: ["y/b"]}
    assert (P.tag_bits(1), P.tag_bits(3), P.tag_bits(4)) == (1, 2, 3)
    assert [P.batches_in_memory(q) for q in (-1, 0, 3)] == [1, 2, 4]
    assert P.block_size([10, 20], 4, 1, 16) == 16 and P.block_size([10, 20], 2, 1, 16) == 20
    assert P.thread_buffer_kib(16384, 16) == 1024

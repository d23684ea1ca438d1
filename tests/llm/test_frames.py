import os

import numpy as np
from pyspark.sql import functions as F

from tensorfold.llm import frames
from tensorfold.llm import text as X


def path_of(table):
    return table.written_path.removeprefix("file://")


def test_scratch_deletes_what_is_not_kept(spark):
    with frames.scratch(spark) as kept:
        a, b = frames.written(spark.range(3), "a"), frames.written(spark.range(4), "b")
        with frames.scratch(spark):
            c = frames.written(spark.range(5), "c")
        assert not os.path.exists(path_of(c)) and os.path.exists(path_of(a))
        kept.add(b.written_path)
    assert not os.path.exists(path_of(a)) and b.count() == 4
    frames.discard(b)
    assert not os.path.exists(path_of(b))


def test_a_bound_of_the_session_stays(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 77)
    frames.batched(spark, 500)
    assert spark.conf.get(key) == "77"
    spark.conf.unset(key)
    frames.batched(spark, 500)
    assert spark.conf.get(key) == "500"
    frames.batched(spark, 1000)
    assert spark.conf.get(key) == "1000"
    spark.conf.set(key, before)


def test_small_tables_join_by_key_either_way(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("host"))
    small = spark.createDataFrame([("hot", 1), ("k3", 2)], "host string, v int")
    want = sorted(map(tuple, rows.join(small, "host", "left").select("id", "v").collect()))
    for most in (10, 1):
        assert sorted(map(tuple, frames.joined_left(rows, small, "host", 2, most, "id").select("id", "v").collect())) == want


def test_run_hashes_do_not_depend_on_the_place(monkeypatch):
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 256, 500, dtype=np.uint8)
    seen = set()
    for before in (0, 1, 65_530, 65_536, 200_000):
        data = np.concatenate([rng.integers(0, 256, before, dtype=np.uint8), passage, rng.integers(0, 256, 50, dtype=np.uint8)])
        runs = X.Runs(data)
        at = np.array([before, before + 3])
        seen.add((tuple(runs.of(at, at + 400).tolist()), tuple(runs.fixed(32)[before : before + 400].tolist())))
        assert runs.fixed(32)[before] == X.mix(runs.raw(at[:1], at[:1] + 32))[0]
    assert len(seen) == 1


def test_word_hashes_of_long_texts(monkeypatch):
    data = np.frombuffer(b"One two  THREE\nfour " * 200, np.uint8)
    bounds = np.array([0, 1000, 1000, 4000])
    whole, first = X.word_hashes(data, bounds)
    monkeypatch.setattr(X, "CHUNK_BYTES", 33)
    again, first_again = X.word_hashes(data, bounds)
    assert (whole == again).all() and (first == first_again).all() and whole[0] == X.word_hashes(np.frombuffer(b"x one", np.uint8), np.array([0, 5]))[0][1]


def test_components_in_one_task_and_in_several(spark, monkeypatch):
    import random

    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    label = {x: x for pair in links for x in pair}
    for _ in range(len(links)):
        again = False
        for a, b in links:
            low = min(label[a], label[b])
            again |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not again:
            break
    want = {k: v for k, v in label.items() if k != v}
    df = spark.createDataFrame(links, "a bigint, b bigint")
    for most in (200_000, 50, 3):
        monkeypatch.setattr(frames, "LINKS_A_TASK", most)
        assert {r["node"]: r["component"] for r in frames.components(df).collect()} == want
    assert frames.components(df.limit(0)).count() == 0

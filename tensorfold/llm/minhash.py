"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard checks.

1. A document's set: hashes (64 bits) of its distinct 5-word shingles. Sets with equal fingerprints (two 64-bit sums over the whole set)
   are one class; its smallest document stands for it, so copies are never paired.
2. Circulant MinHash (Li and Li, 2022): one permutation scatters the shingles, a second one, shifted by k for the k-th coordinate, orders
   them; both are bijections of 32-bit numbers. Bands are as many as let a pair at the threshold slip with probability ``MISSED`` (21 of 6 coordinates at 0.85).
3. Links are confirmed on full sets, in rounds without listing a bucket's pairs. In round one every member of a bucket is held
   against its smallest member. Confirmed links give components; a bucket whose members all share one is done. In round
   two the members of each other bucket are held against the smallest member outside the first one's component.
4. What is still split goes to tasks that hold each member once and find every link between different components by an index over the
   sets: a bucket of up to ``block`` members is one such group. Members of larger ones are grouped by the words of their prefixes instead: two similar sets
   share one of the members that come first in their order, rarest first, so groups are as small as these are rare, and no link
   is lost. A group whose sets have up to ``words`` members is one task. Of a larger one the sets outside its main component, the one with most of it, are
   dealt in blocks of so many, and so are the main ones: a task for each block of others and block of main ones, and for each pair of blocks of others.

Contract. A null or blank text has no shingles, no links and itself as component. A null doc_id is linked with
nothing either, and has no component. A text of any length is read whole; its set is held by one task. Of documents that tie as a group's smallest there is one id. Rows that share a doc_id are one document for links (any of its texts may link). Other
columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorfold.llm import text as X
from tensorfold.llm.frames import batched, components, discard, lean, written

WIDTH = 5
THRESHOLD = 85
MISSED = 5e-5
BLOCK = 256
#: Members of all sets that a task holds, 8 MB, but for a set that is larger by itself.
WORDS = 1 << 20
SIGNATURES = "doc bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>"


def banding(threshold: int = THRESHOLD) -> tuple[int, int]:
    """Bands, and coordinates in each."""
    rows = 6 if threshold >= 85 else 5
    return ceil(log(MISSED) / log1p(-((threshold / 100) ** rows))) if threshold < 100 else 1, rows


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation, of 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def circulant_minhash(sets: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """(rows, k): the least place of each set's members under the second permutation, shifted by each k. Every set has members."""
    out = np.empty((len(first) - 1, k), np.uint32)
    scattered = _scatter((sets ^ (sets >> X.U(32))).astype(np.uint32))
    step = 1 << 16
    i = 0
    while i < len(first) - 1:  # pieces that fit in a core's cache
        j = max(i + 1, int(np.searchsorted(first, first[i] + step, "right")) - 1)
        own, cuts = scattered[first[i] : first[j]], first[i:j] - first[i]
        for c in range(k):
            x = own + np.uint32(c)
            x ^= x >> np.uint32(17)
            x *= np.uint32(0xED5AD4BB)
            x ^= x >> np.uint32(11)
            x *= np.uint32(0xAC4C1B51)
            out[i:j, c] = np.minimum.reduceat(x, cuts)
        i = j
    return out


def sets_of(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    return X.distinct(*X.shingles(*X.word_hashes(data, bounds), width))


def _signatures(n_bands: int, n_rows: int):
    @lean
    def sign(batches):
        for b in batches:
            data, bounds = X.utf8(b.column("text"))
            doc = b.column("doc")
            for i, j in X.chunks(bounds):
                sets, first = sets_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                n = np.diff(first)
                some = n > 0
                starts = first[:-1][some]
                f1, f2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                bands = np.zeros((j - i, n_bands), np.uint64)
                if some.any():
                    f1[some] = np.add.reduceat(X.mix(sets), starts)
                    f2[some] = np.add.reduceat(X.mix(sets ^ X.BASE), starts)
                    least = circulant_minhash(sets, np.append(starts, len(sets)), n_bands * n_rows).astype(np.uint64).reshape(-1, n_bands, n_rows)
                    key = np.zeros(least.shape[:2], np.uint64)
                    for r in range(n_rows):
                        key = X.mix(key * X.BASE + least[:, :, r] + X.U(r))
                    bands[some] = key
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * n_bands)]).astype(np.int32)), pa.array(X.signed(bands[some].reshape(-1))))
                yield pa.RecordBatch.from_arrays([doc.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(X.signed(f1)), pa.array(X.signed(f2)), lists], names=["doc", "n", "f1", "f2", "bands"])

    return sign


def similar(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether 100 times the sets' common members reach the threshold's share of all members. Both are sorted."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < threshold * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _set_of(value) -> np.ndarray:
    return np.frombuffer(value, np.uint64)


def _check_pairs(threshold):
    def check(batches):
        for b in batches:
            ok = [similar(_set_of(x.as_buffer()), _set_of(y.as_buffer()), threshold) for x, y in zip(b.column("sa"), b.column("sb"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return check


@lean
def _sets(batches):
    for b in batches:
        data, bounds = X.utf8(b.column("text"))
        for i, j in X.chunks(bounds):
            sets, first = sets_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            raw = [sets[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc").slice(i, j - i), pa.array(raw, pa.binary())], names=["doc", "set"])


def links_between(sets: list[np.ndarray], component: list[int], allowed=None, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Pairs of places whose sets are similar and whose components differ, enough of them to join all that belong together.

    Every set outside the largest component is held against all others at once: an index by member counts what they share. ``allowed`` gives, for a place, the
    places that it is this task's to compare with it.
    """
    if not sets:
        return []
    parent = {c: c for c in component}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    n, of = np.array([len(s) for s in sets]), np.array(component, np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(sets)), n)[np.argsort(token, kind="stable")]
    counts = np.bincount(token)
    starts = np.cumsum(counts) - counts
    kinds, sizes = np.unique(of, return_counts=True)
    out = []
    for k in np.flatnonzero(of != kinds[sizes.argmax()]).tolist():
        own = token[first[k] : first[k + 1]]
        many = counts[own]
        at = np.arange(many.sum()) + np.repeat(starts[own] - (np.cumsum(many) - many), many)
        both = np.bincount(holders[at], minlength=len(sets))
        near = (100 * both >= threshold * (n[k] + n - both)) & (of != of[k])
        if allowed is not None:
            near &= allowed(k)
        near = np.flatnonzero(near)
        for other in near[np.unique(of[near], return_index=True)[1]].tolist():
            if root(component[k]) != root(component[other]):
                out.append((k, other))
                parent[root(component[k])] = root(component[other])
    return out


#: A task of a group is (i, j): WHOLE and 0 if it holds all of it; else a block of others, and a block of main ones or -1 less a block of others.
WHOLE = -1


def _link_blocks(threshold: int):
    def run(key, table):
        sets = [_set_of(x.as_buffer()) for x in table.column("set")]
        doc, component = (table.column(c).to_pylist() for c in ("doc", "component"))
        own = table.column("own").to_numpy()
        i, j = key[2].as_py(), key[3].as_py()
        if i == WHOLE or j == -1 - i:
            allowed = None
        elif j < 0:
            allowed = lambda k: own != own[k]
        else:
            allowed = lambda k: (own < 0) != (own[k] < 0)
        found = links_between(sets, component, allowed, threshold)
        return pa.table({"a": pa.array([doc[x] for x, _ in found], pa.int64()), "b": pa.array([doc[y] for _, y in found], pa.int64())})

    return run


def _dealt(inside: DataFrame, words: int) -> DataFrame:
    """(g1, g2, i, j, own, doc, component): the members of groups that are split, for each of their tasks; own is a member's block among others, -1 for a main one."""
    kinds = inside.groupBy("g1", "g2", "component").agg(F.sum("n").alias("n"))
    sizes = kinds.groupBy("g1", "g2").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    blocks = [F.ceil((F.col("n") - F.col("main.n")) / words).alias("others"), F.ceil(F.col("main.n") / words).alias("mains")]
    sizes = sizes.select("g1", "g2", F.col("main.component").alias("main"), (F.col("n") <= words).alias("whole"), *blocks)
    rows = inside.join(sizes, ["g1", "g2"]).withColumn("own", F.expr("if(component = main, -1L, pmod(xxhash64(doc), others))"))
    whole = f"array(struct({WHOLE}L as i, 0L as j))"
    of_main = "transform(sequence(0L, others - 1), x -> struct(x as i, pmod(xxhash64(doc), mains) as j))"
    of_other = "concat(transform(sequence(0L, mains - 1), x -> struct(own as i, x as j)), transform(sequence(0L, others - 1), x -> struct(least(own, x) as i, -1L - greatest(own, x) as j)))"
    rows = rows.withColumn("task", F.explode(F.expr(f"case when whole then {whole} when own < 0 then {of_main} else {of_other} end")))
    return rows.select("g1", "g2", "task.i", "task.j", "own", "doc", "component")


@lean
def _members(batches):
    """A row for each member of each set."""
    for b in batches:
        for doc, raw in zip(b.column("doc").to_pylist(), b.column("set"), strict=True):
            own = X.signed(_set_of(raw.as_buffer()))
            for i in range(0, len(own), 1 << 16):
                part = own[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), doc)), pa.array(np.full(len(part), len(own))), pa.array(part)], names=["doc", "n", "token"])


def _by_prefix(large: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(g1, g2, doc, n, component): members under each word of their prefix that another of them has too."""
    tokens = written(large.select("doc").join(sets, "doc").mapInArrow(_members, "doc bigint, n bigint, token bigint"), "tokens")
    shared = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    own = tokens.join(shared, "token").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("own"))
    # Words that no other set has come first in the order and make no group.
    # So many of a set's members, first in an order for all sets, hold one that it shares with each similar set.
    length = F.expr(f"n - ({threshold} * n + 99) div 100 + 1")
    left = F.greatest(length - (F.col("n") - F.size("own")), F.lit(0)).cast("int")
    first = own.select("doc", "n", F.explode(F.slice("own", F.lit(1), left)).alias("x"))
    return first.join(large, "doc").select(F.lit(-1).cast("bigint").alias("g1"), F.col("x.token").alias("g2"), "doc", "n", "component")


def groups(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of documents."""
    spark = docs.sparkSession
    batched(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = written(rows.mapInArrow(_signatures(*banding(threshold)), SIGNATURES), "signatures")
    full = signed.where("n > 0 and doc is not null")
    # Classes of equal sets.
    reps = full.groupBy("f1", "f2", "n").agg(F.min("doc").alias("rep"))
    members = full.select("doc", "f1", "f2", "n").join(reps, ["f1", "f2", "n"]).select("doc", "rep").distinct()
    links = members.where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    # Buckets with different classes.
    keyed = full.join(reps.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi").select("doc", "n", F.posexplode("bands").alias("band", "key"))
    several = keyed.groupBy("band", "key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high")
    bucketed = written(keyed.join(several.select("band", "key", "low"), ["band", "key"]).distinct(), "buckets")
    wanted = bucketed.select("doc").distinct().hint("merge")  # the same plan at every size
    sets = written(rows.where("doc is not null").join(wanted, "doc", "left_semi").mapInArrow(_sets, "doc bigint, set binary").distinct(), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        both = pairs.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), "a")
        return both.select("a", "b", "sa", "sb").mapInArrow(_check_pairs(threshold), "a bigint, b bigint").distinct()

    def labelled(found: DataFrame) -> DataFrame:
        """Members of buckets that are still split, with their component."""
        label = components(found)
        own = bucketed.join(label, F.col("doc") == F.col("node"), "left").select("band", "key", "doc", "n", F.coalesce("component", "doc").alias("component"))
        split = own.groupBy("band", "key").agg(F.min(F.struct("doc", "component")).alias("x"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
        return written(own.join(split.select("band", "key", F.col("x.component").alias("lead")), ["band", "key"]), "split")

    first = written(confirmed(bucketed.select(F.col("doc").alias("a"), F.col("low").alias("b"))), "confirmed")
    left = labelled(first.unionByName(links))
    outside = left.where("component <> lead").groupBy("band", "key").agg(F.min(F.struct("doc", "component")).alias("c"))
    pairs = left.join(outside, ["band", "key"]).where("component <> c.component").select(F.col("doc").alias("a"), F.col("c.doc").alias("b"))
    second = written(confirmed(pairs), "confirmed")
    known = written(first.unionByName(second).unionByName(links).distinct(), "links")
    left = labelled(known)
    third = None
    if not left.isEmpty():
        sizes = left.groupBy("band", "key").agg(F.count("*").alias("m"))
        own = left.join(sizes, ["band", "key"])
        inside = own.where(F.col("m") <= block).select(F.col("band").cast("bigint").alias("g1"), F.col("key").alias("g2"), "doc", "n", "component")
        large = written(own.where(F.col("m") > block).select("doc", "component").distinct(), "large")
        if not large.isEmpty():
            inside = inside.unionByName(_by_prefix(large, sets, threshold))
        members = _dealt(written(inside, "inside"), words).join(sets, "doc")
        third = members.groupBy("g1", "g2", "i", "j").applyInArrow(_link_blocks(threshold), "a bigint, b bigint")
    label = written(components(known if third is None else known.unionByName(third)), "components")
    discard(bucketed, sets, first, second, known)
    per_doc = signed.select("doc", "n")
    out = per_doc.join(label, F.col("doc") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of documents that stand for their group; of rows that share a kept doc_id, one of each text stays: the one whose other columns have the least hash."""
    kept = groups(docs, threshold).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__n"))
    kept = written(kept, "kept")
    key = docs["doc_id"].cast("bigint")
    single = docs.join(kept.where("__n = 1").select("__kept"), key == F.col("__kept"), "left_semi")
    several = docs.join(kept.where("__n > 1").select("__kept"), key == F.col("__kept"), "left_semi")
    rest = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")]
    one = several.groupBy("doc_id", "text").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in rest], F.lit(0))).alias("__row"))
    return single.unionByName(one.select("__row.*")).unionByName(docs.where(docs["doc_id"].isNull()))

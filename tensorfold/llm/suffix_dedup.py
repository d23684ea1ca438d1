"""Exact removal of repeated passages: every byte that a string of ``length`` bytes covers which also starts earlier.

1. Anchors. Of each window of ``length`` bytes, the run of ``ANCHOR`` bytes with the least hash is its anchor; equal windows have equal
   anchors at the same place, so only windows whose anchors are equal need comparing. Windows that follow one another with
   the same anchor make a segment. Anchors that occur once are dropped: counts by anchor hash, then a bounded bit filter and an exact join.
2. Equal segments (equal bytes, same place of the anchor) but the first are repeated as a whole; they are found by a
   map-side combined minimum and a join, so no group of copies is gathered.
3. Of the different segments of an anchor, the first of each kind go, dealt by anchor, to suffix arrays built by linear
   grouping over blocks of ``BLOCK`` bytes counted from the anchor. Neighbours in the suffix array that agree in all whole blocks of
   a window, and whose windows agree in the bytes before and after those blocks, are the same window; all but its first are repeated.
   Anchors with more than ``most`` kinds of segment are split by window instead: one row a window, and the same minimum and join.
4. Ranges are joined to their rows, and merged.

Strings are compared by 64-bit hashes of their bytes, with the anchor's; long texts are looked at in overlapping tiles, so memory follows the text's length once.

Contract. A null text is empty. A null doc_id comes after all others. Rows that share a doc_id and differ in text are
documents of their own, ordered by the text's fingerprint; rows alike in both are the same document and don't repeat
each other. Other columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorfold.llm import text as X
from tensorfold.llm.frames import BitFilter, batched, discard, identified, lean, written
from tensorfold.llm.suffix_array import suffix_array

LENGTH = 100
ANCHOR = 32
BLOCK = 16
MOST_KINDS = 4096
BATCH_SYMBOLS = 24_000
U = np.uint64
PLACE_BITS = 31
#: Windows of a long text looked at together.
TILE = 1 << 20

SEGMENT = "h bigint, sh bigint, doc bigint, fp bigint, a int, n int, rel int"


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    n = len(v)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = v
    blocks = blocks.reshape(-1, w)
    up = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    down = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    return np.minimum(down[: n - w + 1], up[w - 1 : n])


def segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Of texts in a buffer: row, first window, windows, anchor's place from the first window, anchor hash and the hasher of the bytes."""
    size = np.diff(bounds)
    long_enough = size >= length
    if not long_enough.any():
        return None
    runs = X.Runs(data)
    h = runs.fixed(anchor)
    mask = U((1 << PLACE_BITS) - 1)  # one width everywhere, else equal windows of two buffers could differ in their anchors
    least = _sliding_least((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
    at = (least & mask).astype(np.int64)
    lo, hi = bounds[:-1][long_enough], bounds[1:][long_enough] - length + 1
    step = np.zeros(len(at) + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    inside = np.cumsum(step[:-1]) > 0
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = at[1:] != at[:-1]
    new[lo] = True
    start = np.flatnonzero(inside & new)
    last = np.empty(len(at), bool)
    last[-1] = True
    last[:-1] = new[1:] | ~inside[1:]
    end = np.flatnonzero(inside & last) + 1
    row = np.searchsorted(bounds, start, "right") - 1
    return row, start, end - start, at[start] - start, h[at[start]], runs


def tiles(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH):
    """(first row, offset in it, bytes, bounds) of rows together, and of parts of longer ones that overlap so that each window lies whole in one."""
    for i, j in X.chunks(bounds):
        size = int(bounds[j] - bounds[i])
        if j - i > 1 or size < TILE + length:
            yield i, 0, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            continue
        for at in range(0, size - length + 1, TILE):
            part = data[bounds[i] + at : min(bounds[i] + at + TILE + length - 1, bounds[j])]
            yield i, at, part, np.array([0, len(part)])


@lean
def _anchors(batches):
    """Anchor hashes, one row for each segment."""
    for b in batches:
        data, bounds = X.utf8(b.column("text"))
        for _, _, part, own in tiles(data, bounds):
            found = segments(part, own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(X.signed(found[4]))], names=["h"])


def _segments_among(bits):
    words = bits.value

    @lean
    def find(batches):
        kept = BitFilter(words)
        for b in batches:
            data, bounds = X.utf8(b.column("text"))
            doc, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "fp"))
            for i, at, part, own in tiles(data, bounds):
                found = segments(part, own)
                if not found:
                    continue
                row, start, n, rel, h, runs = found
                ok = kept.passes(h)
                row, start, n, rel, h = row[ok], start[ok], n[ok], rel[ok], h[ok]
                sh = X.mix(runs.of(start, start + n + LENGTH - 1) + rel.astype(np.uint64))
                a = start - own[row] + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(X.signed(h)), pa.array(X.signed(sh)), pa.array(doc[i + row]), pa.array(fp[i + row]), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(rel.astype(np.int32))],
                    names=["h", "sh", "doc", "fp", "a", "n", "rel"],
                )

    return find


def repeated_windows(seg_bytes: list[bytes], n: np.ndarray, rel: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Of segments in the order of their places: (segment, first window, last window) of the runs of windows that an earlier one has.

    Windows are compared at the same distance from the anchor, through one suffix array over all segments' blocks.
    """
    size = np.array([len(s) for s in seg_bytes], np.int64)
    first_block = rel % BLOCK
    blocks = np.maximum(size - first_block, 0) // BLOCK
    data = np.frombuffer(b"".join(seg_bytes), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    seg_of = np.repeat(np.arange(len(size)), blocks)
    base = np.concatenate([[0], np.cumsum(blocks + 1)])
    within = np.arange(len(seg_of)) - np.repeat(np.concatenate([[0], np.cumsum(blocks)])[:-1], blocks)
    cells = data[(at + first_block)[seg_of][:, None] + within[:, None] * BLOCK + np.arange(BLOCK)]
    halves = np.ascontiguousarray(cells).view(">u8").astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    changed = np.empty(len(order), bool)
    changed[:1] = True
    changed[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(changed)
    symbols = np.zeros(base[-1], np.int64)  # 0 parts the segments
    symbols[base[seg_of] + within] = name
    sa = suffix_array(symbols)
    most = length // BLOCK
    ahead = np.concatenate([symbols, np.zeros(most, np.int64)])[sa[:, None] + np.arange(most)]
    differs = ahead[1:] != ahead[:-1]
    fewest = (length - BLOCK + 1) // BLOCK
    run = {}
    for m in range(fewest, most + 1):
        ids = np.empty(len(sa), np.int64)
        ids[sa] = np.concatenate([[0], np.cumsum(differs[:, :m].any(axis=1))])
        run[m] = ids
    seg = np.repeat(np.arange(len(n)), n)
    idx = np.arange(len(seg)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    q = (idx - first_block[seg] + BLOCK - 1) // BLOCK
    left = first_block[seg] + BLOCK * q - idx
    m = (length - left) // BLOCK
    begin = at[seg] + idx
    runs = X.Runs(data)
    key = X.mix(runs.of(begin, begin + left)) + runs.of(begin + left + BLOCK * m, begin + length)
    suffix = base[seg] + q
    ids = np.zeros(len(seg), np.int64)
    for k, r in run.items():
        chosen = m == k
        ids[chosen] = r[suffix[chosen]] * (most + 1) + k
    key = X.mix(key + ids.astype(np.uint64) * X.BASE)
    by = np.argsort(key, kind="stable")
    again = np.zeros(len(seg), bool)
    again[by[1:]] = key[by[1:]] == key[by[:-1]]
    hit = np.flatnonzero(again)
    if not len(hit):
        return []
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(seg[hit]) != 0)) + 1
    lo, hi = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])]
    return list(zip(seg[lo].tolist(), idx[lo].tolist(), idx[hi].tolist(), strict=True))


RANGE = "doc bigint, fp bigint, s int, e int"
CUT = "h bigint, doc bigint, fp bigint, a int, n int, rel int, bytes binary"


@lean
def _suffix_sorted(batches):
    """Rows of segments, those of an anchor together; out come repeated byte ranges."""
    held: list[dict] = []

    def flush(rows):
        rows.sort(key=lambda r: (r["doc"], r["fp"], r["a"]))
        out = repeated_windows([r["bytes"] for r in rows], np.array([r["n"] for r in rows]), np.array([r["rel"] for r in rows]))
        return pa.RecordBatch.from_pylist([{"doc": rows[k]["doc"], "fp": rows[k]["fp"], "s": rows[k]["a"] + i, "e": rows[k]["a"] + j + LENGTH} for k, i, j in out], RANGE_ARROW)

    weight = 0
    for b in batches:
        for r in b.to_pylist():
            if weight > BATCH_SYMBOLS and r["h"] != held[-1]["h"]:
                yield flush(held)
                held, weight = [], 0
            held.append(r)
            weight += len(r["bytes"]) // BLOCK + 1
    if held:
        yield flush(held)


RANGE_ARROW = pa.schema([("doc", pa.int64()), ("fp", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


@lean
def _windows(batches):
    """A row for each window of a segment: anchor, distance from it, hash and place."""
    for b in batches:
        for r in b.to_pylist():
            runs = X.Runs(np.frombuffer(r["bytes"], np.uint8))
            i = np.arange(r["n"])
            k = len(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, r["h"])), pa.array((i - r["rel"]).astype(np.int32)), pa.array(X.signed(runs.of(i, i + LENGTH))), pa.array(np.full(k, r["doc"])), pa.array(np.full(k, r["fp"])), pa.array((r["a"] + i).astype(np.int32))],
                names=["h", "d", "w", "doc", "fp", "s"],
            )


@lean
def _cut(batches):
    """Bytes of each row's listed segments."""
    for b in batches:
        rows = []
        for doc, fp, text, parts in zip(b.column("doc").to_pylist(), b.column("fp").to_pylist(), b.column("text"), b.column("parts").to_pylist(), strict=True):
            raw = memoryview(text.as_buffer())
            rows += [{"h": p["h"], "doc": doc, "fp": fp, "a": p["a"], "n": p["n"], "rel": p["rel"], "bytes": bytes(raw[p["a"] : p["a"] + p["n"] + LENGTH - 1])} for p in parts]
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_pylist(rows[i : i + 20_000], CUT_ARROW)


CUT_ARROW = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("fp", pa.int64()), ("a", pa.int32()), ("n", pa.int32()), ("rel", pa.int32()), ("bytes", pa.binary())])


def repeated_ranges(docs: DataFrame, most: int = MOST_KINDS) -> DataFrame:
    """(doc, fp, s, e): byte ranges of identified rows that earlier rows have; ranges of a row may touch or overlap."""
    spark = docs.sparkSession
    batched(spark)
    texts = docs.select("doc", "fp", "text").where(F.octet_length("text") >= LENGTH)
    twice = written(texts.select("text").mapInArrow(_anchors, "h bigint").groupBy("h").count().where("count > 1").select("h"), "anchors")
    bits = spark.sparkContext.broadcast(BitFilter.of(twice, "h").words)
    found = written(texts.mapInArrow(_segments_among(bits), SEGMENT).join(twice, "h", "left_semi"), "segments")
    first = written(found.groupBy("h", "sh").agg(F.min(F.struct("doc", "fp", "a", "n", "rel")).alias("first")), "kinds")
    place = F.struct("doc", "fp", "a", "n", "rel")
    copies = found.join(first, ["h", "sh"]).where(place != F.col("first")).select("doc", "fp", F.col("a").alias("s"), (F.col("a") + F.col("n") + LENGTH - 1).alias("e"))
    kinds = first.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    parts = first.join(kinds, "h").select("h", "kinds", "first.*")
    listed = parts.groupBy("doc", "fp").agg(F.collect_list(F.struct("h", "kinds", "a", "n", "rel")).alias("parts"))
    cut = written(texts.join(listed, ["doc", "fp"]).dropDuplicates(["doc", "fp"]).mapInArrow(_cut, CUT).join(kinds, "h"), "cuts")
    few = cut.where(F.col("kinds") <= most).drop("kinds")
    sorted_ = few.repartition("h").sortWithinPartitions("h").mapInArrow(_suffix_sorted, RANGE)
    windows = cut.where(F.col("kinds") > most).drop("kinds").mapInArrow(_windows, "h bigint, d int, w bigint, doc bigint, fp bigint, s int")
    earliest = windows.groupBy("h", "d", "w").agg(F.min(F.struct("doc", "fp", "s")).alias("first"))
    later = windows.join(earliest, ["h", "d", "w"]).where(F.struct("doc", "fp", "s") != F.col("first")).select("doc", "fp", "s", (F.col("s") + LENGTH).alias("e"))
    ranges = written(copies.unionByName(sorted_).unionByName(later), "ranges")
    discard(twice, found, first, cut)
    return ranges


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Identified rows with the list of their ranges (null where there are none)."""
    per = ranges.groupBy("doc", "fp").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    return docs.join(per, ["doc", "fp"], "left")


@lean
def _digests(batches):
    for b in batches:
        rows = []
        for doc_id, text, ranges in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("ranges").to_pylist(), strict=True):
            raw, spans = bytes(text.as_buffer()), merged(ranges or [])
            kept = kept_bytes(raw, spans)
            rows.append({"doc_id": doc_id, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, DIGEST_ARROW)


DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    rows = identified(docs, F.col("doc_id").cast("bigint").alias("doc_id"))
    return with_ranges(rows, repeated_ranges(rows)).select("doc_id", "text", "ranges").mapInArrow(_digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows with repeated passages cut out of their texts. Characters that a cut splits go whole; n_chars, if there, follows the text.

    Rows whose whole text was repeated are dropped; rows that were empty before stay.
    """
    names = [f.name for f in docs.schema]
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "doc_id", "text")
    rows = identified(plain, "__row")
    ranges = repeated_ranges(rows)

    @F.pandas_udf(T.StringType())
    def cut(text, found):
        return text.combine(found, lambda t, r: t if r is None or not len(r) else kept_bytes(t.encode(), merged(r)).decode("utf-8", "ignore"))

    out = with_ranges(rows, ranges).withColumn("__kept", F.when(F.col("ranges").isNull(), F.col("text")).otherwise(cut("text", "ranges")))
    out = out.where((F.length(F.trim("__kept")) > 0) | F.col("ranges").isNull())
    fresh = {"text": F.when(F.col("ranges").isNull(), F.col("__row.text")).otherwise(F.col("__kept")), "n_chars": F.when(F.col("ranges").isNull(), F.col("__row.n_chars")).otherwise(F.length("__kept").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else None}
    return out.select(*[(fresh[c] if c in fresh else F.col(f"__row.`{c}`")).alias(c) for c in names])

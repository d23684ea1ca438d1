"""Quality by votes of the nearest labelled documents in a latent semantic space.

Terms: each word's shape (runs of capitals, letters or digits count once, other characters stand for themselves), pairs of neighbouring shapes, and how
large a share of words and lines is repeated, capital or marks. They are hashed to ``TERMS``; the lower-cased words themselves to ``WORDS`` more, which together
weigh ``WORD_SHARE`` times what the others do in the sample. A bounded sample of labelled rows (at most ``SAMPLE``
ids of each label and as many of their rows, least hash first, equal rows once; rows held out never) gives inverse document frequencies and, by a randomised singular value decomposition of its sparse rows (no matrix of terms by terms, none of rows by rows),
``RANK`` latent directions. The sample's unit vectors and labels are broadcast (at most 2 x SAMPLE x RANK floats). Every document is held
against all of them by exact cosines in blocks; the ``NEIGHBOURS`` largest vote, weighted by similarity. Votes are weighted back to the labels'
shares in all labelled rows.

Contract. Only texts enter a score, and whole ones. A null or empty text, or no labels at all, scores the share of label 1 (0.5 if there is none). Conflicting
labels of a doc_id count as 0; a null doc_id has no label and is not held out. Neighbours that tie with the last one all vote. Rows alike
score alike, up to the rounding of matrix products. Other columns don't matter. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorfold.llm import rules
from tensorfold.llm import text as X
from tensorfold.llm.frames import batched

TERMS, WORDS = 1 << 12, 1 << 14
WORD_SHARE = 1.0
RANK = 48
SAMPLE = 2048
NEIGHBOURS = 25
FOLDS, HELD_OUT = 4, 2
CUT = 0.7
ROWS = 512
MORE, ROUNDS = 32, 8

_shape = np.arange(256, dtype=np.uint8)
_shape[65:91] = ord("A")
_shape[97:123] = ord("a")
_shape[128:] = ord("a")
_shape[48:58] = ord("0")


def terms(data: np.ndarray, bounds: np.ndarray):
    """Runs of hashed terms of texts in a buffer, each with the rows they are of."""
    n = len(bounds) - 1
    starts, ends, first = X.words(data, bounds)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    yield TERMS + _bucket(X.mix(X.hashes_of(data, starts, ends, lower=True)), WORDS), row
    shape = _shape[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.concatenate([np.zeros(1, np.uint32), np.cumsum(keep, dtype=np.uint32)])
    word = X.hashes_of(shape[keep], place[starts].astype(np.int64), place[ends].astype(np.int64))
    del shape, keep, place
    yield _bucket(word, TERMS), row
    if len(word) > 1:
        pair = row[1:] == row[:-1]
        yield _bucket(X.mix(word[:-1] * X.BASE + word[1:])[pair], TERMS), row[1:][pair]
    counts = rules.count_texts(data, bounds)
    some = counts["n_words"] > 0
    for k, name in enumerate(("repeats", "dup_lines", "capitals", "symbols", "bare_marks")):
        level = np.ceil(counts[name] * 10).astype(np.uint64)
        for least in (1, 2, 4, 6):  # nested, so that near shares have terms in common; each weighs as part of the words
            hit = some & (level >= least)
            times = np.maximum(counts["n_words"] // 10, 1)[hit]
            yield _bucket(np.full(int(times.sum()), X.mix(np.array([1 + 100 * k + least], np.uint64))[0]), TERMS), np.repeat(np.flatnonzero(hit).astype(np.int32), times)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> X.U(64 - n.bit_length() + 1)).astype(np.int32)


def term_rows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's terms, in order, their damped counts, and the rows' bounds among them."""
    if len(bounds) == 2:  # one text, which may be long
        total = np.zeros(TERMS + WORDS, np.int64)
        for term, _ in terms(data, bounds):
            total += np.bincount(term, minlength=len(total))
        keys = np.flatnonzero(total)
        count = total[keys]
    else:
        keys, count = np.unique(np.concatenate([row * np.int64(TERMS + WORDS) + term for term, row in terms(data, bounds)]), return_counts=True)
    row, term = np.divmod(keys, TERMS + WORDS)
    return term, np.log1p(count).astype(np.float32), np.searchsorted(row, np.arange(len(bounds)))


def projected(term: np.ndarray, value: np.ndarray, first: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Sums of each row's terms' projections."""
    out = np.zeros((len(first) - 1, projection.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(projection[term] * value[:, None], first[some], axis=0)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _sparse(batches):
    for b in batches:
        data, bounds = X.utf8(b.column("text"))
        label = b.column("quality").to_pylist()
        for i, j in _slices(bounds):
            term, value, first = term_rows(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            rows = [{"quality": label[i + k], "term": term[x:y].tolist(), "value": value[x:y].tolist()} for k, (x, y) in enumerate(zip(first[:-1], first[1:], strict=True))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("quality", pa.int32()), ("term", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))]))


def _slices(bounds):
    for i, j in X.chunks(bounds):
        for k in range(i, j, ROWS):
            yield k, min(k + ROWS, j)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _directions(term: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of sparse rows, by subspace iteration; only a slab of rows is dense at a time."""
    size = TERMS + WORDS
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).standard_normal((size, RANK + MORE), np.float32))[0]
    for _ in range(ROUNDS):
        onto, small = np.zeros_like(basis), np.zeros((basis.shape[1], basis.shape[1]))
        for a in range(0, len(first) - 1, 256):
            bounds = first[a : a + 257]
            slab = np.zeros((len(bounds) - 1, size), np.float32)
            slab[np.repeat(np.arange(len(slab)), np.diff(bounds)), term[bounds[0] : bounds[-1]]] = value[bounds[0] : bounds[-1]]
            seen = slab @ basis
            onto += slab.T @ seen
            small += seen.T.astype(np.float64) @ seen
        within = np.linalg.eigh(small)[1][:, ::-1]
        leading, basis = basis @ within[:, :RANK].astype(np.float32), np.linalg.qr(onto)[0]
    return leading


class Model:
    def __init__(self, term: np.ndarray, value: np.ndarray, first: np.ndarray, labels: np.ndarray, share: float):
        self.share = share
        n = max(1, len(labels))
        idf = (np.log((1 + n) / (1 + np.bincount(term, minlength=TERMS + WORDS))) + 0.1).astype(np.float32)
        weighted = value * idf[term]
        words = term >= TERMS
        scale = np.sqrt(WORD_SHARE * (weighted[~words] ** 2).sum() / max((weighted[words] ** 2).sum(), 1e-9))
        idf[TERMS:] *= scale
        weighted[words] *= scale
        norm = np.sqrt(np.bincount(np.repeat(np.arange(len(labels)), np.diff(first)), weights=weighted.astype(np.float64) ** 2, minlength=len(labels)))
        weighted = (weighted / np.maximum(np.repeat(norm, np.diff(first)), 1e-9)).astype(np.float32)
        self.projection = (idf[:, None] * _directions(term, weighted, first)).astype(np.float32)
        self.vectors = np.concatenate([np.zeros((0, RANK), np.float32), *(_unit(projected(term[x[0] : x[-1]], value[x[0] : x[-1]], x - x[0], self.projection)) for a in range(0, len(labels), 256) for x in [first[a : a + 257]])])
        self.labels = labels.astype(np.float32)
        # Each label's votes are scaled to its share in all labelled rows.
        ones = max(float(labels.sum()), 1e-9)
        self.weights = np.where(labels == 1, share / ones, (1 - share) / max(n - ones, 1e-9)).astype(np.float32) * n

    def scores(self, term: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        filled = np.diff(first) > 0
        if not len(self.labels):
            return np.full(len(filled), self.share)
        cosine = _unit(projected(term, value, first, self.projection)) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
        found = np.take_along_axis(cosine, near, axis=1)
        weight = np.maximum(found, 0) ** 8 * self.weights[near] + 1e-9
        out = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        for r in np.flatnonzero((cosine >= found.min(axis=1, keepdims=True)).sum(axis=1) > k):  # all that tie with the last neighbour vote
            tied = np.flatnonzero(cosine[r] >= found[r].min())
            weight = np.maximum(cosine[r, tied], 0) ** 8 * self.weights[tied] + 1e-9
            out[r] = (weight * self.labels[tied]).sum() / weight.sum()
        return np.where(filled, out, self.share).astype(np.float64)


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows that are not held out."""
    batched(rows.sparkSession)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for q in (0, 1)]
    found = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("doc_id", "text", "quality").distinct()
    # Ids with many texts take no room from the other label.
    kept = [found.where(F.col("quality") == q).orderBy(F.xxhash64("text"), "doc_id", "text").limit(SAMPLE) for q in (0, 1)]
    got = kept[0].unionByName(kept[1]).select("text", "quality").mapInArrow(_sparse, "quality int, term array<int>, value array<float>").toArrow().sort_by("quality")
    term, value = got.column("term").combine_chunks(), got.column("value").combine_chunks()
    first = np.concatenate([[0], np.cumsum(term.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]).astype(np.int64)
    return Model(term.flatten().to_numpy(zero_copy_only=False).astype(np.int64), value.flatten().to_numpy(zero_copy_only=False), first, got.column("quality").to_numpy(), share)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))

    def score(batches):
        model = shared.value
        for b in batches:
            data, bounds = X.utf8(b.column("text"))
            for i, j in _slices(bounds):
                s = model.scores(*term_rows(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(s)], names=["doc_id", "score"])

    out = rows.mapInArrow(score, "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

"""Benchmark items in documents: latent semantic retrieval, with exact bounds for what it misses, then longest common subsequences and answer checks.

1. Words (lower-cased) are hashed to ``TERMS``. One pass over all documents gives the terms' frequencies by block and a sparse random
   sketch of the blocks' term counts (every block is added to one of ``SKETCH_ROWS`` sums, with a random sign), summed over tasks in a tree.
   Weighted by inverse block frequency, the sketch's singular vectors and values are a randomised SVD of the TF-IDF passages, cut
   to ``RANK``. Passages are two neighbouring blocks of ``STRIDE`` words.
2. Items and passages are projected, scaled by the inverse singular values, and every passage of every document is held against every item:
   a cosine of ``COSINE`` makes it a candidate. What that misses (short items, as they are a small part of a passage, and paraphrases without the
   rare words) is found by bounds that the rule of step 3 implies: a passage that holds an item must have one of the item's
   rarest words, as many of them as may be missing and one more (a copy), or its answer's rarest word (a paraphrase); and, counted with
   repeats, as many of the item's words as the rule asks for. A block that meets these is a candidate too, so none that the rule accepts is left out.
   Items come in blocks of ``ITEM_BLOCK``, and a pass over the documents serves ``BLOCKS_A_PASS`` of them, so what is broadcast has a bound.
3. The words around a candidate are compared with the item's: the longest common subsequence must hold ``COPY`` of
   the item's words, or ``PARAPHRASE`` of them and the answer, the item's last ``ANSWER`` words, in order within a passage of its length.

Contract. Null and empty texts and items match nothing; items of fewer than ``LEAST_WORDS`` words are sought whole and in order (``COPY`` = 1). Repeated rows
give their own matches once; of several places with an item the one with most common words counts, then one with the answer, then the largest cosine. A
text of any length is read whole; memory follows its words. Other columns pass through ``filtered``. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorfold.llm import text as X
from tensorfold.llm.frames import LAST_ID, batched, identified, lean, written

TERMS = 1 << 14
RANK = 128
SKETCH_ROWS = 256
POWER = 3
COSINE = 0.3
STRIDE = 16
COPY, PARAPHRASE, ANSWER, LEAST_WORDS = 0.8, 0.6, 6, 5
ITEM_BLOCK = 2048
CANDIDATES = 1 << 19
SLAB = 256
TREE = 256
TILE = 1 << 14
#: Blocks of items that one pass over the documents looks for.
BLOCKS_A_PASS = 8


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows' word bounds: each block's first word, and each row's blocks' bounds."""
    n = -(-np.diff(first) // STRIDE)
    bounds = np.concatenate([[0], np.cumsum(n)])
    within = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
    return np.repeat(first[:-1], n) + within * STRIDE, bounds


def term_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> X.U(64 - TERMS.bit_length() + 1)).astype(np.int64)


def _block_sums(projection: np.ndarray, term: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the projections of each block's terms; the projection has a row of zeros at its end."""
    zero = len(projection) - 1
    padded = np.append(term, np.full(STRIDE, zero))
    out = np.zeros((len(starts), projection.shape[1]), np.float32)
    held = np.empty((1024, projection.shape[1]), np.float32)
    for i in range(0, len(starts), 1024):  # tiles that fit in a core's cache
        own, begin, end = out[i : i + 1024], starts[i : i + 1024], ends[i : i + 1024]
        for k in range(STRIDE):
            own += np.take(projection, np.where(begin + k < end, padded[begin + k], zero), axis=0, out=held[: len(own)], mode="clip")
    return out


@lean
def _sketch(batches):
    """The sketch of the blocks' term counts, in slabs of terms, and the blocks with each term."""
    from pyspark import TaskContext

    product, df, n = np.zeros(TERMS * SKETCH_ROWS, np.int64), np.zeros(TERMS, np.int64), 0
    for b in batches:
        data, bounds = X.utf8(b.column("text"))
        doc = b.column("doc").to_numpy(zero_copy_only=False).view(np.uint64)
        for i, j in X.chunks(bounds):
            h, first = X.word_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            if not len(h):
                continue
            all_starts, of_row = _blocks(first)
            n += len(all_starts)
            # A block's place in the sketch and its sign come from its document, place and words: a retried task gives the same, and equal blocks of different documents are apart.
            row = np.repeat(np.arange(j - i), np.diff(of_row))
            mark = X.mix(np.add.reduceat(h, all_starts) + X.mix(doc[i + row] * X.BASE + (np.arange(len(row)) - of_row[row]).astype(np.uint64)))
            edges = np.append(all_starts, len(h))
            for t in range(0, len(all_starts), TILE):  # of a long text's blocks some at a time
                starts, own = edges[t : min(t + TILE, len(all_starts)) + 1], mark[t : t + TILE]
                term = term_of(h[starts[0] : starts[-1]])
                block = np.repeat(np.arange(len(own)), np.diff(starts))
                cell = term * SKETCH_ROWS + (own % X.U(SKETCH_ROWS)).astype(np.int64)[block]
                np.add.at(product, cell, (2 * (own >> X.U(63)).astype(np.int64) - 1)[block])
                pairs = np.sort(block * TERMS + term)
                df += np.bincount(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] % TERMS, minlength=TERMS)
    part, product = TaskContext.get().partitionId(), product.reshape(TERMS, SKETCH_ROWS)
    for s in range(0, TERMS, SLAB):
        yield pa.RecordBatch.from_arrays([pa.array([part % TREE]), pa.array([s // SLAB]), pa.array([product[s : s + SLAB].tobytes()], pa.binary()), pa.array([df[s : s + SLAB].tobytes()], pa.binary()), pa.array([n])], names=["branch", "slab", "product", "df", "n"])


SKETCH = "branch bigint, slab bigint, product binary, df binary, n bigint"


def _summed(table):
    product, df = (sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column(c)) for c in ("product", "df"))
    return pa.table({"branch": pa.array([0], pa.int64()), "slab": table.column("slab")[:1], "product": pa.array([product.tobytes()], pa.binary()), "df": pa.array([df.tobytes()], pa.binary()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})


def fit(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(TERMS + 1, RANK) projection of term counts: inverse block frequency, basis and inverse singular values in one; the last row is zero. And the inverse block frequencies."""
    parts = rows.select("doc", "text").mapInArrow(_sketch, SKETCH).groupBy("branch", "slab").applyInArrow(_summed, SKETCH)
    whole = parts.groupBy("slab").applyInArrow(_summed, SKETCH).toArrow().sort_by("slab")
    out = np.zeros((TERMS + 1, RANK), np.float32)
    if not whole.num_rows:
        return out, np.zeros(TERMS, np.float32)
    product = np.concatenate([np.frombuffer(x, np.int64) for x in whole.column("product").to_pylist()]).reshape(TERMS, SKETCH_ROWS).astype(np.float64)
    df = np.concatenate([np.frombuffer(x, np.int64) for x in whole.column("df").to_pylist()])
    idf = np.log((1 + whole.column("n")[0].as_py()) / (1 + df)) ** POWER
    values, u = np.linalg.eigh((product * idf[:, None]).T @ (product * idf[:, None]))
    values, u = values[::-1][:RANK], u[:, ::-1][:, :RANK]
    some = values > max(values[0], 0) * 1e-9
    basis = (product * idf[:, None]) @ (u[:, some] / np.sqrt(values[some]))
    out[:TERMS, : int(some.sum())] = idf[:, None] * basis / np.sqrt(values[some])
    return out, idf.astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def common(a: dict[int, int], m: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item, given as each word's places as bits, and words."""
    v = full = (1 << m) - 1
    for w in words:
        at = a.get(w)
        if at:
            u = v & at
            v = (v + u) | (v - u)
            v &= full
    return m - v.bit_count()


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that have a start and a length, one after another."""
    return np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)


def _parts(x: np.ndarray, weight: np.ndarray):
    """Runs of x of about ``CANDIDATES`` in weight each, so that what is made of one has a bound."""
    cut = np.flatnonzero(np.diff(np.cumsum(weight) // CANDIDATES)) + 1
    return [p for p in np.split(x, cut) if len(p)]


class Items:
    """A block of items: projected, and as word places for the check."""

    def __init__(self, ids: list[int], texts: list[str], projection: np.ndarray, idf: np.ndarray):
        column = pa.array(texts, pa.string())
        self.hashes, first = X.word_hashes(*X.utf8(column))
        term = term_of(self.hashes)
        sums = np.zeros((len(ids), RANK), np.float32)
        np.add.at(sums, np.repeat(np.arange(len(ids)), np.diff(first)), projection[term])
        self.vectors = _unit(sums)
        self.ids = ids
        self.words = [self.hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        self.places = []
        for own in self.words:
            at: dict[int, int] = {}
            for k, w in enumerate(own):
                at[w] = at.get(w, 0) | 1 << k
            self.places.append(at)
        self._bounds(term, first, idf)

    def _bounds(self, term: np.ndarray, first: np.ndarray, idf: np.ndarray) -> None:
        """What step 2 needs: each item's distinct words with their counts in it and in its answer, the least counts, and the items to look for at each word."""
        self.vocabulary, word = np.unique(self.hashes, return_inverse=True)
        m = np.diff(first)
        self.reach = m + m // 2
        self.need = np.where(m < LEAST_WORDS, m, np.ceil(COPY * m)).astype(np.int64)
        self.least = np.where(m < LEAST_WORDS, m, np.ceil(PARAPHRASE * m)).astype(np.int64)
        kinds, counts, answers, anchors = [], [], [], []
        for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            own, n = np.unique(word[a:b], return_counts=True)
            kinds.append(own)
            counts.append(n)
            tail = word[max(a, b - ANSWER) : b] if m[k] >= LEAST_WORDS else word[:0]
            answers.append((own[:, None] == tail).sum(1))
            rarest = a + np.argsort(-idf[term[a:b]], kind="stable")
            at = set(word[rarest[: m[k] - self.need[k] + 1]].tolist())
            if len(tail):
                at.add(int(word[rarest[rarest >= b - ANSWER][0]]))
            anchors += [(w, k) for w in at]
        self.kinds, self.counts, self.answers = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (kinds, counts, answers))
        self.kind_first = np.concatenate([[0], np.cumsum([len(x) for x in kinds], dtype=np.int64)]).astype(np.int64)
        pairs = np.array(sorted(anchors), np.int64).reshape(-1, 2)
        self.anchored = pairs[:, 1]
        self.anchor_first = np.searchsorted(pairs[:, 0], np.arange(len(self.vocabulary) + 1))

    def candidates(self, h: np.ndarray, first: np.ndarray, of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks and items, in order: all that ``match`` can accept, of rows' word hashes, word bounds and block bounds."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.vocabulary):
            return none
        kind = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[kind] == h)
        kind, n = kind[at], len(h) + 1
        keys = np.sort(kind * n + at)
        row = np.searchsorted(first, at, "right") - 1
        block = of_row[row] + (at - first[row]) // STRIDE
        many = self.anchor_first[kind + 1] - self.anchor_first[kind]
        some = np.flatnonzero(many)
        found = []
        for occurrences in _parts(some, many[some]):
            item = self.anchored[_ranges(self.anchor_first[kind[occurrences]], many[occurrences])]
            found.append(np.unique(np.repeat(block[occurrences], many[occurrences]) * len(self.ids) + item))
        if not found:
            return none
        near, item = np.divmod(np.unique(np.concatenate(found)), len(self.ids))
        # First all that the windows with the word can hold, then each window by itself.
        near, item = self._enough(keys, n, first, of_row, near, item, 2 * self.reach + 2 * STRIDE, 2 * self.reach + 3 * STRIDE)
        row = np.searchsorted(of_row, near, "right") - 1
        low = np.maximum(near - 2 - -(-self.reach[item] // STRIDE), of_row[row])
        many = np.minimum(near + 1 + -(-self.reach[item] // STRIDE), of_row[row + 1]) - low
        at = np.unique(_ranges(low, many) * len(self.ids) + np.repeat(item, many))
        return self._enough(keys, n, first, of_row, *np.divmod(at, len(self.ids)), self.reach, 2 * STRIDE + self.reach)

    def _enough(self, keys, n, first, of_row, block, item, before, after):
        """The blocks and items where the words from so many before to so many after a block's start have what the rule asks for."""
        keep = np.zeros(len(block), bool)
        size = self.kind_first[item + 1] - self.kind_first[item]
        for part in _parts(np.arange(len(block)), size):
            b, k, many = block[part], item[part], size[part]
            row = np.searchsorted(of_row, b, "right") - 1
            start = first[row] + (b - of_row[row]) * STRIDE
            low, high = np.maximum(start - before[k], first[row]), np.minimum(start + after[k], first[row + 1])
            word = _ranges(self.kind_first[k], many)
            base = self.kinds[word] * n
            there = np.searchsorted(keys, base + np.repeat(high, many)) - np.searchsorted(keys, base + np.repeat(low, many))
            bounds = np.cumsum(many) - many
            shared = np.add.reduceat(np.minimum(there, self.counts[word]), bounds)
            answer = np.logical_and.reduceat(there >= self.answers[word], bounds)
            keep[part] = (shared >= self.need[k]) | answer & (shared >= self.least[k])
        return block[keep], item[keep]

    def match(self, k: int, words: np.ndarray, at: int) -> tuple[int, bool] | None:
        """Common words and whether the answer is there, if words around a place hold the item."""
        own = self.words[k]
        m = len(own)
        reach = m + m // 2
        around = words[max(0, at - reach) : at + 2 * STRIDE + reach].tolist()
        places = self.places[k]
        if sum(map(places.__contains__, around)) < PARAPHRASE * m:
            return None
        n = common(places, m, around)
        tail = own[-ANSWER:]
        answer = common({w: sum(1 << i for i, x in enumerate(tail) if x == w) for w in tail}, len(tail), around) == len(tail)
        need = m if m < LEAST_WORDS else COPY * m
        return (n, answer) if n >= need or m >= LEAST_WORDS and answer and n >= PARAPHRASE * m else None


def _search(shared):
    @lean
    def search(batches):
        projection, blocks = shared.value
        for b in batches:
            data, bounds = X.utf8(b.column("text"))
            doc, fp = b.column("doc").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)
            for i, j in X.chunks(bounds):
                h, first = X.word_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                if len(h):
                    found = [f for items in blocks for f in _found(items, projection, h, first, doc[i:j], fp[i:j])]
                    yield pa.RecordBatch.from_pylist(found, MATCH_ARROW)

    return search


def _near(items: Items, projection: np.ndarray, term: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The candidates of the latent space, as blocks times items: passages, two neighbouring blocks of a row, whose cosine with an item reaches ``COSINE``."""
    out, step = [np.zeros(0, np.int64)], max(1, CANDIDATES // len(items.ids))
    for a in range(0, len(starts), step):
        b = min(a + step, len(starts))
        sums = _block_sums(projection, term, starts[a : b + 1], ends[a : b + 1])
        two = np.flatnonzero(row[a + 1 : b + 1] == row[a : b + 1][: len(row[a + 1 : b + 1])])
        passages = sums[: b - a].copy()
        passages[two] += sums[two + 1]
        out.append(a * len(items.ids) + np.flatnonzero(_unit(passages) @ items.vectors.T >= COSINE))
    return np.concatenate(out)


def _found(items: Items, projection: np.ndarray, h: np.ndarray, first: np.ndarray, doc: np.ndarray, fp: np.ndarray) -> list[dict]:
    """Items of a block in rows, given as word hashes."""
    starts, of_row = _blocks(first)
    ends = np.append(starts[1:], len(h))
    row = np.repeat(np.arange(len(doc)), np.diff(of_row))
    term = term_of(h)
    at, item = items.candidates(h, first, of_row)
    at, item = np.divmod(np.union1d(_near(items, projection, term, starts, ends, row), at * len(items.ids) + item), len(items.ids))
    best: dict[tuple[int, int], tuple] = {}
    for p, k in zip(at.tolist(), item.tolist(), strict=True):
        r = int(row[p])
        hit = items.match(k, h[first[r] : first[r + 1]], int(starts[p] - first[r]))
        if hit and hit >= best.get((r, k), ((0, False), []))[0]:
            best.setdefault((r, k), (hit, []))
            best[r, k] = (hit, [*best[r, k][1], p] if hit == best[r, k][0] else [p])
    if not best:
        return []
    seen = np.unique(np.array([p for _, places in best.values() for p in places], np.int64))
    passages = _block_sums(projection, term, starts[seen], ends[seen])
    two = np.flatnonzero(seen + 1 < of_row[row[seen] + 1])
    passages[two] += _block_sums(projection, term, starts[seen[two] + 1], ends[seen[two] + 1])
    unit = _unit(passages)
    return [
        {"doc": int(doc[r]), "fp": int(fp[r]), "item_id": items.ids[k], "common_words": n, "item_words": len(items.words[k]), "answer": ok, "cosine": float((unit[np.searchsorted(seen, places)] @ items.vectors[k]).max())}
        for (r, k), ((n, ok), places) in best.items()
    ]


MATCHES = "doc bigint, fp bigint, item_id bigint, common_words bigint, item_words bigint, answer boolean, cosine double"
MATCH_ARROW = pa.schema([("doc", pa.int64()), ("fp", pa.int64()), ("item_id", pa.int64()), ("common_words", pa.int64()), ("item_words", pa.int64()), ("answer", pa.bool_()), ("cosine", pa.float64())])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc, fp, item_id, common_words, item_words, answer, cosine): each item found in each document, once."""
    spark = docs.sparkSession
    batched(spark)
    rows = identified(docs).where("text <> ''")
    wanted = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and trim(text) <> ''").distinct()
    n = -(-wanted.count() // ITEM_BLOCK)
    projection, idf = fit(rows) if n else (None, None)
    out = spark.createDataFrame([], MATCHES)
    for k in range(0, n, BLOCKS_A_PASS):
        own = [wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect() for i in range(k, min(k + BLOCKS_A_PASS, n))]
        shared = spark.sparkContext.broadcast((projection, [Items([r[0] for r in block], [r[1] for r in block], projection, idf) for block in own if block]))
        out = out.unionByName(rows.mapInArrow(_search(shared), MATCHES))
    return out.groupBy("doc", "fp", "item_id").agg(F.max(F.struct("common_words", "item_words", "answer", "cosine")).alias("x")).select("doc", "fp", "item_id", "x.*")


def filtered(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no item."""
    hit = written(matches(docs, benchmark).select(F.col("doc").alias("__doc"), F.col("fp").alias("__fp")).distinct(), "leaks")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(hit, (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(LAST_ID)) == F.col("__doc")) & (F.xxhash64(text) == F.col("__fp")), "left_anti")

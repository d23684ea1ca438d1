"""Best-fit packing of tokenised documents with certified sequence counts.

1. Tokens: ``tokenizers`` gives the ids of each distinct part of the texts once (see ``tokens``); they equal those of the whole text. A closing id follows each document.
2. A document longer than a sequence is cut; all its pieces but the first are full and fill a sequence each.
3. The others are dealt evenly to partitions of at most ``per_task`` pieces, packed by best-fit decreasing. A lower bound from
   dual-feasible functions certifies a partition whose count meets it. The others give up the pieces of their
   emptiest sequences, enough that a sequence could be saved, and these are dealt and packed again, as long as
   a round saves sequences. No task ever holds more than about ``per_task`` pieces. Each piece carries its partition's count and bound.

Contract. A null or empty text is the closing id alone. A text of any length is encoded whole, in tiles; its ids are held by one task. Pieces of equal length are packed
in the order of their numbers. Rows are packed row by row, also those that share a doc_id; a null doc_id
stays null. Other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorfold.llm.frames import batched, lean, written
from tensorfold.llm.tokens import encoder

LENGTH = 1024
END_ID = 2
PER_TASK = 200_000
CHARACTERS = 1 << 22
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces: the first takes what full ones leave."""
    if n <= length:
        return [(0, n)]
    edges = list(range(n % length, n + 1, length))
    edges = edges if edges[0] == 0 else [0, *edges]
    return list(zip(edges[:-1], edges[1:], strict=True))


PIECES = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _batches(texts: list[str]):
    """Ranges of texts with about ``CHARACTERS`` in all; a longer one makes a range of its own."""
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHARACTERS:
            yield first, k
            first, size = k, 0
        size += len(t) + 1
    yield first, len(texts)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece, with a number of its own; on demand also its ids as little-endian 32-bit numbers."""

    @lean
    def cut(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4")
        enc = encoder(path)
        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for i, j in _batches(texts):
                rows = []
                ids, bounds = enc.encode(texts[i:j])
                ids = ids.astype("<u4", copy=False)
                for doc_id, x, y in zip(doc_ids[i:j], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    raw = np.concatenate([ids[x:y], end]).tobytes()
                    for k, (s, e) in enumerate(cuts(len(raw) // 4, length)):
                        own = raw[4 * s : 4 * e]
                        rows.append((uid, doc_id, k, s, e - s, zlib.crc32(own), own if with_ids else None))
                        uid += 1
                if not rows:
                    continue
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:-1], names=names if with_ids else names[:-1])

    batched(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def lower_bound(lengths: np.ndarray, size: int = LENGTH) -> int:
    """No packing needs fewer sequences: the best of dual-feasible functions, from the lengths' counts.

    For each k in 1..size/2: pieces longer than size - k count as whole, those shorter than k as nothing, the others by their length
    (Martello and Toth). For each n in 1..20: x counts as itself where (n + 1) x / size is whole, else as its floor over n (Fekete and Schepers).
    """
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = ceil(int((count * x).sum()) / size)
    total, tokens = np.cumsum(count), np.cumsum(count * x)
    for k in range(1, size // 2 + 1):
        whole = int(total[size] - total[size - k])
        best = max(best, whole + ceil(int(tokens[size - k] - tokens[k - 1]) / size))
    for n in range(1, 21):
        share = np.where((n + 1) * x % size == 0, x * n, (n + 1) * x // size * size)
        best = max(best, ceil(int((count * share).sum()) / (n * size)))
    return best


def best_fit(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's sequence and offset, and the tokens in each sequence."""
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order].tolist()
    open_with: list[list[int]] = [[] for _ in range(size + 1)]  # sequences by free room
    room = 0  # bit r: some sequence has room r
    where, offset, used = [0] * len(sizes), [0] * len(sizes), []
    for k, s in enumerate(sizes):
        fits = room >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            bin_ = open_with[r].pop()
            if not open_with[r]:
                room ^= 1 << r
        else:
            bin_, r = len(used), size
            used.append(0)
        where[k], offset[k] = bin_, used[bin_]
        used[bin_] += s
        r -= s
        open_with[r].append(bin_)
        room |= 1 << r
    out_where, out_offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    out_where[order], out_offset[order] = where, offset
    return out_where, out_offset, np.array(used, np.int64)


def pack_partition(uids: np.ndarray, lengths: np.ndarray, base: int, size: int = LENGTH) -> tuple:
    """Places pieces; tells which lie in sequences that may be packed again, how many sequences there are, and how many there must be."""
    order = np.lexsort((uids, -lengths))
    uids, lengths = uids[order], lengths[order]
    where, offset, used = best_fit(lengths, size)
    bound = lower_bound(lengths, size)
    again = np.zeros(len(used), bool)
    if gap := len(used) - bound:
        emptiest = np.argsort(used, kind="stable")
        free = np.cumsum(size - used[emptiest])
        again[emptiest[: int(np.searchsorted(free, (gap + 1) * size)) + 1]] = True
    return uids, lengths, base + where, offset, again[where], len(used), bound


PLACED = "uid bigint, length bigint, sequence_id bigint, offset bigint, again boolean, bins bigint, bound bigint"
PLACEMENT = ["uid", "sequence_id", "offset", "bins", "bound"]


def placements(items: DataFrame, per_task: int = PER_TASK, size: int = LENGTH) -> DataFrame:
    """(uid, sequence_id, offset, bins, bound) of pieces shorter than a sequence.

    ``bins`` and ``bound`` are the sequences of the partition that placed the piece, and the least that any packing of its pieces needs: equal ones are
    the certificate that this partition can't be packed better.
    """

    def pack(base, step):
        def run(key, table):
            uids, lengths, seq, offset, again, bins, bound = pack_partition(table.column("uid").to_numpy(), table.column("length").to_numpy(), base + key[0].as_py() * step, size)
            return pa.table({"uid": uids, "length": lengths, "sequence_id": seq, "offset": offset, "again": again, "bins": pa.array(np.full(len(uids), bins, np.int64)), "bound": pa.array(np.full(len(uids), bound, np.int64))})

        return run

    done, todo, before, base, round_ = [], items.select("uid", "length"), None, 0, 0
    while count := todo.count():  # every round but the last saves a sequence, so there is a last one
        n = max(1, ceil(count / per_task))
        dealt = todo.withColumn("k", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(n)))
        placed = written(dealt.groupBy("k").applyInArrow(pack(base, count), PLACED), "packed")
        if before is not None and placed.agg(F.countDistinct("sequence_id")).first()[0] >= before[0]:  # nothing saved: what the round before made stands
            done.append(before[1])
            break
        done.append(placed.where("not again"))
        left = placed.where("again")
        if n == 1:
            done.append(left)
            break
        before = (left.agg(F.countDistinct("sequence_id")).first()[0], left)
        # A partition has at most as many sequences as there are pieces, so numbers of partitions and rounds don't meet.
        todo, base, round_ = left.select("uid", "length"), base + n * count, round_ + 1
    if not done:
        return items.select("uid", *[F.lit(0).cast("bigint").alias(c) for c in PLACEMENT[1:]]).where("false")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*PLACEMENT)


def _placed(cut: DataFrame, per_task: int) -> DataFrame:
    one = F.lit(1).cast("bigint")
    full = cut.where(F.col("length") == LENGTH).select("*", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), one.alias("bins"), one.alias("bound"))
    rest = cut.where(F.col("length") < LENGTH)
    return full.unionByName(rest.join(placements(rest, per_task), "uid"))


def packed(docs: DataFrame, path: str | None = None, per_task: int = PER_TASK) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound) of every piece."""
    return _placed(written(pieces(docs, path or vocabulary_path()), "pieces"), per_task).drop("uid")


def sequences(docs: DataFrame, path: str | None = None, per_task: int = PER_TASK) -> DataFrame:
    """(sequence_id, n_tokens, ids array<int>): what a trainer reads. A sequence has at most 1024 tokens, so its group is small."""
    own = _placed(written(pieces(docs, path or vocabulary_path(), with_ids=True), "pieces"), per_task).select("sequence_id", "offset", "ids")

    def join(table):
        ids = np.frombuffer(b"".join(table.sort_by("offset").column("ids").to_pylist()), "<u4")
        return pa.table({"sequence_id": table.column("sequence_id")[:1], "n_tokens": [len(ids)], "ids": pa.array([ids.astype("i4")], pa.list_(pa.int32()))})

    return own.groupBy("sequence_id").applyInArrow(join, "sequence_id bigint, n_tokens bigint, ids array<int>")

"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Counts come from whole texts. Each rule is a share in 0..1 above which a text is rejected. On labelled rows (the holdout: no rule was
fitted to them) and for each stratum of text lengths, cutoffs are tried from the most lenient to stricter ones as long as the false
rejections of good rows are bounded: the exact (Clopper-Pearson) upper limit, at an error level divided by rules and strata (Bonferroni),
stays within ``LIMIT`` divided by rules. Trying in a fixed order and stopping at the first failure needs no further correction, so any
cutoff that passed may be taken; a rule takes the one that catches most bad rows, each good one lost weighing as ``COST``. So with probability 1 - ``LEVEL`` all strata lose at most ``LIMIT`` of their good rows to the rules, and a stratum with too few
labels has no cutoff. Only histograms of labelled rows by stratum, rule and share reaches the driver.

Contract. A null text has no words; it fails the base rule. Texts of any length are counted whole. Of cutoffs that catch as many, the most lenient is taken. Labels count once for each doc_id (0 if they differ); a null doc_id
has none. Rows alike get the same verdict. Other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorfold.llm import text as X
from tensorfold.llm.frames import batched, written

LEAST_WORDS, MOST_REPEATED = 50, 50
LIMIT, LEVEL = 0.05, 0.05
COST = 10
BINS = 200
STRATA = (150, 400, 1200)  # words, upper ends; the last stratum is open
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbols", "capitals", "repeats", "dup_lines", "bare_marks")


def _cover(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether another place of the same row has the same value."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    same = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(v), bool)
    out[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return out


def count_texts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text in a buffer."""
    n = len(bounds) - 1

    def per_row(flags):
        out, filled = np.zeros(n, np.int64), bounds[:-1] < bounds[1:]
        if filled.any():
            out[filled] = np.add.reduceat(flags, bounds[:-1][filled], dtype=np.int64)
        return out

    starts, ends, first = X.words(data, bounds)
    hashes, words = X.hashes_of(data, starts, ends), np.diff(first)
    row = np.repeat(np.arange(n), words)
    out = {"n_words": words, "word_chars": per_row(~X.IS_SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_row(SYMBOLS[data])}
    repeated = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        inside = row[2:] == row[:-2]
        window = X.mix((hashes[:-2] * X.BASE + hashes[1:-1]) * X.BASE + hashes[2:])[inside]
        at = np.flatnonzero(inside)[_cover(window, row[:-2][inside])]
        for k in range(3):
            repeated[at + k] = True
    out["n_repeat_words"] = np.bincount(row[repeated], minlength=n)
    # Lines: a word's line is known by the newlines before it.
    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([bounds[:-1][bounds[:-1] < bounds[1:]], cut + 1]))
    begin = begin[begin < len(data)]
    line_row = np.searchsorted(bounds, begin, "right") - 1
    nl = np.concatenate([cut, [len(data)]])
    end = np.minimum(nl[np.searchsorted(cut, begin)], bounds[line_row + 1])
    filled = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    line, line_row = X.hashes_of(data, begin[filled], end[filled]), line_row[filled]
    order = np.lexsort((line, line_row))
    again = (line[order][1:] == line[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    out["n_dup_lines"] = np.bincount(line_row[order][1:][again], minlength=n)
    lines = np.bincount(line_row, minlength=n)
    capitals, letters = per_row((data >= 65) & (data <= 90)), per_row(((data | 32) >= 97) & ((data | 32) <= 122))
    marks = ~((data >= 48) & (data <= 57) | ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128) | X.IS_SPACE[data])
    heard = np.concatenate([np.zeros(1, np.uint32), np.cumsum(~marks & ~X.IS_SPACE[data], dtype=np.uint32)])
    bare = np.bincount(row[heard[ends] == heard[starts]], minlength=n)
    share = lambda a, b: np.clip(a / np.maximum(b, 1), 0, 1)
    out |= {"symbols": share(out["n_symbols"], out["word_chars"]), "capitals": share(capitals, letters), "repeats": share(out["n_repeat_words"], words), "dup_lines": share(out["n_dup_lines"], lines), "bare_marks": share(bare, words)}
    return out


def _count(batches):
    for b in batches:
        data, bounds = X.utf8(b.column("text"))
        for i, j in X.chunks(bounds):
            c = count_texts(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *(pa.array(c[k].astype(np.int64)) for k in COUNTS), *(pa.array(c[k].astype(np.float64)) for k in RULES)], names=["doc_id", *COUNTS, *RULES])


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    tiny = 1e-300
    front = exp(a * log(x) + b * log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def at_most(k: int, n: int, p: float) -> float:
    """The probability of at most k of n with a share of p."""
    return 1.0 if k >= n else beta_share(1 - p, n - k, k + 1)


def upper_limit(k: int, n: int, level: float) -> float:
    """The exact upper limit of a share of which k of n were seen: with a larger share, so few come with probability below the level."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(k, n, mid) > level else (low, mid)
    return high


def cutoffs(good: dict[tuple[int, str], np.ndarray], bad: dict[tuple[int, str], np.ndarray], limit: float = LIMIT, level: float = LEVEL) -> dict[tuple[int, str], int]:
    """Of labelled rows by stratum, rule and bin: the least bin from which rows are rejected; BINS + 1 rejects none."""
    tests = (len(STRATA) + 1) * len(RULES)
    out = {}
    for key, counts in good.items():
        n, lost, caught, best, cut = int(counts.sum()), 0, 0, 0, BINS + 1
        for b in range(BINS, 0, -1):
            lost += int(counts[b])
            caught += int(bad[key][b]) if key in bad else 0
            if at_most(lost, n, limit / len(RULES)) > level / tests:  # the upper limit exceeds what a rule may lose
                break
            if caught - COST * lost > best:
                best, cut = caught - COST * lost, b
        out[key] = cut
    return out


def _bin(rule: str):
    return F.ceil(F.col(rule) * BINS).cast("int")


def _stratum():
    return sum((F.when(F.col("n_words") > top, 1).otherwise(0) for top in STRATA), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, rule) of each row; ``rule`` names the first rule that rejected it."""
    batched(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = written(rows.mapInArrow(_count, "doc_id bigint, " + ", ".join([*(f"{c} bigint" for c in COUNTS), *(f"{r} double" for r in RULES)])), "counts")
    counted = counted.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).withColumn("stratum", _stratum())
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    held = counted.where("not base_failed").join(known, "doc_id").select("quality", "stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _bin(r).alias("bin")) for r in RULES])).alias("x"))
    histograms: dict[int, dict] = {0: {}, 1: {}}
    for r in held.where("quality in (0, 1)").groupBy("quality", "stratum", "x.rule", "x.bin").count().collect():
        histograms[r["quality"]].setdefault((r["stratum"], r["rule"]), np.zeros(BINS + 1, np.int64))[r["bin"]] += r["count"]
    cut = cutoffs(histograms[1], histograms[0])
    verdicts = [F.when((F.col("stratum") == s) & (_bin(r) >= c), F.lit(r)) for (s, r), c in sorted(cut.items()) if c <= BINS]
    rule = F.coalesce(F.when(F.col("base_failed"), F.lit("base")), *verdicts, F.lit(None).cast("string"))
    return counted.withColumn("rule", rule).select("doc_id", *COUNTS, "base_failed", F.col("rule").isNull().alias("kept"), "rule")

"""Language of documents: Bayesian fusion of text likelihoods, declared markup language, address suffix and host priors.

Text: byte trigrams (ASCII lower-cased) hashed to ``BUCKETS``; their counts by language come from all rows that declare one of the
``languages``, by grouped aggregation. Each language's rates are mixed with ``SHARED`` of the rates of all languages, so a trigram that one
has not shown yet speaks against it with bounded weight only. One more class, ``und``, has all trigrams alike. As trigrams
overlap, ``OVERLAP`` of them count as one, and a text as ``TEXT_WEIGHT`` of these at most.
Declared markup language (of an html element in the text), address suffix: each multiplies the odds of its language by a fixed factor.
Host: prior counts by host are smoothed towards those of its domain, these towards those of all rows (Dirichlet weights
``SMOOTHING``), where a row counts with its posterior from the other evidence, in billionths, so that sums don't depend on their order.

Rejected (kept false): rows whose best class is ``und``, or whose posterior is below ``least``.

Contract. A null or empty text has no trigrams and is rejected as ``und`` with what evidence remains; a null host, declaration or
suffix is no evidence. Of classes with equal posteriors the first in the list wins. Texts of any length are
read whole. Rows alike get the same answer. Other columns pass through ``filtered``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorfold.llm import text as X
from tensorfold.llm.frames import LAST_ID, batched, identified, joined_left, lean, written

LANGUAGES = ("de", "en", "es", "fr")
UND = "und"
BUCKETS = 1 << 14
TEXT_WEIGHT, OVERLAP = 60.0, 3.0
SHARED, UNSEEN = 0.2, 0.05
COUNTED = 1_000_000_000
BROADCAST_HOSTS = 1 << 16
SMOOTHING = {"host": 20.0, "domain": 50.0, "all": 4.0}
DECLARED_ODDS = 20.0
SUFFIX_ODDS = 5.0
UND_PRIOR = 0.01
LEAST = 0.6
# Address suffixes of one language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram that lies in one row, and its row."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = X.LOWER[data].astype(np.uint32)
    code = low[:-2] | (low[1:-1] << np.uint32(8)) | (low[2:] << np.uint32(16))
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ok = row[:-2] == row[2:]
    return code[ok].astype(np.int64), row[:-2][ok]


def trigram_tiles(data: np.ndarray, bounds: np.ndarray):
    """The same for a buffer of any length, a tile at a time."""
    for a in range(0, max(len(data) - 2, 0), X.CHUNK_BYTES):
        part = data[a : a + X.CHUNK_BYTES + 2]
        yield trigrams(part, np.clip(bounds - a, 0, len(part)))


def fit(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, text: str = "text", declared: str = "lang") -> np.ndarray:
    """(languages + 1, BUCKETS) log-likelihoods. The tasks' counts have at most languages x buckets rows each, summed map-side."""
    batched(docs.sparkSession)

    @lean
    def count(batches):
        own = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            data, bounds = X.utf8(b.column(0))
            lang = np.array([languages.index(x) for x in b.column(1).to_pylist()], np.int64)
            for i, j in X.chunks(bounds):
                for code, row in trigram_tiles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]):
                    own += np.bincount(lang[i + row] * BUCKETS + code, minlength=own.size).reshape(own.shape)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.reshape(-1)[at])], names=["cell", "n"])

    known = docs.select(F.col(text).cast("string").alias("t"), F.col(declared).alias("l")).where(F.col("l").isin(*languages) & F.col("t").isNotNull())
    found = known.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(len(languages) * BUCKETS)
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    table = table.reshape(len(languages), BUCKETS) + UNSEEN
    table /= table.sum(axis=1, keepdims=True)
    table = np.log((1 - SHARED) * table + SHARED * table.mean(axis=0))
    return np.vstack([table, np.full(BUCKETS, -np.log(BUCKETS))]).astype(np.float32)


def text_scores(rows: DataFrame, table: np.ndarray, keep: list[str]) -> DataFrame:
    """Adds ``loglik`` (one number a class, tempered) to the kept columns and drops the text."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @lean
    def score(batches):
        t = shared.value
        for b in batches:
            data, bounds = X.utf8(b.column("text"))
            out = np.zeros((b.num_rows, len(t)))
            for i, j in X.chunks(bounds):
                n = np.zeros(j - i, np.int64)
                for code, row in trigram_tiles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]):
                    n += np.bincount(row, minlength=j - i)
                    for c in range(len(t)):
                        out[i:j, c] += np.bincount(row, weights=t[c][code], minlength=j - i)
                out[i:j] *= np.minimum(1 / OVERLAP, TEXT_WEIGHT / np.maximum(n, 1))[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(t), dtype=np.int32)), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], names=[*keep, "loglik"])

    kinds = dict(rows.dtypes)
    return rows.select("text", *keep).mapInArrow(score, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "loglik array<double>"]))


def _softmax(x: Column) -> Column:
    exp = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(exp, lambda v: v / F.aggregate(exp, F.lit(0.0), lambda a, y: a + y))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def fused(scored: DataFrame, languages: tuple[str, ...] = LANGUAGES, least: float = LEAST) -> DataFrame:
    """Of (.., host, domain, declared, suffix, loglik): adds lang, confidence and kept.

    Host and domain counts are sums by host with map-side combining; their table joins back by host (see ``joined_left``).
    """
    k = len(languages)
    evidence = F.col("loglik")
    for column, odds in (("declared", DECLARED_ODDS), ("suffix", SUFFIX_ODDS)):
        evidence = _plus(evidence, F.array(*[F.when(F.col(column) == c, np.log(odds)).otherwise(0.0) for c in (*languages, UND)]))
    flat = [np.log((1 - UND_PRIOR) / k)] * k + [np.log(UND_PRIOR)]
    rows = written(scored.withColumn("evidence", evidence).withColumn("p", _softmax(_plus(F.col("evidence"), F.array(*map(F.lit, map(float, flat)))))), "evidence")
    sums = [F.sum(F.round(F.element_at("p", c + 1) * COUNTED).cast("bigint")).alias(f"s{c}") for c in range(k)]
    every = [(x or 0) / COUNTED for x in rows.agg(*sums).first()]
    base = [(x + SMOOTHING["all"] / k) / (sum(every) + SMOOTHING["all"]) for x in every]

    def prior(counts: list[Column], above: list, weight: float) -> list[Column]:
        n = sum(counts[1:], counts[0])
        return [(c + weight * a) / (n + weight) for c, a in zip(counts, above, strict=True)]

    hosts = rows.where("host is not null").groupBy("host").agg(F.min("domain").alias("domain"), *sums)
    domains = hosts.groupBy("domain").agg(*[F.sum(f"s{c}").alias(f"d{c}") for c in range(k)])
    hosts = hosts.join(domains, "domain", "left")
    by_domain = prior([F.coalesce(f"d{c}", F.lit(0)) / COUNTED for c in range(k)], base, SMOOTHING["domain"])
    by_host = prior([F.col(f"s{c}") / COUNTED for c in range(k)], by_domain, SMOOTHING["host"])
    hosts = written(hosts.select("host", F.array(*by_host).alias("prior")), "hosts")
    rows = joined_left(rows, hosts, "host", hosts.count(), BROADCAST_HOSTS, "loglik")
    own = F.coalesce("prior", F.array(*[F.lit(float(b)) for b in base]))
    logs = F.concat(F.transform(own, lambda x: F.log(x * (1 - UND_PRIOR))), F.array(F.lit(float(np.log(UND_PRIOR)))))
    rows = rows.withColumn("posterior", _softmax(_plus(F.col("evidence"), logs))).withColumn("confidence", F.array_max("posterior"))
    rows = rows.withColumn("lang", F.element_at(F.array(*map(F.lit, (*languages, UND))), F.array_position("posterior", F.col("confidence")).cast("int")))
    return rows.withColumn("kept", (F.col("lang") != UND) & (F.col("confidence") >= least) & F.exists("loglik", lambda x: x != 0)).drop("evidence", "p", "loglik", "prior", "posterior")


def _address(host: Column) -> list[Column]:
    """A host with its domain and the language of its suffix."""
    host = F.nullif(F.lower(host), F.lit(""))
    domain = F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))
    suffix = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.regexp_extract(host, r"\.([a-z]+)$", 1))
    return [host.alias("host"), domain.alias("domain"), suffix.alias("suffix")]


def _declared(markup: Column) -> Column:
    """The two letters that a text's first html element with a lang declares; no angle bracket is passed, so time is in proportion to the text."""
    return F.lower(F.substring(F.regexp_extract(markup, r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]+)", 1), 1, 2)).alias("declared")


def identify_documents(docs: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """(doc, fp, lang, confidence, kept) of each row of documents. The source stands for the host; where it is an address, its domain and suffix count, and where
    a text has an html element, its declaration. The lang column is what the text model learns from, and no evidence."""
    table = fit(docs) if table is None else table
    rows = identified(docs, *_address(F.col("source").cast("string")), _declared(F.col("text").cast("string")))
    return fused(text_scores(rows, table, ["doc", "fp", "host", "domain", "declared", "suffix"])).select("doc", "fp", "lang", "confidence", "kept")


# Each alternative takes what it begins with up to its end or the text's, so no text is read twice.
_TAGS = re.compile(r"<(script|style)\b.*?(?:</\1\s*+>|\Z)|<[/!?a-zA-Z][^>]*+(?:>|\Z)", re.S | re.I)


def plain_text(html: str | None) -> str:
    """The text of markup without tags, scripts and styles, with character references decoded."""
    return unescape(_TAGS.sub(" ", html or ""))


def identify_pages(pages: DataFrame, table: np.ndarray) -> DataFrame:
    """(page_id, lang, confidence, kept) of each page, from its text, its html element's lang, its host and the host's suffix."""

    @F.pandas_udf("string")
    def plain(html):
        return html.map(plain_text, na_action=None)

    batched(pages.sparkSession)
    host = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", plain(html).alias("text"), *_address(host), _declared(html))
    return fused(text_scores(rows, table, ["page_id", "host", "domain", "declared", "suffix"])).select("page_id", "lang", "confidence", "kept")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of documents whose language is recognised."""
    kept = identify_documents(docs).where("kept").select(F.col("doc").alias("__doc"), F.col("fp").alias("__fp")).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(kept, (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(LAST_ID)) == F.col("__doc")) & (F.xxhash64(text) == F.col("__fp")), "left_semi")

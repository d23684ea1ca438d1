"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorfold.llm import chat, decontaminate, html, language, minhash, packing, quality, rules, sharding, suffix_dedup
from tensorfold.llm.frames import original_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_dedup(spark, d):
    return minhash.groups(table(spark, d, "documents"))


@query
def op2_best_fit_packing(spark, d):
    return packing.packed(table(spark, d, "documents"))


@query
def op4_language_id(spark, d):
    found = language.identify_documents(table(spark, d, "documents"))
    return found.select(original_id(F.col("doc")).alias("doc_id"), "lang", "confidence", "kept")


@query
def op5_decontamination(spark, d):
    found = decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(original_id(F.col("doc")).alias("doc_id"), "item_id", "common_words", "item_words", "answer", "cosine")


@query
def op10_suffix_dedup(spark, d):
    return suffix_dedup.digests(table(spark, d, "documents"))


@query
def op3_quality(spark, d):
    return quality.scored(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op6_sharding(spark, d):
    return sharding.sharded(table(spark, d, "documents"))


@query
def op7_chat_format(spark, d):
    return chat.rendered(table(spark, d, "conversations"))


SQL["op7_chat_format"] = """
WITH t AS (SELECT *, CASE WHEN conv_id IS NULL THEN struct_pack(t := turn, r := role, x := text) END AS lone FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
c AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role, text) AS l, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered FROM t GROUP BY conv_id, lone),
m AS (SELECT min(conv_id) AS conv_id, l, any_value(rendered) AS rendered, len(l) AS n FROM c GROUP BY l),
p AS (SELECT DISTINCT list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM m))
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, rendered FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = m.l)"""


@query
def op8_quality_rules(spark, d):
    return rules.judged(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op9_html_extraction(spark, d):
    return html.extracted(table(spark, d, "pages"))


@query
def pages_language(spark, d):
    return language.identify_pages(table(spark, d, "pages"), language.fit(table(spark, d, "documents")))

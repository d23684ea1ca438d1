"""The engine's operators applied to the driver's tables, and the same results as DuckDB SQL."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorfold.functions import dtypes as D
from tensorfold.operators import catalog as C
from tensorfold.operators import exchange as X
from tensorfold.operators import tensors as T
from tensorfold.operators.indexing import numbered, running
from tensorfold.plans import placement as P
from tensorfold.plans.session import Tensors, open_tensors
from tensorfold.plans.workspace import local_folder
from tensorfold.sources import archive as A
from tensorfold.streaming import pipeline as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VEC = 64


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("nb"))


def archived(spark: SparkSession, d: str, what: str, build: Callable[[str], None]) -> str:
    """The folder of archives made of the tables in ``d``, written once a session."""
    path = local_folder(spark, f"archives-{spark.sparkContext.applicationId}-{zlib.crc32(d.encode()):08x}/{what}")
    if not os.path.exists(f"{path}/done"):
        build(path)
        open(f"{path}/done", "w").close()
    return path


def _embeddings(spark, d, world: int = 1) -> Tensors:
    """The embeddings as one [n, 64] tensor."""

    def build(path):
        e = table(spark, d, "embeddings").select("vec_id", "embedding")
        n = e.count()
        A.write_archive(T.pack_vectors(running(e, "vec_id", 1, "i"), "embeddings", "i", "embedding", VEC, n), path, mode="overwrite", layout=[("embeddings", "F32", [n, VEC])])

    return open_tensors(spark, archived(spark, d, "embeddings", build), world)


def _vectors(spark, d) -> Tensors:
    """Each embedding as a tensor of its own."""

    def build(path):
        A.write_archive(T.pack_each(table(spark, d, "embeddings"), F.concat(F.lit("vec."), "vec_id"), "embedding", "F32"), path, 4, mode="overwrite")

    return open_tensors(spark, archived(spark, d, "vectors", build))


def _lineitem(spark, d) -> Tensors:
    """The numeric columns of lineitem as [n] tensors, in the order of the table's rows."""

    def build(path):
        rows, n = numbered(table(spark, d, "lineitem").select(*[c for c, _, _ in COLUMNS]), "__at")
        A.write_archive(T.pack_columns(rows, "__at", [(c, k) for c, k, _ in COLUMNS], n), path, 2, mode="overwrite", layout=[(c, k, [n]) for c, k, _ in COLUMNS])

    return open_tensors(spark, archived(spark, d, "lineitem", build))


def _regions(spark, d) -> str:
    """A folder with an archive for each region: its nations' names as tensors of bytes, its own name as metadata."""

    def build(path):
        for r in table(spark, d, "region").collect():
            own = table(spark, d, "nation").where(F.col("n_regionkey") == r["r_regionkey"])
            A.write_archive(T.pack_each(own, F.concat(F.lit("nation."), "n_nationkey"), "n_name", "U8"), f"{path}/region-{r['r_regionkey']}", 1, {"region": r["r_name"]}, "overwrite")

    return archived(spark, d, "regions", build)


# The numeric columns of lineitem as tensors.
COLUMNS = [("l_orderkey", "I64", 8), ("l_partkey", "I64", 8), ("l_suppkey", "I64", 8), ("l_linenumber", "I32", 4), ("l_quantity", "F64", 8), ("l_extendedprice", "F64", 8), ("l_discount", "F64", 8), ("l_tax", "F64", 8)]
COLUMN_ROWS = ",".join(f"({k},'{n}','{t}',{w})" for k, (n, t, w) in enumerate(COLUMNS))


@query(f"""WITH n AS (SELECT count(*) AS c FROM lineitem), t(ord,name,dtype,size) AS (VALUES {COLUMN_ROWS})
SELECT name, dtype, c AS nelem, CAST(c*size AS BIGINT) AS nbytes, CAST(sum(c*size) OVER (ORDER BY ord) - c*size AS BIGINT) AS off_start, CAST(sum(c*size) OVER (ORDER BY ord) AS BIGINT) AS off_end FROM t, n""")
def q_catalog(spark, d):
    cols = spark.createDataFrame([(k, *c, "lineitem") for k, c in enumerate(COLUMNS)], "ord int, name string, dtype string, size int, path string")
    count = table(spark, d, "lineitem").agg(F.count("*").alias("nelem"), F.lit("lineitem").alias("path"))
    placed = C.layout(cols.join(F.broadcast(count), "path").withColumn("nbytes", F.col("nelem") * F.col("size")))
    return placed.select("name", "dtype", "nelem", "nbytes", "off_start", "off_end")


@query("SELECT 'vec.' || vec_id AS name, generate_subscripts(embedding,1)-1 AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings WHERE vec_id = 7")
def q_get_tensor(spark, d):
    return _vectors(spark, d).tensor("vec.7").select("name", "pos", "value")


@query("SELECT 'embeddings' AS name, count(*) AS dim0, max(len(embedding)) AS dim1, CAST(count(*)*max(len(embedding))*4 AS BIGINT) AS nbytes FROM embeddings")
def q_get_shape(spark, d):
    shape = _embeddings(spark, d).shape("embeddings")
    return spark.createDataFrame([("embeddings", *shape, D.nbytes("F32", shape))], "name string, dim0 bigint, dim1 bigint, nbytes bigint")


@query("SELECT vec_id, (vec_id-10)//7 AS out_row, embedding[1]::DOUBLE AS first_val FROM embeddings WHERE vec_id >= 10 AND vec_id < 200 AND (vec_id-10) % 7 = 0")
def q_slice_rows(spark, d):
    return T.slice_rows(table(spark, d, "embeddings"), "vec_id", 10, 200, 7, 1 << 62).select("vec_id", "out_row", F.element_at("embedding", 1).cast("double").alias("first_val"))


@query("SELECT vec_id, (d-4)//8 AS out_col, v::DOUBLE AS value FROM (SELECT vec_id, generate_subscripts(embedding,1)-1 AS d, unnest(embedding) AS v FROM embeddings) WHERE d >= 4 AND d < 60 AND (d-4) % 8 = 0")
def q_slice_cols(spark, d):
    kept = table(spark, d, "embeddings").select("vec_id", F.explode(T.slice_vector(F.col("embedding"), 4, 60, 8)).alias("z"))
    return kept.select("vec_id", F.expr("(z.d - 4) div 8").alias("out_col"), F.col("z.value").cast("double").alias("value"))


@query("SELECT n - 1 - vec_id AS out_row, vec_id, embedding[len(embedding)]::DOUBLE AS last_val FROM embeddings, (SELECT count(*) AS n FROM embeddings)")
def q_slice_negative(spark, d):
    e = table(spark, d, "embeddings")
    return T.slice_rows(e, "vec_id", None, None, -1, e.count()).select("out_row", "vec_id", F.element_at("embedding", -1).cast("double").alias("last_val"))


@query("SELECT vec_id // ((n+3)//4) AS rank, count(*) AS nrows, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings, (SELECT count(*) AS n FROM embeddings) GROUP BY 1")
def q_shard_dim0(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    return X.shard(e, F.col("vec_id"), e.count(), 4).groupBy("rank").agg(F.count("*").alias("nrows"), F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"))


@query("SELECT d // ((64+5)//6) AS rank, count(*) AS nelem, min(d) AS lo, max(d) AS hi, CAST(sum(CAST(v AS DECIMAL(38,12))) AS DOUBLE) AS total FROM (SELECT generate_subscripts(embedding,1)-1 AS d, unnest(embedding) AS v FROM embeddings) GROUP BY 1")
def q_shard_dim1(spark, d):
    e = T.explode_vector(table(spark, d, "embeddings").select("embedding"), "embedding", "d", "v")
    total = F.sum(F.col("v").cast("decimal(38,12)")).cast("double").alias("total")
    return X.shard(e, F.col("d"), VEC, 6).groupBy("rank").agg(F.count("*").alias("nelem"), F.min("d").alias("lo"), F.max("d").alias("hi"), total)


@query("SELECT r.rank, count(x.r_regionkey) AS nelem FROM (SELECT unnest(range(4)) AS rank) r LEFT JOIN region x ON x.r_regionkey // 2 = r.rank GROUP BY 1")
def q_shard_uneven(spark, d):
    r = table(spark, d, "region")
    return X.per_rank(X.shard(r, F.col("r_regionkey"), r.count(), 4), 4, F.count("*").alias("nelem"), fill={"nelem": 0})


@query("SELECT r.rank, e.vec_id, e.embedding[1]::DOUBLE AS first_val FROM (SELECT unnest(range(4)) AS rank) r, embeddings e")
def q_broadcast(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("first_val"))
    return X.broadcast(e, 4).select("rank", "vec_id", "first_val")


@query("SELECT r.rank, count(e.vec_id) AS ntensors FROM (SELECT unnest(range(4)) AS rank) r LEFT JOIN embeddings e ON e.vec_id % 4 = r.rank GROUP BY 1")
def q_push(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    return X.per_rank(X.push(e, F.col("vec_id") % 4, 4), 4, F.count("*").alias("ntensors"), fill={"ntensors": 0})


def _from_zero(df: DataFrame, key: str, value: str):
    """(i, value) with i the key less its smallest, and the count of rows."""
    low, n = df.agg(F.min(key), F.count("*")).first()
    return df.select((F.col(key) - (low or 0)).alias("i"), F.col(value).alias("value")), n


@query("""WITH a AS (SELECT 0 AS t, s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS i, s_acctbal AS v, (SELECT count(*) FROM supplier) AS n FROM supplier),
b AS (SELECT 1 AS t, c_custkey - (SELECT min(c_custkey) FROM customer) AS i, c_acctbal AS v, (SELECT count(*) FROM customer) AS n FROM customer),
s AS (SELECT t, i // ((n+3)//4) AS rank, i, v FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY t, i) - 1 AS pos, v AS value FROM s""")
def q_multi_cols(spark, d):
    parts = [_from_zero(table(spark, d, "supplier"), "s_suppkey", "s_acctbal"), _from_zero(table(spark, d, "customer"), "c_custkey", "c_acctbal")]
    return X.multi_cols(parts, 4).select("rank", "pos", "value")


@query("SELECT row_number() OVER (ORDER BY t, k) - 1 AS pos, v AS value FROM (SELECT 0 AS t, s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT 1, c_custkey, c_acctbal FROM customer)")
def q_concat(spark, d):
    (a, n), (b, _) = _from_zero(table(spark, d, "supplier"), "s_suppkey", "s_acctbal"), _from_zero(table(spark, d, "customer"), "c_custkey", "c_acctbal")
    return X.concat([a, b]).select((F.col("part") * n + F.col("i")).alias("pos"), "value")


@query("""WITH n AS (SELECT count(*) AS c FROM orders), o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey, o_custkey FROM orders)
SELECT 'o_orderkey' AS name, i // ((c+1)//2) AS rank, count(*) AS nelem, CAST(sum(o_orderkey) AS BIGINT) AS total FROM o, n GROUP BY 2
UNION ALL SELECT 'o_custkey', r.rank, count(*), CAST(sum(o_custkey) AS BIGINT) FROM o, (SELECT unnest(range(2)) AS rank) r GROUP BY 2""")
def q_as_dict(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    sharded = X.shard(running(o, "o_orderkey", 1, "i"), F.col("i"), o.count(), 2)
    first = sharded.groupBy("rank").agg(F.count("*").alias("nelem"), F.sum("o_orderkey").alias("total")).select(F.lit("o_orderkey").alias("name"), "rank", "nelem", "total")
    whole = X.broadcast(o.agg(F.count("*").alias("nelem"), F.sum("o_custkey").alias("total")), 2)
    return first.unionByName(whole.select(F.lit("o_custkey").alias("name"), "rank", "nelem", "total"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS rank, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS ordinal FROM documents")
def q_round_robin(spark, d):
    return P.place(table(spark, d, "documents").select("doc_id"), "doc_id", 4).select("doc_id", "rank", "ordinal")


@query("SELECT doc_id % 4 AS rank, count(*) AS nfiles, CAST(sum(octet_length(encode(text))) AS BIGINT) AS nbytes, max(octet_length(encode(text))) AS max_file FROM documents GROUP BY 1")
def q_rank_bytes(spark, d):
    return P.rank_totals(X.push(_documents(spark, d), F.col("doc_id") % 4, 4), "nb", 4)


@query("SELECT b AS batch, count(*) AS nfiles, min(i) AS first_file, max(i) AS last_file FROM (SELECT i, i // 3 AS b FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)) GROUP BY 1")
def q_batches(spark, d):
    placed = P.place(table(spark, d, "documents").select("doc_id"), "doc_id", 3)
    return placed.groupBy(F.col("ordinal").alias("batch")).agg(F.count("*").alias("nfiles"), F.min("i").alias("first_file"), F.max("i").alias("last_file"))


@query("SELECT doc_id, k AS block, k*4096 AS off, least(4096, nb - k*4096) AS len FROM (SELECT doc_id, octet_length(encode(text)) AS nb, unnest(range((octet_length(encode(text)) + 4095)//4096)) AS k FROM documents)")
def q_block_split(spark, d):
    return _documents(spark, d).select("doc_id", F.inline(P.block_ranges(F.col("nb"), 4096)))


@query("SELECT doc_id, off % 4096 AS head, (4096 - (len + off % 4096) % 4096) % 4096 AS tail, len + off % 4096 + (4096 - (len + off % 4096) % 4096) % 4096 AS aligned_len, off % 16 = 0 AS aligned FROM (SELECT doc_id, 8 + doc_id AS off, octet_length(encode(text)) AS len FROM documents)")
def q_alignment(spark, d):
    off = F.col("doc_id") + 8
    return _documents(spark, d).withColumns(P.aligned_window(off, F.col("nb"))).withColumn("aligned", off % 16 == 0).drop("nb")


@query("""WITH t AS (SELECT doc_id, octet_length(encode(text)) AS nb FROM documents), o AS (SELECT doc_id, sum(nb) OVER (ORDER BY doc_id) - nb AS s, sum(nb) OVER (ORDER BY doc_id) AS e FROM t)
SELECT count(*) AS ntensors, CAST(max(e) AS BIGINT) AS total, count(*) FILTER (WHERE s <> p) AS gaps FROM (SELECT s, e, coalesce(lag(e) OVER (ORDER BY s, e), 0) AS p FROM o)""")
def q_offsets_valid(spark, d):
    # A layout without gaps or overlaps is one where starts and ends, but for the first start and the last end, pair off.
    o = running(_documents(spark, d), "doc_id", F.col("nb"), "s").select("s", (F.col("s") + F.col("nb")).alias("e"))
    edges = o.select(F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("w")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("w")))).alias("x")).groupBy("x.at").agg(F.sum("x.w").alias("w"))
    ends = o.agg(F.count("*").alias("ntensors"), F.max("e").alias("total"))
    odd = edges.join(F.broadcast(ends), F.lit(True), "inner").where((F.col("at") != 0) & (F.col("at") != F.col("total")) & (F.col("w") != 0))
    return ends.join(F.broadcast(odd.agg(F.count("*").alias("gaps"))), F.lit(True), "inner")


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def q_unique_names(spark, d):
    return C.duplicate_names(table(spark, d, "part"), "p_name")


# The rules of the key-to-dimension query.
RULES = [("ECONOMY", -1), ("S(T|M)A", 0), ("(PROMO|SMALL)", 1)]


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type,'^ECONOMY') THEN -1 WHEN regexp_matches(p_type,'^S(T|M)A') THEN 0 WHEN regexp_matches(p_type,'^(PROMO|SMALL)') THEN 1 ELSE -1 END AS dim FROM part")
def q_key_dim(spark, d):
    return table(spark, d, "part").select("p_partkey", C.dim_rule(F.col("p_type"), RULES).alias("dim"))


@query("SELECT d.doc_id, coalesce('label.' || l.doc_id, 'doc.' || d.doc_id) AS resolved FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q_alias(spark, d):
    names = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc."), "doc_id").alias("name"))
    held = table(spark, d, "labels").select(F.concat(F.lit("label."), "doc_id").alias("name"))
    aliases = names.select("name", F.concat(F.lit("label."), "doc_id").alias("alias"), F.lit(0).alias("ord"))
    return C.resolve_alias(names.select("name").distinct(), aliases.distinct(), held).join(names, "name").select("doc_id", "resolved")


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS price_f32, CAST(l_partkey AS INTEGER) AS partkey_i32 FROM lineitem")
def q_cast_narrow(spark, d):
    t = _lineitem(spark, d)
    columns = {
        "price_f32": (T.cast_blocks(t.blocks("l_extendedprice"), "F32"), "double"),
        "partkey_i32": (T.cast_blocks(t.blocks("l_partkey"), "I32"), "int"),
        "l_orderkey": (t.blocks("l_orderkey"), "bigint"),
        "l_linenumber": (t.blocks("l_linenumber"), "int"),
    }
    return T.side_by_side(columns, t.shape("l_orderkey")[0]).drop("pos")


@query("SELECT (vec_id*64 + d)//8 AS row, (vec_id*64 + d) % 8 AS col, v::DOUBLE AS value FROM (SELECT vec_id, generate_subscripts(embedding,1)-1 AS d, unnest(embedding) AS v FROM embeddings)")
def q_reshape(spark, d):
    t = _embeddings(spark, d)
    shaped = T.reshape(t.tensor("embeddings"), t.shape("embeddings"), [-1, 8])
    return shaped.select(F.col("index")[0].alias("row"), F.col("index")[1].alias("col"), "value")


@query("SELECT count(*) FILTER (WHERE a.embedding = b.embedding) AS equal_next, count(*) AS pairs FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q_is_equal(spark, d):
    t = _embeddings(spark, d)
    n = t.shape("embeddings")[0]
    e = t.tensor("embeddings").select(F.expr(f"pos div {VEC}").alias("name"), (F.col("pos") % VEC).alias("pos"), "raw")
    odd = T.differs(e.where(F.col("name") < n - 1), e.where("name > 0").withColumn("name", F.col("name") - 1))
    return odd.agg((F.lit(n - 1) - F.count_distinct("name")).alias("equal_next")).withColumn("pairs", F.lit(n - 1).cast("bigint"))


@query("SELECT user_id % 4 AS rank, min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1, count(*) AS n FROM events GROUP BY 1")
def q_bandwidth(spark, d):
    # The timestamps have no zone; their microseconds are counted as they stand.
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    timings = table(spark, d, "events").select((F.col("user_id") % 4).alias("rank"), us.alias("us"), F.lit(1).cast("bigint").alias("one"))
    return S.bandwidth(timings, "rank", "us", "us", "one", by=["rank"]).select("rank", "t0", "t1", F.col("nbytes").alias("n"))


@query("SELECT s_suppkey, CAST((s_nationkey + 1) * CAST(pow(2, ceil(log2(n+1))) AS BIGINT) + i AS BIGINT) AS tag FROM (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS n FROM supplier)")
def q_tags(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return running(s, "s_suppkey", 1, "i").select("s_suppkey", (F.shiftleft((F.col("s_nationkey") + 1).cast("bigint"), P.tag_bits(s.count())) + F.col("i") + 1).alias("tag"))


# Archives made of the tables, read through the data source.


@query(f"SELECT name, dtype, c AS nelem, CAST(c*size AS BIGINT) AS nbytes, 1 AS ndim FROM (SELECT count(*) AS c FROM lineitem) n, (VALUES {COLUMN_ROWS}) t(ord,name,dtype,size)")
def q_archive_catalog(spark, d):
    return _lineitem(spark, d).catalog.select("name", "dtype", "nelem", "nbytes", "ndim")


@query("".join(f"SELECT '{c}' AS name, count(*) AS n, CAST(sum(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) AS total, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM lineitem UNION ALL " for c, _, _ in COLUMNS).removesuffix(" UNION ALL "))
def q_archive_columns(spark, d):
    t = _lineitem(spark, d)
    every = T.elements(t.blocks(*[c for c, _, _ in COLUMNS]))
    return every.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


# Of each type, a row's value as SQL; every type holds its own exactly.
TYPED = {
    "BOOL": "c_custkey % 2", "I8": "c_custkey % 200 - 100", "I16": "c_custkey % 60000 - 30000", "I32": "c_custkey * 1000 - 7", "I64": "c_custkey * 1000000007", "U8": "c_custkey % 256", "U16": "c_custkey % 65536", "U32": "c_custkey * 1001",
    "U64": "c_custkey * 1000003", "F16": "c_custkey % 2048", "BF16": "c_custkey % 256 - 100", "F32": "c_custkey + 0.5", "F64": "c_custkey + 0.25", "F8_E5M2": "c_custkey % 5 - 2", "F8_E4M3": "c_custkey % 17 - 8", "F8_E8M0": "1 + c_custkey % 2", "F4": "c_custkey % 5 - 2",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS dtype, i AS pos, CAST({v} AS DOUBLE) AS value FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)" for k, v in TYPED.items()))
def q_decode_types(spark, d):
    def build(path):
        c = running(table(spark, d, "customer").select("c_custkey"), "c_custkey", 1, "i")
        n = c.count()
        even = c.unionByName(spark.createDataFrame([(0, n)], c.schema)) if n % 2 else c  # packed values come in pairs
        packed = T.pack_columns(c.select("i", *[F.expr(v).cast("double" if k[0] in "FB" else "decimal(20,0)" if k == "U64" else "bigint").cast("double" if k != "I64" else "bigint").alias(k) for k, v in TYPED.items() if k != "F4"]), "i", [(k, k) for k in TYPED if k != "F4"], n)
        layout = [(k, k, [n + n % 2 if k == "F4" else n]) for k in TYPED]
        A.write_archive(packed.unionByName(T.pack_columns(even.select("i", F.expr(TYPED["F4"]).cast("double").alias("F4")), "i", [("F4", "F4")], n + n % 2)), path, 3, mode="overwrite", layout=layout)

    t = open_tensors(spark, archived(spark, d, "typed", build))
    n = t.shape("BOOL")[0]
    found = T.elements(t.blocks(*TYPED)).where(F.col("pos") < n)
    return found.select(F.col("name").alias("dtype"), "pos", "value")


@query("SELECT (n - 6 - vec_id) // 7 * 20 + (60 - d) // 3 AS pos, v::DOUBLE AS value FROM (SELECT vec_id, generate_subscripts(embedding,1)-1 AS d, unnest(embedding) AS v FROM embeddings), (SELECT count(*) AS n FROM embeddings) WHERE vec_id <= n - 6 AND (n - 6 - vec_id) % 7 = 0 AND vec_id >= 0 AND d BETWEEN 3 AND 60 AND (60 - d) % 3 = 0")
def q_slice_nd(spark, d):
    return _embeddings(spark, d).slice("embeddings", (slice(-6, None, -7), slice(60, 2, -3))).select("pos", "value")


@query("SELECT vec_id * 11 + d - 22 AS pos, v::DOUBLE AS value FROM (SELECT vec_id, generate_subscripts(embedding,1)-1 AS d, unnest(embedding) AS v FROM embeddings) WHERE d >= 22 AND d < 33")
def q_shard_rank(spark, d):
    return _embeddings(spark, d, 6).shard("embeddings", 1, 2).select("pos", "value")


def _halves(spark, d, world: int):
    """The embeddings [n, 64] and their first 10 columns [n, 10], as parts to join along dimension 1."""
    t = _embeddings(spark, d, world)
    n = t.shape("embeddings")[0]
    return [(t.tensor("embeddings"), [n, VEC]), (t.slice("embeddings", (slice(None), slice(0, 10))), [n, 10])]


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding,1)-1 AS d, unnest(embedding) AS v FROM embeddings),
s AS (SELECT 0 AS t, vec_id, d // 22 AS rank, d, v FROM e UNION ALL SELECT 1, vec_id, d // 4, d, v FROM e WHERE d < 10)
SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY vec_id, t, d) - 1 AS pos, v::DOUBLE AS value FROM s""")
def q_multi_cols_dim1(spark, d):
    return X.joined(_halves(spark, d, 3), 1, 3).select("rank", "pos", "value")


@query("SELECT vec_id * 74 + d AS pos, v::DOUBLE AS value FROM (SELECT vec_id, generate_subscripts(embedding,1)-1 AS d, unnest(embedding) AS v FROM embeddings) UNION ALL SELECT vec_id * 74 + 64 + d, v::DOUBLE FROM (SELECT vec_id, generate_subscripts(embedding,1)-1 AS d, unnest(embedding) AS v FROM embeddings) WHERE d < 10")
def q_concat_dim1(spark, d):
    return X.joined(_halves(spark, d, 1), 1).select("pos", "value")


@query("SELECT vec_id AS row, i - 1 AS col, embedding[i]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def q_round_trip(spark, d):
    """Blocks of a few rows, written as another archive of blocks, and read by row."""

    def build(path):
        few = A.read_blocks(spark, _embeddings(spark, d).paths, block_bytes=37 * VEC * 4)
        A.write_archive(few.select("name", "dtype", "shape", "elem_start", "payload"), path, mode="overwrite", layout=[(r[0], r[1], list(r[2])) for r in _embeddings(spark, d).catalog.select("name", "dtype", "shape").collect()])

    back = T.rows(A.read_blocks(spark, archived(spark, d, "again", build), block_bytes=100))
    return back.select("row", F.posexplode("vec").alias("col", "value")).withColumn("col", F.col("col").cast("bigint"))


@query("SELECT 'nation.' || n_nationkey AS name, 'region-' || n_regionkey AS folder FROM nation")
def q_filename(spark, d):
    catalog = A.read_catalog(spark, _regions(spark, d))
    wanted = table(spark, d, "nation").select(F.concat(F.lit("nation."), "n_nationkey").alias("name"))
    return C.filename_of(catalog, wanted).select("name", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))


@query("SELECT 'region-' || r_regionkey AS folder, 'region' AS key, r_name AS value FROM region")
def q_metadata(spark, d):
    found = C.file_metadata(A.read_catalog(spark, _regions(spark, d)))
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "key", "value")


@query("SELECT CAST(n_regionkey // 2 AS INTEGER) AS batch, CAST(n_regionkey % 2 AS INTEGER) AS rank, CAST(1 AS BIGINT) AS files, count(*) AS tensors, CAST(sum(octet_length(encode(n_name))) AS BIGINT) AS nbytes FROM nation GROUP BY 1, 2")
def q_stream_batches(spark, d):
    """Files by batches of two, as Structured Streaming hands them out."""
    out = f"{archived(spark, d, 'streamed', os.makedirs)}/{os.urandom(6).hex()}"
    S.for_each_batch(spark, _regions(spark, d), lambda df, k: S.batch_metrics(df).write.mode("overwrite").parquet(f"file://{out}/batches/n={k}"), f"file://{out}/checkpoint", 2)
    return spark.read.parquet(f"file://{out}/batches").select("batch", "rank", "files", "tensors", "nbytes")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return q_shard_dim0(spark, d)


__all__ = ["QUERIES", "SQL", "flagship"]

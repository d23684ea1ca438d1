"""Chats: logged snapshots that a longer conversation begins with are dropped, and the others rendered. DataFrame operations only.

1. Every turn is hashed with its place in its conversation; the running xor of these hashes (two of 64 bits) names each prefix.
2. Conversations of equal length and hash are one; the smallest conv_id stands for them.
3. A conversation whose whole hash is a proper prefix of another one is removed by an anti-join against the distinct prefixes, so
   a first turn that very many share is one row there.
4. The maximal conversations are joined to their turns and rendered, turn by turn.

Contract. Turns are ordered by (turn, role, text), nulls first; rows repeated in all four are one turn. A null role or text is empty. What
conversation a row without a conv_id belongs to is not known: each different one is a conversation of its own, of one turn and without an id, which stands
behind others as representative. Other columns don't matter. An empty table gives an empty
result. A conversation's rendering is one string, so it must fit in memory; nothing else gathers turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The marks of a rendered turn.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


#: What names a conversation: its id, or the only row of one without an id.
CONVERSATION = ("conv_id", "lone")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, lone, turn, role, text, place): each turn once, numbered from 1 in its conversation."""
    own = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    own = own.withColumn("lone", F.when(F.col("conv_id").isNull(), F.struct("turn", "role", "text")))
    return own.withColumn("place", F.row_number().over(Window.partitionBy(*CONVERSATION).orderBy("turn", "role", "text")))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, lone, place, h1, h2, size): the rolling hash of each conversation's first turns, and its length."""
    so_far = Window.partitionBy(*CONVERSATION).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    marked = turns(conversations).withColumns({"t1": F.xxhash64(F.lit(1), "place", "role", "text"), "t2": F.xxhash64(F.lit(2), "text", "role", "place")})
    rolled = marked.withColumns({"h1": F.bit_xor("t1").over(so_far), "h2": F.bit_xor("t2").over(so_far)})
    return rolled.select(*CONVERSATION, "place", "h1", "h2", (F.count("*").over(Window.partitionBy(*CONVERSATION))).alias("size"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, lone, n_turns) of the conversations that no longer one begins with, one of each."""
    rows = prefixes(conversations)
    whole = rows.where("place = size").groupBy(F.col("size").alias("n"), "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.min("lone").alias("lone")).withColumn("lone", F.when(F.col("conv_id").isNull(), F.col("lone")))
    inner = rows.where("place < size").select(F.col("place").alias("n"), "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select(*CONVERSATION, F.col("n").cast("bigint").alias("n_turns"))


def rendered(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations."""
    kept = maximal(conversations).withColumnsRenamed({"conv_id": "kept_id", "lone": "kept_lone"})
    own = turns(conversations).join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")) & F.col("lone").eqNullSafe(F.col("kept_lone")))
    line = F.concat(F.lit(OPEN), "role", F.lit(CLOSE), "text", F.lit("\n" + END))
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return own.groupBy(*CONVERSATION, "n_turns").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered")).drop("lone")

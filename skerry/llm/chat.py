"""Chat formatting with cumulative-snapshot collapse.

Loggers often store a conversation again after every turn.  A conversation is a snapshot of another if its turns are a proper prefix of the other's; of
conversations with the same turns, all but the smallest conv_id are repeats.  Rolling hashes name every prefix: h_k = sha256(h_{k-1}, role, text), over
(length-prefixed) fields, so prefixes are equal exactly if their hashes are.  Anti-joins keep the conversations whose hash is no proper prefix of another, and only
these are rendered.

Defined cases: turns are ordered by turn, then role and text; repeated rows are repeated turns; null roles and texts count as empty, null turns come first; a row
without a conv_id is a conversation of its own, of one turn, and comes behind those with one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

START, END = "<|im_start|>", "<|im_end|>"


def _field(x: Column) -> Column:
    return F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)


#: Turns whose hashes are gathered together; arrays of these arrays keep long conversations from being copied at every turn.
BLOCK = 64


def _rolled(turns: Column) -> Column:
    """The hash of each prefix."""
    zero = lambda last, kind: F.struct(last.alias("last"), F.array().cast(kind).alias("all"))
    grown = lambda acc, h, more: F.struct(h.alias("last"), F.concat(acc["all"], F.array(more)).alias("all"))

    def turn(acc: Column, t: Column) -> Column:
        return F.transform(F.array(F.sha2(F.concat(acc["last"], _field(t["role"]), _field(t["text"])), 256)), lambda h: grown(acc, h, h))[0]

    def block(acc: Column, part: Column) -> Column:
        return F.transform(F.array(F.aggregate(part, zero(acc["last"], "array<string>"), turn)), lambda x: grown(acc, x["last"], x["all"]))[0]

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / BLOCK).cast("int")), lambda k: F.slice(turns, k * BLOCK + 1, F.lit(BLOCK)))
    return F.flatten(F.aggregate(parts, zero(F.lit(""), "array<array<string>>"), block)["all"])


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, hashes): a conversation's turns in order, and the hash of each prefix."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    own = own.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    return own.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "turns", _rolled(F.col("turns")).alias("hashes"))


def maximal(conversations: DataFrame, base: str) -> DataFrame:
    """(conv_id, n_turns, turns, n_copies): maximal conversations, one of each; n_copies counts conversations with the same turns, itself included."""
    own = written(prefixes(conversations).withColumn("row", F.monotonically_increasing_id()), f"{base}/prefixes")
    last = F.element_at("hashes", -1)
    # Copies meet in a partial count; a hash has one row from each task at most.
    first = own.groupBy(last.alias("hash")).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "row")).alias("least"), F.count("*").alias("n_copies"))
    inner = own.where("n_turns > 1").select(F.explode(F.slice("hashes", F.lit(1), F.col("n_turns").cast("int") - 1)).alias("hash")).distinct()
    kept = first.join(inner, "hash", "left_anti").select(F.col("least.row").alias("row"), "n_copies")
    return own.join(kept, "row").select("conv_id", "n_turns", "turns", "n_copies")


def render(turns: Column) -> Column:
    """Turns as one training text."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(f"{END}\n"))))


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of each maximal conversation."""
    base = scratch(conversations.sparkSession, "chat")
    return maximal(conversations, base).select("conv_id", "n_turns", "n_copies", render(F.col("turns")).alias("text"))


SQL = f"""
WITH t AS (
  SELECT conv_id, count(*) AS n_turns,
         list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations) GROUP BY conv_id, own
), one AS (
  SELECT min(conv_id) AS conv_id, n_turns, turns, count(*) AS n_copies FROM t GROUP BY n_turns, turns
), inner_prefix AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM one)
)
SELECT conv_id, n_turns, n_copies,
       list_aggregate(list_transform(turns, lambda z: '{START}' || z.r || chr(10) || z.x || '{END}' || chr(10)), 'string_agg', '') AS text
FROM one WHERE NOT EXISTS (SELECT 1 FROM inner_prefix p WHERE p.turns = one.turns)
"""

"""Chat formatting: cumulative-snapshot collapse, then rendering.

A logged conversation is often a snapshot of one that went on.  Each conversation's turns get
rolling prefix hashes; one whose last hash is a prefix hash of a longer conversation goes, as does
one of several equal conversations but that with the smallest id.  The rest is rendered.

The hash of a prefix is the exclusive or of two 64-bit hashes of (position, role, text), so the
hash of a prefix is that of the one before and the next turn, and long conversations can be
hashed in blocks of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.llm.common import materialise, small, temporary_tables


def _known(value: Column) -> Column:
    """A string that is null-safe to hash: null and '' differ."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit(""))


def prefix_hashes(turns: DataFrame, block: int = 256) -> DataFrame:
    """(conv_id, turn, pos, h1, h2) from rows of (conv_id, turn, role, text), by conversation.

    Turns logged twice (all four equal) count once.  ``pos`` counts from 1 in order of turn (null
    first), then role, then text hash.  Positions and hashes go over blocks of ``block`` turn
    numbers and then inside each.
    """
    text = _known(F.col("text"))
    rows = turns.select("conv_id", "turn", "role", F.xxhash64(text).alias("__tw_t1"), F.xxhash64(F.lit("2"), text).alias("__tw_t2")).distinct()
    rows = rows.withColumn("__tw_block", F.coalesce(F.expr(f"turn div {block}"), F.lit(-(1 << 62))))
    by = W.partitionBy("conv_id", "__tw_block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "__tw_t1", "__tw_t2")
    earlier = W.partitionBy("conv_id").orderBy("__tw_block").rowsBetween(W.unboundedPreceding, -1)
    # where a block starts in its conversation; most conversations have one block and this is a short table
    counts = rows.groupBy("conv_id", "__tw_block").agg(F.count(F.lit(1)).alias("__tw_n"))
    before = counts.select("conv_id", "__tw_block", F.coalesce(F.sum("__tw_n").over(earlier), F.lit(0)).alias("__tw_before"))
    placed = rows.withColumn("__tw_in", F.row_number().over(by)).join(before, ["conv_id", "__tw_block"]).withColumn("pos", F.col("__tw_in") + F.col("__tw_before"))
    one, two = F.xxhash64("pos", _known(F.col("role")), "__tw_t1"), F.xxhash64(_known(F.col("role")), "__tw_t2", "pos")
    placed = materialise(placed.select("conv_id", "__tw_block", "turn", "pos", one.alias("__tw_1"), two.alias("__tw_2")), "chat-placed")
    run = W.partitionBy("conv_id", "__tw_block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = placed.groupBy("conv_id", "__tw_block").agg(F.bit_xor("__tw_1").alias("__tw_x1"), F.bit_xor("__tw_2").alias("__tw_x2"))
    blocks = blocks.select("conv_id", "__tw_block", *[F.coalesce(F.bit_xor(f"__tw_x{i}").over(earlier), F.lit(0)).alias(f"__tw_p{i}") for i in (1, 2)])
    summed = placed.select("conv_id", "__tw_block", "turn", "pos", *[F.bit_xor(f"__tw_{i}").over(run).alias(f"__tw_r{i}") for i in (1, 2)]).join(blocks, ["conv_id", "__tw_block"])
    return summed.select("conv_id", "turn", "pos", *[F.col(f"__tw_r{i}").bitwiseXOR(F.col(f"__tw_p{i}")).alias(f"h{i}") for i in (1, 2)])


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, first_turn) of conversations that no other one continues or, with a smaller id, repeats.

    A prefix that many conversations share is one row after partial aggregation.
    """
    lengths = hashes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("__tw_last"), F.min("turn").alias("first_turn"))
    lengths = materialise(lengths.select("conv_id", "first_turn", "__tw_last.pos", "__tw_last.h1", "__tw_last.h2"), "chat-ends")
    # a prefix hash that is not a conversation's last turn means that someone goes on from there
    continued = hashes.join(small(lengths.select("conv_id", "pos"), lengths.count()), ["conv_id", "pos"], "left_anti").select("pos", "h1", "h2").distinct()
    first = lengths.groupBy("pos", "h1", "h2").agg(F.min(F.struct("conv_id", "first_turn")).alias("__tw_f"))  # of equal conversations
    alone = first.join(continued, ["pos", "h1", "h2"], "left_anti")
    return alone.select(F.col("__tw_f.conv_id").alias("conv_id"), F.col("pos").alias("n_turns"), F.col("__tw_f.first_turn").alias("first_turn"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", start: str = "<|im_start|>", end: str = "<|im_end|>", part_turns: int = 1024) -> DataFrame:
    """(conv_id, part, n_turns, rendered): maximal conversations in ChatML.

    ``rendered`` joins a conversation's turns.  A conversation has a row for each ``part_turns``
    turn numbers, counted from its first one, that it has turns in (``part``, from 0), so that no
    row or task holds an unbounded conversation; turns without a number come first, in the first
    part.  Rows that are equal in all four columns count once; turns of one number and role follow
    in order of their text's hash; other columns are ignored, whatever their names.  Rows without
    a conv_id belong to no conversation and are left out; a null role is rendered as 'user', a null
    text as empty, but for the comparison null and '' differ.  An empty table gives no rows.

    Only hashes are compared and sorted; the texts of maximal conversations are shuffled once.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).where("conv_id IS NOT NULL")
    with temporary_tables(turns.sparkSession):
        maximal = materialise(maximal_conversations(materialise(prefix_hashes(rows), "chat-hashes")), "chat-maximal", keep=True)
    known = small(maximal.withColumnRenamed("conv_id", "__tw_conv"), maximal.count())
    part = F.coalesce(F.floor((F.col("turn") - F.col("first_turn")) / F.lit(part_turns)), F.lit(0)).cast("long")
    text = _known(F.col("text"))
    one = F.struct("turn", "role", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("2"), text).alias("h2"), "text")
    said = rows.join(known, F.col("conv_id") == F.col("__tw_conv")).groupBy("conv_id", part.alias("part"), "n_turns").agg(F.array_sort(F.collect_set(one)).alias("__tw_all"))
    turn = lambda x: F.concat(F.lit(start), F.coalesce(x["role"], F.lit("user")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(end + "\n"))
    return said.select("conv_id", "part", "n_turns", F.array_join(F.transform("__tw_all", turn), "").alias("rendered"))


ORACLE_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
said AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
                concat('<|im_start|>', coalesce(role, 'user'), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)) AS one FROM turns),
convs AS (SELECT conv_id, count(*) AS n_turns, string_agg(one, '' ORDER BY pos) AS rendered FROM said GROUP BY conv_id),
starts AS (SELECT conv_id, pos, string_agg(one, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS so_far FROM said),
gone AS (
  SELECT c.conv_id FROM convs c JOIN starts s ON s.pos = c.n_turns AND s.so_far = c.rendered
  JOIN convs o ON o.conv_id = s.conv_id
  WHERE o.n_turns > c.n_turns OR (o.n_turns = c.n_turns AND o.conv_id < c.conv_id))
SELECT conv_id, 0::BIGINT AS part, n_turns, rendered FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM gone)"""

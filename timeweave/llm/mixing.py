"""Mixing sources to target weights by weighted fair queueing.

Each source gets a share of the budget by weight, at most ``max_epochs`` times its own size; what
a capped source can't use is shared out again by weight.  Its documents are put in a shuffled
order that depends only on their ids, and each gets a virtual finish time: the words of its
source up to and including it, over the source's target.  The queue of all sources in order of
finish time, cut where the words taken reach the budget, is the mix.

The order and the sums come from narrow rows alone.  To sort the documents themselves, the time
from 0 to 1 is cut into slices, in each of which every source hands out the same share of its
target; a small table says which keys of a source fall into which slice.  So each text is
shuffled once, straight to its slice, and slice after slice is the global order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.llm.common import materialise, small, temporary_tables

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources by code point, null last, take the weights in turn.  The level L is the one at which
    the targets least(max_epochs * size, weight * L) add up to ``share`` of all words: sources are
    capped in order of max_epochs * size / weight until the next one stays below its cap.
    A source without words has target 0.  One row for each source passes through a window.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    per = per.withColumn("__tw_at", F.col("cap") / F.col("weight"))
    by_cap = W.orderBy("__tw_at", F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(1))
    per = per.withColumn("__tw_capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("__tw_open", F.sum("weight").over(by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)))
    per = per.withColumn("__tw_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    per = per.withColumn("__tw_level", (F.col("__tw_budget") - F.col("__tw_capped")) / F.col("__tw_open"))
    fits = F.when(F.col("__tw_level") <= F.col("__tw_at"), F.struct(F.row_number().over(by_cap).alias("k"), F.col("__tw_level").alias("level")))
    per = per.withColumn("__tw_fits", fits).withColumn("__tw_l", F.min("__tw_fits").over(everything)["level"])
    target = F.when(F.col("__tw_l").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("__tw_l")))
    return per.select("source", "source_size", "docs", target.alias("target"))


def _key(id_col: str, text_col: str, seed: str) -> Column:
    """A row's place in the shuffled order of its source: md5 of seed, id and the text's md5.

    The text counts, so that rows of one id, or of none, are spread as well.
    """
    id_ = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed + ":"), id_, F.lit(":"), text).cast("binary"))


def _block(key: Column, blocks: Column) -> Column:
    """Which of ``blocks`` (a power of two) equal ranges of keys holds ``key``."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") / (F.lit(1 << 32) / blocks)).cast("long")


def _placed(docs: DataFrame, weights: Sequence[float], max_epochs: int, share: float, id_col: str, text_col: str, source_col: str, seed: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(one narrow row per row of ``docs`` with its place and the times it is taken, the sources with their targets and blocks)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _key(id_col, text_col, seed).alias("key"))
    rows = materialise(rows, "mix-sizes")
    blocks = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("docs") / F.lit(block_rows), F.lit(1.0))))), F.lit(float(1 << 20))).cast("long")
    targets = materialise(source_targets(rows, weights, max_epochs, share).withColumn("blocks", blocks), "mix-targets")
    totals = targets.agg(F.sum("target").alias("budget"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("n")).first()
    of_source = targets.select(F.col("source").alias("__tw_t"), "blocks")
    rows = rows.join(small(of_source, totals["n"]), F.col("source").eqNullSafe(F.col("__tw_t"))).withColumn("block", _block(F.col("key"), F.col("blocks"))).drop("__tw_t", "blocks")
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("__tw_sum"))
    earlier = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__tw_s"), F.col("block").alias("__tw_b"), F.coalesce(F.sum("__tw_sum").over(earlier), F.lit(0)).alias("__tw_before"))
    sums = sums.join(small(targets.select(F.col("source").alias("__tw_t"), "source_size", "target"), totals["n"]), F.col("__tw_s").eqNullSafe(F.col("__tw_t"))).drop("__tw_t")
    inside = W.partitionBy("source", "block").orderBy("key")
    placed = rows.withColumn("__tw_in", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    placed = placed.withColumn("__tw_with", F.sum("size").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("__tw_s")) & (F.col("block") == F.col("__tw_b")))
    placed = placed.withColumn("cum", F.col("__tw_in") + F.col("__tw_before")).withColumn("__tw_end", F.col("__tw_with") + F.col("__tw_before"))
    copies = [F.col("cum") + F.col("source_size") * e for e in range(max_epochs)]
    in_time = sum(((c <= F.col("target")) & (F.col("size") > 0)).cast("long") for c in copies)
    late = [(c > F.col("target")) & (c - F.col("size") < F.col("target")) & (F.col("size") > 0) for c in copies]
    finish = F.coalesce(*[F.when(x, c / F.col("target")) for x, c in zip(late, copies, strict=True)])
    placed = placed.select("doc_id", "source", "block", "key", "size", "source_size", "target", "cum", "__tw_end", in_time.alias("__tw_times"), finish.alias("__tw_finish"))
    placed = materialise(placed, "mix-placed", totals["docs"] or 0, 20_000)
    # at most one late row for each source
    left = (totals["budget"] or 0.0) - (placed.agg(F.sum(F.col("size") * F.col("__tw_times")).alias("n")).first()["n"] or 0)
    late_rows = placed.where("__tw_finish IS NOT NULL").select(F.col("source").alias("__tw_s"), F.col("cum").alias("__tw_c"), "size", "__tw_finish")
    queue = W.orderBy("__tw_finish", F.col("__tw_s").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    also = late_rows.withColumn("__tw_run", F.sum("size").over(queue)).where(F.col("__tw_run") <= F.lit(float(left))).select("__tw_s", "__tw_c", F.lit(1).cast("long").alias("__tw_also"))
    full = placed.join(small(also, totals["n"]), F.col("source").eqNullSafe(F.col("__tw_s")) & (F.col("cum") == F.col("__tw_c")) & F.col("__tw_finish").isNotNull(), "left")
    return full.withColumn("times", F.col("__tw_times") + F.coalesce("__tw_also", F.lit(0))).drop("__tw_s", "__tw_c", "__tw_also"), targets


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = 3, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", block_rows: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, cum, key, taken, times.

    ``cum`` is the document's own place in its source's shuffled order, in words; ``times`` how
    often the mix takes it (0 to max_epochs) and ``taken`` the words of that.  Copy e of a document
    finishes at (e * source_size + cum) / target.  All copies that finish by 1 are in the mix;
    then, in order of finish time, those that start before 1 as long as the budget holds.

    The order within a source is by md5(seed, id, text): the same on every run.  Rows that are
    equal in id, source and text are taken one by one; texts without words have size 0 and are
    taken 0 times; a null source is a source, last in order; null ids and texts are hashed as
    such.  An empty table gives no rows.  Running sums go over blocks of about ``block_rows`` rows
    of a source (of more, once that would make over 2**20 blocks) and then within each block, so a
    hot source is split, whatever its ids.  One row for each source passes through one task.
    """
    placed, _ = _placed(docs, weights, max_epochs, share, id_col, text_col, source_col, seed, block_rows)
    return placed.select("doc_id", "source", "size", "source_size", "target", "cum", "key", (F.col("times") * F.col("size")).alias("taken"), "times")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = 3, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", block_rows: int = 4096, slice_words: int = 1 << 21, table_rows: int = 1 << 20) -> DataFrame:
    """The rows of the mix with all columns of ``docs``, globally sorted by virtual finish time.

    A document that the mix takes twice is there twice.  Partition k holds the k-th of equal slices
    of time, sorted; a slice has about ``slice_words`` words, or more once slices, sources and
    epochs would multiply to over ``table_rows``.  The table of which keys fall into which slice
    is broadcast only if it has at most that many rows; otherwise Spark joins as it sees fit.

    Rows that are equal in id, source and text are taken as often as ``mix`` takes them together.
    Nulls, texts without words and empty tables are as in ``mix``.
    """
    with temporary_tables(docs.sparkSession):
        return _sliced(docs, *_placed(docs, weights, max_epochs, share, id_col, text_col, source_col, seed, block_rows), max_epochs, id_col, text_col, source_col, seed, slice_words, table_rows)


def _sliced(docs: DataFrame, placed: DataFrame, targets: DataFrame, max_epochs: int, id_col: str, text_col: str, source_col: str, seed: str, slice_words: int, table_rows: int) -> DataFrame:
    """``docs`` dealt to slices and sorted; ``placed`` and ``targets`` are no longer needed then."""
    totals = targets.agg(F.sum("target").alias("budget"), F.count(F.lit(1)).alias("n")).first()
    slices = max(1, min(int((totals["budget"] or 0) // slice_words) + 1, table_rows // (max_epochs * max(totals["n"], 1))))
    copies = placed.where("times > 0").withColumn("__tw_e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    offset = F.col("source_size") * F.col("__tw_e")
    # equal rows share the slice in which the last of them ends
    at = F.least(F.floor((F.col("__tw_end") + offset) / F.col("target") * F.lit(float(slices))), F.lit(slices - 1)).cast("int")
    finish = F.col("cum") + offset
    table = copies.groupBy("source", "block", "__tw_e", at.alias("__tw_slice"), "source_size", "target").agg(
        F.min("key").alias("__tw_lo"), F.max("key").alias("__tw_hi"), F.min(finish - F.col("size")).alias("__tw_start"), F.max(F.when(finish > F.col("target"), finish)).alias("__tw_late")
    )
    table = table.select(F.col("source").alias("__tw_src"), F.col("block").alias("__tw_block"), "__tw_e", "__tw_slice", F.col("target").alias("__tw_target"), "__tw_lo", "__tw_hi", "__tw_start", "__tw_late")
    table = materialise(table, "mix-slices", keep=True)
    of_source = small(materialise(targets.select(F.col("source").alias("__tw_s"), F.col("blocks").alias("__tw_n")), "mix-blocks", keep=True), totals["n"])
    rows = docs.withColumn("__tw_key", _key(id_col, text_col, seed)).join(of_source, F.col(source_col).eqNullSafe(F.col("__tw_s")))
    rows = rows.withColumn("__tw_b", _block(F.col("__tw_key"), F.col("__tw_n"))).drop("__tw_s", "__tw_n")
    inside = F.col("__tw_key").between(F.col("__tw_lo"), F.col("__tw_hi"))
    rows = rows.join(small(table, table.count(), table_rows), F.col(source_col).eqNullSafe(F.col("__tw_src")) & (F.col("__tw_b") == F.col("__tw_block")) & inside)
    rows = rows.where(F.col(text_col).rlike(WORD)).withColumn("__tw_size", word_count(F.col(text_col))).repartitionById(slices, F.col("__tw_slice"))
    order = W.partitionBy("__tw_slice", "__tw_src", "__tw_block", "__tw_e").orderBy("__tw_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__tw_cum", F.col("__tw_start") + F.sum("__tw_size").over(order))
    rows = rows.where((F.col("__tw_cum") <= F.col("__tw_target")) | F.col("__tw_cum").eqNullSafe(F.col("__tw_late")))
    return rows.sortWithinPartitions(F.col("__tw_cum") / F.col("__tw_target"), "__tw_src", "__tw_key").select(*[F.col(c) for c in docs.columns])

"""Allen's interval relations, overlap joins and as-of joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.functions.temporal import micros

Relation = Callable[[Column, Column, Column, Column], Column]

#: a = [a1, a2), b = [b1, b2)
ALLEN: dict[str, Relation] = {
    "before": lambda a1, a2, b1, b2: a2 < b1,
    "after": lambda a1, a2, b1, b2: a1 > b2,
    "meets": lambda a1, a2, b1, b2: a2 == b1,
    "met_by": lambda a1, a2, b1, b2: a1 == b2,
    "overlaps": lambda a1, a2, b1, b2: (a1 < b1) & (a2 > b1) & (a2 < b2),
    "overlapped_by": lambda a1, a2, b1, b2: (a1 > b1) & (a1 < b2) & (a2 > b2),
    "during": lambda a1, a2, b1, b2: (a1 > b1) & (a2 < b2),
    "contains": lambda a1, a2, b1, b2: (a1 < b1) & (a2 > b2),
    "starts": lambda a1, a2, b1, b2: (a1 == b1) & (a2 < b2),
    "started_by": lambda a1, a2, b1, b2: (a1 == b1) & (a2 > b2),
    "finishes": lambda a1, a2, b1, b2: (a2 == b2) & (a1 > b1),
    "finished_by": lambda a1, a2, b1, b2: (a2 == b2) & (a1 < b1),
    "equals": lambda a1, a2, b1, b2: (a1 == b1) & (a2 == b2),
}


def _us(df: DataFrame, column: str) -> Column:
    """Microseconds of a timestamp column; a whole-number column counts as such already."""
    return F.col(column) if isinstance(df.schema[column].dataType, T.LongType) else micros(F.col(column))


def _suffixed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_r") for c in df.columns])


def _end(df: DataFrame, column: str) -> Column:
    """The end of an interval; no end is later than any other, and equal to no end."""
    kind = df.schema[column].dataType
    far = F.lit((1 << 63) - 1) if isinstance(kind, T.LongType) else F.lit("9999-12-31 23:59:59.999999").cast(kind)
    return F.coalesce(F.col(column), far)


#: Buckets of a level are so many times as wide as those of the one below it; the last level has one bucket.
FACTOR, LEVELS = 64, 4


def _places(level: int, first: Column, last: Column) -> Column:
    return F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bucket"), first.alias("first")))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], width_us: int, start: str = "valid_from", end: str = "valid_to", also: Column | None = None) -> DataFrame:
    """Pairs of rows with equal ``on`` whose [start, end) overlap; the right side's columns get the suffix ``_r``.

    A null end is open: later than everything.  Empty intervals, and those without a start, meet
    nothing.  Both sides are dealt into time buckets, so that a key with many intervals is split
    along time and only neighbours in time are compared.  Buckets come in levels: ``width_us``,
    64 and 4096 times that, and one for all time.  An interval belongs to the level at which it
    touches two buckets at most, and is also dealt into the buckets of the levels above, where it
    meets longer ones: so nobody is copied more than eight times, however long.  A pair is kept at
    the level of its longer interval, in the first bucket both share.  Choose a width near the
    typical interval.  ``also`` is one more condition on the pair.
    """

    def dealt(df: DataFrame, suffix: str) -> DataFrame:
        lo, hi = _us(df, start + suffix), _us(df, end + suffix)
        length = hi - lo
        own = F.lit(LEVELS - 1)
        for level in range(LEVELS - 2, -1, -1):
            own = F.when(length <= width_us * FACTOR**level, level).otherwise(own)
        own = F.when(hi.isNull(), LEVELS - 1).otherwise(own)
        places = []
        for level in range(LEVELS):
            wide = F.lit(width_us * FACTOR**level)
            first, last = (F.floor(x / wide) for x in (lo, hi - 1)) if level < LEVELS - 1 else (F.lit(0).cast("long"),) * 2
            places.append(F.when(own <= level, _places(level, first, last)).otherwise(F.array().cast("array<struct<level:int,bucket:bigint,first:bigint>>")))
        rows = df.where(lo.isNotNull() & (hi.isNull() | (lo < hi))).withColumn(f"_own{suffix}", own)
        return rows.withColumn(f"_at{suffix}", F.explode(F.concat(*places)))

    other = _suffixed(right)
    a, b = dealt(left, ""), dealt(other, "_r")
    cond = (F.col("_at.level") == F.col("_at_r.level")) & (F.col("_at.bucket") == F.col("_at_r.bucket"))
    cond = cond & (F.col("_at.level") == F.greatest("_own", "_own_r")) & (F.col("_at.bucket") == F.greatest("_at.first", "_at_r.first"))
    cond = cond & (F.col(start) < _end(other, f"{end}_r")) & (F.col(f"{start}_r") < _end(left, end))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"{c}_r"))
    if also is not None:
        cond = cond & also
    return a.join(b, cond).drop("_at", "_at_r", "_own", "_own_r")


#: Relations whose intervals share time, so that buckets find them.
SHARING = frozenset({"overlaps", "overlapped_by", "during", "contains", "starts", "started_by", "finishes", "finished_by", "equals"})


def allen_join(left: DataFrame, right: DataFrame, on: Sequence[str], relation: str, start: str = "valid_from", end: str = "valid_to", width_us: int | None = None) -> DataFrame:
    """Pairs with equal ``on`` whose intervals stand in ``relation``; the right side gets the suffix ``_r``.

    With ``width_us``, relations that share time are found by buckets (see ``overlap_join``);
    ``meets`` and ``met_by`` are equi-joins as they are.  ``before`` and ``after`` hold for most
    pairs, so their result is that large.  A null end is later than every other and equal to
    another null end; a null start stands in no relation.
    """
    holds = ALLEN[relation](F.col(start), _end(left, end), F.col(f"{start}_r"), _end(_suffixed(right), f"{end}_r"))
    if width_us is not None and relation in SHARING:
        return overlap_join(left, right, on, width_us, start, end, also=holds)
    for c in on:
        holds = holds & (F.col(c) == F.col(f"{c}_r"))
    return left.join(_suffixed(right), holds)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], seq: str | None = None, width_us: int | None = None) -> DataFrame:
    """``left`` with the newest ``values`` of ``right`` at or before its time, per key; null where there is none.

    Both sides are one stream sorted by (key, time); a running last value answers every left row,
    so the cost is one shuffle of both, not the pairs.  Of right rows of one time the one with the
    largest ``seq`` counts.  With ``width_us`` each key's stream is cut into buckets of time, each
    sorted by itself; what a bucket starts with comes from the last right row of each bucket before
    it, a short table.  So a hot key is not the work of one task.
    """
    order = [F.col("_ts"), F.col("_side")]
    l_cols = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*l_cols).alias("_left"))
    b = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.struct(*values).alias("_right"), *([F.col(seq).alias("_seq")] if seq else []))
    if seq:
        order.append(F.col("_seq"))
    both = a.unionByName(b, allowMissingColumns=True)
    by = list(keys)
    if width_us is not None:
        both = both.withColumn("_b", F.floor(_us(both, "_ts") / F.lit(width_us)))
        by.append("_b")
    upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumn("_last", F.last("_right", ignorenulls=True).over(upto)).where("_side = 1")
    if width_us is not None:
        newest = F.max_by(F.when(F.col("_side") == 0, F.col("_right")), F.when(F.col("_side") == 0, F.struct("_ts", *(["_seq"] if seq else []))))
        earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        ends = both.groupBy(*by).agg(newest.alias("_end")).withColumn("_before", F.last("_end", ignorenulls=True).over(earlier))
        ends = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_before")
        on = F.lit(True)
        for i, c in enumerate(by):
            on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        seen = seen.join(ends, on, "left").withColumn("_last", F.coalesce("_last", "_before"))
    return seen.select(*keys, *[F.col(f"_left.{c}").alias(c) for c in l_cols], *[F.col(f"_last.{v}").alias(v) for v in values])


def transaction_conflicts(txns: DataFrame, width_us: int = 3_600_000_000) -> DataFrame:
    """(a, b, kind) of transactions (txn_id, start, end, key, mode R or W) whose windows overlap and that touch a key, one writing.

    Windows that do not overlap never conflict, so a hot key is compared within time buckets of ``width_us`` only.
    """
    writes = (F.col("mode") == "W") | (F.col("mode_r") == "W")
    pairs = overlap_join(txns, txns, ["key"], width_us, "start", "end", also=(F.col("txn_id") < F.col("txn_id_r")) & writes)
    kind = F.when((F.col("mode") == "W") & (F.col("mode_r") == "W"), "write-write").otherwise("read-write")
    return pairs.select(F.col("txn_id").alias("a"), F.col("txn_id_r").alias("b"), kind.alias("kind")).distinct()

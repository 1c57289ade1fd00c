"""Version folding: from append-only logs to the state at a moment, and to intervals.

A log has key columns, a time, a tie-breaking sequence and an ``op``; DELETE wins over whatever is
older.  A fold is one aggregation by ``max_by`` with partial aggregation before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.functions.temporal import at


def _when(moment) -> Column:
    return moment if isinstance(moment, Column) else at(moment)


def fold(log: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str = "seq", as_of=None, op: str = "op", deleted: str = "DELETE") -> DataFrame:
    """Each key's newest row at ``as_of`` (default: ever), unless that row deletes it."""
    rows = log if as_of is None else log.where(F.col(ts) <= _when(as_of))
    rest = [c for c in log.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, seq)).alias("_r"))
    return newest.where(F.col(f"_r.{op}") != deleted).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def intervals(log: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """``log`` with valid_from, valid_to (the next row's time; null for the last) and version (from 0)."""
    by = W.partitionBy(*keys).orderBy(ts, seq)
    return log.withColumn("valid_from", F.col(ts)).withColumn("valid_to", F.lead(ts).over(by)).withColumn("version", F.row_number().over(by).cast("bigint") - 1)


def get_at_time(history: DataFrame, keys: Sequence[str], when, value: str, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(keys..., ts, value): each key's newest value at ``when``."""
    rows = history.where(F.col(ts) <= _when(when))
    return rows.groupBy(*keys).agg(F.max(ts).alias(ts), F.max_by(value, F.struct(ts, seq)).alias(value))


def version_k(history: DataFrame, keys: Sequence[str], k: int, ts: str = "ts") -> DataFrame:
    """Rows of each key's k-th different time, from 0."""
    rank = F.dense_rank().over(W.partitionBy(*keys).orderBy(ts))
    return history.withColumn("version", rank.cast("bigint") - 1).where(F.col("version") == k)


def first_last(history: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(keys..., first_value, last_value)."""
    by = F.struct(ts, seq)
    return history.groupBy(*keys).agg(F.min_by(value, by).alias("first_value"), F.max_by(value, by).alias("last_value"))


def prev_next(history: DataFrame, keys: Sequence[str], when, value: str, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(keys..., prev_value, next_value) around ``when``: the newest value before it, the oldest after it."""
    by, t = F.struct(ts, seq), _when(when)
    before, after = F.col(ts) < t, F.col(ts) > t
    return history.groupBy(*keys).agg(
        F.max_by(F.when(before, F.col(value)), F.when(before, by)).alias("prev_value"),
        F.min_by(F.when(after, F.col(value)), F.when(after, by)).alias("next_value"),
    )


def snapshot_pivot(cells: DataFrame, entity: str, column: str, values: Sequence[str], when, value: str = "value", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """One row per entity with its newest value of each of ``values`` of ``column`` at ``when``, by conditional aggregation."""
    rows = cells.where((F.col(ts) <= _when(when)) & F.col(column).isin(*values))
    by = F.struct(ts, seq)
    hit = lambda v: F.col(column) == F.lit(v)
    return rows.groupBy(entity).agg(*[F.max_by(F.when(hit(v), F.col(value)), F.when(hit(v), by)).alias(v) for v in values])


def snapshot_diff(history: DataFrame, keys: Sequence[str], t0, t1, value: str, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(keys..., change, old_value, new_value) between two moments: added, removed is not possible in a log without deletes, changed."""
    by = F.struct(ts, seq)
    old, new = F.col(ts) <= _when(t0), F.col(ts) <= _when(t1)
    both = history.where(new).groupBy(*keys).agg(F.max_by(F.when(old, F.col(value)), F.when(old, by)).alias("old_value"), F.max_by(value, by).alias("new_value"), F.max(F.when(old, F.lit(True))).alias("_had"))
    change = F.when(F.col("_had").isNull(), "added").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", "old_value", "new_value")


def scan_limit(history: DataFrame, keys: Sequence[str], n: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The newest ``n`` rows of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(seq).desc()))
    return history.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


# lifecycles: events Created, Deleted, Recreated, Purged

ALIVE = ("Created", "Recreated")


def _moment(events: DataFrame, ts: str) -> list[str]:
    """What orders an entity's events: the time and, where the log has one, its sequence."""
    return [ts, "seq"] if "seq" in events.columns else [ts]


def alive_periods(events: DataFrame, entity: str = "entity_id", ts: str = "ts", event: str = "event") -> DataFrame:
    """(entity, start, end): runs in which an entity exists; ``end`` is null while it does.  Events of one time follow in order of ``seq``."""
    by = W.partitionBy(entity).orderBy(*_moment(events, ts))
    alive = F.col(event).isin(*ALIVE)
    edges = events.withColumn("_a", alive).withColumn("_p", F.lag("_a").over(by)).where(F.col("_p").isNull() & F.col("_a") | (F.col("_p") != F.col("_a")))
    ends = edges.withColumn("end", F.lead(ts).over(by)).where("_a")
    return ends.select(entity, F.col(ts).alias("start"), "end")


def entity_exists_at(events: DataFrame, when, entity: str = "entity_id", ts: str = "ts", event: str = "event") -> DataFrame:
    """(entity, state, alive) by the newest event at ``when``; entities without one are not there."""
    newest = events.where(F.col(ts) <= _when(when)).groupBy(entity).agg(F.max_by(event, F.struct(*_moment(events, ts))).alias("state"))
    return newest.withColumn("alive", F.col("state").isin(*ALIVE))


def active_entities(events: DataFrame, when, entity: str = "entity_id", ts: str = "ts", event: str = "event") -> DataFrame:
    return entity_exists_at(events, when, entity, ts, event).where("alive").select(entity)


def portion_of(table: DataFrame, start, end, changes: dict[str, Column], lo: str = "valid_from", hi: str = "valid_to") -> DataFrame:
    """``changes`` applied to [start, end) only: rows that reach beyond are split at its ends."""
    s, e = _when(start), _when(end)
    meets = (F.col(lo) < e) & (F.col(hi).isNull() | (F.col(hi) > s))
    ends = F.coalesce(F.col(hi), F.lit("9999-12-31").cast("timestamp_ntz"))
    whole = lambda c: F.when(c == F.lit("9999-12-31").cast("timestamp_ntz"), F.lit(None)).otherwise(c)
    pieces = F.array(
        F.struct(F.col(lo).alias("lo"), F.least(s, ends).alias("hi"), F.lit(False).alias("now")),
        F.struct(F.greatest(F.col(lo), s).alias("lo"), F.least(ends, e).alias("hi"), F.lit(True).alias("now")),
        F.struct(F.greatest(F.col(lo), e).alias("lo"), ends.alias("hi"), F.lit(False).alias("now")),
    )
    pieces = F.when(meets, F.filter(pieces, lambda p: p["lo"] < p["hi"])).otherwise(F.array(F.struct(F.col(lo).alias("lo"), ends.alias("hi"), F.lit(False).alias("now"))))
    cut = table.withColumn("_p", F.explode(pieces))
    out = {c: F.col(c) for c in table.columns}
    out |= {c: F.when(F.col("_p.now"), v).otherwise(F.col(c) if c in table.columns else F.lit(None)) for c, v in changes.items()}
    out |= {lo: F.col("_p.lo"), hi: whole(F.col("_p.hi"))}
    return cut.select(*[v.alias(c) for c, v in out.items()])

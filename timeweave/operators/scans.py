"""Scans of node, edge and history tables with a predicate that reaches the files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.functions.temporal import at
from timeweave.operators import fold

OPS = {
    "=": lambda c, v: c == v,
    "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v) if len(v) else F.lit(False),
    "like": lambda c, v: c.contains(v),  # a plain substring
}


@dataclass(frozen=True)
class Predicate:
    """All of ``filters`` (property, operator, value), an inclusive time range, the columns wanted and a limit."""

    filters: Sequence[tuple] = ()
    time: tuple | None = None
    columns: Sequence[str] = ()
    limit: int | None = None
    ts: str = "ts"
    aggregate: Sequence[Column] = field(default_factory=tuple)

    def column(self) -> Column:
        found = F.lit(True)
        for prop, op, value in self.filters:
            found = found & OPS[op](F.col(prop), value)
        if self.time is not None:
            found = found & F.col(self.ts).between(at(self.time[0]), at(self.time[1]))
        return found


def scan(df: DataFrame, predicate: Predicate) -> DataFrame:
    rows = df.where(predicate.column())
    if predicate.aggregate:
        return rows.agg(*predicate.aggregate)
    if predicate.columns:
        rows = rows.select(*predicate.columns)
    return rows if predicate.limit is None else rows.limit(predicate.limit)


def scan_ids(df: DataFrame, low, high, limit: int | None = None, key: str = "id") -> DataFrame:
    """Rows with ``low`` <= id <= ``high``, the first ``limit`` by id; files and partitions are read in parallel."""
    rows = df.where(F.col(key).between(low, high))
    return rows if limit is None else rows.orderBy(key).limit(limit)


def batch_get(df: DataFrame, wanted: DataFrame | Iterable, key: str = "id") -> DataFrame:
    """The rows whose key is in ``wanted``: a short list as a predicate, a table as a semi-join."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(F.col(wanted.columns[0]).alias("_want")).distinct(), F.col(key) == F.col("_want"), "left_semi")
    return df.where(F.col(key).isin(*wanted))


def get_node(history: DataFrame, lifecycle: DataFrame, node, when, keys: Sequence[str] = ("entity_id",), value: str = "value") -> DataFrame:
    """The node's newest cell at ``when``; nothing if it is absent or deleted then."""
    alive = fold.active_entities(lifecycle.where(F.col("entity_id") == node), when)
    cell = fold.get_at_time(history.where(F.col(keys[0]) == node), list(keys), when, value)
    return cell.join(alive, F.col(keys[0]) == F.col("entity_id") if keys[0] != "entity_id" else "entity_id", "left_semi")


def snapshot_edges(log: DataFrame, lifecycle: DataFrame, when, direction: str = "out", vertex=None) -> DataFrame:
    """(src, dst, ...) folded at ``when``, without edges either end of which is deleted by then.

    ``log`` has src, dst, ts, seq and op; an end that the lifecycle never mentions counts as there.
    """
    rows = log
    if vertex is not None:
        rows = rows.where(F.col("src" if direction == "out" else "dst") == vertex)
    edges = fold.fold(rows, ["src", "dst"], as_of=when)
    gone = fold.entity_exists_at(lifecycle, when).where("NOT alive").select(F.col("entity_id").alias("_gone"))
    for end in ("src", "dst"):
        edges = edges.join(gone, F.col(end) == F.col("_gone"), "left_anti")
    return edges


def temporal_query(history: DataFrame, keys: Sequence[str], mode: str, value: str, start=None, end=None) -> DataFrame:
    """The four ways to ask for a history: as_of (at ``end``), version_history, changes_in_range, latest."""
    if mode == "as_of":
        return fold.get_at_time(history, keys, end, value)
    if mode == "latest":
        return history.groupBy(*keys).agg(F.max("ts").alias("ts"), F.max_by(value, F.struct("ts", "seq")).alias(value))
    rows = history.select(*keys, "ts", value)
    if mode == "changes_in_range":
        return rows.where((F.col("ts") >= at(start)) & (F.col("ts") < at(end)))
    if mode == "version_history":
        return rows
    raise ValueError(mode)

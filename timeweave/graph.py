"""The graph: labelled node tables and typed edge tables, each an ordinary DataFrame.

A node table has an ``id`` column, an edge table ``src``, ``dst`` and ``edge_id``; all other
columns are properties.  Tables that change over time have ``valid_from`` and ``valid_to`` (and,
bitemporal, ``txn_from`` and ``txn_to``): half-open intervals whose open end is null.  Graphs are
immutable; writes return new ones.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.functions.temporal import at

INTERVALS = {"valid": ("valid_from", "valid_to"), "system": ("txn_from", "txn_to")}


@dataclass(frozen=True)
class NodeTable:
    label: str
    df: DataFrame

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c != "id"]


@dataclass(frozen=True)
class EdgeTable:
    type: str
    src_label: str
    dst_label: str
    df: DataFrame

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("src", "dst", "edge_id")]

    def key(self) -> Column:
        """The edge's id over all tables of the graph."""
        return F.concat(F.lit(f"{self.type}:{self.src_label}:{self.dst_label}:"), F.col("edge_id").cast("string"))


@dataclass(frozen=True)
class TemporalGraph:
    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: tuple[EdgeTable, ...] = ()
    name: str = "default"

    # making graphs

    def with_nodes(self, label: str, df: DataFrame, id_col: str = "id") -> TemporalGraph:
        table = NodeTable(label, df if id_col == "id" else df.withColumnRenamed(id_col, "id"))
        return replace(self, nodes={**self.nodes, label: table})

    def with_edges(self, type_: str, src_label: str, dst_label: str, df: DataFrame) -> TemporalGraph:
        """``df`` has src and dst; without an edge_id, edges are told apart by their ends."""
        if "edge_id" not in df.columns:
            df = df.withColumn("edge_id", F.concat_ws(">", "src", "dst"))
        others = tuple(e for e in self.edges if (e.type, e.src_label, e.dst_label) != (type_, src_label, dst_label))
        return replace(self, edges=(*others, EdgeTable(type_, src_label, dst_label, df)))

    # looking things up

    def node_tables(self, labels: Iterable[str] = ()) -> list[NodeTable]:
        wanted = list(labels) or list(self.nodes)
        return [self.nodes[x] for x in wanted if x in self.nodes]

    def edge_tables(self, types: Iterable[str] = (), src: Iterable[str] = (), dst: Iterable[str] = ()) -> list[EdgeTable]:
        types, src, dst = list(types), set(src), set(dst)
        return [e for e in self.edges if (not types or e.type in types) and (not src or e.src_label in src) and (not dst or e.dst_label in dst)]

    def edges_of(self, *types: str) -> DataFrame:
        """src, dst, type and edge_id of all edges of these types (none named: of all), with all properties."""
        found = None
        for e in self.edge_tables(types):
            one = e.df.withColumn("type", F.lit(e.type)).withColumn("edge_id", F.col("edge_id").cast("string"))
            found = one if found is None else found.unionByName(one, allowMissingColumns=True)
        if found is None:
            raise KeyError(f"no edges of type {' or '.join(types) or 'any'}")
        return found

    # time travel

    def map_tables(self, change) -> TemporalGraph:
        """A graph whose every table is ``change(df)``."""
        return replace(
            self,
            nodes={k: replace(n, df=change(n.df)) for k, n in self.nodes.items()},
            edges=tuple(replace(e, df=change(e.df)) for e in self.edges),
        )

    def as_of(self, when, axis: str = "valid") -> TemporalGraph:
        return self.map_tables(lambda df: where_interval(df, "as_of", (_moment(when),), axis))

    def between(self, start, end, axis: str = "valid") -> TemporalGraph:
        return self.map_tables(lambda df: where_interval(df, "between", (_moment(start), _moment(end)), axis))

    def contained_in(self, start, end, axis: str = "valid") -> TemporalGraph:
        return self.map_tables(lambda df: where_interval(df, "contained_in", (_moment(start), _moment(end)), axis))

    def cypher(self, text: str, **params) -> DataFrame:
        from timeweave.session import GraphSession

        return GraphSession(self.spark, self).query(text, **params)


def _moment(value) -> Column:
    return value if isinstance(value, Column) else at(value)


def interval_predicate(kind: str, args: tuple[Column, ...], start: Column, end: Column) -> Column:
    """Half-open intervals whose open end is null."""
    if kind == "as_of":
        return (start <= args[0]) & (end.isNull() | (end > args[0]))
    if kind == "between":
        return (start < args[1]) & (end.isNull() | (end > args[0]))
    if kind == "contained_in":
        return (start >= args[0]) & (end <= args[1])
    raise ValueError(kind)


def where_interval(df: DataFrame, kind: str, args: tuple[Column, ...], axis: str = "valid") -> DataFrame:
    """Rows of ``df`` valid as asked; tables without interval columns on that axis are static and stay whole."""
    lo, hi = INTERVALS[axis]
    if lo not in df.columns:
        return df
    return df.where(interval_predicate(kind, args, F.col(lo), F.col(hi) if hi in df.columns else F.lit(None).cast("timestamp_ntz")))

"""Writes: each returns a new graph.  Validation is a query that returns the violations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.graph import NodeTable, TemporalGraph
from timeweave.operators.intervals import asof_join

LEVELS = ("permissive", "check_exists", "strict_temporal", "full_isolation")


class UpdateRejected(ValueError):
    """A strict update has violations; ``violations`` is their DataFrame."""

    def __init__(self, violations: DataFrame):
        super().__init__("the update violates the graph's constraints")
        self.violations = violations


def create_nodes(graph: TemporalGraph, label: str, rows: DataFrame) -> TemporalGraph:
    """``rows`` (id, properties) added to ``label``; new properties are null in old rows and the other way round."""
    old = graph.nodes.get(label)
    return graph.with_nodes(label, rows if old is None else old.df.unionByName(rows, allowMissingColumns=True))


def create_edges(graph: TemporalGraph, type_: str, src_label: str, dst_label: str, rows: DataFrame) -> TemporalGraph:
    if "edge_id" not in rows.columns:
        rows = rows.withColumn("edge_id", F.concat_ws(">", "src", "dst"))
    old = [e for e in graph.edges if (e.type, e.src_label, e.dst_label) == (type_, src_label, dst_label)]
    if old:
        kind = old[0].df.schema["edge_id"].dataType
        rows = old[0].df.unionByName(rows.withColumn("edge_id", F.col("edge_id").try_cast(kind)), allowMissingColumns=True)
    return graph.with_edges(type_, src_label, dst_label, rows)


def set_property(graph: TemporalGraph, label: str, ids: DataFrame, prop: str, value: str) -> TemporalGraph:
    """``prop`` of the nodes in ``ids`` (id, ``value``) becomes that row's value; of several, the largest."""
    table = graph.nodes[label]
    new = ids.groupBy(F.col("id").alias("_id")).agg(F.max(value).alias("_value"), F.count(F.lit(1)).alias("_hit"))
    joined = table.df.join(new, F.col("id") == F.col("_id"), "left")
    old = F.col(prop) if prop in table.df.columns else F.lit(None)
    df = joined.withColumn(prop, F.when(F.col("_hit").isNotNull(), F.col("_value")).otherwise(old)).drop("_id", "_value", "_hit")
    return replace(graph, nodes={**graph.nodes, label: NodeTable(label, df)})


def delete_nodes(graph: TemporalGraph, label: str, ids: DataFrame) -> TemporalGraph:
    """Nodes whose id is in ``ids`` go, and with them every edge that ends there."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    nodes = {**graph.nodes, label: NodeTable(label, graph.nodes[label].df.join(gone, F.col("id") == F.col("_gone"), "left_anti"))}
    edges = []
    for e in graph.edges:
        df = e.df
        if e.src_label == label:
            df = df.join(gone, F.col("src") == F.col("_gone"), "left_anti")
        if e.dst_label == label:
            df = df.join(gone, F.col("dst") == F.col("_gone"), "left_anti")
        edges.append(replace(e, df=df))
    return replace(graph, nodes=nodes, edges=tuple(edges))


def delete_edges(graph: TemporalGraph, type_: str, ids: DataFrame) -> TemporalGraph:
    """Edges of ``type_`` whose ``EdgeTable.key()`` is in ``ids`` (key) go."""
    gone = ids.select(F.col("key").alias("_gone")).distinct()
    edges = tuple(replace(e, df=e.df.join(gone, e.key() == F.col("_gone"), "left_anti")) if e.type == type_ else e for e in graph.edges)
    return replace(graph, edges=edges)


def merge_nodes(graph: TemporalGraph, label: str, rows: DataFrame, key: str = "id") -> TemporalGraph:
    """Rows of ``rows`` whose key no node of ``label`` has are created; of repeated keys, one."""
    old = graph.nodes.get(label)
    rows = rows.dropDuplicates([key])
    if old is not None:
        rows = rows.join(old.df.select(F.col(key).alias("_have")), F.col(key) == F.col("_have"), "left_anti")
    return create_nodes(graph, label, rows)


def merge_edges(graph: TemporalGraph, type_: str, src_label: str, dst_label: str, rows: DataFrame) -> TemporalGraph:
    """Edges between ends that have none of ``type_`` yet are created."""
    rows = rows.dropDuplicates(["src", "dst"])
    for e in graph.edge_tables([type_], [src_label], [dst_label]):
        have = e.df.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        rows = rows.join(have, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti")
    return create_edges(graph, type_, src_label, dst_label, rows)


def missing_endpoints(edges: DataFrame, src_ids: DataFrame, dst_ids: DataFrame) -> DataFrame:
    """(src, dst, error) of edges whose source or target does not exist."""
    s, d = src_ids.select(F.col("id").alias("_s")).distinct(), dst_ids.select(F.col("id").alias("_d")).distinct()
    no_src = edges.join(s, F.col("src") == F.col("_s"), "left_anti").select("src", "dst", F.lit("SrcNodeNotFound").alias("error"))
    no_dst = edges.join(d, F.col("dst") == F.col("_d"), "left_anti").select("src", "dst", F.lit("DstNodeNotFound").alias("error"))
    return no_src.unionByName(no_dst)


def anachronisms(edges: DataFrame, created: DataFrame, end: str = "src", ts: str = "ts") -> DataFrame:
    """(src, dst, ts, error) of edges earlier than the creation (id, created) of the node at ``end``."""
    born = created.groupBy(F.col("id").alias("_n")).agg(F.min("created").alias("_born"))
    return edges.join(born, F.col(end) == F.col("_n")).where(F.col(ts) < F.col("_born")).select("src", "dst", ts, F.lit("TemporalAnachronism").alias("error"))


def updates_on_deleted(updates: DataFrame, lifecycle: DataFrame, width_us: int | None = None) -> DataFrame:
    """(id, ts, error) of updates (id, ts) whose entity is deleted by then; lifecycle: entity_id, ts, event.

    An as-of join: each update meets the newest event before it, not all of them; ``width_us`` cuts
    hot entities along time.
    """
    life = lifecycle.select(F.col("entity_id").alias("id"), F.col("ts").alias("_t"), F.col("event").alias("_state"), *(["seq"] if "seq" in lifecycle.columns else []))
    known = asof_join(updates.select("id", "ts"), life, ["id"], "ts", "_t", ["_state"], "seq" if "seq" in lifecycle.columns else None, width_us)
    return known.where(F.col("_state").isin("Deleted", "Purged")).select("id", "ts", F.lit("UpdateOnDeleted").alias("error")).distinct()


class Update:
    """A batch of writes applied at once, checked at one of ``LEVELS``.

    ``permissive`` checks nothing.  ``check_exists``: both ends of a new edge exist.
    ``strict_temporal``: also, no edge (column ``ts``) is older than an end (column ``valid_from``),
    and what is updated exists.  ``full_isolation``: also, nothing that the batch touches has
    changed in the graph it is applied to since the graph it was made for.  Nodes that the batch
    creates count as there for its edges and updates, nodes that it deletes as gone.
    """

    def __init__(self, graph: TemporalGraph, level: str = "permissive"):
        if level not in LEVELS:
            raise ValueError(level)
        self.graph, self.level = graph, level
        self.nodes: list[tuple[str, DataFrame]] = []
        self.edges: list[tuple[str, str, str, DataFrame]] = []
        self.changes: list[tuple[str, str, str, DataFrame]] = []
        self.gone_nodes: list[tuple[str, DataFrame]] = []
        self.gone_edges: list[tuple[str, DataFrame]] = []

    def create_nodes(self, label: str, rows: DataFrame) -> Update:
        self.nodes.append((label, rows))
        return self

    def create_edges(self, type_: str, src_label: str, dst_label: str, rows: DataFrame) -> Update:
        self.edges.append((type_, src_label, dst_label, rows))
        return self

    def update_nodes(self, label: str, prop: str, rows: DataFrame, value: str = "value") -> Update:
        """``prop`` of nodes (id, ``value``) of ``label``."""
        self.changes.append((label, prop, value, rows))
        return self

    def delete_nodes(self, label: str, ids: DataFrame) -> Update:
        """Nodes (id) and their edges."""
        self.gone_nodes.append((label, ids))
        return self

    def delete_edges(self, type_: str, rows: DataFrame) -> Update:
        """Edges of ``type_`` between (src, dst)."""
        self.gone_edges.append((type_, rows))
        return self

    def _there(self, label: str) -> DataFrame | None:
        """(id, created) of nodes that are there for the batch; None if nobody knows the label."""
        found = []
        for rows in [self.graph.nodes[label].df] * (label in self.graph.nodes) + [r for name, r in self.nodes if name == label]:
            found.append(rows.select("id", (F.col("valid_from") if "valid_from" in rows.columns else F.lit(None).cast("timestamp_ntz")).alias("created")))
        if not found:
            return None
        ids = found[0]
        for more in found[1:]:
            ids = ids.unionByName(more)
        for name, gone in self.gone_nodes:
            if name == label:
                ids = ids.join(gone.select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti")
        return ids.groupBy("id").agg(F.min("created").alias("created"))

    def violations(self, current: TemporalGraph | None = None) -> DataFrame | None:
        """(src, dst, id, error) of what stands against the batch; None where the level checks nothing.

        ``current`` is the graph to write to, as it is now (default: the one the batch was made for).
        """
        if self.level == "permissive":
            return None
        strict = self.level in ("strict_temporal", "full_isolation")
        found: list[DataFrame] = []
        of_edge = lambda df: df.select("src", "dst", F.lit(None).cast("bigint").alias("id"), "error")
        of_node = lambda df: df.select(F.lit(None).cast("bigint").alias("src"), F.lit(None).cast("bigint").alias("dst"), "id", "error")
        for _, src_label, dst_label, rows in self.edges:
            ends = [self._there(x) for x in (src_label, dst_label)]
            ends = [rows.limit(0).select(F.col("src").alias("id"), F.lit(None).cast("timestamp_ntz").alias("created")) if x is None else x for x in ends]
            found.append(of_edge(missing_endpoints(rows, *ends)))
            if strict and "ts" in rows.columns:
                found += [of_edge(anachronisms(rows, x.where("created IS NOT NULL"), end)) for end, x in zip(("src", "dst"), ends, strict=True)]
        if strict:
            for label, _, _, rows in self.changes:
                there, missing = self._there(label), rows
                if there is not None:
                    missing = rows.join(there.select(F.col("id").alias("_n")), F.col("id") == F.col("_n"), "left_anti")
                found.append(of_node(missing.select("id", F.lit("UpdateOnDeleted").alias("error"))))
        if self.level == "full_isolation" and current is not None and current is not self.graph:
            for label, ids in self._touched():
                before, after = (_prints(g, label) for g in (self.graph, current))
                both = before.join(after.withColumnRenamed("print", "_print").withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "full_outer")
                moved = both.where(~F.col("print").eqNullSafe(F.col("_print"))).select(F.coalesce("id", "_id").alias("id"))
                found.append(of_node(moved.join(ids.select(F.col("id").alias("_t")).distinct(), F.col("id") == F.col("_t"), "left_semi").select("id", F.lit("WriteConflict").alias("error"))))
        if not found:
            return None
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def _touched(self) -> list[tuple[str, DataFrame]]:
        """(label, ids) of nodes that the batch creates, changes, deletes or puts edges at."""
        out = [(label, rows.select("id")) for label, rows in [*self.nodes, *self.gone_nodes]]
        out += [(label, rows.select("id")) for label, _, _, rows in self.changes]
        for _, src_label, dst_label, rows in self.edges:
            out += [(src_label, rows.select(F.col("src").alias("id"))), (dst_label, rows.select(F.col("dst").alias("id")))]
        return out

    def apply(self, current: TemporalGraph | None = None) -> TemporalGraph:
        """The graph after the batch: nodes, then changes, then edges are written, then what is deleted goes."""
        bad = self.violations(current)
        if bad is not None and not bad.isEmpty():
            raise UpdateRejected(bad)
        graph = self.graph if current is None else current
        for label, rows in self.nodes:
            graph = create_nodes(graph, label, rows)
        for label, prop, value, rows in self.changes:
            graph = set_property(graph, label, rows, prop, value)
        for type_, src_label, dst_label, rows in self.edges:
            graph = create_edges(graph, type_, src_label, dst_label, rows)
        for type_, rows in self.gone_edges:
            ends = rows.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
            kept = tuple(replace(e, df=e.df.join(ends, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti")) if e.type == type_ else e for e in graph.edges)
            graph = replace(graph, edges=kept)
        for label, ids in self.gone_nodes:
            graph = delete_nodes(graph, label, ids)
        return graph


def _prints(graph: TemporalGraph, label: str) -> DataFrame:
    """(id, print): a hash of each node's properties, by name."""
    if label not in graph.nodes:
        return graph.spark.createDataFrame([], "id long, print string")
    df = graph.nodes[label].df
    named = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in sorted(df.columns)]
    return df.groupBy("id").agg(F.sum(F.xxhash64(*named).cast("decimal(38,0)")).cast("string").alias("print"))


def retention(df: DataFrame, keep_from: Column, end: str = "valid_to") -> DataFrame:
    """Rows whose interval has not ended before ``keep_from``."""
    return df.where(F.col(end).isNull() | (F.col(end) >= keep_from))


def to_cold_storage(df: DataFrame, keep_from: Column, path: str, end: str = "valid_to") -> DataFrame:
    """``retention``, after the rows that it drops were appended to the Parquet table at ``path``."""
    df.where(F.col(end) < keep_from).write.mode("append").parquet(path)
    return retention(df, keep_from, end)

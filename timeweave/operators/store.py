"""An append-only store of cells: property versions, edges and lifecycle events.

A cell is (entity_id, column, ts, seq, op, value); edges go to a log of (src, dst, type, ts, seq,
op) and lifecycle marks to (entity_id, ts, event).  Writing appends; reading folds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.functions.temporal import at
from timeweave.operators import fold

CELLS = "entity_id long, column string, ts timestamp_ntz, seq long, op string, value string"
EDGES = "src long, dst long, type string, ts timestamp_ntz, seq long, op string, props map<string,string>"
LIFE = "entity_id long, ts timestamp_ntz, event string"
#: When a static property is written: before every moment that can be asked for.
STATIC = "1970-01-01T00:00:00.000001"


@dataclass(frozen=True)
class Store:
    cells: DataFrame
    edges: DataFrame
    life: DataFrame
    seq: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        return cls(*[spark.createDataFrame([], s) for s in (CELLS, EDGES, LIFE)])

    # writes

    def put(self, rows: DataFrame, op: str = "CREATE") -> Store:
        """``rows``: entity_id, column, ts, value.  Later puts win ties."""
        new = rows.select("entity_id", "column", "ts", F.lit(self.seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.col("value").cast("string").alias("value"))
        return replace(self, cells=self.cells.unionByName(new), seq=self.seq + 1)

    def put_static(self, rows: DataFrame) -> Store:
        """``rows``: entity_id, column, value."""
        return self.put(rows.withColumn("ts", at(STATIC)))

    def delete(self, rows: DataFrame) -> Store:
        """``rows``: entity_id, column, ts."""
        return self.put(rows.withColumn("value", F.lit(None).cast("string")), "DELETE")

    def put_edges(self, rows: DataFrame, op: str = "CREATE") -> Store:
        """``rows``: src, dst, type, ts and perhaps props.  One row serves both directions."""
        props = F.col("props") if "props" in rows.columns else F.lit(None).cast("map<string,string>")
        new = rows.select("src", "dst", "type", "ts", F.lit(self.seq).cast("long").alias("seq"), F.lit(op).alias("op"), props.alias("props"))
        return replace(self, edges=self.edges.unionByName(new), seq=self.seq + 1)

    def delete_edges(self, rows: DataFrame) -> Store:
        return self.put_edges(rows, "DELETE")

    def mark(self, rows: DataFrame, event: str) -> Store:
        """``rows``: entity_id, ts; ``event``: Created, Deleted, Recreated or Purged."""
        return replace(self, life=self.life.unionByName(rows.select("entity_id", "ts", F.lit(event).alias("event"))))

    # reads

    def get(self, when) -> DataFrame:
        """(entity_id, column, ts, value): each property's value at ``when``."""
        return fold.fold(self.cells, ["entity_id", "column"], as_of=when).select("entity_id", "column", "ts", "value")

    def scan(self, start, end, entity=None, column: str | None = None) -> DataFrame:
        """Cells in [start, end], of one entity and of one column if these are named; newest first within an entity."""
        rows = self.cells.where(F.col("ts").between(at(start), at(end)))
        if entity is not None:
            rows = rows.where(F.col("entity_id") == entity)
        if column is not None:
            rows = rows.where(F.col("column") == column)
        return rows.repartition("entity_id").sortWithinPartitions("entity_id", F.col("ts").desc(), F.col("seq").desc())

    def neighbors(self, when, vertex=None, direction: str = "out", type_: str | None = None) -> DataFrame:
        """(src, dst, type, ts): edges at ``when``; a delete wins, and types do not hide one another."""
        rows = self.edges if type_ is None else self.edges.where(F.col("type") == type_)
        if vertex is not None:
            rows = rows.where(F.col("src" if direction == "out" else "dst") == vertex)
        return fold.fold(rows, ["src", "dst", "type"], as_of=when).select("src", "dst", "type", "ts")

    def alive(self, when) -> DataFrame:
        return fold.active_entities(self.life, when)

    def compact(self, before) -> Store:
        """The same store without cells that no question from ``before`` on can reach."""
        t = at(before)
        newest = F.max(F.when(F.col("ts") <= t, F.struct("ts", "seq"))).over(W.partitionBy("entity_id", "column"))
        kept = self.cells.withColumn("_n", newest).where((F.col("ts") > t) | (F.struct("ts", "seq") == F.col("_n"))).drop("_n")
        return replace(self, cells=kept)

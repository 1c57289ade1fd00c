"""Spaces kept as Parquet: a graph's tables under one folder, found again by name."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from timeweave.graph import TemporalGraph


def save_graph(graph: TemporalGraph, path: str, partition_edges_by: tuple[str, ...] = ()) -> None:
    """Write every table of ``graph`` below ``path``, and what they are to ``path/schema``."""
    entries = []
    for t in graph.nodes.values():
        entries.append({"kind": "node", "label": t.label, "at": f"nodes/{t.label}"})
        t.df.write.mode("overwrite").parquet(f"{path}/nodes/{t.label}")
    for i, e in enumerate(graph.edges):
        entries.append({"kind": "edge", "type": e.type, "src": e.src_label, "dst": e.dst_label, "at": f"edges/{i}_{e.type}"})
        writer = e.df.write.mode("overwrite")
        (writer.partitionBy(*partition_edges_by) if partition_edges_by else writer).parquet(f"{path}/edges/{i}_{e.type}")
    graph.spark.createDataFrame([(json.dumps(x),) for x in entries], "entry string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def load_graph(spark: SparkSession, path: str, name: str = "default") -> TemporalGraph:
    graph = TemporalGraph(spark, name=name)
    for row in spark.read.text(f"{path}/schema").collect():
        x = json.loads(row[0])
        df = spark.read.parquet(f"{path}/{x['at']}")
        graph = graph.with_nodes(x["label"], df) if x["kind"] == "node" else graph.with_edges(x["type"], x["src"], x["dst"], df)
    return graph

"""How tables are dealt into parts: by key, by range, by hour, and by temporal affinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def static_hash(key: Column, parts: int) -> Column:
    """``key`` modulo ``parts``, never negative."""
    return F.pmod(key, F.lit(parts)).cast("int")


def hour_bucket(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(3_600_000_000)).cast("bigint")


def write_partitioned(df: DataFrame, path: str, key: str, parts: int, ts: str | None = None) -> None:
    """Parquet in folders by part (and day of ``ts``), sorted by key, so that scans prune folders and row groups."""
    out = df.withColumn("part", static_hash(F.col(key), parts))
    folders = ["part"]
    if ts is not None:
        out = out.withColumn("day", F.to_date(ts))
        folders.append("day")
    out.repartition(*folders).sortWithinPartitions(key).write.partitionBy(*folders).mode("overwrite").parquet(path)


def affinity_scores(edges: DataFrame, placed: DataFrame, now: Column, half_life_us: int, topo: float = 1.0, temporal: float = 1.0, balance: float = 0.5) -> DataFrame:
    """(id, part, score) for vertices with neighbours in ``placed`` (id, part).

    A part scores by how many of the vertex's neighbours it holds, by how recent their edges (src,
    dst, ts) are, each halving in weight every ``half_life_us``, and against how full it is.
    """
    both = edges.select("src", "dst", "ts").union(edges.select("dst", "src", "ts"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(float(half_life_us))
    near = both.join(placed.select(F.col("id").alias("_p"), "part"), F.col("dst") == F.col("_p"))
    found = near.groupBy(F.col("src").alias("id"), "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)))).alias("fresh"))
    load = placed.groupBy(F.col("part").alias("_l")).agg(F.count(F.lit(1)).alias("load"))
    load = load.withColumn("share", F.col("load") / F.sum("load").over(W.partitionBy(F.lit(1))))
    of = W.partitionBy("id")
    scored = found.join(load, F.col("part") == F.col("_l"))
    score = topo * F.col("n") / F.sum("n").over(of) + temporal * F.col("fresh") / F.sum("fresh").over(of) - balance * F.col("share")
    return scored.select("id", "part", score.alias("score"))


def place(edges: DataFrame, placed: DataFrame, now: Column, half_life_us: int, **weights: float) -> DataFrame:
    """(id, part): the best-scoring part of each vertex, the smallest of equals."""
    best = affinity_scores(edges, placed, now, half_life_us, **weights).groupBy("id").agg(F.max(F.struct("score", (-F.col("part")).alias("_p"))).alias("_b"))
    return best.select("id", (-F.col("_b._p")).alias("part"))


def commit_path(txns: DataFrame, parts: int, window_us: int) -> DataFrame:
    """(txn_id, path) of transactions (txn_id, key, at): single-partition, same-window or cross-window, by what they touch."""
    seen = txns.groupBy("txn_id").agg(F.count_distinct(static_hash(F.col("key"), parts)).alias("p"), F.count_distinct(F.floor(F.col("at") / F.lit(window_us))).alias("w"))
    path = F.when(F.col("p") == 1, "single-partition").when(F.col("w") == 1, "same-window").otherwise("cross-window")
    return seen.select("txn_id", path.alias("path"))

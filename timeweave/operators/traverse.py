"""Neighbours, breadth-first search, components, shortest paths, PageRank, path enumeration.

Edges are DataFrames with ``src`` and ``dst``.  Each round of an iterative algorithm is one join
with the edges; its result is written to the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where that is unset on a local master a temporary folder is made and filled in; on a cluster
    an unset folder is an error, for executors share no other.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="timeweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written once, as Parquet in the shared folder, and read back.

    That cuts the lineage and survives lost executors.  The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/timeweave-graph-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def simple(edges: DataFrame) -> DataFrame:
    """Different (src, dst) without loops."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges from ``src`` to ``dst`` in the direction of travel: out, in or both."""
    swap = {"src": "dst", "dst": "src"}
    back = edges.select(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns])
    return edges if direction == "out" else back if direction == "in" else edges.unionByName(back.where("src <> dst"))


def neighbors(edges: DataFrame, vertex, direction: str = "out", limit: int | None = None, where: Column | None = None) -> DataFrame:
    """(src, dst, ...) of the edges of one vertex, of a few, or of a table of them (its first column).

    ``where`` is a condition on the edges; ``limit`` counts per vertex after it, smallest dst first.
    """
    found = oriented(edges, direction)
    if isinstance(vertex, DataFrame):
        wanted = vertex.select(F.col(vertex.columns[0]).alias("_want")).distinct()
        found = found.join(wanted, F.col("src") == F.col("_want"), "left_semi")
    else:
        many = list(vertex) if isinstance(vertex, Iterable) and not isinstance(vertex, str) else [vertex]
        found = found.where(F.col("src").isin(*many))
    if where is not None:
        found = found.where(where)
    if limit is None:
        return found
    rank = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    return found.withColumn("_n", rank).where(F.col("_n") <= limit).drop("_n")


def degree_centrality(edges: DataFrame, vertices: DataFrame, direction: str = "out") -> DataFrame:
    """(id, degree) of every row of ``vertices`` (id); 0 without edges."""
    counts = oriented(edges, direction).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def bfs(edges: DataFrame, start: DataFrame, max_depth: int | None, direction: str = "out") -> DataFrame:
    """(id, depth): vertices within ``max_depth`` (None: any number) of any of ``start`` (id), at the depth they are first reached; the start has 0."""
    step = checkpoint(simple(oriented(edges, direction)))
    seen = start.select("id").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    front = seen
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        reached = front.join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front = checkpoint(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth).cast("bigint")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def khop(edges: DataFrame, start: DataFrame, k: int, direction: str = "out") -> DataFrame:
    """(id) first reached at exactly ``k`` hops."""
    return bfs(edges, start, k, direction).where(F.col("depth") == k).select("id")


def shortest_path(edges: DataFrame, source, target, max_depth: int = 10, direction: str = "out") -> DataFrame:
    """(source, target, distance, path): one row, or none if ``target`` is not within ``max_depth``.

    The search stops at the depth that reaches it.  Of several shortest paths it is the one whose
    last but one vertex is smallest, then the one before that, and so on.
    """
    step = checkpoint(simple(oriented(edges, direction)))
    spark = edges.sparkSession
    start = spark.range(1).select(F.lit(source).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("by"))
    levels, seen, front, distance = [start], start.select("id"), start, 0 if source == target else None
    for depth in range(1, max_depth + 1):
        if distance is not None:
            break
        reached = front.select("id").join(step, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min("src").alias("by"))
        front = checkpoint(reached.select(F.col("to").alias("id"), "by").join(seen, "id", "left_anti"))
        levels.append(front)
        if not front.where(F.col("id") == target).isEmpty():
            distance = depth
        elif front.isEmpty():
            break
        seen = seen.unionByName(front.select("id"))
    if distance is None:
        return start.limit(0).select(F.col("id").alias("source"), F.col("id").alias("target"), F.col("id").alias("distance"), F.array("id").alias("path"))
    back = spark.range(1).select(F.array(F.lit(target).cast("bigint")).alias("path"))
    for level in reversed(levels[1 : distance + 1]):
        back = back.join(level, F.get("path", F.lit(0)) == F.col("id")).select(F.concat(F.array("by"), "path").alias("path"))
    return back.select(F.lit(source).cast("bigint").alias("source"), F.lit(target).cast("bigint").alias("target"), F.lit(distance).cast("bigint").alias("distance"), "path")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each undirected component, over vertices with edges.

    Neighbour minima and pointer jumping: a few rounds even on long chains.
    """
    both = checkpoint(simple(oriented(edges, "both")))
    labels = both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component"))
    while True:
        labels = checkpoint(labels)
        near = both.join(labels, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("n")).agg(F.min("component").alias("least"))
        step = labels.join(near, F.col("id") == F.col("n")).select("id", F.col("component").alias("old"), F.least("component", "least").alias("mid"))
        far = labels.select(F.col("id").alias("j"), F.col("component").alias("far"))
        new = checkpoint(step.join(far, F.col("mid") == F.col("j")).select("id", "old", F.least("mid", "far").alias("component")))
        labels = new.select("id", "component")
        if new.where("old <> component").isEmpty():
            return labels


def directed_components(edges: DataFrame, seeds: list, max_depth: int | None = None) -> DataFrame:
    """(id, seed): what each seed in turn reaches along edges that no earlier one reached."""
    taken = None
    for seed in seeds:
        start = edges.sparkSession.range(1).select(F.lit(seed).cast("bigint").alias("id"))
        found = bfs(edges, start, max_depth).select("id", F.lit(seed).cast("bigint").alias("seed"))
        taken = found if taken is None else taken.unionByName(found.join(taken.select("id"), "id", "left_anti"))
    return taken


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank) after a fixed number of rounds over different (src, dst); the rank of vertices without out-edges is lost."""
    links = checkpoint(simple(edges))
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    weighted = checkpoint(links.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("n")).alias("w")))
    vertices = checkpoint(weighted.select(F.col("src").alias("id")).union(weighted.select("dst")).distinct())
    total = vertices.count()
    ranks = vertices.withColumn("rank", F.lit(1.0 / max(total, 1)))
    for i in range(iterations):
        sent = weighted.join(ranks, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        ranks = vertices.join(sent, F.col("id") == F.col("v"), "left").select("id", (F.lit((1 - damping) / max(total, 1)) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 3 == 2:
            ranks = checkpoint(ranks)
    return ranks


def paths(edges: DataFrame, start: DataFrame, depth: int, direction: str = "out", branch: int | None = None) -> DataFrame:
    """(path): simple vertex paths of exactly ``depth`` edges from each of ``start`` (id); ``branch`` limits a step's choices, smallest first."""
    step = simple(oriented(edges, direction))
    if branch is not None:
        step = step.withColumn("_n", F.row_number().over(W.partitionBy("src").orderBy("dst"))).where(F.col("_n") <= branch).drop("_n")
    found = start.select(F.array("id").alias("path"))
    for _ in range(depth):
        on = (F.element_at("path", -1) == F.col("src")) & ~F.array_contains("path", F.col("dst"))
        found = found.join(step, on).select(F.concat("path", F.array("dst")).alias("path"))
    return found


def triangles_in_window(edges: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """(a, b, c): directed cycles a->b->c->a of edges in [start, end), the smallest vertex first.

    Pairs of neighbours are pointed from the vertex of smaller degree to the other.  So a hub's
    wedges start at its many small neighbours, and no vertex points to more than about the square
    root of twice the number of pairs.
    """
    from timeweave.functions.temporal import at

    e = simple(edges.where((F.col(ts) >= at(start)) & (F.col(ts) < at(end))))
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = e.groupBy(low.alias("u"), high.alias("v")).agg(F.max(F.col("src") < F.col("dst")).alias("up"), F.max(F.col("src") > F.col("dst")).alias("down"))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    sized = pairs.join(ends.select(F.col("id").alias("u"), F.col("n").alias("nu")), "u").join(ends.select(F.col("id").alias("v"), F.col("n").alias("nv")), "v")
    first = F.struct("nu", "u") < F.struct("nv", "v")
    # x -> y of the pointed pair; ``there`` says whether the edge x->y is among the edges, ``back`` whether y->x is
    pointed = sized.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("y"), F.when(first, F.col("up")).otherwise(F.col("down")).alias("there"), F.when(first, F.col("down")).otherwise(F.col("up")).alias("back"))
    one, two, three = ((pointed.select(*[F.col(c).alias(n) for c, n in zip(("x", "y", "there", "back"), names, strict=True)])) for names in (("x", "y", "xy", "yx"), ("x", "z", "xz", "zx"), ("y", "z", "yz", "zy")))
    found = one.join(two, "x").where("y <> z").join(three, ["y", "z"])
    cycles = F.array(F.when(F.col("xy") & F.col("yz") & F.col("zx"), F.array("x", "y", "z")), F.when(F.col("xz") & F.col("zy") & F.col("yx"), F.array("x", "z", "y")))
    each = found.select(F.explode(F.filter(cycles, lambda c: c.isNotNull())).alias("c"))
    at_least = F.array_position("c", F.array_min("c")) - 1
    turned = each.select(F.concat(F.slice("c", at_least + 1, 3), F.slice("c", F.lit(1), at_least)).alias("c"))
    return turned.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate("abc")])


SEMANTICS = {
    "snapshot": lambda vf, vt, s, e: (vf <= e) & (vt.isNull() | (vt > s)),
    "continuous": lambda vf, vt, s, e: (vf <= s) & (vt.isNull() | (vt > e)),
    "pairwise": lambda vf, vt, s, e: (vf < e) & (vt.isNull() | (vt > s)),
    "sequential": lambda vf, vt, s, e: vf.isNotNull(),
}


def temporal_paths(edges: DataFrame, start, end, hops: int, semantics: str = "snapshot") -> DataFrame:
    """(path, valid_from, valid_to) of walks of ``hops`` edges with [valid_from, valid_to).

    Every edge meets the semantics' predicate on [start, end].  In a continuous walk all edges are
    valid together at some time, which is returned; in a pairwise one adjacent edges overlap.
    """
    from timeweave.functions.temporal import at

    s, e = at(start), at(end)
    ok = edges.where(SEMANTICS[semantics](F.col("valid_from"), F.col("valid_to"), s, e)).select("src", "dst", "valid_from", "valid_to")
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    step = ok.select("src", "dst", F.col("valid_from").alias("_f"), F.coalesce("valid_to", F.lit(far)).alias("_t"))
    found = step.select(F.array("src", "dst").alias("path"), F.col("_f").alias("lo"), F.col("_t").alias("hi"), F.col("_f").alias("pf"), F.col("_t").alias("pt"))
    for _ in range(hops - 1):
        on = F.element_at("path", -1) == F.col("src")
        if semantics == "continuous":
            on = on & (F.greatest("lo", "_f") < F.least("hi", "_t"))
        elif semantics == "pairwise":
            on = on & (F.col("pt") > F.col("_f")) & (F.col("_t") > F.col("pf"))
        elif semantics == "sequential":
            on = on & (F.col("_f") >= F.col("pf"))
        joined = found.join(step, on)
        found = joined.select(F.concat("path", F.array("dst")).alias("path"), F.greatest("lo", "_f").alias("lo"), F.least("hi", "_t").alias("hi"), F.col("_f").alias("pf"), F.col("_t").alias("pt"))
    return found.select("path", F.col("lo").alias("valid_from"), F.col("hi").alias("valid_to"))


def gathered(edges: DataFrame, *facts: Column) -> DataFrame:
    """(src, dst, edges): each pair once, its parallel edges as an array of structs of ``facts``."""
    return edges.groupBy("src", "dst").agg(F.collect_list(F.struct(*facts)).alias("edges"))


def count_pairs(one: Column, two: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """How many pairs of an element of the array ``one`` and one of ``two`` there are that ``fits``."""
    none = F.lit(0).cast("bigint")
    first, other = F.get(one, F.lit(0)), F.get(two, F.lit(0))
    many = F.aggregate(one, none, lambda n, x: n + F.size(F.filter(two, lambda y: fits(x, y))))
    return F.when((F.size(one) == 1) & (F.size(two) == 1), F.when(fits(first, other), none + 1).otherwise(none)).otherwise(many)


def temporal_path_counts(edges: DataFrame, start, end, semantics: str = "snapshot") -> DataFrame:
    """(a, b, c, n): the different vertices of ``temporal_paths`` of two edges, and how many walks pass each.

    Parallel edges are gathered before the join, so that it gives each path once and nothing is
    grouped after it: a task holds no table of paths.
    """
    from timeweave.functions.temporal import at

    ok = edges.where(SEMANTICS[semantics](F.col("valid_from"), F.col("valid_to"), at(start), at(end)))
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    pairs = gathered(ok, F.col("valid_from").alias("f"), F.coalesce("valid_to", far).alias("t"))
    fits = {
        "continuous": lambda x, y: F.greatest(x["f"], y["f"]) < F.least(x["t"], y["t"]),
        "pairwise": lambda x, y: (x["t"] > y["f"]) & (y["t"] > x["f"]),
        "sequential": lambda x, y: y["f"] >= x["f"],
    }
    one = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("edges").alias("_one"))
    two = pairs.select(F.col("src").alias("_b"), F.col("dst").alias("c"), F.col("edges").alias("_two"))
    count = count_pairs(F.col("_one"), F.col("_two"), fits[semantics]) if semantics in fits else F.size("_one").cast("bigint") * F.size("_two")
    return one.join(two, F.col("b") == F.col("_b")).select("a", "b", "c", count.alias("n")).where("n > 0")

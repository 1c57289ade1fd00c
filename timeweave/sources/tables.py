"""Table readers, and the graph view of the order, event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.graph import TemporalGraph
from timeweave.operators.fold import intervals


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Any file format Spark reads; text formats take a schema rather than inferring one."""
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif format == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item, ts, seq, op, kind, value): the user-item log; an error event deletes."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("item"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("CREATE").alias("op"),
        F.col("event_type").alias("kind"),
        "value",
    )


def user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, seq, value, kind, valid_from, valid_to, version): a user's value between one event and the next."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"), "value", F.col("event_type").alias("kind"))
    return intervals(e, ["user_id"])


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, ts): different links between users of one id space; ts is the first."""
    log = event_log(spark, sf_dir).where("item IS NOT NULL AND user_id <> item")
    return log.groupBy(F.col("user_id").alias("src"), F.col("item").alias("dst")).agg(F.min("ts").alias("ts"))


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, ts, event): purchases create users again, errors delete them, signups create them."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "purchase", "Recreated").when(F.col("event_type") == "error", "Deleted")
    return e.select(F.col("user_id").alias("entity_id"), "ts", kind.alias("event")).where("event IS NOT NULL")


def shop_graph(spark: SparkSession, sf_dir: str) -> TemporalGraph:
    """Customers, orders, parts, suppliers, nations, regions and users, with the relationships between them.

    Orders and order edges are valid from their date on; a user's state from one event to the
    next.  LINKS is the simple digraph over users and items of one id space.
    """
    t = lambda name: table(spark, sf_dir, name)
    never = F.lit(None).cast("timestamp_ntz")
    orders, items = t("orders"), t("lineitem")
    graph = (
        TemporalGraph(spark, name="shop")
        .with_nodes("Customer", t("customer").withColumn("id", F.col("c_custkey")))
        .with_nodes("Order", orders.withColumn("id", F.col("o_orderkey")).withColumn("valid_from", F.col("o_orderdate")).withColumn("valid_to", never))
        .with_nodes("Part", t("part").withColumn("id", F.col("p_partkey")))
        .with_nodes("Supplier", t("supplier").withColumn("id", F.col("s_suppkey")))
        .with_nodes("Nation", t("nation").withColumn("id", F.col("n_nationkey").cast("bigint")))
        .with_nodes("Region", t("region").withColumn("id", F.col("r_regionkey").cast("bigint")))
        .with_nodes("State", user_history(spark, sf_dir).withColumn("id", F.col("user_id")))
    )
    placed = orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderkey").alias("edge_id"), F.col("o_orderdate").alias("valid_from"), never.alias("valid_to"))
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    contains = items.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), line.alias("edge_id"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("valid_from"), never.alias("valid_to"))
    supplied = items.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), line.alias("edge_id"), F.col("l_shipdate").alias("valid_from"), never.alias("valid_to"))
    of_nation = lambda df, key, nation: df.select(F.col(key).alias("src"), F.col(nation).cast("bigint").alias("dst"), F.col(key).alias("edge_id"))
    links = link_edges(spark, sf_dir)
    people = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    events = event_log(spark, sf_dir)
    acted = intervals(events.where("item IS NOT NULL"), ["user_id", "item"]).select(F.col("user_id").alias("src"), F.col("item").alias("dst"), F.col("seq").alias("edge_id"), "kind", "op", "value", "valid_from", "valid_to", "version")
    return (
        graph.with_nodes("Person", people)
        .with_edges("PLACED", "Customer", "Order", placed)
        .with_edges("CONTAINS", "Order", "Part", contains)
        .with_edges("SUPPLIED_BY", "Order", "Supplier", supplied)
        .with_edges("IN_NATION", "Customer", "Nation", of_nation(t("customer"), "c_custkey", "c_nationkey"))
        .with_edges("IN_NATION", "Supplier", "Nation", of_nation(t("supplier"), "s_suppkey", "s_nationkey"))
        .with_edges("IN_REGION", "Nation", "Region", of_nation(t("nation").withColumn("n_nationkey", F.col("n_nationkey").cast("bigint")), "n_nationkey", "n_regionkey"))
        .with_edges("LINKS", "Person", "Person", links)
        .with_edges("ACTED", "Person", "Person", acted)
    )

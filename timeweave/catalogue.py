"""The registered queries of the graph engine, each with SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.functions.aggregates import temporal_avg
from timeweave.functions.temporal import at, format_iso8601, micros, parse_duration
from timeweave.graph import TemporalGraph
from timeweave.operators import fold, intervals, partitioning, scans, traverse, writes
from timeweave.operators.store import Store
from timeweave.operators.traverse import shared_folder
from timeweave.session import GraphSession
from timeweave.sources.tables import event_log, lifecycle, link_edges, shop_graph, table, user_history
from timeweave.streaming import cdc, windows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions the SQL below starts from.
ELOG = "elog AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'CREATE' END AS op, event_type AS kind, value FROM events)"
LINKS = f"{ELOG}, links AS (SELECT user_id AS src, item AS dst, min(ts) AS ts FROM elog WHERE item IS NOT NULL AND user_id <> item GROUP BY 1, 2)"
HIST = "hist AS (SELECT user_id, ts, event_id AS seq, value, event_type AS kind, ts AS valid_from, lead(ts) OVER w AS valid_to, row_number() OVER w - 1 AS version FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
LIFE = "life AS (SELECT user_id AS entity_id, ts, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'purchase' THEN 'Recreated' WHEN 'error' THEN 'Deleted' END AS event FROM events WHERE event_type IN ('signup', 'purchase', 'error'))"
ACTED = f"{ELOG}, acted AS (SELECT user_id AS src, item AS dst, kind, op, value, ts AS valid_from, lead(ts) OVER w AS valid_to, row_number() OVER w - 1 AS version, seq FROM elog WHERE item IS NOT NULL WINDOW w AS (PARTITION BY user_id, item ORDER BY ts, seq))"
MOMENT, LATER = "2024-01-15T00:00:00", "2024-01-20T00:00:00"


def text_query(name: str, text: str, sql: str, **params) -> None:
    """Register a query in the graph language over the shop graph."""
    QUERIES[name] = lambda spark, sf_dir: shop_graph(spark, sf_dir).cypher(text, **params)
    ORACLE_SQL[name] = sql


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# scans

text_query("scan_label", "MATCH (n:Nation) RETURN n.id AS id, n.n_name AS name", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
text_query("scan_point", "MATCH (o:Order {id: 7}) RETURN o.id AS id, o.o_totalprice AS price", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey = 7")
text_query("scan_between", "MATCH (o:Order) WHERE o.id >= 100 AND o.id <= 200 RETURN o.id AS id, o.o_orderstatus AS status", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
text_query("batch_get", "MATCH (c:Customer) WHERE c.id IN $ids RETURN c.id AS id, c.c_name AS name", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (1, 5, 9, 1000000)", ids=[1, 5, 9, 1000000])
text_query("scan_all_nodes", "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n",
    f"WITH {LINKS} SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'State', count(*) FROM events UNION ALL SELECT 'Person', count(*) FROM (SELECT src FROM links UNION SELECT dst FROM links)")
text_query("scan_property", "MATCH (p:Part) WHERE p.p_brand = 'Brand#7' RETURN p.id AS id, p.p_size AS size", "SELECT p_partkey AS id, p_size AS size FROM part WHERE p_brand = 'Brand#7'")

# filters and predicates

text_query("filter_cmp", "MATCH (p:Part) WHERE p.p_size > 20 AND p.p_size <> 30 AND p.p_retailprice < 1000 RETURN p.id AS id", "SELECT p_partkey AS id FROM part WHERE p_size > 20 AND p_size <> 30 AND p_retailprice < 1000")
text_query("filter_and_or_not_3vl",
    "UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS x, a OR b AS y, NOT a AS z, a XOR b AS w",
    "SELECT a, b, a AND b AS x, a OR b AS y, NOT a AS z, (a OR b) AND NOT (a AND b) AS w FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) t(a), (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) u(b)")
text_query("filter_str_preds", "MATCH (p:Part) WHERE p.p_name STARTS WITH 'red' OR p.p_name ENDS WITH 'bolt' OR p.p_name CONTAINS 'll w' RETURN p.id AS id, p.p_name AS name", "SELECT p_partkey AS id, p_name AS name FROM part WHERE starts_with(p_name, 'red') OR ends_with(p_name, 'bolt') OR contains(p_name, 'll w')")
text_query("filter_is_null",
    "MATCH (c:Customer) WITH c.id AS id, CASE WHEN c.id % 3 = 0 THEN c.c_name END AS name WHERE name IS NULL OR name IS NOT NULL RETURN id, name IS NULL AS missing, name IS NOT NULL AS present, name = 'x' AS eq",
    "SELECT c_custkey AS id, c_custkey % 3 <> 0 AS missing, c_custkey % 3 = 0 AS present, CASE WHEN c_custkey % 3 = 0 THEN c_name = 'x' END AS eq FROM customer")
text_query("filter_in", "MATCH (c:Customer) WHERE c.c_mktsegment IN ['BUILDING', 'MACHINERY'] AND NOT c.id IN [1, 2, 3] RETURN c.id AS id", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey NOT IN (1, 2, 3)")
text_query("filter_precedence", "MATCH (p:Part) WHERE NOT p.p_size < 10 AND p.p_size < 20 OR p.p_size = 1 + 2 * 3 RETURN p.id AS id", "SELECT p_partkey AS id FROM part WHERE (NOT p_size < 10 AND p_size < 20) OR p_size = 7")
text_query("filter_regex", "MATCH (p:Part) WHERE p.p_brand =~ 'Brand#1.*' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE regexp_full_match(p_brand, 'Brand#1.*')")
text_query("filter_missing_property", "MATCH (n:Nation) WHERE n.nothing IS NULL RETURN count(*) AS n, count(n.nothing) AS k", "SELECT count(*) AS n, 0::BIGINT AS k FROM nation")
text_query("filter_parameter", "MATCH (c:Customer) WHERE c.c_acctbal > $low AND c.c_mktsegment = $segment RETURN c.id AS id, c.c_acctbal AS balance", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000.5 AND c_mktsegment = 'BUILDING'", low=5000.5, segment="BUILDING")

# projection

text_query("project_expr", "MATCH (o:Order) RETURN o.id AS id, o.o_totalprice * 2 + 1 AS x, o.id / 7 AS q, o.id % 7 AS r, -o.id AS neg, o.o_orderstatus + '-' + o.o_orderpriority AS tag",
    "SELECT o_orderkey AS id, o_totalprice * 2 + 1 AS x, o_orderkey // 7 AS q, o_orderkey % 7 AS r, -o_orderkey AS neg, o_orderstatus || '-' || o_orderpriority AS tag FROM orders")
text_query("return_distinct", "MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS status, o.o_orderpriority AS priority", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
text_query("return_star", "MATCH (r:Region) WITH r.id AS id, r.r_name AS name RETURN *", "SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region")
text_query("with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.id AS id, count(*) AS n, sum(o.o_totalprice) AS total WHERE n > 12 RETURN id, n, round(total) AS total", "SELECT o_custkey AS id, count(*) AS n, round(sum(o_totalprice))::BIGINT AS total FROM orders GROUP BY 1 HAVING count(*) > 12")
text_query("case_when", "MATCH (p:Part) RETURN p.id AS id, CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'medium' ELSE 'large' END AS size, CASE p.p_type WHEN 'ECONOMY' THEN 1 ELSE 0 END AS economy",
    "SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, CASE p_type WHEN 'ECONOMY' THEN 1::BIGINT ELSE 0::BIGINT END AS economy FROM part")
text_query("relationship_property", "MATCH (o:Order {id: 3})-[r:CONTAINS]->(p:Part) RETURN p.id AS part, r.qty AS qty, r.price AS price, type(r) AS kind", "SELECT l_partkey AS part, l_quantity AS qty, l_extendedprice AS price, 'CONTAINS' AS kind FROM lineitem WHERE l_orderkey = 3")

# expansion and joins

text_query("expand_out", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 RETURN c.c_mktsegment AS seg, count(*) AS n ORDER BY n DESC, seg LIMIT 5",
    "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000 GROUP BY 1 ORDER BY n DESC, seg LIMIT 5")
text_query("expand_in", "MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE c.c_acctbal < 0 RETURN o.id AS id, c.id AS customer", "SELECT o_orderkey AS id, c_custkey AS customer FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0")
text_query("expand_both", "MATCH (a:Person)-[:LINKS]-(b:Person) WHERE a.id = 5 RETURN b.id AS id, count(*) AS n", f"WITH {LINKS} SELECT id, count(*) AS n FROM (SELECT dst AS id FROM links WHERE src = 5 UNION ALL SELECT src FROM links WHERE dst = 5) GROUP BY 1")
text_query("expand_two_hop", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer) RETURN r.r_name AS region, count(*) AS n, round(sum(c.c_acctbal)) AS balance",
    "SELECT r_name AS region, count(*) AS n, round(sum(c_acctbal))::BIGINT AS balance FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
text_query("expand_untyped", "MATCH (n:Nation {id: 3})<-[r]-(x) RETURN type(r) AS kind, labels(x)[0] AS label, count(*) AS n", "SELECT 'IN_NATION' AS kind, 'Customer' AS label, count(*) AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'IN_NATION', 'Supplier', count(*) FROM supplier WHERE s_nationkey = 3")
text_query("expand_unique_relationships", "MATCH (a:Person)-[:LINKS]-(b:Person)-[:LINKS]-(c:Person) WHERE a.id = 5 AND c.id = 5 RETURN count(*) AS n",
    f"WITH {LINKS}, both_ways AS (SELECT src AS a, dst AS b, src, dst FROM links UNION ALL SELECT dst, src, src, dst FROM links) SELECT count(*) AS n FROM both_ways x JOIN both_ways y ON x.b = y.a WHERE x.a = 5 AND y.b = 5 AND NOT (x.src = y.src AND x.dst = y.dst)")
text_query("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 450000 RETURN c.id AS id, count(o) AS n, max(o.o_totalprice) AS top",
    "SELECT c_custkey AS id, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000 GROUP BY 1")
text_query("multi_pattern_join", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) WHERE c.c_acctbal > 9000 RETURN n.n_name AS nation, count(*) AS pairs",
    "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY 1")
text_query("cross_pattern", "MATCH (r:Region), (n:Nation) WHERE n.id < 3 RETURN r.r_name AS region, n.n_name AS nation", "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE n_nationkey < 3")
text_query("semi_exists", "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderstatus: 'P'}) RETURN c.id AS id", "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
text_query("anti_not_exists", "MATCH (p:Part) WHERE NOT (:Order)-[:CONTAINS]->(p) RETURN p.id AS id", "SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
text_query("equi_predicate_join", "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9500 RETURN c.id AS customer, s.id AS supplier", "SELECT c_custkey AS customer, s_suppkey AS supplier FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9500")
text_query("two_matches", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 490000 MATCH (o)-[:CONTAINS]->(p:Part) RETURN c.id AS customer, p.id AS part, count(*) AS n", "SELECT o_custkey AS customer, l_partkey AS part, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 490000 GROUP BY 1, 2")

# variable length and algorithms

WALKS = f"{LINKS}, w1 AS (SELECT src AS s, dst AS t, src AS a1, dst AS b1 FROM links), w2 AS (SELECT s, dst AS t, a1, b1, src AS a2, dst AS b2 FROM w1 JOIN links ON src = t WHERE NOT (src = a1 AND dst = b1)), w3 AS (SELECT s, dst AS t FROM w2 JOIN links ON src = t WHERE NOT (src = a1 AND dst = b1) AND NOT (src = a2 AND dst = b2))"
text_query("var_len_1_3", "MATCH (a:Person {id: 3})-[:LINKS*1..3]->(b:Person) RETURN b.id AS id, count(*) AS n", f"WITH {WALKS} SELECT t AS id, count(*) AS n FROM (SELECT s, t FROM w1 UNION ALL SELECT s, t FROM w2 UNION ALL SELECT s, t FROM w3) WHERE s = 3 GROUP BY 1")
text_query("var_len_exact_2", "MATCH p = (a:Person {id: 3})-[:LINKS*2]->(b:Person) RETURN b.id AS id, length(p) AS hops, count(*) AS n", f"WITH {WALKS} SELECT t AS id, 2 AS hops, count(*) AS n FROM w2 WHERE s = 3 GROUP BY 1")
text_query("var_len_zero", "MATCH (a:Person {id: 3})-[:LINKS*0..1]->(b:Person) RETURN b.id AS id", f"WITH {WALKS} SELECT t AS id FROM w1 WHERE s = 3 UNION ALL SELECT 3")



def _reach(depth: int, start: int) -> str:
    steps, seen = [f"d0 AS (SELECT {start}::BIGINT AS id)"], ["SELECT id FROM d0"]
    for k in range(1, depth + 1):
        steps.append(f"d{k} AS (SELECT DISTINCT dst AS id FROM d{k - 1} JOIN links ON src = id WHERE dst NOT IN ({' UNION ALL '.join(seen)}))")
        seen.append(f"SELECT id FROM d{k}")
    return ", ".join(steps)


def _seed(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


@registered("bfs_levels", f"WITH {LINKS}, {_reach(3, 3)} SELECT id, 0::BIGINT AS depth FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2 UNION ALL SELECT id, 3 FROM d3")
def bfs_levels(spark, sf_dir):
    return traverse.bfs(link_edges(spark, sf_dir), _seed(spark, 3), 3)


@registered("bfs_as_of", f"WITH {LINKS.replace('user_id <> item GROUP', f"user_id <> item AND ts <= TIMESTAMP '{MOMENT}' GROUP")}, {_reach(2, 3)} SELECT id, 0::BIGINT AS depth FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2")
def bfs_as_of(spark, sf_dir):
    return traverse.bfs(link_edges(spark, sf_dir).where(F.col("ts") <= at(MOMENT)), _seed(spark, 3), 2)


@registered("khop", f"WITH {LINKS}, {_reach(2, 3)} SELECT id FROM d2")
def khop(spark, sf_dir):
    return traverse.khop(link_edges(spark, sf_dir), _seed(spark, 3), 2)


@registered("degree_centrality", f"WITH {LINKS} SELECT c_custkey AS id, count(src) AS degree FROM customer LEFT JOIN links ON src = c_custkey GROUP BY 1")
def degree_centrality(spark, sf_dir):
    return traverse.degree_centrality(link_edges(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@registered("neighbors_in", f"WITH {LINKS} SELECT dst AS id, src AS neighbor FROM links WHERE dst IN (3, 7)")
def neighbors_in(spark, sf_dir):
    return traverse.neighbors(link_edges(spark, sf_dir), [3, 7], "in").select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))


@registered("batch_neighbors_limit", f"WITH {LINKS} SELECT src AS id, dst AS neighbor FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM links WHERE src IN (1, 2, 3)) WHERE n <= 4")
def batch_neighbors_limit(spark, sf_dir):
    return traverse.neighbors(link_edges(spark, sf_dir), [1, 2, 3], limit=4).select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))


@registered("connected_components", f"WITH RECURSIVE {LINKS}, both_ways AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links), reach(id, other) AS (SELECT src, src FROM both_ways UNION SELECT r.id, b.dst FROM reach r JOIN both_ways b ON b.src = r.other) SELECT id, min(other) AS component FROM reach GROUP BY 1")
def connected_components(spark, sf_dir):
    return traverse.connected_components(link_edges(spark, sf_dir))


@registered("directed_components", f"WITH {LINKS}, {_reach(3, 3)}, a AS (SELECT id FROM d0 UNION SELECT id FROM d1 UNION SELECT id FROM d2 UNION SELECT id FROM d3), {_reach(3, 140).replace('d0', 'e0').replace('d1', 'e1').replace('d2', 'e2').replace('d3', 'e3')}, b AS (SELECT id FROM e0 UNION SELECT id FROM e1 UNION SELECT id FROM e2 UNION SELECT id FROM e3) SELECT id, 3::BIGINT AS seed FROM a UNION ALL SELECT id, 140 FROM b WHERE id NOT IN (SELECT id FROM a)")
def directed_components(spark, sf_dir):
    return traverse.directed_components(link_edges(spark, sf_dir), [3, 140])


@registered(
    "shortest_path",
    f"WITH RECURSIVE {LINKS}, {_reach(4, 3)}, depths AS (SELECT id, 0 AS d FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2 UNION ALL SELECT id, 3 FROM d3 UNION ALL SELECT id, 4 FROM d4), "
    "back(rev, d) AS (SELECT [id], d FROM depths WHERE id = 60 UNION ALL SELECT list_append(b.rev, l.src), b.d - 1 FROM back b JOIN links l ON l.dst = b.rev[len(b.rev)] JOIN depths x ON x.id = l.src AND x.d = b.d - 1) "
    "SELECT 3::BIGINT AS source, 60::BIGINT AS target, (len(rev) - 1)::BIGINT AS distance, array_to_string(list_reverse(rev), '>') AS path FROM back WHERE d = 0 ORDER BY rev LIMIT 1",
)
def shortest_path(spark, sf_dir):
    return traverse.shortest_path(link_edges(spark, sf_dir), 3, 60, 4).withColumn("path", F.concat_ws(">", F.col("path").cast("array<string>")))


def _rank_sql(rounds: int) -> str:
    parts = [LINKS, "deg AS (SELECT src, count(*) AS n FROM links GROUP BY 1)", "v AS (SELECT src AS id FROM links UNION SELECT dst FROM links)", "k AS (SELECT count(*)::DOUBLE AS n FROM v)", "r0 AS (SELECT id, 1.0::DOUBLE / (SELECT n FROM k) AS rank FROM v)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS (SELECT v.id, (0.15::DOUBLE / (SELECT n FROM k)) + 0.85::DOUBLE * coalesce(g.got, 0.0) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank / deg.n) AS got FROM links JOIN deg ON deg.src = links.src JOIN r{i} ON r{i}.id = links.src GROUP BY 1) g ON g.dst = v.id)")
    return "WITH " + ", ".join(parts) + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@registered("pagerank_fixed_iter", _rank_sql(5))
def pagerank_fixed_iter(spark, sf_dir):
    return traverse.pagerank(link_edges(spark, sf_dir), 5).select("id", F.round("rank", 9).alias("rank"))


@registered("path_enumeration", f"WITH {LINKS}, s AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM links) SELECT concat_ws('>', 3, a.dst, b.dst, c.dst) AS path FROM s a JOIN s b ON b.src = a.dst JOIN s c ON c.src = b.dst WHERE a.src = 3 AND a.n <= 5 AND b.n <= 5 AND c.n <= 5 AND b.dst <> 3 AND c.dst <> 3 AND c.dst <> a.dst")
def path_enumeration(spark, sf_dir):
    return traverse.paths(link_edges(spark, sf_dir), _seed(spark, 3), 3, branch=5).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@registered("path_enumeration_whole", f"WITH {LINKS} SELECT concat_ws('>', 3, a.dst, b.dst, c.dst) AS path FROM links a JOIN links b ON b.src = a.dst JOIN links c ON c.src = b.dst WHERE a.src = 3 AND b.dst <> 3 AND c.dst <> 3 AND c.dst <> a.dst")
def path_enumeration_whole(spark, sf_dir):
    return traverse.paths(link_edges(spark, sf_dir), _seed(spark, 3), 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@registered("triangle_in_window", f"WITH {ELOG}, e AS (SELECT DISTINCT user_id AS src, item AS dst FROM elog WHERE user_id <> item AND ts >= TIMESTAMP '{MOMENT}' AND ts < TIMESTAMP '{LATER}') SELECT x.src AS a, y.src AS b, z.src AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst AND z.dst = x.src WHERE x.src < y.src AND x.src < z.src")
def triangle_in_window(spark, sf_dir):
    edges = event_log(spark, sf_dir).where("item IS NOT NULL").select(F.col("user_id").alias("src"), F.col("item").alias("dst"), "ts")
    return traverse.triangles_in_window(edges, MOMENT, LATER)


# aggregation

text_query("agg_global", "MATCH (o:Order) RETURN count(*) AS n, round(sum(o.o_totalprice)) AS total, min(o.o_totalprice) AS low, max(o.o_totalprice) AS high", "SELECT count(*) AS n, round(sum(o_totalprice))::BIGINT AS total, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
text_query("agg_grouped", "MATCH (o:Order) RETURN o.o_orderstatus AS status, o.o_orderpriority AS priority, count(*) AS n", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2")
text_query("agg_count_distinct", "MATCH (o:Order)-[:CONTAINS]->(p:Part) RETURN o.o_orderstatus AS status, count(DISTINCT p.id) AS parts, count(DISTINCT p.p_brand) AS brands", "SELECT o_orderstatus AS status, count(DISTINCT l_partkey) AS parts, count(DISTINCT p_brand) AS brands FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
text_query("agg_collect_sorted", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r.r_name AS region, collect(n.n_name) AS names RETURN region, size(names) AS n, names[0] AS first, last(names) AS final", "SELECT r_name AS region, count(*)::INT AS n, min(n_name) AS first, max(n_name) AS final FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
text_query("agg_min_max_avg", "MATCH (p:Part) RETURN p.p_type AS kind, min(p.p_size) AS low, max(p.p_name) AS name, avg(p.p_size) AS mean, sum(p.p_size) AS total", "SELECT p_type AS kind, min(p_size) AS low, max(p_name) AS name, avg(p_size) AS mean, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
text_query("agg_empty_global", "MATCH (p:Part) WHERE p.id < 0 RETURN count(*) AS n, sum(p.p_size) AS total, avg(p.p_size) AS mean, max(p.p_name) AS name", "SELECT 0::BIGINT AS n, 0::BIGINT AS total, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS VARCHAR) AS name")
text_query("agg_empty_grouped", "MATCH (p:Part) WHERE p.id < 0 RETURN p.p_brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_partkey < 0 GROUP BY 1")
text_query("agg_expression", "MATCH (o:Order) RETURN o.o_orderstatus AS status, count(*) * 2 + 1 AS x, max(o.o_totalprice) - min(o.o_totalprice) AS spread ORDER BY count(*) DESC", "SELECT o_orderstatus AS status, count(*) * 2 + 1 AS x, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY 1")


@registered("agg_rollup", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity))::BIGINT AS qty FROM lineitem GROUP BY ROLLUP (1, 2)")
def agg_rollup(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
    return items.rollup("flag", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity")).cast("bigint").alias("qty"))


# sort, limit, distinct, set operations

text_query("sort_nulls", "MATCH (c:Customer) WITH c.id AS id, CASE WHEN c.id % 2 = 0 THEN c.c_acctbal END AS b RETURN id, b ORDER BY b DESC, id", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS b FROM customer ORDER BY b DESC NULLS FIRST, id")
text_query("topk", "MATCH (o:Order) RETURN o.id AS id, o.o_totalprice AS price ORDER BY o.o_totalprice DESC, o.id LIMIT 10", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY price DESC, id LIMIT 10")
text_query("skip_limit", "MATCH (c:Customer) RETURN c.id AS id ORDER BY c.c_name SKIP 20 LIMIT 10", "SELECT c_custkey AS id FROM customer ORDER BY c_name LIMIT 10 OFFSET 20")
text_query("limit_zero", "MATCH (c:Customer) RETURN c.id AS id LIMIT 0", "SELECT c_custkey AS id FROM customer LIMIT 0")
text_query("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS nation UNION MATCH (s:Supplier) RETURN s.s_nationkey AS nation", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
text_query("union_all", "MATCH (c:Customer) RETURN c.c_nationkey AS nation UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS nation", "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
text_query("call_subquery", "MATCH (n:Nation) CALL { WITH n MATCH (c:Customer)-[:IN_NATION]->(n) RETURN count(*) AS customers, max(c.c_acctbal) AS top } RETURN n.n_name AS nation, customers, top", "SELECT n_name AS nation, count(*) AS customers, max(c_acctbal) AS top FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
text_query("call_independent", "CALL { MATCH (s:Supplier) RETURN count(*) AS suppliers } MATCH (r:Region) RETURN r.r_name AS region, suppliers", "SELECT r_name AS region, (SELECT count(*) FROM supplier) AS suppliers FROM region")
text_query("unwind_list", "MATCH (r:Region) UNWIND [1, 2, 3] AS x RETURN r.id AS id, x, x * r.id AS y", "SELECT r_regionkey::BIGINT AS id, x::BIGINT AS x, x * r_regionkey::BIGINT AS y FROM region, (VALUES (1), (2), (3)) t(x)")
text_query("unwind_parameter", "UNWIND $xs AS x WITH x WHERE x > 1 RETURN x, x / 2 AS half", "SELECT x::BIGINT AS x, x::BIGINT // 2 AS half FROM (VALUES (5), (8)) t(x)", xs=[1, 5, 8])

# functions

text_query("fn_string", "MATCH (p:Part) RETURN p.id AS id, toUpper(p.p_name) AS up, toLower(p.p_brand) AS low, substring(p.p_name, 1, 3) AS mid, substring(p.p_name, -2, 2) AS neg, replace(p.p_name, 'e', '_') AS rep, trim('  ' + p.p_name + '\\t') AS trimmed, size(p.p_name) AS n, toString(p.p_size) AS s",
    "SELECT p_partkey AS id, upper(p_name) AS up, lower(p_brand) AS low, substring(p_name, 2, 3) AS mid, substring(p_name, 1, 2) AS neg, replace(p_name, 'e', '_') AS rep, p_name AS trimmed, length(p_name)::INT AS n, p_size::VARCHAR AS s FROM part")
text_query("fn_math", "MATCH (c:Customer) RETURN c.id AS id, abs(c.c_acctbal) AS a, round(c.c_acctbal) AS r, floor(c.c_acctbal) AS f, ceil(c.c_acctbal) AS ce, c.id / 0 AS z, c.id % 0 AS m, sign(c.c_acctbal) AS sg",
    "SELECT c_custkey AS id, abs(c_acctbal) AS a, round(c_acctbal)::BIGINT AS r, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS ce, CAST(NULL AS BIGINT) AS z, CAST(NULL AS BIGINT) AS m, sign(c_acctbal)::DOUBLE AS sg FROM customer")
text_query("fn_list", "UNWIND [[1, 2, 3], [4]] AS xs RETURN size(xs) AS n, head(xs) AS first, last(xs) AS final, xs[1] AS second, element_at(xs, 7) AS none, coalesce(xs[1], -1) AS filled", "SELECT * FROM (VALUES (3::INT, 1::BIGINT, 3::BIGINT, 2::BIGINT, CAST(NULL AS BIGINT), 2::BIGINT), (1, 4, 4, NULL, NULL, -1)) t(n, first, final, second, none, filled)")
text_query("fn_temporal", "MATCH (o:Order) RETURN o.id AS id, o.o_orderdate + duration('1d2h') AS later, o.o_orderdate - duration('P1D') AS sooner, o.o_orderdate - datetime('1995-01-01') AS since, micros(o.o_orderdate) AS us",
    "SELECT o_orderkey AS id, o_orderdate + INTERVAL 26 HOUR AS later, o_orderdate - INTERVAL 1 DAY AS sooner, epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01') AS since, epoch_us(o_orderdate) AS us FROM orders")
text_query("fn_json", "MATCH (s:State) RETURN s.kind AS kind, count(*) AS n, max(json('{\"k\": 7}', '$.k')) AS k", "SELECT event_type AS kind, count(*) AS n, '7' AS k FROM events GROUP BY 1")


@registered("fn_duration", "SELECT * FROM (VALUES ('1d2h30m10s', 95410000000), ('250l', 250000), ('P1Y2M3DT4H5M6S', 36993906000000), ('PT0.5S', 500000)) t(text, us)")
def fn_duration(spark, sf_dir):
    texts = ["1d2h30m10s", "250l", "P1Y2M3DT4H5M6S", "PT0.5S"]
    return spark.createDataFrame([(t, parse_duration(t)) for t in texts], "text string, us long")


@registered("fn_format_iso8601", "SELECT event_id AS id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || 'Z' AS text FROM events")
def fn_format_iso8601(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), format_iso8601(F.col("ts")).alias("text"))


# time travel

T0, T1 = f"TIMESTAMP '{MOMENT}'", f"TIMESTAMP '{LATER}'"
text_query("as_of", f"AS OF '{MOMENT}' MATCH (s:State) RETURN s.user_id AS id, s.value AS value, s.version AS version", f"WITH {HIST} SELECT user_id AS id, value, version FROM hist WHERE valid_from <= {T0} AND (valid_to IS NULL OR valid_to > {T0})")
text_query("as_of_match", f"MATCH (s:State) FOR SYSTEM_TIME AS OF '{MOMENT}' RETURN count(*) AS n", "SELECT count(*) AS n FROM events")
text_query("at_time_edges", "AT TIME '1997-01-01' MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.id AS id, count(*) AS n", "SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY 1")
text_query("between_versions", f"MATCH (s:State) BETWEEN '{MOMENT}' AND '{LATER}' RETURN s.user_id AS id, count(*) AS n", f"WITH {HIST} SELECT user_id AS id, count(*) AS n FROM hist WHERE valid_from < {T1} AND (valid_to IS NULL OR valid_to > {T0}) GROUP BY 1")
text_query("from_to", f"FROM '{MOMENT}' TO '{LATER}' MATCH (s:State) RETURN count(*) AS n", f"WITH {HIST} SELECT count(*) AS n FROM hist WHERE valid_from < {T1} AND (valid_to IS NULL OR valid_to > {T0})")
text_query("contained_in", f"CONTAINED IN ('{MOMENT}', '{LATER}') MATCH (s:State) RETURN s.user_id AS id, s.version AS version", f"WITH {HIST} SELECT user_id AS id, version FROM hist WHERE valid_from >= {T0} AND valid_to <= {T1}")
text_query("during_period", f"MATCH (s:State) DURING PERIOD ('{MOMENT}', '{LATER}') RETURN count(*) AS n", f"WITH {HIST} SELECT count(*) AS n FROM hist WHERE valid_from >= {T0} AND valid_to <= {T1}")
text_query("all_versions", "ALL VERSIONS MATCH (s:State) WHERE s.user_id = 3 RETURN s.version AS version, s.value AS value", f"WITH {HIST} SELECT version, value FROM hist WHERE user_id = 3")
text_query("version_k", "VERSION 2 MATCH (s:State) RETURN s.user_id AS id, s.value AS value", f"WITH {HIST} SELECT user_id AS id, value FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY valid_from) - 1 AS k FROM hist) WHERE k = 2")
text_query("first_version", "FIRST VERSION MATCH (s:State) RETURN s.user_id AS id, s.value AS value", f"WITH {HIST} SELECT user_id AS id, value FROM hist WHERE version = 0")
text_query("prev_version", f"PREV VERSION OF '{MOMENT}' MATCH (s:State) RETURN s.user_id AS id, s.value AS value", f"WITH {HIST}, now_v AS (SELECT user_id, max(version) AS v FROM hist WHERE valid_from <= {T0} GROUP BY 1) SELECT h.user_id AS id, h.value FROM hist h JOIN now_v n ON n.user_id = h.user_id AND h.version = n.v - 1")


@registered("first_last", f"WITH {HIST} SELECT user_id, arg_min(value, version) AS first_value, arg_max(value, version) AS last_value FROM hist GROUP BY 1")
def first_last(spark, sf_dir):
    return fold.first_last(user_history(spark, sf_dir), ["user_id"], "value")


@registered("prev_next", f"SELECT user_id, max_by(value, ts) FILTER (ts < {T0}) AS prev_value, min_by(value, ts) FILTER (ts > {T0}) AS next_value FROM events GROUP BY 1")
def prev_next(spark, sf_dir):
    return fold.prev_next(user_history(spark, sf_dir), ["user_id"], MOMENT, "value")


@registered("bitemporal_as_of", f"WITH {HIST}, b AS (SELECT *, valid_from + INTERVAL 1 DAY AS txn_from, valid_to + INTERVAL 3 DAY AS txn_to FROM hist) SELECT user_id, version FROM b WHERE valid_from <= {T0} AND (valid_to IS NULL OR valid_to > {T0}) AND txn_from <= {T1} AND (txn_to IS NULL OR txn_to > {T1})")
def bitemporal_as_of(spark, sf_dir):
    h = user_history(spark, sf_dir)
    h = h.withColumn("txn_from", F.expr("valid_from + INTERVAL 1 DAY")).withColumn("txn_to", F.expr("valid_to + INTERVAL 3 DAY"))
    graph = GraphSession(spark).graph.with_nodes("State", h.withColumn("id", F.col("user_id")))
    return graph.as_of(MOMENT).as_of(LATER, axis="system").nodes["State"].df.select("user_id", "version")


@registered("latest_fold_delete_wins", f"WITH {ELOG} SELECT user_id, item, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, seq DESC) AS n FROM elog) WHERE n = 1 AND op <> 'DELETE'")
def latest_fold_delete_wins(spark, sf_dir):
    return fold.fold(event_log(spark, sf_dir), ["user_id", "item"]).select("user_id", "item", "ts", "value")


@registered("neighbors_as_of", f"WITH {ELOG} SELECT user_id, item FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, seq DESC) AS n FROM elog WHERE ts <= {T0}) WHERE n = 1 AND op <> 'DELETE' AND user_id = 3")
def neighbors_as_of(spark, sf_dir):
    return fold.fold(event_log(spark, sf_dir).where("user_id = 3"), ["user_id", "item"], as_of=MOMENT).select("user_id", "item")


@registered("edge_history", f"WITH {ACTED} SELECT src, dst, kind, version, valid_from, valid_to FROM acted WHERE src = 3 AND dst IN (1, 2, 3, 4, 5)")
def edge_history(spark, sf_dir):
    text = "ALL VERSIONS MATCH (a:Person)-[r:ACTED]->(b:Person) WHERE startNode(r) = 3 AND endNode(r) IN [1, 2, 3, 4, 5] RETURN startNode(r) AS src, endNode(r) AS dst, r.kind AS kind, r.version AS version, r.valid_from AS valid_from, r.valid_to AS valid_to"
    graph = shop_graph(spark, sf_dir)
    everyone = event_log(spark, sf_dir).select(F.col("user_id").alias("id")).union(event_log(spark, sf_dir).select("item")).where("id IS NOT NULL").distinct()
    return graph.with_nodes("Person", everyone).cypher(text)


@registered("get_at_time", f"SELECT user_id, max(ts) AS ts, max_by(value, ts) AS value FROM events WHERE ts <= {T0} GROUP BY 1")
def get_at_time(spark, sf_dir):
    return fold.get_at_time(user_history(spark, sf_dir), ["user_id"], MOMENT, "value")


@registered("scan_range_desc", f"SELECT user_id, ts, value FROM events WHERE user_id = 3 AND ts >= {T0} AND ts < {T1}")
def scan_range_desc(spark, sf_dir):
    h = table(spark, sf_dir, "events").where((F.col("user_id") == 3) & (F.col("ts") >= at(MOMENT)) & (F.col("ts") < at(LATER)))
    return h.select("user_id", "ts", "value").orderBy(F.col("ts").desc())


@registered("scan_limit", "SELECT user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def scan_limit(spark, sf_dir):
    return fold.scan_limit(user_history(spark, sf_dir), ["user_id"], 3).select("user_id", "ts", "value")


@registered("snapshot_vertex_pivot", f"SELECT user_id, max_by(value, ts) FILTER (event_type = 'click') AS click, max_by(value, ts) FILTER (event_type = 'view') AS view, max_by(value, ts) FILTER (event_type = 'purchase') AS purchase FROM events WHERE ts <= {T0} AND event_type IN ('click', 'view', 'purchase') GROUP BY 1")
def snapshot_vertex_pivot(spark, sf_dir):
    return fold.snapshot_pivot(user_history(spark, sf_dir), "user_id", "kind", ["click", "view", "purchase"], MOMENT)


@registered("snapshot_diff", f"WITH a AS (SELECT user_id, max_by(value, ts) AS v FROM events WHERE ts <= {T0} GROUP BY 1), b AS (SELECT user_id, max_by(value, ts) AS v FROM events WHERE ts <= {T1} GROUP BY 1) SELECT b.user_id, CASE WHEN a.user_id IS NULL THEN 'added' ELSE 'changed' END AS change, a.v AS old_value, b.v AS new_value FROM b LEFT JOIN a ON a.user_id = b.user_id WHERE a.user_id IS NULL OR a.v IS DISTINCT FROM b.v")
def snapshot_diff(spark, sf_dir):
    return fold.snapshot_diff(user_history(spark, sf_dir), ["user_id"], MOMENT, LATER, "value")


# Allen relations between a user's states on two half-day grids

ALLEN_SQL = {
    "before": "a.valid_to < b.valid_from", "after": "a.valid_from > b.valid_to", "meets": "a.valid_to = b.valid_from", "met_by": "a.valid_from = b.valid_to",
    "overlaps": "a.valid_from < b.valid_from AND a.valid_to > b.valid_from AND a.valid_to < b.valid_to", "overlapped_by": "a.valid_from > b.valid_from AND a.valid_from < b.valid_to AND a.valid_to > b.valid_to",
    "during": "a.valid_from > b.valid_from AND a.valid_to < b.valid_to", "contains": "a.valid_from < b.valid_from AND a.valid_to > b.valid_to",
    "starts": "a.valid_from = b.valid_from AND a.valid_to < b.valid_to", "started_by": "a.valid_from = b.valid_from AND a.valid_to > b.valid_to",
    "finishes": "a.valid_to = b.valid_to AND a.valid_from > b.valid_from", "finished_by": "a.valid_to = b.valid_to AND a.valid_from < b.valid_from",
    "equals": "a.valid_from = b.valid_from AND a.valid_to = b.valid_to",
}
#: Activity of a kind within a five-day block, as an interval of whole days.
BLOCKS = "blocks AS (SELECT user_id, event_type AS kind, epoch_us(ts) // 432000000000 AS block, to_timestamp(min(epoch_us(ts) // 86400000000) * 86400)::TIMESTAMP AS valid_from, to_timestamp((max(epoch_us(ts) // 86400000000) + 1) * 86400)::TIMESTAMP AS valid_to FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3)"


def activity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    e = e.withColumn("block", F.expr("unix_micros(cast(ts AS TIMESTAMP)) div 432000000000")).withColumn("day", F.expr("unix_micros(cast(ts AS TIMESTAMP)) div 86400000000"))
    day = lambda c: F.timestamp_seconds(c * 86400).cast("timestamp_ntz")
    return e.groupBy("user_id", F.col("event_type").alias("kind"), "block").agg(day(F.min("day")).alias("valid_from"), day(F.max("day") + 1).alias("valid_to"))


def _allen(relation: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = activity_blocks(spark, sf_dir)
        pairs = intervals.allen_join(b.where("kind = 'click'"), b.where("kind = 'view'"), ["user_id"], relation, width_us=parse_duration("5d"))
        return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

    sql = f"WITH {BLOCKS} SELECT a.user_id, count(*) AS n FROM blocks a JOIN blocks b ON a.user_id = b.user_id WHERE a.kind = 'click' AND b.kind = 'view' AND {ALLEN_SQL[relation]} GROUP BY 1"
    registered(f"allen_{relation}", sql)(run)


for _name in intervals.ALLEN:
    _allen(_name)


@registered("interval_overlap_join", f"WITH {BLOCKS} SELECT a.user_id, a.valid_from AS click_from, b.valid_from AS view_from FROM blocks a JOIN blocks b ON a.user_id = b.user_id AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to WHERE a.kind = 'click' AND b.kind = 'view'")
def interval_overlap_join(spark, sf_dir):
    b = activity_blocks(spark, sf_dir)
    pairs = intervals.overlap_join(b.where("kind = 'click'"), b.where("kind = 'view'"), ["user_id"], parse_duration("5d"))
    return pairs.select("user_id", F.col("valid_from").alias("click_from"), F.col("valid_from_r").alias("view_from"))


HISTORY_PAIRS = "WITH {hist}, a AS (SELECT * FROM hist WHERE kind = 'click'), b AS (SELECT * FROM hist WHERE kind <> 'view') SELECT a.user_id, a.version AS click, b.version AS other FROM a JOIN b ON a.user_id = b.user_id AND {condition}"
FAR = "TIMESTAMP '9999-12-31'"


def _history_pairs(spark: SparkSession, sf_dir: str, relation: str | None) -> DataFrame:
    """A user's click states, made longer, against the same user's states but views; each user's last state has no end."""
    h = user_history(spark, sf_dir).select("user_id", "kind", "version", "valid_from", "valid_to")
    longer = h.withColumn("valid_to", F.when(F.col("valid_to").isNotNull(), F.col("valid_to") + F.expr("INTERVAL 20 DAYS")))
    clicks, others = longer.where("kind = 'click'"), h.where("kind <> 'view'")
    width = parse_duration("1d")
    pairs = intervals.overlap_join(clicks, others, ["user_id"], width) if relation is None else intervals.allen_join(clicks, others, ["user_id"], relation, width_us=width)
    return pairs.select("user_id", F.col("version").alias("click"), F.col("version_r").alias("other"))


def _open_ends(name: str, relation: str | None, condition: str) -> None:
    ends = condition.format(a1="a.valid_from", a2=f"coalesce(a.valid_to + INTERVAL 20 DAY, {FAR})", b1="b.valid_from", b2=f"coalesce(b.valid_to, {FAR})")
    registered(name, HISTORY_PAIRS.format(hist=HIST, condition=ends))(lambda spark, sf_dir: _history_pairs(spark, sf_dir, relation))


_open_ends("overlap_open_ends", None, "{a1} < {b2} AND {b1} < {a2}")
_open_ends("allen_contains_open_ends", "contains", "{a1} < {b1} AND {a2} > {b2}")
_open_ends("allen_equals_open_ends", "equals", "{a1} = {b1} AND {a2} = {b2}")
_open_ends("allen_started_by_open_ends", "started_by", "{a1} = {b1} AND {a2} > {b2}")
_open_ends("allen_overlaps_open_ends", "overlaps", "{a1} < {b1} AND {a2} > {b1} AND {a2} < {b2}")


@registered("asof_join", "SELECT p.event_id, p.user_id, c.value AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("bought"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("clicked"), F.col("value").alias("last_click"))
    return intervals.asof_join(buys, clicks, ["user_id"], "bought", "clicked", ["last_click"], width_us=parse_duration("7d")).select("event_id", "user_id", "last_click")


# temporal aggregates

CLAMPED = f"{HIST}, span AS (SELECT user_id, value, version, greatest(valid_from, {T0}) AS s, least(coalesce(valid_to, {T1}), {T1}) AS e FROM hist WHERE valid_from < {T1} AND (valid_to IS NULL OR valid_to > {T0}))"


def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = user_history(spark, sf_dir).where((F.col("valid_from") < at(LATER)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at(MOMENT))))
    return h.withColumn("s", F.greatest("valid_from", at(MOMENT))).withColumn("e", F.least(F.coalesce("valid_to", at(LATER)), at(LATER)))


@registered("temporal_avg", f"WITH {CLAMPED} SELECT user_id, round(sum(value * (epoch_us(e) - epoch_us(s))::DOUBLE) / sum((epoch_us(e) - epoch_us(s))::DOUBLE), 6) AS mean FROM span GROUP BY 1")
def temporal_avg_(spark, sf_dir):
    return clamped(spark, sf_dir).groupBy("user_id").agg(F.round(temporal_avg(F.col("value"), F.col("s"), F.col("e")), 6).alias("mean"))


@registered("temporal_sum", f"SELECT user_id, round(sum(value), 4) AS total FROM events WHERE ts >= {T0} AND ts < {T1} GROUP BY 1")
def temporal_sum(spark, sf_dir):
    e = table(spark, sf_dir, "events").where((F.col("ts") >= at(MOMENT)) & (F.col("ts") < at(LATER)))
    return e.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))


@registered("total_duration", f"WITH {CLAMPED} SELECT user_id, sum(epoch_us(e) - epoch_us(s))::BIGINT AS us FROM span GROUP BY 1")
def total_duration(spark, sf_dir):
    return clamped(spark, sf_dir).groupBy("user_id").agg(F.sum(micros(F.col("e")) - micros(F.col("s"))).alias("us"))


@registered("version_count", "SELECT user_id, count(DISTINCT ts) AS n FROM events GROUP BY 1")
def version_count(spark, sf_dir):
    return user_history(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("ts").alias("n"))


def _sliding(agg: str) -> None:
    sql = f"""WITH w AS (SELECT *, epoch_us(ts) // 86400000000 AS d FROM events)
      SELECT to_timestamp((d - k) * 86400)::TIMESTAMP AS window_start, to_timestamp((d - k + 7) * 86400)::TIMESTAMP AS window_end, event_type, {agg} AS x
      FROM w, range(7) r(k) GROUP BY 1, 2, 3"""
    made = lambda: {"round(avg(value), 6)": F.round(F.avg("value"), 6), "round(sum(value), 4)": F.round(F.sum("value"), 4), "count(*)": F.count(F.lit(1))}[agg]
    name = {"round(avg(value), 6)": "avg", "round(sum(value), 4)": "sum", "count(*)": "count"}[agg]
    registered(f"sliding_window_{name}", sql)(lambda spark, sf_dir: windows.windowed(table(spark, sf_dir, "events"), "ts", "7 days", "1 day", ["event_type"], x=made()))


for _agg in ("round(avg(value), 6)", "round(sum(value), 4)", "count(*)"):
    _sliding(_agg)


@registered("tumbling_count", "SELECT to_timestamp(epoch_us(ts) // 86400000000 * 86400)::TIMESTAMP AS window_start, to_timestamp((epoch_us(ts) // 86400000000 + 1) * 86400)::TIMESTAMP AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def tumbling_count(spark, sf_dir):
    return windows.windowed(table(spark, sf_dir, "events"), "ts", "1 day", None, ["event_type"], n=F.count(F.lit(1)))


@registered("session_window", "WITH a AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), b AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM b GROUP BY user_id, s")
def session_window(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"], n=F.count(F.lit(1)))


# lifecycles

ISLANDS = f"{LIFE}, m AS (SELECT *, event <> 'Deleted' AS alive, lag(event <> 'Deleted') OVER (PARTITION BY entity_id ORDER BY ts) AS was FROM life), e AS (SELECT * FROM m WHERE (was IS NULL AND alive) OR was <> alive), n AS (SELECT *, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts) AS nxt FROM e)"


@registered("alive_periods", f'WITH {ISLANDS} SELECT entity_id, ts AS start, nxt AS "end" FROM n WHERE alive')
def alive_periods(spark, sf_dir):
    return fold.alive_periods(lifecycle(spark, sf_dir))


@registered("entity_exists_at", f"WITH {LIFE} SELECT entity_id, max_by(event, ts) AS state, max_by(event, ts) <> 'Deleted' AS alive FROM life WHERE ts <= {T0} GROUP BY 1")
def entity_exists_at(spark, sf_dir):
    return fold.entity_exists_at(lifecycle(spark, sf_dir), MOMENT)


@registered("active_entities", f"WITH {LIFE} SELECT entity_id FROM life WHERE ts <= {T0} GROUP BY 1 HAVING max_by(event, ts) <> 'Deleted'")
def active_entities(spark, sf_dir):
    return fold.active_entities(lifecycle(spark, sf_dir), MOMENT)


@registered("lifecycle_history", f"WITH {LIFE} SELECT entity_id, ts, event FROM life WHERE entity_id = 3 AND ts BETWEEN {T0} AND {T1}")
def lifecycle_history(spark, sf_dir):
    return lifecycle(spark, sf_dir).where((F.col("entity_id") == 3) & F.col("ts").between(at(MOMENT), at(LATER))).orderBy("ts")


# temporal paths

TEDGES = f"{ACTED}, te AS (SELECT src, dst, valid_from AS f, coalesce(valid_to, TIMESTAMP '9999-12-31') AS t FROM acted WHERE op <> 'DELETE' AND src <> dst AND valid_from < {T1} AND (valid_to IS NULL OR valid_to > {T0}))"


def temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).where("item IS NOT NULL")
    return fold.intervals(log, ["user_id", "item"]).where("op <> 'DELETE' AND user_id <> item").select(F.col("user_id").alias("src"), F.col("item").alias("dst"), "valid_from", "valid_to")


@registered("temporal_path_continuous", f"WITH {TEDGES.replace(f'valid_from < {T1} AND (valid_to IS NULL OR valid_to > {T0})', f'valid_from <= {T0} AND (valid_to IS NULL OR valid_to > {T1})')} SELECT a.src AS a, a.dst AS b, b.dst AS c, count(*) AS n FROM te a JOIN te b ON b.src = a.dst WHERE greatest(a.f, b.f) < least(a.t, b.t) GROUP BY 1, 2, 3")
def temporal_path_continuous(spark, sf_dir):
    return traverse.temporal_path_counts(temporal_edges(spark, sf_dir), MOMENT, LATER, "continuous")


@registered("temporal_path_pairwise", f"WITH {TEDGES} SELECT a.src AS a, a.dst AS b, b.dst AS c, count(*) AS n FROM te a JOIN te b ON b.src = a.dst WHERE a.t > b.f AND b.t > a.f GROUP BY 1, 2, 3")
def temporal_path_pairwise(spark, sf_dir):
    return traverse.temporal_path_counts(temporal_edges(spark, sf_dir), MOMENT, LATER, "pairwise")


_WITHIN = f"valid_from < {T1} AND (valid_to IS NULL OR valid_to > {T0})"
_OPEN = "TIMESTAMP '9999-12-31'"
_TWO_HOPS = "MATCH (a:Person)-[r:ACTED]->(b:Person)-[s:ACTED]->(c:Person) BETWEEN $start AND $end PATH {} RETURN a.id AS a, b.id AS b, c.id AS c, count(*) AS n"
_TWO_HOPS_SQL = f"WITH {ACTED} SELECT a.src AS a, a.dst AS b, b.dst AS c, count(*) AS n FROM acted a JOIN acted b ON b.src = a.dst AND b.seq <> a.seq WHERE {{}} GROUP BY 1, 2, 3"


def _both(condition: str) -> str:
    return " AND ".join(condition.replace("valid_", f"{x}.valid_") for x in "ab")


text_query("match_path_snapshot", _TWO_HOPS.format("SNAPSHOT"), _TWO_HOPS_SQL.format(_both(f"valid_from <= {T1} AND (valid_to IS NULL OR valid_to > {T0})")), start=MOMENT, end=LATER)
text_query("match_path_continuous", _TWO_HOPS.format("CONTINUOUS"),
    _TWO_HOPS_SQL.format(_both(f"valid_from <= {T0} AND (valid_to IS NULL OR valid_to > {T1})") + f" AND greatest(a.valid_from, b.valid_from) < least(coalesce(a.valid_to, {_OPEN}), coalesce(b.valid_to, {_OPEN}))"), start=MOMENT, end=LATER)
text_query("match_path_pairwise", _TWO_HOPS.format("PAIRWISE"),
    _TWO_HOPS_SQL.format(_both(_WITHIN) + f" AND coalesce(a.valid_to, {_OPEN}) > b.valid_from AND coalesce(b.valid_to, {_OPEN}) > a.valid_from"), start=MOMENT, end=LATER)
text_query("match_path_sequential", "MATCH (a:Person)-[r:ACTED]->(b:Person)-[s:ACTED]->(c:Person) PATH SEQUENTIAL RETURN b.id AS b, count(*) AS n",
    f"WITH {ACTED} SELECT a.dst AS b, count(*) AS n FROM acted a JOIN acted b ON b.src = a.dst AND b.seq <> a.seq WHERE b.valid_from >= a.valid_from GROUP BY 1")
text_query("match_walk_continuous", "MATCH p = (a:Person)-[:ACTED*1..2]->(b:Person) BETWEEN $start AND $end PATH CONTINUOUS RETURN a.id AS a, length(p) AS hops, count(*) AS n, max(valid_from(p)) AS since",
    f"""WITH {ACTED}, ok AS (SELECT * FROM acted WHERE valid_from <= {T0} AND (valid_to IS NULL OR valid_to > {T1}))
    SELECT src AS a, 1 AS hops, count(*) AS n, max(valid_from) AS since FROM ok GROUP BY 1
    UNION ALL SELECT a.src, 2, count(*), max(greatest(a.valid_from, b.valid_from)) FROM ok a JOIN ok b ON b.src = a.dst AND b.seq <> a.seq
    WHERE greatest(a.valid_from, b.valid_from) < least(coalesce(a.valid_to, {_OPEN}), coalesce(b.valid_to, {_OPEN})) GROUP BY 1""", start=MOMENT, end=LATER)
text_query("match_window_slide", "MATCH (u:State) RETURN u.kind AS event_type, round(window_avg(u.value) WINDOW 7d SLIDE 1d * 100000) AS avg_value, window_count(u.value) WINDOW 7d SLIDE 1d AS n",
    """WITH w AS (SELECT *, epoch_us(ts) // 86400000000 AS d FROM events)
    SELECT to_timestamp((d - k) * 86400)::TIMESTAMP AS window_start, to_timestamp((d - k + 7) * 86400)::TIMESTAMP AS window_end, event_type, round(avg(value) * 100000)::BIGINT AS avg_value, count(value) AS n
    FROM w, range(7) r(k) GROUP BY 1, 2, 3""")
text_query("match_window_tumbling", "MATCH (u:State) RETURN u.user_id AS user_id, round(window_sum(u.value) WINDOW 1d ON u.ts * 1000) AS total",
    "SELECT user_id, to_timestamp(epoch_us(ts) // 86400000000 * 86400)::TIMESTAMP AS window_start, to_timestamp((epoch_us(ts) // 86400000000 + 1) * 86400)::TIMESTAMP AS window_end, round(sum(value) * 1000)::BIGINT AS total FROM events GROUP BY 1, 2, 3")


# writes


@registered("create_node_edge", "SELECT n_name AS nation, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT 3) JOIN nation ON n_nationkey = k WHERE n_nationkey < 5 GROUP BY 1")
def create_node_edge(spark, sf_dir):
    s = GraphSession(spark, shop_graph(spark, sf_dir))
    s.query("MATCH (n:Nation {id: 3}) CREATE (c:Customer {id: 99000000, c_name: 'new'})-[:IN_NATION]->(n)")
    return s.query("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE n.id < 5 RETURN n.n_name AS nation, count(*) AS n")


@registered("set_prop", "SELECT c_custkey AS id, CASE WHEN c_custkey < 10 THEN 'VIP' ELSE c_mktsegment END AS segment FROM customer")
def set_prop(spark, sf_dir):
    s = GraphSession(spark, shop_graph(spark, sf_dir))
    s.query("MATCH (c:Customer) WHERE c.id < 10 SET c.c_mktsegment = 'VIP'")
    return s.query("MATCH (c:Customer) RETURN c.id AS id, c.c_mktsegment AS segment")


@registered("delete_edge", "SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_totalprice <= 400000 GROUP BY 1")
def delete_edge(spark, sf_dir):
    s = GraphSession(spark, shop_graph(spark, sf_dir))
    s.query("MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 DELETE r")
    return s.query("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.id AS id, count(*) AS n")


@registered("delete_node_detach", "SELECT count(*) AS n FROM customer WHERE c_nationkey <> 3")
def delete_node_detach(spark, sf_dir):
    s = GraphSession(spark, shop_graph(spark, sf_dir))
    s.query("MATCH (n:Nation {id: 3}) DETACH DELETE n")
    return s.query("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN count(*) AS n")


@registered("merge_node", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 1000, 'NEW'")
def merge_node(spark, sf_dir):
    s = GraphSession(spark, shop_graph(spark, sf_dir))
    s.query("UNWIND [1, 2, 1000, 1000] AS k MERGE (n:Nation {id: k, n_name: 'NEW'})")
    return s.query("MATCH (n:Nation) RETURN n.id AS id, n.n_name AS name")


@registered("strict_missing_endpoint", "SELECT l_orderkey AS src, l_partkey AS dst, 'DstNodeNotFound' AS error FROM lineitem WHERE l_partkey % 50 = 0")
def strict_missing_endpoint(spark, sf_dir):
    g = shop_graph(spark, sf_dir)
    parts = g.nodes["Part"].df.where("id % 50 <> 0")
    return writes.missing_endpoints(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), g.nodes["Order"].df, parts)


@registered("strict_anachronism", "SELECT l_orderkey AS src, l_partkey AS dst, l_shipdate AS ts, 'TemporalAnachronism' AS error FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate + INTERVAL 10 DAY")
def strict_anachronism(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_shipdate").alias("ts"))
    born = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_orderdate + INTERVAL 10 DAY").alias("created"))
    return writes.anachronisms(edges, born)


@registered(
    "strict_update_batch",
    "WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst, l_shipdate AS ts FROM lineitem), gone AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 50 = 0), born AS (SELECT o_orderkey AS id, o_orderdate + INTERVAL 10 DAY AS created FROM orders) "
    "SELECT src, dst, NULL::BIGINT AS id, 'DstNodeNotFound' AS error FROM e WHERE dst IN (SELECT id FROM gone) "
    "UNION ALL SELECT src, dst, NULL, 'TemporalAnachronism' FROM e JOIN born ON born.id = src WHERE ts < created "
    "UNION ALL SELECT NULL, NULL, id, 'UpdateOnDeleted' FROM gone",
)
def strict_update_batch(spark, sf_dir):
    """New edges from orders to parts, parts that go in the same batch, and a change of every part."""
    g = shop_graph(spark, sf_dir)
    born = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_orderdate + INTERVAL 10 DAY").alias("valid_from"))
    parts = g.nodes["Part"].df.select("id")
    bare = writes.create_nodes(writes.create_nodes(TemporalGraph(spark), "Order", born), "Part", parts)
    batch = writes.Update(bare, "strict_temporal").delete_nodes("Part", parts.where("id % 50 = 0")).update_nodes("Part", "checked", parts.select("id", F.lit("yes").alias("value")))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_shipdate").alias("ts"))
    return batch.create_edges("CONTAINS", "Order", "Part", edges).violations()


@registered("strict_write_conflict", "SELECT c_custkey AS id, 'WriteConflict' AS error FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0")
def strict_write_conflict(spark, sf_dir):
    """Customers that a batch changes, some of whom someone else has changed since."""
    g = shop_graph(spark, sf_dir)
    people = g.nodes["Customer"].df
    now = writes.set_property(g, "Customer", people.where("c_nationkey = 3").select("id", F.lit("VIP").alias("value")), "c_mktsegment", "value")
    batch = writes.Update(g, "full_isolation").update_nodes("Customer", "c_mktsegment", people.where("c_acctbal > 0").select("id", F.lit("X").alias("value")))
    return batch.violations(now).select("id", "error")


@registered("strict_update_on_deleted", f"WITH {LIFE} SELECT u.user_id AS id, u.ts, 'UpdateOnDeleted' AS error FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view') u JOIN life ON entity_id = user_id AND life.ts <= u.ts GROUP BY 1, 2 HAVING max_by(event, life.ts) = 'Deleted'")
def strict_update_on_deleted(spark, sf_dir):
    views = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("id"), "ts").distinct()
    return writes.updates_on_deleted(views, lifecycle(spark, sf_dir))


TXN = "txn AS (SELECT event_id AS txn_id, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 AS e, user_id AS key, CASE WHEN event_type IN ('purchase', 'signup') THEN 'W' ELSE 'R' END AS mode FROM events)"


@registered("txn_conflicts", f"WITH {TXN} SELECT DISTINCT x.txn_id AS a, y.txn_id AS b, CASE WHEN x.mode = 'W' AND y.mode = 'W' THEN 'write-write' ELSE 'read-write' END AS kind FROM txn x JOIN txn y ON x.key = y.key AND x.txn_id < y.txn_id AND x.s < y.e AND y.s < x.e AND (x.mode = 'W' OR y.mode = 'W')")
def txn_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mode = F.when(F.col("event_type").isin("purchase", "signup"), "W").otherwise("R")
    return intervals.transaction_conflicts(e.select(F.col("event_id").alias("txn_id"), micros(F.col("ts")).alias("start"), (micros(F.col("ts")) + 3600000000).alias("end"), F.col("user_id").alias("key"), mode.alias("mode")))


# change streams

CDC = f"{ELOG}, cdc AS (SELECT (user_id % 4)::INT AS p, row_number() OVER (PARTITION BY user_id % 4 ORDER BY seq) AS o, seq + 1 AS v, user_id AS e, item AS t, op FROM elog)"


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as change records: four partitions, one record a transaction."""
    log = event_log(spark, sf_dir).withColumn("partition_id", (F.col("user_id") % 4).cast("int"))
    log = log.withColumn("offset", F.row_number().over(W.partitionBy("partition_id").orderBy("seq")).cast("bigint"))
    one = lambda v, t: F.lit(v).cast(t)
    return log.select(
        "partition_id", one(1, "bigint").alias("partition_epoch"), "offset", (F.col("seq") + 1).alias("commit_version"), F.col("seq").alias("txn_id"), one(0, "int").alias("batch_index"), one(1, "int").alias("batch_size"),
        F.col("user_id").alias("entity_id"), F.col("item").alias("target_id"), one(1, "int").alias("edge_type"), "op", (F.col("seq") + 1).alias("valid_from"), one(0, "bigint").alias("valid_to"),
    )


FOLDED = "SELECT e AS src, t AS dst, v AS version FROM (SELECT *, row_number() OVER (PARTITION BY p, e, t ORDER BY v DESC, o DESC) AS n FROM cdc{where}) WHERE n = 1 AND op <> 'DELETE'"


@registered("cdc_snapshot", f"WITH {CDC} " + FOLDED.format(where=" WHERE v <= 500"))
def cdc_snapshot(spark, sf_dir):
    return cdc.snapshot(change_log(spark, sf_dir), 500).select(F.col("entity_id").alias("src"), F.col("target_id").alias("dst"), F.col("commit_version").alias("version"))


@registered("cdc_idempotent", f"WITH {CDC} " + FOLDED.format(where=""))
def cdc_idempotent(spark, sf_dir):
    log = change_log(spark, sf_dir)
    again = log.unionByName(log.where("offset % 3 = 0"))  # a third is delivered twice
    return cdc.snapshot(cdc.applicable(again)).select(F.col("entity_id").alias("src"), F.col("target_id").alias("dst"), F.col("commit_version").alias("version"))


@registered("cdc_progress_gap", f"WITH {CDC} SELECT p AS partition_id, CASE WHEN p = 2 THEN 4 ELSE max(o) END::BIGINT AS applied_offset, p = 2 AS gap FROM cdc GROUP BY 1")
def cdc_progress_gap(spark, sf_dir):
    return cdc.progress(change_log(spark, sf_dir).where("NOT (partition_id = 2 AND offset = 5)"))


@registered("cdc_stream_equals_batch", f"WITH {CDC} " + FOLDED.format(where=""))
def cdc_stream_equals_batch(spark, sf_dir):
    base = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    change_log(spark, sf_dir).repartitionByRange(3, "commit_version").write.parquet(f"{base}/log")
    view = cdc.EdgeView(spark, f"{base}/view")
    view.run(f"{base}/log", f"{base}/checkpoint")
    return view.edges().select(F.col("entity_id").alias("src"), F.col("target_id").alias("dst"), F.col("commit_version").alias("version"))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/timeweave-catalogue"


@registered("cdc_resume", f"WITH {CDC} " + FOLDED.format(where=""))
def cdc_resume(spark, sf_dir):
    """Half of the log, then the rest by a view that is opened anew."""
    base, log = f"{_scratch(spark)}/{uuid.uuid4().hex}", change_log(spark, sf_dir)
    early = F.col("seq_half")
    halves = log.withColumn("seq_half", F.col("commit_version") % 1000 < 500)
    for rows in (halves.where(early), halves.where(~early)):
        rows.drop("seq_half").coalesce(2).write.mode("append").parquet(f"{base}/log")
        cdc.EdgeView(spark, f"{base}/view").run(f"{base}/log", f"{base}/checkpoint", 2)
    return cdc.EdgeView(spark, f"{base}/view").edges().select(F.col("entity_id").alias("src"), F.col("target_id").alias("dst"), F.col("commit_version").alias("version"))


@registered("cdc_replace_partition", f"WITH {CDC} " + FOLDED.format(where=""))
def cdc_replace_partition(spark, sf_dir):
    """Partition 2 has lost its first records and comes from a snapshot; then all are followed."""
    base, log = f"{_scratch(spark)}/{uuid.uuid4().hex}", change_log(spark, sf_dir)
    log.where("NOT (partition_id = 2 AND offset < 40)").repartitionByRange(3, "commit_version").write.parquet(f"{base}/log")
    view = cdc.EdgeView(spark, f"{base}/view")
    old = log.where("partition_id = 2 AND offset <= 60")
    view.catch_up(2, 1, 40, lambda: (old, 60, old.agg(F.max("commit_version")).first()[0]))
    view.run(f"{base}/log", f"{base}/checkpoint")
    return view.edges().select(F.col("entity_id").alias("src"), F.col("target_id").alias("dst"), F.col("commit_version").alias("version"))


@registered("cdc_unordered", f"WITH {CDC} SELECT e AS src, t AS dst, o AS version FROM (SELECT *, row_number() OVER (PARTITION BY p, e, t ORDER BY o DESC) AS n FROM cdc) WHERE n = 1 AND op <> 'DELETE'")
def cdc_unordered(spark, sf_dir):
    """Files from the newest to the oldest, put in order of commit versions by the stream."""
    base = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    change_log(spark, sf_dir).withColumn("commit_version", F.col("offset")).repartitionByRange(4, F.col("offset").desc()).write.parquet(f"{base}/log")
    view = cdc.EdgeView(spark, f"{base}/view")
    view.run(f"{base}/log", f"{base}/checkpoint", unordered=True)
    return view.edges().select(F.col("entity_id").alias("src"), F.col("target_id").alias("dst"), F.col("commit_version").alias("version"))


@registered("cdc_version_gate", "SELECT * FROM (VALUES ('before', 'NOT_READY'), ('held', 'READY'), ('ahead', 'VERSION_LAG')) t(asked, answer)")
def cdc_version_gate(spark, sf_dir):
    view = cdc.EdgeView(spark, f"{_scratch(spark)}/{uuid.uuid4().hex}")
    first = cdc.ready(view.version, 1)
    view.apply(change_log(spark, sf_dir), 0)
    held = view.version
    return spark.createDataFrame([("before", first), ("held", cdc.ready(view.version, held)), ("ahead", cdc.ready(view.version, held + 1))], "asked string, answer string")


@registered("cdc_read_after", f"WITH {CDC} SELECT p AS partition_id, o AS \"offset\" FROM cdc WHERE o > 10 AND o <= 15")
def cdc_read_after(spark, sf_dir):
    return cdc.read_after(change_log(spark, sf_dir), 10, 5).select("partition_id", "offset")


@registered("cdc_scan_at", f"WITH {CDC} SELECT e AS src, t AS dst FROM (SELECT *, row_number() OVER (PARTITION BY e, t ORDER BY v DESC) AS n FROM cdc WHERE v <= 700) WHERE n = 1 AND op <> 'DELETE'")
def cdc_scan_at(spark, sf_dir):
    return cdc.scan_at(cdc.edge_records(change_log(spark, sf_dir)), 700).select("src", "dst")


@registered("watermark_gc", f"WITH {CDC}, i AS (SELECT e, t, v, op, lead(v) OVER (PARTITION BY e, t ORDER BY v) AS nxt FROM cdc) SELECT e AS src, t AS dst, v AS valid_from, CASE WHEN op = 'DELETE' THEN v ELSE nxt END AS valid_to FROM i WHERE CASE WHEN op = 'DELETE' THEN v ELSE nxt END IS NULL OR CASE WHEN op = 'DELETE' THEN v ELSE nxt END >= 600")
def watermark_gc(spark, sf_dir):
    log = change_log(spark, sf_dir)
    nxt = F.lead("commit_version").over(W.partitionBy("entity_id", "target_id").orderBy("commit_version"))
    edges = cdc.edge_records(log.withColumn("valid_to", F.coalesce(nxt, F.lit(0).cast("bigint"))))
    mark = cdc.safe_watermark(applied=900, oldest_query=600, now=2000, retention=1000)
    return cdc.collect_garbage(edges, mark).select("src", "dst", "valid_from", "valid_to")


@registered("retention", f"WITH {HIST} SELECT user_id, version FROM hist WHERE valid_to IS NULL OR valid_to >= {T0}")
def retention(spark, sf_dir):
    return writes.retention(user_history(spark, sf_dir), at(MOMENT)).select("user_id", "version")


@registered("cold_storage", f"WITH {HIST} SELECT 'cold' AS place, user_id, version FROM hist WHERE valid_to < {T0} UNION ALL SELECT 'kept', user_id, version FROM hist WHERE valid_to IS NULL OR valid_to >= {T0}")
def cold_storage(spark, sf_dir):
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    kept = writes.to_cold_storage(user_history(spark, sf_dir), at(MOMENT), path)
    cold = spark.read.parquet(path).select(F.lit("cold").alias("place"), "user_id", "version")
    return cold.unionByName(kept.select(F.lit("kept").alias("place"), "user_id", "version"))


# the cell store, batch writes, results row by row

CELLS = "cells AS (SELECT user_id AS entity_id, event_type AS col, ts, 0 AS seq, 'CREATE' AS op, event_id::VARCHAR AS value FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT user_id, 'click', ts, 1, 'DELETE', NULL FROM events WHERE event_type = 'error')"


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """Clicks and views are written, errors delete the click."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("column"), "ts", F.col("event_id").alias("value"))
    written = Store.empty(spark).put(e.where(F.col("column").isin("click", "view")))
    return written.delete(e.where("column = 'error'").withColumn("column", F.lit("click")).drop("value"))


@registered("store_put_delete", f"WITH {CELLS} SELECT entity_id, col, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, col ORDER BY ts DESC, seq DESC) AS n FROM cells WHERE ts <= {T0}) WHERE n = 1 AND op <> 'DELETE'")
def store_put_delete(spark, sf_dir):
    return _store(spark, sf_dir).get(MOMENT).withColumnRenamed("column", "col")


@registered("store_compact", f"WITH {CELLS} SELECT entity_id, col, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, col ORDER BY ts DESC, seq DESC) AS n FROM cells WHERE ts <= {T1}) WHERE n = 1 AND op <> 'DELETE'")
def store_compact(spark, sf_dir):
    return _store(spark, sf_dir).compact(MOMENT).get(LATER).withColumnRenamed("column", "col")


@registered("store_static", "SELECT c_custkey AS entity_id, 'name' AS col, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer")
def store_static(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cells = [c.select(F.col("c_custkey").alias("entity_id"), F.lit(n).alias("column"), F.col(v).alias("value")) for n, v in (("name", "c_name"), ("segment", "c_mktsegment"))]
    return Store.empty(spark).put_static(cells[0]).put_static(cells[1]).get(MOMENT).select("entity_id", F.col("column").alias("col"), "value")


@registered("store_edges", f"WITH {ELOG}, log AS (SELECT user_id AS src, item AS dst, ts, CASE WHEN op = 'DELETE' THEN 1 ELSE 0 END AS seq, op FROM elog WHERE item IS NOT NULL) SELECT src, dst, ts FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC, seq DESC) AS n FROM log WHERE ts <= {T0}) WHERE n = 1 AND op <> 'DELETE'")
def store_edges(spark, sf_dir):
    log = event_log(spark, sf_dir).where("item IS NOT NULL").select(F.col("user_id").alias("src"), F.col("item").alias("dst"), F.lit("LINKS").alias("type"), "ts", "op")
    written = Store.empty(spark).put_edges(log.where("op <> 'DELETE'")).delete_edges(log.where("op = 'DELETE'"))
    return written.neighbors(MOMENT).select("src", "dst", "ts")


@registered("batch_write", "SELECT (user_id % 8)::INT AS part, count(*) AS n, sum(event_id)::BIGINT AS keys FROM events GROUP BY 1")
def batch_write(spark, sf_dir):
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    partitioning.write_partitioned(table(spark, sf_dir, "events"), path, "user_id", 8)
    return spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("keys"))


@registered("result_stream", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def result_stream(spark, sf_dir):
    rows = GraphSession(spark, shop_graph(spark, sf_dir)).stream("MATCH (n:Nation) RETURN n.id AS id, n.n_name AS name")
    return spark.createDataFrame([tuple(r) for r in rows], "id long, name string")


@registered("session_function", "SELECT p_partkey AS id, reverse(p_name) AS back FROM part")
def session_function(spark, sf_dir):
    s = GraphSession(spark, shop_graph(spark, sf_dir))
    s.register_function("backwards", F.reverse)
    return s.query("MATCH (p:Part) RETURN p.id AS id, backwards(p.p_name) AS back")


text_query("fn_now", "MATCH (n:Nation) RETURN n.id AS id, now() > datetime('2024-01-01') AS later", "SELECT n_nationkey::BIGINT AS id, true AS later FROM nation")


@registered("profile", "SELECT 'Query' AS operator, count(DISTINCT c_mktsegment) AS rows FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000")
def profile(spark, sf_dir):
    return GraphSession(spark, shop_graph(spark, sf_dir)).profile("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 1000 RETURN c.c_mktsegment AS segment, count(*) AS n").where("depth = 0").select("operator", "rows")


@registered("batch_neighbors_where", f"WITH {LINKS}, asked AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') SELECT src AS id, dst AS neighbor FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM links WHERE src IN (SELECT user_id FROM asked) AND ts < {T1}) WHERE n <= 4")
def batch_neighbors_where(spark, sf_dir):
    asked = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id")
    return traverse.neighbors(link_edges(spark, sf_dir), asked, limit=4, where=F.col("ts") < at(LATER)).select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))


# catalog


@registered("show_labels", "SELECT unnest(['Customer', 'Nation', 'Order', 'Part', 'Person', 'Region', 'State', 'Supplier']) AS name")
def show_labels(spark, sf_dir):
    return GraphSession(spark, shop_graph(spark, sf_dir)).query("SHOW LABELS").select(F.col("Name").alias("name"))


@registered("show_edges", "SELECT * FROM (VALUES ('ACTED', 'Person', 'Person'), ('CONTAINS', 'Order', 'Part'), ('IN_NATION', 'Customer', 'Nation'), ('IN_NATION', 'Supplier', 'Nation'), ('IN_REGION', 'Nation', 'Region'), ('LINKS', 'Person', 'Person'), ('PLACED', 'Customer', 'Order'), ('SUPPLIED_BY', 'Order', 'Supplier')) t(name, source, target)")
def show_edges(spark, sf_dir):
    return GraphSession(spark, shop_graph(spark, sf_dir)).query("SHOW EDGES").select(F.col("Name").alias("name"), F.col("Source").alias("source"), F.col("Target").alias("target"))


@registered("show_hotspots", "SELECT * FROM (VALUES ('Customer', 'id', 2), ('Order', '', 1), ('PLACED', '', 1)) t(entity, property, n)")
def show_hotspots(spark, sf_dir):
    s = GraphSession(spark, shop_graph(spark, sf_dir))
    s.query("MATCH (c:Customer {id: 1})-[:PLACED]->(o:Order) RETURN o.id AS id")
    s.query("MATCH (c:Customer {id: 2}) RETURN c.c_name AS name")
    return s.query("SHOW HOTSPOTS").select(F.col("Entity_ID").alias("entity"), F.col("Column_ID").alias("property"), F.col("Query_Count").alias("n"))


@registered("show_parts", "SELECT unnest(['Customer', 'Nation', 'Order', 'Part', 'Person', 'Region', 'State', 'Supplier']) AS label")
def show_parts(spark, sf_dir):
    parts = GraphSession(spark, shop_graph(spark, sf_dir)).query("SHOW PARTS").where("State = 'Normal'")
    return parts.select(F.substring_index("Partition", "/", 1).alias("label")).distinct()


@registered("show_hosts", "SELECT 'ONLINE' AS state")
def show_hosts(spark, sf_dir):
    return GraphSession(spark, shop_graph(spark, sf_dir)).query("SHOW HOSTS").select(F.col("State").alias("state"))


@registered("show_spaces", "SELECT unnest(['archive', 'shop']) AS name")
def show_spaces(spark, sf_dir):
    s = GraphSession(spark, shop_graph(spark, sf_dir))
    s.add_space("archive", s.graph.as_of("1996-01-01"))
    return s.query("SHOW SPACES").select(F.col("Name").alias("name"))


@registered("use_space", "SELECT count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01'")
def use_space(spark, sf_dir):
    s = GraphSession(spark, shop_graph(spark, sf_dir))
    s.add_space("archive", s.graph.as_of("1996-01-01"))
    s.query("USE archive")
    return s.query("MATCH (o:Order) RETURN count(*) AS n")


@registered("alter_add_prop", "SELECT n_nationkey::BIGINT AS id, n_name AS title, CAST(NULL AS VARCHAR) AS motto, n_regionkey::VARCHAR AS region FROM nation")
def alter_add_prop(spark, sf_dir):
    s = GraphSession(spark, shop_graph(spark, sf_dir))
    for text in ("ADD PROPERTY motto string", "RENAME PROPERTY n_name TO title", "MODIFY PROPERTY n_regionkey string", "DROP PROPERTY n_nationkey"):
        s.query(f"ALTER TAG Nation {text}")
    return s.query("MATCH (n:Nation) RETURN n.id AS id, n.title AS title, n.motto AS motto, n.n_regionkey AS region")


# merging results of several parts, as a query tier would


@registered("merge_sorted_page", "SELECT DISTINCT c_nationkey AS nation FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) ORDER BY 1 NULLS FIRST LIMIT 10 OFFSET 5")
def merge_sorted_page(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.unionByName(b).distinct().orderBy(F.col("nation").asc_nulls_first()).offset(5).limit(10)


@registered("partition_by_time", "SELECT (epoch_us(ts) // 3600000000) AS hour, (user_id % 8)::INT AS part, count(*) AS n FROM events GROUP BY 1, 2")
def partition_by_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("hour", F.expr("unix_micros(cast(ts AS TIMESTAMP)) div 3600000000")).withColumn("part", (F.col("user_id") % 8).cast("int"))
    return e.groupBy("hour", "part").agg(F.count(F.lit(1)).alias("n"))


# the storage-level scans


@registered("predicate_scan", f"SELECT event_id, user_id, value FROM events WHERE value >= 50 AND event_type IN ('click', 'view') AND contains(props, '7') AND ts BETWEEN {T0} AND {T1}")
def predicate_scan(spark, sf_dir):
    p = scans.Predicate([("value", ">=", 50), ("event_type", "in", ["click", "view"]), ("props", "like", "7")], (MOMENT, LATER), ["event_id", "user_id", "value"])
    return scans.scan(table(spark, sf_dir, "events"), p)


@registered("predicate_aggregate", "SELECT count(*) AS n, min(value) AS low, max(value) AS high FROM events WHERE event_type <> 'error'")
def predicate_aggregate(spark, sf_dir):
    p = scans.Predicate([("event_type", "<>", "error")], aggregate=[F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")])
    return scans.scan(table(spark, sf_dir, "events"), p)


@registered("scan_ids_limit", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey BETWEEN 50 AND 5000 ORDER BY 1 LIMIT 25")
def scan_ids_limit(spark, sf_dir):
    return scans.scan_ids(table(spark, sf_dir, "orders"), 50, 5000, 25, key="o_orderkey").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@registered("batch_get_table", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)")
def batch_get_table(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_totalprice > 490000").select("o_custkey")
    return scans.batch_get(table(spark, sf_dir, "customer"), wanted, "c_custkey").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@registered("get_node_snapshot", f"WITH {LIFE} SELECT user_id, max(ts) AS ts, max_by(value, ts) AS value FROM events WHERE user_id = 7 AND ts <= {T0} AND (SELECT max_by(event, ts) FROM life WHERE entity_id = 7 AND ts <= {T0}) <> 'Deleted' GROUP BY 1")
def get_node_snapshot(spark, sf_dir):
    return scans.get_node(user_history(spark, sf_dir), lifecycle(spark, sf_dir), 7, MOMENT, ("user_id",))


@registered("snapshot_edges_live_ends", f"WITH {ELOG}, {LIFE}, f AS (SELECT user_id AS src, item AS dst FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, seq DESC) AS n FROM elog WHERE ts <= {T0}) WHERE n = 1 AND op <> 'DELETE'), gone AS (SELECT entity_id FROM life WHERE ts <= {T0} GROUP BY 1 HAVING max_by(event, ts) = 'Deleted') SELECT src, dst FROM f WHERE src NOT IN (SELECT entity_id FROM gone) AND dst NOT IN (SELECT entity_id FROM gone)")
def snapshot_edges_live_ends(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumnsRenamed({"user_id": "src", "item": "dst"})
    return scans.snapshot_edges(log, lifecycle(spark, sf_dir), MOMENT).select("src", "dst")


@registered("temporal_query_changes", f"SELECT user_id, ts, value FROM events WHERE ts >= {T0} AND ts < {T1}")
def temporal_query_changes(spark, sf_dir):
    return scans.temporal_query(user_history(spark, sf_dir), ["user_id"], "changes_in_range", "value", MOMENT, LATER)


@registered("temporal_query_latest", "SELECT user_id, max(ts) AS ts, max_by(value, ts) AS value FROM events GROUP BY 1")
def temporal_query_latest(spark, sf_dir):
    return scans.temporal_query(user_history(spark, sf_dir), ["user_id"], "latest", "value")


@registered("portion_of", f"WITH {HIST}, h AS (SELECT user_id, version, value, valid_from, coalesce(valid_to, TIMESTAMP '9999-12-31') AS t FROM hist), cut AS (SELECT user_id, version, value, valid_from AS s, least(t, {T0}) AS e FROM h UNION ALL SELECT user_id, version, -1.0, greatest(valid_from, {T0}), least(t, {T1}) FROM h UNION ALL SELECT user_id, version, value, greatest(valid_from, {T1}), t FROM h) SELECT user_id, version, value, s AS valid_from, nullif(e, TIMESTAMP '9999-12-31') AS valid_to FROM cut WHERE s < e")
def portion_of(spark, sf_dir):
    h = user_history(spark, sf_dir).select("user_id", "version", "value", "valid_from", "valid_to")
    return fold.portion_of(h, MOMENT, LATER, {"value": F.lit(-1.0)})


@registered("commit_path", "SELECT user_id AS txn_id, CASE WHEN count(DISTINCT item % 4) = 1 THEN 'single-partition' WHEN count(DISTINCT epoch_us(ts) // 86400000000) = 1 THEN 'same-window' ELSE 'cross-window' END AS path FROM (SELECT event_id // 3 AS user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, ts FROM events) GROUP BY 1")
def commit_path(spark, sf_dir):
    log = event_log(spark, sf_dir).select(F.expr("seq div 3").alias("txn_id"), F.col("item").alias("key"), micros(F.col("ts")).alias("at"))
    return partitioning.commit_path(log, 4, parse_duration("1d"))


@registered("affinity_placement", f"WITH {LINKS}, placed AS (SELECT DISTINCT dst AS id, (dst % 3)::INT AS part FROM links), b AS (SELECT src, dst, ts FROM links UNION ALL SELECT dst, src, ts FROM links), n AS (SELECT src AS id, part, count(*) AS n FROM b JOIN placed ON dst = placed.id GROUP BY 1, 2), l AS (SELECT part, count(*) / (SELECT count(*) FROM placed)::DOUBLE AS share FROM placed GROUP BY 1), s AS (SELECT id, n.part, n / sum(n) OVER (PARTITION BY id) - 0.5 * share AS score FROM n JOIN l ON n.part = l.part) SELECT id, part FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, part) AS k FROM s) WHERE k = 1 AND score = score")
def affinity_placement(spark, sf_dir):
    links = link_edges(spark, sf_dir)
    placed = links.select(F.col("dst").alias("id"), (F.col("dst") % 3).cast("int").alias("part")).distinct()
    scored = partitioning.affinity_scores(links, placed, at(LATER), parse_duration("1d"), temporal=0.0)
    best = scored.groupBy("id").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("part")).alias("p"))).alias("b"))
    return best.select("id", (-F.col("b.p")).alias("part"))


@registered("txn_neighbors", f"WITH {ELOG} SELECT user_id AS src, item AS dst FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, seq DESC) AS n FROM elog WHERE seq < 500) WHERE n = 1 AND op <> 'DELETE' AND user_id IN (3, 7)")
def txn_neighbors(spark, sf_dir):
    """Neighbours as a transaction that began before record 500 reads them."""
    log = event_log(spark, sf_dir).where("seq < 500 AND user_id IN (3, 7)")
    return fold.fold(log, ["user_id", "item"]).select(F.col("user_id").alias("src"), F.col("item").alias("dst"))

"""The query language: grammar, three-valued logic, joins, ordering, writes, time travel."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timeweave.graph import TemporalGraph
from timeweave.plans.compiler import QueryError
from timeweave.plans.parser import QuerySyntaxError, parse
from timeweave.session import GraphSession

DAY = lambda n: dt.datetime(2024, 1, n)


@pytest.fixture()
def people(spark):
    nodes = spark.createDataFrame([(1, "Ann", 30), (2, "Bob", None), (3, "Cid", 41), (4, "Ann", 30)], "id long, name string, age long")
    knows = spark.createDataFrame([(1, 2, 5.0, DAY(1), None), (2, 3, 2.0, DAY(3), DAY(6)), (3, 1, 1.0, DAY(4), None), (1, 1, 9.0, DAY(1), None)], "src long, dst long, w double, valid_from timestamp_ntz, valid_to timestamp_ntz")
    cities = spark.createDataFrame([(1, "Oslo"), (2, "Rome")], "id long, city string")
    lives = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "src long, dst long")
    graph = TemporalGraph(spark).with_nodes("Person", nodes).with_nodes("City", cities).with_edges("KNOWS", "Person", "Person", knows).with_edges("LIVES_IN", "Person", "City", lives)
    return GraphSession(spark, graph)


def rows(session, text, **params):
    return [tuple(r) for r in session.query(text, **params).collect()]


def some(session, text, **params):
    return sorted(rows(session, text, **params), key=str)


def test_filter_project_and_names(people):
    df = people.query("MATCH (p:Person) WHERE p.age > 35 RETURN p.name, p.age + 1 AS next, p.age * 2")
    assert df.columns == ["name", "next", "p.age * 2"]
    assert [tuple(r) for r in df.collect()] == [("Cid", 42, 82)]


def test_unlabelled_unknown_property_is_null(people):
    assert some(people, "MATCH (x) WHERE x.city IS NOT NULL RETURN x.id AS id, labels(x) AS l, x.age AS age") == [(1, ["City"], None), (2, ["City"], None)]


def test_three_valued_logic(people):
    got = rows(people, "UNWIND [true, false, null] AS a RETURN a AND null AS x, a OR null AS y, NOT a AS z, a = null AS e")
    assert got == [(None, True, False, None), (False, None, True, None), (None, None, None, None)]


def test_not_binds_looser_than_comparison(people):
    assert some(people, "MATCH (p:Person) WHERE NOT p.age > 35 RETURN p.id AS id") == [(1,), (4,)]


def test_directions(people):
    assert some(people, "MATCH (a:Person {id: 1})-[:KNOWS]->(b) RETURN b.id AS id") == [(1,), (2,)]
    assert some(people, "MATCH (a:Person {id: 1})<-[:KNOWS]-(b) RETURN b.id AS id") == [(1,), (3,)]
    assert some(people, "MATCH (a:Person {id: 1})-[:KNOWS]-(b) RETURN b.id AS id") == [(1,), (2,), (3,)]  # the loop once


def test_relationships_are_unique_in_a_match(people):
    assert rows(people, "MATCH (a:Person {id: 2})-[:KNOWS]-(b)-[:KNOWS]-(a) RETURN count(*) AS n") == [(0,)]


def test_variable_length(people):
    assert some(people, "MATCH (a:Person {id: 1})-[:KNOWS*1..2]->(b) RETURN b.id AS id") == [(1,), (2,), (2,), (3,)]
    assert some(people, "MATCH p = (a:Person {id: 2})-[:KNOWS*2]->(b) RETURN b.id AS id, length(p) AS n") == [(1, 2)]
    assert some(people, "MATCH (a:Person {id: 2})-[:KNOWS*0..1]->(b) RETURN b.id AS id") == [(2,), (3,)]
    assert some(people, "MATCH (a:Person {id: 2})-[:KNOWS*]->(b) RETURN b.id AS id, count(*) AS n") == [(1, 2), (2, 2), (3, 1)]


def test_variable_length_from_a_bound_node(people):
    text = "MATCH (c:City {city: 'Oslo'})<-[:LIVES_IN]-(a) MATCH (a)-[:KNOWS*1..2]->(b) RETURN a.id AS a, b.id AS b"
    assert some(people, text) == [(1, 1), (1, 2), (1, 2), (1, 3), (3, 1), (3, 1), (3, 2)]


def test_optional_match(people):
    text = "MATCH (p:Person) OPTIONAL MATCH (p)-[r:KNOWS]->(q:Person) WHERE r.w < 3 RETURN p.id AS id, q.id AS q, q IS NULL AS none"
    assert some(people, text) == [(1, None, True), (2, 3, False), (3, 1, False), (4, None, True)]


def test_patterns_joined_on_shared_variables(people):
    assert some(people, "MATCH (a:Person)-[:KNOWS]->(b), (a)-[:LIVES_IN]->(c), (b)-[:LIVES_IN]->(c) RETURN a.id AS a, b.id AS b, c.city AS city") == [(3, 1, "Oslo")]  # 1 knows itself, but would live in Oslo by one relationship twice


def test_exists_and_not(people):
    assert some(people, "MATCH (p:Person) WHERE (p)-[:LIVES_IN]->(:City {city: 'Rome'}) RETURN p.id AS id") == [(2,)]
    assert some(people, "MATCH (p:Person) WHERE NOT (p)-[:LIVES_IN]->() RETURN p.id AS id") == [(4,)]


def test_aggregation(people):
    assert some(people, "MATCH (p:Person) RETURN p.name AS name, count(*) AS n, count(p.age) AS k, sum(p.age) AS s, collect(p.age) AS ages") == [("Ann", 2, 2, 60, [30, 30]), ("Bob", 1, 0, 0, []), ("Cid", 1, 1, 41, [41])]
    assert rows(people, "MATCH (p:Person) WHERE p.id > 99 RETURN count(*) AS n, max(p.age) AS m") == [(0, None)]
    assert rows(people, "MATCH (p:Person) WHERE p.id > 99 RETURN p.name AS x, count(*) AS n") == []
    assert rows(people, "MATCH (p:Person) RETURN count(DISTINCT p.age) AS n") == [(2,)]


def test_with_is_a_barrier_and_having(people):
    assert rows(people, "MATCH (p:Person) WITH p.name AS name, count(*) AS n WHERE n > 1 RETURN name") == [("Ann",)]
    with pytest.raises(QueryError):
        people.query("MATCH (p:Person) WITH p.name AS name RETURN p.age")


def test_sort_nulls_skip_limit_distinct(people):
    assert rows(people, "MATCH (p:Person) RETURN p.age AS a, p.id AS id ORDER BY a, id") == [(30, 1), (30, 4), (41, 3), (None, 2)]
    assert rows(people, "MATCH (p:Person) RETURN p.id AS id ORDER BY p.age DESC, p.id SKIP 1 LIMIT 2") == [(3,), (1,)]
    assert rows(people, "MATCH (p:Person) RETURN DISTINCT p.name AS n ORDER BY n LIMIT 2") == [("Ann",), ("Bob",)]
    assert rows(people, "MATCH (p:Person) RETURN p.id AS id LIMIT 0") == []


def test_union_call_unwind(people):
    assert some(people, "RETURN 1 AS x UNION RETURN 1 AS x UNION RETURN 2 AS x") == [(1,), (2,)]
    assert some(people, "RETURN 1 AS x UNION ALL RETURN 1 AS x") == [(1,), (1,)]
    assert some(people, "MATCH (c:City) CALL { WITH c MATCH (p:Person)-[:LIVES_IN]->(c) RETURN count(*) AS n } RETURN c.city AS city, n") == [("Oslo", 2), ("Rome", 1)]
    assert rows(people, "UNWIND [] AS x RETURN x") == []
    assert some(people, "UNWIND $xs AS x RETURN x * 2 AS y", xs=[1, 2]) == [(2,), (4,)]


def test_arithmetic(people):
    assert rows(people, "RETURN 7 / 2 AS a, -7 / 2 AS b, 7 % 0 AS c, 7 / 0 AS d, 7.0 / 2 AS e, 'a' + 1 AS f, -(-3) AS g") == [(3, -3, None, None, 3.5, "a1", 3)]


def test_strings_and_lists(people):
    assert rows(people, "RETURN substring('hello', 1, 3) AS a, trim(' \\tx\\n') AS b, [1, 2, 3][5] AS c, size('héé') AS d, size([1, 2]) AS e, 'x' IN ['x', 'y'] AS f, {a: 1}.a AS g") == [("ell", "x", None, 3, 2, True, 1)]


def test_time_travel(people):
    count = "RETURN count(*) AS n"
    assert rows(people, f"AS OF '2024-01-02' MATCH (:Person)-[r:KNOWS]->(:Person) {count}") == [(2,)]
    assert rows(people, f"MATCH (:Person)-[r:KNOWS]->(:Person) AS OF '2024-01-05' {count}") == [(4,)]
    assert rows(people, f"MATCH (:Person)-[r:KNOWS]->(:Person) AS OF '2024-01-06' {count}") == [(3,)]  # half-open
    assert rows(people, f"BETWEEN '2024-01-02' AND '2024-01-04' MATCH (:Person)-[r:KNOWS]->(:Person) {count}") == [(3,)]
    assert rows(people, f"CONTAINED IN ('2024-01-02', '2024-01-07') MATCH (:Person)-[r:KNOWS]->(:Person) {count}") == [(1,)]
    assert rows(people, f"ALL VERSIONS MATCH (:Person)-[r:KNOWS]->(:Person) {count}") == [(4,)]
    assert rows(people, "RETURN datetime('2024-01-02') + duration('1d') AS t, datetime('2024-01-02') - datetime('2024-01-01') AS us") == [(DAY(3), 86400000000)]


def test_path_semantics(people, spark):
    two = "MATCH (a:Person)-[:KNOWS]->(b:Person)-[:KNOWS]->(c:Person) {} RETURN a.id AS a, b.id AS b, c.id AS c"
    assert some(people, two.format("PATH SEQUENTIAL")) == [(1, 1, 2), (1, 2, 3), (2, 3, 1)]
    assert len(rows(people, two.format("PATH CONTINUOUS"))) == 5
    assert some(people, two.format("BETWEEN '2024-01-07' AND '2024-01-08' PATH CONTINUOUS")) == [(1, 1, 2), (3, 1, 1), (3, 1, 2)]
    walk = "MATCH p = (a:Person {id: 2})-[:KNOWS*3]->(b:Person) PATH CONTINUOUS RETURN b.id AS b, valid_from(p) AS since, valid_to(p) AS till"
    assert some(people, walk) == [(1, DAY(4), DAY(6)), (2, DAY(4), DAY(6))]
    assert len(rows(people, "MATCH (a:Person)-[:KNOWS]->(b:Person)-[:LIVES_IN]->(c:City) PATH CONTINUOUS RETURN c.id AS c")) == 4  # always valid
    chain = spark.createDataFrame([(1, 2, DAY(1), DAY(3)), (2, 3, DAY(2), DAY(5)), (3, 4, DAY(4), DAY(6)), (3, 5, DAY(5), None)], "src long, dst long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    s = GraphSession(spark, TemporalGraph(spark).with_nodes("N", spark.range(1, 6)).with_edges("E", "N", "N", chain))
    for semantics, ends in (("SNAPSHOT", [4, 5]), ("PAIRWISE", [4]), ("CONTINUOUS", []), ("SEQUENTIAL", [4, 5])):
        assert some(s, f"MATCH (a:N {{id: 1}})-[:E]->()-[:E]->()-[:E]->(d:N) PATH {semantics} RETURN d.id AS d") == [(x,) for x in ends]
        assert some(s, f"MATCH (a:N {{id: 1}})-[:E*3]->(d:N) PATH {semantics} RETURN d.id AS d") == [(x,) for x in ends]
    with pytest.raises(QuerySyntaxError):
        parse("MATCH (a)-[r]->(b) PATH STRAIGHT RETURN a")


def test_windowed_aggregates(people):
    df = people.query("MATCH (a:Person)-[r:KNOWS]->(b:Person) RETURN count(r.w) WINDOW 2d AS n, sum(r.w) WINDOW 2d AS w ORDER BY window_start")
    assert df.columns == ["n", "w", "window_start", "window_end"]
    assert [tuple(r) for r in df.collect()] == [(2, 14.0, dt.datetime(2023, 12, 31), DAY(2)), (1, 2.0, DAY(2), DAY(4)), (1, 1.0, DAY(4), DAY(6))]
    sliding = "MATCH (a:Person)-[r:KNOWS]->(b:Person) RETURN a.id AS a, count(*) WINDOW 2d SLIDE 1d ON r.valid_from AS n"
    assert [r for r in some(people, sliding) if r[0] == 2] == [(2, 1, DAY(2), DAY(4)), (2, 1, DAY(3), DAY(5))]
    assert rows(people, "MATCH (a:Person)-[r:KNOWS]->(b:Person) WHERE r.w > 99 RETURN count(*) WINDOW 1d ON r.valid_from AS n") == []
    for wrong in ("count(*) WINDOW 1d AS n", "count(*) WINDOW 1d ON a.name AS n", "count(*) WINDOW 1d ON r.valid_from AS n, sum(r.w) WINDOW 2d AS w", "coalesce(a.id) WINDOW 1d ON r.valid_from AS n"):
        with pytest.raises(QueryError):
            people.query(f"MATCH (a:Person)-[r:KNOWS]->(b:Person) RETURN {wrong}")


def test_writes(people):
    people.query("CREATE (p:Person {id: 9, name: 'Eve'})-[:LIVES_IN]->(c:City {id: 7, city: 'Bern'})")
    assert rows(people, "MATCH (p:Person {id: 9})-[:LIVES_IN]->(c) RETURN p.name AS name, p.age AS age, c.city AS city") == [("Eve", None, "Bern")]
    people.query("MATCH (p:Person) WHERE p.name = 'Ann' SET p.age = p.age + 1, p.nick = 'A'")
    assert some(people, "MATCH (p:Person) RETURN p.id AS id, p.age AS age, p.nick AS nick") == [(1, 31, "A"), (2, None, None), (3, 41, None), (4, 31, "A"), (9, None, None)]
    people.query("MATCH (a:Person {id: 1})-[r:KNOWS]->(b) WHERE b.id = 2 DELETE r")
    assert some(people, "MATCH (a:Person {id: 1})-[:KNOWS]->(b) RETURN b.id AS id") == [(1,)]
    people.query("MATCH (p:Person {id: 3}) DETACH DELETE p")
    assert some(people, "MATCH (a)-[:KNOWS]->(b) RETURN a.id AS a, b.id AS b") == [(1, 1)]
    people.query("UNWIND [1, 10, 10] AS k MERGE (p:Person {id: k, name: 'new'})")
    assert some(people, "MATCH (p:Person) WHERE p.name = 'new' RETURN p.id AS id") == [(10,)]


def test_ids_are_generated_after_the_largest(people):
    people.query("UNWIND ['x', 'y'] AS n CREATE (p:Person {name: n})")
    ids = [r[0] for r in rows(people, "MATCH (p:Person) WHERE p.name IN ['x', 'y'] RETURN p.id AS id")]
    assert len(set(ids)) == 2 and min(ids) > 4


def test_catalog(people):
    assert some(people, "SHOW SPACES") == [("default",)]
    people.add_space("old", people.graph)
    people.query("USE old")
    people.query("ALTER TAG City ADD PROPERTY size long")
    assert rows(people, "MATCH (c:City) RETURN count(c.size) AS n") == [(0,)]
    people.query("USE default")
    assert "size" not in people.graph.nodes["City"].df.columns
    for name in ("LABELS", "EDGES", "INDEXES", "PARTS", "HOSTS"):
        assert people.query(f"SHOW {name}").count() > 0


def test_transactions(people):
    people.begin()
    people.query("MATCH (p:Person) DETACH DELETE p")
    assert rows(people, "MATCH (p:Person) RETURN count(*) AS n") == [(0,)]
    people.rollback()
    assert rows(people, "MATCH (p:Person) RETURN count(*) AS n") == [(4,)]
    people.begin()
    people.query("CREATE (p:Person {id: 77})")
    people.commit()
    assert rows(people, "MATCH (p:Person) RETURN count(*) AS n") == [(5,)]
    with pytest.raises(QueryError):
        people.rollback()


def test_bound_times(people):
    assert rows(people, "AS OF '2024-01-02' RETURN valid_time() AS t") == [(DAY(2),)]
    assert rows(people, "RETURN transaction_time() IS NOT NULL AS t") == [(True,)]


@pytest.mark.parametrize("format", ["parquet", "csv", "json", "orc"])
def test_read_table(spark, tmp_path, format):
    from timeweave.sources.tables import read_table

    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    df.write.format(format).option("header", True).save(f"file://{tmp_path}/t")
    assert sorted(map(tuple, read_table(spark, f"file://{tmp_path}/t", format, "id long, name string", header=True).collect())) == [(1, "a"), (2, None)]


def test_explain_profile_and_validity(people):
    text = "MATCH (a:Person)-[:KNOWS*1..2]->(b) WHERE a.age > 1 RETURN b.id AS id ORDER BY id LIMIT 3"
    plan = people.explain(text)
    for word in ("VariableLengthExpand", "NodeScan(a:Person)", "Filter", "Sort", "Limit", "Physical Plan"):
        assert word in plan
    assert people.query(f"EXPLAIN {text}").count() > 5
    text = "MATCH (p:Person) WHERE p.age > 0 RETURN p.age AS age, count(*) AS n"
    for found in (people.profile(text), people.query(f"PROFILE {text}")):
        ops = found.collect()
        assert ops[0]["operator"] == "Query" and ops[0]["rows"] == len(rows(people, text))
        kept = rows(people, "MATCH (p:Person) WHERE p.age > 0 RETURN count(*) AS n")[0][0]
        assert [o["rows"] for o in ops if o["operator"] == "Filter"] == [kept] and any(o["operator"] == "HashAggregate" and o["rows"] == ops[0]["rows"] for o in ops)
    assert people.is_valid(text) and not people.is_valid("MATCH (a RETURN")


@pytest.mark.parametrize("text", ["MATCH (a", "RETURN", "MATCH (a) RETURN a.b.", "MATCH (a)-[r>(b) RETURN 1", "RETURN 'open", "RETURN 1 LIMIT", "MATCH (a) RETURN a # b", ""])
def test_bad_syntax_raises(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


@pytest.mark.parametrize("text", ["MATCH (x:Nobody) RETURN x.id", "MATCH (a)-[:NOTHING]->(b) RETURN 1 AS x", "RETURN y", "RETURN nosuch(1) AS x", "MATCH (p:Person) RETURN p.id AS a, p.id AS a", "MATCH (p:Person) RETURN p.id LIMIT -1", "MATCH (p:Person)"])
def test_bad_queries_raise(people, text):
    with pytest.raises(QueryError):
        people.query(text)


def test_registered_function(people):
    people.register_function("twice", lambda c: c * 2)
    assert rows(people, "RETURN twice(4) AS x") == [(8,)]
    with pytest.raises(QueryError):
        GraphSession(people.spark, people.graph).query("RETURN twice(4) AS x")


def test_hotspots_and_long_runs_of_writes(people):
    people.query("MATCH (p:Person {id: 1})-[:KNOWS]->(q:Person) RETURN q.id AS id")
    people.query("MATCH (p:Person) RETURN p.id AS id")
    got = [tuple(r)[:3] for r in people.query("SHOW HOTSPOTS").collect()]
    assert got == [("Person", "", 2), ("KNOWS", "", 1), ("Person", "id", 1)]
    for i in range(17):
        people.query(f"CREATE (p:Person {{id: {1000 + i}, name: 'n'}})")
    assert rows(people, "MATCH (p:Person) WHERE p.name = 'n' RETURN count(*) AS n") == [(17,)]
    assert people.graph.nodes["Person"].df._jdf.queryExecution().logical().toString().count("Union") <= 1


def test_saved_graph_round_trip(people, tmp_path):
    from timeweave.catalog import load_graph, save_graph

    save_graph(people.graph, f"file://{tmp_path}")
    back = load_graph(people.spark, f"file://{tmp_path}")
    text = "MATCH (a:Person)-[r]->(b) RETURN a.id AS a, type(r) AS t, b.id AS b"
    assert some(GraphSession(people.spark, back), text) == some(people, text)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("wide")).write.parquet(f"{tmp_path}/n")
    graph = TemporalGraph(spark).with_nodes("N", spark.read.parquet(f"{tmp_path}/n"))
    plan = GraphSession(spark, graph).explain("MATCH (n:N) WHERE n.k = 3 RETURN n.id AS id")
    assert "EqualTo(k,3)" in plan and "wide" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_floats_per_node_are_added_in_order_of_ids(spark):
    values = [1e16, 1.0, -1e16, 0.5]
    lists = spark.createDataFrame([(k,) for k in range(6)], "id long")
    for shift in range(4):  # however the rows lie
        items = spark.createDataFrame([(k * 10 + i, values[i]) for k in range(6) for i in [(j + shift) % 4 for j in (2, 0, 3, 1)]], "id long, v double")
        holds = spark.createDataFrame([(k, k * 10 + i) for k in range(6) for i in range(4)], "src long, dst long")
        graph = TemporalGraph(spark).with_nodes("L", lists).with_nodes("I", items).with_edges("HOLDS", "L", "I", holds)
        session = GraphSession(spark, graph)
        assert some(session, "MATCH (l:L)-[:HOLDS]->(i:I) RETURN l.id AS id, sum(i.v) AS total, count(*) AS n") == [(k, 0.5, 4) for k in range(6)]
        assert some(session, "MATCH (l:L)-[:HOLDS]->(i:I) WITH l, sum(-i.v) AS total, max(i.v) AS top WHERE total < 0 RETURN l.id AS id, top ORDER BY total") == [(k, 1e16) for k in range(6)]
    assert some(session, "MATCH (l:L) OPTIONAL MATCH (l)-[:HOLDS]->(i:I) WHERE i.v > 5e16 RETURN l.id AS id, sum(i.v) AS total ORDER BY sum(i.v), l.id") == [(k, 0.0) for k in range(6)]


@pytest.mark.parametrize("semantics", ["SNAPSHOT", "PAIRWISE", "CONTINUOUS", "SEQUENTIAL", None])
def test_two_edges_are_counted_without_a_table_of_paths(spark, semantics):
    import random

    rng = random.Random(3)
    span = lambda: (a := rng.randrange(1, 20), rng.choice([None, a + rng.randrange(1, 9)]))
    edge = lambda: (rng.randrange(4), rng.randrange(4), *[x and DAY(x) for x in span()])
    schema = "src long, dst long, valid_from timestamp_ntz, valid_to timestamp_ntz, edge_id long"
    e, f = (spark.createDataFrame([(*edge(), i) for i in range(60)], schema) for _ in "ef")
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 3)], "id long")  # one row twice
    graph = TemporalGraph(spark).with_nodes("N", nodes).with_edges("E", "N", "N", e).with_edges("F", "N", "N", f)
    session = GraphSession(spark, graph)
    path = f"BETWEEN '2024-01-08' AND '2024-01-10' PATH {semantics}" if semantics else ""
    for pattern in ("-[:E]->(b:N)-[:E]->", "-[:E]->(b:N)<-[:E]-", "-[:E]-(b:N)-[:E]-", "-[:E]->(b:N)-[:F]->", "<-[:E|F]-(b:N)<-[:F]-"):
        text = f"MATCH (a:N){pattern}(c:N) {path} {{}} RETURN a.id AS a, count(*) AS n, b.id AS b, c.id AS c"
        got, plain = session.query(text.format("")), session.query(text.format("WHERE a.id = a.id"))
        assert got.schema.simpleString() == plain.schema.simpleString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) != []
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert -1 < plan.find("Join") < plan.find("Aggregate")  # nothing is grouped after the join
    ranked = "MATCH (a:N)-[:E]->(b:N)-[:E]->(c:N) {} WITH a.id AS a, b.id AS b, c.id AS c, count(*) AS n ORDER BY count(*) DESC, a, b, c LIMIT 7 WHERE n > 2 RETURN a, b, c, n ORDER BY n, c, b, a"
    assert rows(session, ranked.format("")) == rows(session, ranked.format("WHERE a.id = a.id"))

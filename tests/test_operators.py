"""Folds, intervals, traversal, strict updates and change streams, on small literals."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timeweave.functions.temporal import parse_duration, parse_timestamp
from timeweave.graph import TemporalGraph
from timeweave.operators import fold, intervals, traverse, writes
from timeweave.streaming import cdc, windows

T = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def log(spark, rows):
    return spark.createDataFrame([(k, T(t), s, op, v) for k, t, s, op, v in rows], "k long, ts timestamp_ntz, seq long, op string, v long")


def test_fold_delete_wins_and_recreate(spark):
    df = log(spark, [(1, 1, 1, "CREATE", 10), (1, 2, 2, "DELETE", None), (2, 1, 3, "CREATE", 20), (3, 1, 4, "CREATE", 1), (3, 2, 5, "DELETE", None), (3, 3, 6, "CREATE", 2)])
    assert ids(fold.fold(df, ["k"]), "k", "v") == [(2, 20), (3, 2)]
    assert ids(fold.fold(df, ["k"], as_of=T(1)), "k", "v") == [(1, 10), (2, 20), (3, 1)]
    assert ids(fold.fold(fold.fold(df, ["k"]), ["k"]), "k", "v") == ids(fold.fold(df, ["k"]), "k", "v")


def test_fold_ties_go_by_sequence(spark):
    df = log(spark, [(1, 1, 2, "CREATE", 2), (1, 1, 1, "CREATE", 1)])
    assert ids(fold.fold(df, ["k"]), "v") == [(2,)]


def test_versions(spark):
    df = log(spark, [(1, t, t, "CREATE", t * 10) for t in (1, 3, 5)])
    assert ids(fold.intervals(df, ["k"]), "version", "valid_from") == [(0, T(1)), (1, T(3)), (2, T(5))]
    assert ids(fold.version_k(df, ["k"], 1), "v") == [(30,)]
    assert ids(fold.first_last(df, ["k"], "v"), "first_value", "last_value") == [(10, 50)]
    assert ids(fold.prev_next(df, ["k"], T(4), "v"), "prev_value", "next_value") == [(30, 50)]
    assert ids(fold.get_at_time(df, ["k"], T(4), "v"), "v") == [(30,)]
    assert ids(fold.scan_limit(df, ["k"], 2), "v") == [(30,), (50,)]
    assert ids(fold.snapshot_diff(df, ["k"], T(0), T(2), "v"), "change", "new_value") == [("added", 10)]
    assert ids(fold.snapshot_diff(df, ["k"], T(1), T(2), "v"), "change") == []


def test_lifecycle(spark):
    df = spark.createDataFrame([(1, T(10), "Created"), (1, T(20), "Deleted"), (1, T(30), "Recreated"), (2, T(5), "Deleted")], "entity_id long, ts timestamp_ntz, event string")
    assert sorted(((r.entity_id, r.start, r.end) for r in fold.alive_periods(df).collect()), key=str) == [(1, T(10), T(20)), (1, T(30), None)]
    alive = lambda t: ids(fold.active_entities(df, T(t)), "entity_id")
    assert alive(15) == [(1,)] and alive(25) == [] and alive(35) == [(1,)] and alive(1) == []


def test_allen_relations_partition(spark):
    pts = range(4)
    pairs = [(a1, a2, b1, b2) for a1 in pts for a2 in pts for b1 in pts for b2 in pts if a1 < a2 and b1 < b2]
    df = spark.createDataFrame(pairs, "a1 long, a2 long, b1 long, b2 long")
    hits = sum(r(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")).cast("int") for r in intervals.ALLEN.values())
    assert {r[0] for r in df.select(hits).collect()} == {1}  # exactly one holds


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 30), st.integers(1, 20)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 1), st.integers(0, 30), st.integers(1, 20)), min_size=1, max_size=12), st.integers(1, 9))
def test_overlap_join_is_the_plain_join(spark, a, b, width):
    make = lambda xs: spark.createDataFrame([(i, k, T(s), T(s + n)) for i, (k, s, n) in enumerate(xs)], "i long, k long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = sorted((r.i, r.i_r) for r in intervals.overlap_join(make(a), make(b), ["k"], width * 3_600_000_000).collect())
    want = sorted((i, j) for i, (k, s, n) in enumerate(a) for j, (m, u, o) in enumerate(b) if k == m and s < u + o and u < s + n)
    assert got == want


def test_allen_join_by_buckets_is_the_plain_join(spark):
    rows = [(i, 1, T(s), T(s + n)) for i, (s, n) in enumerate([(0, 4), (0, 9), (2, 2), (4, 3), (2, 5), (7, 2), (1, 1)])]
    df = spark.createDataFrame(rows, "i long, k long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    for relation in intervals.ALLEN:
        pairs = lambda width: sorted((r.i, r.i_r) for r in intervals.allen_join(df, df, ["k"], relation, width_us=width).collect())
        assert pairs(None) == pairs(7_200_000_000)


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", T(5)), (1, "b", T(1)), (2, "c", T(9))], "k long, name string, at timestamp_ntz")
    right = spark.createDataFrame([(1, T(2), 20), (1, T(5), 50), (1, T(6), 60)], "k long, ts timestamp_ntz, v long")
    assert sorted((r.name, r.v) for r in intervals.asof_join(left, right, ["k"], "at", "ts", ["v"]).collect()) == [("a", 50), ("b", None), ("c", None)]


EDGES = [(1, 2), (2, 3), (3, 4), (1, 3), (4, 1), (7, 8), (5, 5)]


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


def start(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


def test_bfs(spark, edges):
    assert ids(traverse.bfs(edges, start(spark, 1), 5), "id", "depth") == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert ids(traverse.khop(edges, start(spark, 1), 2), "id") == [(4,)]
    assert ids(traverse.bfs(edges, start(spark, 1), 1, "in"), "id", "depth") == [(1, 0), (4, 1)]
    small, large = (set(ids(traverse.bfs(edges, start(spark, 1), k), "id")) for k in (1, 2))
    assert small <= large


def test_paths_and_components(spark, edges):
    assert [tuple(r)[:3] for r in traverse.shortest_path(edges, 1, 4).collect()] == [(1, 4, 2)]
    assert traverse.shortest_path(edges, 1, 8).collect() == []
    assert [r.distance for r in traverse.shortest_path(edges, 1, 1).collect()] == [0]
    assert ids(traverse.connected_components(edges), "id", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)]
    assert ids(traverse.directed_components(edges, [7, 1]), "id", "seed") == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)]
    assert sorted(r.path for r in traverse.paths(edges, start(spark, 1), 2).collect()) == [[1, 2, 3], [1, 3, 4]]
    assert ids(traverse.degree_centrality(edges, start(spark, 1, 8)), "id", "degree") == [(1, 2), (8, 0)]


def test_long_chain_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r.component for r in traverse.connected_components(chain).collect()} == {0}


def test_pagerank_sums_to_one_without_sinks(spark):
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    ranks = [r["rank"] for r in traverse.pagerank(ring, 5).collect()]
    assert all(abs(x - 1 / 3) < 1e-9 for x in ranks)


def test_temporal_paths(spark):
    df = spark.createDataFrame([(1, 2, T(0), T(5)), (2, 3, T(4), T(9)), (3, 4, T(6), None)], "src long, dst long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    found = lambda hops, how: sorted(r.path for r in traverse.temporal_paths(df, T(0), T(10), hops, how).collect())
    assert found(3, "pairwise") == [[1, 2, 3, 4]]
    assert found(2, "pairwise") == [[1, 2, 3], [2, 3, 4]]
    assert found(3, "snapshot") == [[1, 2, 3, 4]] and found(2, "continuous") == []


def test_strict_updates(spark):
    graph = TemporalGraph(spark).with_nodes("N", spark.createDataFrame([(1, T(5))], "id long, valid_from timestamp_ntz"))
    edges = spark.createDataFrame([(1, 2, T(6)), (1, 1, T(1))], "src long, dst long, ts timestamp_ntz")
    with pytest.raises(writes.UpdateRejected) as no:
        writes.Update(graph, "strict_temporal").create_edges("E", "N", "N", edges).apply()
    assert {(r.src, r.dst, r.error) for r in no.value.violations.collect()} == {(1, 2, "DstNodeNotFound"), (1, 1, "TemporalAnachronism")}
    new = spark.createDataFrame([(2, T(2))], "id long, valid_from timestamp_ntz")
    ok = writes.Update(graph, "check_exists").create_nodes("N", new).create_edges("E", "N", "N", edges).apply()
    assert ok.edges_of("E").count() == 2
    assert writes.Update(graph, "permissive").create_edges("E", "N", "N", edges).apply().edges_of("E").count() == 2


def record(p, off, v, src, dst, op="CREATE", i=0, n=1):
    return (p, 1, off, v, v, i, n, src, dst, 1, op, v, 0)


def test_cdc_duplicates_gaps_and_batches(spark):
    make = lambda *r: spark.createDataFrame(list(r), cdc.SCHEMA)
    assert ids(cdc.progress(make(record(3, 1, 100, 10, 20), record(3, 1, 100, 10, 20))), "applied_offset", "gap") == [(1, False)]
    assert ids(cdc.progress(make(record(3, 2, 100, 10, 20))), "applied_offset", "gap") == [(0, True)]
    half = make(record(1, 1, 100, 10, 20, i=0, n=2))
    assert cdc.applicable(half).count() == 0
    whole = half.union(make(record(1, 2, 100, 10, 30, i=1, n=2)))
    assert ids(cdc.snapshot(cdc.applicable(whole)), "target_id") == [(20,), (30,)]


def test_cdc_delete_and_scan(spark):
    df = spark.createDataFrame([record(1, 1, 1000, 1, 100), record(1, 2, 2000, 1, 100, "DELETE"), record(1, 3, 1500, 1, 101)], cdc.SCHEMA)
    e = cdc.edge_records(df)
    assert ids(cdc.scan_at(e, 1600, 1), "dst") == [(100,), (101,)]
    assert ids(cdc.scan_at(e, 2500, 1), "dst") == [(101,)]
    assert ids(cdc.snapshot(df, 1999), "target_id") == [(100,), (101,)]


def test_cdc_view_streams_and_replays(spark, tmp_path):
    rows = [record(1, i, 100 + i, 1, i % 3, "DELETE" if i % 4 == 0 else "CREATE") for i in range(1, 13)]
    for k in range(3):
        spark.createDataFrame(rows[k * 4 : k * 4 + 4], cdc.SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    view = cdc.EdgeView(spark, f"file://{tmp_path}/view")
    assert cdc.ready(view.version, 1) == "NOT_READY"
    view.run(f"file://{tmp_path}/log", f"file://{tmp_path}/cp")
    want = ids(cdc.snapshot(spark.createDataFrame(rows, cdc.SCHEMA)), "target_id", "commit_version")
    assert ids(view.edges(), "target_id", "commit_version") == want
    view.apply(spark.createDataFrame(rows, cdc.SCHEMA), view.batch)  # an old batch id
    assert ids(view.edges(), "target_id", "commit_version") == want
    assert cdc.ready(view.version, 112) == "READY" and cdc.ready(view.version, 113) == "VERSION_LAG"


def test_windows_on_a_stream_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(T(i), i % 2) for i in range(48)], "ts timestamp_ntz, k long")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    batch = windows.windowed(df, "ts", "6 hours", "3 hours", ["k"], n=F.count(F.lit(1)))
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    live = windows.windowed(stream, "ts", "6 hours", "3 hours", ["k"], late="1 hour", n=F.count(F.lit(1)))
    q = live.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ids(spark.table("w"), "window_start", "k", "n") == ids(batch, "window_start", "k", "n")


def test_sessions(spark):
    df = spark.createDataFrame([(1, T(0)), (1, T(1)), (1, T(5))], "k long, ts timestamp_ntz")
    assert ids(windows.sessions(df, "ts", "2 hours", ["k"], n=F.count(F.lit(1))), "session_start", "session_end", "n") == [(T(0), T(3), 2), (T(5), T(7), 1)]


def test_watermark():
    assert cdc.safe_watermark(900, 600, 2000, 1000) == 600
    assert cdc.safe_watermark(900, None, 1500, 1000) == 500


@pytest.mark.parametrize(("text", "us"), [("1d2h30m10s", 95410000000), ("250l", 250000), ("P1DT1S", 86401000000), ("-1h", -3600000000), ("0.5s", 500000)])
def test_durations(text, us):
    assert parse_duration(text) == us


@pytest.mark.parametrize("text", ["", "5", "P", "1x", "d1"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)


def test_timestamps():
    assert parse_timestamp("2024-01-01T02:00:00+02:00") == dt.datetime(2024, 1, 1)
    assert parse_timestamp("2024-01-01 00:00:00.5") == dt.datetime(2024, 1, 1, 0, 0, 0, 500000)


def test_ordered_stream_waits_for_gaps(spark, tmp_path):
    first, second = [record(1, 3, 103, 1, 3), record(1, 1, 101, 1, 1), record(2, 2, 2, 9, 9)], [record(1, 2, 102, 1, 2), record(1, 1, 101, 1, 1)]
    for rows in (first, second):
        spark.createDataFrame(rows, cdc.SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    stream = spark.readStream.schema(cdc.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log")
    q = cdc.ordered_stream(stream).writeStream.format("memory").queryName("ordered").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ids(spark.table("ordered"), "partition_id", "offset", "target_id") == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]


def test_resume():
    assert cdc.resume(2, 2, 10, 11) == "TAIL" and cdc.resume(2, 2, 10, 12) == "SNAPSHOT" and cdc.resume(2, 1, 10, 1) == "SNAPSHOT" and cdc.resume(2, None, None, 1) == "SNAPSHOT"


def test_replace_partition(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(list(r), cdc.SCHEMA)
    view = cdc.EdgeView(spark, f"file://{tmp_path}/v")
    view.apply(make(record(1, 1, 5, 1, 2), record(2, 1, 5, 3, 4)), 0)
    view.replace_partition(1, make(record(1, 7, 9, 1, 8)), offset=7, version=9)
    assert ids(view.edges(), "partition_id", "target_id") == [(1, 8), (2, 4)]


def test_open_and_long_intervals_meet(spark):
    import random

    rng = random.Random(5)
    span = lambda: (a := rng.randrange(4000), rng.choice([None, a, a + 1, a + rng.randrange(1, 9), a + rng.randrange(1, 3000), a + 10**6]))
    rows = [(rng.randrange(3), *span(), i) for i in range(300)] + [(1, None, 5, 300), (1, 10, None, 301), (1, 20, 30, 302)]
    df = spark.createDataFrame(rows, "k long, valid_from long, valid_to long, n long")
    inf = float("inf")
    want = sorted((x[3], y[3]) for x in rows for y in rows if x[0] == y[0] and x[1] is not None and y[1] is not None and x[1] < (inf if x[2] is None else x[2]) and y[1] < (inf if y[2] is None else y[2]) and x[1] < (inf if y[2] is None else y[2]) and y[1] < (inf if x[2] is None else x[2]))
    for width in (1, 7, 1000):
        assert sorted(ids(intervals.overlap_join(df, df, ["k"], width), "n", "n_r")) == want
    whole = df.where("valid_to IS NULL OR valid_from < valid_to")
    for relation in intervals.ALLEN:
        plain, cut = (sorted(ids(intervals.allen_join(whole, whole, ["k"], relation, width_us=w), "n", "n_r")) for w in (None, 7))
        assert plain == cut
    assert (301, 302) not in ids(intervals.allen_join(whole, whole, ["k"], "before"), "n", "n_r") and (301, 302) in ids(intervals.allen_join(whole, whole, ["k"], "contains", width_us=7), "n", "n_r")


def test_asof_join_in_buckets(spark):
    import random

    rng = random.Random(6)
    left = spark.createDataFrame([(rng.choice([1, 2, None]), rng.randrange(500), i) for i in range(200)], "k long, at long, i long")
    right = spark.createDataFrame([(rng.choice([1, 2, None]), rng.randrange(500), rng.choice([None, i]), i) for i in range(60)], "k long, ts long, v long, seq long")
    plain, cut = (ids(intervals.asof_join(left, right, ["k"], "at", "ts", ["v"], "seq", w), "i", "v") for w in (None, 13))
    assert sorted(plain, key=str) == sorted(cut, key=str)


def test_a_strict_batch(spark):
    node = lambda *r: spark.createDataFrame([(i, T(h), "x") for i, h in r], "id long, valid_from timestamp_ntz, p string")
    edge = lambda *r: spark.createDataFrame([(a, b, T(h)) for a, b, h in r], "src long, dst long, ts timestamp_ntz")
    value = lambda *r: spark.createDataFrame(list(r), "id long, value string")
    only = lambda *r: spark.createDataFrame([(i,) for i in r], "id long")
    graph = writes.create_nodes(TemporalGraph(spark), "N", node((1, 0), (2, 5), (3, 0)))
    batch = lambda level: writes.Update(graph, level).create_nodes("N", node((4, 1))).delete_nodes("N", only(3)).update_nodes("N", "p", value((1, "y"), (3, "y"), (9, "y"))).create_edges("E", "N", "N", edge((1, 2, 3), (1, 4, 3), (1, 3, 3)))
    assert batch("permissive").violations() is None
    assert ids(batch("check_exists").violations(), "src", "dst", "error") == [(1, 3, "DstNodeNotFound")]
    want = sorted([(1, 3, None, "DstNodeNotFound"), (1, 2, None, "TemporalAnachronism"), (None, None, 3, "UpdateOnDeleted"), (None, None, 9, "UpdateOnDeleted")], key=str)
    assert sorted(map(tuple, batch("strict_temporal").violations().collect()), key=str) == want
    good = writes.Update(graph, "full_isolation").update_nodes("N", "p", value((1, "y"))).create_edges("E", "N", "N", edge((1, 3, 3))).delete_nodes("N", only(2))
    done = good.apply()
    assert ids(done.nodes["N"].df, "id", "p") == [(1, "y"), (3, "x")] and ids(done.edges_of("E"), "src", "dst") == [(1, 3)]
    other = writes.set_property(graph, "N", value((2, "z")), "p", "value")
    with pytest.raises(writes.UpdateRejected) as no:
        good.apply(other)
    assert ids(no.value.violations, "id", "error") == [(2, "WriteConflict")]
    apart = writes.create_nodes(graph, "N", node((7, 0)))
    assert good.apply(apart).nodes["N"].df.count() == 3
    assert ids(writes.Update(done).delete_edges("E", edge((1, 3, 0)).select("src", "dst")).apply().edges_of("E"), "src") == []


def test_a_view_goes_on_after_a_restart_and_a_replaced_partition(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(list(r), cdc.SCHEMA)
    log, cp, path = f"file://{tmp_path}/log", f"file://{tmp_path}/cp", f"file://{tmp_path}/view"
    add = lambda *r: make(*r).coalesce(1).write.mode("append").parquet(log)
    add(record(1, 1, 11, 1, 1))
    add(record(1, 3, 13, 1, 3), record(2, 1, 5, 4, 4))
    cdc.EdgeView(spark, path).run(log, cp)
    view = cdc.EdgeView(spark, path)
    assert ids(view.edges(), "partition_id", "target_id") == [(1, 1), (2, 4)] and ids(view.waiting(), "offset") == [(3,)] and view.version == 11
    view.replace_partition(2, make(record(2, 9, 20, 4, 6)), offset=9, version=20)
    add(record(1, 2, 12, 1, 2), record(2, 9, 20, 4, 9))
    add(record(2, 10, 21, 4, 7))
    view.run(log, cp)
    want = [(1, 1), (1, 2), (1, 3), (2, 6), (2, 7)]
    assert ids(view.edges(), "partition_id", "target_id") == want == ids(cdc.EdgeView(spark, path).edges(), "partition_id", "target_id")
    assert ids(view.progress(), "partition_id", "applied_offset", "applied_version") == [(1, 3, 13), (2, 10, 21)]


def test_a_view_follows_one_epoch_and_compacts(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(list(r), cdc.SCHEMA)
    later = lambda r: tuple(2 if f == "partition_epoch" else v for f, v in zip(cdc.SCHEMA.fieldNames(), r, strict=True))
    view = cdc.EdgeView(spark, f"file://{tmp_path}/v", compact_every=3)
    for i in range(1, 6):
        view.apply(make(record(1, i, i, 1, i % 2)), i)
    assert ids(view.edges(), "target_id", "commit_version") == [(0, 4), (1, 5)] and len(view.parts) <= 3
    view.apply(make(later(record(1, 1, 9, 1, 8))), 6)
    assert ids(view.edges(), "target_id") == [(0,), (1,)] and view.waiting().count() == 1
    tail = lambda: (_ for _ in ()).throw(AssertionError)
    assert view.catch_up(1, 1, 6, tail) == "TAIL"
    assert view.catch_up(1, 2, 1, lambda: (make(), 0, 0)) == "SNAPSHOT"
    view.apply(make(), 7)
    assert ids(view.edges(), "target_id") == [(8,)]
    with pytest.raises(cdc.BadRecord):
        view.apply(make(record(1, 9, 9, 1, 1, i=2, n=2)), 8)


def test_applicable_in_blocks(spark):
    import random

    rng = random.Random(4)
    rows = [record(p, o, o, 1, o) for p in (1, 2, 3) for o in range(1, 60) if not (p == 2 and o == 31) and not (p == 3 and o < 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:20], cdc.SCHEMA)
    start = spark.createDataFrame([(3, 3)], "partition_id int, start long")
    for block in (4, 7, 1000):
        got = cdc.applicable(df, start, block).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("top"))
        assert ids(got, "partition_id", "n", "top") == [(1, 59, 59), (2, 30, 30), (3, 57, 59)]


def test_stream_in_order_of_commit_versions(spark, tmp_path):
    big = (1 << 60) + 1
    rows = [record(1, 5, 3, big, 5), record(1, 2, 2, big, 2, i=1, n=2), record(1, 1, 2, big, 1, i=0, n=2), record(1, 1, 2, big, 1, i=0, n=2), record(1, 9, 1, big, 9), record(1, 7, 5, big, 7)]
    for r in rows:
        spark.createDataFrame([r], cdc.SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    stream = spark.readStream.schema(cdc.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log")
    q = cdc.ordered_stream(stream, by="commit_version").writeStream.format("memory").queryName("by_version").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["commit_version"], r["target_id"]) for r in spark.table("by_version").where(F.col("entity_id") == big).collect()]
    assert got == [(1, 9), (2, 1), (2, 2), (3, 5)]


def test_store(spark):
    from timeweave.operators.store import Store

    cell = lambda *r: spark.createDataFrame(list(r), "entity_id long, column string, ts timestamp_ntz, value string")
    s = Store.empty(spark).put(cell((1, "a", T(1), "x"), (1, "a", T(5), "y"), (2, "a", T(1), "z"))).put(cell((1, "a", T(5), "w")))
    s = s.put_static(spark.createDataFrame([(1, "name", "n")], "entity_id long, column string, value string"))
    assert ids(s.get(T(1)), "entity_id", "column", "value") == [(1, "a", "x"), (1, "name", "n"), (2, "a", "z")]
    assert ids(s.get(T(9)), "entity_id", "column", "value") == [(1, "a", "w"), (1, "name", "n"), (2, "a", "z")]
    assert ids(s.scan(T(0), T(9), entity=1, column="a"), "value") == [("w",), ("x",), ("y",)] and s.scan(T(0), T(9), column="b").count() == 0
    gone = s.delete(spark.createDataFrame([(1, "a", T(6))], "entity_id long, column string, ts timestamp_ntz"))
    assert ids(gone.get(T(9)), "entity_id", "column") == [(1, "name"), (2, "a")]
    assert ids(s.compact(T(5)).get(T(9)), "value") == ids(s.get(T(9)), "value") and s.compact(T(5)).cells.count() < s.cells.count()
    assert [r.ts for r in s.scan(T(0), T(9)).where("entity_id = 1").collect()] == [T(5), T(5), T(1)]
    edge = lambda t, ty="e": spark.createDataFrame([(1, 2, ty, T(t))], "src long, dst long, type string, ts timestamp_ntz")
    s = s.put_edges(edge(1)).delete_edges(edge(3)).put_edges(edge(2, "f"))
    assert ids(s.neighbors(T(2), 1), "type") == [("e",), ("f",)] and ids(s.neighbors(T(4), 2, "in"), "type") == [("f",)]
    mark = lambda t: spark.createDataFrame([(1, T(t))], "entity_id long, ts timestamp_ntz")
    s = s.mark(mark(1), "Created").mark(mark(4), "Deleted")
    assert ids(s.alive(T(2)), "entity_id") == [(1,)] and ids(s.alive(T(4)), "entity_id") == []


def test_portion_of_splits(spark):
    df = spark.createDataFrame([(1, T(0), T(10), 5), (2, T(3), None, 5), (3, T(8), T(9), 5)], "k long, valid_from timestamp_ntz, valid_to timestamp_ntz, v long")
    out = fold.portion_of(df, T(2), T(6), {"v": F.lit(9)})
    got = sorted(((r.k, r.valid_from, r.valid_to, r.v) for r in out.collect()), key=str)
    assert got == sorted([(1, T(0), T(2), 5), (1, T(2), T(6), 9), (1, T(6), T(10), 5), (2, T(3), T(6), 9), (2, T(6), None, 5), (3, T(8), T(9), 5)], key=str)


def test_write_partitioned_prunes(spark, tmp_path):
    from timeweave.operators import partitioning

    df = spark.createDataFrame([(i, T(i * 10)) for i in range(20)], "id long, ts timestamp_ntz")
    partitioning.write_partitioned(df, f"file://{tmp_path}/p", "id", 4, "ts")
    back = spark.read.parquet(f"file://{tmp_path}/p")
    assert back.count() == 20 and len(back.where("part = 1 AND day = DATE '2024-01-01'").inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(part" in back.where("part = 1")._jdf.queryExecution().toString()


def test_early_versions_wait_in_the_view(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(list(r), cdc.SCHEMA)
    log, cp = f"file://{tmp_path}/log", f"file://{tmp_path}/cp"
    add = lambda *r: make(*r).coalesce(1).write.mode("append").parquet(log)
    view = cdc.EdgeView(spark, f"file://{tmp_path}/v")
    view.replace_partition(2, make(record(2, 40, 60, 4, 6)), offset=40, version=60)
    add(record(1, 4, 3, 1, 4), record(2, 42, 62, 4, 8))
    add(record(1, 3, 2, 1, 3, i=1, n=2), record(2, 41, 61, 4, 7))
    add(record(1, 1, 1, 1, 1), record(1, 1, 1, 1, 1))
    view.run(log, cp, unordered=True)
    assert ids(view.waiting(), "partition_id", "offset") == [(1, 3), (1, 4)]
    assert ids(view.edges(), "partition_id", "target_id") == [(1, 1), (2, 6), (2, 7), (2, 8)]
    add(record(1, 2, 2, 1, 2, i=0, n=2))
    add(record(1, 6, 9, 1, 6))
    view.run(log, cp, unordered=True)
    assert ids(view.waiting(), "offset") == [(6,)]
    assert ids(view.progress(), "partition_id", "applied_offset", "applied_version") == [(1, 4, 3), (2, 42, 62)]


def test_in_version_order(spark):
    import random

    rng = random.Random(7)
    rows = [record(p, v * 3 + i, v, 1, v, i=i, n=1 + v % 3) for p in (1, 2, 3, 4) for v in range(1, 40) for i in range(1 + v % 3) if (p, v, i) not in ((2, 20, 1), (3, 17, 0)) and not (p == 4 and v <= 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:20], cdc.SCHEMA)
    done = spark.createDataFrame([(4, 5), (2, 3)], "partition_id int, applied_version long")
    for block in (4, 7, 1000):
        got = cdc.in_version_order(df, done, block).groupBy("partition_id").agg(F.max("commit_version").alias("top"), F.count_distinct("offset").alias("n"))
        assert ids(got, "partition_id", "top", "n") == [(1, 39, 78), (2, 19, 38), (3, 16, 32), (4, 39, 67)]


@pytest.mark.parametrize("semantics", ["snapshot", "pairwise", "continuous", "sequential"])
def test_temporal_path_counts(spark, semantics):
    import random
    from collections import Counter

    rng = random.Random(8)
    span = lambda: (a := rng.randrange(40), rng.choice([None, a + rng.randrange(1, 30)]))
    rows = [(rng.randrange(5), rng.randrange(5), *[None if x is None else T(x) for x in span()]) for _ in range(120)] + [(1, 2, None, None)]
    df = spark.createDataFrame(rows, "src long, dst long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    want = Counter(tuple(r.path) for r in traverse.temporal_paths(df, T(15), T(20), 2, semantics).collect())
    got = traverse.temporal_path_counts(df, T(15), T(20), semantics)
    assert {(r.a, r.b, r.c): r.n for r in got.collect()} == dict(want) != {}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("Join") < plan.find("Aggregate")  # nothing is grouped after the join

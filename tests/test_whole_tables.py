"""Queries that take a whole table, against brute force or counts of that table."""

import datetime as dt
import os
from collections import Counter

import pytest

from timeweave import catalogue
from timeweave.sources.tables import link_edges, table

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_components_over_all_links(spark):
    links = [(r.src, r.dst) for r in link_edges(spark, DATA).collect()]
    label = {v: v for edge in links for v in edge}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed = changed or label[a] != label[b]
            label[a] = label[b] = low
    got = catalogue.QUERIES["connected_components"](spark, DATA).collect()
    assert sorted((r.id, r.component) for r in got) == sorted(label.items())


def test_pairwise_paths_of_all_starts(spark):
    edges = catalogue.temporal_edges(spark, DATA).select("src", "dst", "valid_from", "valid_to").collect()
    low, high = (dt.datetime.fromisoformat(x) for x in (catalogue.MOMENT, catalogue.LATER))
    ok = [(e.src, e.dst, e.valid_from, e.valid_to or dt.datetime.max) for e in edges if e.valid_from < high and (e.valid_to is None or e.valid_to > low)]
    want = Counter((a, b, d) for a, b, f, t in ok for c, d, g, u in ok if b == c and t > g and u > f)
    got = catalogue.QUERIES["temporal_path_pairwise"](spark, DATA).collect()
    assert {(r.a, r.b, r.c): r.n for r in got} == dict(want) and len({r.a for r in got}) > 1


def test_sort_goes_on_behind_the_nulls(spark):
    got = [(r.id, r.b) for r in catalogue.QUERIES["sort_nulls"](spark, "/root/testdata/sf0.1").collect()]
    values = [(-b, i) for i, b in got if b is not None]
    nulls = [i for i, b in got if b is None]
    assert [b for _, b in got[: len(nulls)]] == [None] * len(nulls) and nulls == sorted(nulls)
    assert len(got) == 15_000 and len(values) == 7_500 and values == sorted(values)


def test_dates_of_all_orders(spark):
    got = {r.id: (r.later, r.us) for r in catalogue.QUERIES["fn_temporal"](spark, DATA).collect()}
    orders = table(spark, DATA, "orders").select("o_orderkey", "o_orderdate").collect()
    epoch = dt.datetime(1970, 1, 1)
    assert max(got) >= 50 and got == {o: (d + dt.timedelta(hours=26), (d - epoch) // dt.timedelta(microseconds=1)) for o, d in orders}


def test_iso8601_of_whole_seconds(spark, tmp_path):
    times = [dt.datetime(2024, 1, 1, 2, 3, 4), dt.datetime(2024, 1, 1, 2, 3, 4, 50)]
    spark.createDataFrame(list(enumerate(times)), "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["fn_format_iso8601"](spark, str(tmp_path)).collect()
    want = [(0, "2024-01-01T02:03:04Z"), (1, "2024-01-01T02:03:04.000050Z")]
    assert sorted((r.id, r.text) for r in got) == want
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert sorted(c.sql(catalogue.ORACLE_SQL["fn_format_iso8601"]).fetchall()) == want


def test_directed_components_follow_a_long_chain(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(3, 9)] + [(140, 141), (141, 3)], "src long, dst long")
    monkeypatch.setattr(catalogue, "link_edges", lambda spark, sf_dir: chain)
    got = catalogue.QUERIES["directed_components"](spark, DATA).collect()
    assert sorted((r.id, r.seed) for r in got) == [(i, 3) for i in range(3, 10)] + [(140, 140), (141, 140)]


def test_paths_over_all_neighbours(spark):
    out = {}
    for r in link_edges(spark, DATA).collect():
        out.setdefault(r.src, set()).add(r.dst)
    want = [f"3>{a}>{b}>{c}" for a in out.get(3, ()) for b in out.get(a, ()) for c in out.get(b, ()) if len({3, a, b, c}) == 4]
    got = [r.path for r in catalogue.QUERIES["path_enumeration_whole"](spark, DATA).collect()]
    assert sorted(got) == sorted(want) and len(got) > 5**3


def _counted_paths(spark, query, edge, both):
    log = [r for r in catalogue.event_log(spark, DATA).where("item IS NOT NULL").orderBy("ts", "seq").collect()]
    runs = {}
    for r in log:
        runs.setdefault((r.user_id, r.item), []).append(r)
    acted = [(*k, r.ts, s.ts if s else dt.datetime.max, r.seq) for k, rs in runs.items() for r, s in zip(rs, [*rs[1:], None], strict=True)]
    ok = [e for e in acted if edge(e[2], e[3])]
    want = Counter((x[0], x[1], y[1]) for x in ok for y in ok if x[1] == y[0] and x[4] != y[4] and both(x[2], x[3], y[2], y[3]))
    got = catalogue.QUERIES[query](spark, DATA)
    assert {(r.a, r.b, r.c): r.n for r in got.collect()} == dict(want) != {}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("Join") < plan.find("Aggregate")  # nothing is grouped after the join


def test_pairwise_matches_are_counted_before_the_join(spark):
    low, high = (dt.datetime.fromisoformat(x) for x in (catalogue.MOMENT, catalogue.LATER))
    _counted_paths(spark, "match_path_pairwise", lambda f, t: f < high and t > low, lambda f, t, g, u: t > g and u > f)


def test_continuous_matches_are_counted_before_the_join(spark):
    low, high = (dt.datetime.fromisoformat(x) for x in (catalogue.MOMENT, catalogue.LATER))
    _counted_paths(spark, "match_path_continuous", lambda f, t: f <= low and t > high, lambda f, t, g, u: max(f, g) < min(t, u))

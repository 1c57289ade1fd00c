"""A session: named graphs, queries over the current one, and the statements that change it."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.graph import NodeTable, TemporalGraph
from timeweave.operators import writes
from timeweave.operators.traverse import checkpoint
from timeweave.plans import ast
from timeweave.plans.compiler import Compiler, NodeVar, QueryError, RelVar, Rows, ValueVar
from timeweave.plans.explain import logical_tree
from timeweave.plans.parser import QuerySyntaxError, parse

WRITES = (ast.Create, ast.Merge, ast.SetProps, ast.Delete)


#: Write statements after which a session writes its tables down.
CUT = 16


def matched(q: ast.Query) -> list[tuple[str, str]]:
    """(label or type, property or '') of every pattern that ``q`` matches."""
    out = []
    for c in q.clauses:
        for p in c.patterns if isinstance(c, ast.Match) else []:
            for part in p.parts:
                for name in getattr(part, "labels", None) or getattr(part, "types", None) or ():
                    out += [(name, key) for key, _ in part.props] or [(name, "")]
    for _, other in q.unions:
        out += matched(other)
    return out


def operators(plan, depth: int) -> list[tuple[int, str, str, int | None, int | None]]:
    """(depth, operator, details, rows, time in ms) of an executed plan and what is below it."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return operators(plan.executedPlan(), depth)
    if kind.endswith("QueryStageExec"):
        return operators(plan.plan(), depth)
    if kind in ("WholeStageCodegenExec", "InputAdapter"):
        return operators(plan.child(), depth)
    metrics = plan.metrics()

    def measured(*names: str) -> int | None:
        return next((metrics.apply(n).value() for n in names if metrics.contains(n)), None)

    out = [(depth, plan.nodeName(), plan.simpleStringWithNodeId()[:200], measured("numOutputRows", "shuffleRecordsWritten"), measured("aggTime", "sortTime", "scanTime", "buildTime"))]
    children = plan.children()
    for i in range(children.size()):
        out += operators(children.apply(i), depth + 1)
    return out


class GraphSession:
    """Holds spaces (named graphs); ``query`` reads or, for CREATE, SET, DELETE, MERGE and ALTER, replaces the current graph."""

    def __init__(self, spark: SparkSession, graph: TemporalGraph | None = None, max_hops: int = 10):
        graph = graph or TemporalGraph(spark)
        self.spark, self.max_hops = spark, max_hops
        self.spaces: dict[str, TemporalGraph] = {graph.name: graph}
        self.current = graph.name
        self.before: dict[str, TemporalGraph] | None = None
        self.functions: dict[str, Callable[..., Column]] = {}
        self.asked: Counter[tuple[str, str]] = Counter()
        self.writes = 0

    @property
    def graph(self) -> TemporalGraph:
        return self.spaces[self.current]

    @graph.setter
    def graph(self, graph: TemporalGraph) -> None:
        self.spaces[self.current] = graph

    def add_space(self, name: str, graph: TemporalGraph) -> None:
        self.spaces[name] = replace(graph, name=name)

    # transactions: graphs never change, so a transaction is a note of which ones there were

    def begin(self) -> None:
        if self.before is not None:
            raise QueryError("a transaction is open")
        self.before = dict(self.spaces)

    def commit(self) -> None:
        self.before = None

    def rollback(self) -> None:
        if self.before is None:
            raise QueryError("no transaction is open")
        self.spaces, self.before = self.before, None

    def register_function(self, name: str, builder: Callable[..., Column]) -> None:
        """Make a Column builder, a UDF or a pandas UDF callable from this session's queries under ``name``."""
        self.functions[name.lower()] = builder

    def is_valid(self, text: str) -> bool:
        try:
            parse(text)
        except QuerySyntaxError:
            return False
        return True

    def explain(self, text: str, **params) -> str:
        """The syntax as an operator tree, then Spark's formatted plan."""
        q = parse(text)
        tree = logical_tree(q)
        if not any(isinstance(c, (*WRITES, ast.Show, ast.Use, ast.Alter)) for c in q.clauses):
            df = Compiler(self.graph, params, self.max_hops, self.functions).result(q)
            tree += "\n" + df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return tree

    def profile(self, text: str, **params) -> DataFrame:
        """The query is run, its rows counted and thrown away: a row for each of Spark's operators.

        (depth, operator, details, rows, time_ms): ``rows`` is what the operator put out, where it
        counts that; ``time_ms`` the time spent in it over all tasks, where it measures that.  The
        first row, at depth 0, is the whole query.  Below a global sort rows count twice, for Spark
        samples the sort's input first.
        """
        began = time.perf_counter()
        executed = self.query(text, **params)._jdf.queryExecution()
        rows = executed.toRdd().count()
        took = int((time.perf_counter() - began) * 1000)
        found = [(0, "Query", text.strip(), rows, took), *operators(executed.executedPlan(), 1)]
        return self.spark.createDataFrame(found, "depth int, operator string, details string, rows long, time_ms long").coalesce(1)

    def stream(self, text: str, **params):
        """Rows one by one, a partition at a time."""
        return self.query(text, **params).toLocalIterator()

    def batch(self, texts: list[str], **params) -> list[DataFrame]:
        return [self.query(t, **params) for t in texts]

    def query(self, text: str, **params) -> DataFrame:
        q = parse(text)
        if q.explain and q.explain.upper() == "PROFILE":
            return self.profile(text.strip()[len(q.explain) :], **params)
        if q.explain:
            return self.spark.createDataFrame([(line,) for line in self.explain(text.strip()[len(q.explain) :], **params).splitlines()], "plan string")
        first = q.clauses[0]
        if isinstance(first, ast.Show):
            return self.show(first)
        if isinstance(first, ast.Use):
            if first.space not in self.spaces:
                raise QueryError(f"no space {first.space}")
            self.current = first.space
            return self.stats(spaces=1)
        if isinstance(first, ast.Alter):
            return self.alter(first)
        compiler = Compiler(self.graph, params, self.max_hops, self.functions)
        self.asked.update(matched(q))
        if any(isinstance(c, WRITES) for c in q.clauses):
            return self.write(q, compiler)
        return compiler.result(q)

    def stats(self, **counts: int) -> DataFrame:
        return self.spark.createDataFrame([(k, v) for k, v in counts.items()], "action string, n long")

    # statements that write

    def write(self, q: ast.Query, compiler: Compiler) -> DataFrame:
        """Reading clauses first, then each write over their rows; what was matched is matched once.

        A SET or DELETE row comes from the graph as it was before the statement.
        """
        rows: Rows | None = None
        done: dict[str, int] = {}
        compiler.prefix = q.temporal
        for c in q.clauses:
            if isinstance(c, ast.Create):
                rows = rows or compiler.unit()
                for p in c.patterns:
                    rows = self.create(p, rows, compiler)
                done["created"] = done.get("created", 0) + len(c.patterns)
            elif isinstance(c, ast.Merge):
                rows = rows or compiler.unit()
                rows = self.merge(c.pattern, rows, compiler)
                done["merged"] = done.get("merged", 0) + 1
            elif isinstance(c, ast.SetProps):
                for var, prop, expr in c.items:
                    rows = self.set_prop(var, prop, expr, self.need(rows), compiler)
                done["set"] = done.get("set", 0) + len(c.items)
            elif isinstance(c, ast.Delete):
                for var in c.variables:
                    self.delete(var, self.need(rows))
                done["deleted"] = done.get("deleted", 0) + len(c.variables)
            else:
                rows = compiler.clause(c, rows)
            compiler.graph = self.graph
        self.writes += 1
        if self.writes % CUT == 0:
            self.cut()
        if any(isinstance(c, ast.Project) and c.final for c in q.clauses):
            return compiler.plain(rows)
        return self.stats(**done)

    def cut(self) -> None:
        """Write the tables of the current graph down, so that plans do not grow with the statements that made them."""
        nodes = {k: NodeTable(t.label, checkpoint(t.df)) for k, t in self.graph.nodes.items() if t.df._jdf.queryExecution().logical().children().nonEmpty()}
        edges = tuple(replace(e, df=checkpoint(e.df)) if e.df._jdf.queryExecution().logical().children().nonEmpty() else e for e in self.graph.edges)
        self.graph = replace(self.graph, nodes={**self.graph.nodes, **nodes}, edges=edges)

    @staticmethod
    def need(rows: Rows | None) -> Rows:
        if rows is None:
            raise QueryError("nothing was matched that could be changed")
        return rows

    def create(self, p: ast.Pattern, rows: Rows, compiler: Compiler) -> Rows:
        """Nodes, then edges, for every row.  An id comes from the ``id`` property or after the label's largest."""
        nodes = p.parts[0::2]
        scope, df = dict(rows.scope), rows.df
        for node in nodes:
            if node.var in scope:
                continue
            if len(node.labels) != 1:
                raise QueryError("CREATE needs one label for a new node")
            label = node.labels[0]
            given = dict(node.props)
            current = Rows(df, scope)
            columns = {k: compiler.fresh(f"{node.var}_{k}") for k in [*given, "id", "label"]}
            made = {columns[k]: compiler.value(e, current) for k, e in given.items()}
            made[columns["label"]] = F.lit(label)
            if "id" not in given:
                old = self.graph.nodes.get(label)
                top = None if old is None else old.df.agg(F.max("id")).first()[0]
                made[columns["id"]] = F.lit(0 if top is None else top + 1).cast("bigint") + F.monotonically_increasing_id()
            df = df.withColumns(made)
            if "id" not in given:  # written once, or nodes and edges might see different ids
                df = checkpoint(df)
            scope[node.var] = NodeVar((label,), columns)
            new = df.select(*[F.col(c).alias(k) for k, c in columns.items() if k != "label"])
            self.graph = writes.create_nodes(self.graph, label, new)
        for i, rel in enumerate(p.parts[1::2]):
            a, b = (nodes[i], nodes[i + 1]) if rel.direction != "in" else (nodes[i + 1], nodes[i])
            src, dst = scope[a.var], scope[b.var]
            if len(rel.types) != 1 or len(src.labels) != 1 or len(dst.labels) != 1:
                raise QueryError("CREATE needs one type and labelled ends for a new relationship")
            current = Rows(df, scope)
            props = {k: compiler.value(e, current) for k, e in rel.props}
            new = df.select(F.col(src.columns["id"]).alias("src"), F.col(dst.columns["id"]).alias("dst"), *[c.alias(k) for k, c in props.items()])
            self.graph = writes.create_edges(self.graph, rel.types[0], src.labels[0], dst.labels[0], new)
        return Rows(df, scope)

    def merge(self, p: ast.Pattern, rows: Rows, compiler: Compiler) -> Rows:
        """Nodes by id, edges by their ends: created where they are missing."""
        nodes = p.parts[0::2]
        scope, df = dict(rows.scope), rows.df
        for node in nodes:
            if node.var in scope:
                continue
            given = dict(node.props)
            if len(node.labels) != 1 or "id" not in given:
                raise QueryError("MERGE needs a label and an id")
            columns = {k: compiler.fresh(f"{node.var}_{k}") for k in [*given, "label"]}
            current = Rows(df, scope)
            df = df.withColumns({columns[k]: compiler.value(e, current) for k, e in given.items()} | {columns["label"]: F.lit(node.labels[0])})
            scope[node.var] = NodeVar((node.labels[0],), columns)
            self.graph = writes.merge_nodes(self.graph, node.labels[0], df.select(*[F.col(columns[k]).alias(k) for k in given]))
        for i, rel in enumerate(p.parts[1::2]):
            a, b = (nodes[i], nodes[i + 1]) if rel.direction != "in" else (nodes[i + 1], nodes[i])
            src, dst = scope[a.var], scope[b.var]
            current = Rows(df, scope)
            new = df.select(F.col(src.columns["id"]).alias("src"), F.col(dst.columns["id"]).alias("dst"), *[compiler.value(e, current).alias(k) for k, e in rel.props])
            self.graph = writes.merge_edges(self.graph, rel.types[0], src.labels[0], dst.labels[0], new)
        return Rows(df, scope)

    def set_prop(self, var: str, prop: str, expr: Any, rows: Rows, compiler: Compiler) -> Rows:
        bound = rows.scope.get(var)
        value = compiler.fresh(prop)
        df = rows.df.withColumn(value, compiler.value(expr, rows))
        if isinstance(bound, NodeVar) and len(bound.labels) == 1:
            ids = df.select(F.col(bound.columns["id"]).alias("id"), F.col(value).alias("_new"))
            self.graph = writes.set_property(self.graph, bound.labels[0], ids, prop, "_new")
        elif isinstance(bound, RelVar):
            ids = df.select(F.col(bound.columns["edge_id"]).alias("id"), F.col(value).alias("_new"))
            edges = []
            for e in self.graph.edges:
                if e.type in bound.types:
                    keyed = NodeTable(e.type, e.df.withColumn("id", e.key()))
                    one = writes.set_property(replace(self.graph, nodes={e.type: keyed}), e.type, ids, prop, "_new")
                    e = replace(e, df=one.nodes[e.type].df.drop("id"))
                edges.append(e)
            self.graph = replace(self.graph, edges=tuple(edges))
        else:
            raise QueryError(f"SET needs a node of one label or a relationship, not {var}")
        return Rows(df, {**rows.scope, var: replace(bound, columns={**bound.columns, prop: value})})

    def delete(self, var: str, rows: Rows) -> None:
        bound = rows.scope.get(var)
        if isinstance(bound, NodeVar):
            for label in bound.labels:
                ids = rows.df.where(F.col(bound.columns["label"]) == label).select(F.col(bound.columns["id"]).alias("id"))
                self.graph = writes.delete_nodes(self.graph, label, ids)
        elif isinstance(bound, RelVar):
            for t in dict.fromkeys(bound.types):
                ids = rows.df.where(F.col(bound.columns["type"]) == t).select(F.col(bound.columns["edge_id"]).alias("key"))
                self.graph = writes.delete_edges(self.graph, t, ids)
        else:
            raise QueryError(f"DELETE needs a node or relationship, not {var}")

    # catalog

    def show(self, s: ast.Show) -> DataFrame:
        graph = self.spaces[s.space] if s.space else self.graph
        if s.what == "SPACES":
            return self.spark.createDataFrame([(n,) for n in sorted(self.spaces)], "Name string")
        if s.what in ("TAGS", "LABELS"):
            rows = [(t.label, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.df.schema)) for t in sorted(graph.nodes.values(), key=lambda t: t.label)]
            return self.spark.createDataFrame(rows, "Name string, Properties string")
        if s.what == "EDGES":
            rows = [(e.type, e.src_label, e.dst_label, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.df.schema)) for e in sorted(graph.edges, key=lambda e: (e.type, e.src_label))]
            return self.spark.createDataFrame(rows, "Name string, Source string, Target string, Properties string")
        if s.what == "INDEXES":  # what a filter can prune by: every property that files keep statistics of
            rows = [(f"{t.label}.{f.name}", t.label, f.name, f.name == "id") for t in sorted(graph.nodes.values(), key=lambda t: t.label) for f in t.df.schema]
            return self.spark.createDataFrame(rows, "Name string, Label string, Properties string, Unique boolean")
        here = self.spark.sparkContext.master
        if s.what == "PARTS":  # Spark keeps no replicas of its own; a part lives where its task runs
            rows = [(f"{t.label}/{i}", here, "", "Normal") for t in sorted(graph.nodes.values(), key=lambda t: t.label) for i in range(t.df.rdd.getNumPartitions())]
            return self.spark.createDataFrame(rows, "Partition string, Leader string, Followers string, State string")
        if s.what == "HOSTS":
            return self.spark.createDataFrame([(0, here, "ONLINE")], "ID long, Address string, State string")
        if s.what == "HOTSPOTS":  # what this session has asked for most
            rows = [(name, prop, n, here) for (name, prop), n in sorted(self.asked.items(), key=lambda x: (-x[1], x[0]))]
            return self.spark.createDataFrame(rows, "Entity_ID string, Column_ID string, Query_Count long, Node string")
        raise QueryError(f"SHOW {s.what}")

    def alter(self, a: ast.Alter) -> DataFrame:
        def change(df: DataFrame) -> DataFrame:
            if a.action == "ADD":
                if a.prop in df.columns:
                    raise QueryError(f"{a.name} has a property {a.prop}")
                return df.withColumn(a.prop, F.lit(None).cast(a.detail))
            if a.prop not in df.columns:
                raise QueryError(f"{a.name} has no property {a.prop}")
            if a.action == "DROP":
                return df.drop(a.prop)
            if a.action == "RENAME":
                return df.withColumnRenamed(a.prop, a.detail)
            return df.withColumn(a.prop, F.col(a.prop).try_cast(a.detail))

        graph = self.graph
        if a.kind in ("TAG", "LABEL"):
            if a.name not in graph.nodes:
                raise QueryError(f"no label {a.name}")
            self.graph = replace(graph, nodes={**graph.nodes, a.name: NodeTable(a.name, change(graph.nodes[a.name].df))})
        else:
            if not graph.edge_tables([a.name]):
                raise QueryError(f"no relationship type {a.name}")
            self.graph = replace(graph, edges=tuple(replace(e, df=change(e.df)) if e.type == a.name else e for e in graph.edges))
        return self.stats(altered=1)


__all__ = ["GraphSession", "QueryError", "QuerySyntaxError", "ValueVar"]

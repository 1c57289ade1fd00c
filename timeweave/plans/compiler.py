"""Syntax tree to DataFrame.  Patterns become joins; Catalyst orders, prunes and pushes down."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.functions.aggregates import AGGREGATES
from timeweave.functions.scalar import SCALARS, divide
from timeweave.functions.temporal import from_micros, micros, micros_of, parse_duration
from timeweave.graph import INTERVALS, EdgeTable, TemporalGraph, where_interval
from timeweave.operators.traverse import SEMANTICS, count_pairs, gathered
from timeweave.plans import ast

TIMES = (T.TimestampType, T.TimestampNTZType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class QueryError(ValueError):
    """The query names something that is not there, or uses it where it can't be used."""


@dataclass(frozen=True)
class NodeVar:
    labels: tuple[str, ...]
    columns: dict[str, str]  # property -> column; id and label always


@dataclass(frozen=True)
class RelVar:
    types: tuple[str, ...]
    columns: dict[str, str]


@dataclass(frozen=True)
class HopsVar:
    """A variable-length relationship: the ids of its edges, in order."""

    ids: str


@dataclass(frozen=True)
class PathVar:
    nodes: tuple[str, ...]  # id columns
    hops: tuple[tuple[str, str], ...]  # (edge or edges, column)
    valid: tuple[str, str] | None = None  # when all edges are valid, of a MATCH with PATH


@dataclass(frozen=True)
class ValueVar:
    column: str


Scope = dict[str, Any]


@dataclass
class Rows:
    df: DataFrame
    scope: Scope


@dataclass
class Piece:
    """A compiled pattern: its rows, its own variables, and columns that must equal an outer variable's."""

    df: DataFrame | None
    scope: Scope = field(default_factory=dict)
    refs: list[tuple[str, str, str | None]] = field(default_factory=list)  # variable, id column, label column
    filters: list[tuple[str, tuple]] = field(default_factory=list)  # variable, ((property, expression), ...)
    edges: list[tuple[frozenset[str], str]] = field(default_factory=list)


def conjuncts(e: Any) -> list:
    if isinstance(e, ast.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [] if e is None else [e]


def walk(e: Any):
    yield e
    if isinstance(e, (tuple, list)):
        for x in e:
            yield from walk(x)
    elif hasattr(e, "__dataclass_fields__"):
        for name in e.__dataclass_fields__:
            value = getattr(e, name)
            if isinstance(value, tuple) or hasattr(value, "__dataclass_fields__"):
                yield from walk(value)


def has_aggregate(e: Any) -> bool:
    return any(isinstance(x, ast.Call) and (x.name in AGGREGATES or any(isinstance(a, ast.Star) for a in x.args)) for x in walk(e))


class Compiler:
    def __init__(self, graph: TemporalGraph, params: dict[str, Any] | None = None, max_hops: int = 10, functions: dict[str, Any] | None = None):
        self.graph, self.params, self.max_hops = graph, params or {}, max_hops
        self.functions = SCALARS if functions is None else {**SCALARS, **functions}
        self.spark = graph.spark
        self.n = 0
        self.prefix: ast.Temporal | None = None
        self.semantics: str | None = None
        self.running: dict[ast.Call, tuple[str, str]] = {}

    # queries

    def query(self, q: ast.Query, start: Rows | None = None) -> Rows:
        """The rows of ``q``; ``start`` holds what an enclosing CALL passes in."""
        saved, self.prefix = self.prefix, q.temporal or self.prefix
        rows, clauses = start, q.clauses
        counted = self.path_counts(*clauses[:2]) if start is None and len(clauses) > 1 else None
        if counted is not None:
            rows, clauses = counted[0], [counted[1], *clauses[2:]]
        for clause in clauses:
            rows = self.clause(clause, rows)
        self.prefix = saved
        for every, other in q.unions:
            more = self.query(other, start)
            names = [n for n in rows.scope]
            if names != list(more.scope):
                raise QueryError(f"UNION of different columns: {names} and {list(more.scope)}")
            both = self.plain(rows).unionByName(self.plain(more))
            df = both if every else both.distinct()
            rows = Rows(df, {c: ValueVar(c) for c in df.columns})
        return rows

    def result(self, q: ast.Query) -> DataFrame:
        if not any(isinstance(c, ast.Project) and c.final for c in q.clauses):
            raise QueryError("the query returns nothing: RETURN is missing")
        return self.plain(self.query(q))

    def plain(self, rows: Rows) -> DataFrame:
        """Columns named after the variables; nodes and relationships become structs."""
        return rows.df.select(*[self.value(ast.Var(name), rows).alias(name) for name in rows.scope])

    def clause(self, c: Any, rows: Rows | None) -> Rows:
        if isinstance(c, ast.Match):
            return self.match(c, rows)
        if isinstance(c, ast.Project):
            return self.project(c, rows or self.unit())
        if isinstance(c, ast.Unwind):
            rows = rows or self.unit()
            name = self.fresh(c.alias)
            out = rows.df.withColumn(name, F.explode(self.value(c.expr, rows)))
            return Rows(out, {**rows.scope, c.alias: ValueVar(name)})
        if isinstance(c, ast.Subquery):
            return self.subquery(c, rows)
        raise QueryError(f"{type(c).__name__} is a write; run it through a session")

    def unit(self) -> Rows:
        return Rows(self.spark.range(1).select(F.lit(1).alias("_unit")), {})

    def fresh(self, name: str) -> str:
        self.n += 1
        return f"{re.sub(r'\W', '_', name)}__{self.n}"

    def subquery(self, c: ast.Subquery, rows: Rows | None) -> Rows:
        """An inner query that starts with WITH over outer variables runs for each row; any other is crossed."""
        first = c.query.clauses[0]
        if rows is not None and isinstance(first, ast.Project) and not first.final and all(isinstance(i.expr, ast.Var) for i in first.items):
            key = self.fresh("row")
            outer = rows.df.withColumn(key, F.monotonically_increasing_id())
            keep = ast.Project([*first.items, ast.Item(ast.Var(key), key)], first.distinct)
            inner = ast.Query([keep, *c.query.clauses[1:]], c.query.temporal)
            inner.clauses = [self._carry(x, key) for x in inner.clauses]
            got = self.query(inner, Rows(outer, {**rows.scope, key: ValueVar(key)}))
            names = [n for n in got.scope if n != key]
            renamed = got.df.select(got.scope[key].column if isinstance(got.scope[key], ValueVar) else key, *[self.value(ast.Var(n), got).alias(self.fresh(n)) for n in names])
            back = renamed.withColumnRenamed(renamed.columns[0], f"{key}_in")
            joined = outer.join(back, F.col(key) == F.col(f"{key}_in"))
            return Rows(joined, {**rows.scope, **{n: ValueVar(col) for n, col in zip(names, renamed.columns[1:], strict=True)}})
        got = self.query(c.query)
        out = self.plain(got)
        renamed = {n: self.fresh(n) for n in out.columns}
        out = out.select(*[F.col(f"`{n}`").alias(x) for n, x in renamed.items()])
        df = out if rows is None else rows.df.crossJoin(out)
        return Rows(df, {**(rows.scope if rows else {}), **{n: ValueVar(x) for n, x in renamed.items()}})

    def _carry(self, clause: Any, key: str) -> Any:
        """Projections inside a per-row subquery hand its row key on, so aggregation is per row."""
        if isinstance(clause, ast.Project) and not clause.star and all(i.alias != key for i in clause.items):
            return replace(clause, items=[*clause.items, ast.Item(ast.Var(key), key)])
        return clause

    # MATCH

    def match(self, m: ast.Match, rows: Rows | None) -> Rows:
        outer = rows.scope if rows else {}
        self.semantics = m.semantics
        piece = self.patterns(m.patterns, outer, m.temporal or self.prefix)
        self.semantics = None
        return self.attach(rows, piece, m.where, m.optional)

    def attach(self, rows: Rows | None, piece: Piece, where: Any, optional: bool) -> Rows:
        outer = rows.scope if rows else {}
        scope = {**outer, **piece.scope}
        if piece.df is None:  # every variable was bound already
            df = rows.df
        elif rows is None:
            df = piece.df
            if optional:  # a lone OPTIONAL MATCH gives a row of nulls if there is none
                df = self.unit().df.join(df, F.lit(True), "left")
        else:
            on = F.lit(True)
            for var, id_col, label_col in piece.refs:
                mine = outer[var].columns
                on = on & (F.col(mine["id"]) == F.col(id_col))
                if label_col:
                    on = on & (F.col(mine["label"]) == F.col(label_col))
            if optional:
                joint = Rows(rows.df.join(piece.df.limit(0), F.lit(False), "left"), scope)  # to type the condition
                for cond in self.prop_filters(piece, joint) + [self.value(x, joint) for x in conjuncts(where)]:
                    on = on & cond
                return Rows(rows.df.join(piece.df, on, "left"), scope)
            df = rows.df.join(piece.df, on) if piece.refs else rows.df.crossJoin(piece.df)
        joint = Rows(df, scope)
        for cond in self.prop_filters(piece, joint):
            joint = Rows(joint.df.where(cond), scope)
        return self.where(where, joint)

    def path_counts(self, m: Any, p: Any) -> tuple[Rows, ast.Project] | None:
        """A MATCH of two edges whose projection is the three nodes' ids and count(*): the paths' vertices with their counts, and the projection of these.

        Parallel edges are gathered before they are joined, so that the join gives each three
        vertices once and nothing is grouped after it: no task holds a table of all its paths.
        None for any other clauses.
        """
        if not isinstance(m, ast.Match) or not isinstance(p, ast.Project) or m.optional or m.where is not None or p.star or len(m.patterns) != 1:
            return None
        nodes, rels = m.patterns[0].parts[0::2], m.patterns[0].parts[1::2]
        names = [n.var for n in nodes]
        if m.patterns[0].path or len(rels) != 2 or len(set(names)) != 3 or any(n.props or len(n.labels) != 1 for n in nodes) or any(r.props or r.hops is not None for r in rels):
            return None
        every, ids = ast.Call("count", (ast.Star(),)), [ast.Prop(ast.Var(n), "id") for n in names]
        exprs, sort = [i.expr for i in p.items], [e for e, _ in p.order if not (isinstance(e, ast.Var) and any(e.name == i.alias for i in p.items))]
        if every not in exprs or not set(ids) <= set(exprs) or not all(e == every or e in ids for e in exprs + sort):
            return None
        temporal, labels = m.temporal or self.prefix, [self.labels_of(n, {}) for n in nodes]
        tables = [self.rel_tables(r, labels[i], labels[i + 1]) for i, r in enumerate(rels)]
        if not all(tables):
            raise QueryError("no relationship connects these labels")
        self.semantics = m.semantics
        axis, never = INTERVALS[temporal.axis if temporal else "valid"], F.lit(None).cast("timestamp_ntz")
        shared = {e.type for e, _ in tables[0]} & {e.type for e, _ in tables[1]}  # a relationship is matched once in a MATCH
        straight = rels[0].direction == rels[1].direction != "both"  # where only a loop can be both edges
        hops = []
        for i, rel in enumerate(rels):
            edges, columns, ends = self.edge_rows(tables[i], rel.var, temporal, rel.direction == "both")
            key = F.col(columns["edge_id"]) if shared else F.lit(None).cast("string")
            key = F.when(F.col(ends["from"]) == F.col(ends["to"]), key) if straight else key
            times = [F.col(columns[c]) if self.semantics and c in columns else never for c in axis]
            pairs = gathered(edges.select(F.col(ends["from"]).alias("src"), F.col(ends["to"]).alias("dst"), key.alias("key"), *[c.alias(n) for c, n in zip(times, "ft", strict=True)]), *map(F.col, ("key", "f", "t")))
            hops.append(pairs.select(F.col("src").alias(f"_from{i}"), F.col("dst").alias(f"_to{i}"), F.col("edges").alias(f"_edges{i}")))
        scope: Scope = {}
        for i, (at, hop) in enumerate((("_from0", 0), ("_to0", 0), ("_to1", 1))):
            rows, var = self.node_rows(labels[i], nodes[i].var, temporal)
            found = rows.groupBy(var.columns["id"], var.columns["label"]).agg(F.count(F.lit(1)).alias(f"_times{i}"))
            hops[hop] = hops[hop].join(found, F.col(at) == F.col(var.columns["id"]))
            scope[nodes[i].var] = replace(var, columns={k: var.columns[k] for k in ("id", "label")})

        def fits(x: Column, y: Column) -> Column:
            return self.along((x["f"], x["t"], x["f"], x["t"]), y["f"], y["t"])[0]

        one, two = F.col("_edges0"), F.col("_edges1")
        plain = F.size(one).cast("bigint") * F.size(two) if self.semantics in (None, "snapshot") else count_pairs(one, two, fits)
        if shared:
            meet = F.col("_from0") == F.col("_to1")
            n = F.when(meet & (F.col("_from0") == F.col("_to0")) if straight else meet, count_pairs(one, two, lambda x, y: fits(x, y) & F.coalesce(x["key"] != y["key"], F.lit(True)))).otherwise(plain)
        else:
            n = plain
        for i in range(3):
            n = n * F.col(f"_times{i}")
        name = self.fresh("paths")
        df = hops[0].join(hops[1], F.col("_to0") == F.col("_from1")).withColumn(name, n).where(F.col(name) > 0)
        self.semantics = None
        of = ast.Var("_paths")
        items = [replace(i, expr=of) if i.expr == every else i for i in p.items]
        return Rows(df, {**scope, "_paths": ValueVar(name)}), replace(p, items=items, order=[(of if e == every else e, up) for e, up in p.order])

    def prop_filters(self, piece: Piece, rows: Rows) -> list[Column]:
        return [self.value(ast.Prop(ast.Var(var), key), rows) == self.value(expr, rows) for var, props in piece.filters for key, expr in props]

    def where(self, e: Any, rows: Rows) -> Rows:
        """Rows for which ``e`` is true.  Patterns as conjuncts, negated or not, become anti and semi joins."""
        for part in conjuncts(e):
            how, inside = "left_semi", part
            if isinstance(part, ast.Unary) and part.op == "NOT" and isinstance(part.of, ast.Exists):
                how, inside = "left_anti", part.of
            if not isinstance(inside, ast.Exists):
                rows = Rows(rows.df.where(self.value(part, rows)), rows.scope)
                continue
            piece = self.patterns([inside.pattern], rows.scope, self.prefix)
            own = Rows(piece.df, piece.scope)
            df = piece.df
            for var, props in piece.filters:
                for key, expr in props:
                    df = df.where(self.value(ast.Prop(ast.Var(var), key), own) == self.value(expr, own))
            on = F.lit(True)
            for var, id_col, label_col in piece.refs:
                on = on & (F.col(rows.scope[var].columns["id"]) == F.col(id_col))
                if label_col:
                    on = on & (F.col(rows.scope[var].columns["label"]) == F.col(label_col))
            rows = Rows(rows.df.join(df, on, how), rows.scope)
        return rows

    def patterns(self, patterns: list[ast.Pattern], outer: Scope, temporal: ast.Temporal | None) -> Piece:
        """All patterns of a MATCH, joined on the variables they share."""
        whole = Piece(None)
        for p in patterns:
            part = self.pattern(p, outer, whole.scope, temporal)
            whole.filters += part.filters
            if part.df is None:
                whole.scope |= part.scope
                whole.refs += part.refs
                continue
            if whole.df is None:
                whole.df, whole.scope, whole.refs, whole.edges = part.df, {**whole.scope, **part.scope}, part.refs, part.edges
                continue
            on, shared = F.lit(True), False
            refs = list(whole.refs)
            for var, id_col, label_col in part.refs:
                if var in whole.scope and var not in outer:
                    mine = whole.scope[var].columns
                    same_id, same_label = mine["id"], mine["label"]
                else:
                    earlier = next((r for r in whole.refs if r[0] == var), None)
                    if earlier is None:
                        refs.append((var, id_col, label_col))
                        continue
                    same_id, same_label = earlier[1], earlier[2]
                shared = True
                on = on & (F.col(same_id) == F.col(id_col))
                if label_col and same_label:
                    on = on & (F.col(same_label) == F.col(label_col))
            for types, one in whole.edges:  # a relationship is matched once in a MATCH
                for others, two in part.edges:
                    if types & others:
                        on = on & (F.col(one) != F.col(two))
            whole.df = whole.df.join(part.df, on) if shared else whole.df.crossJoin(part.df).where(on)
            whole.scope, whole.refs, whole.edges = {**whole.scope, **part.scope}, refs, whole.edges + part.edges
        return whole

    def labels_of(self, node: ast.NodePat, known: Scope) -> tuple[str, ...]:
        if node.labels:
            for x in node.labels:
                if x not in self.graph.nodes:
                    raise QueryError(f"no label {x}")
            return node.labels
        bound = known.get(node.var)
        if bound is not None and not isinstance(bound, NodeVar):
            raise QueryError(f"{node.var} is not a node")
        return bound.labels if bound else ()

    def rel_tables(self, rel: ast.RelPat, left: tuple[str, ...], right: tuple[str, ...]) -> list[tuple[EdgeTable, bool]]:
        """Edge tables that may match, each with whether it is read backwards."""
        for t in rel.types:
            if not self.graph.edge_tables([t]):
                raise QueryError(f"no relationship type {t}")
        out = []
        if rel.direction in ("out", "both"):
            out += [(e, False) for e in self.graph.edge_tables(rel.types, left, right)]
        if rel.direction in ("in", "both"):
            out += [(e, True) for e in self.graph.edge_tables(rel.types, right, left)]
        return out

    def edge_rows(self, tables: list[tuple[EdgeTable, bool]], var: str, temporal: ast.Temporal | None, both: bool) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
        """Edges from one side to the other: the DataFrame, property columns, and the end columns."""
        props = list(dict.fromkeys(p for e, _ in tables for p in e.props))
        tag = self.fresh(var)
        columns = {p: f"{tag}__{p}" for p in props} | {"edge_id": f"{tag}__edge_id", "type": f"{tag}__type", "src": f"{tag}__src", "dst": f"{tag}__dst"}
        ends = {k: f"{tag}__{k}" for k in ("from", "from_label", "to", "to_label")}
        found = None
        for e, backwards in tables:
            if self.semantics and temporal is not None and temporal.kind == "between" and INTERVALS[temporal.axis][0] in e.df.columns:
                df = e.df.where(SEMANTICS[self.semantics](*[F.col(c) for c in INTERVALS[temporal.axis]], *[self.moment(a) for a in temporal.args]))
            else:
                df = self.travel(e.df, ("src", "dst"), temporal)
            if backwards and both:
                df = df.where("src <> dst") if e.src_label == e.dst_label else df  # a loop is met once
            a, b = ("dst", "src") if backwards else ("src", "dst")
            la, lb = (e.dst_label, e.src_label) if backwards else (e.src_label, e.dst_label)
            one = df.select(
                *[F.col(p).alias(columns[p]) for p in e.props],
                e.key().alias(columns["edge_id"]),
                F.lit(e.type).alias(columns["type"]),
                F.col("src").alias(columns["src"]),
                F.col("dst").alias(columns["dst"]),
                F.col(a).alias(ends["from"]),
                F.lit(la).alias(ends["from_label"]),
                F.col(b).alias(ends["to"]),
                F.lit(lb).alias(ends["to_label"]),
            )
            found = one if found is None else found.unionByName(one, allowMissingColumns=True)
        return found, columns, ends

    def node_rows(self, labels: tuple[str, ...], var: str, temporal: ast.Temporal | None) -> tuple[DataFrame, NodeVar]:
        tables = self.graph.node_tables(labels)
        if not tables:
            raise QueryError("the graph has no nodes")
        tag = self.fresh(var)
        props = list(dict.fromkeys(p for t in tables for p in t.props))
        columns = {p: f"{tag}__{p}" for p in props} | {"id": f"{tag}__id", "label": f"{tag}__label"}
        found = None
        for t in tables:
            df = self.travel(t.df, ("id",), temporal)
            one = df.select(F.col("id").alias(columns["id"]), F.lit(t.label).alias(columns["label"]), *[F.col(p).alias(columns[p]) for p in t.props if p != "label"])
            found = one if found is None else found.unionByName(one, allowMissingColumns=True)
        return found, NodeVar(tuple(t.label for t in tables), columns)

    def pattern(self, p: ast.Pattern, outer: Scope, local: Scope, temporal: ast.Temporal | None) -> Piece:
        known = {**outer, **local}
        out = Piece(None)
        nodes, rels = p.parts[0::2], p.parts[1::2]
        labels = [self.labels_of(n, known) for n in nodes]
        candidates = []
        for i, rel in enumerate(rels):  # what the ends of the edges say about unlabelled nodes
            tables = self.rel_tables(rel, labels[i], labels[i + 1]) if rel.hops is None else self.rel_tables(rel, (), ())
            if not tables:
                raise QueryError("no relationship connects these labels")
            candidates.append(tables)
            if rel.hops is None or rel.hops[0] > 0:
                for at, side in ((i, 0), (i + 1, 1)):
                    seen = tuple(dict.fromkeys((e.dst_label if back != bool(side) else e.src_label) for e, back in tables))
                    if not labels[at] and nodes[at].var not in known:
                        labels[at] = seen
        for i, rel in enumerate(rels):
            if rel.hops is None:
                candidates[i] = self.rel_tables(rel, labels[i], labels[i + 1])
        ids: list[str] = []
        hops: list[tuple[str, str]] = []
        axis = INTERVALS[temporal.axis if temporal else "valid"]
        run: tuple[Column, ...] | None = None  # intervals of the path so far

        def meet(i: int, end_id: str | None, end_label: str | None) -> None:
            """Bind node i, whose id is in ``end_id`` if an edge led there."""
            node = nodes[i]
            if node.props:
                out.filters.append((node.var, node.props))
            mine = out.scope.get(node.var)
            if mine is not None:  # a cycle
                out.df = out.df.where((F.col(mine.columns["id"]) == F.col(end_id)) & (F.col(mine.columns["label"]) == F.col(end_label)))
                ids.append(mine.columns["id"])
                return
            if node.var in known:
                if end_id is not None:
                    several = len(known[node.var].labels) != 1
                    out.refs.append((node.var, end_id, end_label if several or len(labels[i]) != 1 else None))
                    ids.append(end_id)
                else:
                    ids.append(known[node.var].columns["id"])
                return
            if not node.named and not node.labels and not node.props and end_id is not None:
                ids.append(end_id)  # nobody asks for the node itself
                return
            rows, var = self.node_rows(labels[i], node.var, temporal)
            if end_id is None:
                out.df = rows
            else:
                on = F.col(var.columns["id"]) == F.col(end_id)
                if len(var.labels) != 1 or end_label is None or len({x for e, back in candidates[i - 1] for x in [e.src_label if back else e.dst_label]}) != 1:
                    on = on & (F.col(var.columns["label"]) == F.col(end_label))
                out.df = out.df.join(rows, on)
            out.scope[node.var] = var
            ids.append(var.columns["id"])

        first = nodes[0]
        anonymous = bool(rels) and (first.var in known or (not first.named and not first.labels and not first.props))
        if not anonymous or (rels and rels[0].hops is not None and first.var not in known):
            meet(0, None, None)
        for i, rel in enumerate(rels):
            edges, columns, ends = self.edge_rows(candidates[i], rel.var, temporal, rel.direction == "both")
            here = out.scope.get(nodes[i].var)
            at_id = here.columns["id"] if here else (ids[i] if i < len(ids) else None)
            at_label = here.columns["label"] if here else None
            if rel.hops is not None:
                low, high = rel.hops
                interval = tuple(columns.get(c) for c in axis)
                end_id, end_label, eids, run = self.walk(out, edges, columns, ends, at_id, at_label, low, self.max_hops if high is None else high, interval, run)
                if i == 0 and at_id is None:  # the start is an outer variable
                    out.refs.append((first.var, f"{eids}_start", None))
                    ids.append(f"{eids}_start")
                out.scope[rel.var] = HopsVar(eids)
                hops.append(("edges", eids))
            else:
                if out.df is None:
                    out.df = edges
                    if first.var in known:
                        several = len(known[first.var].labels) != 1
                        out.refs.append((first.var, ends["from"], ends["from_label"] if several else None))
                        if first.props:
                            out.filters.append((first.var, first.props))
                    ids.append(ends["from"])
                else:
                    on = F.col(at_id) == F.col(ends["from"])
                    if at_label and len(labels[i]) != 1:
                        on = on & (F.col(at_label) == F.col(ends["from_label"]))
                    for types, other in out.edges:
                        if types & {e.type for e, _ in candidates[i]}:
                            on = on & (F.col(other) != F.col(columns["edge_id"]))
                    out.df = out.df.join(edges, on)
                if self.semantics:
                    fits, run = self.along(run, *[F.col(columns[c]) if c in columns else F.lit(None).cast("timestamp_ntz") for c in axis])
                    out.df = out.df.where(fits)
                out.edges.append((frozenset(e.type for e, _ in candidates[i]), columns["edge_id"]))
                out.scope[rel.var] = RelVar(tuple(e.type for e, _ in candidates[i]), columns)
                if rel.props:
                    out.filters.append((rel.var, rel.props))
                hops.append(("edge", columns["edge_id"]))
                end_id, end_label = ends["to"], ends["to_label"]
            meet(i + 1, end_id, end_label)
        if p.path:
            valid = None
            if run is not None:
                valid = self.fresh("valid_from"), self.fresh("valid_to")
                out.df = out.df.withColumns(dict(zip(valid, run[:2], strict=True)))
            out.scope[p.path] = PathVar(tuple(ids), tuple(hops), valid)
        return out

    def along(self, run: tuple[Column, ...] | None, start: Column, end: Column) -> tuple[Column, tuple[Column, ...]]:
        """Whether a path may go on over an edge valid in [start, end), and its intervals then: when all edges are valid, and the last edge's own.

        A null is an open end, or an edge that is always valid.
        """
        if run is None:
            return F.lit(True), (start, end, start, end)
        lo, hi, before_start, before_end = run
        lo, hi = F.greatest(lo, start), F.least(hi, end)  # which leave out nulls
        fits = F.lit(True)
        if self.semantics == "continuous":
            fits = F.coalesce(lo < hi, F.lit(True))
        elif self.semantics == "pairwise":
            fits = F.coalesce(before_end > start, F.lit(True)) & F.coalesce(end > before_start, F.lit(True))
        elif self.semantics == "sequential":
            fits = F.coalesce(start >= before_start, F.lit(True))
        return fits, (lo, hi, start, end)

    def walk(self, out: Piece, edges: DataFrame, columns: dict, ends: dict, at_id: str | None, at_label: str | None, low: int, high: int, interval: tuple[str | None, str | None], run: tuple[Column, ...] | None) -> tuple[str, str, str, tuple[Column, ...] | None]:
        """All walks of ``low`` to ``high`` edges without a repeated edge; one join for each hop.

        With PATH semantics a walk carries the intervals of the path up to its end.
        """
        eids, end_id, end_label = self.fresh("walk"), self.fresh("end"), self.fresh("end_label")
        never = F.lit(None).cast("timestamp_ntz")
        carried = [self.fresh(n) for n in ("lo", "hi", "last_from", "last_to")] if self.semantics else []
        times = [(F.col(c) if c else never).alias(n) for n, c in zip(("_vf", "_vt"), interval, strict=True)] if carried else []
        step = edges.select(F.col(ends["from"]).alias("_f"), F.col(ends["from_label"]).alias("_fl"), F.col(ends["to"]).alias("_t"), F.col(ends["to_label"]).alias("_tl"), F.col(columns["edge_id"]).alias("_e"), *times)
        own = [F.col(c) for c in ("_vf", "_vt", "_vf", "_vt")][: len(carried)]
        if at_id is None:  # from an outer variable: begin with every edge
            if low == 0:
                raise QueryError("a walk of no edges from a variable of an earlier clause")
            front = step.select(F.col("_f").alias(f"{eids}_start"), F.col("_t").alias(end_id), F.col("_tl").alias(end_label), F.array("_e").alias(eids), *[c.alias(n) for c, n in zip(own, carried, strict=True)])
            levels, done = ([front] if low <= 1 else []), 1
        else:
            label = F.col(at_label) if at_label else F.lit(None).cast("string")
            front = out.df.withColumn(end_id, F.col(at_id)).withColumn(end_label, label).withColumn(eids, F.array().cast("array<string>"))
            front = front.withColumns(dict(zip(carried, run or (never,) * 4)))
            levels, done = ([front] if low == 0 else []), 0
        for k in range(done + 1, high + 1):
            on = (F.col(end_id) == F.col("_f")) & ~F.array_contains(F.col(eids), F.col("_e"))
            if at_label or k > 1:
                on = on & (F.col(end_label) == F.col("_fl"))
            after: tuple[Column, ...] = ()
            if carried:
                fits, after = self.along(tuple(F.col(c) for c in carried), *own[:2])
                on = on & fits
            joined = front.join(step, on)
            keep = [c for c in front.columns if c not in (end_id, end_label, eids, *carried)]
            front = joined.select(*keep, F.col("_t").alias(end_id), F.col("_tl").alias(end_label), F.concat(F.col(eids), F.array("_e")).alias(eids), *[c.alias(n) for c, n in zip(after, carried, strict=True)])
            if k >= low:
                levels.append(front)
        if not levels:
            raise QueryError(f"no walk has {low} to {high} edges")
        found = levels[0]
        for x in levels[1:]:
            found = found.unionByName(x)
        out.df = found
        return end_id, end_label, eids, tuple(F.col(c) for c in carried) or None

    # time travel

    def travel(self, df: DataFrame, entity: tuple[str, ...], temporal: ast.Temporal | None) -> DataFrame:
        """``df`` as a modifier sees it.  Tables without intervals on its axis are static."""
        if temporal is None or INTERVALS[temporal.axis][0] not in df.columns:
            return df
        lo = INTERVALS[temporal.axis][0]
        if temporal.kind == "all_versions":
            return df
        if temporal.kind in ("as_of", "between", "contained_in"):
            return where_interval(df, temporal.kind, tuple(self.moment(a) for a in temporal.args), temporal.axis)
        by = W.partitionBy(*[c for c in entity if c in df.columns])
        if temporal.kind == "version":
            k = self.constant(temporal.args[0])
            return df.withColumn("_v", F.dense_rank().over(by.orderBy(lo)) - 1).where(F.col("_v") == k).drop("_v")
        if temporal.kind in ("first", "last"):
            order = F.col(lo).asc() if temporal.kind == "first" else F.col(lo).desc()
            return df.withColumn("_v", F.row_number().over(by.orderBy(order, *[c for c in ("edge_id",) if c in df.columns]))).where("_v = 1").drop("_v")
        when = self.moment(temporal.args[0])  # the version before or after the one valid then
        if temporal.kind == "prev":
            is_now = F.max(F.when(F.col(lo) <= when, F.col(lo))).over(by)
            return df.withColumn("_now", is_now).withColumn("_v", F.max(F.when(F.col(lo) < F.col("_now"), F.col(lo))).over(by)).where(F.col(lo) == F.col("_v")).drop("_v", "_now")
        return df.withColumn("_v", F.min(F.when(F.col(lo) > when, F.col(lo))).over(by)).where(F.col(lo) == F.col("_v")).drop("_v")

    def moment(self, e: Any) -> Column:
        """A literal timestamp of ISO text or microseconds; any other expression as it is."""
        value = e.value if isinstance(e, ast.Lit) else self.params.get(e.name) if isinstance(e, ast.Param) else None
        if value is not None:
            return from_micros(F.lit(micros_of(value)))
        c = self.value(e, self.unit())
        return c if isinstance(self.type_of(c, self.unit()), TIMES) else from_micros(c)

    def constant(self, e: Any) -> int:
        """A whole number known before the query runs."""
        if isinstance(e, ast.Lit):
            value = e.value
        elif isinstance(e, ast.Param):
            value = self.params.get(e.name)
        else:
            rows = self.unit()
            value = rows.df.select(self.value(e, rows)).first()[0]
        if not isinstance(value, int) or isinstance(value, bool) or value < 0:
            raise QueryError(f"not a whole number: {value!r}")
        return value

    # WITH and RETURN

    def project(self, p: ast.Project, rows: Rows) -> Rows:
        items = [ast.Item(ast.Var(v), v) for v in rows.scope if not v.startswith("_")] if p.star else []
        items += p.items
        names = [i.alias for i in items]
        if len(set(names)) != len(names):
            raise QueryError(f"two columns have one name: {names}")
        if not items:
            raise QueryError("nothing to return")
        grouped = [i for i in items if has_aggregate(i.expr)]
        order = [(e, up) for e, up in p.order]
        if grouped:
            keys = [i for i in items if not has_aggregate(i.expr)]
            scope: Scope = {}
            by: list[Column] = []
            for i in keys:  # a node as a key keeps being a node
                bound = rows.scope.get(i.expr.name) if isinstance(i.expr, ast.Var) else None
                if isinstance(bound, (NodeVar, RelVar)):
                    by += [F.col(c) for c in dict.fromkeys(bound.columns.values())]
                    scope[i.alias] = bound
                else:
                    name = self.fresh(i.alias)
                    by.append(self.value(i.expr, rows).alias(name))
                    scope[i.alias] = ValueVar(name)
            over = self.window_of([i.expr for i in grouped] + [e for e, _ in order], rows)
            if over is not None:
                if {"window_start", "window_end"} & set(names):
                    raise QueryError("window_start and window_end are the columns of the window itself")
                spans = self.fresh("window")
                by.append(over.alias(spans))
            source, by = self.sums_in_order([i.expr for i in grouped] + [e for e, _ in order], keys, by, rows) if over is None else (rows.df, by)
            aggs = []
            for i in grouped:
                name = self.fresh(i.alias)
                aggs.append(self.value(i.expr, rows).alias(name))
                scope[i.alias] = ValueVar(name)
            hidden = {}
            for e, _ in order:  # ORDER BY count(*) that is not returned
                if has_aggregate(e) and not any(i.expr == e for i in items):
                    hidden[e] = self.fresh("sort")
                    aggs.append(self.value(e, rows).alias(hidden[e]))
            self.running = {}
            df = source.groupBy(*by).agg(*aggs) if by else source.agg(*aggs)
            if over is not None:
                names += ["window_start", "window_end"]
                scope |= {n: ValueVar(f"{spans}_{n}") for n in names[-2:]}
                df = df.withColumns({f"{spans}_{n}": F.col(spans)[n.removeprefix("window_")] for n in names[-2:]})
            made = Rows(df, {n: scope[n] for n in names})
            by_text = {i.expr: i.alias for i in items}
            order = [(ast.Var(by_text[e]) if e in by_text else _Column(hidden[e]) if e in hidden else e, up) for e, up in order]
        else:
            scope, columns, made_names = {}, [], []
            for i in items:
                bound = rows.scope.get(i.expr.name) if isinstance(i.expr, ast.Var) else None
                if isinstance(bound, (NodeVar, RelVar, HopsVar, PathVar)):
                    scope[i.alias] = bound
                    held = bound.columns.values() if isinstance(bound, (NodeVar, RelVar)) else [bound.ids] if isinstance(bound, HopsVar) else [*bound.nodes, *[h[1] for h in bound.hops], *(bound.valid or ())]
                    for c in held:
                        if c not in made_names:
                            columns.append(F.col(c))
                            made_names.append(c)
                else:
                    name = self.fresh(i.alias)
                    columns.append(self.value(i.expr, rows).alias(name))
                    made_names.append(name)
                    scope[i.alias] = ValueVar(name)
            if p.distinct or not order:
                made = Rows(rows.df.select(*columns), scope)
            else:  # sort keys may be older variables, which go afterwards
                both = Rows(rows.df, {**rows.scope, **{n: v for n, v in scope.items() if not isinstance(v, ValueVar)}})
                sort, resolved = [], []
                aliases = {i.alias: i.expr for i in items}
                for e, up in order:
                    e = aliases.get(e.name, e) if isinstance(e, ast.Var) else e
                    name = self.fresh("sort")
                    sort.append(self.value(e, both).alias(name))
                    resolved.append((_Column(name), up))
                made, order = Rows(rows.df.select(*columns, *sort), scope), resolved
        if p.distinct:
            made = Rows(made.df.select(*[c for c in made.df.columns if not c.startswith("sort__")]).distinct(), made.scope)
            by_text = {i.expr: i.alias for i in items}
            order = [(ast.Var(by_text[e]) if e in by_text else e, up) for e, up in order]
        if order:
            made = Rows(made.df.orderBy(*[self.sort_key(e, up, made) for e, up in order]), made.scope)
        if p.skip is not None:
            made = Rows(made.df.offset(self.constant(p.skip)), made.scope)
        if p.limit is not None:
            made = Rows(made.df.limit(self.constant(p.limit)), made.scope)
        if p.where is not None:
            made = self.where(p.where, made)
        return made

    def sums_in_order(self, exprs: list, keys: list, by: list[Column], rows: Rows) -> tuple[DataFrame, list[Column]]:
        """The rows with running sums of the floats that are summed per node, and the keys as their columns.

        A sum of floats depends on their order.  Per node they are added in order of the ids of
        whom they belong to, however tasks and files lie; coarser groups, which one task should
        not have to sort, are added as they come.
        """
        of_node = lambda e: isinstance(rows.scope.get(e.name) if isinstance(e, ast.Var) else None, NodeVar)
        per_node = any(of_node(k.expr) or isinstance(k.expr, ast.Prop) and k.expr.name == "id" and of_node(k.expr.of) or isinstance(k.expr, ast.Call) and k.expr.name == "id" and of_node(k.expr.args[0]) for k in keys)
        sums = dict.fromkeys(x for e in exprs for x in walk(e) if isinstance(x, ast.Call) and x.name == "sum" and not x.distinct) if per_node else {}
        df, names = rows.df, by
        for call in sums:
            owners = dict.fromkeys(x.name for x in walk(call.args) if isinstance(x, ast.Var) and isinstance(rows.scope.get(x.name), (NodeVar, RelVar)))
            value = self.value(call.args[0], rows) if owners and not isinstance(call.args[0], ast.Var) else None
            if value is None or not isinstance(self.type_of(value, rows), (T.DoubleType, T.FloatType)):
                continue
            if not self.running:  # the keys become columns that the window and the grouping share
                made = df.select("*", *[c.alias(f"_key{n}") for n, c in enumerate(by)])
                plain = rows.df.select(*by).columns
                df, names = made, [F.col(f"_key{n}").alias(c) for n, c in enumerate(plain)]
            ids = []
            for x in owners:
                c = rows.scope[x].columns
                ids += [F.col(c["id"]), F.col(c["label"])] if "id" in c else [F.length(c["edge_id"]), F.col(c["edge_id"])]
            order = W.partitionBy(*[f"_key{n}" for n in range(len(by))]).orderBy(*ids)
            total, place = self.fresh("running"), self.fresh("place")
            df = df.withColumn(total, F.sum(value).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn(place, F.row_number().over(order))
            self.running[call] = total, place
        return df, names

    def window_of(self, exprs: list, rows: Rows) -> Column | None:
        """The one event-time window that the aggregates of a projection are taken over.

        The time is what ON names, or the start of validity of whom the aggregated property belongs to.
        """
        found = {}
        for w in (x for e in exprs for x in walk(e) if isinstance(x, ast.Windowed)):
            time = w.time
            if time is None:
                owner = next((x.of for x in walk(w.of) if isinstance(x, ast.Prop)), next((x for x in walk(w.of) if isinstance(x, ast.Var)), None))
                if owner is None:
                    raise QueryError("WINDOW needs ON and a time here")
                time = ast.Prop(owner, INTERVALS["valid"][0])
            found[w.length, w.slide, time] = None
        if not found:
            return None
        if len(found) > 1:
            raise QueryError("two different windows in one projection")
        length, slide, time = next(iter(found))
        at = self.value(time, rows)
        if not isinstance(self.type_of(at, rows), TIMES):
            raise QueryError("WINDOW needs a time")
        return F.window(at, *[f"{parse_duration(x)} microseconds" for x in (length, slide) if x])

    def sort_key(self, e: Any, up: bool, rows: Rows) -> Column:
        c = F.col(e.name) if isinstance(e, _Column) else self.value(e, rows)
        return c.asc_nulls_last() if up else c.desc_nulls_first()

    # expressions

    def type_of(self, c: Column, rows: Rows) -> T.DataType:
        return rows.df.select(c.alias("x")).schema["x"].dataType

    def value(self, e: Any, rows: Rows) -> Column:
        method = getattr(self, "_" + type(e).__name__.lower(), None)
        if method is None:
            raise QueryError(f"{type(e).__name__} can't be used here")
        return method(e, rows)

    def _lit(self, e: ast.Lit, rows: Rows) -> Column:
        return F.lit(e.value).cast("bigint") if type(e.value) is int else F.lit(e.value)

    def _param(self, e: ast.Param, rows: Rows) -> Column:
        value = self.params.get(e.name)
        if isinstance(value, (list, tuple)):
            return F.array(*[self._lit(ast.Lit(v), rows) for v in value])
        return value if isinstance(value, Column) else self._lit(ast.Lit(value), rows)

    def _var(self, e: ast.Var, rows: Rows) -> Column:
        bound = rows.scope.get(e.name)
        if bound is None:
            raise QueryError(f"unknown variable {e.name}")
        if isinstance(bound, ValueVar):
            return F.col(bound.column)
        if isinstance(bound, HopsVar):
            return F.col(bound.ids)
        if isinstance(bound, PathVar):
            return F.array(*[F.col(c) for c in bound.nodes])
        return F.when(F.col(bound.columns["id" if isinstance(bound, NodeVar) else "edge_id"]).isNotNull(), F.struct(*[F.col(c).alias(p) for p, c in bound.columns.items()]))

    def _prop(self, e: ast.Prop, rows: Rows) -> Column:
        if isinstance(e.of, ast.Var):
            bound = rows.scope.get(e.of.name)
            if bound is None:
                raise QueryError(f"unknown variable {e.of.name}")
            if isinstance(bound, (NodeVar, RelVar)):
                name = bound.columns.get(e.name)
                return F.col(name) if name else F.lit(None)  # a property that nobody has
        inner = self.value(e.of, rows)
        kind = self.type_of(inner, rows)
        if isinstance(kind, T.StringType):  # pseudo-properties of strings
            if e.name in ("length", "size"):
                return F.length(inner)
            if e.name in ("toUpper", "toLower"):
                return F.upper(inner) if e.name == "toUpper" else F.lower(inner)
        if isinstance(kind, T.StructType) and e.name not in kind.names:
            return F.lit(None)
        return inner[e.name]

    def _index(self, e: ast.Index, rows: Rows) -> Column:
        of = self.value(e.of, rows)
        if isinstance(self.type_of(of, rows), T.MapType):
            return F.try_element_at(of, self.value(e.at, rows))
        return F.get(of, self.value(e.at, rows).cast("int"))

    def _listof(self, e: ast.ListOf, rows: Rows) -> Column:
        return F.array(*[self.value(x, rows) for x in e.items])

    def _mapof(self, e: ast.MapOf, rows: Rows) -> Column:
        return F.struct(*[self.value(x, rows).alias(k) for k, x in e.items])

    def _isnull(self, e: ast.IsNull, rows: Rows) -> Column:
        bound = rows.scope.get(e.of.name) if isinstance(e.of, ast.Var) else None
        c = F.col(bound.columns["id" if isinstance(bound, NodeVar) else "edge_id"]) if isinstance(bound, (NodeVar, RelVar)) else self.value(e.of, rows)
        return c.isNotNull() if e.negated else c.isNull()

    def _case(self, e: ast.Case, rows: Rows) -> Column:
        of = None if e.of is None else self.value(e.of, rows)
        out = None
        for test, then in e.whens:
            cond = self.value(test, rows) if of is None else of == self.value(test, rows)
            out = F.when(cond, self.value(then, rows)) if out is None else out.when(cond, self.value(then, rows))
        return out if e.default is None else out.otherwise(self.value(e.default, rows))

    def _exists(self, e: ast.Exists, rows: Rows) -> Column:
        raise QueryError("a pattern can be a condition of its own in WHERE, or NOT one, but not part of another expression")

    def _unary(self, e: ast.Unary, rows: Rows) -> Column:
        c = self.value(e.of, rows)
        return ~c if e.op == "NOT" else -c

    def _binary(self, e: ast.Binary, rows: Rows) -> Column:
        if e.op == "IN":
            left = self.value(e.left, rows)
            if isinstance(e.right, ast.ListOf):
                return left.isin(*[self.value(x, rows) for x in e.right.items]) if e.right.items else F.lit(False)
            return F.array_contains(self.value(e.right, rows), left)
        a, b = self.value(e.left, rows), self.value(e.right, rows)
        match e.op:
            case "AND":
                return a & b
            case "OR":
                return a | b
            case "XOR":
                return (a | b) & ~(a & b)
            case "=":
                return a == b
            case "<>":
                return a != b
            case "<" | "<=" | ">" | ">=":
                return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op]
            case "STARTS":
                return SCALARS["starts_with"](a, b)
            case "ENDS":
                return SCALARS["ends_with"](a, b)
            case "CONTAINS":
                return SCALARS["contains"](a, b)
            case "=~":
                return F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
        ta, tb = self.type_of(a, rows), self.type_of(b, rows)
        if isinstance(ta, TIMES) or isinstance(tb, TIMES):
            return self.time_arithmetic(e.op, a, ta, b, tb)
        if e.op == "+":
            if isinstance(ta, T.ArrayType) or isinstance(tb, T.ArrayType):
                return F.concat(a, b)
            if isinstance(ta, T.StringType) or isinstance(tb, T.StringType):
                return F.concat(a.cast("string"), b.cast("string"))
            return a + b
        if e.op == "-":
            return a - b
        if e.op == "*":
            return a * b
        if e.op == "/":
            return divide(a, b, isinstance(ta, WHOLE) and isinstance(tb, WHOLE))
        return F.try_mod(a, b)

    def time_arithmetic(self, op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
        """timestamp - timestamp gives microseconds; timestamp and microseconds give a timestamp."""
        if op == "-" and isinstance(ta, TIMES) and isinstance(tb, TIMES):
            return micros(a) - micros(b)
        if op == "+" and isinstance(tb, TIMES):
            a, b = b, a
        if op in ("+", "-"):
            return from_micros(micros(a) + b if op == "+" else micros(a) - b)
        raise QueryError(f"{op} of timestamps")

    def _call(self, e: ast.Call, rows: Rows) -> Column:
        name, args = e.name, e.args
        if len(args) == 1 and isinstance(args[0], ast.Star):
            if name != "count":
                raise QueryError(f"{name}(*)")
            return F.count(F.lit(1))
        bound = rows.scope.get(args[0].name) if args and isinstance(args[0], ast.Var) else None
        special = self.entity_call(name, bound)
        if special is not None:
            return special
        if name in ("valid_time", "transaction_time") and not args:
            return self.bound_time("valid" if name == "valid_time" else "system")
        if name == "duration" and len(args) == 1 and isinstance(args[0], ast.Lit):
            return F.lit(parse_duration(args[0].value)).cast("bigint")
        if name in ("timestamp", "datetime") and len(args) == 1 and isinstance(args[0], (ast.Lit, ast.Param)):
            return self.moment(args[0])
        if name in AGGREGATES:
            if isinstance(bound, (NodeVar, RelVar)):
                values = [F.col(bound.columns["id" if isinstance(bound, NodeVar) else "edge_id"])]
            else:
                values = [self.value(a, rows) for a in args]
            if e.distinct:
                return self.distinct_aggregate(name, values)
            if e in self.running:
                total, place = self.running[e]
                return F.coalesce(F.max_by(total, place), F.lit(0.0))
            if name == "sum" and isinstance(self.type_of(values[0], rows), (T.DoubleType, T.FloatType)):
                return F.coalesce(F.sum(values[0]), F.lit(0.0))
            return AGGREGATES[name](*values)
        if name in self.functions:
            values = [self.value(a, rows) for a in args]
            if name in ("size", "length") and isinstance(self.type_of(values[0], rows), T.ArrayType):
                return F.size(values[0])
            if name == "coalesce":
                return F.coalesce(*values)
            return self.functions[name](*values)
        raise QueryError(f"unknown function {name}")

    def _windowed(self, e: ast.Windowed, rows: Rows) -> Column:
        if not has_aggregate(e.of):
            raise QueryError("WINDOW needs an aggregate before it")
        return self.value(e.of, rows)

    def bound_time(self, axis: str) -> Column:
        """The moment that an AS OF before the query names on this axis; without one, now."""
        t = self.prefix
        return self.moment(t.args[0]) if t is not None and t.kind == "as_of" and t.axis == axis else SCALARS["now"]()

    def entity_call(self, name: str, bound: Any) -> Column | None:
        if isinstance(bound, NodeVar):
            if name == "id":
                return F.col(bound.columns["id"])
            if name == "labels":
                return F.array(F.col(bound.columns["label"]))
        if isinstance(bound, RelVar) and name in ("id", "type", "startnode", "endnode"):
            return F.col(bound.columns[{"id": "edge_id", "type": "type", "startnode": "src", "endnode": "dst"}[name]])
        if isinstance(bound, PathVar):
            if name == "length":
                total = F.lit(0)
                for kind, column in bound.hops:
                    total = total + (F.lit(1) if kind == "edge" else F.size(F.col(column)))
                return total
            if name in INTERVALS["valid"] and bound.valid:
                return F.col(bound.valid[INTERVALS["valid"].index(name)])
            if name == "nodes":
                return F.array(*[F.col(c) for c in bound.nodes])
            if name == "relationships":
                return F.concat(*[F.array(F.col(c)) if kind == "edge" else F.col(c) for kind, c in bound.hops])
        return None

    def distinct_aggregate(self, name: str, values: list[Column]) -> Column:
        if name == "count":
            return F.count_distinct(*values)
        if name == "sum":
            return F.coalesce(F.sum_distinct(values[0]), F.lit(0))
        if name == "collect":
            return F.array_sort(F.collect_set(values[0]))
        if name in ("min", "max", "temporal_count", "approx_count_distinct"):
            return AGGREGATES[name](*values)
        raise QueryError(f"{name}(DISTINCT ...)")


@dataclass(frozen=True)
class _Column:
    """A column made for sorting only."""

    name: str

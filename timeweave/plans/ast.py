"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    name: str


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    distinct: bool = False


@dataclass(frozen=True)
class Windowed:
    """An aggregate over event-time windows: its projection is grouped by them too."""

    of: Any
    length: str
    slide: str | None
    time: Any = None


@dataclass(frozen=True)
class Star:
    """The argument of count(*), or RETURN *."""


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    of: Any
    negated: bool


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple  # of (key, expression)


@dataclass(frozen=True)
class Case:
    of: Any
    whens: tuple
    default: Any


@dataclass(frozen=True)
class Exists:
    """A pattern as a predicate."""

    pattern: Any


@dataclass(frozen=True)
class NodePat:
    var: str
    labels: tuple[str, ...]
    props: tuple  # of (key, expression)
    named: bool


@dataclass(frozen=True)
class RelPat:
    var: str
    types: tuple[str, ...]
    direction: str  # out, in, both
    hops: tuple[int, int | None] | None
    props: tuple
    named: bool


@dataclass(frozen=True)
class Pattern:
    parts: tuple  # node, rel, node, ...
    path: str | None = None


@dataclass(frozen=True)
class Temporal:
    """A time-travel modifier and its arguments (expressions)."""

    kind: str  # as_of, between, contained_in, all_versions, version, first, last, prev, next, overlaps
    args: tuple = ()
    axis: str = "valid"


@dataclass
class Match:
    patterns: list[Pattern]
    optional: bool = False
    where: Any = None
    temporal: Temporal | None = None
    semantics: str | None = None  # of a path's intervals: snapshot, continuous, pairwise, sequential


@dataclass
class Item:
    expr: Any
    alias: str


@dataclass
class Project:
    """WITH or RETURN."""

    items: list[Item]
    distinct: bool = False
    star: bool = False
    order: list[tuple[Any, bool]] = field(default_factory=list)
    skip: Any = None
    limit: Any = None
    where: Any = None
    final: bool = False


@dataclass
class Unwind:
    expr: Any
    alias: str


@dataclass
class Subquery:
    query: Query


@dataclass
class Create:
    patterns: list[Pattern]


@dataclass
class Merge:
    pattern: Pattern


@dataclass
class SetProps:
    items: list[tuple[str, str, Any]]  # variable, property, expression


@dataclass
class Delete:
    variables: list[str]
    detach: bool = False


@dataclass
class Show:
    what: str
    space: str | None = None


@dataclass
class Use:
    space: str


@dataclass
class Alter:
    kind: str  # TAG or EDGE
    name: str
    action: str  # ADD, DROP, RENAME, MODIFY
    prop: str
    detail: str | None = None


@dataclass
class Query:
    clauses: list
    temporal: Temporal | None = None
    unions: list[tuple[bool, Query]] = field(default_factory=list)  # (all?, next)
    explain: str | None = None  # EXPLAIN or PROFILE

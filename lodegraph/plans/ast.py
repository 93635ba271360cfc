"""Cypher as data: expressions, patterns, clauses."""

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
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Case:
    subject: Any
    branches: tuple
    otherwise: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple  # (key, expression)


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class Slice:
    of: Any
    begin: Any
    end: Any


@dataclass(frozen=True)
class Comprehension:
    var: str
    source: Any
    where: Any
    result: Any


@dataclass(frozen=True)
class Reduce:
    acc: str
    start: Any
    var: str
    source: Any
    step: Any


@dataclass(frozen=True)
class Quantified:
    kind: str  # all, any, none, single
    var: str
    source: Any
    where: Any


@dataclass(frozen=True)
class NodePattern:
    var: str
    labels: tuple = ()
    props: tuple = ()
    named: bool = True


@dataclass(frozen=True)
class RelPattern:
    var: str
    types: tuple = ()
    direction: str = "out"  # out, in, both
    props: tuple = ()
    least: int | None = None  # None: one hop
    most: int | None = None  # with least: None is without end
    named: bool = True


@dataclass(frozen=True)
class PathPattern:
    nodes: tuple
    rels: tuple
    var: str | None = None
    shortest: str | None = None  # one, all


@dataclass(frozen=True)
class Exists:
    paths: tuple
    where: Any = None


@dataclass(frozen=True)
class PatternList:
    path: PathPattern
    where: Any
    result: Any


@dataclass
class Match:
    paths: list
    where: Any = None
    optional: bool = False


@dataclass
class Item:
    expr: Any
    alias: str


@dataclass
class Projection:
    items: list
    star: bool = False
    distinct: bool = False
    order: list = field(default_factory=list)  # (expression, ascending)
    skip: Any = None
    limit: Any = None
    where: Any = None
    final: bool = False


@dataclass
class Unwind:
    expr: Any
    alias: str


@dataclass
class Create:
    paths: list


@dataclass
class Merge:
    node: NodePattern
    on_create: list = field(default_factory=list)
    on_match: list = field(default_factory=list)


@dataclass
class SetProps:
    items: list  # (variable, property, expression)


@dataclass
class Remove:
    items: list  # (variable, property)


@dataclass
class Delete:
    names: list
    detach: bool


@dataclass
class Foreach:
    var: str
    source: Any
    body: list


@dataclass
class Query:
    parts: list  # lists of clauses
    all: list  # for each further part: UNION ALL?
    explain: bool = False


def children(x: Any) -> list:
    """The expressions and patterns right within x."""
    out: list = []

    def add(v: Any) -> None:
        if isinstance(v, (tuple, list)):
            for y in v:
                add(y)
        elif hasattr(v, "__dataclass_fields__"):
            out.append(v)

    for name in getattr(x, "__dataclass_fields__", ()):
        add(getattr(x, name))
    return out


def walk(x: Any):
    yield x
    for y in children(x):
        yield from walk(y)

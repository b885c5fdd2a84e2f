"""Nodes of the query algebra. Variables are strings that start with `?`; other terms are canonical N-Triples; a quoted triple with variables is a Quoted."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Quoted:
    s: Any
    p: Any
    o: Any


@dataclass(frozen=True)
class Triple:
    s: Any
    p: Any
    o: Any


# paths
@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Inv:
    path: Any


@dataclass(frozen=True)
class Rep:
    path: Any
    least: int  # 0 or 1
    many: bool


@dataclass(frozen=True)
class Neg:
    forward: tuple
    backward: tuple


# patterns
@dataclass
class BGP:
    triples: list


@dataclass
class Join:
    left: Any
    right: Any


@dataclass
class LeftJoin:
    left: Any
    right: Any
    condition: Any = None


@dataclass
class Union:
    left: Any
    right: Any


@dataclass
class Minus:
    left: Any
    right: Any


@dataclass
class Filter:
    node: Any
    condition: Any


@dataclass
class Extend:
    node: Any
    var: str
    value: Any


@dataclass
class Values:
    vars: list
    rows: list


@dataclass
class Graph:
    name: str
    node: Any


@dataclass
class Unit:
    """The empty pattern: one solution without bindings."""


@dataclass
class Select:
    where: Any
    projection: list | None = None  # [(var, expression or None)], None for *
    distinct: bool = False
    group: list = field(default_factory=list)  # [(var or None, expression)]
    grouped: bool = False
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # [(expression, descending)]
    limit: int | None = None
    offset: int = 0


@dataclass
class Query:
    form: str  # select, ask, construct, describe
    select: Select
    template: list = field(default_factory=list)
    default_graphs: list = field(default_factory=list)
    named_graphs: list = field(default_factory=list)


@dataclass
class Update:
    """One operation: insert_data, delete_data, modify, clear, drop, create, load, copy, move, add."""

    kind: str
    insert: list = field(default_factory=list)  # [(graph or None, Triple)]
    delete: list = field(default_factory=list)
    where: Any = None
    with_graph: str | None = None
    using: list = field(default_factory=list)
    using_named: list = field(default_factory=list)
    target: str | None = None  # graph IRI, DEFAULT, NAMED or ALL
    source: str | None = None
    silent: bool = False


def is_var(term: Any) -> bool:
    return isinstance(term, str) and term.startswith("?")


def variables(node: Any) -> list[str]:
    """Variables that a pattern can bind, in order of appearance."""
    out: dict[str, None] = {}

    def term(t):
        if is_var(t):
            out[t] = None
        elif isinstance(t, Quoted):
            for x in (t.s, t.p, t.o):
                term(x)

    def walk(n):
        if isinstance(n, BGP):
            for t in n.triples:
                for x in (t.s, t.p, t.o):
                    term(x)
        elif isinstance(n, (Join, LeftJoin, Union)):
            walk(n.left)
            walk(n.right)
        elif isinstance(n, Minus):
            walk(n.left)
        elif isinstance(n, Filter):
            walk(n.node)
        elif isinstance(n, Extend):
            walk(n.node)
            term(n.var)
        elif isinstance(n, Values):
            for v in n.vars:
                term(v)
        elif isinstance(n, Graph):
            term(n.name)
            walk(n.node)
        elif isinstance(n, Select):
            if n.projection is None:
                walk(n.where)
            else:
                for v, _ in n.projection:
                    term(v)

    walk(node)
    return [v for v in out if not v.startswith("?_:")]

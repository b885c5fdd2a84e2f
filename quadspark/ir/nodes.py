"""The nodes of a program: a flat list that starts with Find."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Find:
    type: str
    scope: Any = None  # accepted, not used


@dataclass(frozen=True)
class Filter:
    field: str
    op: str  # eq neq lt lte gt gte
    value: Any


@dataclass(frozen=True)
class FilterRange:
    field: str
    min: Any
    max: Any
    inclusive: bool = True


@dataclass(frozen=True)
class FilterIn:
    field: str
    values: tuple

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(self.values))


@dataclass(frozen=True)
class Sort:
    field: str
    dir: str = "asc"  # anything but desc is asc


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Offset:
    n: int


@dataclass(frozen=True)
class Project:
    fields: tuple

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))


@dataclass(frozen=True)
class Count:
    pass


@dataclass(frozen=True)
class Compare:
    left: Any
    right: Any
    field: str


NODES = (Find, Filter, FilterRange, FilterIn, Sort, Limit, Offset, Project, Count, Compare)
OPS = {"eq": "=", "neq": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}


def find(ir: list, kind: type) -> Any:
    return next((n for n in ir if isinstance(n, kind)), None)


def all_of(ir: list, kind: type) -> list:
    return [n for n in ir if isinstance(n, kind)]

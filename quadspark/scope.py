"""Scopes: which graphs play which role."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any, ClassVar

from . import reasons as R


@dataclass(frozen=True)
class Scope:
    data: str
    schema: str | None = None
    shapes: str | None = None
    inferred: str | None = None
    report: str | None = None
    additional: Any = field(default_factory=dict)

    READ_ROLES: ClassVar[tuple] = ("data", "schema", "shapes")
    WRITE_ROLES: ClassVar[tuple] = ("inferred", "report")
    _known: ClassVar[list] = []

    def __post_init__(self):
        object.__setattr__(self, "additional", MappingProxyType(dict(self.additional)))

    def __eq__(self, other):
        return isinstance(other, Scope) and self._key() == other._key()

    def __hash__(self):
        return hash(self._key())

    def _key(self):
        return (self.data, self.schema, self.shapes, self.inferred, self.report, tuple(sorted((str(k), str(v)) for k, v in self.additional.items())))

    @classmethod
    def from_graph(cls, iri: str) -> Scope:
        return cls(data=iri)

    @classmethod
    def register(cls, scope: Scope) -> Scope:
        if scope not in cls._known:
            cls._known.append(scope)
        return scope

    @classmethod
    def find_by_data(cls, iri: str) -> Scope | None:
        return next((s for s in cls._known if s.data == iri), None)

    @property
    def read_graphs(self) -> set[str]:
        return {g for r in self.READ_ROLES if (g := getattr(self, r))}

    @property
    def write_graphs(self) -> set[str]:
        return {g for r in self.WRITE_ROLES if (g := getattr(self, r))}

    def read_write_overlap(self) -> bool:
        return bool(self.read_graphs & self.write_graphs)


def resolve(scope: Scope | None, kwargs: dict, mapping: dict[str, str], required: tuple = ()) -> dict:
    """{"kwargs": ...} with the scope's roles filled in, or a refusal; conflicts come first, then overlaps, then missing roles."""
    given = {k: v for k, v in kwargs.items() if v is not None}
    if scope is None:
        return {"kwargs": given}
    if not isinstance(scope, Scope):
        return R.refused(R.SCOPE_KWARG_CONFLICT, f"scope must be a Scope, got {type(scope).__name__}")
    clash = [name for name in mapping.values() if name in given]
    if clash:
        return R.refused(R.SCOPE_KWARG_CONFLICT, f"scope was given together with {clash}")
    if scope.read_write_overlap():
        return R.refused(R.SCOPE_READ_WRITE_OVERLAP, f"graphs with read and write roles: {sorted(scope.read_graphs & scope.write_graphs)}")
    missing = [r for r in required if not getattr(scope, r)]
    if missing:
        return R.refused(R.SCOPE_ROLE_MISSING, f"the scope lacks roles: {missing}")
    return {"kwargs": given | {name: v for role, name in mapping.items() if (v := getattr(scope, role))}}

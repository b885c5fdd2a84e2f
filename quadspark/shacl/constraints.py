"""SHACL Core constraint components as aggregates over the value nodes of a focus node."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import SH


@dataclass(frozen=True)
class Constraint:
    """measure(value node, parameter) is an aggregate (null nodes stand for no value); violated and message look at its result.

    `parameter` is the parameter's IRI; the parameter's value is a term, or a list of terms for sh:in.
    """

    iri: str
    name: str
    parameter: str
    measure: Callable[[Column, Any], Column]
    violated: Callable[[Column, Any], Column]
    message: Callable[[Column, Any], Column]


class ConstraintLibrary:
    def __init__(self, constraints=()):
        self.constraints = tuple(constraints)
        self._iri = {c.iri: c for c in self.constraints}
        self._parameter = {c.parameter: c for c in self.constraints}

    def __iter__(self) -> Iterator[Constraint]:
        return iter(self.constraints)

    def __len__(self) -> int:
        return len(self.constraints)

    def __getitem__(self, iri: str) -> Constraint | None:
        return self._iri.get(iri)

    def by_parameter(self, iri: str) -> Constraint | None:
        return self._parameter.get(iri)

    def __add__(self, other: ConstraintLibrary) -> ConstraintLibrary:
        return ConstraintLibrary(self.constraints + other.constraints)


def whole(term: str) -> int:
    """The integer a term starts with, else 0."""
    import re

    m = re.match(r"\s*([+-]?\d+)", T.lexical(term) or "")
    return int(m.group(1)) if m else 0


def real(term: str) -> float:
    import re

    m = re.match(r"\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", T.lexical(term) or "")
    return float(m.group(1)) if m else 0.0


def _real(node: Column) -> Column:
    return F.coalesce(F.regexp_extract(T.c_raw(node), r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def _count(kind: str, name: str, param: str, bad, text) -> Constraint:
    return Constraint(SH + kind + "ConstraintComponent", f"sh:{param}", SH + param, lambda o, p: F.count(o), bad, text)


def _each(kind: str, param: str, good: Callable[[Column, Any], Column], text: Callable[[Any], str]) -> Constraint:
    """Violated if any value node is not good; nodes the test does not apply to are not good."""
    measure = lambda o, p: F.sum(F.when(o.isNotNull() & ~F.coalesce(good(o, p), F.lit(False)), 1).otherwise(0))
    return Constraint(SH + kind + "ConstraintComponent", f"sh:{param}", SH + param, measure, lambda m, p: m > 0, lambda m, p: F.lit(text(p)))


def _kind(o: Column, p: str) -> Column:
    kind = T.lexical(p)
    tests = {SH + "IRI": T.is_iri, SH + "Literal": T.is_literal, SH + "BlankNode": T.is_blank}
    return tests[kind](o) if kind in tests else F.lit(True)


def _length(o: Column) -> Column:
    return F.when(T.is_literal(o), F.length(T.c_raw(o)))


def _offending_types(o: Column, p: str) -> Column:
    kind = F.coalesce(T.c_datatype(o), F.lit("IRI/BlankNode"))
    return F.sort_array(F.collect_set(F.when(o.isNotNull() & (kind != T.lexical(p)), kind)))


def in_range(param: str, test) -> Constraint:
    kind = param[0].upper() + param[1:]
    return _each(kind, param, lambda o, p: T.is_literal(o) & test(_real(o), real(p)), lambda p: f"expected sh:{param} {real(p)}; some values are out of range")


CORE = ConstraintLibrary(
    [
        _count("MinCount", "sh:minCount", "minCount", lambda m, p: m < whole(p), lambda m, p: F.concat(F.lit(f"expected at least {whole(p)} value(s); got "), m.cast("string"))),
        _count("MaxCount", "sh:maxCount", "maxCount", lambda m, p: m > whole(p), lambda m, p: F.concat(F.lit(f"expected at most {whole(p)} value(s); got "), m.cast("string"))),
        Constraint(
            SH + "DatatypeConstraintComponent",
            "sh:datatype",
            SH + "datatype",
            _offending_types,
            lambda m, p: F.size(m) > 0,
            lambda m, p: F.concat(F.lit(f"expected sh:datatype <{T.lexical(p)}>; got "), F.array_join(m, ", ")),
        ),
        _each("NodeKind", "nodeKind", _kind, lambda p: f"expected sh:nodeKind {p}; some values are of another kind"),
        # whether a node has the class is joined in as a column of its own (see the validator)
        _each("Class", "class", lambda o, p: F.col(class_flag(p)), lambda p: f"expected sh:class {p}; some values lack the type"),
        _each("Pattern", "pattern", lambda o, p: T.is_literal(o) & T.c_raw(o).rlike("(?m)" + (T.parse_plain(p) or "")), lambda p: f"expected sh:pattern {T.lexical(p)}; some values do not match"),
        _each("MinLength", "minLength", lambda o, p: _length(o) >= whole(p), lambda p: f"expected sh:minLength {whole(p)}; some values are shorter"),
        _each("MaxLength", "maxLength", lambda o, p: _length(o) <= whole(p), lambda p: f"expected sh:maxLength {whole(p)}; some values are longer"),
        Constraint(
            SH + "HasValueConstraintComponent",
            "sh:hasValue",
            SH + "hasValue",
            lambda o, p: F.coalesce(F.max(o == F.lit(p)), F.lit(False)),
            lambda m, p: ~m,
            lambda m, p: F.lit(f"expected sh:hasValue {p} among values"),
        ),
        _each("In", "in", lambda o, p: o.isin(list(p)), lambda p: f"expected sh:in {list(p)}; some values are not in the set"),
        in_range("minInclusive", lambda x, y: x >= y),
        in_range("maxInclusive", lambda x, y: x <= y),
        in_range("minExclusive", lambda x, y: x > y),
        in_range("maxExclusive", lambda x, y: x < y),
    ]
)

#: Parameters that are known but refused.
PENDING = tuple(SH + p for p in "not and or xone node closed ignoredProperties equals disjoint lessThan lessThanOrEquals languageIn uniqueLang qualifiedValueShape qualifiedMinCount qualifiedMaxCount".split())


def class_flag(term: str) -> str:
    import hashlib

    return "class_" + hashlib.md5(term.encode()).hexdigest()[:12]

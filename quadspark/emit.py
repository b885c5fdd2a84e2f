"""Mapping of table rows to triples, with read-replace semantics on save.

A Mapping names a subject, triples, further subjects, collections and annotations; values are
constants or functions of the DataFrame that give Columns. Saving replaces the values of every
(subject, predicate, graph) slot that the batch touches; a null value retracts
its slot; a false guard leaves the slot as it is.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import reasons as R
from .config import ENV_STRICT
from .functions import terms as T
from .graph import Graph, guarded
from .store import minus, pin

Value = Any  # a constant, a Column, or a function of the DataFrame that gives a Column


@dataclass
class Annotation:
    predicate: Value
    value: Value
    guard: Callable[[DataFrame], Column] | None = None


@dataclass
class Triple:
    predicate: Value
    value: Value
    guard: Callable[[DataFrame], Column] | None = None
    iri: bool = False  # the value is an IRI's text
    annotations: list[Annotation] = field(default_factory=list)

    def annotate(self, predicate: Value, value: Value, guard=None) -> Triple:
        self.annotations.append(Annotation(predicate, value, guard))
        return self


@dataclass
class Each:
    """One triple per element of an array column; predicate and value are functions of the element."""

    items: Value
    predicate: Value
    value: Callable[[Column], Column] = lambda item: item
    guard: Callable[[DataFrame], Column] | None = None
    iri: bool = False


@dataclass
class OnSubject:
    subject: Value
    triples: list = field(default_factory=list)
    graph: Value = None


@dataclass
class Mapping:
    subject: Value
    triples: list = field(default_factory=list)
    on_subject: list[OnSubject] = field(default_factory=list)
    each: list[Each] = field(default_factory=list)
    graph: Value = None

    def __post_init__(self):
        if self.subject is None:
            raise ValueError("a mapping needs a subject")


def _col(df: DataFrame, value: Value) -> Column:
    found = value(df) if callable(value) and not isinstance(value, Column) else value
    return found if isinstance(found, Column) else F.lit(found)


def _iri(df: DataFrame, value: Value) -> Column:
    c = _col(df, value).cast("string")
    return F.when(c.startswith("<") | c.startswith("_:"), c).otherwise(T.c_iri(c))


def _object(df: DataFrame, value: Value, iri: bool) -> Column:
    c = _col(df, value)
    if iri:
        return _iri(df, c)
    kind = df.select(c.alias("x")).schema[0].dataType.simpleString()
    if kind == "void":
        return F.lit(None).cast("string")
    if kind == "string":
        # bracketed text is an IRI or a quoted triple already
        return F.when(c.startswith("<") & c.endswith(">"), c).otherwise(T.c_plain(c))
    return T.c_literal(c, kind)


def _guard(df: DataFrame, guard) -> Column:
    return F.lit(True) if guard is None else F.coalesce(guard(df), F.lit(False))


def slots(df: DataFrame, mapping: Mapping) -> DataFrame:
    """(s, p, o, g) of all touched slots; o is null where the slot is retracted."""
    parts = []

    def one(subject: Value, graph: Value, triples: list):
        s = _iri(df, subject)
        g = F.lit(None).cast("string") if graph is None else F.regexp_replace(_col(df, graph).cast("string"), "^<|>$", "")
        for t in triples:
            if isinstance(t, Each):
                items = df.where(_guard(df, t.guard)).select(s.alias("s__"), g.alias("g__"), F.explode(_col(df, t.items)).alias("item"), "*")
                p = t.predicate(F.col("item")) if callable(t.predicate) else t.predicate
                parts.append(items.select(F.col("s__").alias("s"), _iri(items, p).alias("p"), _object(items, t.value(F.col("item")), t.iri).alias("o"), F.col("g__").alias("g")))
                continue
            rows = df.where(_guard(df, t.guard))
            p, o = _iri(df, t.predicate), _object(df, t.value, t.iri)
            parts.append(rows.select(s.alias("s"), p.alias("p"), o.alias("o"), g.alias("g")))
            for a in t.annotations:
                quoted = F.concat_ws(" ", F.lit("<<"), s, p, o, F.lit(">>"))
                noted = rows.where(o.isNotNull() & _guard(df, a.guard))
                parts.append(noted.select(quoted.alias("s"), _iri(df, a.predicate).alias("p"), _object(df, a.value, False).alias("o"), g.alias("g")))

    one(mapping.subject, mapping.graph, [*mapping.triples, *mapping.each])
    for other in mapping.on_subject:
        one(other.subject, other.graph if other.graph is not None else mapping.graph, other.triples)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quads(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Lazy quads of a mapping, not distinct."""
    return slots(df, mapping).where(F.col("o").isNotNull())


def _same_slot(a: str = "a", b: str = "b") -> Column:
    return (F.col(f"{a}.s") == F.col(f"{b}.s")) & (F.col(f"{a}.p") == F.col(f"{b}.p")) & F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))


#: Ways to send a save in the original design; here all of them are one set-based write.
DISPATCH_MODES = ("sparql_update", "bulk", "per_call")


class Refused(RuntimeError):
    """A refused write in strict mode."""


def strict(f):
    """In strict mode (environment variable of config.ENV_STRICT), a refusal is raised."""

    @functools.wraps(f)
    def call(*args, **kwargs):
        env = f(*args, **kwargs)
        if not env["ok"] and os.environ.get(ENV_STRICT, "").lower() in ("1", "true", "yes"):
            raise Refused(f"{env['reason']}: {env['because']}")
        return env

    return call


@strict
@guarded
def save(graph: Graph, df: DataFrame, mapping: Mapping, mode: str = "bulk") -> dict:
    """Replaces every touched slot's values; annotations of replaced triples go with them."""
    if mode not in DISPATCH_MODES:
        return R.refused(R.INVALID_DSL, f"mode is one of {DISPATCH_MODES}")
    touched = pin(slots(df, mapping))
    store = graph.store
    with store.lock:
        keys = touched.select("s", "p", "g").distinct()
        old = pin(store.quads.alias("a").join(keys.alias("b"), _same_slot(), "left_semi"))
        new = touched.where(F.col("o").isNotNull()).distinct()
        gone = pin(minus(old, new))
        stale = _annotations(store.quads, gone)
        n = store.change(gone.unionByName(stale), new)
    return {"ok": True, "count": n}


def _annotations(all_quads: DataFrame, triples: DataFrame) -> DataFrame:
    """Quads whose subject quotes one of the triples."""
    quoted = triples.select(F.concat_ws(" ", F.lit("<<"), "s", "p", "o", F.lit(">>")).alias("term")).distinct()
    return all_quads.join(quoted, F.col("s") == F.col("term"), "left_semi")


@strict
@guarded
def destroy(graph: Graph, df: DataFrame, mapping: Mapping) -> dict:
    """Retracts all declared slots of the rows, guards or not, and annotations of what goes."""
    keys = _declared(df, mapping)
    store = graph.store
    with store.lock:
        gone = pin(store.quads.alias("a").join(keys.distinct().alias("b"), _same_slot(), "left_semi"))
        stale = pin(_annotations(store.quads, gone))
        n = store.delete(gone.unionByName(stale))
    return {"ok": True, "count": n}


def _declared(df: DataFrame, mapping: Mapping) -> DataFrame:
    open_guards = Mapping(mapping.subject, [_open(t) for t in mapping.triples], [OnSubject(o.subject, [_open(t) for t in o.triples], o.graph) for o in mapping.on_subject], [_open(e) for e in mapping.each], mapping.graph)
    return slots(df, open_guards).select("s", "p", "g")


def _open(t):
    return Each(t.items, t.predicate, t.value, None, t.iri) if isinstance(t, Each) else Triple(t.predicate, t.value, None, t.iri)



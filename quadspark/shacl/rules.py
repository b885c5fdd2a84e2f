"""SHACL rules: triple rules and SPARQL rules fired to a fixpoint. A rule runs once over all its focus nodes, by a join with them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import reasons as R
from ..functions import terms as T
from ..functions.terms import SH
from ..graph import Graph, guarded, instantiate
from ..operators.patterns import Compiler, Dataset, Solutions, column
from ..plans import algebra as A
from ..plans.parser import PREFIXES, ParseError, parse_query
from ..scope import resolve
from ..store import bare, pin
from .constraints import CORE, whole
from .validator import Shapes, check, targets

MAX_ITERATIONS = 50
THIS = "?this"
_SCOPE = {"data": "data_graph", "shapes": "shapes_graph", "inferred": "inferred"}


@dataclass(frozen=True)
class Rule:
    iri: str
    shape: str
    order: int = 0
    conditions: tuple = ()
    deactivated: bool = False
    description: str | None = None
    body: Any = None  # TripleRule or SparqlRule


@dataclass(frozen=True)
class TripleRule:
    subject: str
    predicate: str
    object: str


@dataclass(frozen=True)
class SparqlRule:
    construct: str


def discover(shapes: Shapes) -> list[Rule] | dict:
    """All rules of a shapes graph by (order, IRI), or a refusal if one has an unknown type. Incomplete rules are skipped."""
    out = []
    for shape in sorted(shapes.by):
        for node in shapes.objects(shape, SH + "rule"):
            kinds = shapes.objects(node, T.RDF + "type")
            get = lambda p: shapes.first(node, SH + p)  # noqa: B023,E731
            body: Any = None
            if f"<{SH}TripleRule>" in kinds:
                s, p, o = get("subject"), get("predicate"), get("object")
                if s and p and o:
                    body = TripleRule(s, p, o)
            elif f"<{SH}SPARQLRule>" in kinds:
                text = get("construct")
                if text:
                    body = SparqlRule(T.parse_plain(text))
            else:
                return R.refused(R.UNKNOWN_RULE_TYPE, f"rule {node} has no supported type")
            if body is None:
                continue
            off = get("deactivated")
            out.append(Rule(node, shape, whole(get("order") or '"0"'), tuple(shapes.objects(node, SH + "condition")), off is not None and T.parse_plain(off) in (True, "true"), get("description") or shapes.first(node, T.RDFS + "comment"), body))
    return sorted(out, key=lambda r: (r.order, r.iri))


def _resolved(term: str, literal: bool) -> str | None:
    if term == f"<{SH}this>":
        return THIS
    return term if term.startswith("<") or literal and term.startswith('"') else None


class _Run:
    def __init__(self, graph: Graph, data_graph, shapes: Shapes, inferred):
        self.graph, self.data, self.shapes, self.inferred = graph, data_graph, shapes, inferred
        self.foci: dict[str, DataFrame] = {}

    def focus(self, rule: Rule) -> DataFrame:
        """Focus nodes that meet the rule's conditions, in the data graph as it was when first asked for."""
        key = rule.iri + rule.shape
        if key not in self.foci:
            foci = targets(self.graph, self.data, self.shapes, rule.shape)
            for c in rule.conditions:
                ps = self.shapes.property_shapes(c, CORE)
                if any(p.pending for p in ps):
                    foci = foci.where(F.lit(False))  # a condition that cannot be checked does not hold
                    break
                bad = check(self.graph, self.data, [(p, foci) for p in ps], CORE)
                foci = foci.join(bad.select(F.col("focus_node").alias("b")).distinct(), F.col("focus") == F.col("b"), "left_anti")
            self.foci[key] = pin(foci)
        return self.foci[key]

    def heads(self, rule: Rule) -> DataFrame | None:
        this = Solutions(self.focus(rule).select(F.col("focus").alias(column(THIS))), {THIS: True})
        if isinstance(rule.body, TripleRule):
            s, p, o = _resolved(rule.body.subject, False), _resolved(rule.body.predicate, False), _resolved(rule.body.object, True)
            if s is None or p is None or o is None:
                return None
            return instantiate(this, [(None, A.Triple(s, p, o))], self.inferred)
        q = parse_query(rule.body.construct, PREFIXES)
        if q.form != "construct":
            raise ParseError("a rule is a CONSTRUCT query")
        compiler = Compiler(self.graph.store, Dataset((self.data, self.inferred)))
        found = compiler.compile(q.select.where)
        return instantiate(compiler.join(this, found), q.template, self.inferred)


@guarded
def materialise(graph: Graph, data_graph: str | None = None, shapes_graph: str | None = None, inferred: str | None = None, scope=None, rules: Any = "all", max_iterations: int = MAX_ITERATIONS, provenance: bool = False) -> dict:
    """{ok, iterations, rules_fired, derived, per_rule, fixpoint}; rules: "all" or a list of rule IRIs."""
    found = resolve(scope, {"data_graph": data_graph, "shapes_graph": shapes_graph, "inferred": inferred}, _SCOPE, ("data", "shapes", "inferred"))
    if "kwargs" not in found:
        return found
    kw = found["kwargs"]
    data_graph, shapes_graph, inferred = (None if kw.get(k) is None else bare(kw[k]) for k in ("data_graph", "shapes_graph", "inferred"))
    if error := R.invalid_graph(data_graph, shapes_graph, inferred):
        return error
    shapes = Shapes(graph, shapes_graph)
    known = discover(shapes)
    if isinstance(known, dict):
        return known
    if rules != "all":
        chosen = {T.iri(r) for r in rules}
        known = [r for r in known if r.iri in chosen]
    known = [r for r in known if not r.deactivated]
    now = _Run(graph, data_graph, shapes, inferred)
    per_rule: dict[str, int] = {}
    warnings: list[str] = []
    derived = iterations = 0
    fixpoint = not known
    while not fixpoint and iterations < max_iterations:
        iterations += 1
        delta = 0
        for r in known:
            try:
                rows = now.heads(r)
            except ParseError as e:
                if iterations == 1:
                    warnings.append(f"{r.iri}: {e}")
                continue
            n = 0 if rows is None else graph.store.insert(rows)
            if n:
                per_rule[r.iri[1:-1] if r.iri.startswith("<") else r.iri] = per_rule.get(r.iri[1:-1] if r.iri.startswith("<") else r.iri, 0) + n
                delta += n
        derived += delta
        fixpoint = delta == 0
    out = {"iterations": iterations, "rules_fired": len(per_rule), "derived": derived, "per_rule": per_rule}
    if warnings:
        out["warnings"] = warnings
    if not fixpoint:
        return R.refused(R.REASONER_DIVERGED, f"no fixpoint after {iterations} iterations", **out)
    return {"ok": True, **out, "fixpoint": True}

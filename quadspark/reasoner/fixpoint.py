"""Fixpoint materialisation of rules over the store, with provenance and over-delete/re-derive maintenance.

Rules read asserted and inferred, and write inferred. In the sequential mode each
rule sees what earlier rules of the round derived; in the batched mode
all rules of a round see its start, which gives the same closure with fewer writes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import reasons as R
from ..functions import terms as T
from ..graph import Graph, guarded, instantiate
from ..operators.patterns import Compiler, Dataset
from ..plans import algebra as A
from ..plans.parser import ParseError
from ..scope import resolve
from ..store import MOST_PIECES, bare, in_graph, local_df, minus, pin, pinned
from .rules import RULE_SETS, Rule, RuleSet

DERIVED_BY = f"<{T.ENGINE}derivedBy>"
DERIVED_FROM = f"<{T.ENGINE}derivedFrom>"
MAX_ITERATIONS = 50
_SCOPE = {"data": "asserted", "inferred": "inferred"}


def rule_iri(rule_id: str) -> str:
    return f"<{T.ENGINE}reasoner:rule:{rule_id}>"


def _quoted(t: A.Triple) -> A.Quoted | str:
    if any(A.is_var(x) or isinstance(x, A.Quoted) for x in (t.s, t.p, t.o)):
        return A.Quoted(t.s, t.p, t.o)
    return f"<< {t.s} {t.p} {t.o} >>"


def template(rule: Rule, provenance: bool) -> list:
    """Heads of a rule, each with who derived it and from what."""
    out = []
    for _, head in rule.update.insert:
        out.append((None, head))
        if provenance:
            name = _quoted(head)
            out.append((None, A.Triple(name, DERIVED_BY, rule_iri(rule.id))))
            out += [(None, A.Triple(name, DERIVED_FROM, _quoted(p))) for p in rule.premises]
    return out


def _arguments(asserted, inferred, scope, rules):
    """(asserted, inferred, rule set), or a refusal."""
    found = resolve(scope, {"asserted": asserted, "inferred": inferred}, _SCOPE, ("data", "inferred"))
    if "kwargs" not in found:
        return found
    asserted, inferred = found["kwargs"].get("asserted"), found["kwargs"].get("inferred")
    if error := R.invalid_graph(asserted, inferred):
        return error
    if asserted == inferred:
        return R.refused(R.INVALID_DSL, "asserted and inferred must be different graphs")
    if isinstance(rules, str):
        if rules not in RULE_SETS:
            return R.refused(R.RULE_SET_UNKNOWN, f"unknown rule set {rules!r}")
        rules = RULE_SETS[rules]
    if not isinstance(rules, RuleSet):
        return R.refused(R.RULE_SET_UNKNOWN, "rules is the name of a rule set or a RuleSet")
    try:
        for r in rules:
            r.update
    except ParseError as e:
        return R.refused(R.INVALID_DSL, e)
    return None if asserted is None else bare(asserted), None if inferred is None else bare(inferred), rules


class _Run:
    def __init__(self, graph: Graph, asserted: str | None, inferred: str | None, provenance: bool):
        self.store, self.inferred, self.provenance = graph.store, inferred, provenance
        self.dataset = Dataset((asserted, inferred))
        self._present: set | None = None

    def can_fire(self, rule: Rule, rules: RuleSet) -> bool:
        """Whether the triggers of a rule are in the graphs; a rule without them derives nothing."""
        if self._present is None:
            needed = set().union(*(r.triggers() for r in rules)) if len(rules) else set()
            rows = Compiler(self.store, self.dataset).scan(None)
            predicates = sorted({p for p, _ in needed})
            classes = sorted({o for _, o in needed if o})
            here = rows.where(F.col("p").isin(predicates)).select("p", F.when((F.col("p") == T.TYPE) & F.col("o").isin(classes), F.col("o")).alias("o")).distinct()
            found = {(r["p"], r["o"]) for r in here.collect()}  # at most one row per trigger and type
            self._present = found | {(p, None) for p, _ in found}
        return rule.triggers() <= self._present

    def heads(self, rule: Rule) -> DataFrame:
        found = Compiler(self.store, self.dataset).compile(rule.update.where)
        return instantiate(found, template(rule, self.provenance), self.inferred)

    def insert(self, rows: DataFrame) -> int:
        n = self.store.insert(rows)
        if n:
            self._present = None
        return n


def run(graph: Graph, asserted, inferred, rules: RuleSet, provenance: bool, max_iterations: int, mode: str = "sequential") -> dict:
    now = _Run(graph, asserted, inferred, provenance)
    per_rule: dict[str, int] = {}
    derived = iterations = 0
    fixpoint = not len(rules)
    while not fixpoint and iterations < max_iterations:
        iterations += 1
        delta = 0
        firing = [r for r in rules if now.can_fire(r, rules)] if mode == "batched" else list(rules)
        if mode == "batched" and firing:
            tagged = None
            for r in firing:
                rows = now.heads(r).withColumn("rule", F.lit(r.id))
                tagged = rows if tagged is None else tagged.unionByName(rows)
            fresh = pin(minus(tagged.groupBy("s", "p", "o", "g").agg(F.min("rule").alias("rule")), in_graph(graph.store.quads, inferred)))
            for row in fresh.groupBy("rule").count().collect():
                per_rule[row["rule"]] = per_rule.get(row["rule"], 0) + row["count"]
            delta = now.insert(fresh.select("s", "p", "o", "g"))
        elif mode != "batched":
            for r in firing:
                if now.can_fire(r, rules):
                    n = now.insert(now.heads(r))
                    if n:
                        per_rule[r.id] = per_rule.get(r.id, 0) + n
                        delta += n
        derived += delta
        fixpoint = delta == 0
    if not fixpoint:
        return R.refused(R.REASONER_DIVERGED, f"no fixpoint after {iterations} iterations", iterations=iterations, derived=derived, per_rule=per_rule)
    return {"ok": True, "iterations": iterations, "derived": derived, "fixpoint": True, "per_rule": per_rule}


@guarded
def materialise(graph: Graph, asserted: str | None = None, inferred: str | None = None, scope=None, rules: str | RuleSet = "owl_2_rl", provenance: bool = True, max_iterations: int = MAX_ITERATIONS, mode: str = "sequential") -> dict:
    """Derives to a fixpoint. Counts include annotation quads; the last, empty iteration counts."""
    found = _arguments(asserted, inferred, scope, rules)
    if isinstance(found, dict):
        return found
    return run(graph, *found, provenance, max_iterations, mode)


def over_delete(graph: Graph, inferred: str | None, retracted) -> int:
    """Removes all that was derived, directly or not, from the retracted triples, with its annotations; returns the quads removed."""
    spark, store = graph.spark, graph.store
    if isinstance(retracted, DataFrame):
        start = retracted.select(F.concat_ws(" ", F.lit("<<"), "s", "p", "o", F.lit(">>")).alias("t")).distinct()
    else:
        rows = [(f"<< {T.subject(s)} {T.predicate(p)} {o if T.kind_of(o) != 'unknown' else T.object_(o)} >>",) for s, p, o, *_ in retracted]
        if not rows:
            return 0
        start = local_df(spark, rows, "t string").distinct()
    own = in_graph(store.quads, inferred)
    edges = own.where(F.col("p") == DERIVED_FROM).select(F.col("s").alias("head"), F.col("o").alias("premise"))
    start = frontier = pin(start)
    found: list[DataFrame] = []  # one table per round; rewritten together only when they are many
    while True:
        heads = edges.join(frontier, F.col("premise") == F.col("t"), "left_semi").select(F.col("head").alias("t")).distinct()
        frontier, n = pinned(heads.join(reduce(DataFrame.union, found, start), "t", "left_anti"))
        if not n:
            break
        found.append(frontier)
        if len(found) == MOST_PIECES:
            found = [pin(reduce(DataFrame.union, found))]
    if not found:
        return 0
    gone = reduce(DataFrame.union, found)
    doomed = gone.select(F.col("t").alias("term"))
    triples = own.withColumn("term", F.concat_ws(" ", F.lit("<<"), "s", "p", "o", F.lit(">>"))).join(doomed, "term", "left_semi").drop("term")
    notes = own.join(doomed, F.col("s") == F.col("term"), "left_semi")
    return store.delete(triples.select("s", "p", "o", "g").unionByName(notes))


@guarded
def materialise_incremental(graph: Graph, asserted: str | None = None, inferred: str | None = None, scope=None, changes=None, rules: str | RuleSet = "owl_2_rl", dependency_index: str = "sparql", provenance: bool = True, max_iterations: int = MAX_ITERATIONS, mode: str = "sequential") -> dict:
    """Maintains inferred after retractions and additions: over-deletes what depended on the retracted triples, then derives again."""
    found = _arguments(asserted, inferred, scope, rules)
    if isinstance(found, dict):
        return found
    asserted, inferred, rule_set = found
    if not hasattr(changes, "retracted") or not hasattr(changes, "scope"):
        return R.refused(R.INVALID_DSL, "changes is a change set")
    if changes.scope is not None and bare(changes.scope.data) != asserted:
        return R.refused(R.CHANGESET_SCOPE_MISMATCH, f"the change set is about {changes.scope.data!r}, not {asserted!r}")
    if dependency_index not in ("sparql", "native", "auto"):
        return R.refused(R.INVALID_DSL, "dependency_index is sparql, native or auto")
    frames = getattr(changes, "retracted_frames", None)
    deleted = over_delete(graph, inferred, changes.frame("retracted") if frames else changes.retracted)
    before = graph.store.size(inferred)
    again = run(graph, asserted, inferred, rule_set, provenance, max_iterations, mode)
    if not again["ok"]:
        return {**again, "over_deleted": deleted}
    return {
        "ok": True,
        "over_deleted": deleted,
        "over_deleted_via_index": 0,
        "over_deleted_via_sparql": deleted,
        "rederived": again["derived"],
        "net_derived": graph.store.size(inferred) - before,
        "iterations": again["iterations"],
        "fixpoint": again["fixpoint"],
        "index_dirty": dependency_index != "sparql",
        "per_rule": again["per_rule"],
    }


dred = materialise_incremental

"""Rules as SPARQL updates, and the OWL 2 RL rules of the standard's tables that are supported."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from ..functions import terms as T
from ..plans import algebra as A
from ..plans.parser import PREFIXES, ParseError, parse_update


@dataclass(frozen=True)
class Rule:
    id: str
    sparql: str
    name: str = ""
    description: str = ""

    @cached_property
    def update(self) -> A.Update:
        found = parse_update(self.sparql, PREFIXES)
        if len(found) != 1 or found[0].kind != "modify" or found[0].delete or not found[0].insert:
            raise ParseError(f"rule {self.id} is not of the form INSERT {{...}} WHERE {{...}}")
        return found[0]

    @cached_property
    def premises(self) -> list[A.Triple]:
        """Triple patterns of the body that every solution matches."""
        out: list[A.Triple] = []

        def walk(n):
            if isinstance(n, A.BGP):
                out.extend(t for t in n.triples if isinstance(t.p, str))
            elif isinstance(n, A.Join):
                walk(n.left)
                walk(n.right)
            elif isinstance(n, (A.Filter, A.Extend)):
                walk(n.node)
            elif isinstance(n, (A.LeftJoin, A.Minus)):
                walk(n.left)

        walk(self.update.where)
        return out

    def triggers(self) -> set[tuple[str, str | None]]:
        """Predicates, and classes after rdf:type, without which the body cannot match."""
        out = set()
        for t in self.premises:
            if not A.is_var(t.p):
                fixed = t.p == T.TYPE and isinstance(t.o, str) and not A.is_var(t.o)
                out.add((t.p, t.o if fixed else None))
        return out


@dataclass(frozen=True)
class RuleSet:
    rules: tuple = field(default_factory=tuple)
    name: str = "custom"

    def __init__(self, rules=(), name: str = "custom"):
        object.__setattr__(self, "rules", tuple(rules))
        object.__setattr__(self, "name", name)

    def __iter__(self) -> Iterator[Rule]:
        return iter(self.rules)

    def __len__(self) -> int:
        return len(self.rules)

    def __add__(self, other: RuleSet) -> RuleSet:
        return RuleSet(self.rules + other.rules, f"{self.name}+{other.name}")

    def __getitem__(self, rule_id: str) -> Rule:
        return next(r for r in self.rules if r.id == rule_id)

    def only(self, *ids: str) -> RuleSet:
        return RuleSet([r for r in self.rules if r.id in ids], self.name)


def _rule(rule_id: str, head: str, body: str, description: str) -> Rule:
    return Rule(rule_id, f"INSERT {{ {head} }} WHERE {{ {body} }}", rule_id, description)


#: Rules of the OWL 2 RL profile, with the standard's ids.
OWL_2_RL = RuleSet(
    [
        _rule("scm-sco", "?a rdfs:subClassOf ?c", "?a rdfs:subClassOf ?b . ?b rdfs:subClassOf ?c FILTER(?a != ?c)", "subclasses are transitive"),
        _rule("scm-spo", "?a rdfs:subPropertyOf ?c", "?a rdfs:subPropertyOf ?b . ?b rdfs:subPropertyOf ?c FILTER(?a != ?c)", "subproperties are transitive"),
        _rule("scm-eqc1", "?a rdfs:subClassOf ?b . ?b rdfs:subClassOf ?a", "?a owl:equivalentClass ?b", "equivalent classes are subclasses of each other"),
        _rule("scm-eqp1", "?a rdfs:subPropertyOf ?b . ?b rdfs:subPropertyOf ?a", "?a owl:equivalentProperty ?b", "equivalent properties are subproperties of each other"),
        _rule("cax-sco", "?x a ?b", "?a rdfs:subClassOf ?b . ?x a ?a FILTER(?a != ?b)", "instances belong to superclasses"),
        _rule("prp-spo1", "?x ?q ?y", "?p rdfs:subPropertyOf ?q . ?x ?p ?y FILTER(?p != ?q)", "a property implies its superproperties"),
        _rule("prp-dom", "?x a ?c", "?p rdfs:domain ?c . ?x ?p ?y", "subjects belong to the domain"),
        _rule("prp-rng", "?y a ?c", "?p rdfs:range ?c . ?x ?p ?y", "objects belong to the range"),
        _rule("prp-trp", "?x ?p ?z", "?p a owl:TransitiveProperty . ?x ?p ?y . ?y ?p ?z FILTER(?x != ?z)", "transitive properties"),
        _rule("prp-symp", "?y ?p ?x", "?p a owl:SymmetricProperty . ?x ?p ?y FILTER(?x != ?y)", "symmetric properties"),
        _rule("prp-inv1", "?y ?q ?x", "?p owl:inverseOf ?q . ?x ?p ?y", "inverse properties, forward"),
        _rule("prp-inv2", "?y ?p ?x", "?p owl:inverseOf ?q . ?x ?q ?y", "inverse properties, backward"),
        _rule("prp-fp", "?y owl:sameAs ?z", "?p a owl:FunctionalProperty . ?x ?p ?y . ?x ?p ?z FILTER(?y != ?z)", "values of a functional property are the same"),
        _rule("eq-sym", "?y owl:sameAs ?x", "?x owl:sameAs ?y FILTER(?x != ?y)", "sameness is symmetric"),
        _rule("eq-trans", "?x owl:sameAs ?z", "?x owl:sameAs ?y . ?y owl:sameAs ?z FILTER(?x != ?z)", "sameness is transitive"),
    ],
    "owl_2_rl",
)

#: Ids of the profile's rules that are known but not supported.
PENDING_RULES = tuple(
    """eq-ref eq-rep-s eq-rep-p eq-rep-o eq-diff1 eq-diff2 eq-diff3 prp-ap prp-ifp prp-irp prp-asyp prp-spo2 prp-eqp1 prp-eqp2 prp-pdw prp-adp
    prp-key prp-npa1 prp-npa2 cls-thing cls-nothing1 cls-nothing2 cls-int1 cls-int2 cls-uni cls-com cls-svf1 cls-svf2 cls-avf cls-hv1 cls-hv2
    cls-maxc1 cls-maxc2 cls-maxqc1 cls-maxqc2 cls-maxqc3 cls-maxqc4 cls-oo cax-eqc1 cax-eqc2 cax-dw cax-adc scm-cls scm-eqc2 scm-op scm-dp
    scm-eqp2 scm-dom1 scm-dom2 scm-rng1 scm-rng2""".split()
)
RULE_SETS = {"owl_2_rl": OWL_2_RL}

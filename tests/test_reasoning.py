"""Rules, provenance, incremental maintenance, shapes and shape rules on minimal fixtures."""

import pytest
from pyspark.sql import functions as F

from quadspark import changeset, reasoner, shacl
from quadspark.functions import terms as T
from quadspark.graph import Graph
from quadspark.reasoner import fixpoint
from quadspark.reasoner.fixpoint import DERIVED_BY, DERIVED_FROM
from quadspark.scope import Scope

P = f"PREFIX rdfs: <{T.RDFS}> PREFIX owl: <{T.OWL}> PREFIX : <urn:> "
A, I = "urn:asserted", "urn:inferred"


def graph(spark, text):
    g = Graph(spark)
    env = g.execute(P + f"INSERT DATA {{ GRAPH <{A}> {{ {text} }} }}")
    assert env["ok"], env
    return g


def inferred(g):
    short = lambda t: t.replace("<urn:", "").replace(">", "").replace(f"<{T.RDFS}", "").replace(f"<{T.OWL}", "").replace(f"<{T.RDF}", "")
    rows = g.store.quads.where((F.col("g") == I) & ~F.col("s").startswith("<<")).collect()
    return {tuple(short(x) for x in (r.s, r.p, r.o)) for r in rows}


@pytest.mark.parametrize(
    ("rule", "text", "want"),
    [
        ("scm-sco", ":A rdfs:subClassOf :B . :B rdfs:subClassOf :C", {("A", "subClassOf", "C")}),
        ("scm-spo", ":p rdfs:subPropertyOf :q . :q rdfs:subPropertyOf :r", {("p", "subPropertyOf", "r")}),
        ("scm-eqc1", ":A owl:equivalentClass :B", {("A", "subClassOf", "B"), ("B", "subClassOf", "A")}),
        ("scm-eqp1", ":p owl:equivalentProperty :q", {("p", "subPropertyOf", "q"), ("q", "subPropertyOf", "p")}),
        ("cax-sco", ":x a :D . :D rdfs:subClassOf :P", {("x", "type", "P")}),
        ("prp-spo1", ":x :f :y . :f rdfs:subPropertyOf :g", {("x", "g", "y")}),
        ("prp-dom", ":f rdfs:domain :P . :x :f :y", {("x", "type", "P")}),
        ("prp-rng", ':f rdfs:range :M . :x :f :y , "literal"', {("y", "type", "M")}),
        ("prp-trp", ":p a owl:TransitiveProperty . :f :p :h . :h :p :a", {("f", "p", "a")}),
        ("prp-symp", ":k a owl:SymmetricProperty . :a :k :b , 5", {("b", "k", "a"), ("a", "k", "b")}),
        ("prp-inv1", ":f owl:inverseOf :g . :a :f :b", {("b", "g", "a")}),
        ("prp-inv2", ":f owl:inverseOf :g . :c :g :d", {("d", "f", "c")}),
        ("prp-fp", ":h a owl:FunctionalProperty . :x :h :a , :b", {("a", "sameAs", "b"), ("b", "sameAs", "a")}),
        ("eq-sym", ":a owl:sameAs :b", {("b", "sameAs", "a"), ("a", "sameAs", "b")}),
        ("eq-trans", ":a owl:sameAs :b . :b owl:sameAs :c", {("a", "sameAs", "c")}),
    ],
)
def test_each_rule(spark, rule, text, want):
    g = graph(spark, text)
    env = reasoner.materialise(g, A, I, rules=reasoner.OWL_2_RL.only(rule), provenance=False)
    assert env["ok"] and env["fixpoint"] and set(env["per_rule"]) == {rule}
    assert inferred(g) == want and env["derived"] == len(want)


def test_provenance_and_idempotence(spark):
    g = graph(spark, ":A rdfs:subClassOf :B . :B rdfs:subClassOf :C")
    env = reasoner.materialise(g, A, I)
    assert (env["derived"], env["iterations"]) == (4, 2)
    notes = {p: g.store.quads.where(F.col("p") == p).collect() for p in (DERIVED_BY, DERIVED_FROM)}
    assert len(notes[DERIVED_BY]) == 1 and len(notes[DERIVED_FROM]) == 2
    assert notes[DERIVED_BY][0].o.endswith("rule:scm-sco>")
    assert reasoner.materialise(g, A, I)["derived"] == 0


def test_refusals_and_divergence(spark):
    g = graph(spark, " . ".join(f":C{i} rdfs:subClassOf :C{i + 1}" for i in range(5)))
    assert reasoner.materialise(g, A, A)["reason"] == "invalid_dsl"
    assert reasoner.materialise(g)["reason"] == "invalid_dsl"
    assert reasoner.materialise(g, A, "_:x")["reason"] == "invalid_graph"
    assert reasoner.materialise(g, A, I, rules="nope")["reason"] == "rule_set_unknown"
    assert reasoner.materialise(g, A, I, rules=reasoner.RuleSet([reasoner.Rule("x", "SELECT nonsense")]))["reason"] == "invalid_dsl"
    assert reasoner.materialise(g, A, I, rules=reasoner.RuleSet())["iterations"] == 0
    env = reasoner.materialise(g, A, I, max_iterations=1, provenance=False)
    assert (env["reason"], env["iterations"]) == ("reasoner_diverged", 1) and env["derived"] > 0
    assert reasoner.materialise(g, scope=Scope(A))["reason"] == "scope_role_missing"
    assert len(reasoner.OWL_2_RL) == 15 and len(reasoner.PENDING_RULES) == 51


def test_batched_mode_gives_the_same_closure(spark):
    text = ":A rdfs:subClassOf :B . :B rdfs:subClassOf :C . :x a :A . :k a owl:SymmetricProperty . :k rdfs:domain :A . :x :k :y"
    one, two = graph(spark, text), graph(spark, text)
    reasoner.materialise(one, A, I, provenance=False)
    reasoner.materialise(two, A, I, provenance=False, mode="batched")
    assert inferred(one) == inferred(two) and ("y", "type", "C") in inferred(one)


def test_incremental(spark):
    scope = Scope(A, inferred=I)
    g = graph(spark, ":A rdfs:subClassOf :B . :B rdfs:subClassOf :C . :x a :A . :y a :B")
    reasoner.materialise(g, scope=scope)
    with changeset.capture(scope) as changes:
        g.execute(P + "DELETE DATA { :A rdfs:subClassOf :B }", graph=A)
    env = reasoner.dred(g, scope=scope, changes=changes, dependency_index="native")
    assert env["ok"] and env["index_dirty"] and env["over_deleted"] == env["over_deleted_via_sparql"] > 0
    again = graph(spark, ":B rdfs:subClassOf :C . :x a :A . :y a :B")
    reasoner.materialise(again, scope=scope)
    assert inferred(g) == inferred(again) == {("y", "type", "C")}
    other = changeset.ChangeSet(Scope("urn:else"))
    assert reasoner.dred(g, scope=scope, changes=other)["reason"] == "changeset_scope_mismatch_for_reasoner"


@pytest.mark.parametrize("pieces", [16, 3])
def test_over_delete_follows_long_chains_and_cycles(spark, monkeypatch, pieces):
    monkeypatch.setattr(fixpoint, "MOST_PIECES", pieces)
    n = [(f"<urn:n{i}>", "<urn:p>", "<urn:o>") for i in range(9)]
    name = ["<< " + " ".join(t) + " >>" for t in n]
    notes = [(name[i + 1], DERIVED_FROM, name[i]) for i in range(7)] + [(name[1], DERIVED_FROM, name[7]), (name[3], DERIVED_FROM, name[0])]
    g = Graph(spark)
    g.store.insert(spark.createDataFrame([(*t, I) for t in n + notes], "s string, p string, o string, g string"))
    assert fixpoint.over_delete(g, I, [("urn:m", "urn:p", "<urn:o>")]) == 0
    assert fixpoint.over_delete(g, I, [("urn:n0", "urn:p", "<urn:o>")]) == 7 + len(notes)
    assert {r.s for r in g.store.quads.collect()} == {n[0][0], n[8][0]}


SH = f"@prefix sh: <{T.SH}> . @prefix : <urn:> . @prefix xsd: <{T.XSD}> . "


@pytest.mark.parametrize(
    ("constraint", "good", "bad", "message"),
    [
        ("sh:minCount 1", ':x :p "v"', ":x :q 1", "expected at least 1"),
        ("sh:maxCount 1", ":x :p 1", ":x :p 1 , 2", "expected at most 1"),
        ("sh:datatype xsd:integer", ":x :p 5", ':x :p 5 , "v"', "expected sh:datatype"),
        ("sh:nodeKind sh:IRI", ":x :p :y", ':x :p "v"', "expected sh:nodeKind"),
        ("sh:class :C", ":x :p :y . :y a :C", ":x :p :y", "expected sh:class"),
        ('sh:pattern "^a.c$"', ':x :p "abc"', ':x :p "xabc"', "expected sh:pattern"),
        ("sh:minLength 3", ':x :p "abc"', ':x :p "ab"', "expected sh:minLength"),
        ("sh:maxLength 3", ':x :p "abc"', ':x :p "abcd"', "expected sh:maxLength"),
        ("sh:minInclusive 3", ":x :p 3", ":x :p 2", "expected sh:minInclusive"),
        ("sh:maxInclusive 3", ":x :p 3", ":x :p 4", "expected sh:maxInclusive"),
        ("sh:minExclusive 3", ":x :p 4", ":x :p 3", "expected sh:minExclusive"),
        ('sh:hasValue "v"', ':x :p "v" , "w"', ':x :p "w"', "expected sh:hasValue"),
        ('sh:in "a" , "b"', ':x :p "a"', ':x :p "a" , "c"', "expected sh:in"),
        ('sh:in ( "a" "b" )', ':x :p "b"', ':x :p "c"', "expected sh:in"),
    ],
)
def test_each_constraint(spark, constraint, good, bad, message):
    for text, conforms in ((good, True), (bad, False)):
        g = Graph(spark)
        g.execute(P + f"INSERT DATA {{ :x a :T . {text} }}", graph="urn:d")
        assert shacl.load_shapes(g, SH + f":S a sh:NodeShape ; sh:targetClass :T ; sh:property [ sh:path :p ; {constraint} ] .\n", scope="urn:s")["ok"]
        env = shacl.validate(g, "urn:d", "urn:s")
        assert env["ok"] and env["conforms"] is conforms, env
        if not conforms:
            assert [v["focus_node"] for v in env["violations"]] == ["<urn:x>"] and env["violations"][0]["message"].startswith(message)
            assert env["report_graph"] == "urn:d:report"
            assert g.ask(f"ASK {{ ?r <{T.SH}result> ?v . ?v <{T.SH}focusNode> <urn:x> ; <{T.SH}resultPath> <urn:p> . ?r <{T.SH}conforms> false }}", graph="urn:d:report")["value"]


def test_pending_parameters_and_loading(spark, tmp_path):
    g = Graph(spark)
    body = SH + ":S a sh:NodeShape ; sh:targetNode :x ; sh:property [ sh:path :p ; sh:equals :q ] .\n"
    first = shacl.load_shapes(g, body, scope="urn:s")
    assert first["loaded"] == 5 and shacl.load_shapes(g, body, scope="urn:s") == {"ok": True, "loaded": 0, "scope": "urn:s", "reason": "unchanged"}
    assert shacl.validate(g, "urn:d", "urn:s")["reason"] == "unknown_constraint_component"
    assert shacl.load_shapes(g, "/nowhere/x.ttl")["reason"] == "shapes_file_missing"
    assert shacl.load_shapes(g, body, format="xml")["reason"] == "shapes_format_unknown"
    assert shacl.load_shapes(g, "this is not turtle\n")["reason"] == "shapes_parse_error"
    (tmp_path / "s.nt").write_text("# c\n<urn:a> <urn:b> <urn:c> . <urn:a> <urn:b> <urn:d> .\n")
    assert shacl.load_shapes(g, str(tmp_path / "s.nt"), format="nt", scope="urn:n")["loaded"] == 2


RULES = SH + ":S a sh:NodeShape ; sh:targetClass :O ; sh:rule "
FIRE = '; sh:construct "CONSTRUCT { ?this <urn:big> true } WHERE { ?this <urn:n> ?n FILTER(?n > 100) }" ] .'


def fired(spark, body, **kw):
    g = Graph(spark)
    g.execute(P + 'INSERT DATA { :a a :O ; :n 150 ; :s "active" . :b a :O ; :n 5 ; :s "retired" }', graph="urn:d")
    assert shacl.load_shapes(g, body + "\n", scope="urn:s")["ok"]
    return g, shacl.rules.materialise(g, "urn:d", "urn:s", "urn:i", **kw)


def test_shape_rules(spark):
    _, env = fired(spark, RULES + '[ a sh:TripleRule ; sh:subject sh:this ; sh:predicate :status ; sh:object "ok" ] .')
    assert (env["derived"], env["rules_fired"], env["iterations"], env["fixpoint"]) == (2, 1, 2, True)
    _, env = fired(spark, RULES + "[ a sh:SPARQLRule " + FIRE)
    assert env["derived"] == 1
    _, env = fired(spark, RULES + "[ a sh:SPARQLRule ; sh:deactivated true " + FIRE)
    assert (env["derived"], env["per_rule"], env["fixpoint"]) == (0, {}, True)
    _, env = fired(spark, RULES + "[ a sh:JSRule ] .")
    assert env["reason"] == "unknown_rule_type"
    _, env = fired(spark, RULES + ':R . :R a sh:TripleRule ; sh:subject sh:this ; sh:predicate :status ; sh:object "ok" ; sh:condition :C . :C sh:property [ sh:path :s ; sh:hasValue "active" ] .')
    assert env["per_rule"] == {"urn:R": 1}
    g, env = fired(spark, RULES + ':R1 , :R2 . :R1 a sh:SPARQLRule ; sh:order 2 ; sh:construct "CONSTRUCT { ?this <urn:z> 1 } WHERE { ?this <urn:big> ?b }" . :R2 a sh:SPARQLRule ; sh:order 1 ; sh:construct "CONSTRUCT { ?this <urn:big> true } WHERE { ?this <urn:n> ?n FILTER(?n > 100) }" .')
    assert env["per_rule"] == {"urn:R1": 1, "urn:R2": 1} and env["iterations"] == 2
    _, env = fired(spark, SH + ":S a sh:NodeShape .")
    assert (env["fixpoint"], env["derived"], env["iterations"]) == (True, 0, 0)

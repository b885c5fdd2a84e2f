"""Terms, text formats, queries, updates and the facade's envelopes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quadspark import changeset
from quadspark.functions import terms as T
from quadspark.graph import Graph
from quadspark.plans.parser import ParseError, parse_query
from quadspark.scope import Scope, resolve
from quadspark.sources import ntriples as N
from quadspark.sources import turtle

INT = f"^^<{T.XSD}integer>"


@pytest.fixture
def g(spark):
    return Graph(spark)


def values(env, *names):
    assert env["ok"], env
    return sorted(tuple(T.parse_plain(r.get(n)) for n in names) for r in env["results"])


@pytest.mark.parametrize(
    ("term", "cell"),
    [
        ("<urn:a>", ("urn:a", "iri", None, None)),
        ("_:b", ("_:b", "blank_node", None, None)),
        ('"x"', ("x", "literal", None, None)),
        (f'"5"{INT}', (5, "literal", T.XSD + "integer", None)),
        (f'"x"{INT}', ("x", "literal", T.XSD + "integer", None)),
        ('"a\\"b\\n"@en-US', ('a"b\n', "literal", None, "en-US")),
        ("<< <urn:a> <urn:b> <urn:c> >>", ("<< <urn:a> <urn:b> <urn:c> >>", "quoted_triple", None, None)),
        ("garbage", ("garbage", "unknown", None, None)),
        (f'"1.5"^^<{T.XSD}double>', (1.5, "literal", T.XSD + "double", None)),
        (f'"true"^^<{T.XSD}boolean>', (True, "literal", T.XSD + "boolean", None)),
    ],
)
def test_cells(spark, term, cell):
    found = T.parse_typed(term)
    assert tuple(found[k] for k in ("value", "kind", "datatype", "lang")) == cell
    c = spark.createDataFrame([(term,)], "t string").select(T.c_typed_cell(F.col("t")).alias("c")).first().c
    assert (c.kind, c.datatype, c.lang) == cell[1:]


def test_tokenizer():
    assert N.split_line("<< <urn:a> <urn:b> << <urn:c> <urn:d> \"x >> y\" >> >> <urn:p> <urn:o> .") == ('<< <urn:a> <urn:b> << <urn:c> <urn:d> "x >> y" >> >>', "<urn:p>", "<urn:o>")
    assert N.split_line("<< <urn:a> <urn:b> <urn:c> <urn:p> <urn:o> .") is None
    assert len(N.triples("<urn:a> <urn:b> 'x' .".replace("'", '"') + ' # c\n\n<urn:a> <urn:b> "y"@en . <urn:a> <urn:b> _:z .')) == 3
    with pytest.raises(N.ParseError):
        N.triples("<> <urn:p> <urn:o> .")


def test_ntriples_file(spark, tmp_path):
    text = '# c\n<urn:a> <urn:p> "x\\ty" .\n\n<< <urn:a> <urn:p> "x" >> <urn:by> <urn:me> .\n_:b <urn:p> "v"@en .\n'
    (tmp_path / "x.nt").write_text(text)
    rows = sorted((r.s, r.p, r.o, r.g) for r in N.read(spark, str(tmp_path / "x.nt"), "urn:g").collect())
    assert rows == sorted((*t, "urn:g") for t in N.triples(text))


def test_turtle():
    rows = turtle.parse('@prefix e: <urn:> . e:a a e:C ; e:p 1 , "x"@en , [ e:q (1 2) ] . << e:a e:p 1 >> e:by e:b .')
    assert ("<urn:a>", T.TYPE, "<urn:C>", None) in rows
    assert (f'<< <urn:a> <urn:p> "1"{INT} >>', "<urn:by>", "<urn:b>", None) in rows
    assert len(rows) == 10
    with pytest.raises(ParseError):
        turtle.parse("e:a e:b e:c .")


def test_updates_and_counts(g):
    assert g.execute("INSERT DATA { <urn:a> <urn:p> 1 , 2 . <urn:b> <urn:p> 2 }") == {"ok": True, "count": 3}
    assert g.execute("INSERT DATA { <urn:a> <urn:p> 1 . <urn:z> <urn:p> 1 }", graph="urn:g")["count"] == 2
    assert g.execute("INSERT DATA { <urn:a> <urn:p> 1 . <urn:z> <urn:p> 1 }", graph="urn:g")["count"] == 2  # rows given
    assert g.execute("DELETE DATA { <urn:none> <urn:p> 1 }")["count"] == 1  # rows given, even if absent
    assert [g.store_size()["count"], g.store_size(graph=None)["count"], g.store_size(graph="urn:g")["count"]] == [5, 3, 2]
    assert g.execute("DELETE WHERE { <urn:a> <urn:p> ?o }")["count"] == -2
    assert g.execute("PREFIX x: <urn:> INSERT { ?s x:q ?k } WHERE { ?s x:p ?o BIND(?o * 10 AS ?k) }")["count"] == 1
    assert values(g.select("SELECT ?k WHERE { <urn:b> <urn:q> ?k }"), "k") == [(20,)]
    assert g.execute("DELETE { ?s ?p ?o } INSERT { ?s <urn:r> ?o } WHERE { ?s ?p ?o }", graph="urn:g")["count"] == 0
    assert g.execute("CLEAR ALL", graph="urn:g")["reason"] == "invalid_dsl"
    assert g.execute("CLEAR GRAPH <urn:g>")["count"] == -2
    assert g.execute("CLEAR DEFAULT") == {"ok": True, "count": 0}
    assert g.store_size()["count"] == 0
    assert g.execute("INSERT DATA { GRAPH <urn:x> { <urn:a> <urn:b> <urn:c> } } ; COPY <urn:x> TO <urn:y> ; MOVE <urn:x> TO <urn:z> ; ADD <urn:z> TO DEFAULT")["ok"]
    assert sorted(str(r.g) for r in g.store.quads.collect()) == ["None", "urn:y", "urn:z"]


def test_bulk(g):
    rows = [{"s": "urn:a", "p": "urn:p", "o": "x"}, ["urn:a", "urn:p", "x"], ("urn:a", "urn:p", 5, "urn:g"), {"s": ("urn:a", "urn:p", "x"), "p": "urn:by", "o": "<urn:me>"}]
    assert g.bulk_insert(rows) == {"ok": True, "inserted": 3}
    assert g.bulk_insert(rows)["inserted"] == 0
    bad = g.bulk_insert([("urn:a", "urn:p", "y"), ("", "urn:p", "x")])
    assert bad["reason"] == "invalid_dsl" and "row 2" in bad["because"]
    assert g.bulk_insert([("urn:a", "_:p", "y")])["ok"] is False
    assert g.bulk_insert([]) == {"ok": True, "inserted": 0}
    assert g.bulk_insert([('<urn:a>', "<urn:p>", '"raw"@en')], raw=True)["inserted"] == 1
    assert g.bulk_delete([("urn:a", "urn:p", "x"), ("urn:a", "urn:p", "nope")]) == {"ok": True, "deleted": 1}
    assert values(g.select("SELECT ?x ?w WHERE { << ?x <urn:p> ?y >> <urn:by> ?w }"), "x", "w") == [("urn:a", "urn:me")]
    assert g.ask("ASK { << <urn:a> <urn:p> \"x\" >> <urn:by> <urn:me> }")["value"] is True
    assert g.store_size(graph="_:b")["reason"] == "invalid_graph"


def test_graphs_and_scopes(g):
    g.bulk_insert([("urn:d", "urn:p", "default"), ("urn:n", "urn:p", "one", "urn:g1"), ("urn:n", "urn:p", "two", "urn:g2")])
    q = "SELECT ?o WHERE { ?s <urn:p> ?o }"
    assert values(g.select(q), "o") == [("default",)]
    assert values(g.select(q, graph="urn:g1"), "o") == [("one",)]
    assert values(g.select(q, scope=Scope("urn:g2")), "o") == [("two",)]
    assert values(g.select("SELECT ?o FROM <urn:g1> FROM <urn:g2> WHERE { ?s <urn:p> ?o }"), "o") == [("one",), ("two",)]
    assert values(g.select("SELECT ?g FROM NAMED <urn:g1> WHERE { GRAPH ?g { ?s <urn:p> ?o } }"), "g") == [("urn:g1",)]
    assert g.select(q, graph="urn:g1", scope=Scope("urn:g2"))["reason"] == "scope_kwarg_conflict"
    assert g.select(q, scope=Scope("urn:a", inferred="urn:a"))["reason"] == "scope_read_write_overlap"
    assert g.select(q, graph="_:x")["reason"] == "invalid_graph"
    assert resolve(Scope("urn:a"), {}, {"data": "graph"}, ("inferred",))["reason"] == "scope_role_missing"
    assert Scope("urn:a", additional={"k": "v"}) == Scope("urn:a", additional={"k": "v"}) != Scope("urn:a")


def test_query_forms(g):
    g.execute('PREFIX e: <urn:> INSERT DATA { e:a e:knows e:b . e:b e:knows e:c . e:c e:knows e:a . e:a e:age 30 . e:b e:age 20 ; e:name "Bob"@en . e:c e:name "Cy" }')
    p = "PREFIX e: <urn:> "
    assert values(g.select(p + "SELECT ?x WHERE { e:a e:knows+ ?x }"), "x") == [("urn:a",), ("urn:b",), ("urn:c",)]
    assert values(g.select(p + "SELECT ?x WHERE { ?x e:knows/e:knows e:a }"), "x") == [("urn:b",)]
    assert len(g.select(p + "SELECT ?x WHERE { e:a (^e:knows|e:age) ?x }")["results"]) == 2
    assert values(g.select(p + "SELECT ?x ?n WHERE { ?x e:knows ?y OPTIONAL { ?x e:name ?n } FILTER(!BOUND(?n)) }"), "x", "n") == [("urn:a", None)]
    assert values(g.select(p + "SELECT ?x WHERE { ?x e:knows ?y MINUS { ?x e:age ?z } }"), "x") == [("urn:c",)]
    assert values(g.select(p + "SELECT ?x WHERE { ?x e:knows ?y MINUS { ?a e:age ?z } }"), "x") == [("urn:a",), ("urn:b",), ("urn:c",)]
    assert values(g.select(p + "SELECT ?x WHERE { ?x e:age ?z FILTER NOT EXISTS { ?w e:age ?v FILTER(?v < ?z) } }"), "x") == [("urn:b",)]
    assert values(g.select(p + "SELECT (SUM(?z) AS ?s) (AVG(?z) AS ?a) (MIN(?z) AS ?m) (COUNT(*) AS ?k) WHERE { ?x e:age ?z }"), "s", "a", "m", "k") == [(50, 25.0, 20, 2)]
    assert values(g.select(p + "SELECT (COUNT(?x) AS ?k) WHERE { ?x e:none ?y }"), "k") == [(0,)]
    assert values(g.select(p + "SELECT ?x ?v WHERE { VALUES (?x ?v) { (e:a 1) (UNDEF 2) } ?x e:age ?z }"), "x", "v") == [("urn:a", 1), ("urn:a", 2), ("urn:b", 2)]
    assert values(g.select(p + 'SELECT ?x WHERE { ?x e:name ?n FILTER(LANG(?n) = "en" && STRLEN(?n) = 3) }'), "x") == [("urn:b",)]
    assert [r["x"] for r in g.select(p + "SELECT ?x WHERE { ?x e:knows ?y OPTIONAL { ?x e:age ?z } } ORDER BY ?z DESC(?x)")["results"]] == ["<urn:c>", "<urn:b>", "<urn:a>"]
    assert g.construct(p + "CONSTRUCT { ?y e:knownBy ?x . ?n e:bad ?x } WHERE { ?x e:knows ?y ; e:name ?n }")["ntriples"] == "<urn:a> <urn:knownBy> <urn:c> .\n<urn:c> <urn:knownBy> <urn:b> .\n"
    assert g.select("SELECT ?x WHERE { ?x")["reason"] == "sparql_parse_error"
    assert g.select(p + "SELECT (NOPE(?x) AS ?y) WHERE { ?x e:age ?z }")["reason"] == "sparql_eval_error"
    assert g.ask(p + "ASK { e:a e:age ?z FILTER(?z > 100) }")["value"] is False
    assert g.ask(p + "ASK { e:a e:knows e:b ; e:age 30 . e:b e:age 20 }")["value"] is True
    assert g.ask(p + "ASK { e:a e:knows e:b ; e:age 31 }")["value"] is False
    assert len(g.select(p + "SELECT ?x WHERE { e:a e:knows e:b . ?x e:age ?z FILTER EXISTS { e:b e:age 20 } }")["results"]) == 2
    assert g.select(p + "SELECT ?x WHERE { ?x e:age ?z FILTER NOT EXISTS { e:b e:age 20 } }")["results"] == []
    assert values(g.select(p + "SELECT ?x (1/0 AS ?e) WHERE { ?x e:age 30 }"), "x", "e") == [("urn:a", None)]
    assert g.select(p + "SELECT ?x WHERE { SERVICE <urn:s> { ?x ?y ?z } }")["ok"] is False


def test_explain(g):
    plan = g.explain('PREFIX e: <urn:> SELECT DISTINCT ?x (COUNT(*) AS ?k) WHERE { ?x e:p ?y . FILTER(?y > 3) OPTIONAL { ?x e:q ?z } GRAPH <urn:g> { ?x e:r ?w } { ?x e:a ?b } UNION { ?x e:c ?d } BIND(1 AS ?one) } GROUP BY ?x HAVING(COUNT(*) > 1) ORDER BY DESC(?x) LIMIT 5 OFFSET 2')
    assert plan["ok"] and plan["estimated_rows"] == "unknown"
    w, m = plan["plan"]["where"], plan["plan"]["modifiers"]
    assert plan["plan"]["projection"] == ["?x", "(COUNT(*) AS ?k)"]
    assert [len(w[k]) for k in ("patterns", "filters", "optionals", "graphs", "unions", "binds")] == [1] * 6
    assert (m["limit"], m["offset"], m["group_by"], m["order_by"]) == (5, 2, ["?x"], [{"var": "?x", "dir": "desc"}])
    assert g.explain("INSERT DATA { <urn:a> <urn:b> 1 }")["plan"]["operation"] == "insert_data"
    assert g.explain("DELETE { ?s ?p ?o } WHERE { ?s ?p ?o }")["plan"]["operation"] == "delete_where"
    assert g.explain("CLEAR GRAPH <urn:g>")["plan"] == {"kind": "update", "operation": "clear", "target": "<urn:g>"}
    assert g.explain("nonsense")["reason"] == "sparql_parse_error"
    assert parse_query("ASK { ?a ?b ?c }").form == "ask"


def test_change_sets(g):
    scope = Scope("urn:d")
    with changeset.capture(scope) as changes:
        g.bulk_insert([("urn:a", "urn:p", 5, "urn:d"), ("urn:a", "urn:p", "out", "urn:other")])
        g.execute("DELETE DATA { <urn:a> <urn:p> 5 }", graph="urn:d")
        with pytest.raises(changeset.NestedCaptureError), changeset.capture():
            pass
        with pytest.raises(changeset.ScopeMismatch):
            changeset.record_add("<urn:a>", "<urn:b>", "<urn:c>", "urn:else")
    assert changes.added == (("<urn:a>", "<urn:p>", f'"5"{INT}', "urn:d"),)
    assert changes.retracted == (("<urn:a>", "<urn:p>", f'"5"{INT}', "urn:d"),)
    assert changeset.active() is None and changes.graph_iri.startswith(T.ENGINE)


def test_snapshots_are_isolated(g):
    g.bulk_insert([("urn:a", "urn:p", 1)])
    before = g.select_df("SELECT ?o WHERE { <urn:a> <urn:p> ?o }")
    g.bulk_insert([("urn:a", "urn:p", 2)])
    assert before.count() == 1 and g.select_df("SELECT ?o WHERE { <urn:a> <urn:p> ?o }").count() == 2


def _naive(triples, patterns):
    """All solutions of a basic graph pattern, as sorted tuples of items."""
    names = sorted({x for t in patterns for x in t if x.startswith("?")})
    out = []
    for choice in itertools.product(triples, repeat=len(patterns)):
        row, ok = {}, True
        for t, pattern in zip(choice, patterns, strict=True):
            for x, y in zip(pattern, t, strict=True):
                if x.startswith("?"):
                    ok = ok and row.setdefault(x, y) == y
                else:
                    ok = ok and x == y
        if ok:
            out.append(tuple(row[n] for n in names))
    return names, sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_random_patterns(spark, seed):
    r = random.Random(seed)
    nodes, preds = [f"<urn:n{i}>" for i in range(4)], ["<urn:p>", "<urn:q>"]
    triples = sorted({(r.choice(nodes), r.choice(preds), r.choice(nodes)) for _ in range(8)})
    terms = [*nodes[:2], "?a", "?b", "?c"]
    patterns = [(r.choice(terms), r.choice([*preds, "?p"]), r.choice(terms)) for _ in range(r.randint(1, 3))]
    names, want = _naive(triples, patterns)
    g = Graph(spark)
    g.bulk_insert(triples, raw=True)
    text = f"SELECT * WHERE {{ {' . '.join(' '.join(p) for p in patterns)} }}"
    if not names:
        assert g.ask("ASK" + text[8:].replace("WHERE", "", 1))["value"] == bool(want)
        return
    got = sorted(tuple(row[n[1:]] for n in names) for row in g.select(text)["results"])
    assert got == want


def test_counts_over_products(spark):
    """Grouped counts after an OPTIONAL equal those of the listed solutions, and the product itself is not made."""
    rnd = random.Random(5)
    rows = [f"<urn:x{i}> <urn:p> <urn:l{rnd.randrange(3)}> ." for i in range(40)]
    rows += [f"<urn:x{i}> <urn:q> <urn:v{rnd.randrange(3)}> ." for i in range(0, 40, 3)]
    rows += [f"<urn:y{i}> <urn:t> <urn:v{rnd.randrange(2)}> ." for i in range(25)] + [f"<urn:z{i}> <urn:u> <urn:v{i % 3}> ." for i in range(7)]
    g = Graph(spark)
    assert g.execute("INSERT DATA { " + " ".join(rows) + " GRAPH <urn:g> { " + " ".join(rows) + " } }")["ok"]
    after = "{ ?x <urn:p> ?l OPTIONAL { ?x <urn:q> ?q } } { ?y <urn:t> ?q }"
    patterns = [after, after + " FILTER(?l != ?q || !BOUND(?q) || ?q = <urn:v1>)", after + " { ?z <urn:u> ?w }", after + " OPTIONAL { ?y <urn:none> ?w }", f"GRAPH ?h {{ {after} }}", "{ ?x <urn:p> ?l } { SELECT ?q ?w WHERE { ?z <urn:u> ?q OPTIONAL { ?z <urn:none> ?w } } }", "{ ?x <urn:p> ?l OPTIONAL { ?x <urn:q> ?q } } { ?y <urn:none> ?q }"]
    for pattern in patterns:
        every = g.select(f"SELECT * WHERE {{ {pattern} }}")["results"]
        for keys in ([], ["l"], ["q"], ["l", "q"]):
            groups = {}
            for r in every:
                groups.setdefault(tuple(r.get(k) for k in keys), []).append(r)
            if not keys:
                groups.setdefault((), [])
            want = {k: (len(rs), sum(r.get("q") is not None for r in rs), len({r["q"] for r in rs if r.get("q")}), max((r["l"] for r in rs), default=None)) for k, rs in groups.items()}
            by = " ".join(f"?{k}" for k in keys)
            got = g.select(f"SELECT {by} (COUNT(*) AS ?n) (COUNT(?q) AS ?m) (COUNT(DISTINCT ?q) AS ?d) (MAX(?l) AS ?top) WHERE {{ {pattern} }} " + (f"GROUP BY {by}" if keys else ""))["results"]
            assert {tuple(r.get(k) for k in keys): (*(T.parse_plain(r[c]) for c in "nmd"), r.get("top")) for r in got} == want and len(got) == len(want)
    plan = g.select_df(f"SELECT ?l (COUNT(*) AS ?n) WHERE {{ {after} }} GROUP BY ?l")._jdf.queryExecution().optimizedPlan().toString()
    depth = [(len(line) - len(line.lstrip(" :+-")), line.lstrip(" :+-").split()[0]) for line in plan.splitlines()]
    product = next(k for k, (_, name) in enumerate(depth) if name == "Join")
    assert [name for d, name in depth[product + 1 :] if name == "Aggregate" and d > depth[product][0]]

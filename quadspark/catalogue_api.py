"""Queries over the facade's other calls: counts, refusals, envelopes, quoted triples, the view, snapshots, routing. Most are held against what the tables say."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import capabilities, changeset, emit, ir, reasoner, shacl
from . import reasons as R
from .catalogue import _A, _G, _I, _K, _RDF_TYPE, _SUB, _SUBS, C, NS, PREFIX, _annotated, _context, _counts, _inferred, _reasoned, _run, _shapes, mapped, query, sparql, subject, table
from .functions import terms as T
from .graph import Graph
from .ir import relational_backend, router, sparql_backend
from .scope import Scope
from .store import shared_folder


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/quadspark/{name}-{uuid.uuid4().hex}"


def _nations(spark, d) -> list:
    """The 25 nations, which updates are written from."""
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()


# asking
@query("ask_segments", "SELECT r_name AS name, count(n_nationkey) > 0 AS has, count(n_nationkey) > 5 AS many FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_name < 'J' GROUP BY r_name")
def ask_segments(spark, d):
    g = Graph(spark, mapped(spark, d, "Nation", "Region"))
    rows = []
    for r in table(spark, d, "region").select("r_regionkey", "r_name").collect():
        some = f'?x n:region <urn:tpch:Region:{r.r_regionkey}> ; n:name ?n FILTER(?n < "J")'
        has = g.ask(PREFIX + f"ASK {{ {some} }}")["value"]
        rows.append((r.r_name, has, g.ask(PREFIX + f"ASK {{ {{ SELECT (COUNT(*) AS ?k) WHERE {{ {some} }} }} FILTER(?k > 5) }}")["value"]))
    return spark.createDataFrame(rows, "name string, has boolean, many boolean")


sparql("from_named", "Customer Nation Region", "SELECT ?g (COUNT(*) AS ?k) FROM NAMED <urn:g:nations> WHERE { GRAPH ?g { ?x a ?c } } GROUP BY ?g", "g:iri k:long", "SELECT 'urn:g:nations' AS g, COUNT(*) AS k FROM nation", graphs=_G)
sparql("join_predicate_variable", "Nation Customer", "SELECT ?p (COUNT(*) AS ?k) WHERE { ?c c:nation ?x . ?x ?p ?o } GROUP BY ?p", "p:iri k:long", f"SELECT unnest(['{_RDF_TYPE}', 'urn:tpch:Nation/name', 'urn:tpch:Nation/region']) AS p, (SELECT COUNT(*) FROM customer) AS k")
sparql("join_after_optional", "Document Label", "SELECT ?l (COUNT(*) AS ?k) WHERE { ?x d:lang ?l OPTIONAL { ?x l:quality ?q } ?y l:toxic ?q } GROUP BY ?l", "l:string k:long", "SELECT lang AS l, COUNT(*) AS k FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id JOIN labels t ON b.quality IS NULL OR t.toxic = b.quality GROUP BY lang")
sparql("optional_after_optional", "Document Label", "SELECT ?x ?q ?z WHERE { ?x d:lang ?l OPTIONAL { ?x l:quality ?q } OPTIONAL { ?x l:toxic ?q . ?x l:quality ?z } }", "x:iri q:long z:long", "SELECT 'urn:tpch:Document:' || d.doc_id AS x, CAST(quality AS BIGINT) AS q, CAST(CASE WHEN quality = toxic THEN quality END AS BIGINT) AS z FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id")
sparql("not_exists_some", "Customer Order", 'SELECT ?x WHERE { ?x a t:Customer FILTER NOT EXISTS { ?y o:customer ?x ; o:status "P" } }', "x:iri", "SELECT 'urn:tpch:Customer:' || c_custkey AS x FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")


@query("order_positions", "SELECT row_number() OVER (ORDER BY c_mktsegment DESC, c_name) AS at, c_name AS n FROM customer")
def order_positions(spark, d):
    rows = Graph(spark, mapped(spark, d, "Customer")).select_df(PREFIX + "SELECT ?m ?n WHERE { ?x c:segment ?m ; c:name ?n } ORDER BY DESC(?m) ?n", types={"m": "string", "n": "string"}).collect()
    return spark.createDataFrame([(k, r.n) for k, r in enumerate(rows, 1)], "at long, n string")


# functions
sparql("fn_now", "Region", "SELECT ?x (YEAR(NOW()) - ?k AS ?y) (NOW() = NOW() AS ?same) WHERE { ?x r:name ?n BIND(STRLEN(?n) AS ?k) }", "x:iri y:long same:boolean", "SELECT 'urn:tpch:Region:' || r_regionkey AS x, year(now()) - length(r_name) AS y, true AS same FROM region")
sparql("fn_hash_long", "Nation", "SELECT ?x WHERE { ?x n:name ?n FILTER(STRLEN(SHA512(?n)) = 128 && STRLEN(SHA384(?n)) = 96 && SHA512(?n) != SHA512(CONCAT(?n, \"!\"))) }", "x:iri", "SELECT 'urn:tpch:Nation:' || n_nationkey AS x FROM nation")
sparql("fn_same_term", "Nation", "SELECT ?a ?b WHERE { ?a n:region ?g . ?b n:region ?h FILTER(sameTerm(?g, ?h) && !sameTerm(?a, ?b)) }", "a:iri b:iri", "SELECT 'urn:tpch:Nation:' || x.n_nationkey AS a, 'urn:tpch:Nation:' || y.n_nationkey AS b FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_nationkey <> y.n_nationkey")
sparql("fn_make_terms", "Part", 'SELECT ?x (STRDT(STR(?z), xsd:integer) + 1 AS ?i) (DATATYPE(STRDT(?b, <urn:dt>)) AS ?t) (isBlank(BNODE()) AS ?bn) (STRLEN(STRUUID()) AS ?l) (isIRI(UUID()) AS ?u) (RAND() < 1 AS ?r) WHERE { ?x p:size ?z ; p:brand ?b }', "x:iri i:long t:iri bn:boolean l:long u:boolean r:boolean", "SELECT 'urn:tpch:Part:' || p_partkey AS x, CAST(p_size + 1 AS BIGINT) AS i, 'urn:dt' AS t, true AS bn, CAST(36 AS BIGINT) AS l, true AS u, true AS r FROM part")
sparql("fn_time_parts", "Order", 'SELECT ?x (MINUTES(?e) AS ?m) (SECONDS(?e) AS ?s) (TZ(?e) AS ?z) (STR(TIMEZONE(?e)) AS ?t) WHERE { ?x o:status "P" ; o:date ?d BIND(STRDT(CONCAT(SUBSTR(STR(?d), 1, 10), "T10:", SUBSTR(STR(?d), 9, 2), ":07Z"), xsd:dateTime) AS ?e) }', "x:iri m:long s:double z:string t:string", "SELECT 'urn:tpch:Order:' || o_orderkey AS x, day(o_orderdate) AS m, 7.0::DOUBLE AS s, 'Z' AS z, 'PT0S' AS t FROM orders WHERE o_orderstatus = 'P'")


@query("term_parts", "SELECT 'iri' AS kind, 'urn:tpch:Nation:' || n_nationkey AS lexical, NULL AS datatype, '' AS lang, false AS quoted FROM nation UNION ALL SELECT 'literal', n_name, 'http://www.w3.org/2001/XMLSchema#string', '', false FROM nation UNION ALL SELECT 'literal', n_name, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString', 'en', false FROM nation UNION ALL SELECT 'literal', CAST(n_nationkey AS VARCHAR), 'http://www.w3.org/2001/XMLSchema#integer', '', false FROM nation UNION ALL SELECT 'quoted_triple', NULL, NULL, '', true FROM nation")
def term_parts(spark, d):
    n = table(spark, d, "nation")
    iri, plain = T.c_iri(F.concat(F.lit("urn:tpch:Nation:"), F.col("n_nationkey"))), T.c_plain(F.col("n_name"))
    quoted = F.concat_ws(" ", F.lit("<<"), iri, F.lit("<urn:p>"), plain, F.lit(">>"))
    t = n.select(F.explode(F.array(iri, plain, F.concat(plain, F.lit("@en")), T.c_literal(F.col("n_nationkey"), "int"), quoted)).alias("t"))
    c = F.col("t")
    return t.select(T.c_kind(c).alias("kind"), T.c_lexical(c).alias("lexical"), T.c_datatype(c).alias("datatype"), F.coalesce(T.c_lang(c), F.lit("")).alias("lang"), T.is_quoted(c).alias("quoted"))


@query("json_literals", "SELECT n_nationkey AS k, '{\"k\":' || n_nationkey || ',\"tags\":[\"' || n_name || '\",\"x\\\"y\"]}' AS j FROM nation")
def json_literals(spark, d):
    n = table(spark, d, "nation")
    m = emit.Mapping(subject("Nation", "n_nationkey"), [emit.Triple("urn:j", lambda df: F.struct(F.col("n_nationkey").alias("k"), F.array("n_name", F.lit('x"y')).alias("tags")))])
    return emit.quads(n, m).select(F.regexp_extract("s", r"(\d+)>$", 1).cast("int").alias("k"), T.c_lexical(F.col("o")).alias("j"))


@query("checkpoint_slugs", "SELECT n_name AS n, 'urn_g_' || replace(n_name, ' ', '_') || '.nt' AS f FROM nation")
def checkpoint_slugs(spark, d):
    from .sources.blobs import slug

    return spark.createDataFrame([(r.n_name, slug(f"urn:g/{r.n_name}#") + ".nt") for r in _nations(spark, d)], "n string, f string")


# quoted triples
@query("star_ground", "SELECT CAST(2 * n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey = 7")
def star_ground(spark, d):
    name = next(r.n_name for r in _nations(spark, d) if r.n_nationkey == 7)
    return _annotated(spark, d).select_df(PREFIX + f'SELECT ?k WHERE {{ << <urn:tpch:Nation:7> n:name "{name}" >> t:confidence ?k }}', types={"k": "long"})


@query("star_functions", "SELECT 'urn:tpch:Nation:' || n_nationkey AS s, 'urn:tpch:Nation/name' AS p, n_name AS o, true AS same FROM nation WHERE n_nationkey < 5")
def star_functions(spark, d):
    text = 'SELECT (SUBJECT(?t) AS ?s) (PREDICATE(?t) AS ?p) (OBJECT(?t) AS ?o) (TRIPLE(SUBJECT(?t), PREDICATE(?t), OBJECT(?t)) = ?t AS ?same) WHERE { ?t t:by "loader" FILTER(isTRIPLE(?t)) }'
    return _annotated(spark, d).select_df(PREFIX + text, types={"s": "iri", "p": "iri", "o": "string", "same": "boolean"})


@query("star_shorthand", "SELECT 'urn:tpch:Nation:' || n_nationkey AS x, n_name AS n, CAST(2 * n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey < 5")
def star_shorthand(spark, d):
    return _annotated(spark, d).select_df(PREFIX + 'SELECT ?x ?n ?k WHERE { ?x n:name ?n {| t:confidence ?k ; t:by "loader" |} }', types={"x": "iri", "n": "string", "k": "long"})


@query("star_quoted_rows", "SELECT 'urn:tpch:Nation:' || n_nationkey AS x, n_name AS n, CAST(n_regionkey AS BIGINT) AS k FROM nation")
def star_quoted_rows(spark, d):
    g = Graph(spark)
    g.bulk_insert([(Graph.quoted_triple(f"urn:tpch:Nation:{r.n_nationkey}", "urn:n", r.n_name), "urn:k", r.n_regionkey) for r in _nations(spark, d)])
    return g.select_df("SELECT ?x ?n ?k WHERE { << ?x <urn:n> ?n >> <urn:k> ?k }", types={"x": "iri", "n": "string", "k": "long"})


@query("star_nt_roundtrip", "SELECT 2 * COUNT(*) + 5 AS k, CAST(0 AS BIGINT) AS lost FROM nation")
def star_nt_roundtrip(spark, d):
    from .sources import ntriples
    from .store import minus

    quads = _annotated(spark, d).store.quads
    path = _folder(spark, "nt-star")
    ntriples.write(quads, path)
    back = ntriples.read(spark, path)
    return back.agg(F.count(F.lit(1)).alias("k")).crossJoin(minus(quads, back).agg(F.count(F.lit(1)).alias("lost")))  # one row each


# writes
def _data(rows: list) -> str:
    return " ".join(f'<urn:tpch:Nation:{r.n_nationkey}> <urn:r> <urn:tpch:Region:{r.n_regionkey}> .' for r in rows)


@query("upd_data_counts", "SELECT 'default' AS form, COUNT(*) AS first, CAST(0 AS BIGINT) AS again, (SELECT COUNT(*) FROM nation WHERE n_regionkey = 1) AS gone FROM nation UNION ALL SELECT 'graph', COUNT(*), COUNT(*), (SELECT COUNT(*) FROM nation WHERE n_regionkey = 1) FROM nation")
def upd_data_counts(spark, d):
    rows, out = _nations(spark, d), []
    for form, kw in (("default", {}), ("graph", {"graph": "urn:g:n"})):
        g = Graph(spark)
        first, again = (_run(g, f"INSERT DATA {{ {_data(rows)} }}", **kw)["count"] for _ in range(2))
        out.append((form, first, again, _run(g, f"DELETE DATA {{ {_data([r for r in rows if r.n_regionkey == 1])} }}", **kw)["count"]))
    return spark.createDataFrame(out, "form string, first long, again long, gone long")


@query("upd_delete_where_form", "SELECT '" + _RDF_TYPE + "' AS p, '' AS g, COUNT(*) AS k FROM nation UNION ALL SELECT 'urn:tpch:Nation/region', '', COUNT(*) FROM nation UNION ALL SELECT 'urn:tpch:Nation/name', '', COUNT(*) - 1 FROM nation")
def upd_delete_where_form(spark, d):
    g = Graph(spark, mapped(spark, d, "Nation"))
    _run(g, "DELETE WHERE { <urn:tpch:Nation:3> n:name ?n }")
    return _counts(g)


@query("upd_graph_scoped", f"SELECT 'urn:tpch:Nation/name' AS p, 'urn:g:nations' AS g, COUNT(*) AS k FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'urn:tpch:Nation/region', 'urn:g:nations', COUNT(*) FROM nation UNION ALL SELECT '{_RDF_TYPE}', 'urn:g:nations', COUNT(*) FROM nation UNION ALL SELECT 'urn:old', 'urn:g:nations', COUNT(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'urn:tpch:Region/name', '', COUNT(*) FROM region UNION ALL SELECT '{_RDF_TYPE}', '', COUNT(*) FROM region")
def upd_graph_scoped(spark, d):
    g = Graph(spark, mapped(spark, d, "Nation", "Region", graphs=_G))
    _run(g, "DELETE { ?x n:name ?n } INSERT { ?x <urn:old> ?n } WHERE { ?x n:name ?n ; n:region <urn:tpch:Region:1> }", graph="urn:g:nations")
    return _counts(g)


@query("upd_using", "SELECT 'urn:seen' AS p, 'urn:g:out' AS g, COUNT(*) AS k FROM nation")
def upd_using(spark, d):
    g = Graph(spark, mapped(spark, d, "Nation", "Customer", graphs=_G))
    _run(g, "INSERT { GRAPH <urn:g:out> { ?x <urn:seen> ?c } } USING <urn:g:nations> WHERE { ?x a ?c }")
    return _counts(g).where("g = 'urn:g:out'")


@query("upd_clear_forms", "SELECT * FROM (VALUES ('DEFAULT'), ('NAMED'), ('ALL')) f(form), LATERAL (SELECT CASE form WHEN 'NAMED' THEN 2 * COUNT(*) ELSE 0 END AS plain FROM region) a, LATERAL (SELECT CASE form WHEN 'DEFAULT' THEN 3 * COUNT(*) ELSE 0 END AS named FROM nation) b")
def upd_clear_forms(spark, d):
    out = []
    for form in ("DEFAULT", "NAMED", "ALL"):
        g = Graph(spark, mapped(spark, d, "Nation", "Region", graphs=_G))
        _run(g, f"CLEAR {form}")
        out.append((form, g.store_size(graph=None)["count"], g.store_size(graph="urn:g:nations")["count"]))
    return spark.createDataFrame(out, "form string, plain long, named long")


@query("upd_graph_forms", "SELECT 2 * (SELECT COUNT(*) FROM region) AS kept, CAST(0 AS BIGINT) AS dropped, (SELECT COUNT(*) FROM nation) AS loaded, CAST(0 AS BIGINT) AS silent, 'invalid_dsl' AS refused")
def upd_graph_forms(spark, d):
    from .sources import ntriples

    path = _folder(spark, "load")
    ntriples.write(mapped(spark, d, "Nation").where(F.col("p") == f"<{NS}Nation/name>"), path)
    g = Graph(spark, mapped(spark, d, "Nation", "Region", graphs=_G))
    refused = g.execute("CLEAR ALL", graph="urn:g:nations")["reason"]
    _run(g, "DROP GRAPH <urn:g:nations> ; CREATE GRAPH <urn:g:new>")
    dropped = g.store_size(graph="urn:g:nations")["count"]
    loaded = _run(g, f"LOAD <{path}> INTO GRAPH <urn:g:new>")["count"]
    return spark.createDataFrame([(g.store_size(graph=None)["count"], dropped, loaded, _run(g, "LOAD SILENT <file:///nowhere/x.nt>")["count"], refused)], "kept long, dropped long, loaded long, silent long, refused string")


@query("nt_bulk_load", "SELECT 3 * COUNT(*) AS first, CAST(0 AS BIGINT) AS again, 3 * COUNT(*) AS size FROM nation")
def nt_bulk_load(spark, d):
    from .sources import ntriples

    path = _folder(spark, "nt")
    ntriples.write(mapped(spark, d, "Nation"), path)
    g = Graph(spark)
    first, again = (g.load_ntriples(path, "urn:g:n")["count"] for _ in range(2))
    return spark.createDataFrame([(first, again, g.store_size(graph="urn:g:n")["count"])], "first long, again long, size long")


@query("view_by_predicate", f"SELECT graph, p, k FROM (SELECT 'urn:g:nations' AS graph, '<' || unnest(['{_RDF_TYPE}', 'urn:tpch:Nation/name', 'urn:tpch:Nation/region']) || '>' AS p, (SELECT COUNT(*) FROM nation) AS k UNION ALL SELECT NULL, '<urn:of>', COUNT(*) FROM nation)")
def view_by_predicate(spark, d):
    g = Graph(spark, mapped(spark, d, "Nation", graphs=_G))
    g.create_view("triples_read")
    g.insert_sql("SELECT s, '<urn:of>' AS p, o, NULL AS graph FROM triples_read WHERE p = '<urn:tpch:Nation/region>'")
    g.create_view("triples_read")
    return spark.sql("SELECT graph, p, COUNT(*) AS k FROM triples_read GROUP BY graph, p")


@query("bulk_rows_checked", "SELECT 'predicate' AS bad, 'invalid_dsl' AS reason, 'row ' || (SELECT COUNT(*) + 1 FROM nation) AS at, CAST(0 AS BIGINT) AS size UNION ALL SELECT 'subject', 'invalid_dsl', 'row ' || (SELECT COUNT(*) + 1 FROM nation), 0")
def bulk_rows_checked(spark, d):
    good = mapped(spark, d, "Nation").where(F.col("p") == f"<{NS}Nation/name>").select("s", "p", "o", "g").coalesce(1)
    out = []
    for name, row in (("predicate", ("<urn:a>", '"p"', "<urn:b>", None)), ("subject", ('"s"', "<urn:p>", "<urn:b>", None))):
        g = Graph(spark)
        env = g.bulk_insert(good.union(spark.createDataFrame([row], "s string, p string, o string, g string").coalesce(1)))
        out.append((name, env["reason"], env["because"].split(":")[0], g.store_size()["count"]))
    return spark.createDataFrame(out, "bad string, reason string, at string, size long")


@query("changes_of_frames", "SELECT 3 * (SELECT COUNT(*) FROM nation) AS added, (SELECT COUNT(*) FROM nation WHERE n_regionkey = 1) AS retracted")
def changes_of_frames(spark, d):
    g = Graph(spark)
    rows = mapped(spark, d, "Nation")
    with changeset.capture() as changes:
        g.bulk_insert(rows)
        g.bulk_delete(rows.where((F.col("p") == f"<{NS}Nation/region>") & (F.col("o") == "<urn:tpch:Region:1>")))
    return changes.frame("added").agg(F.count(F.lit(1)).alias("added")).crossJoin(changes.frame("retracted").agg(F.count(F.lit(1)).alias("retracted")))  # one row each


@query("dred_of_frames", f"SELECT 'urn:tpch:Nation:' || n_nationkey AS s, '{_RDF_TYPE}' AS p, '{_K}' || c AS o FROM nation, (VALUES ('Nation'), ('Place')) v(c) WHERE n_regionkey <> 2 UNION ALL SELECT '{_K}Nation' || i, '{_SUB}', '{_K}Place' FROM range(5) t(i)")
def dred_of_frames(spark, d):
    g = _reasoned(spark, d, _SUBS, ("scm-sco", "cax-sco"), provenance=True)
    scope = Scope(_A, inferred=_I)
    gone = g.store.quads.where((F.col("g") == _A) & (F.col("p") == T.TYPE) & (F.col("o") == f"<{_K}Nation2>"))
    with changeset.capture(scope) as changes:
        g.bulk_delete(gone)
    env = reasoner.dred(g, scope=scope, changes=changes, rules=reasoner.OWL_2_RL.only("scm-sco", "cax-sco"))
    if not env["ok"]:
        raise RuntimeError(env["because"])
    return _inferred(g)


@query("snapshots_pruned", "SELECT CAST(2 AS BIGINT) AS kept, CAST(1 AS BIGINT) AS pruned, (SELECT COUNT(*) FROM nation WHERE n_regionkey = 1) AS removed, 3 * (SELECT COUNT(*) FROM nation) - (SELECT COUNT(*) FROM nation WHERE n_regionkey = 1) AS restored")
def snapshots_pruned(spark, d):
    from . import snapshots as S

    base = _folder(spark, "snapshots")
    g = Graph(spark, mapped(spark, d, "Nation"))
    ids = [S.snapshot(g, base, "none")["id"], S.snapshot(g, base, "before")["id"]]
    _run(g, "DELETE { ?x n:name ?n } WHERE { ?x n:name ?n ; n:region <urn:tpch:Region:1> }")
    ids.append(S.snapshot(g, base, "after")["id"])
    pruned = S.prune(g, base, keep=2)["pruned"]
    _run(g, "CLEAR ALL")
    removed = S.diff(g, base, ids[1], ids[2])["removed"]
    return spark.createDataFrame([(len(S.snapshots(g, base)["snapshots"]), pruned, removed, S.restore(g, base, ids[2])["quads"])], "kept long, pruned long, removed long, restored long")


# refusals
def _reasons(spark, found: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame([(k, e["ok"], e.get("reason"), len(str(e.get("because", ""))) > 0) for k, e in found.items()], "what string, ok boolean, reason string, told boolean")


def _table_of(reasons: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', false, '{v}', true)" for k, v in reasons.items()) + ") t(what, ok, reason, told)"


@query("refusals_of_the_facade", _table_of({"parse": "sparql_parse_error", "form": "sparql_parse_error", "graph": "invalid_graph", "size": "invalid_graph", "row": "invalid_dsl", "blank": "invalid_dsl", "scope": "scope_kwarg_conflict", "overlap": "scope_read_write_overlap", "clear": "invalid_dsl"}))
def refusals_of_the_facade(spark, d):
    g = Graph(spark, mapped(spark, d, "Region"))
    return _reasons(
        spark,
        {
            "parse": g.select("SELECT ?x WHERE {"),
            "form": g.ask("SELECT ?x WHERE { ?x ?p ?o }"),
            "graph": g.select("SELECT ?x WHERE { ?x ?p ?o }", graph="_:b"),
            "size": g.store_size(graph="_:b"),
            "row": g.bulk_insert([("urn:a", "urn:p", 1), ("urn:a", "_:p", 1)]),
            "blank": g.bulk_insert([("urn:a", "urn:p", 1, "_:g")]),
            "scope": g.select("SELECT ?x WHERE { ?x ?p ?o }", graph="urn:g", scope=Scope("urn:h")),
            "overlap": g.select("SELECT ?x WHERE { ?x ?p ?o }", scope=Scope("urn:h", inferred="urn:h")),
            "clear": g.execute("CLEAR ALL", graph="urn:g"),
        },
    )


@query("graphs_validated", "SELECT n_name AS n, n_regionkey = 1 AS refused FROM nation")
def graphs_validated(spark, d):
    name = lambda r: ("_:" if r.n_regionkey == 1 else "urn:g:") + r.n_name.replace(" ", "")
    return spark.createDataFrame([(r.n_name, R.invalid_graph(None, name(r)) is not None) for r in _nations(spark, d)], "n string, refused boolean")


@query("reason_registry", "SELECT n, 1 AS k FROM (SELECT unnest(['no_blob', 'ir_invalid', 'invalid_dsl', 'invalid_graph', 'model_unknown', 'rule_set_unknown', 'reasoner_diverged', 'full_rebuild_required', 'non_monotonic_rule_set', 'dependency_index_unavailable']) AS n)")
def reason_registry(spark, d):
    known = {v for k, v in vars(R).items() if k.isupper()}
    wanted = {R.NO_BLOB, R.IR_INVALID, R.INVALID_DSL, R.INVALID_GRAPH, R.MODEL_UNKNOWN, R.RULE_SET_UNKNOWN, R.REASONER_DIVERGED, R.FULL_REBUILD_REQUIRED, R.NON_MONOTONIC_RULE_SET, R.DEPENDENCY_INDEX_UNAVAILABLE}
    made = [R.refused(v, "x") for v in sorted(wanted & known)]
    return spark.createDataFrame([(e["reason"], int(not e["ok"])) for e in made], "n string, k int")


# scopes
@query("scope_graph_sets", "SELECT 'read' AS role, 'urn:g:' || unnest(['data', 'shapes']) AS g UNION ALL SELECT 'write', 'urn:g:' || unnest(['inferred', 'report'])")
def scope_graph_sets(spark, d):
    s = Scope("urn:g:data", shapes="urn:g:shapes", inferred="urn:g:inferred", report="urn:g:report")
    return spark.createDataFrame([("read", g) for g in s.read_graphs] + [("write", g) for g in s.write_graphs], "role string, g string")


@query("scope_reads", "SELECT 'scope' AS by, COUNT(*) AS k FROM nation UNION ALL SELECT 'graph', COUNT(*) FROM nation UNION ALL SELECT 'none', COUNT(*) FROM region")
def scope_reads(spark, d):
    g = Graph(spark, mapped(spark, d, "Nation", "Region", graphs=_G))
    text = "SELECT ?x WHERE { ?x a ?c }"
    found = {"scope": g.select(text, scope=Scope("urn:g:nations")), "graph": g.select(text, graph="urn:g:nations"), "none": g.select(text)}
    return spark.createDataFrame([(k, len(e["results"])) for k, e in found.items()], "by string, k long")


# reasoning
@query("owl_fire_counts", "SELECT 'cax-sco' AS rule, 2 * COUNT(*) AS k, CAST(2 AS BIGINT) AS iterations FROM nation UNION ALL SELECT 'scm-sco', 5, 2")
def owl_fire_counts(spark, d):
    g = _reasoned(spark, d, _SUBS, ())
    _run(g, f"CLEAR GRAPH <{_I}>")
    env = reasoner.materialise(g, _A, _I, rules=reasoner.OWL_2_RL.only("cax-sco", "scm-sco"), provenance=False)
    return spark.createDataFrame([(k, n, env["iterations"]) for k, n in env["per_rule"].items()], "rule string, k long, iterations long")


@query("owl_custom_rules", f"SELECT 'urn:tpch:Region:' || n_regionkey AS s, '{_K}has' AS p, 'urn:tpch:Nation:' || n_nationkey AS o FROM nation UNION ALL SELECT 'urn:tpch:Nation:' || n_nationkey, '{_K}far', '{_K}World' FROM nation")
def owl_custom_rules(spark, d):
    g = _reasoned(spark, d, f"<{_K}x> <{_K}y> <{_K}z> .", ("scm-sco",))
    own = reasoner.RuleSet([reasoner.Rule("has", f"INSERT {{ ?r <{_K}has> ?n }} WHERE {{ ?n <{_K}in> ?r }}"), reasoner.Rule("far", f"INSERT {{ ?n <{_K}far> <{_K}World> }} WHERE {{ ?r <{_K}has> ?n }}")], "own")
    env = reasoner.materialise(g, _A, _I, rules=own, provenance=False)
    if not env["ok"]:
        raise RuntimeError(env["because"])
    return _inferred(g)


@query("owl_rule_texts", "SELECT id, premises FROM (VALUES ('prp-dom', 2), ('prp-trp', 3), ('cax-sco', 2), ('eq-sym', 1), ('prp-fp', 3)) t(id, premises)")
def owl_rule_texts(spark, d):
    wanted = ("prp-dom", "prp-trp", "cax-sco", "eq-sym", "prp-fp")
    return spark.createDataFrame([(i, len(reasoner.OWL_2_RL[i].premises)) for i in wanted], "id string, premises int")


@query("refusals_of_the_reasoner", _table_of({"set": "rule_set_unknown", "same": "invalid_dsl", "text": "invalid_dsl", "role": "scope_role_missing", "diverged": "reasoner_diverged", "other scope": "changeset_scope_mismatch_for_reasoner", "index": "invalid_dsl"}))
def refusals_of_the_reasoner(spark, d):
    g = _reasoned(spark, d, _SUBS, ("scm-sco",))
    with changeset.capture(Scope("urn:other", inferred=_I)) as other:
        pass
    with changeset.capture(Scope(_A, inferred=_I)) as own:
        pass
    bad = reasoner.RuleSet([reasoner.Rule("r", "SELECT ?x WHERE { ?x ?p ?o }")])
    return _reasons(
        spark,
        {
            "set": reasoner.materialise(g, _A, _I, rules="nope"),
            "same": reasoner.materialise(g, _A, _A),
            "text": reasoner.materialise(g, _A, _I, rules=bad),
            "role": reasoner.materialise(g, scope=Scope(_A)),
            "diverged": reasoner.materialise(g, _A, _I, rules=reasoner.OWL_2_RL.only("cax-sco"), max_iterations=1),
            "other scope": reasoner.dred(g, scope=Scope(_A, inferred=_I), changes=other),
            "index": reasoner.dred(g, scope=Scope(_A, inferred=_I), changes=own, dependency_index="nope"),
        },
    )


@query("dred_index_modes", "SELECT m AS mode, m <> 'sparql' AS dirty, (SELECT 2 * COUNT(*) FROM nation WHERE n_regionkey = 2) > 0 AS some FROM (VALUES ('sparql'), ('native'), ('auto')) v(m)")
def dred_index_modes(spark, d):
    out = []
    for mode in ("sparql", "native", "auto"):
        g = _reasoned(spark, d, f"<{_K}Nation2> rdfs:subClassOf <{_K}Place> .", ("cax-sco",), provenance=True)
        scope = Scope(_A, inferred=_I)
        with changeset.capture(scope) as changes:
            _run(g, f"DELETE DATA {{ <{_K}Nation2> rdfs:subClassOf <{_K}Place> }}", graph=_A)
        env = reasoner.dred(g, scope=scope, changes=changes, rules=reasoner.OWL_2_RL.only("cax-sco"), dependency_index=mode)
        out.append((mode, env["index_dirty"], env["over_deleted"] > 0))
    return spark.createDataFrame(out, "mode string, dirty boolean, some boolean")


# shapes
@query("shacl_datatype_messages", "SELECT 'urn:tpch:Customer:' || c_custkey AS x, true AS names_it FROM customer")
def shacl_datatype_messages(spark, d):
    g = Graph(spark, mapped(spark, d, "Customer", graphs={"Customer": "urn:data"}))
    shacl.load_shapes(g, _shapes("t:S a sh:NodeShape ; sh:targetClass t:Customer ; sh:property [ sh:path c:acctbal ; sh:datatype xsd:integer ] .") + "\n", scope="urn:shapes")
    return shacl.violations_df(g, "urn:data", "urn:shapes").select(T.c_lexical(F.col("focus_node")).alias("x"), (F.col("message").contains("double") & F.col("message").contains("integer")).alias("names_it"))


def _mixed(name: str, shape: str, component: str, where: str) -> None:
    """Customers of whom one in three was changed by an update, so that some conform and some do not."""

    @query(name, f"SELECT 'urn:tpch:Customer:' || c_custkey AS x, '{component}ConstraintComponent' AS component FROM customer WHERE {where}")
    def run(spark, d):
        rows = table(spark, d, "customer")
        odd = F.col("c_custkey") % 3 == 0
        m = emit.Mapping(subject("Customer", "c_custkey"), [emit.Triple(T.RDF + "type", f"<{NS}Customer>"), emit.Triple("urn:v", lambda df: F.when(odd, F.lit(f"<{NS}Thing>")).otherwise(F.concat(F.lit(f"<{NS}Nation:"), F.col("c_nationkey"), F.lit(">"))), iri=True), emit.Triple("urn:n", lambda df: F.col("c_acctbal"), guard=lambda df: odd), emit.Triple("urn:n", lambda df: F.col("c_custkey").cast("long"), guard=lambda df: ~odd), emit.Triple("urn:w", lambda df: F.col("c_name"), guard=lambda df: odd), emit.Triple("urn:w", f"<{NS}Thing>", guard=lambda df: ~odd)])
        quads = emit.quads(rows, m).withColumn("g", F.lit("urn:data"))
        types = emit.quads(table(spark, d, "nation"), emit.Mapping(subject("Nation", "n_nationkey"), [emit.Triple(T.RDF + "type", f"<{NS}Nation>")])).withColumn("g", F.lit("urn:data"))
        g = Graph(spark, quads.unionByName(types))
        env = shacl.load_shapes(g, _shapes(f"t:S a sh:NodeShape ; sh:targetClass t:Customer ; sh:property [ {shape} ] .") + "\n", scope="urn:shapes")
        if not env["ok"]:
            raise RuntimeError(env["because"])
        return shacl.violations_df(g, "urn:data", "urn:shapes").select(T.c_lexical(F.col("focus_node")).alias("x"), F.regexp_extract("source_constraint_component", "#(.*)>$", 1).alias("component"))


_mixed("shacl_class_mixed", "sh:path <urn:v> ; sh:class t:Nation", "Class", "c_custkey % 3 = 0")
_mixed("shacl_datatype_mixed", "sh:path <urn:n> ; sh:datatype xsd:integer", "Datatype", "c_custkey % 3 = 0")
_mixed("shacl_node_kind_mixed", "sh:path <urn:w> ; sh:nodeKind sh:Literal", "NodeKind", "c_custkey % 3 <> 0")


@query("shacl_custom_constraint", "SELECT 'urn:tpch:Customer:' || c_custkey AS x FROM customer WHERE c_name NOT LIKE '%7'")
def shacl_custom_constraint(spark, d):
    from .shacl.constraints import CORE, Constraint, ConstraintLibrary

    ends = Constraint("urn:EndsComponent", "ends", "urn:ends", lambda node, v: F.max(~F.coalesce(T.c_lexical(node).endswith(T.lexical(v)), F.lit(False))), lambda m, v: m, lambda m, v: F.lit("expected another ending"))
    g = Graph(spark, mapped(spark, d, "Customer", graphs={"Customer": "urn:data"}))
    shacl.load_shapes(g, _shapes('t:S a sh:NodeShape ; sh:targetClass t:Customer ; sh:property [ sh:path c:name ; <urn:ends> "7" ] .') + "\n", scope="urn:shapes")
    found = shacl.violations_df(g, "urn:data", "urn:shapes", CORE + ConstraintLibrary([ends]))
    return found.select(T.c_lexical(F.col("focus_node")).alias("x"))


@query("rule_failure_warns", "SELECT COUNT(*) AS derived, CAST(1 AS BIGINT) AS warnings FROM customer")
def rule_failure_warns(spark, d):
    g = Graph(spark, mapped(spark, d, "Customer", graphs={"Customer": "urn:data"}))
    body = 't:S a sh:NodeShape ; sh:targetClass t:Customer ; sh:rule t:R1 , t:R2 . t:R1 a sh:TripleRule ; sh:subject sh:this ; sh:predicate t:status ; sh:object "active" . t:R2 a sh:SPARQLRule ; sh:construct "CONSTRUCT { ?this <urn:x> WHERE" .'
    shacl.load_shapes(g, _shapes(body) + "\n", scope="urn:shapes")
    env = shacl.rules.materialise(g, "urn:data", "urn:shapes", "urn:out")
    return spark.createDataFrame([(env["derived"], len(env["warnings"]))], "derived long, warnings long")


# emission and durable graphs
def _segments(spark, d):
    customers = table(spark, d, "customer")
    words = emit.Each(lambda df: F.filter(F.split("c_mktsegment", "I"), lambda x: x != ""), "urn:word")
    return customers, emit.Mapping(subject("Customer", "c_custkey"), [emit.Triple("urn:segment", lambda df: F.col("c_mktsegment"))], each=[words])


@query("emit_empty_each_keeps", "SELECT 'urn:tpch:Customer:' || c_custkey AS s, unnest(list_filter(string_split(c_mktsegment, 'I'), lambda x: x <> '')) AS o FROM customer")
def emit_empty_each_keeps(spark, d):
    customers, m = _segments(spark, d)
    g = Graph(spark)
    emit.save(g, customers, m)
    emit.save(g, customers.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("I")), m)
    return g.select_df("SELECT ?s ?o WHERE { ?s <urn:word> ?o }", types={"s": "iri", "o": "string"})


@query("emit_dispatch_modes", "SELECT m AS mode, COUNT(*) AS k, COUNT(DISTINCT c_mktsegment) AS segments FROM customer, (VALUES ('sparql_update'), ('bulk'), ('per_call')) v(m) GROUP BY m")
def emit_dispatch_modes(spark, d):
    customers, m = _segments(spark, d)
    out = []
    for mode in emit.DISPATCH_MODES:
        g = Graph(spark)
        emit.save(g, customers, m, mode=mode)
        out.append(g.select_df("SELECT (COUNT(*) AS ?k) (COUNT(DISTINCT ?o) AS ?segments) WHERE { ?s <urn:segment> ?o }", types={"k": "long", "segments": "long"}).withColumn("mode", F.lit(mode)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("emit_strict_mode", "SELECT 'invalid_dsl' AS reason, true AS raised")
def emit_strict_mode(spark, d):
    import os

    from .config import ENV_STRICT

    customers, m = _segments(spark, d)
    reason, had = emit.save(Graph(spark), customers, m, mode="nope")["reason"], os.environ.get(ENV_STRICT)
    os.environ[ENV_STRICT] = "1"
    try:
        emit.save(Graph(spark), customers, m, mode="nope")
        raised = False
    except emit.Refused:
        raised = True
    finally:
        os.environ.pop(ENV_STRICT) if had is None else os.environ.__setitem__(ENV_STRICT, had)
    return spark.createDataFrame([(reason, raised)], "reason string, raised boolean")


@query("ethereal_calls", "SELECT 3 * COUNT(*) AS inserted, 'already_hydrated' AS again, CAST(0 AS BIGINT) AS left_over, 3 * COUNT(*) AS anew, 'no_blob' AS missing FROM nation")
def ethereal_calls(spark, d):
    from .ethereal import EtherealGraph
    from .sources.blobs import MemoryBlob

    iri, blob = f"urn:g:{uuid.uuid4().hex}", MemoryBlob()
    EtherealGraph(Graph(spark, mapped(spark, d, "Nation", graphs={"Nation": iri})), iri, blob).checkpoint()
    g = Graph(spark)
    e = EtherealGraph(g, iri, blob)
    inserted, again = e.hydrate()["inserted"], e.hydrate()["reason"]
    e.retract()
    left = g.store_size(graph=iri)["count"]
    anew = e.hydrate()["inserted"]
    e.evict()
    return spark.createDataFrame([(inserted, again, left, anew, EtherealGraph(g, "urn:g:none", MemoryBlob()).hydrate()["reason"])], "inserted long, again string, left_over long, anew long, missing string")


@query("ethereal_folder", f"SELECT {C} AS x, c_name AS n, c_acctbal AS b FROM customer")
def ethereal_folder(spark, d):
    """Customers by way of a folder of N-Triples that tasks write and read."""
    from .ethereal import EtherealGraph
    from .sources.blobs import FolderBlob

    iri, blob = f"urn:g:{uuid.uuid4().hex}", FolderBlob(spark, _folder(spark, "blob"))
    EtherealGraph(Graph(spark, mapped(spark, d, "Customer", graphs={"Customer": iri})), iri, blob).checkpoint()
    g = Graph(spark)
    EtherealGraph(g, iri, blob).hydrate()
    blob.purge()
    return g.select_df(PREFIX + f"SELECT ?x ?n ?b WHERE {{ GRAPH <{iri}> {{ ?x c:name ?n ; c:acctbal ?b }} }}", types={"x": "iri", "n": "string", "b": "double"})


# query algebra
@query("ir_refusals", _table_of({"empty": "ir_invalid", "no find": "ir_invalid", "offset": "ir_invalid", "count": "ir_invalid", "op": "ir_invalid", "model": "model_unknown", "column": "ar_query_error", "backend": "unknown_backend", "capability": "backend_missing_capability", "none loaded": "ar_not_loaded"}))
def ir_refusals(spark, d):
    ctx = _context(spark, d, False)
    rel = {"backend": "relational"}
    return _reasons(
        spark,
        {
            "empty": ir.run(ctx, []),
            "no find": ir.run(ctx, [ir.Limit(1)]),
            "offset": ir.run(ctx, [ir.Find("Part"), ir.Offset(1)]),
            "count": ir.run(ctx, [ir.Find("Part"), ir.Count(), ir.Limit(1)]),
            "op": ir.run(ctx, [ir.Find("Part"), ir.Filter("p_size", "like", 1)]),
            "model": ir.run(ctx, [ir.Find("Nope")], **rel),
            "column": ir.run(ctx, [ir.Find("Part"), ir.Filter("nope", "eq", 1)], **rel),
            "backend": ir.run(ctx, [ir.Find("Part")], backend="nope"),
            "capability": ir.run(ctx, [ir.Find("Part")], backend="relational", needs=("shacl",)),
            "none loaded": ir.run(ir.QueryContext(), [ir.Find("Part")], **rel),
        },
    )


@query("ir_run_meta", "SELECT b AS backend, (SELECT COUNT(*) FROM part WHERE p_size < 3) AS k, b = 'sparql' AS planned, true AS timed FROM (VALUES ('sparql'), ('relational')) v(b)")
def ir_run_meta(spark, d):
    out = []
    for backend, graph_plane in (("sparql", True), ("relational", False)):
        env = ir.run(_context(spark, d, graph_plane), [ir.Find("Part"), ir.Filter("p_size", "lt", 3), ir.Project(["p_size"])], backend=backend, with_meta=True)
        out.append((env["backend"], len(env["results"]), env["plan"] is not None, env["ms"] > 0))
    return spark.createDataFrame(out, "backend string, k long, planned boolean, timed boolean")


@query("ir_routes", "SELECT * FROM (VALUES ('hint', 'relational'), ('needs graphs', 'sparql'), ('needs joins', 'relational'), ('module', 'relational')) t(what, backend)")
def ir_routes(spark, d):
    nodes = [ir.Find("Part")]
    found = {"hint": router.pick(nodes, "relational"), "needs graphs": router.pick(nodes, needs=("named_graphs",)), "needs joins": router.pick(nodes, needs={"joins": "ar"}), "module": router.pick(nodes, relational_backend)}
    return spark.createDataFrame([(k, b.NAME) for k, b in found.items()], "what string, backend string")


@query("backend_capabilities", "SELECT * FROM (VALUES ('relational', 'joins', 'ar'), ('relational', 'named_graphs', 'False'), ('relational', 'owl_closure', 'False'), ('relational', 'shacl', 'False'), ('sparql', 'named_graphs', 'True'), ('sparql', 'owl_closure', 'True'), ('sparql', 'shacl', 'True')) t(backend, capability, value)")
def backend_capabilities(spark, d):
    rows = [(b.NAME, k, str(v)) for b in (sparql_backend, relational_backend) for k, v in b.CAPABILITIES.items() if k in ("named_graphs", "owl_closure", "shacl") or b is relational_backend and k == "joins"]
    return spark.createDataFrame(rows, "backend string, capability string, value string")


@query("capabilities", "SELECT * FROM (VALUES ('star writes', true), ('plain round trip', true), ('star round trip', true), ('select', true), ('nope', false), ('engine', true), ('facade', true)) t(what, has)")
def capabilities_of(spark, d):
    found = {
        "star writes": capabilities.rdf_star_writes_enabled(),
        "plain round trip": capabilities.checkpoint_can_round_trip("plain_ntriples"),
        "star round trip": capabilities.checkpoint_can_round_trip("ntriples_star"),
        "select": capabilities.sparql_method_available("select"),
        "nope": capabilities.sparql_method_available("nope"),
        "engine": capabilities.engine_version(spark) == f"spark-{spark.version}",
        "facade": bool(capabilities.facade_version()),
    }
    return spark.createDataFrame(list(found.items()), "what string, has boolean")


@query("schema_foreign_keys", "SELECT CAST(2 AS BIGINT) AS classes, CAST(5 AS BIGINT) AS datatype_properties, CAST(1 AS BIGINT) AS object_properties, 'urn:n:Region' AS target")
def schema_foreign_keys(spark, d):
    from . import schema

    regions = table(spark, d, "region").withColumnsRenamed({"r_regionkey": "id", "r_name": "name"}).select("id", "name")
    nations = table(spark, d, "nation").withColumnsRenamed({"n_nationkey": "id", "n_name": "name", "n_regionkey": "region_id"}).withColumn("size", F.lit(1)).select("id", "name", "size", "region_id")
    g = Graph(spark)
    env = schema.normalize(g, {"regions": regions, "nations": nations}, iri_prefix="urn:n:", schema_graph="urn:schema")
    capabilities.reset_schema_normalization()
    target = g.select(f"SELECT ?t WHERE {{ ?p a <{T.OWL}ObjectProperty> ; <{T.RDFS}range> ?t }}", graph="urn:schema")["results"][0]["t"]
    return spark.createDataFrame([(env["classes"], env["datatype_properties"], env["object_properties"], target.strip("<>"))], "classes long, datatype_properties long, object_properties long, target string")

"""Queries over the driver's tables, one or more per operator, with DuckDB SQL that must give the same rows.

Tables are mapped to quads lazily; nothing is written to answer a read-only query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import emit, ir, reasoner, shacl
from .functions import terms as T
from .graph import Graph
from .ir import relational_backend, sparql_backend


NS = "urn:tpch:"
PREFIX = f"PREFIX t: <{NS}> PREFIX c: <{NS}Customer/> PREFIX o: <{NS}Order/> PREFIX p: <{NS}Part/> PREFIX n: <{NS}Nation/> PREFIX r: <{NS}Region/> PREFIX s: <{NS}Supplier/> PREFIX d: <{NS}Document/> PREFIX l: <{NS}Label/> PREFIX rdfs: <{T.RDFS}> PREFIX owl: <{T.OWL}> PREFIX xsd: <{T.XSD}> "

#: model: (table, key, {predicate: column}, {predicate: (column, model of the object)})
MODELS = {
    "Region": ("region", "r_regionkey", {"name": "r_name"}, {}),
    "Nation": ("nation", "n_nationkey", {"name": "n_name"}, {"region": ("n_regionkey", "Region")}),
    "Customer": ("customer", "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment"}, {"nation": ("c_nationkey", "Nation")}),
    "Supplier": ("supplier", "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal"}, {"nation": ("s_nationkey", "Nation")}),
    "Part": ("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}, {}),
    "Order": ("orders", "o_orderkey", {"status": "o_orderstatus", "total": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority"}, {"customer": ("o_custkey", "Customer")}),
    "Document": ("documents", "doc_id", {"lang": "lang", "source": "source", "n_chars": "n_chars"}, {}),
    "Label": ("labels", "doc_id", {"quality": "quality", "toxic": "toxic"}, {}),
}
OBJECT_MODEL = {"Label": "Document"}  # labels say more about documents


def subject(model: str, column: str) -> Callable[[DataFrame], object]:
    return lambda df: F.concat(F.lit(f"{NS}{OBJECT_MODEL.get(model, model)}:"), F.col(column).cast("string"))


def mapping(model: str, graph: str | None = None) -> emit.Mapping:
    _, key, values, links = MODELS[model]
    triples = [emit.Triple(T.RDF + "type", f"<{NS}{model}>")]
    triples += [emit.Triple(f"{NS}{model}/{p}", (lambda c: lambda df: F.col(c))(c)) for p, c in values.items()]
    triples += [emit.Triple(f"{NS}{model}/{p}", subject(m, c), iri=True) for p, (c, m) in links.items()]
    return emit.Mapping(subject(model, key), triples, graph=graph)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def mapped(spark: SparkSession, d: str, *models: str, graphs: dict[str, str] | None = None) -> DataFrame:
    out = None
    for m in models:
        q = emit.quads(table(spark, d, MODELS[m][0]), mapping(m, (graphs or {}).get(m)))
        out = q if out is None else out.unionByName(q)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def sparql(name: str, models: str, text: str, types: str, sql: str, graph: str | None = None, graphs: dict[str, str] | None = None) -> None:
    """Registers a SELECT over mapped tables. types: `var:decoder ...`."""
    decoded = dict(x.split(":") for x in types.split())

    def run(spark: SparkSession, d: str) -> DataFrame:
        return Graph(spark, mapped(spark, d, *models.split(), graphs=graphs)).select_df(PREFIX + text, graph, decoded)

    QUERIES[name], ORACLE_SQL[name] = run, sql


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


C = "'urn:tpch:Customer:' || c_custkey"

# scans, filters, projections
sparql("bgp_type_scan", "Region Nation", "SELECT ?s WHERE { ?s a t:Nation }", "s:iri", "SELECT 'urn:tpch:Nation:' || n_nationkey AS s FROM nation")
sparql("filter_eq", "Customer", 'SELECT ?s WHERE { ?s c:segment ?m FILTER(?m = "BUILDING") }', "s:iri", f"SELECT {C} AS s FROM customer WHERE c_mktsegment = 'BUILDING'")
sparql("filter_neq", "Customer", 'SELECT ?s ?m WHERE { ?s c:segment ?m FILTER(?m != "BUILDING") }', "s:iri m:string", f"SELECT {C} AS s, c_mktsegment AS m FROM customer WHERE c_mktsegment <> 'BUILDING'")
sparql("filter_lt", "Customer", "SELECT ?s ?b WHERE { ?s c:acctbal ?b FILTER(?b < 100) }", "s:iri b:double", f"SELECT {C} AS s, c_acctbal AS b FROM customer WHERE c_acctbal < 100")
sparql("filter_range_incl", "Part", "SELECT ?s ?z WHERE { ?s p:size ?z FILTER(?z >= 10 && ?z <= 20) }", "s:iri z:long", "SELECT 'urn:tpch:Part:' || p_partkey AS s, CAST(p_size AS BIGINT) AS z FROM part WHERE p_size BETWEEN 10 AND 20")
sparql("filter_range_excl", "Part", "SELECT ?s ?z WHERE { ?s p:size ?z FILTER(?z > 10 && ?z < 20) }", "s:iri z:long", "SELECT 'urn:tpch:Part:' || p_partkey AS s, CAST(p_size AS BIGINT) AS z FROM part WHERE p_size > 10 AND p_size < 20")
sparql("filter_in", "Customer", 'SELECT ?s ?m WHERE { ?s c:segment ?m FILTER(?m IN ("BUILDING", "MACHINERY")) }', "s:iri m:string", f"SELECT {C} AS s, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
sparql("filter_and_or_not", "Customer", 'SELECT ?s WHERE { ?s c:segment ?m ; c:acctbal ?b FILTER((?m = "BUILDING" || ?b > 9000) && !(?b < 0)) }', "s:iri", f"SELECT {C} AS s FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 9000) AND NOT c_acctbal < 0")
sparql("filter_regex", "Customer", 'SELECT ?s WHERE { ?s c:name ?n FILTER REGEX(?n, "0[1-3]$") }', "s:iri", f"SELECT {C} AS s FROM customer WHERE regexp_matches(c_name, '0[1-3]$')")
sparql("select_star", "Nation", "SELECT * WHERE { ?na n:name ?name ; n:region ?reg }", "na:iri name:string reg:iri", "SELECT 'urn:tpch:Nation:' || n_nationkey AS na, n_name AS name, 'urn:tpch:Region:' || n_regionkey AS reg FROM nation")
sparql("project_expr", "Part", "SELECT ?s (?z * 2 + 1 AS ?w) WHERE { ?s p:size ?z }", "s:iri w:long", "SELECT 'urn:tpch:Part:' || p_partkey AS s, CAST(p_size * 2 + 1 AS BIGINT) AS w FROM part")
sparql("bind_expr", "Part", 'SELECT ?s ?k WHERE { ?s p:brand ?b ; p:size ?z BIND(CONCAT(?b, "/", STR(?z)) AS ?k) FILTER(?z < 5) }', "s:iri k:string", "SELECT 'urn:tpch:Part:' || p_partkey AS s, p_brand || '/' || p_size AS k FROM part WHERE p_size < 5")
sparql("distinct_values", "Customer", "SELECT DISTINCT ?m WHERE { ?s c:segment ?m }", "m:string", "SELECT DISTINCT c_mktsegment AS m FROM customer")
sparql("same_variable_twice", "Nation Customer", "SELECT ?a ?b WHERE { ?a n:region ?g . ?b n:region ?g FILTER(STR(?a) < STR(?b)) }", "a:iri b:iri", "SELECT 'urn:tpch:Nation:' || x.n_nationkey AS a, 'urn:tpch:Nation:' || y.n_nationkey AS b FROM nation x JOIN nation y USING (n_regionkey) WHERE 'urn:tpch:Nation:' || x.n_nationkey < 'urn:tpch:Nation:' || y.n_nationkey")

# joins
sparql("join_two_hop", "Customer Nation Region", "SELECT ?s ?rn WHERE { ?s c:nation/n:region ?g . ?g r:name ?rn }", "s:iri rn:string", f"SELECT {C} AS s, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("join_star", "Customer", "SELECT ?s ?n ?b ?m WHERE { ?s c:name ?n ; c:acctbal ?b ; c:segment ?m }", "s:iri n:string b:double m:string", f"SELECT {C} AS s, c_name AS n, c_acctbal AS b, c_mktsegment AS m FROM customer")
sparql("join_triangle", "Customer Supplier Nation", "SELECT ?na (COUNT(*) AS ?k) WHERE { ?x c:nation ?na . ?y s:nation ?na . ?na n:name ?nn } GROUP BY ?na", "na:iri k:long", "SELECT 'urn:tpch:Nation:' || n_nationkey AS na, COUNT(*) AS k FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
sparql("join_var_predicate", "Region", "SELECT ?s ?p ?o WHERE { ?s ?p ?o }", "s:iri p:iri o:string", "SELECT 'urn:tpch:Region:' || r_regionkey AS s, 'urn:tpch:Region/name' AS p, r_name AS o FROM region UNION ALL SELECT 'urn:tpch:Region:' || r_regionkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:tpch:Region' FROM region")
sparql("optional_label", "Document Label", "SELECT ?x ?q WHERE { ?x d:lang ?l OPTIONAL { ?x l:quality ?q } }", "x:iri q:long", "SELECT 'urn:tpch:Document:' || d.doc_id AS x, CAST(quality AS BIGINT) AS q FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id")
sparql("optional_filter_inside", "Document Label", "SELECT ?x ?q WHERE { ?x d:lang ?l OPTIONAL { ?x l:quality ?q FILTER(?q = 1) } }", "x:iri q:long", "SELECT 'urn:tpch:Document:' || d.doc_id AS x, CAST(quality AS BIGINT) AS q FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id AND quality = 1")
sparql("optional_filter_outer", "Document Label", "SELECT ?x WHERE { ?x d:lang ?l OPTIONAL { ?x l:quality ?q } FILTER(!BOUND(?q)) }", "x:iri", "SELECT 'urn:tpch:Document:' || doc_id AS x FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
sparql("union_two", "Customer Supplier", "SELECT ?x ?n WHERE { { ?x c:name ?n } UNION { ?x s:name ?n } }", "x:iri n:string", f"SELECT {C} AS x, c_name AS n FROM customer UNION ALL SELECT 'urn:tpch:Supplier:' || s_suppkey, s_name FROM supplier")
sparql("union_misaligned", "Customer Supplier", "SELECT ?x ?m ?b WHERE { { ?x c:segment ?m } UNION { ?x s:acctbal ?b } }", "x:iri m:string b:double", f"SELECT {C} AS x, c_mktsegment AS m, NULL::DOUBLE AS b FROM customer UNION ALL SELECT 'urn:tpch:Supplier:' || s_suppkey, NULL, s_acctbal FROM supplier")
sparql("minus_labelled", "Document Label", "SELECT ?x WHERE { ?x a t:Document MINUS { ?x l:toxic ?t } }", "x:iri", "SELECT 'urn:tpch:Document:' || doc_id AS x FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
sparql("exists_order", "Customer Order", 'SELECT ?x WHERE { ?x a t:Customer FILTER EXISTS { ?y o:customer ?x ; o:status "F" } }', "x:iri", f"SELECT {C} AS x FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
sparql("not_exists_order", "Customer Order", "SELECT ?x WHERE { ?x a t:Customer FILTER NOT EXISTS { ?y o:customer ?x } }", "x:iri", f"SELECT {C} AS x FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
sparql("exists_in_expression", "Customer Order", 'SELECT ?x WHERE { ?x c:segment ?m FILTER(?m = "BUILDING" || EXISTS { ?y o:customer ?x ; o:status "P" }) }', "x:iri", f"SELECT {C} AS x FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
sparql("values_join", "Customer", 'SELECT ?s ?m ?w WHERE { VALUES (?m ?w) { ("BUILDING" 1) ("MACHINERY" 2) } ?s c:segment ?m }', "s:iri m:string w:long", f"SELECT {C} AS s, c_mktsegment AS m, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 2 END AS BIGINT) AS w FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_G = {"Customer": "urn:g:customers", "Nation": "urn:g:nations"}
sparql("graph_scoped", "Customer Nation Region", "SELECT ?x ?n WHERE { ?x c:name ?n }", "x:iri n:string", f"SELECT {C} AS x, c_name AS n FROM customer", graph="urn:g:customers", graphs=_G)
sparql("graph_variable", "Customer Nation Region", "SELECT ?g (COUNT(*) AS ?k) WHERE { GRAPH ?g { ?x ?p ?y } } GROUP BY ?g", "g:iri k:long", "SELECT 'urn:g:customers' AS g, 5 * COUNT(*) AS k FROM customer UNION ALL SELECT 'urn:g:nations', 3 * COUNT(*) FROM nation", graphs=_G)
sparql("graph_join_default", "Customer Nation Region", "SELECT ?n ?rn WHERE { GRAPH <urn:g:nations> { ?x n:name ?n ; n:region ?g } ?g r:name ?rn }", "n:string rn:string", "SELECT n_name AS n, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey", graphs=_G)
sparql("from_merge", "Customer Nation Region", "SELECT (COUNT(*) AS ?k) FROM <urn:g:customers> FROM <urn:g:nations> WHERE { ?x c:nation ?y . ?y n:name ?n }", "k:long", "SELECT COUNT(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey", graphs=_G)
sparql("subselect", "Customer Order", "SELECT ?x ?k WHERE { ?x c:segment \"BUILDING\" { SELECT ?x (COUNT(?y) AS ?k) WHERE { ?y o:customer ?x } GROUP BY ?x } }", "x:iri k:long", f"SELECT {C} AS x, COUNT(*) AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")

# aggregates
sparql("count_star", "Order", "SELECT (COUNT(*) AS ?k) WHERE { ?x a t:Order }", "k:long", "SELECT COUNT(*) AS k FROM orders")
sparql("count_by_group", "Customer Nation Region", "SELECT ?rn (COUNT(?x) AS ?k) WHERE { ?x a t:Customer ; c:nation ?na . ?na n:region ?g . ?g r:name ?rn } GROUP BY ?rn ORDER BY ?rn", "rn:string k:long", "SELECT r_name AS rn, COUNT(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("count_distinct", "Customer", "SELECT ?m (COUNT(DISTINCT ?na) AS ?k) WHERE { ?x c:segment ?m ; c:nation ?na } GROUP BY ?m", "m:string k:long", "SELECT c_mktsegment AS m, COUNT(DISTINCT c_nationkey) AS k FROM customer GROUP BY 1")
sparql("sum_avg_min_max", "Part", "SELECT ?b (SUM(?z) AS ?total) (MIN(?z) AS ?lo) (MAX(?z) AS ?hi) (COUNT(?z) AS ?k) WHERE { ?x p:brand ?b ; p:size ?z } GROUP BY ?b", "b:string total:long lo:long hi:long k:long", "SELECT p_brand AS b, CAST(SUM(p_size) AS BIGINT) AS total, CAST(MIN(p_size) AS BIGINT) AS lo, CAST(MAX(p_size) AS BIGINT) AS hi, COUNT(*) AS k FROM part GROUP BY 1")
sparql("avg_rounded", "Part", "SELECT ?b (ROUND(AVG(?z) * 1000) AS ?mean) WHERE { ?x p:brand ?b ; p:size ?z } GROUP BY ?b", "b:string mean:double", "SELECT p_brand AS b, FLOOR(AVG(p_size) * 1000 + 0.5) AS mean FROM part GROUP BY 1")
sparql("group_concat_sorted", "Nation Region", 'SELECT ?g (GROUP_CONCAT(?n; SEPARATOR=",") AS ?names) WHERE { ?x n:region ?g ; n:name ?n } GROUP BY ?g', "g:iri names:string", "SELECT 'urn:tpch:Region:' || n_regionkey AS g, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
sparql("having_min", "Order", "SELECT ?x (COUNT(*) AS ?k) WHERE { ?y o:customer ?x } GROUP BY ?x HAVING(COUNT(*) >= 12)", "x:iri k:long", "SELECT 'urn:tpch:Customer:' || o_custkey AS x, COUNT(*) AS k FROM orders GROUP BY 1 HAVING COUNT(*) >= 12")
sparql("count_empty", "Region", "SELECT (COUNT(?x) AS ?k) (SUM(?x) AS ?t) WHERE { ?x a t:Nothing }", "k:long t:long", "SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS t")
sparql("sample_group", "Customer", "SELECT ?m (SAMPLE(?m) AS ?one) WHERE { ?x c:segment ?m } GROUP BY ?m", "m:string one:string", "SELECT DISTINCT c_mktsegment AS m, c_mktsegment AS one FROM customer")
sparql("group_by_expression", "Part", "SELECT ?h (COUNT(*) AS ?k) WHERE { ?x p:size ?z } GROUP BY (FLOOR(?z / 10) AS ?h)", "h:double k:long", "SELECT FLOOR(p_size / 10.0)::DOUBLE AS h, COUNT(*) AS k FROM part GROUP BY 1")

# order and slices
sparql("order_multi", "Customer", "SELECT ?m ?n WHERE { ?x c:segment ?m ; c:name ?n } ORDER BY DESC(?m) ?n", "m:string n:string", "SELECT c_mktsegment AS m, c_name AS n FROM customer ORDER BY m DESC, n")
sparql("limit_topk", "Customer", "SELECT ?x ?b WHERE { ?x c:acctbal ?b } ORDER BY DESC(?b) ?x LIMIT 10", "x:iri b:double", f"SELECT {C} AS x, c_acctbal AS b FROM customer ORDER BY b DESC, x LIMIT 10")
sparql("offset_page", "Customer", "SELECT ?x ?n WHERE { ?x c:name ?n } ORDER BY ?n ?x LIMIT 10 OFFSET 20", "x:iri n:string", f"SELECT {C} AS x, c_name AS n FROM customer ORDER BY n, x LIMIT 10 OFFSET 20")

# functions
sparql("fn_string", "Nation", 'SELECT ?x (UCASE(?n) AS ?u) (LCASE(?n) AS ?lo) (STRLEN(?n) AS ?len) (SUBSTR(?n, 2, 3) AS ?sub) (CONTAINS(?n, "A") AS ?has) (STRSTARTS(?n, "A") AS ?st) (STRENDS(?n, "A") AS ?en) (STRBEFORE(?n, "A") AS ?be) (STRAFTER(?n, "A") AS ?af) (REPLACE(?n, "A", "-") AS ?re) WHERE { ?x n:name ?n }', "x:iri u:string lo:string len:long sub:string has:boolean st:boolean en:boolean be:string af:string re:string", "SELECT 'urn:tpch:Nation:' || n_nationkey AS x, upper(n_name) AS u, lower(n_name) AS lo, length(n_name) AS len, substr(n_name, 2, 3) AS sub, contains(n_name, 'A') AS has, starts_with(n_name, 'A') AS st, ends_with(n_name, 'A') AS en, CASE WHEN contains(n_name, 'A') THEN split_part(n_name, 'A', 1) ELSE '' END AS be, CASE WHEN contains(n_name, 'A') THEN substr(n_name, strpos(n_name, 'A') + 1) ELSE '' END AS af, replace(n_name, 'A', '-') AS re FROM nation")
sparql("fn_math", "Customer", "SELECT ?x (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) WHERE { ?x c:acctbal ?b }", "x:iri a:double c:double f:double r:double", f"SELECT {C} AS x, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r FROM customer")
sparql("fn_date_parts", "Order", "SELECT ?x (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) WHERE { ?x o:date ?d }", "x:iri y:long m:long dd:long h:long", "SELECT 'urn:tpch:Order:' || o_orderkey AS x, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h FROM orders")
sparql("fn_if_coalesce", "Document Label", 'SELECT ?x (IF(BOUND(?q), "yes", "no") AS ?has) (COALESCE(?q, -1) AS ?v) WHERE { ?x d:lang ?l OPTIONAL { ?x l:quality ?q } }', "x:iri has:string v:long", "SELECT 'urn:tpch:Document:' || d.doc_id AS x, CASE WHEN quality IS NULL THEN 'no' ELSE 'yes' END AS has, CAST(coalesce(quality, -1) AS BIGINT) AS v FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id")
sparql("fn_hash", "Nation", "SELECT ?x (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x n:name ?n }", "x:iri a:string b:string c:string", "SELECT 'urn:tpch:Nation:' || n_nationkey AS x, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation")
sparql("fn_typecheck", "Nation", "SELECT ?p ?i ?l ?n (COUNT(*) AS ?k) WHERE { ?x ?p ?o } GROUP BY ?p (isIRI(?o) AS ?i) (isLiteral(?o) AS ?l) (isNumeric(?o) AS ?n)", "p:iri i:boolean l:boolean n:boolean k:long", "SELECT 'urn:tpch:Nation/name' AS p, false AS i, true AS l, false AS n, COUNT(*) AS k FROM nation UNION ALL SELECT 'urn:tpch:Nation/region', true, false, false, COUNT(*) FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', true, false, false, COUNT(*) FROM nation")
sparql("fn_cast_datatype", "Part", "SELECT ?x (xsd:integer(?r) AS ?i) (DATATYPE(?z) AS ?t) WHERE { ?x p:price ?r ; p:size ?z }", "x:iri i:long t:iri", "SELECT 'urn:tpch:Part:' || p_partkey AS x, CAST(trunc(p_retailprice) AS BIGINT) AS i, 'http://www.w3.org/2001/XMLSchema#integer' AS t FROM part")
sparql("fn_iri_replace", "Nation", 'SELECT ?y WHERE { ?x a t:Nation BIND(IRI(REPLACE(STR(?x), "Nation", "Country")) AS ?y) }', "y:iri", "SELECT 'urn:tpch:Country:' || n_nationkey AS y FROM nation")
sparql("fn_encode_lang", "Nation", 'SELECT ?x (ENCODE_FOR_URI(?n) AS ?e) (LANG(STRLANG(?n, "en")) AS ?l) (LANGMATCHES("en-US", "en") AS ?m) WHERE { ?x n:name ?n }', "x:iri e:string l:string m:boolean", "SELECT 'urn:tpch:Nation:' || n_nationkey AS x, replace(n_name, ' ', '%20') AS e, 'en' AS l, true AS m FROM nation")


@query("typed_cells", "SELECT c_acctbal AS value, 'literal' AS kind, 'http://www.w3.org/2001/XMLSchema#double' AS datatype, 'urn:tpch:Customer:' || c_custkey AS x FROM customer")
def typed_cells(spark, d):
    df = Graph(spark, mapped(spark, d, "Customer")).select_df(PREFIX + "SELECT ?x ?b WHERE { ?x c:acctbal ?b }", types={"x": "iri", "b": "cell"})
    return df.select(F.col("b.value").try_cast("double").alias("value"), F.col("b.kind").alias("kind"), F.col("b.datatype").alias("datatype"), "x")


# paths
sparql("path_sequence", "Customer Nation Region", "SELECT ?x ?rn WHERE { ?x c:nation/n:region/r:name ?rn }", "x:iri rn:string", f"SELECT {C} AS x, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("path_inverse", "Nation Region", "SELECT ?g ?x WHERE { ?g ^n:region ?x }", "g:iri x:iri", "SELECT 'urn:tpch:Region:' || n_regionkey AS g, 'urn:tpch:Nation:' || n_nationkey AS x FROM nation")
sparql("path_alternative", "Customer Supplier", "SELECT ?x ?na WHERE { ?x (c:nation|s:nation) ?na }", "x:iri na:iri", f"SELECT {C} AS x, 'urn:tpch:Nation:' || c_nationkey AS na FROM customer UNION ALL SELECT 'urn:tpch:Supplier:' || s_suppkey, 'urn:tpch:Nation:' || s_nationkey FROM supplier")
sparql("path_negated", "Nation", "SELECT ?x ?y WHERE { ?x !(n:name|rdf:type) ?y }".replace("rdf:type", f"<{T.RDF}type>"), "x:iri y:iri", "SELECT 'urn:tpch:Nation:' || n_nationkey AS x, 'urn:tpch:Region:' || n_regionkey AS y FROM nation")
sparql("path_plus", "Customer Nation Region", "SELECT ?x ?y WHERE { ?x (c:nation|n:region)+ ?y }", "x:iri y:iri", f"SELECT {C} AS x, 'urn:tpch:Nation:' || c_nationkey AS y FROM customer UNION SELECT {C}, 'urn:tpch:Region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'urn:tpch:Nation:' || n_nationkey, 'urn:tpch:Region:' || n_regionkey FROM nation")
sparql("path_star", "Nation Region", "SELECT ?y WHERE { <urn:tpch:Nation:3> n:region* ?y }", "y:iri", "SELECT 'urn:tpch:Nation:3' AS y UNION SELECT 'urn:tpch:Region:' || n_regionkey FROM nation WHERE n_nationkey = 3")
sparql("path_optional", "Nation Region", "SELECT ?x ?y WHERE { ?x a t:Nation ; n:region? ?y }", "x:iri y:iri", "SELECT 'urn:tpch:Nation:' || n_nationkey AS x, 'urn:tpch:Nation:' || n_nationkey AS y FROM nation UNION SELECT 'urn:tpch:Nation:' || n_nationkey, 'urn:tpch:Region:' || n_regionkey FROM nation")


# quoted triples
def _annotated(spark, d) -> Graph:
    _, key, _, _ = MODELS["Nation"]
    m = emit.Mapping(subject("Nation", key), [emit.Triple(NS + "Nation/name", lambda df: F.col("n_name")).annotate(NS + "confidence", lambda df: F.col("n_nationkey") * 2).annotate(NS + "by", "loader", lambda df: F.col("n_nationkey") < 5)])
    return Graph(spark, emit.quads(table(spark, d, "nation"), m))


@query("star_annotation_lookup", "SELECT 'urn:tpch:Nation:' || n_nationkey AS x, CAST(n_nationkey * 2 AS BIGINT) AS k FROM nation WHERE n_name = 'FRANCE' OR n_nationkey = 7")
def star_annotation_lookup(spark, d):
    return _annotated(spark, d).select_df(PREFIX + 'SELECT ?x ?k WHERE { << ?x n:name ?n >> t:confidence ?k FILTER(?n = "FRANCE" || STR(?x) = "urn:tpch:Nation:7") }', types={"x": "iri", "k": "long"})


@query("star_pattern_vars", "SELECT 'urn:tpch:Nation:' || n_nationkey AS x, n_name AS n, 'loader' AS w FROM nation WHERE n_nationkey < 5")
def star_pattern_vars(spark, d):
    return _annotated(spark, d).select_df(PREFIX + "SELECT ?x ?n ?w WHERE { << ?x ?p ?n >> t:by ?w }", types={"x": "iri", "n": "string", "w": "string"})


@query("star_istriple", "SELECT COUNT(*) + SUM(CASE WHEN n_nationkey < 5 THEN 1 ELSE 0 END)::BIGINT AS k FROM nation")
def star_istriple(spark, d):
    return _annotated(spark, d).select_df("SELECT (COUNT(*) AS ?k) WHERE { ?s ?p ?o FILTER(isTRIPLE(?s)) }", types={"k": "long"})


@query("construct_inverse", "SELECT '<urn:tpch:Region:' || n_regionkey || '>' AS s, '<urn:has>' AS p, '<urn:tpch:Nation:' || n_nationkey || '>' AS o FROM nation")
def construct_inverse(spark, d):
    return Graph(spark, mapped(spark, d, "Nation")).construct_df(PREFIX + "CONSTRUCT { ?g <urn:has> ?x . ?n <urn:bad> ?x } WHERE { ?x n:region ?g ; n:name ?n }")


# writes
def _counts(g: Graph) -> DataFrame:
    return g.store.quads.groupBy("p", "g").agg(F.count(F.lit(1)).alias("k")).select(F.regexp_replace("p", "^<|>$", "").alias("p"), F.coalesce("g", F.lit("")).alias("g"), "k")


def _run(g: Graph, text: str, **kw) -> dict:
    env = g.execute(PREFIX + text, **kw)
    if not env["ok"]:
        raise RuntimeError(env["because"])
    return env


_RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_NATIONS = f"SELECT '{_RDF_TYPE}' AS p, '' AS g, COUNT(*) AS k FROM nation UNION ALL SELECT 'urn:tpch:Nation/name', '', COUNT(*) FROM nation UNION ALL SELECT 'urn:tpch:Nation/region', '', COUNT(*) FROM nation"


@query("upd_insert_where", _NATIONS + " UNION ALL SELECT 'urn:in', 'urn:g', COUNT(*) FROM nation WHERE n_regionkey = 1")
def upd_insert_where(spark, d):
    g = Graph(spark, mapped(spark, d, "Nation"))
    _run(g, "INSERT { GRAPH <urn:g> { ?x <urn:in> ?r } } WHERE { ?x n:region ?r FILTER(?r = <urn:tpch:Region:1>) }")
    return _counts(g)


@query("upd_delete_where", f"SELECT '{_RDF_TYPE}' AS p, '' AS g, COUNT(*) AS k FROM nation UNION ALL SELECT 'urn:tpch:Nation/region', '', COUNT(*) FROM nation UNION ALL SELECT 'urn:tpch:Nation/name', '', COUNT(*) FROM nation WHERE n_regionkey <> 1")
def upd_delete_where(spark, d):
    g = Graph(spark, mapped(spark, d, "Nation"))
    _run(g, "DELETE { ?x n:name ?n } WHERE { ?x n:name ?n ; n:region <urn:tpch:Region:1> }")
    return _counts(g)


@query("upd_modify", "SELECT 'urn:tpch:Customer:' || c_custkey AS x, c_acctbal + 1 AS b FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'urn:tpch:Customer:' || c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def upd_modify(spark, d):
    g = Graph(spark, mapped(spark, d, "Customer"))
    _run(g, "DELETE { ?x c:acctbal ?b } INSERT { ?x c:acctbal ?k } WHERE { ?x c:acctbal ?b FILTER(?b < 0) BIND(?b + 1 AS ?k) }")
    return g.select_df(PREFIX + "SELECT ?x ?b WHERE { ?x c:acctbal ?b }", types={"x": "iri", "b": "double"})


@query("upd_clear_graph", "SELECT 'urn:g:nations' AS g, 3 * COUNT(*) AS k FROM nation")
def upd_clear_graph(spark, d):
    g = Graph(spark, mapped(spark, d, "Customer", "Nation", graphs=_G))
    _run(g, "CLEAR GRAPH <urn:g:customers>")
    return g.store.quads.groupBy("g").agg(F.count(F.lit(1)).alias("k"))


@query("upd_copy_move_add", "SELECT 'urn:g:copy' AS g, 3 * COUNT(*) AS k FROM nation UNION ALL SELECT 'urn:g:moved', 3 * COUNT(*) FROM nation")
def upd_copy_move_add(spark, d):
    g = Graph(spark, mapped(spark, d, "Nation", graphs=_G))
    _run(g, "COPY <urn:g:nations> TO <urn:g:copy> ; ADD <urn:g:nations> TO <urn:g:copy> ; MOVE <urn:g:nations> TO <urn:g:moved>")
    return g.store.quads.groupBy("g").agg(F.count(F.lit(1)).alias("k"))


@query("bulk_insert_dedup", "SELECT 3 * COUNT(*) AS first, CAST(0 AS BIGINT) AS second, 3 * COUNT(*) AS size FROM nation")
def bulk_insert_dedup(spark, d):
    g = Graph(spark)
    rows = mapped(spark, d, "Nation")
    first, second = (g.bulk_insert(rows.union(rows))["inserted"] for _ in range(2))
    return spark.createDataFrame([(first, second, g.store_size()["count"])], "first long, second long, size long")


@query("bulk_delete_rows", "SELECT 3 * (SELECT COUNT(*) FROM nation WHERE n_regionkey = 2) AS gone, 3 * (SELECT COUNT(*) FROM nation WHERE n_regionkey <> 2) AS size")
def bulk_delete_rows(spark, d):
    g = Graph(spark, mapped(spark, d, "Nation"))
    some = emit.quads(table(spark, d, "nation").where("n_regionkey = 2"), mapping("Nation"))
    gone = g.bulk_delete(some)["deleted"]
    return spark.createDataFrame([(gone, g.store_size()["count"])], "gone long, size long")


@query("store_sizes", "SELECT 2 * (SELECT COUNT(*) FROM region) AS plain, 3 * (SELECT COUNT(*) FROM nation) AS named, 2 * (SELECT COUNT(*) FROM region) + 3 * (SELECT COUNT(*) FROM nation) AS every")
def store_sizes(spark, d):
    g = Graph(spark, mapped(spark, d, "Nation", "Region", graphs=_G))
    return spark.createDataFrame([(g.store_size(graph=None)["count"], g.store_size(graph="urn:g:nations")["count"], g.store_size()["count"])], "plain long, named long, every long")


# emission
@query("emit_counts_by_predicate", f"SELECT p, COUNT(*) AS k FROM (SELECT unnest(['{_RDF_TYPE}', 'urn:tpch:Order/status', 'urn:tpch:Order/total', 'urn:tpch:Order/date', 'urn:tpch:Order/priority', 'urn:tpch:Order/customer']) AS p FROM orders) GROUP BY p")
def emit_counts_by_predicate(spark, d):
    return mapped(spark, d, "Order").groupBy(F.regexp_replace("p", "^<|>$", "").alias("p")).agg(F.count(F.lit(1)).alias("k"))


@query("emit_on_subject_folders", "SELECT DISTINCT 'urn:source:' || source AS s, lang AS o FROM documents")
def emit_on_subject_folders(spark, d):
    m = emit.Mapping(subject("Document", "doc_id"), [emit.Triple(NS + "x", lambda df: F.col("n_chars"))], on_subject=[emit.OnSubject(lambda df: F.concat(F.lit("urn:source:"), F.col("source")), [emit.Triple("urn:has", lambda df: F.col("lang"))])])
    return emit.quads(table(spark, d, "documents"), m).where("p = '<urn:has>'").select(T.c_lexical(F.col("s")).alias("s"), T.c_lexical(F.col("o")).alias("o")).distinct()


@query("emit_each_unpivot", "SELECT 'urn:tpch:Part:' || p_partkey AS s, unnest(string_split(p_type, ' ')) AS o FROM part")
def emit_each_unpivot(spark, d):
    m = emit.Mapping(subject("Part", "p_partkey"), each=[emit.Each(lambda df: F.split("p_type", " "), "urn:word")])
    return emit.quads(table(spark, d, "part"), m).select(T.c_lexical(F.col("s")).alias("s"), T.c_lexical(F.col("o")).alias("o"))


@query("emit_guard_if", "SELECT 'urn:tpch:Customer:' || c_custkey AS s, c_acctbal AS o FROM customer WHERE c_acctbal > 5000")
def emit_guard_if(spark, d):
    m = emit.Mapping(subject("Customer", "c_custkey"), [emit.Triple("urn:rich", lambda df: F.col("c_acctbal"), guard=lambda df: F.col("c_acctbal") > 5000)])
    return emit.quads(table(spark, d, "customer"), m).select(T.c_lexical(F.col("s")).alias("s"), T.c_number(F.col("o")).alias("o"))


@query("emit_replace_update", "SELECT 'urn:tpch:Customer:' || c_custkey AS s, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS o FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 <> 0")
def emit_replace_update(spark, d):
    customers = table(spark, d, "customer")
    m = emit.Mapping(subject("Customer", "c_custkey"), [emit.Triple("urn:segment", lambda df: F.col("c_mktsegment"))])
    g = Graph(spark)
    emit.save(g, customers, m)
    even = customers.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, "NEW"))
    emit.save(g, even, m)
    return g.select_df("SELECT ?s ?o WHERE { ?s <urn:segment> ?o }", types={"s": "iri", "o": "string"})


@query("emit_destroy", "SELECT COUNT(*) AS k FROM customer WHERE c_nationkey <> 3")
def emit_destroy(spark, d):
    customers = table(spark, d, "customer")
    m = emit.Mapping(subject("Customer", "c_custkey"), [emit.Triple("urn:segment", lambda df: F.col("c_mktsegment"))])
    g = Graph(spark, emit.quads(customers, m))
    emit.destroy(g, customers.where("c_nationkey = 3"), m)
    return g.select_df("SELECT (COUNT(*) AS ?k) WHERE { ?s <urn:segment> ?o }", types={"k": "long"})


# query algebra, on both planes
IR_PREFIX = "urn:m:"


def _context(spark, d, graph_plane: bool) -> ir.QueryContext:
    parts = table(spark, d, "part")
    ctx = ir.QueryContext()
    ctx.schema.iri_prefix = IR_PREFIX
    ctx.schema.register("Part", parts, "p_partkey")
    if graph_plane:
        fields = ("p_partkey", "p_brand", "p_size", "p_name")
        m = emit.Mapping(subject("Part", "p_partkey"), [emit.Triple(T.RDF + "type", f"<{ctx.schema.class_iri('Part')}>")] + [emit.Triple(ctx.schema.field("Part", f)["iri"], (lambda c: lambda df: F.col(c))(f)) for f in fields])
        ctx.graph = Graph(spark, emit.quads(parts, m))
    return ctx


def program(name: str, nodes: list, columns: dict[str, str], sql: str) -> None:
    """Registers a program on both backends; s is the row's key."""

    def on(graph_plane: bool):
        def run(spark, d):
            ctx = _context(spark, d, graph_plane)
            error = ir.validate(nodes)
            if error:
                raise ValueError(error["because"])
            if graph_plane:
                df = sparql_backend.frame(ctx, nodes, types={"s": "iri", **columns})
                return df.withColumn("s", F.regexp_extract("s", r"(\d+)$", 1).cast("long")) if "s" in df.columns else df
            df = relational_backend.frame(ctx, nodes)
            kinds = {"long": "bigint", "string": "string"}
            return df.select(*([F.col("s").cast("long").alias("s")] if "s" in df.columns else []), *(F.col(c).cast(kinds[k]).alias(c) for c, k in columns.items()))

        return run

    for plane, graph_plane in (("sparql", True), ("relational", False)):
        QUERIES[f"{name}_{plane}"], ORACLE_SQL[f"{name}_{plane}"] = on(graph_plane), sql


program("ir_find_project", [ir.Find("Part"), ir.Project(["p_brand", "p_size"])], {"p_brand": "string", "p_size": "long"}, "SELECT p_partkey AS s, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part")
program("ir_filter_sort_limit", [ir.Find("Part"), ir.Filter("p_size", "gte", 10), ir.Filter("p_brand", "neq", "Brand#11"), ir.Sort("p_size", "desc"), ir.Sort("p_name"), ir.Sort("p_partkey"), ir.Limit(20), ir.Project(["p_size", "p_name"])], {"p_size": "long", "p_name": "string"}, "SELECT p_partkey AS s, CAST(p_size AS BIGINT) AS p_size, p_name FROM part WHERE p_size >= 10 AND p_brand <> 'Brand#11' ORDER BY p_size DESC, p_name, p_partkey LIMIT 20")
program("ir_range", [ir.Find("Part"), ir.FilterRange("p_size", 5, 15), ir.Project(["p_size"])], {"p_size": "long"}, "SELECT p_partkey AS s, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size BETWEEN 5 AND 15")
program("ir_range_exclusive", [ir.Find("Part"), ir.FilterRange("p_size", 5, 15, inclusive=False), ir.Project(["p_size"])], {"p_size": "long"}, "SELECT p_partkey AS s, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size > 5 AND p_size < 15")
program("ir_in", [ir.Find("Part"), ir.FilterIn("p_size", [1, 2, 3]), ir.Project(["p_size"])], {"p_size": "long"}, "SELECT p_partkey AS s, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size IN (1, 2, 3)")
program("ir_count", [ir.Find("Part"), ir.Filter("p_size", "lt", 10), ir.Count()], {"count": "long"}, "SELECT COUNT(*) AS count FROM part WHERE p_size < 10")
program("ir_offset_page", [ir.Find("Part"), ir.Sort("p_size"), ir.Sort("p_partkey"), ir.Limit(10), ir.Offset(5), ir.Project(["p_size"])], {"p_size": "long"}, "SELECT p_partkey AS s, CAST(p_size AS BIGINT) AS p_size FROM part ORDER BY p_size, p_partkey LIMIT 10 OFFSET 5")


@query("ir_compare_sparql", "SELECT a.p_brand AS left_value, b.p_brand AS right_value, a.p_brand = b.p_brand AS equal FROM part a, part b WHERE a.p_partkey = 1 AND b.p_partkey = 2")
def ir_compare_sparql(spark, d):
    env = ir.run(_context(spark, d, True), [ir.Find("Part"), ir.Compare("urn:tpch:Part:1", "urn:tpch:Part:2", "p_brand")], backend="sparql")
    r = env["results"][0]
    return spark.createDataFrame([(r["left"], r["right"], r["equal"])], "left_value string, right_value string, equal boolean")


@query("ir_compare_relational", ORACLE_SQL["ir_compare_sparql"])
def ir_compare_relational(spark, d):
    env = ir.run(_context(spark, d, False), [ir.Find("Part"), ir.Compare(1, 2, "p_brand")], backend="relational")
    r = env["results"][0]
    return spark.createDataFrame([(r["left"], r["right"], r["equal"])], "left_value string, right_value string, equal boolean")


# reasoning over nations and regions
_A, _I = "urn:asserted", "urn:inferred"


def _reasoned(spark, d, ontology: str, rules: tuple, provenance: bool = False, mode: str = "sequential") -> Graph:
    base = emit.quads(table(spark, d, "nation"), emit.Mapping(subject("Nation", "n_nationkey"), [emit.Triple(T.RDF + "type", lambda df: F.concat(F.lit("urn:k:Nation"), F.col("n_regionkey").cast("string")), iri=True), emit.Triple("urn:k:in", subject("Region", "n_regionkey"), iri=True)], graph=_A))
    g = Graph(spark, base)
    if ontology:
        _run(g, f"INSERT DATA {{ GRAPH <{_A}> {{ {ontology} }} }}")
    env = reasoner.materialise(g, _A, _I, rules=reasoner.OWL_2_RL.only(*rules) if rules else "owl_2_rl", provenance=provenance, mode=mode)
    if not env["ok"]:
        raise RuntimeError(env["because"])
    return g


def _inferred(g: Graph, where: str = "true") -> DataFrame:
    q = g.store.quads.where((F.col("g") == _I) & ~T.is_quoted(F.col("s"))).where(where)
    return q.select(*(F.regexp_replace(c, "^<|>$", "").alias(c) for c in "spo"))


_K = "urn:k:"
_SUB = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
_SAME = "http://www.w3.org/2002/07/owl#sameAs"
_SUBS = " ".join(f"<{_K}Nation{i}> rdfs:subClassOf <{_K}Nation> ." for i in range(5)) + f" <{_K}Nation> rdfs:subClassOf <{_K}Place> ."
_N = "'urn:tpch:Nation:' || n_nationkey"
_R = "'urn:tpch:Region:' || n_regionkey"


def rule_query(name: str, rules: str, ontology: str, sql: str) -> None:
    query(name, sql)(lambda spark, d: _inferred(_reasoned(spark, d, ontology, tuple(rules.split()))))


rule_query("owl_scm_sco", "scm-sco", _SUBS, f"SELECT '{_K}Nation' || i AS s, '{_SUB}' AS p, '{_K}Place' AS o FROM range(5) t(i)")
rule_query("owl_scm_spo", "scm-spo", f"<{_K}in> rdfs:subPropertyOf <{_K}near> . <{_K}near> rdfs:subPropertyOf <{_K}related> .", f"SELECT '{_K}in' AS s, 'http://www.w3.org/2000/01/rdf-schema#subPropertyOf' AS p, '{_K}related' AS o")
rule_query("owl_scm_eqc1", "scm-eqc1", f"<{_K}Nation1> owl:equivalentClass <{_K}American> .", f"SELECT '{_K}Nation1' AS s, '{_SUB}' AS p, '{_K}American' AS o UNION ALL SELECT '{_K}American', '{_SUB}', '{_K}Nation1'")
rule_query("owl_scm_eqp1", "scm-eqp1", f"<{_K}in> owl:equivalentProperty <{_K}inside> .", f"SELECT '{_K}in' AS s, 'http://www.w3.org/2000/01/rdf-schema#subPropertyOf' AS p, '{_K}inside' AS o UNION ALL SELECT '{_K}inside', 'http://www.w3.org/2000/01/rdf-schema#subPropertyOf', '{_K}in'")
rule_query("owl_cax_sco", "cax-sco", _SUBS, f"SELECT {_N} AS s, '{_RDF_TYPE}' AS p, '{_K}' || c AS o FROM nation, (VALUES ('Nation'), ('Place')) v(c)")
rule_query("owl_prp_spo1", "prp-spo1", f"<{_K}in> rdfs:subPropertyOf <{_K}near> .", f"SELECT {_N} AS s, '{_K}near' AS p, {_R} AS o FROM nation")
rule_query("owl_prp_dom", "prp-dom", f"<{_K}in> rdfs:domain <{_K}Located> .", f"SELECT {_N} AS s, '{_RDF_TYPE}' AS p, '{_K}Located' AS o FROM nation")
rule_query("owl_prp_rng", "prp-rng", f"<{_K}in> rdfs:range <{_K}Area> .", f"SELECT DISTINCT {_R} AS s, '{_RDF_TYPE}' AS p, '{_K}Area' AS o FROM nation")
rule_query("owl_prp_trp", "prp-trp", f"<{_K}in> a owl:TransitiveProperty . " + " ".join(f"<urn:tpch:Region:{i}> <{_K}in> <{_K}World> ." for i in range(5)), f"SELECT {_N} AS s, '{_K}in' AS p, '{_K}World' AS o FROM nation")
rule_query("owl_prp_symp", "prp-symp", f"<{_K}in> a owl:SymmetricProperty .", f"SELECT {_R} AS s, '{_K}in' AS p, {_N} AS o FROM nation UNION ALL SELECT {_N}, '{_K}in', {_R} FROM nation")
rule_query("owl_prp_inv", "prp-inv1 prp-inv2", f"<{_K}in> owl:inverseOf <{_K}holds> . <{_K}World> <{_K}holds> <{_K}All> .", f"SELECT {_R} AS s, '{_K}holds' AS p, {_N} AS o FROM nation UNION ALL SELECT {_N}, '{_K}in', {_R} FROM nation UNION ALL SELECT '{_K}All', '{_K}in', '{_K}World' UNION ALL SELECT '{_K}World', '{_K}holds', '{_K}All'")
rule_query("owl_prp_fp", "prp-fp", f"<{_K}in> a owl:FunctionalProperty . <urn:tpch:Nation:0> <{_K}in> <{_K}Else> .", f"SELECT {_R} AS s, '{_SAME}' AS p, '{_K}Else' AS o FROM nation WHERE n_nationkey = 0 UNION ALL SELECT '{_K}Else', '{_SAME}', {_R} FROM nation WHERE n_nationkey = 0")
rule_query("owl_eq_sym_trans", "eq-sym eq-trans", f"<{_K}a> owl:sameAs <{_K}b> . <{_K}b> owl:sameAs <{_K}c> .", f"SELECT '{_K}' || x AS s, '{_SAME}' AS p, '{_K}' || y AS o FROM (VALUES ('a'), ('b'), ('c')) v(x), (VALUES ('a'), ('b'), ('c')) w(y) WHERE x <> y")
_CLOSURE = f"SELECT '{_K}Nation' || i AS s, '{_SUB}' AS p, '{_K}Place' AS o FROM range(5) t(i) UNION ALL SELECT {_N}, '{_RDF_TYPE}', '{_K}' || c FROM nation, (VALUES ('Nation'), ('Place')) v(c) UNION ALL SELECT {_R}, '{_K}in', {_N} FROM nation UNION ALL SELECT {_N}, '{_K}in', {_R} FROM nation"
query("owl_closure_all", _CLOSURE)(lambda spark, d: _inferred(_reasoned(spark, d, _SUBS + f" <{_K}in> a owl:SymmetricProperty .", ())))
query("owl_closure_batched", _CLOSURE)(lambda spark, d: _inferred(_reasoned(spark, d, _SUBS + f" <{_K}in> a owl:SymmetricProperty .", (), mode="batched")))


@query("owl_derived_by_counts", "SELECT 'cax-sco' AS rule, 2 * COUNT(*) AS k FROM nation UNION ALL SELECT 'scm-sco', 5")
def owl_derived_by_counts(spark, d):
    g = _reasoned(spark, d, _SUBS, ("scm-sco", "cax-sco"), provenance=True)
    by = g.store.quads.where(F.col("p") == reasoner.fixpoint.DERIVED_BY)
    return by.groupBy(F.regexp_extract("o", "rule:(.*)>$", 1).alias("rule")).agg(F.count_distinct("s").alias("k"))


@query("dred_equals_full", f"SELECT {_N} AS s, '{_RDF_TYPE}' AS p, '{_K}Nation' AS o FROM nation")
def dred_equals_full(spark, d):
    from . import changeset
    from .scope import Scope

    g = _reasoned(spark, d, _SUBS, ("scm-sco", "cax-sco"), provenance=True)
    scope = Scope(_A, inferred=_I)
    with changeset.capture(scope) as changes:
        g.execute(f"DELETE DATA {{ <{_K}Nation> <{_SUB}> <{_K}Place> }}", graph=_A)
    env = reasoner.dred(g, scope=scope, changes=changes, rules=reasoner.OWL_2_RL.only("scm-sco", "cax-sco"))
    if not env["ok"]:
        raise RuntimeError(env["because"])
    return _inferred(g)


# shapes
def _shapes(body: str) -> str:
    return f"@prefix sh: <{T.SH}> . @prefix t: <{NS}> . @prefix c: <{NS}Customer/> . @prefix p: <{NS}Part/> . @prefix l: <{NS}Label/> . @prefix xsd: <{T.XSD}> . {body}"


def _violating(spark, d, models: tuple, body: str) -> DataFrame:
    g = Graph(spark, mapped(spark, d, *models, graphs=dict.fromkeys(models, "urn:data")))
    env = shacl.load_shapes(g, _shapes(body) + "\n", scope="urn:shapes")
    if not env["ok"]:
        raise RuntimeError(env["because"])
    return shacl.violations_df(g, "urn:data", "urn:shapes").select(T.c_lexical(F.col("focus_node")).alias("x"), F.regexp_extract("source_constraint_component", "#(.*)>$", 1).alias("component"))


def shape_query(name: str, models: str, body: str, sql: str) -> None:
    query(name, sql)(lambda spark, d: _violating(spark, d, tuple(models.split()), body))


_DOC = "t:S a sh:NodeShape ; sh:targetClass t:Document ; sh:property [ sh:path {} ; {} ] ."
_CUS = "t:S a sh:NodeShape ; sh:targetClass t:Customer ; sh:property [ sh:path {} ; {} ] ."
_PRT = "t:S a sh:NodeShape ; sh:targetClass t:Part ; sh:property [ sh:path {} ; {} ] ."
_X = f"SELECT {C} AS x, '{{}}ConstraintComponent' AS component FROM customer WHERE {{}}"
_XP = "SELECT 'urn:tpch:Part:' || p_partkey AS x, '{}ConstraintComponent' AS component FROM part WHERE {}"
shape_query("shacl_min_count", "Document Label", _DOC.format("l:quality", "sh:minCount 1"), "SELECT 'urn:tpch:Document:' || doc_id AS x, 'MinCountConstraintComponent' AS component FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
shape_query("shacl_max_count", "Document Label", _DOC.format("l:quality", "sh:maxCount 0"), "SELECT 'urn:tpch:Document:' || doc_id AS x, 'MaxCountConstraintComponent' AS component FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
shape_query("shacl_datatype", "Customer", _CUS.format("c:acctbal", "sh:datatype xsd:integer"), _X.format("Datatype", "true"))
shape_query("shacl_pattern", "Customer", _CUS.format("c:segment", 'sh:pattern "^[A-B]"'), _X.format("Pattern", "NOT regexp_matches(c_mktsegment, '^[A-B]')"))
shape_query("shacl_min_length", "Customer", _CUS.format("c:segment", "sh:minLength 9"), _X.format("MinLength", "length(c_mktsegment) < 9"))
shape_query("shacl_max_length", "Customer", _CUS.format("c:segment", "sh:maxLength 9"), _X.format("MaxLength", "length(c_mktsegment) > 9"))
shape_query("shacl_min_inclusive", "Customer", _CUS.format("c:acctbal", "sh:minInclusive 0"), _X.format("MinInclusive", "c_acctbal < 0"))
shape_query("shacl_max_inclusive", "Part", _PRT.format("p:size", "sh:maxInclusive 40"), _XP.format("MaxInclusive", "p_size > 40"))
shape_query("shacl_exclusive", "Part", _PRT.format("p:size", "sh:minExclusive 10 ; sh:maxExclusive 40"), _XP.format("MinExclusive", "p_size <= 10") + " UNION ALL " + _XP.format("MaxExclusive", "p_size >= 40"))
shape_query("shacl_node_kind", "Customer", _CUS.format("c:nation", "sh:nodeKind sh:Literal"), _X.format("NodeKind", "true"))
shape_query("shacl_has_value", "Customer", _CUS.format("c:segment", 'sh:hasValue "BUILDING"'), _X.format("HasValue", "c_mktsegment <> 'BUILDING'"))
shape_query("shacl_in", "Customer", _CUS.format("c:segment", 'sh:in "BUILDING" , "MACHINERY"'), _X.format("In", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"))
shape_query("shacl_class", "Customer Nation", _CUS.format("c:nation", "sh:class t:Region"), _X.format("Class", "true"))


@query("shacl_report_counts", "SELECT p, COUNT(*) AS k FROM (SELECT unnest(['focusNode', 'resultPath', 'sourceShape', 'sourceConstraintComponent', 'resultSeverity', 'resultMessage', 'result']) AS p FROM customer WHERE c_acctbal < 0) GROUP BY p UNION ALL SELECT 'conforms', 1")
def shacl_report_counts(spark, d):
    g = Graph(spark, mapped(spark, d, "Customer", graphs={"Customer": "urn:data"}))
    shacl.load_shapes(g, _shapes(_CUS.format("c:acctbal", "sh:minInclusive 0")) + "\n", scope="urn:shapes")
    env = shacl.validate(g, "urn:data", "urn:shapes")
    if not env["ok"]:
        raise RuntimeError(env["because"])
    report = g.store.quads.where((F.col("g") == env["report_graph"]) & F.col("p").contains("shacl#"))
    return report.groupBy(F.regexp_extract("p", "#(.*)>$", 1).alias("p")).agg(F.count(F.lit(1)).alias("k"))


def _ruled(spark, d, body: str, **kw) -> DataFrame:
    g = Graph(spark, mapped(spark, d, "Customer", graphs={"Customer": "urn:data"}))
    loaded = shacl.load_shapes(g, _shapes(body) + "\n", scope="urn:shapes")
    env = shacl.rules.materialise(g, "urn:data", "urn:shapes", "urn:out", **kw) if loaded["ok"] else loaded
    if not env["ok"]:
        raise RuntimeError(env["because"])
    q = g.store.quads.where("g = 'urn:out'")
    return q.select(T.c_lexical(F.col("s")).alias("s"), T.c_lexical(F.col("p")).alias("p"), T.c_lexical(F.col("o")).alias("o"))


_RULE = "t:S a sh:NodeShape ; sh:targetClass t:Customer ; sh:rule {} ."
_T1 = 't:R1 a sh:TripleRule ; sh:subject sh:this ; sh:predicate t:status ; sh:object "active" .'
_S1 = 't:R2 a sh:SPARQLRule ; sh:order {} ; sh:construct "CONSTRUCT {{ ?this <urn:tpch:debt> ?b }} WHERE {{ ?this <urn:tpch:Customer/acctbal> ?b FILTER(?b < 0) }}" .'
query("rule_triple", f"SELECT {C} AS s, 'urn:tpch:status' AS p, 'active' AS o FROM customer")(lambda spark, d: _ruled(spark, d, _RULE.format("t:R1") + _T1))


@query("rule_sparql", f"SELECT {C} AS s, c_acctbal AS b FROM customer WHERE c_acctbal < 0")
def rule_sparql(spark, d):
    out = _ruled(spark, d, _RULE.format("t:R2") + _S1.format(0))
    return out.select("s", F.col("o").cast("double").alias("b"))


@query("rule_order_chain", f"SELECT {C} AS s FROM customer WHERE c_acctbal < 0")
def rule_order_chain(spark, d):
    chain = _S1.format(1) + ' t:R3 a sh:SPARQLRule ; sh:order 2 ; sh:construct "CONSTRUCT { ?this <urn:tpch:warn> true } WHERE { ?this <urn:tpch:debt> ?b }" .'
    return _ruled(spark, d, _RULE.format("t:R2 , t:R3") + chain).where("p = 'urn:tpch:warn'").select("s")


@query("rule_condition", f"SELECT {C} AS s, 'urn:tpch:status' AS p, 'active' AS o FROM customer WHERE c_mktsegment = 'BUILDING'")
def rule_condition(spark, d):
    condition = ' t:R1 sh:condition t:C . t:C sh:property [ sh:path c:segment ; sh:hasValue "BUILDING" ] .'
    return _ruled(spark, d, _RULE.format("t:R1") + _T1 + condition)


@query("rule_filter_by_iri", f"SELECT {C} AS s, 'urn:tpch:status' AS p, 'active' AS o FROM customer")
def rule_filter_by_iri(spark, d):
    return _ruled(spark, d, _RULE.format("t:R1 , t:R2") + _T1 + _S1.format(0), rules=[f"{NS}R1"])


# text and schemas
@query("nt_roundtrip", "SELECT 3 * COUNT(*) AS k, CAST(0 AS BIGINT) AS lost FROM nation")
def nt_roundtrip(spark, d):
    import uuid

    from .sources import ntriples
    from .store import minus, shared_folder

    quads = mapped(spark, d, "Nation")
    path = f"{shared_folder(spark)}/quadspark/nt-{uuid.uuid4().hex}"
    ntriples.write(quads, path)
    back = ntriples.read(spark, path)
    return back.agg(F.count(F.lit(1)).alias("k")).crossJoin(minus(quads, back).agg(F.count(F.lit(1)).alias("lost")))  # one row each


@query("schema_normalize_counts", "SELECT CAST(3 AS BIGINT) AS classes, CAST(11 AS BIGINT) AS datatype_properties, CAST(0 AS BIGINT) AS object_properties, CAST(3 + 11 * 3 AS BIGINT) AS triples")
def schema_normalize_counts(spark, d):
    from .schema import normalize

    g = Graph(spark)
    env = normalize(g, {t: table(spark, d, t) for t in ("region", "nation", "part", "embeddings")}, exclude=["embeddings"], schema_graph="urn:schema")
    if not env["ok"]:
        raise RuntimeError(env["because"])
    return spark.createDataFrame([tuple(env[k] for k in ("classes", "datatype_properties", "object_properties", "triples"))], "classes long, datatype_properties long, object_properties long, triples long")


@query("explain_plan", "SELECT 'select' AS kind, CAST(2 AS BIGINT) AS patterns, CAST(1 AS BIGINT) AS filters, CAST(5 AS BIGINT) AS row_limit")
def explain_plan(spark, d):
    plan = Graph(spark).explain(PREFIX + "SELECT ?x WHERE { ?x c:name ?n ; c:acctbal ?b FILTER(?b > 1) } LIMIT 5")["plan"]
    return spark.createDataFrame([(plan["kind"], len(plan["where"]["patterns"]), len(plan["where"]["filters"]), plan["modifiers"]["limit"])], "kind string, patterns long, filters long, row_limit long")


@query("ethereal_roundtrip", "SELECT 3 * COUNT(*) AS k FROM nation")
def ethereal_roundtrip(spark, d):
    from .ethereal import EtherealGraph
    from .sources.blobs import MemoryBlob

    blob = MemoryBlob()
    EtherealGraph(Graph(spark, mapped(spark, d, "Nation", graphs=_G)), "urn:g:nations", blob).checkpoint()
    g = Graph(spark)
    EtherealGraph(g, "urn:g:nations", blob).hydrate()
    return g.select_df("SELECT (COUNT(*) AS ?k) WHERE { GRAPH <urn:g:nations> { ?s ?p ?o } }", types={"k": "long"})


@query("stream_ingest", "SELECT 3 * COUNT(*) AS k FROM nation")
def stream_ingest(spark, d):
    import uuid

    from .store import shared_folder
    from .streaming.ingest import ingest

    base = f"{shared_folder(spark)}/quadspark/stream-{uuid.uuid4().hex}"
    mapped(spark, d, "Nation").write.parquet(base + "/in")
    g = Graph(spark)
    stream = spark.readStream.schema("s string, p string, o string, g string").parquet(base + "/in")
    ingest(stream, g, base + "/state").awaitTermination()
    return g.select_df("SELECT (COUNT(*) AS ?k) WHERE { ?s ?p ?o }", types={"k": "long"})


#: The flagship: customers by region over quads.
def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["count_by_group"](spark, d)


from . import catalogue_api  # noqa: E402,F401  it registers more queries

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

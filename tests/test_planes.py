"""Mapping, query algebra on both planes, schema, durable graphs, capabilities, streaming."""

import pytest
from pyspark.sql import functions as F

from quadspark import capabilities, emit, ir, schema
from quadspark.config import ENV_QUERY_BACKEND, ENV_STRICT
from quadspark.ethereal import EtherealGraph, reset
from quadspark.functions import terms as T
from quadspark.graph import Graph
from quadspark.ir import router, sparql_backend
from quadspark.sources.blobs import FileBlob, FolderBlob, MemoryBlob, slug
from quadspark.streaming.ingest import ingest

ROWS = [(1, "A1", "Epson", "Alpha", 100), (2, "A2", "Epson", "Beta", 200), (3, "B1", "Canon", "Gamma", 150)]


def product_mapping():
    prefix = "urn:m:Product"
    fields = [emit.Triple(f"{prefix}/{c}", (lambda c: lambda df: F.col(c))(c)) for c in ("sku", "brand", "name", "price")]
    return emit.Mapping(lambda df: F.concat(F.lit("urn:p:"), F.col("sku")), [emit.Triple(T.RDF + "type", f"<{prefix}>"), *fields])


@pytest.fixture
def ctx(spark):
    df = spark.createDataFrame(ROWS, "id int, sku string, brand string, name string, price int")
    c = ir.QueryContext(Graph(spark, emit.quads(df, product_mapping())))
    c.schema.iri_prefix = "urn:m:"
    c.schema.register("Product", df)
    return c


FIND = ir.Find("Product")


@pytest.mark.parametrize(
    ("nodes", "want"),
    [
        ([ir.Filter("brand", "eq", "Epson")], [100, 200]),
        ([ir.Filter("brand", "neq", "Epson")], [150]),
        ([ir.Filter("price", "lt", 200)], [100, 150]),
        ([ir.Filter("price", "gte", 150)], [150, 200]),
        ([ir.FilterRange("price", 100, 150)], [100, 150]),
        ([ir.FilterRange("price", 100, 200, inclusive=False)], [150]),
        ([ir.FilterIn("sku", ["A1", "B1"])], [100, 150]),
        ([ir.Sort("price", "desc"), ir.Limit(2)], [150, 200]),
        ([ir.Sort("price"), ir.Limit(1), ir.Offset(1)], [150]),
    ],
)
def test_parity(ctx, nodes, want):
    program = [FIND, *nodes, ir.Project(["price"])]
    for backend in ("sparql", "relational"):
        env = ir.run(ctx, program, backend=backend, with_meta=True)
        assert env["ok"] and env["from"] == env["backend"] == backend, env
        assert sorted(r["price"] for r in env["results"]) == want
        assert (env["plan"] is None) == (backend == "relational")


def test_counts_compare_and_refusals(ctx, monkeypatch):
    for backend in ("sparql", "relational"):
        assert ir.run(ctx, [FIND, ir.Count()], backend=backend)["count"] == 3
    assert ir.run(ctx, [FIND, ir.Compare("urn:p:A1", "urn:p:A2", "brand")])["results"] == [{"left": "Epson", "right": "Epson", "equal": True}]
    assert ir.run(ctx, [FIND, ir.Compare(1, 3, "brand")], backend="relational")["results"][0]["equal"] is False
    assert set(ir.run(ctx, [FIND], backend="relational")["results"][0]) == {"s", "sku", "brand", "name", "price"}
    assert set(ir.run(ctx, [FIND])["results"][0]) == {"s"}
    for bad in ([], [ir.Limit(1)], [FIND, FIND], [FIND, ir.Offset(1)], [FIND, ir.Count(), ir.Limit(1)], [FIND, ir.Compare(1, 2, "x"), ir.Count()], [FIND, "x"], [FIND, ir.Filter("price", "like", 1)], [FIND, ir.Limit(1), ir.Limit(2)]):
        assert ir.run(ctx, bad)["reason"] == "ir_invalid"
    assert ir.run(ctx, [FIND, ir.Filter("brand", "eq", None)])["reason"] == "ir_invalid"
    assert ir.run(ctx, [FIND, ir.Filter("brand", "eq", None)], backend="relational")["results"] == []
    assert ir.run(ctx, [ir.Find("Nope")], backend="relational")["reason"] == "model_unknown"
    assert ir.run(ctx, [FIND, ir.Project(["nope"])], backend="relational")["reason"] == "ar_query_error"
    assert ir.run(ir.QueryContext(ctx.graph), [FIND], backend="relational")["reason"] == "ar_not_loaded"
    assert ir.run(ctx, [FIND], backend="nope")["reason"] == "unknown_backend"
    lacking = ir.run(ctx, [FIND], backend="relational", needs=("shacl",))
    assert (lacking["reason"], lacking["available_backends"]) == ("backend_missing_capability", ["sparql"])
    assert router.pick([FIND], needs=("fts",))["reason"] == "backend_missing_capability"
    monkeypatch.setenv(ENV_QUERY_BACKEND, "relational")
    assert ir.run(ctx, [FIND])["from"] == "relational"
    text = sparql_backend.compile_select(ctx, [FIND, ir.Filter("a-b.c", "eq", 'q"x'), ir.Sort("price", "up")])
    assert '?a_b_c = "q\\"x"' in text and "ASC(?price)" in text


def test_mapping_life_cycle(spark):
    g = Graph(spark)
    df = spark.createDataFrame([(1, "Epson", 100, ["a", "b"]), (2, "Canon", None, [])], "id int, brand string, price int, tags array<string>")
    m = emit.Mapping(
        lambda d: F.concat(F.lit("urn:w:"), d.id),
        [emit.Triple("urn:brand", lambda d: d.brand).annotate("urn:by", 42), emit.Triple("urn:price", lambda d: d.price), emit.Triple("urn:cheap", True, guard=lambda d: d.price < 50)],
        on_subject=[emit.OnSubject(lambda d: F.concat(F.lit("urn:brand:"), d.brand), [emit.Triple("urn:makes", lambda d: F.concat(F.lit("urn:w:"), d.id), iri=True)])],
        each=[emit.Each(lambda d: d.tags, lambda item: F.concat(F.lit("urn:tag/"), item), lambda item: F.upper(item))],
        graph="urn:g",
    )

    def state():
        return {(r.s, r.p, r.o) for r in g.store.quads.where("g = 'urn:g'").collect()}

    for mode in emit.DISPATCH_MODES:
        assert emit.save(g, df, m, mode)["ok"]
    five = f'"42"^^<{T.XSD}integer>'
    assert state() == {
        ("<urn:w:1>", "<urn:brand>", '"Epson"'),
        ('<< <urn:w:1> <urn:brand> "Epson" >>', "<urn:by>", five),
        ("<urn:w:2>", "<urn:brand>", '"Canon"'),
        ('<< <urn:w:2> <urn:brand> "Canon" >>', "<urn:by>", five),
        ("<urn:w:1>", "<urn:price>", f'"100"^^<{T.XSD}integer>'),
        ("<urn:brand:Epson>", "<urn:makes>", "<urn:w:1>"),
        ("<urn:brand:Canon>", "<urn:makes>", "<urn:w:2>"),
        ("<urn:w:1>", "<urn:tag/a>", '"A"'),
        ("<urn:w:1>", "<urn:tag/b>", '"B"'),
    }
    # a null retracts its slot, a guard that fails leaves its slot, an empty collection leaves its slots
    changed = df.where("id = 1").withColumn("price", F.lit(None).cast("int")).withColumn("brand", F.lit("New")).withColumn("tags", F.array().cast("array<string>"))
    emit.save(g, changed, m)
    now = state()
    assert ("<urn:w:1>", "<urn:brand>", '"New"') in now and ("<urn:w:1>", "<urn:tag/a>", '"A"') in now
    assert not any(p == "<urn:price>" for _, p, _ in now) and not any("Epson" in s for s, p, _ in now if p == "<urn:by>")
    emit.destroy(g, df.where("id = 2"), m)
    assert not any("urn:w:2" in s or "Canon" in s for s, _, _ in state())
    with pytest.raises(ValueError, match="subject"):
        emit.Mapping(None)


def test_strict_mode(spark, monkeypatch):
    df = spark.createDataFrame([(1,)], "id int")
    m = emit.Mapping("urn:x", [emit.Triple("urn:p", lambda d: d.id)])
    assert emit.save(Graph(spark), df, m, mode="nope")["reason"] == "invalid_dsl"
    monkeypatch.setenv(ENV_STRICT, "1")
    with pytest.raises(emit.Refused):
        emit.save(Graph(spark), df, m, mode="nope")


def test_schema(spark):
    capabilities.reset_schema_normalization()
    s = schema.Schema()
    assert s.iri_prefix == "mm:" and s.field("Product", "price") == {"iri": "mm:Product/price", "column": None, "xsd": None, "supports_closure": False}
    g = Graph(spark)
    authors = spark.createDataFrame([], "id bigint, name string, created_at timestamp")
    books = spark.createDataFrame([], "id bigint, title string, price int, norm_author_id bigint")
    env = schema.normalize(g, {"norm_authors": authors, "norm_books": books, "schema_migrations": authors}, iri_prefix="urn:n:", schema_graph="urn:schema")
    assert (env["classes"], env["object_properties"], env["datatype_properties"]) == (2, 1, 6)
    assert g.ask(f"ASK {{ <urn:n:NormBook/norm_author_id> a <{T.OWL}ObjectProperty> ; <{T.RDFS}range> <urn:n:NormAuthor> }}", graph="urn:schema")["value"]
    assert capabilities.schema_normalized() and s.iri_prefix == "urn:n:"
    s.register("Book", books)
    s.override("Book", "price", iri="urn:price")
    assert s.field("Book", "price") == {"iri": "urn:price", "column": "price", "xsd": T.XSD + "integer", "supports_closure": False}
    s.reset()
    assert s.iri_prefix == "mm:" and schema.normalize(g, {}, schema_graph="_:b")["reason"] == "invalid_graph"
    capabilities.reset_schema_normalization()


def test_durable_graphs(spark, tmp_path):
    reset()
    g, blob = Graph(spark), MemoryBlob("# c\n\n<urn:a> <urn:p> \"x\" .\n<< <urn:a> <urn:p> \"x\" >> <urn:by> <urn:me> .\n")
    e = EtherealGraph(g, "urn:host:1", blob, policy="save")
    assert e.hydrate() == {"ok": True, "inserted": 2}
    assert e.hydrate()["reason"] == "already_hydrated"
    text = blob.download()
    assert e.saved()["written"] == len(blob.download().encode()) and set(blob.download().splitlines()) == {x for x in text.splitlines() if x.startswith("<")}
    assert e.retract()["ok"] and g.store_size()["count"] == 0
    assert e.hydrate()["inserted"] == 2
    assert EtherealGraph(g, "urn:h2", MemoryBlob()).hydrate()["reason"] == "no_blob"
    assert EtherealGraph(g, "urn:h3", MemoryBlob(" \n")).hydrate()["reason"] == "empty_blob"
    bad = EtherealGraph(g, "urn:h4", MemoryBlob("<> <urn:p> <urn:o> .\n"))
    assert bad.hydrate()["ok"] is False and bad.hydrate()["reason"] != "already_hydrated"
    assert EtherealGraph(g, None, blob).checkpoint()["reason"] == "ethereal_graph_undeclared"

    class Nested(MemoryBlob):
        def attach(self, *args):
            self.inner = nested.checkpoint()
            super().attach(*args)

    nested = EtherealGraph(g, "urn:host:1", Nested())
    assert nested.checkpoint()["ok"] and nested.blob.inner["reason"] == "reentrant_checkpoint"
    file = FileBlob(tmp_path, slug("urn:host:1") + ".nt")
    EtherealGraph(g, "urn:host:1", file).checkpoint()
    assert file.attached() and file.path.name == "urn_host_1.nt"
    file.purge()
    assert not file.attached() and slug("///") == "graph" and len(slug("x" * 300)) == 120


def test_durable_graphs_in_a_folder(spark, tmp_path):
    reset()
    blob, text = FolderBlob(spark, f"file://{tmp_path}/g"), T.literal("two\nlines \r # no comment")
    rows = [("<urn:a>", "<urn:p>", text, "urn:host:1"), ("<< <urn:a> <urn:p> <urn:b> >>", "<urn:by>", "<urn:me>", "urn:host:1"), ("<urn:a>", "<urn:p>", "<urn:c>", None)]
    g = Graph(spark)
    g.store.insert(g.store.rows(rows))
    e = EtherealGraph(g, "urn:host:1", blob, policy="save")
    assert not blob.attached() and e.hydrate()["reason"] == "no_blob"
    written = e.checkpoint()["written"]
    assert written == e.saved()["written"] == sum(len(" ".join([*r[:3], "."])) + 1 for r in rows[:2]) and blob.attached()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["g"]
    h = Graph(spark)
    other = EtherealGraph(h, "urn:host:1", blob)
    assert other.hydrate() == {"ok": True, "inserted": 2} and other.hydrate()["reason"] == "already_hydrated"
    assert {tuple(r) for r in h.store.quads.collect()} == set(rows[:2])
    # a swap that was cut short leaves the old version
    (tmp_path / "g").rename(tmp_path / "g.old")
    again = EtherealGraph(Graph(spark), "urn:host:1", blob)
    assert again.hydrate()["inserted"] == 2 and again.checkpoint()["written"] == written
    assert sorted(p.name for p in tmp_path.iterdir()) == ["g"]
    for name, line, reason in (("empty", "# c", "empty_blob"), ("blank", " ", "empty_blob"), ("plain", "<> <urn:p> <urn:o> .", "invalid_dsl"), ("star", "<< <urn:a> <urn:p> >> <urn:p> <urn:o> .", "invalid_dsl")):
        spark.createDataFrame([(line,)], "value string").write.text(f"file://{tmp_path}/{name}")
        k = Graph(spark)
        bad = EtherealGraph(k, "urn:h", FolderBlob(spark, f"file://{tmp_path}/{name}"))
        assert bad.hydrate()["reason"] == reason == bad.hydrate()["reason"] and k.store_size()["count"] == 0, name
    blob.purge()
    assert not blob.attached()


def test_capabilities():
    assert capabilities.rdf_star_writes_enabled() and capabilities.checkpoint_can_round_trip("ntriples_star")
    assert capabilities.sparql_method_available("select") and not capabilities.sparql_method_available("nope")
    with pytest.raises(ValueError, match="unknown"):
        capabilities.checkpoint_can_round_trip("other")


def test_stream(spark, tmp_path):
    rows = [("<urn:a>", "<urn:p>", f'"{i}"', None) for i in range(10)]
    spark.createDataFrame(rows, "s string, p string, o string, g string").repartition(3).write.parquet(f"{tmp_path}/in")
    g, seen = Graph(spark), []
    stream = spark.readStream.schema("s string, p string, o string, g string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest(stream, g, f"{tmp_path}/state", after=lambda graph, batch: seen.append(batch.count())).awaitTermination()
    assert g.store_size()["count"] == 10 and sum(seen) == 10


def test_snapshots(spark, tmp_path):
    from quadspark import snapshots as S

    g, base = Graph(spark), str(tmp_path)
    g.bulk_insert([("urn:a", "urn:p", 1), ("urn:a", "urn:p", 2, "urn:g")])
    one = S.snapshot(g, base, "one")["id"]
    g.bulk_insert([("urn:a", "urn:p", 3)])
    g.bulk_delete([("urn:a", "urn:p", 1)])
    two = S.snapshot(g, base, "two")["id"]
    assert [x["label"] for x in S.snapshots(g, base)["snapshots"]] == ["one", "two"]
    assert S.diff(g, base, one, two) == {"ok": True, "added": 1, "removed": 1}
    assert S.restore(g, base, one) == {"ok": True, "quads": 2}
    assert g.store_size(graph="urn:g")["count"] == 1 and S.restore(g, base, "nope")["ok"] is False

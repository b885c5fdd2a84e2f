"""Validation as one join: targets, property shapes and value nodes, aggregated per focus node.

The shapes graph is read to the driver (shapes are written by people); focus and
value nodes stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import reasons as R
from ..functions import terms as T
from ..functions.terms import SH
from ..graph import Graph, guarded
from ..scope import resolve
from ..store import bare, in_graph, local_df, pin
from .constraints import CORE, PENDING, ConstraintLibrary, class_flag

_SCOPE = {"data": "data_graph", "shapes": "shapes_graph", "report": "report_graph"}
VIOLATION_KEYS = ("focus_node", "path", "source_shape", "source_constraint_component", "severity", "value", "message")


@dataclass
class PropertyShape:
    shape: str
    node: str
    path: str
    declarations: list[tuple[str, Any]] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)


class Shapes:
    """The shapes graph on the driver, by subject."""

    def __init__(self, graph: Graph, shapes_graph: str | None):
        self.by: dict[str, list[tuple[str, str]]] = {}
        for r in in_graph(graph.store.quads, shapes_graph).select("s", "p", "o").toLocalIterator():
            self.by.setdefault(r["s"], []).append((r["p"], r["o"]))
        for rows in self.by.values():
            rows.sort()

    def objects(self, s: str, p: str) -> list[str]:
        return [o for q, o in self.by.get(s, []) if q == f"<{p}>"]

    def first(self, s: str, p: str) -> str | None:
        return next(iter(self.objects(s, p)), None)

    def node_shapes(self) -> list[str]:
        return sorted(s for s in self.by if f"<{SH}NodeShape>" in self.objects(s, T.RDF + "type"))

    def items(self, head: str) -> list[str]:
        """Members of a list, or the term itself."""
        if not self.objects(head, T.RDF + "first"):
            return [head]
        out, seen = [], set()
        while head and head != f"<{T.RDF}nil>" and head not in seen:
            seen.add(head)
            out += self.objects(head, T.RDF + "first")[:1]
            head = self.first(head, T.RDF + "rest")
        return out

    def property_shapes(self, shape: str, library: ConstraintLibrary) -> list[PropertyShape]:
        out = []
        for node in self.objects(shape, SH + "property"):
            path = self.first(node, SH + "path")
            if path is None or not path.startswith("<"):
                continue
            found = PropertyShape(shape, node, path)
            allowed = [x for o in self.objects(node, SH + "in") for x in self.items(o)]
            for p, o in self.by.get(node, []):
                name = p[1:-1]
                if library.by_parameter(name):
                    value = allowed if name == SH + "in" else o
                    if (name, value) not in found.declarations:
                        found.declarations.append((name, value))
                elif name in PENDING:
                    found.pending.append(name)
            out.append(found)
        return out


def targets(graph: Graph, data_graph: str | None, shapes: Shapes, shape: str) -> DataFrame:
    """(focus): instances of the target classes, by direct type, and the target nodes."""
    classes = shapes.objects(shape, SH + "targetClass")
    nodes = [(n,) for n in shapes.objects(shape, SH + "targetNode")]
    data = in_graph(graph.store.quads, data_graph)
    typed = data.where((F.col("p") == T.TYPE) & F.col("o").isin(classes)).select(F.col("s").alias("focus"))
    return typed.union(local_df(graph.spark, nodes, "focus string")).distinct()


def check(graph: Graph, data_graph: str | None, wanted: list[tuple[PropertyShape, DataFrame]], library: ConstraintLibrary) -> DataFrame:
    """Violations of property shapes at the focus nodes given for each; columns of VIOLATION_KEYS, lazy."""
    spark = graph.spark
    data = in_graph(graph.store.quads, data_graph).select("s", "p", "o")
    found = [(k, ps, foci) for k, (ps, foci) in enumerate(wanted) if ps.declarations]
    schema = ", ".join(f"{k} string" for k in VIOLATION_KEYS)
    if not found:
        return local_df(spark, [], schema)
    rows = None
    for k, ps, foci in found:
        part = foci.select(F.lit(k).alias("k"), "focus", F.lit(ps.path).alias("path"))
        rows = part if rows is None else rows.unionByName(part)
    paths = sorted({ps.path for _, ps, _ in found})
    values = data.where(F.col("p").isin(paths)).select(F.col("s").alias("vs"), F.col("p").alias("vp"), F.col("o").alias("node"))
    rows = rows.join(values, (F.col("focus") == F.col("vs")) & (F.col("path") == F.col("vp")), "left").select("k", "focus", "path", "node")
    classes = sorted({v for _, ps, _ in found for p, v in ps.declarations if p == SH + "class"})
    for c in classes:
        has = data.where((F.col("p") == T.TYPE) & (F.col("o") == c)).select(F.col("s").alias("cs")).distinct().withColumn(class_flag(c), F.lit(True))
        rows = rows.join(has, F.col("node") == F.col("cs"), "left").drop("cs")
    measures, tests = [], []
    for k, ps, _ in found:
        for i, (param, value) in enumerate(ps.declarations):
            c = library.by_parameter(param)
            name = f"m_{k}_{i}"
            # a null node stands for no value; rows of other property shapes do not reach this aggregate's test
            measures.append(c.measure(F.col("node"), value).alias(name))
            bad = (F.col("k") == k) & F.coalesce(c.violated(F.col(name), value), F.lit(False))
            entry = F.struct(
                F.lit(ps.node).alias("source_shape"),
                F.lit(f"<{c.iri}>").alias("source_constraint_component"),
                c.message(F.col(name), value).alias("message"),
            )
            tests.append(F.when(bad, entry))
    groups = rows.groupBy("k", "focus", "path").agg(*measures)
    each = groups.select("focus", "path", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("v"))
    return each.select(
        F.col("focus").alias("focus_node"),
        "path",
        "v.source_shape",
        "v.source_constraint_component",
        F.lit(f"<{SH}Violation>").alias("severity"),
        F.lit(None).cast("string").alias("value"),
        "v.message",
    )


def violations_df(graph: Graph, data_graph: str | None, shapes_graph: str | None, library: ConstraintLibrary = CORE) -> DataFrame:
    """Lazy violations of all node shapes; pending parameters are ignored."""
    shapes = Shapes(graph, shapes_graph)
    wanted = []
    for shape in shapes.node_shapes():
        foci = targets(graph, data_graph, shapes, shape)
        wanted += [(ps, foci) for ps in shapes.property_shapes(shape, library)]
    return check(graph, data_graph, wanted, library)


def _report(graph: Graph, found: DataFrame, conforms: bool, report_graph: str) -> DataFrame:
    """Report quads; node names follow from what they report."""
    g = bare(report_graph)
    top = f"<{T.ENGINE}validation-report:{g}>"
    node = F.concat(F.lit(f"<{T.ENGINE}validation-result:"), F.sha2(F.concat_ws("|", F.lit(g), "source_shape", "focus_node", "path", "source_constraint_component", "message"), 256), F.lit(">"))
    head = graph.store.rows([(top, T.TYPE, f"<{SH}ValidationReport>", g), (top, f"<{SH}conforms>", T.literal(conforms), g)])
    named = found.withColumn("n", node)
    parts = {"focusNode": "focus_node", "resultPath": "path", "sourceShape": "source_shape", "sourceConstraintComponent": "source_constraint_component", "resultSeverity": "severity"}
    cells = [F.struct(F.lit(T.TYPE).alias("p"), F.lit(f"<{SH}ValidationResult>").alias("o"))]
    cells += [F.struct(F.lit(f"<{SH}{p}>").alias("p"), F.col(c).alias("o")) for p, c in parts.items()]
    cells.append(F.struct(F.lit(f"<{SH}resultMessage>").alias("p"), T.c_plain(F.col("message")).alias("o")))
    rows = named.select(F.col("n").alias("s"), F.explode(F.array(*cells)).alias("x")).select("s", "x.p", "x.o", F.lit(g).alias("g"))
    links = named.select(F.lit(top).alias("s"), F.lit(f"<{SH}result>").alias("p"), F.col("n").alias("o"), F.lit(g).alias("g"))
    return head.unionByName(rows).unionByName(links)


@guarded
def validate(graph: Graph, data_graph: str | None = None, shapes_graph: str | None = None, report_graph: str | None = None, scope=None, provenance: bool = True, constraint_library: ConstraintLibrary = CORE) -> dict:
    """{ok, conforms, violations, report_graph}; the report graph is replaced. A pending parameter refuses the whole call."""
    found = resolve(scope, {"data_graph": data_graph, "shapes_graph": shapes_graph, "report_graph": report_graph}, _SCOPE, ("data", "shapes"))
    if "kwargs" not in found:
        return found
    kw = found["kwargs"]
    data_graph, shapes_graph, report_graph = kw.get("data_graph"), kw.get("shapes_graph"), kw.get("report_graph")
    if error := R.invalid_graph(data_graph, shapes_graph, report_graph):
        return error
    report_graph = bare(report_graph or f"{data_graph}:report")
    graph.store.clear(report_graph)
    shapes = Shapes(graph, shapes_graph)
    wanted = []
    for shape in shapes.node_shapes():
        foci = targets(graph, data_graph, shapes, shape)
        for ps in shapes.property_shapes(shape, constraint_library):
            if ps.pending and not foci.isEmpty():
                return R.refused(R.UNKNOWN_CONSTRAINT_COMPONENT, f"not supported: {', '.join(sorted(set(ps.pending)))}")
            wanted.append((ps, foci))
    violations = pin(check(graph, data_graph, wanted, constraint_library))
    rows = [r.asDict() for r in violations.orderBy("focus_node", "source_shape", "source_constraint_component").collect()]
    graph.store.insert(_report(graph, violations, not rows, report_graph))
    return {"ok": True, "conforms": not rows, "violations": rows, "report_graph": report_graph}

"""Relational models (DataFrames), their fields as IRIs, and their normalisation into an OWL graph."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as ST

from . import capabilities
from . import reasons as R
from .functions import terms as T
from .graph import Graph, guarded
from .scope import resolve
from .store import bare

DEFAULT_PREFIX = "mm:"
_EXCLUDED = re.compile(r"^(ar_internal_metadata|schema_migrations|active_storage_.*|action_text_.*)$")
_UNSET = object()


def xsd_of(kind: ST.DataType) -> str:
    """Datatype IRI of a column."""
    table = [
        ((ST.ByteType, ST.ShortType, ST.IntegerType, ST.LongType), "integer"),
        ((ST.FloatType, ST.DoubleType), "double"),
        ((ST.DecimalType,), "decimal"),
        ((ST.BooleanType,), "boolean"),
        ((ST.DateType,), "date"),
        ((ST.TimestampType, ST.TimestampNTZType), "dateTime"),
        ((ST.BinaryType,), "base64Binary"),
    ]
    for kinds, name in table:
        if isinstance(kind, kinds):
            return T.XSD + name
    return T.XSD + "string"


def model_name(table: str) -> str:
    """`norm_authors` -> `NormAuthor`."""
    return "".join(w.capitalize() for w in singular(table).split("_"))


def singular(word: str) -> str:
    for end, other in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh")):
        if word.endswith(end):
            return word[: -len(end)] + other
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


class Schema:
    """Models are registered with their table's DataFrame and key."""

    def __init__(self):
        self.models: dict[str, tuple[DataFrame, str]] = {}
        self.overrides: dict[tuple[str, str], dict] = {}
        self._prefix: object = _UNSET

    @property
    def iri_prefix(self) -> str:
        """Set prefix, else the one of the last normalisation, else the default."""
        if self._prefix is not _UNSET:
            return self._prefix  # type: ignore[return-value]
        info = capabilities.schema_normalization_info()
        return (info or {}).get("iri_prefix") or DEFAULT_PREFIX

    @iri_prefix.setter
    def iri_prefix(self, prefix: str) -> None:
        self._prefix = prefix

    def reset(self) -> None:
        """Forgets overrides and sets the prefix to the default."""
        self._prefix, self.overrides = DEFAULT_PREFIX, {}

    def register(self, model: str, df: DataFrame, key: str = "id") -> None:
        self.models[model] = (df, key)

    def resolve_model(self, model: str) -> DataFrame | None:
        return self.models[model][0] if model in self.models else None

    def override(self, model: str, name: str, iri: str | None = None, column: str | None = None, xsd: str | None = None, supports_closure: bool = False) -> None:
        given = {"iri": iri, "column": column, "xsd": xsd, "supports_closure": supports_closure}
        self.overrides[model, name] = {k: v for k, v in given.items() if v is not None}

    def field(self, model: str, name: str) -> dict:
        """{iri, column, xsd, supports_closure}; column and xsd are None where the model or column is unknown."""
        df = self.resolve_model(model)
        known = df is not None and name in df.columns
        out = {"iri": f"{self.class_iri(model)}/{name}", "column": name if known else None, "xsd": xsd_of(df.schema[name].dataType) if known else None, "supports_closure": capabilities.schema_normalized()}
        return out | self.overrides.get((model, name), {})

    def class_iri(self, model: str) -> str:
        return f"{self.iri_prefix}{model}"


def foreign_key(column: str, tables: dict[str, DataFrame]) -> str | None:
    """The table that `<stem>_id` refers to by its name."""
    if not column.endswith("_id"):
        return None
    return next((t for t in tables if singular(t) == column[:-3]), None)


@guarded
def normalize(graph: Graph, tables: dict[str, DataFrame], iri_prefix: str = DEFAULT_PREFIX, include: list[str] | None = None, exclude: list[str] | None = None, schema_graph: str | None = None, scope=None, name_of: Callable[[str], str] = model_name, key_of: Callable = foreign_key) -> dict:
    """Describes tables as OWL classes with datatype and object properties, replacing the schema graph."""
    found = resolve(scope, {"schema_graph": schema_graph}, {"schema": "schema_graph"})
    if "kwargs" not in found:
        return found
    schema_graph = found["kwargs"].get("schema_graph") or T.ENGINE + "schema"
    if error := R.invalid_graph(schema_graph):
        return error
    chosen = {t: df for t, df in tables.items() if not _EXCLUDED.match(t) and (include is None or t in include) and t not in (exclude or [])}
    g, rows = bare(schema_graph), []
    counts = {"classes": 0, "datatype_properties": 0, "object_properties": 0}

    def add(s, p, o):
        rows.append((f"<{s}>", p if p.startswith("<") else f"<{p}>", o, g))

    for name, df in chosen.items():
        cls = f"{iri_prefix}{name_of(name)}"
        add(cls, T.TYPE, f"<{T.OWL}Class>")
        counts["classes"] += 1
        for f in df.schema.fields:
            prop, other = f"{cls}/{f.name}", key_of(f.name, chosen)
            kind = "ObjectProperty" if other else "DatatypeProperty"
            add(prop, T.TYPE, f"<{T.OWL}{kind}>")
            add(prop, T.RDFS + "domain", f"<{cls}>")
            add(prop, T.RDFS + "range", f"<{iri_prefix}{name_of(other)}>" if other else f"<{xsd_of(f.dataType)}>")
            counts["object_properties" if other else "datatype_properties"] += 1
    graph.store.clear(g)
    n = graph.store.insert(graph.store.rows(rows))
    capabilities.set_schema_normalized(g, iri_prefix)
    return {"ok": True, "schema_graph": g, "triples": n, **counts}

"""What this engine can do, and what has been normalised."""

from __future__ import annotations

from . import __version__
from .graph import Graph
from .sources.ntriples import split_line

CONTENT_KINDS = ("plain_ntriples", "ntriples_star")
_normalization: dict | None = None


def rdf_star_writes_enabled() -> bool:
    return hasattr(Graph, "quoted_triple")


def facade_version() -> str:
    return __version__


def engine_version(spark) -> str:
    """The engine below is Spark itself."""
    return f"spark-{spark.version}"


def checkpoint_can_round_trip(content_kind: str) -> bool:
    if content_kind == "plain_ntriples":
        return True
    if content_kind == "ntriples_star":
        probe = split_line("<< <urn:a> <urn:b> <urn:c> >> <urn:d> <urn:e> .")
        return probe is not None and probe[0].startswith("<< ")
    raise ValueError(f"unknown content kind {content_kind!r}, known: {CONTENT_KINDS}")


def sparql_method_available(name: str) -> bool:
    return callable(getattr(Graph, name, None))


def schema_normalized() -> bool:
    return _normalization is not None


def schema_normalization_info() -> dict | None:
    return _normalization


def set_schema_normalized(schema_graph: str, iri_prefix: str) -> None:
    global _normalization
    _normalization = {"schema_graph": schema_graph, "iri_prefix": iri_prefix}


def reset_schema_normalization() -> None:
    global _normalization
    _normalization = None

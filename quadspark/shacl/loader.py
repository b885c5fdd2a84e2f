"""Loading of shapes from a file, a text or a stream, once per content."""

from __future__ import annotations

import hashlib
import os
from typing import Any

from .. import reasons as R
from ..functions import terms as T
from ..graph import Graph, guarded
from ..plans.parser import ParseError
from ..sources import ntriples as N
from ..sources import turtle
from ..store import bare

DEFAULT_GRAPH = T.ENGINE + "shapes"
META = ":meta"
LOAD = f"<{T.ENGINE}shapes-load>"
HASH = f"<{T.ENGINE}shapes-content-hash>"
SOURCE = f"<{T.ENGINE}shapes-source>"
_ENDINGS = (".ttl", ".nt", ".n3", ".rdf", ".shapes", ".shacl")


def _read(source: Any) -> tuple[str, str] | dict:
    """(text, label), or a refusal."""
    if hasattr(source, "read"):
        return source.read(), str(getattr(source, "name", "<io>"))
    if isinstance(source, os.PathLike):
        source = os.fspath(source)
        if not os.path.isfile(source):
            return R.refused(R.SHAPES_FILE_MISSING, f"no file at {source!r}")
    if not isinstance(source, str):
        return R.refused(R.SHAPES_FILE_MISSING, f"{source!r} is neither a path, a text nor a stream")
    looks_like_path = "\n" not in source and source.lower().endswith(_ENDINGS)
    if looks_like_path or "\n" not in source and len(source) < 1024 and os.path.isfile(source):
        if not os.path.isfile(source):
            return R.refused(R.SHAPES_FILE_MISSING, f"no file at {source!r}")
        with open(source, encoding="utf-8") as f:
            return f.read(), source
    return source, "<inline>"


@guarded
def load_shapes(graph: Graph, source: Any, format: str = "ttl", scope: str | None = None) -> dict:
    """{ok, loaded, scope}; a content that was the last one loaded there is not loaded again (reason `unchanged`). Other content is added."""
    if format not in ("ttl", "nt"):
        return R.refused(R.SHAPES_FORMAT_UNKNOWN, f"format is ttl or nt, got {format!r}")
    if error := R.invalid_graph(scope):
        return error
    found = _read(source)
    if isinstance(found, dict):
        return found
    text, label = found
    target = bare(scope or DEFAULT_GRAPH)
    meta, digest = target + META, hashlib.sha256(text.encode()).hexdigest()
    mark = graph.store.rows([(LOAD, HASH, f'"{digest}"', meta)])
    if graph.store.quads.join(mark, ["s", "p", "o", "g"], "left_semi").count():
        return {"ok": True, "loaded": 0, "scope": target, "reason": "unchanged"}
    try:
        rows = turtle.parse(text, target) if format == "ttl" else [(*t, target) for t in N.triples(text)]
    except (ParseError, N.ParseError) as e:
        return R.refused(R.SHAPES_PARSE_ERROR, e)
    n = graph.store.insert(graph.store.rows(rows))
    graph.store.clear(meta)
    graph.store.insert(graph.store.rows([(LOAD, HASH, f'"{digest}"', meta), (LOAD, SOURCE, T.literal(label), meta)]))
    return {"ok": True, "loaded": n, "scope": target}

"""Durable graphs: a named graph that is hydrated from a blob and checkpointed to it.

A FolderBlob is read and written by tasks, so its graph may be of any size; other blobs are one text on the driver.
"""

from __future__ import annotations

import threading

from pyspark.errors import PySparkException

from . import reasons as R
from .graph import Graph, guarded
from .sources import ntriples as N
from .sources.blobs import Blob, FolderBlob, slug
from .store import bare, in_graph

CONTENT_TYPE = "application/n-triples"
BATCH = 1000
_lock = threading.Lock()
_hydrated: set[tuple[int, str]] = set()


def hydrated(graph: Graph, iri: str) -> bool:
    return (id(graph), bare(iri)) in _hydrated


def evict(graph: Graph, iri: str) -> None:
    with _lock:
        _hydrated.discard((id(graph), bare(iri)))


def reset() -> None:
    with _lock:
        _hydrated.clear()


class EtherealGraph:
    """policy: `explicit`, or `save` to checkpoint by saved()."""

    def __init__(self, graph: Graph, iri: str | None, blob: Blob | FolderBlob, policy: str = "explicit"):
        if policy not in ("explicit", "save"):
            raise ValueError("policy is `explicit` or `save`")
        self.graph, self.iri, self.blob, self.policy = graph, iri, blob, policy
        self._busy = threading.local()

    def _undeclared(self) -> dict | None:
        return R.refused(R.ETHEREAL_GRAPH_UNDECLARED, "no graph is declared") if not self.iri else None

    @guarded
    def hydrate(self) -> dict:
        """Loads the blob once per process and graph; a malformed row leaves the graph unhydrated."""
        if error := self._undeclared():
            return error
        with _lock:
            if hydrated(self.graph, self.iri):
                return R.refused(R.ALREADY_HYDRATED, f"{self.iri} is already hydrated")
        if not self.blob.attached():
            return R.refused(R.NO_BLOB, "no blob is attached")
        try:
            rows = self._rows()
            if rows is None:
                return R.refused(R.EMPTY_BLOB, "the blob has no triples")
            n = self.graph.store.insert(rows)
        except N.ParseError as e:
            return R.refused(R.INVALID_DSL, e)
        except PySparkException as e:
            if "not N-Triples" not in str(e) and N.ParseError.__name__ not in str(e):  # an error of a task, not of a row
                raise
            return R.refused(R.INVALID_DSL, e)
        with _lock:
            _hydrated.add((id(self.graph), bare(self.iri)))
        return {"ok": True, "inserted": n}

    def _rows(self):
        """The blob's quads, or None if there are none."""
        if isinstance(self.blob, FolderBlob):
            return None if self.blob.empty() else self.blob.frame(bare(self.iri))
        found = [(*t, bare(self.iri)) for t in N.triples(self.blob.download())]
        return self.graph.store.rows(found) if found else None

    @guarded
    def checkpoint(self) -> dict:
        if error := self._undeclared():
            return error
        if getattr(self._busy, "on", False):
            return R.refused(R.REENTRANT_CHECKPOINT, "a checkpoint is under way")
        self._busy.on = True
        try:
            if isinstance(self.blob, FolderBlob):
                return {"ok": True, "written": self.blob.attach_frame(in_graph(self.graph.store.quads, self.iri))}
            text = "".join(sorted(r["value"] + "\n" for r in self.graph.ntriples(self.iri).toLocalIterator()))
            self.blob.attach(text, slug(bare(self.iri)) + ".nt", CONTENT_TYPE)
        finally:
            self._busy.on = False
        return {"ok": True, "written": len(text.encode())}

    def saved(self) -> dict | None:
        """To be called after the host record is saved."""
        return self.checkpoint() if self.policy == "save" else None

    @guarded
    def retract(self) -> dict:
        if error := self._undeclared():
            return error
        n = self.graph.store.clear(self.iri)
        evict(self.graph, self.iri)
        return {"ok": True, "count": n}

    def evict(self) -> None:
        evict(self.graph, self.iri)

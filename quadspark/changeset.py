"""Change capture: what a block of code adds and retracts."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import ENGINE
from .scope import Scope
from .sources.ntriples import QUADS


class NestedCaptureError(RuntimeError):
    """Captures do not nest."""


class ScopeMismatch(RuntimeError):
    """A write outside the scope of the active capture."""


_active: contextvars.ContextVar[ChangeSet | None] = contextvars.ContextVar("changes", default=None)


class ChangeSet:
    """added and retracted: quads (s, p, o, g) as canonical terms; tuples once the capture is over."""

    def __init__(self, scope: Scope | None):
        self.scope, self.id = scope, str(uuid.uuid4())
        self.added: list | tuple = []
        self.retracted: list | tuple = []
        #: written tables of quads that came as DataFrames; they are never collected
        self.added_frames: list[DataFrame] = []
        self.retracted_frames: list[DataFrame] = []

    @property
    def graph_iri(self) -> str:
        return f"{ENGINE}changeset:{self.id}"

    def accepts(self, graph: str | None) -> bool:
        return self.scope is None or graph is None or graph in self.scope.read_graphs | self.scope.write_graphs

    def record_frame(self, where: str, rows: DataFrame) -> None:
        """Quads of a written table; those outside the scope are left out."""
        if self.scope is not None:
            inside = sorted(self.scope.read_graphs | self.scope.write_graphs)
            rows = rows.where(F.col("g").isNull() | F.col("g").isin(inside))
        getattr(self, where + "_frames").append(rows)

    def frame(self, where: str) -> DataFrame | None:
        """All quads added or retracted (`where`) as one DataFrame; None if there are none."""
        frames = list(getattr(self, where + "_frames"))
        if rows := getattr(self, where):
            from .store import local_df

            spark = frames[0].sparkSession if frames else SparkSession.getActiveSession()
            frames.append(local_df(spark, [tuple(r) for r in rows], QUADS))
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out

    def record(self, where: str, rows) -> None:
        for s, p, o, g in rows:
            if not self.accepts(g):
                raise ScopeMismatch(f"graph {g!r} is outside the scope of the active change set")
            getattr(self, where).append((s, p, o, g))


def active() -> ChangeSet | None:
    return _active.get()


def record_add(s: str, p: str, o: str, g: str | None = None) -> None:
    if (now := active()) is not None:
        now.record("added", [(s, p, o, g)])


def record_retract(s: str, p: str, o: str, g: str | None = None) -> None:
    if (now := active()) is not None:
        now.record("retracted", [(s, p, o, g)])


@contextlib.contextmanager
def capture(scope: Scope | None = None) -> Iterator[ChangeSet]:
    """Records bulk writes and DATA updates of this thread; other updates are not seen."""
    if active() is not None:
        raise NestedCaptureError("captures do not nest")
    changes = ChangeSet(scope)
    token = _active.set(changes)
    try:
        yield changes
    finally:
        _active.reset(token)
        changes.added, changes.retracted = tuple(changes.added), tuple(changes.retracted)


def notify_frame(where: str, rows: DataFrame) -> None:
    """The rows of a DataFrame write for the active capture."""
    if (now := active()) is not None:
        now.record_frame(where, rows)


def notify(where: str, rows) -> None:
    """A write's rows for the active capture; writes outside its scope are left out."""
    now = active()
    if now is not None:
        with contextlib.suppress(ScopeMismatch):
            now.record(where, rows)

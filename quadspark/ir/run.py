"""Validation and execution of programs."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from .. import reasons as R
from ..graph import Graph
from ..plans.explain import plan
from ..schema import Schema
from . import nodes as I
from . import router


@dataclass
class QueryContext:
    """What a program runs on: a graph, and models registered in a schema."""

    graph: Graph | None = None
    schema: Schema = field(default_factory=Schema)


def validate(ir) -> dict | None:
    """A refusal, or None for a valid program."""

    def bad(because: str) -> dict:
        return R.refused(R.IR_INVALID, because)

    if not isinstance(ir, (list, tuple)) or not ir:
        return bad("a program is a list of nodes")
    for n in ir:
        if not isinstance(n, I.NODES):
            return bad(f"unknown node {n!r}")
    if not isinstance(ir[0], I.Find) or len(I.all_of(ir, I.Find)) != 1:
        return bad("a program starts with its only Find")
    for kind in (I.Limit, I.Offset, I.Count, I.Project, I.Compare):
        if len(I.all_of(ir, kind)) > 1:
            return bad(f"at most one {kind.__name__}")
    has = {k: I.find(ir, k) is not None for k in I.NODES}
    if has[I.Offset] and not has[I.Limit]:
        return bad("Offset needs Limit")
    if has[I.Count] and any(has[k] for k in (I.Limit, I.Sort, I.Project, I.Offset)):
        return bad("Count excludes Limit, Offset, Sort and Project")
    if has[I.Compare] and any(has[k] for k in (I.Limit, I.Sort, I.Project, I.Offset, I.Count)):
        return bad("Compare excludes Limit, Offset, Sort, Project and Count")
    for n in I.all_of(ir, I.Filter):
        if n.op not in I.OPS:
            return bad(f"unknown filter op {n.op!r}")
    return None


def run(ctx: QueryContext, ir, scope: str | None = None, backend=None, with_meta: bool = False, needs=None) -> dict:
    """The envelope of a program's rows, count or comparison; with_meta adds plan, backend and ms."""
    if error := validate(ir):
        return error
    picked = router.pick(list(ir), backend, needs)
    if isinstance(picked, dict):
        return picked
    began = time.perf_counter()
    env = picked.execute(ctx, list(ir), scope)
    if with_meta:
        env = {**env, "plan": plan(env["query"]) if env.get("query") else None, "backend": picked.NAME, "ms": round(1000 * (time.perf_counter() - began), 3)}
    return env

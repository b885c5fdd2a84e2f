"""Programs on the graph plane: SPARQL text over the mapped predicates. Every field that is used must be bound, so rows without it vanish."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import DataFrame

from ..functions import terms as T
from . import nodes as I

NAME = "sparql"
CAPABILITIES = {"owl_closure": True, "shacl": True, "joins": "rdf", "datetime_filter": True, "fts": False, "named_graphs": True}


class Refused(ValueError):
    """A program that this backend cannot express."""


def supports(ir: list) -> bool:
    return True


def var_name(field: str) -> str:
    return re.sub(r"[-/.]", "_", field)


def term(value: Any) -> str:
    if value is None:
        raise Refused("the graph plane cannot compare with a missing value")
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, dt.datetime):
        at = value.astimezone(dt.timezone.utc) if value.tzinfo else value
        return T.typed(at.strftime("%Y-%m-%dT%H:%M:%S") + ("Z" if value.tzinfo else ""), T.XSD + "dateTime")
    if isinstance(value, dt.date):
        return T.typed(value.isoformat(), T.XSD + "date")
    text = str(value)
    return text if text.startswith("<") and text.endswith(">") else f'"{T.escape(text)}"'


def fields(ir: list) -> list[str]:
    """Fields in order of first use."""
    out: dict[str, None] = {}
    for n in ir:
        if isinstance(n, (I.Filter, I.FilterRange, I.FilterIn, I.Sort)):
            out[n.field] = None
        elif isinstance(n, I.Project):
            out |= dict.fromkeys(n.fields)
    return list(out)


def where(ctx, ir: list) -> str:
    model = I.find(ir, I.Find).type
    parts = [f"?s {T.TYPE} <{ctx.schema.class_iri(model)}> ."]
    parts += [f"?s <{ctx.schema.field(model, f)['iri']}> ?{var_name(f)} ." for f in fields(ir)]
    for n in ir:
        if isinstance(n, I.Filter):
            if n.op not in I.OPS:
                raise Refused(f"unknown filter op {n.op!r}")
            parts.append(f"FILTER(?{var_name(n.field)} {I.OPS[n.op]} {term(n.value)})")
        elif isinstance(n, I.FilterRange):
            lo, hi = (">=", "<=") if n.inclusive else (">", "<")
            v = var_name(n.field)
            parts.append(f"FILTER(?{v} {lo} {term(n.min)} && ?{v} {hi} {term(n.max)})")
        elif isinstance(n, I.FilterIn):
            parts.append(f"FILTER(?{var_name(n.field)} IN ({', '.join(map(term, n.values))}))")
    return " ".join(parts)


def compile_select(ctx, ir: list) -> str:
    project, limit, offset = I.find(ir, I.Project), I.find(ir, I.Limit), I.find(ir, I.Offset)
    shown = list(dict.fromkeys(["?s", *(f"?{var_name(f)}" for f in (project.fields if project else ()))]))
    text = f"SELECT {' '.join(shown)} WHERE {{ {where(ctx, ir)} }}"
    sorts = I.all_of(ir, I.Sort)
    if sorts:
        text += " ORDER BY " + " ".join(f"{'DESC' if s.dir == 'desc' else 'ASC'}(?{var_name(s.field)})" for s in sorts)
    if limit:
        text += f" LIMIT {int(limit.n)}"
    if offset:
        text += f" OFFSET {int(offset.n)}"
    return text


def compile_count(ctx, ir: list) -> str:
    return f"SELECT (COUNT(?s) AS ?count) WHERE {{ {where(ctx, ir)} }}"


def compile_compare(ctx, model: str, focus: str, field: str) -> str:
    return f"SELECT ?val WHERE {{ {T.iri(str(focus))} <{ctx.schema.field(model, field)['iri']}> ?val }} LIMIT 1"


def frame(ctx, ir: list, graph: str | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Lazy rows of a program without Compare."""
    if I.find(ir, I.Count):
        return ctx.graph.select_df(compile_count(ctx, ir), graph, {"count": "long"} | (types or {}))
    return ctx.graph.select_df(compile_select(ctx, ir), graph, types)


def execute(ctx, ir: list, graph: str | None = None) -> dict:
    try:
        if (c := I.find(ir, I.Compare)) is not None:
            model = I.find(ir, I.Find).type
            values = []
            for focus in (c.left, c.right):
                env = ctx.graph.select(compile_compare(ctx, model, focus, c.field), graph)
                if not env["ok"]:
                    return {**env, "from": NAME}
                values.append(T.parse_plain(env["results"][0]["val"]) if env["results"] else None)
            return {"ok": True, "results": [{"left": values[0], "right": values[1], "equal": values[0] == values[1]}], "from": NAME}
        count = I.find(ir, I.Count) is not None
        query = compile_count(ctx, ir) if count else compile_select(ctx, ir)
    except Refused as e:
        return {"ok": False, "reason": "ir_invalid", "because": str(e), "from": NAME}
    env = ctx.graph.select(query, graph)
    if not env["ok"]:
        return {**env, "from": NAME, "query": query}
    rows = [{k: T.parse_plain(v) for k, v in r.items()} for r in env["results"]]
    if count:
        return {"ok": True, "count": int(rows[0]["count"]) if rows else 0, "from": NAME, "query": query}
    return {"ok": True, "results": rows, "from": NAME, "query": query}

"""A query's plan as nested dicts, from its algebra. Nothing is executed."""

from __future__ import annotations

from . import algebra as A
from .parser import parse_query, parse_update

_UPDATES = {"insert_data": "insert_data", "delete_data": "delete_data", "clear": "clear", "load": "load", "drop": "drop", "create": "create"}


def _text(x) -> str:
    if isinstance(x, A.Quoted):
        return f"<< {_text(x.s)} {_text(x.p)} {_text(x.o)} >>"
    if isinstance(x, str):
        return x
    return {A.Seq: lambda: "/".join(map(_text, x.parts)), A.Alt: lambda: "(" + "|".join(map(_text, x.parts)) + ")", A.Inv: lambda: "^" + _text(x.path), A.Rep: lambda: f"({_text(x.path)})" + ("+" if x.least else "*" if x.many else "?"), A.Neg: lambda: "!(" + "|".join([*x.forward, *("^" + b for b in x.backward)]) + ")"}[type(x)]()


_INFIX = {"and": "&&", "or": "||", "=": "=", "!=": "!=", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "+": "+", "-": "-", "*": "*", "/": "/"}


def expression(e) -> str:
    op, args = e[0], e[1:]
    if op in ("var", "term"):
        return args[0]
    if op in _INFIX:
        return f"{_nested(args[0])} {_INFIX[op]} {_nested(args[1])}"
    if op in ("not", "neg"):
        return ("!" if op == "not" else "-") + _nested(args[0])
    if op in ("in", "notin"):
        return f"{expression(args[0])} {'IN' if op == 'in' else 'NOT IN'} ({', '.join(map(expression, args[1:]))})"
    if op == "agg":
        inner = "*" if args[2] is None else expression(args[2])
        return f"{args[0]}({'DISTINCT ' if args[1] else ''}{inner})"
    if op == "exists":
        return ("" if args[0] else "NOT ") + "EXISTS {...}"
    if op == "cast":
        return f"<{args[0]}>({expression(args[1])})"
    return f"{op}({', '.join(map(expression, args))})"


def _nested(e) -> str:
    return f"({expression(e)})" if e[0] in ("and", "or") else expression(e)


def _triples(triples) -> list:
    return [[_text(t.s), _text(t.p), _text(t.o)] for t in triples]


def where(node) -> dict:
    """{kind, patterns} and, where there are any, filters, binds, graphs, optionals, unions, minus, values, subselects."""
    out: dict = {"kind": "bgp", "patterns": []}

    def add(key, value):
        out.setdefault(key, []).append(value)

    def walk(n):
        if isinstance(n, A.BGP):
            out["patterns"] += _triples(n.triples)
        elif isinstance(n, A.Join):
            walk(n.left)
            walk(n.right)
        elif isinstance(n, A.Filter):
            walk(n.node)
            add("filters", {"expression": expression(n.condition)})
        elif isinstance(n, A.Extend):
            walk(n.node)
            add("binds", {"expression": expression(n.value), "var": n.var})
        elif isinstance(n, A.Graph):
            inner = where(n.node)
            add("graphs", {"iri": n.name if A.is_var(n.name) else f"<{n.name}>", **{k: v for k, v in inner.items() if k != "kind"}})
        elif isinstance(n, A.LeftJoin):
            walk(n.left)
            inner = where(n.right)
            if n.condition is not None:
                inner.setdefault("filters", []).append({"expression": expression(n.condition)})
            add("optionals", inner)
        elif isinstance(n, A.Union):
            add("unions", {"left": where(n.left), "right": where(n.right)})
        elif isinstance(n, A.Minus):
            walk(n.left)
            add("minus", where(n.right))
        elif isinstance(n, A.Values):
            add("values", {"vars": n.vars, "rows": n.rows})
        elif isinstance(n, A.Select):
            add("subselects", {"projection": projection(n), "where": where(n.where), "modifiers": modifiers(n)})

    walk(node)
    return out


def projection(q: A.Select) -> list[str]:
    if q.projection is None:
        return ["*"]
    return [v if e is None else f"({expression(e)} AS {v})" for v, e in q.projection]


def modifiers(q: A.Select) -> dict:
    return {
        "order_by": [{"var": expression(e), "dir": "desc" if down else "asc"} for e, down in q.order] or None,
        "limit": q.limit,
        "offset": q.offset or None,
        "group_by": [v or expression(e) for v, e in q.group] or None,
        "having": " && ".join(map(expression, q.having)) or None,
    }


def plan(text: str) -> dict:
    """Raises ParseError for text that is neither query nor update."""
    from .parser import ParseError

    try:
        q = parse_query(text)
    except ParseError as query_error:
        try:
            found = [_update(u) for u in parse_update(text)]
        except ParseError:
            raise query_error from None
        return found[0] if len(found) == 1 else {"kind": "update", "operation": "sequence", "operations": found}
    out: dict = {"kind": q.form}
    if q.form == "select":
        out["projection"] = projection(q.select)
    if q.form == "construct":
        out["template"] = _triples(t for _, t in q.template)
    out |= {"where": where(q.select.where), "modifiers": modifiers(q.select)}
    return out


def _update(u: A.Update) -> dict:
    out: dict = {"kind": "update"}
    if u.kind == "modify":
        out["operation"] = "delete_where" if u.delete else "insert_where"
        out |= {"template": _triples(t for _, t in u.delete or u.insert), "where": where(u.where)}
        if u.delete and u.insert:
            out["insert"] = _triples(t for _, t in u.insert)
        return out
    out["operation"] = u.kind
    if u.kind in ("insert_data", "delete_data"):
        out["data"] = _triples(t for _, t in u.insert or u.delete)
    elif u.kind in ("clear", "drop", "create"):
        out["target"] = u.target if u.target in ("ALL", "DEFAULT", "NAMED") else f"<{u.target}>"
    elif u.kind == "load":
        out |= {"source": u.source, "into_graph": None if u.target == "DEFAULT" else u.target}
    else:
        out |= {"source": u.source, "target": u.target}
    return out

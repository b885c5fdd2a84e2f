"""Programs on tables: a chain of DataFrame operations over one registered model. Rows keep their nulls."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reasons as R
from . import nodes as I

NAME = "relational"
CAPABILITIES = {"owl_closure": False, "shacl": False, "joins": "ar", "datetime_filter": True, "fts": False, "named_graphs": False}


class Refused(ValueError):
    """A program that this backend refuses, with a reason."""

    def __init__(self, reason: str, because: str):
        super().__init__(because)
        self.reason = reason


def supports(ir: list) -> bool:
    return True


def _model(ctx, ir: list) -> tuple[DataFrame, str, str]:
    if not ctx.schema.models:
        raise Refused(R.AR_NOT_LOADED, "no relational models are registered")
    name = I.find(ir, I.Find).type
    if name not in ctx.schema.models:
        raise Refused(R.MODEL_UNKNOWN, f"unknown model {name!r}")
    df, key = ctx.schema.models[name]
    return df, key, name


def _column(ctx, model: str, df: DataFrame, field: str) -> Column:
    name = ctx.schema.field(model, field)["column"] or field
    if name not in df.columns:
        raise Refused(R.AR_QUERY_ERROR, f"{model} has no column {name!r}")
    return F.col(name)


def _filter(c: Column, op: str, value) -> Column:
    if value is None and op in ("eq", "neq"):
        return c.isNull() if op == "eq" else c.isNotNull()
    table = {"eq": c == value, "neq": c != value, "lt": c < value, "lte": c <= value, "gt": c > value, "gte": c >= value}
    if op not in table:
        raise Refused(R.IR_INVALID, f"unknown filter op {op!r}")
    return table[op]


def frame(ctx, ir: list) -> DataFrame:
    """Lazy rows of a program without Compare; a count is one row."""
    df, key, model = _model(ctx, ir)
    out = df
    for n in ir:
        if isinstance(n, I.Filter):
            out = out.where(_filter(_column(ctx, model, df, n.field), n.op, n.value))
        elif isinstance(n, I.FilterRange):
            c = _column(ctx, model, df, n.field)
            out = out.where(c.between(n.min, n.max) if n.inclusive else (c > n.min) & (c < n.max))
        elif isinstance(n, I.FilterIn):
            out = out.where(_column(ctx, model, df, n.field).isin(list(n.values)))
    sorts = [(_column(ctx, model, df, s.field), s.dir) for s in I.all_of(ir, I.Sort)]
    if sorts:
        out = out.orderBy(*(c.desc() if d == "desc" else c.asc() for c, d in sorts))
    if (o := I.find(ir, I.Offset)) is not None:
        out = out.offset(int(o.n))
    if (n := I.find(ir, I.Limit)) is not None:
        out = out.limit(int(n.n))
    if I.find(ir, I.Count) is not None:
        return out.agg(F.count(F.lit(1)).alias("count"))
    s = F.col(key).cast("string").alias("s") if key in df.columns else F.lit(None).cast("string").alias("s")
    project = I.find(ir, I.Project)
    if project is not None:
        return out.select(s, *(_column(ctx, model, df, f).alias(f) for f in project.fields))
    return out.select(s, *(c for c in df.columns if c != key))


def execute(ctx, ir: list, graph: str | None = None) -> dict:
    try:
        if (c := I.find(ir, I.Compare)) is not None:
            df, key, model = _model(ctx, ir)
            value = _column(ctx, model, df, c.field).alias("v")
            found = {str(r["k"]): r["v"] for r in df.where(F.col(key).cast("string").isin(str(c.left), str(c.right))).select(F.col(key).alias("k"), value).collect()}
            left, right = found.get(str(c.left)), found.get(str(c.right))
            return {"ok": True, "results": [{"left": left, "right": right, "equal": left == right}], "from": NAME}
        rows = [r.asDict() for r in frame(ctx, ir).collect()]
    except Refused as e:
        return {"ok": False, "reason": e.reason, "because": str(e), "from": NAME}
    except PySparkException as e:
        return {"ok": False, "reason": R.AR_QUERY_ERROR, "because": str(e), "from": NAME}
    if I.find(ir, I.Count) is not None:
        return {"ok": True, "count": rows[0]["count"], "from": NAME}
    return {"ok": True, "results": rows, "from": NAME}

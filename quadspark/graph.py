"""The facade: SPARQL queries and updates, bulk writes, explain. Calls return envelopes instead of raising; `select_df` and its kin stay lazy."""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import changeset, scope as S
from . import reasons as R
from .functions import terms as T
from .functions.expressions import EvaluationError
from .operators.patterns import Compiler, Dataset, Solutions, column
from .plans import algebra as A
from .plans.explain import plan
from .plans.parser import ParseError, fresh_blank, parse_query, parse_update
from .sources import ntriples as N
from .store import QuadStore, bare, in_graph, local_df, pin

_SCOPE = {"data": "graph"}
OMITTED = object()

#: How select_df(types=...) decodes a variable.
DECODERS = {
    "term": lambda c: c,
    "string": T.c_lexical,
    "iri": T.c_lexical,
    "long": lambda c: T.c_lexical(c).try_cast("bigint"),
    "int": lambda c: T.c_lexical(c).try_cast("int"),
    "double": lambda c: T.c_lexical(c).try_cast("double"),
    "boolean": lambda c: T.c_lexical(c) == "true",
    "timestamp": lambda c: F.to_timestamp(T.c_lexical(c)),
    "date": lambda c: F.to_date(T.c_lexical(c)),
    "cell": T.c_typed_cell,
}


class InvalidRequest(ValueError):
    """A request that is refused as invalid."""


def guarded(f):
    """Turns exceptions of a facade call into refusals."""
    import functools

    @functools.wraps(f)
    def call(*args, **kwargs):
        try:
            return f(*args, **kwargs)
        except ParseError as e:
            return R.refused(R.SPARQL_PARSE_ERROR, f"SPARQL parse error: {e}")
        except N.ParseError as e:
            return R.refused(R.SPARQL_PARSE_ERROR, f"parse error: {e}")
        except EvaluationError as e:
            return R.refused(R.SPARQL_EVAL_ERROR, f"SPARQL evaluation error: {e}")
        except InvalidRequest as e:
            return R.refused(R.INVALID_DSL, e)
        except PySparkException as e:
            return R.refused(R.SPARQL_EVAL_ERROR, f"SPARQL evaluation error: {e}")
        except Exception as e:
            return R.refused(R.UNEXPECTED_ERROR, e)

    return call


class Graph:
    def __init__(self, spark: SparkSession, quads: DataFrame | None = None):
        self.spark = spark
        self.store = QuadStore(spark, quads)
        self.prefixes: dict[str, str] = {}

    # lazy forms

    def _compiler(self, query: A.Query, graph: str | None, quads: DataFrame | None = None) -> Compiler:
        default, named = tuple(query.default_graphs), tuple(query.named_graphs)
        if default or named:
            dataset = Dataset(default, named or ())
        else:
            # the graph argument sets the default graph only; named graphs stay visible
            dataset = Dataset((bare(graph),)) if graph else Dataset()
        return Compiler(self.store, dataset, quads)

    def solutions(self, query: str | A.Query, graph: str | None = None) -> Solutions:
        q = parse_query(query, self.prefixes) if isinstance(query, str) else query
        if q.form != "select":
            raise ParseError("a SELECT query is needed")
        return self._compiler(q, graph).select(q.select)

    def select_df(self, query: str | A.Query, graph: str | None = None, types: dict[str, str] | None = None) -> DataFrame:
        """Lazy rows with a column per variable: terms, or values decoded as `types` says (see DECODERS)."""
        found = self.solutions(query, graph)
        types = types or {}
        return found.df.select(*(DECODERS[types.get(v[1:], "term")](F.col(column(v))).alias(v[1:]) for v in found.vars))

    def construct_df(self, query: str | A.Query, graph: str | None = None) -> DataFrame:
        """Lazy distinct triples (s, p, o)."""
        q = parse_query(query, self.prefixes) if isinstance(query, str) else query
        compiler = self._compiler(q, graph)
        if q.form == "describe":
            return self._describe(q, compiler)
        if q.form != "construct":
            raise ParseError("a CONSTRUCT query is needed")
        found = compiler.select(A.Select(**{**vars(q.select), "projection": None}))
        return instantiate(found, q.template, None).select("s", "p", "o").distinct()

    def _describe(self, q: A.Query, compiler: Compiler) -> DataFrame:
        """Triples about the described nodes."""
        rows = compiler.scan(None)
        names = [n for n in q.template if not A.is_var(n)]
        nodes = local_df(self.spark, [(n,) for n in names], "n string")
        if any(A.is_var(n) for n in q.template):
            found = compiler.select(A.Select(**{**vars(q.select), "projection": None}))
            for v in q.template:
                if A.is_var(v) and v in found.vars:
                    nodes = nodes.union(found.df.select(F.col(column(v))))
        return rows.join(nodes.distinct(), F.col("s") == F.col("n"), "left_semi").select("s", "p", "o").distinct()

    # envelopes

    def _resolved(self, graph, scope) -> tuple[str | None, dict | None]:
        found = S.resolve(scope, {"graph": graph}, _SCOPE)
        if "kwargs" not in found:
            return None, found
        graph = found["kwargs"].get("graph")
        return graph, R.invalid_graph(graph)

    @guarded
    def select(self, query: str, graph: str | None = None, scope=None, with_types: bool = False) -> dict:
        graph, error = self._resolved(graph, scope)
        if error:
            return error
        rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in self.select_df(query, graph).collect()]
        if with_types:
            rows = [{k: T.parse_typed(v) for k, v in r.items()} for r in rows]
        return {"ok": True, "results": rows}

    @guarded
    def ask(self, query: str, graph: str | None = None, scope=None) -> dict:
        graph, error = self._resolved(graph, scope)
        if error:
            return error
        q = parse_query(query, self.prefixes)
        if q.form != "ask":
            raise ParseError("an ASK query is needed")
        return {"ok": True, "value": not self._compiler(q, graph).compile(q.select.where).df.isEmpty()}

    @guarded
    def construct(self, query: str, graph: str | None = None, scope=None) -> dict:
        graph, error = self._resolved(graph, scope)
        if error:
            return error
        lines = N.lines_of(self.construct_df(query, graph)).collect()
        return {"ok": True, "ntriples": "".join(sorted(r["value"] + "\n" for r in lines))}

    @guarded
    def explain(self, query: str, graph: str | None = None, scope=None) -> dict:
        graph, error = self._resolved(graph, scope)
        return error or {"ok": True, "plan": plan(query), "estimated_rows": "unknown", "from": "gem_parser"}

    @guarded
    def execute(self, update: str, graph: str | None = None, scope=None) -> dict:
        graph, error = self._resolved(graph, scope)
        return error or {"ok": True, "count": Updates(self, graph).run(update)}

    @guarded
    def store_size(self, graph: Any = OMITTED) -> dict:
        if graph is OMITTED:
            return {"ok": True, "count": self.store.size(everything=True)}
        return R.invalid_graph(graph) or {"ok": True, "count": self.store.size(graph)}

    @guarded
    def bulk_insert(self, rows, raw: bool = False) -> dict:
        return self._bulk(rows, "inserted", raw)

    @guarded
    def bulk_delete(self, rows, raw: bool = False) -> dict:
        return self._bulk(rows, "deleted", raw)

    def _bulk(self, rows, word: str, raw: bool) -> dict:
        write = self.store.insert if word == "inserted" else self.store.delete
        where = "added" if word == "inserted" else "retracted"
        if isinstance(rows, DataFrame):
            checked = sound(rows)
            n = write(checked)
            changeset.notify_frame(where, checked)
            return {"ok": True, word: n}
        found = [quad(r, k, raw) for k, r in enumerate(rows or [], 1)]
        if not found:
            return {"ok": True, word: 0}
        n = write(self.store.rows(found))
        changeset.notify(where, found)
        return {"ok": True, word: n}

    @guarded
    def insert_sql(self, text: str) -> dict:
        """Inserts the rows of a SQL query with columns s, p, o and graph (canonical terms; graph without brackets or null)."""
        rows = self.spark.sql(text)
        return self._bulk(rows.select("s", "p", "o", F.col("graph").cast("string").alias("g")), "inserted", True)

    quoted_triple = staticmethod(T.quoted_triple)

    # text

    @guarded
    def load_ntriples(self, path: str, graph: str | None = None) -> dict:
        return R.invalid_graph(graph) or {"ok": True, "count": self.store.insert(N.read(self.spark, path, None if graph is None else bare(graph)))}

    def ntriples(self, graph: str | None = None) -> DataFrame:
        return N.lines_of(in_graph(self.store.quads, graph))

    def create_view(self, name: str = "triples") -> None:
        """The store as a temporary view with a `graph` column."""
        self.store.quads.withColumnRenamed("g", "graph").createOrReplaceTempView(name)


def sound(rows: DataFrame) -> DataFrame:
    """rows (s, p, o[, g]) as a written table, or a refusal that names the first one that is not a quad of canonical terms."""
    if "g" not in rows.columns:
        rows = rows.withColumn("g", F.lit(None).cast("string"))
    s, p, o, g = (F.col(c) for c in ("s", "p", "o", "g"))
    good = (T.is_iri(s) | T.is_blank(s) | T.is_quoted(s)) & T.is_iri(p) & (T.c_kind(o) != "unknown") & ~F.coalesce(T.is_blank(g), F.lit(False))
    numbered = pin(rows.select("s", "p", "o", "g", F.monotonically_increasing_id().alias("n"), (~F.coalesce(good, F.lit(False))).alias("bad")))
    first = numbered.where("bad").orderBy("n").limit(1).collect()
    if first:
        row = first[0]
        number = numbered.where(F.col("n") < row["n"]).count() + 1
        raise InvalidRequest(f"row {number}: not a quad: {row['s']} {row['p']} {row['o']} {row['g'] or ''}")
    return numbered.select("s", "p", "o", "g")


def quad(row: Any, number: int, raw: bool = False) -> tuple:
    """A bulk row (mapping or sequence of 3 or 4) as canonical terms. raw: terms are N-Triples already."""
    try:
        if isinstance(row, dict):
            get = lambda *names: next((row[n] for n in names if n in row), None)
            parts = [get("s", "subject"), get("p", "predicate"), get("o", "object"), get("graph", "g")]
        elif isinstance(row, (list, tuple)) and len(row) in (3, 4):
            parts = [*row, None][:4]
        else:
            raise ValueError("a row is a mapping or a sequence of 3 or 4 values")
        s, p, o, g = parts
        if s is None or p is None or o is None:
            raise ValueError("subject, predicate and object are needed")
        if isinstance(g, str) and g.startswith("_:"):
            raise ValueError("a graph cannot be a blank node")
        if raw:
            found = N.split_line(f"{s} {p} {o} .")
            if found is None:
                raise ValueError("not N-Triples terms")
            s, p, o = found
        else:
            s, p, o = T.subject(s), T.predicate(p), T.object_(o)
        return (s, p, o, None if g is None else bare(str(g)))
    except ValueError as e:
        raise InvalidRequest(f"row {number}: {e}") from None


def instantiate(found: Solutions, template: list, graph: str | None) -> DataFrame:
    """Quads of a template for every solution; illegal ones are left out. Blank nodes are fresh for each solution."""
    df = found.df
    blanks = {x for _, t in template for x in (t.s, t.p, t.o) if A.is_var(x) and x.startswith("?_:") and x not in found.vars}
    if blanks:
        df = df.withColumn("u__id", F.uuid())

    def col(term):
        if isinstance(term, A.Quoted):
            return F.concat_ws(" ", F.lit("<<"), col(term.s), col(term.p), col(term.o), F.lit(">>"))
        if not A.is_var(term):
            return F.lit(term)
        if term in blanks:
            return F.concat(F.lit("_:" + re.sub(r"\W", "_", term[3:]) + "_"), F.replace(F.col("u__id"), F.lit("-")))
        c = found.col(term)
        return F.lit(None).cast("string") if c is None else c

    def sound(term):
        """Whether the triple inside a quoted term could be stated."""
        if not isinstance(term, A.Quoted):
            return F.lit(True)
        s, p = col(term.s), col(term.p)
        return (T.is_iri(s) | T.is_blank(s) | T.is_quoted(s)) & T.is_iri(p) & col(term.o).isNotNull() & sound(term.s) & sound(term.o)

    rows = []
    for g, t in template:
        name = F.lit(graph).cast("string") if g is None else T.c_lexical(col(g)) if A.is_var(g) else F.lit(g)
        legal = (T.is_iri(F.col("s")) | T.is_blank(F.col("s")) | T.is_quoted(F.col("s"))) & T.is_iri(F.col("p")) & F.col("o").isNotNull()
        part = df.where(sound(t.s) & sound(t.o)).select(col(t.s).alias("s"), col(t.p).alias("p"), col(t.o).alias("o"), name.alias("g")).where(legal)
        rows.append(part.where(F.col("g").isNotNull()) if g is not None else part)
    if not rows:
        return local_df(found.df.sparkSession, [], N.QUADS)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


class Updates:
    """Runs update text; the count follows the form: net change, or rows given for DATA with a graph."""

    def __init__(self, graph: Graph, target: str | None):
        self.graph, self.store, self.target = graph, graph.store, None if target is None else bare(target)

    def run(self, text: str) -> int:
        operations = parse_update(text, self.graph.prefixes)
        return sum(self.one(u) for u in operations)

    def _data(self, template: list, insert: bool) -> list[tuple]:
        load = uuid.uuid4().hex[:8]

        def ground(x):
            if isinstance(x, A.Quoted):
                return f"<< {ground(x.s)} {ground(x.p)} {ground(x.o)} >>"
            if A.is_var(x):
                if not x.startswith("?_:") or not insert:
                    raise ParseError("DATA blocks have no variables" if not x.startswith("?_:") else "DELETE DATA has no blank nodes")
                return fresh_blank(x[3:], load)
            return x

        rows = []
        for g, t in template:
            if not isinstance(t.p, str) or isinstance(t.s, str) and t.s.startswith('"'):
                raise ParseError("not a triple")
            rows.append((ground(t.s), ground(t.p), ground(t.o), self.target if g is None else g))
        return rows

    def one(self, u: A.Update) -> int:
        if u.kind in ("insert_data", "delete_data"):
            insert = u.kind == "insert_data"
            rows = self._data(u.insert or u.delete, insert)
            n = (self.store.insert if insert else self.store.delete)(self.store.rows(rows))
            changeset.notify("added" if insert else "retracted", rows)
            return n if insert and self.target is None else len(rows)
        if u.kind in ("clear", "drop", "create"):
            if self.target is not None and u.target in ("ALL", "DEFAULT", "NAMED"):
                raise InvalidRequest(f"{u.kind.upper()} {u.target} cannot be combined with a graph")
            if u.kind == "create":
                return 0
            n = self.store.clear(None if u.target in ("ALL", "DEFAULT", "NAMED") else u.target, everything=u.target == "ALL", named=u.target == "NAMED")
            return 0 if u.target in ("ALL", "DEFAULT") else n
        if u.kind == "load":
            try:
                rows = N.read(self.graph.spark, u.source, None if u.target == "DEFAULT" else u.target)
                return self.store.insert(rows)
            except Exception:
                if u.silent:
                    return 0
                raise
        if u.kind in ("copy", "move", "add"):
            return self._transfer(u)
        return self._modify(u)

    def _transfer(self, u: A.Update) -> int:
        source = None if u.source == "DEFAULT" else u.source
        target = None if u.target == "DEFAULT" else u.target
        if source == target:
            return 0
        quads = self.store.quads
        rows = in_graph(quads, source).withColumn("g", F.lit(target).cast("string"))
        none = quads.where(F.lit(False))
        removed = none if u.kind == "add" else in_graph(quads, target)
        if u.kind == "move":
            removed = removed.unionByName(in_graph(quads, source))
        return self.store.change(removed, rows)

    def _modify(self, u: A.Update) -> int:
        """WHERE is evaluated once; deletions, then insertions, are applied to that snapshot."""
        graph = u.with_graph or self.target
        if u.using or u.using_named:
            dataset = Dataset(tuple(u.using), tuple(u.using_named))
        else:
            dataset = Dataset((graph,)) if graph else Dataset()
        compiler = Compiler(self.store, dataset)
        found = compiler.compile(u.where)
        none = self.store.quads.where(F.lit(False))
        removed = instantiate(found, u.delete, graph) if u.delete else none
        added = instantiate(found, u.insert, graph) if u.insert else none
        return self.store.change(removed, added)

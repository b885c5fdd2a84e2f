"""Query algebra to DataFrames: scans, joins, paths, groups and slices. Catalyst and AQE pick the physical plan."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.expressions import EvaluationError, Expressions, V, order_key
from ..plans import algebra as A
from ..store import QuadStore, local_df, pin


@dataclass
class Solutions:
    """df has a term column for each variable; vars tells whether it is bound in every row."""

    df: DataFrame
    vars: dict[str, bool] = field(default_factory=dict)
    unit: bool = False  # one solution without bindings

    def col(self, var: str) -> Column | None:
        return F.col(column(var)) if var in self.vars else None


def column(var: str) -> str:
    return "v_" + re.sub(r"\W", lambda m: f"_{ord(m.group()):x}_", var[1:])


@dataclass(frozen=True)
class Dataset:
    """default: graphs merged into the default graph (None: the store's own, which is also what a None among them means). named: the visible named graphs (None: all)."""

    default: tuple | None = None
    named: tuple | None = None


#: Joins with more possibly unbound shared variables are made by one condition.
MOST_OPEN = 4
#: Variables of this prefix (no query can name them) hold the number of solutions that a row stands for; several are multiplied.
WEIGHT = "?#"
#: Expressions with these are evaluated for every solution.
EACH = ("exists", "RAND", "UUID", "STRUUID", "BNODE")


def _by_bound(df: DataFrame, columns: dict[str, str]):
    """(bound variables, their rows) for each way in which the columns can be bound."""
    names = list(columns)
    for k in range(1 << len(names)):
        bound = [v for i, v in enumerate(names) if k >> i & 1]
        rows = df
        for v in names:
            rows = rows.where(F.col(columns[v]).isNotNull() if v in bound else F.col(columns[v]).isNull())
        yield bound, rows


class Compiler:
    def __init__(self, store: QuadStore, dataset: Dataset = Dataset(), quads: DataFrame | None = None, extra: dict[str, DataFrame] | None = None):
        self.store, self.dataset = store, dataset
        self.quads = store.quads if quads is None else quads
        self.extra = extra or {}
        self._fresh = itertools.count()
        self.expressions_now = None

    # scans

    def scan(self, graph) -> DataFrame:
        """(s, p, o), with g as a term if `graph` is a variable."""
        if graph is None:
            wanted = self.dataset.default
            if wanted is None:
                return self.quads.where("g is null").select("s", "p", "o")
            names = [g for g in wanted if g is not None]
            here = F.col("g").isin(names) if names else F.lit(False)
            rows = self.quads.where(here | F.col("g").isNull() if None in wanted else here).select("s", "p", "o")
            return rows.distinct() if len(wanted) > 1 else rows
        named = self.dataset.named
        if A.is_var(graph):
            rows = self.quads.where(F.col("g").isNotNull() if named is None else F.col("g").isin(list(named)))
            return rows.select("s", "p", "o", T.c_iri(F.col("g")).alias("g"))
        if named is not None and graph not in named:
            return self.quads.where(F.lit(False)).select("s", "p", "o")
        return self.quads.where(F.col("g") == graph).select("s", "p", "o")

    def unit(self) -> Solutions:
        return Solutions(self.store.spark.range(1).select(F.lit(1).alias("u__")), {}, True)

    # patterns

    def compile(self, node, graph=None) -> Solutions:
        if isinstance(node, A.Unit):
            return self._graph_names(graph) if A.is_var(graph) else self.unit()
        if isinstance(node, A.BGP):
            return self.bgp(node.triples, graph)
        if isinstance(node, A.Join):
            if isinstance(node.left, A.BGP) and isinstance(node.right, A.BGP):
                return self.bgp(node.left.triples + node.right.triples, graph)
            return self.join(self.compile(node.left, graph), self.compile(node.right, graph))
        if isinstance(node, A.LeftJoin):
            return self.left_join(self.compile(node.left, graph), self.compile(node.right, graph), node.condition, graph)
        if isinstance(node, A.Union):
            return self.union(self.compile(node.left, graph), self.compile(node.right, graph))
        if isinstance(node, A.Minus):
            return self.minus(self.compile(node.left, graph), self.compile(node.right, graph))
        if isinstance(node, A.Filter):
            return self.filter(self.compile(node.node, graph), node.condition, graph)
        if isinstance(node, A.Extend):
            return self.extend(self.compile(node.node, graph), node.var, node.value, graph)
        if isinstance(node, A.Values):
            return self.values(node)
        if isinstance(node, A.Graph):
            return self.compile(node.node, node.name)
        if isinstance(node, A.Select):
            return self.select(node, graph)
        raise EvaluationError(f"unknown pattern {type(node).__name__}")

    def _graph_names(self, graph) -> Solutions:
        return Solutions(self.scan(graph).select(F.col("g").alias(column(graph))).distinct(), {graph: True})

    def bgp(self, triples: list, graph) -> Solutions:
        """Joins the patterns along shared variables, those with the most constants first; a cross product only if nothing is shared."""
        triples = list(_without_sequences(triples, self._fresh))
        todo = [(sum(not A.is_var(x) for x in (t.s, t.p, t.o)) - 2 * (not isinstance(t.p, str)), -k, t) for k, t in enumerate(triples)]
        out: Solutions | None = None
        while todo:
            seen = out.vars if out else {}
            best = max(todo, key=lambda x: (bool(set(A.variables(A.BGP([x[2]]))) & set(seen)) or any(v in seen for v in _all_vars(x[2])), x[0], x[1]))
            todo.remove(best)
            found = self.triple(best[2], graph)
            out = found if out is None else self.join(out, found)
        return out or self.unit()

    def triple(self, t: A.Triple, graph) -> Solutions:
        if not isinstance(t.p, str):
            return self.path(t.s, t.p, t.o, graph)
        return self._match(self.scan(graph), [("s", t.s), ("p", t.p), ("o", t.o)] + ([("g", graph)] if A.is_var(graph) else []))

    def _match(self, rows: DataFrame, wanted: list) -> Solutions:
        chosen: dict[str, str] = {}
        quoted = []
        for name, term in wanted:
            if isinstance(term, A.Quoted):
                var = f"?_:q{next(self._fresh)}"
                quoted.append((var, term))
                term = var
            if A.is_var(term):
                if term in chosen:
                    rows = rows.where(F.col(name) == F.col(chosen[term]))
                else:
                    chosen[term] = name
            else:
                rows = rows.where(F.col(name) == term)
        columns = [F.col(c).alias(column(v)) for v, c in chosen.items()] or [F.lit(1).alias("u__")]  # a ground pattern only says how often it matches
        out = Solutions(rows.select(*columns), dict.fromkeys(chosen, True))
        for var, q in quoted:
            parts = self._match(self.store.quoted(), [("term", var), ("qs", q.s), ("qp", q.p), ("qo", q.o)])
            out = self.join(out, parts)
        return out

    # paths

    def path(self, s, path, o, graph) -> Solutions:
        pairs = self.pairs(path, graph, s if not A.is_var(s) and isinstance(s, str) else None, o if not A.is_var(o) and isinstance(o, str) else None)
        wanted = [("s", s), ("o", o)] + ([("g", graph)] if A.is_var(graph) else [])
        return self._match(pairs, wanted)

    def pairs(self, path, graph, s=None, o=None) -> DataFrame:
        """(s, o[, g]) linked by a path; repetition gives distinct pairs. s, o: constants known at the ends."""
        keep = ["g"] if A.is_var(graph) else []
        if isinstance(path, str):
            rows = self.scan(graph)
            return (rows if A.is_var(path) else rows.where(F.col("p") == path)).select("s", "o", *keep)
        if isinstance(path, A.Inv):
            return self.pairs(path.path, graph, o, s).select(F.col("o").alias("s"), F.col("s").alias("o"), *keep)
        if isinstance(path, A.Alt):
            out = self.pairs(path.parts[0], graph, s, o)
            for p in path.parts[1:]:
                out = out.unionByName(self.pairs(p, graph, s, o))
            return out
        if isinstance(path, A.Seq):
            out = self.pairs(path.parts[0], graph, s)
            for p in path.parts[1:]:
                step = self.pairs(p, graph).select(F.col("s").alias("m"), F.col("o").alias("e"), *(F.col(g).alias("h") for g in keep))
                on = (F.col("o") == F.col("m")) & (F.col("g") == F.col("h") if keep else F.lit(True))
                out = out.join(step, on).select("s", F.col("e").alias("o"), *keep)
            return out
        if isinstance(path, A.Neg):
            rows = self.scan(graph)
            parts = []
            if path.forward or not path.backward:
                parts.append(rows.where(~F.col("p").isin(list(path.forward))).select("s", "o", *keep))
            if path.backward:
                parts.append(rows.where(~F.col("p").isin(list(path.backward))).select(F.col("o").alias("s"), F.col("s").alias("o"), *keep))
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        base = self.pairs(path.path, graph)
        out = self._closure(base, keep, s, o) if path.many else base.distinct()
        if path.least == 0:
            out = out.unionByName(self._same(graph, keep, s, o)).distinct()
        return out

    def _same(self, graph, keep, s, o) -> DataFrame:
        """Zero steps: every node of the graph, and the constant ends."""
        rows = self.scan(graph)
        nodes = rows.select(F.col("s").alias("n"), *keep).unionByName(rows.select(F.col("o").alias("n"), *keep)).distinct()
        for c in (s, o):
            if c is not None:
                one = self.store.spark.range(1).select(F.lit(c).alias("n"))
                one = one.crossJoin(nodes.select("g").distinct()) if keep else one
                nodes = nodes.where(F.col("n") == c).unionByName(one).distinct()
        return nodes.select(F.col("n").alias("s"), F.col("n").alias("o"), *keep)

    def _closure(self, base: DataFrame, keep: list, s, o) -> DataFrame:
        """Pairs linked by one step or more: a fixpoint over the new pairs of each round, from a constant end if there is one."""
        edges = pin(base.distinct())
        if s is None and o is not None:  # walk back from the constant
            turned = edges.select(F.col("o").alias("s"), F.col("s").alias("o"), *keep)
            return self._closure(turned, keep, o, None).select(F.col("o").alias("s"), F.col("s").alias("o"), *keep)
        step = edges.select(F.col("s").alias("m"), F.col("o").alias("e"), *(F.col(g).alias("h") for g in keep))
        reached = edges if s is None else edges.where(F.col("s") == s)
        fresh = reached
        names = ["s", "o", *keep]

        def beyond(first: DataFrame, then: DataFrame) -> DataFrame:
            more = then.select(F.col("s").alias("m"), F.col("o").alias("e"), *(F.col(g).alias("h") for g in keep))
            on = (F.col("o") == F.col("m")) & (F.col("g") == F.col("h") if keep else F.lit(True))
            return first.join(more, on).select("s", F.col("e").alias("o"), *keep)

        if s is None:
            # no end is known: path lengths double each round, so a chain of n takes log n rounds
            while not fresh.isEmpty():
                far = beyond(fresh, reached).unionByName(beyond(reached, fresh)).distinct()
                old = reached.select(*(F.col(c).alias("r_" + c) for c in names))
                fresh = pin(far.join(old, [F.col(c) == F.col("r_" + c) for c in names], "left_anti"))
                reached = pin(reached.unionByName(fresh))
            return reached
        while not fresh.isEmpty():
            on = (F.col("o") == F.col("m")) & (F.col("g") == F.col("h") if keep else F.lit(True))
            far = fresh.join(step, on).select("s", F.col("e").alias("o"), *keep).distinct()
            old = reached.select(*(F.col(c).alias("r_" + c) for c in names))
            fresh = pin(far.join(old, [F.col(c) == F.col("r_" + c) for c in names], "left_anti"))
            reached = pin(reached.unionByName(fresh))
        return reached

    # joins

    def _aligned(self, left: Solutions, right: Solutions) -> tuple[DataFrame, Column, list[str]]:
        """right with its shared columns renamed, the compatibility condition, the shared variables."""
        shared = [v for v in right.vars if v in left.vars]
        df = right.df
        condition = F.lit(True)
        for v in shared:
            c = column(v)
            df = df.withColumnRenamed(c, c + "__r")
            same = F.col(c) == F.col(c + "__r")
            if not left.vars[v]:
                same = same | F.col(c).isNull()
            if not right.vars[v]:
                same = same | F.col(c + "__r").isNull()
            condition = condition & same
        return df, condition, shared

    def join(self, left: Solutions, right: Solutions) -> Solutions:
        if left.unit or right.unit:
            return right if left.unit else left
        df, condition, shared = self._aligned(left, right)
        if not shared:
            # nothing is shared: the pattern itself is a product
            names = [column(v) for v in [*left.vars, *right.vars]]
            return Solutions(left.df.crossJoin(df).select(*names) if names else left.df.select("u__").crossJoin(df.select()), left.vars | right.vars)
        # where a shared variable can be unbound, rows are dealt by which of them are bound: each part is an equi-join
        open_left = [v for v in shared if not left.vars[v]]
        open_right = [v for v in shared if not right.vars[v]]
        if not open_left and not open_right or len(open_left) + len(open_right) > MOST_OPEN:
            return self._merged(left.df.join(df, condition), left, right, shared, inner=True)
        out = None
        for bound_left, own in _by_bound(left.df, {v: column(v) for v in open_left}):
            for bound_right, other in _by_bound(df, {v: column(v) + "__r" for v in open_right}):
                both = [v for v in shared if (left.vars[v] or v in bound_left) and (right.vars[v] or v in bound_right)]
                part = own.join(other, [F.col(column(v)) == F.col(column(v) + "__r") for v in both]) if both else own.crossJoin(other)
                out = part if out is None else out.unionByName(part)
        return self._merged(out, left, right, shared, inner=True)

    def _folded(self, pattern, graph, needed: set[str]) -> Solutions:
        """Solutions of a pattern of which only the needed variables and the number of solutions matter.

        Where a join can be a product (nothing is shared, or a shared variable can be unbound), its sides are grouped
        by what is shared or needed first, so pairs of solutions that nothing tells apart are counted and not made."""
        if isinstance(pattern, A.Filter) and not any(_has(pattern.condition, op) for op in EACH):
            return self.filter(self._folded(pattern.node, graph, needed | _expr_vars(pattern.condition)), pattern.condition, graph)
        if isinstance(pattern, A.Graph):
            return self._folded(pattern.node, pattern.name, needed)
        if not isinstance(pattern, A.Join) or isinstance(pattern.left, A.BGP) and isinstance(pattern.right, A.BGP):
            return self.compile(pattern, graph)
        right = self.compile(pattern.right, graph)
        left = self._folded(pattern.left, graph, needed | set(right.vars))
        shared = [v for v in right.vars if v in left.vars]
        if not shared or not all(left.vars[v] and right.vars[v] for v in shared):
            left, right = self._fold(left, needed | set(shared)), self._fold(right, needed | set(shared))
        return self.join(left, right)

    def _fold(self, node: Solutions, kept: set[str]) -> Solutions:
        """One row for each binding of the kept variables, with its weight."""
        keep = [v for v in node.vars if v in kept]
        if all(v in kept or v.startswith(WEIGHT) for v in node.vars):
            return node
        name = f"{WEIGHT}{next(self._fresh)}"
        each = _weight(node)
        df = node.df.groupBy(*(column(v) for v in keep)).agg(F.sum(F.lit(1) if each is None else each).alias(column(name)))
        # without a key, no rows give one row without a number
        return Solutions(df if keep else df.where(F.col(column(name)).isNotNull()), {**{v: node.vars[v] for v in keep}, name: True})

    def _merged(self, df: DataFrame, left: Solutions, right: Solutions, shared: list[str], inner: bool) -> Solutions:
        out, certain = [], {}
        for v in dict.fromkeys([*left.vars, *right.vars]):
            c = column(v)
            if v in shared:
                out.append((F.col(c) if left.vars[v] else F.coalesce(F.col(c), F.col(c + "__r"))).alias(c))
                certain[v] = left.vars[v] or inner and right.vars[v]
            else:
                out.append(F.col(c))
                certain[v] = left.vars[v] if v in left.vars else right.vars[v] and inner
        return Solutions(df.select(*out), certain)

    def left_join(self, left: Solutions, right: Solutions, condition, graph) -> Solutions:
        df, on, shared = self._aligned(left, right)
        if condition is not None:
            both = {**right.vars, **left.vars}

            def column_of(v):
                if v not in both:
                    return None
                c = column(v)
                return F.coalesce(F.col(c), F.col(c + "__r")) if v in shared else F.col(c)

            on = on & F.coalesce(self._expressions(column_of, None)(condition).truth(), F.lit(False))
        return self._merged(left.df.join(df, on, "left_outer"), left, right, shared, inner=False)

    def union(self, left: Solutions, right: Solutions) -> Solutions:
        names = list(dict.fromkeys([*left.vars, *right.vars]))

        def padded(x: Solutions) -> DataFrame:
            return x.df.select(*(F.col(column(v)) if v in x.vars else F.lit(None).cast("string").alias(column(v)) for v in names))

        return Solutions(padded(left).unionByName(padded(right)), {v: left.vars.get(v, False) and right.vars.get(v, False) for v in names})

    def minus(self, left: Solutions, right: Solutions) -> Solutions:
        df, condition, shared = self._aligned(left, right)
        if not shared:
            return left
        if not all(left.vars[v] and right.vars[v] for v in shared):
            # solutions whose bound variables do not meet exclude nothing
            meet = F.lit(False)
            for v in shared:
                meet = meet | (F.col(column(v)).isNotNull() & F.col(column(v) + "__r").isNotNull())
            condition = condition & meet
        return Solutions(left.df.join(df.select(*(column(v) + "__r" for v in shared)).distinct(), condition, "left_anti"), left.vars)

    # filters and values

    def _expressions(self, column_of, exists) -> Expressions:
        out = Expressions(column_of, self.expressions_now, exists)
        self.expressions_now = out.now
        return out

    def filter(self, node: Solutions, condition, graph) -> Solutions:
        if condition[0] == "and":
            return self.filter(self.filter(node, condition[1], graph), condition[2], graph)
        negative = condition[0] == "not" and condition[1][0] == "exists"
        if condition[0] == "exists" or negative:
            wanted, pattern = condition[1:] if not negative else (not condition[1][1], condition[1][2])
            return self._semi(node, pattern, graph, "left_semi" if wanted else "left_anti")
        node, test = self._with_exists(node, condition, graph)
        df = node.df.where(self._expressions(node.col, None)(test).truth())
        return Solutions(df.select(*(column(v) for v in node.vars)) if node.vars else df, node.vars)

    def _semi(self, node: Solutions, pattern, graph, how: str) -> Solutions:
        """EXISTS as a semi join; a filter at the top of the pattern may use outer variables."""
        tests = []
        while isinstance(pattern, A.Filter) and pattern.condition[0] not in ("exists",):
            tests.append(pattern.condition)
            pattern = pattern.node
        right = self.compile(pattern, graph)
        inner = [t for t in tests if all(v in right.vars for v in _expr_vars(t))]
        outer = [t for t in tests if t not in inner]
        for t in inner:
            right = self.filter(right, t, graph)
        df, condition, shared = self._aligned(node, right)
        for t in outer:

            def column_of(v):
                if v in node.vars:
                    return F.col(column(v))
                return F.col(column(v)) if v in right.vars else None

            condition = condition & F.coalesce(self._expressions(column_of, None)(t).truth(), F.lit(False))
        if not outer:
            if right.unit:
                return node if how == "left_semi" else Solutions(node.df.where(F.lit(False)), node.vars)
            df = df.select(*(column(v) + "__r" for v in shared)).distinct() if shared else df.limit(1)
        return Solutions(node.df.join(df, condition, how), node.vars)

    def _with_exists(self, node: Solutions, condition, graph):
        """EXISTS inside a larger expression becomes a flag column of a left join."""
        if not _has(condition, "exists"):
            return node, condition
        if condition[0] == "exists":
            right = self.compile(condition[2], graph)
            df, on, shared = self._aligned(node, right)
            flag = f"e__{next(self._fresh)}"
            df = df.select(*(column(v) + "__r" for v in shared)).distinct().withColumn(flag, F.lit(True))
            joined = node.df.join(df, on, "left_outer").drop(*(column(v) + "__r" for v in shared))
            value = F.coalesce(F.col(flag), F.lit(False))
            return Solutions(joined, node.vars), ("value", V("bool", value if condition[1] else ~value))
        parts = [condition[0]]
        for x in condition[1:]:
            if isinstance(x, tuple):
                node, x = self._with_exists(node, x, graph)
            parts.append(x)
        return node, tuple(parts)

    def extend(self, node: Solutions, var: str, value, graph) -> Solutions:
        if var in node.vars:
            raise EvaluationError(f"{var} is already bound")
        had = node
        node, value = self._with_exists(node, value, graph)
        term = self._expressions(node.col, None)(value).term()
        return Solutions(node.df.select(*(F.col(column(v)) for v in had.vars), term.alias(column(var))), {**had.vars, var: value[0] == "term"})

    def values(self, node: A.Values) -> Solutions:
        schema = ", ".join(f"{column(v)} string" for v in node.vars)
        df = local_df(self.store.spark, [tuple(r) for r in node.rows], schema)
        return Solutions(df, {v: all(r[k] is not None for r in node.rows) for k, v in enumerate(node.vars)})

    # select

    def select(self, q: A.Select, graph=None) -> Solutions:
        needed = _counted_vars(q) if q.grouped else None
        node = self.compile(q.where, graph) if needed is None else self._folded(q.where, graph, needed)
        names = [v for v, _ in q.projection] if q.projection is not None else [v for v in A.variables(q.where)]
        if q.grouped:
            node, q = self._grouped(node, q, graph)
        values: dict[str, V] = {}

        def column_of(v):
            return values[v] if v in values else node.col(v)

        columns, certain = [], {}
        for v, e in q.projection if q.projection is not None else [(v, None) for v in names]:
            if e is not None:
                if v in node.vars:
                    raise EvaluationError(f"{v} is already bound")
                node, e = self._with_exists(node, e, graph)
                values[v] = self._expressions(column_of, None)(e)
            col = values[v].term() if v in values else node.col(v)
            columns.append((F.lit(None).cast("string") if col is None else col).alias(column(v)))
            certain[v] = node.vars.get(v, False) if e is None else e[0] == "agg" and e[1] == "COUNT"
        keys = [self._expressions(column_of, None)(e) for e, _ in q.order]
        df = node.df
        if q.order and q.distinct:
            # order by what is projected: keys are computed again after the distinct
            df = df.select(*columns).distinct()
            done = Solutions(df, certain)
            keys = [self._expressions(done.col, None)(e) for e, _ in q.order]
            df = df.orderBy(*(order_key(k).desc() if down else order_key(k).asc() for k, (_, down) in zip(keys, q.order, strict=True)))
        elif q.order:
            order = [order_key(k).alias(f"k__{i}") for i, k in enumerate(keys)]
            df = df.select(*columns, *order)
            df = df.orderBy(*(F.col(f"k__{i}").desc() if down else F.col(f"k__{i}").asc() for i, (_, down) in enumerate(q.order)))
        else:
            df = df.select(*columns)
            if q.distinct:
                df = df.distinct()
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        if q.order and not q.distinct:
            df = df.drop(*(f"k__{i}" for i in range(len(q.order))))
        return Solutions(df, certain)

    def _grouped(self, node: Solutions, q: A.Select, graph):
        """Aggregates become columns; the projection, HAVING and ORDER BY refer to them."""
        make = self._expressions(node.col, None)
        keys, certain = [], {}
        for k, (name, e) in enumerate(q.group):
            name = name or f"?_:key{k}"
            keys.append(make(e).term().alias(column(name)))
            certain[name] = node.vars.get(name, False)
        aggregates: dict[str, tuple] = {}
        values: dict[str, V] = {}

        def lifted(e):
            if not isinstance(e, tuple):
                return e
            if e[0] == "agg":
                name = f"a__{len(aggregates)}"
                for old, seen in aggregates.items():
                    if seen == e:
                        name = old
                aggregates[name] = e
                return ("var", "?" + name)
            for k, (_, key) in enumerate(q.group):
                if key == e and e[0] != "var":
                    return ("var", q.group[k][0] or f"?_:key{k}")
            return tuple(lifted(x) for x in e)

        projection = [(v, None if e is None else lifted(e)) for v, e in q.projection or [(g, None) for g, _ in q.group if g]]
        having = [lifted(h) for h in q.having]
        order = [(lifted(e), d) for e, d in q.order]
        columns: list[Column] = []
        for name, (_, kind, distinct, value, separator) in aggregates.items():
            columns += self._aggregate(name, kind, distinct, None if value is None else make(value), separator, node, values)
        df = node.df
        df = df.groupBy(*keys).agg(*columns) if columns else df.select(*keys).distinct() if keys else df.limit(1)
        grouped = Solutions(df, certain)

        def column_of(v):
            return values[v[1:]] if v[1:] in values else grouped.col(v)

        inner = self._expressions(column_of, None)
        for h in having:
            df = df.where(inner(h).truth())
        named = {v: e for v, e in projection if e is not None}
        shown = []
        for v, e in projection:
            if e is not None:
                shown.append((v, ("value", inner(e))))
            else:
                if v not in certain:
                    raise EvaluationError(f"{v} is neither grouped nor aggregated")
                shown.append((v, None))

        def bound(e):
            """Order keys may name projected values."""
            if isinstance(e, tuple):
                if e[0] == "var" and e[1] in named:
                    return ("value", inner(named[e[1]]))
                if e[0] == "var" and e[1][1:] in values:
                    return ("value", values[e[1][1:]])
                return tuple(bound(x) for x in e)
            return e

        out = A.Select(q.where, shown, q.distinct, [], False, [], [(bound(e), d) for e, d in order], q.limit, q.offset)
        return Solutions(df, certain), out

    def _aggregate(self, name: str, kind: str, distinct: bool, value: V | None, separator: str, node: Solutions, values: dict) -> list[Column]:
        if kind == "COUNT":
            each = _weight(node)
            if value is None:
                col = F.count_distinct(F.struct(*(column(v) for v in node.vars))) if distinct and node.vars else F.count(F.lit(1)) if each is None else F.coalesce(F.sum(each), F.lit(0))
            elif distinct or each is None:
                col = F.count_distinct(value.term()) if distinct else F.count(value.term())
            else:
                col = F.coalesce(F.sum(F.when(value.term().isNotNull(), each)), F.lit(0))
            values[name] = V("num", F.col(name).cast("double"), F.lit(True))
            return [col.alias(name)]
        if kind in ("SUM", "AVG"):
            n, term = value.number(), value.term()
            col = getattr(F, kind.lower())(n) if not distinct else (F.sum_distinct(n) if kind == "SUM" else F.sum_distinct(n) / F.count_distinct(n))
            # a value that is no number is an error; an empty group sums to 0
            ok = F.count(term) == F.count(n)
            out = [F.when(ok, F.coalesce(col, F.lit(0.0))).alias(name)]
            whole = None
            if kind == "SUM":
                out.append(F.coalesce(F.bool_and(F.coalesce(value.is_whole(), F.lit(True))), F.lit(True)).alias(name + "w"))
                whole = F.col(name + "w")
            else:
                out.append((F.count(term) == 0).alias(name + "w"))
                whole = F.col(name + "w")
            values[name] = V("num", F.col(name), whole)
            return out
        if kind in ("MIN", "MAX", "SAMPLE"):
            pick = F.max if kind == "MAX" else F.min
            keyed = F.when(value.term().isNotNull(), F.struct(order_key(value).alias("k"), value.term().alias("t")))
            values[name] = V("term", F.col(name))
            return [pick(keyed)["t"].alias(name)]
        if kind == "GROUP_CONCAT":
            gather = F.collect_set if distinct else F.collect_list
            values[name] = V("str", F.col(name))
            return [F.array_join(F.sort_array(gather(value.text())), separator).alias(name)]
        raise EvaluationError(f"unknown aggregate {kind}")


def _weight(node: Solutions) -> Column | None:
    """How many solutions a row stands for (None: one)."""
    out = None
    for v in node.vars:
        if v.startswith(WEIGHT):
            out = F.col(column(v)) if out is None else out * F.col(column(v))
    return out


def _counted_vars(q: A.Select) -> set[str] | None:
    """The variables that a grouped query reads, if its aggregates need no more than the number of equal solutions; else None."""
    parts = [*(e for _, e in q.group), *(e for _, e in q.projection or () if e is not None), *q.having, *(e for e, _ in q.order)]
    if any(_has(e, op) for e in parts for op in EACH):
        return None
    for _, kind, distinct, value, _ in itertools.chain.from_iterable(map(_aggregates, parts)):
        # COUNT(DISTINCT *) reads all; sums are left as they are, as weights would round them otherwise
        if value is None if distinct else kind not in ("COUNT", "MIN", "MAX", "SAMPLE"):
            return None
    return set().union(*map(_expr_vars, parts))


def _aggregates(e):
    if isinstance(e, tuple):
        if e[:1] == ("agg",):
            yield e
        for x in e[1:]:
            yield from _aggregates(x)


def _all_vars(t: A.Triple) -> list[str]:
    out = []
    for x in (t.s, t.p, t.o):
        if A.is_var(x):
            out.append(x)
        elif isinstance(x, A.Quoted):
            out += _all_vars(A.Triple(x.s, x.p, x.o))
    return out


def _without_sequences(triples: list, fresh):
    """A sequence path is a chain of triples through hidden variables; an inverse one is turned."""
    for t in triples:
        if isinstance(t.p, A.Seq):
            at = t.s
            for k, p in enumerate(t.p.parts):
                to = t.o if k == len(t.p.parts) - 1 else f"?_:p{next(fresh)}"
                yield from _without_sequences([A.Triple(at, p, to)], fresh)
                at = to
        elif isinstance(t.p, A.Inv) and isinstance(t.p.path, str):
            yield A.Triple(t.o, t.p.path, t.s)
        elif isinstance(t.p, A.Inv) and isinstance(t.p.path, A.Seq):
            turned = A.Seq(tuple(A.Inv(p) for p in reversed(t.p.path.parts)))
            yield from _without_sequences([A.Triple(t.s, turned, t.o)], fresh)
        else:
            yield t


def _has(e, op: str) -> bool:
    return isinstance(e, tuple) and (e[:1] == (op,) or any(_has(x, op) for x in e[1:]))


def _expr_vars(e) -> set[str]:
    if not isinstance(e, tuple):
        return set()
    if e[0] == "var":
        return {e[1]}
    return set().union(*(_expr_vars(x) for x in e[1:]))

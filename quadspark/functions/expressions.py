"""SPARQL expressions as Columns. An error or an unbound variable is null, so SQL's three-valued logic is SPARQL's."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as T


class EvaluationError(ValueError):
    """An expression that cannot be compiled."""


@dataclass
class V:
    """A value. kind: term (any RDF term), num (double, with `whole`: is it an integer), str, bool."""

    kind: str
    col: Column
    whole: Column | None = None
    lang: Column | None = None
    static: str | None = None  # the term, where the value is a constant

    def term(self) -> Column:
        if self.static is not None:
            return F.lit(self.static)
        if self.kind == "num":
            as_int = T.c_typed(self.col.try_cast("long"), T.XSD + "integer")
            as_double = T.c_typed(self.col, T.XSD + "double")
            return as_double if self.whole is None else F.when(self.whole, as_int).otherwise(as_double)
        if self.kind == "bool":
            return T.c_typed(self.col, T.XSD + "boolean")
        if self.kind == "str":
            plain = T.c_plain(self.col)
            return plain if self.lang is None else F.when(F.coalesce(self.lang, F.lit("")) != "", F.concat(plain, F.lit("@"), self.lang)).otherwise(plain)
        return self.col

    def number(self) -> Column:
        return self.col if self.kind == "num" else T.c_number(self.col) if self.kind == "term" else F.lit(None).cast("double")

    def is_whole(self) -> Column:
        if self.kind == "num":
            return F.lit(False) if self.whole is None else self.whole
        return T.c_is_integer(self.col) if self.kind == "term" else F.lit(False)

    def text(self) -> Column:
        """STR()."""
        if self.kind == "term":
            return T.c_lexical(self.col)
        if self.kind == "str":
            return self.col
        if self.kind == "num":
            return T.c_lexical(self.term())
        return self.col.cast("string")

    def string(self) -> Column:
        """Text of a string literal (plain, xsd:string or with a language); null for others."""
        if self.kind == "str":
            return self.col
        if self.kind == "term":
            ok = T.c_datatype(self.col).isin(T.XSD + "string", T.RDF + "langString")
            return F.when(ok, T.c_lexical(self.col))
        return F.lit(None).cast("string")

    def language(self) -> Column:
        if self.kind == "str":
            return F.lit("") if self.lang is None else F.coalesce(self.lang, F.lit(""))
        return T.c_lang(self.term())

    def truth(self) -> Column:
        """Effective boolean value."""
        if self.kind == "bool":
            return self.col
        if self.kind == "num":
            return (self.col != 0) & ~F.isnan(self.col)
        if self.kind == "str":
            return F.length(self.col) > 0
        own = T.c_datatype(self.col)
        return F.when(own == T.XSD + "boolean", T.c_raw(self.col).isin("true", "1")).when(T.c_number(self.col).isNotNull(), T.c_number(self.col) != 0).when(own == T.XSD + "string", F.length(T.c_lexical(self.col)) > 0)


def constant(term: str) -> V:
    cell = T.parse_typed(term)
    value = cell["value"]
    if cell["kind"] == "literal":
        if isinstance(value, bool):
            return V("bool", F.lit(value), static=term)
        if isinstance(value, (int, float)):
            return V("num", F.lit(float(value)), F.lit(isinstance(value, int)), static=term)
        if cell["datatype"] in (None, T.XSD + "string"):
            return V("str", F.lit(value), lang=None if cell["lang"] is None else F.lit(cell["lang"]), static=term)
    return V("term", F.lit(term), static=term)


def _string(col: Column, like: V | None = None) -> V:
    return V("str", col, lang=None if like is None else like.language())


def _num(col: Column, whole: Column | bool | None = None) -> V:
    return V("num", col.cast("double"), F.lit(whole) if isinstance(whole, bool) else whole)


def equal(a: V, b: V) -> Column:
    """a = b; null where SPARQL raises an error."""
    if "bool" in (a.kind, b.kind) and a.kind != "term" and b.kind != "term":
        return a.col == b.col if a.kind == b.kind else F.lit(None).cast("boolean")
    x, y = a.term(), b.term()
    if a.kind == "num" or b.kind == "num":
        other = b if a.kind == "num" else a
        same = a.number() == b.number()
        if other.kind != "term" or other.static is not None:
            return same if other.kind in ("num", "term") else F.lit(None).cast("boolean")
        return F.when(T.is_literal(other.col), same).otherwise(F.when(other.col.isNotNull(), F.lit(False)))
    if a.kind == "str" and b.kind == "str":
        return (a.col == b.col) & (a.language() == b.language())
    if a.static is not None and T.kind_of(a.static) in ("iri", "blank_node") or b.static is not None and T.kind_of(b.static) in ("iri", "blank_node"):
        return x == y
    number = a.number().isNotNull() & b.number().isNotNull()
    strings = a.string().isNotNull() & b.string().isNotNull()
    return F.when(x == y, F.lit(True)).when(x.isNull() | y.isNull(), F.lit(None)).when(~T.is_literal(x) | ~T.is_literal(y), F.lit(False)).when(number, a.number() == b.number()).when(strings, (a.string() == b.string()) & (a.language() == b.language()))


def less(a: V, b: V, op: str) -> Column:
    cmp: dict[str, Any] = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    f = cmp[op]
    if a.kind == "num" or b.kind == "num":
        return f(a.number(), b.number())
    if a.kind == "bool" and b.kind == "bool":
        return f(a.col, b.col)
    if a.kind == "str" or b.kind == "str":
        return f(a.string(), b.string())
    number = a.number().isNotNull() & b.number().isNotNull()
    strings = a.string().isNotNull() & b.string().isNotNull()
    same = T.c_datatype(a.term()) == T.c_datatype(b.term())
    return F.when(number, f(a.number(), b.number())).when(strings, f(a.string(), b.string())).when(same, f(a.text(), b.text()))


def _flags(args: list[V], k: int) -> Column:
    """The regex with its flags (i, m, s, x) in front."""
    base = args[1].text()
    return base if len(args) <= k else F.concat(F.lit("(?"), args[k].text(), F.lit(")"), base)


def _timestamp(v: V) -> Column:
    return F.to_timestamp_ntz(F.regexp_replace(F.regexp_extract(v.text(), r"^(\d{4}-\d\d-\d\d(?:T\d\d:\d\d:\d\d(?:\.\d+)?)?)", 1), "T", " "))


def _part(v: V, pattern: str) -> Column:
    return F.regexp_extract(v.text(), pattern, 1).try_cast("double")


_DATE = r"^-?(\d{4,})-\d\d-\d\d"
_NOW = dt.datetime.now


def _iri(a: V) -> V:
    return V("term", F.when(T.is_iri(a.term()), a.term()).when(T.is_literal(a.term()), T.c_iri(a.text())))


def _quoted_part(a: V, k: int) -> Column:
    """Part k of a quoted triple, where it is not nested (nested ones are destructured by patterns)."""
    return F.regexp_extract(a.term(), r'(?s)^<< (<[^<>]*>|_:\S+) (<[^<>]*>) (<[^<>]*>|_:\S+|".*) >>$', k)


def _part_or_null(a: V, k: int) -> V:
    part = _quoted_part(a, k)
    return V("term", F.when(part != "", part))


def _strdt(a: V, b: V) -> V:
    return V("term", F.concat(F.lit('"'), T.c_escape(a.string()), F.lit('"^^'), b.term()))


def _strlang(a: V, b: V) -> V:
    return V("str", a.string(), lang=b.text())


def _hash(f) -> Any:
    return lambda a: _string(f(a.string()))


def _substr(a: V, start: V, n: V | None = None) -> V:
    s = a.string()
    at = start.number().cast("int")
    size = F.length(s) if n is None else n.number().cast("int")
    return _string(F.substring(s, at, size), a)


def _position(a: V, b: V) -> Column:
    return F.position(b.string(), a.string())


def _strbefore(a: V, b: V) -> V:
    at = _position(a, b)
    return _string(F.when(at > 0, F.substring(a.string(), F.lit(1), at - 1)).otherwise(""), a)


def _strafter(a: V, b: V) -> V:
    at = _position(a, b)
    return _string(F.when(at > 0, F.substring(a.string(), at + F.length(b.string()), F.length(a.string()))).otherwise(""), a)


def _round(a: V) -> V:
    return _num(F.floor(a.number() + 0.5), a.is_whole())


def _zone(v: V) -> Column:
    return F.regexp_extract(v.text(), r"(Z|[+-]\d\d:\d\d)$", 1)


FUNCTIONS: dict[str, Any] = {
    "STR": lambda a: _string(a.text()),
    "LANG": lambda a: _string(a.language()),
    "DATATYPE": lambda a: V("term", T.c_iri(T.c_datatype(a.term()))),
    "IRI": _iri,
    "URI": _iri,
    "BNODE": lambda *a: V("term", F.concat(F.lit("_:b"), F.md5(a[0].text()) if a else F.replace(F.uuid(), F.lit("-")))),
    "STRDT": _strdt,
    "STRLANG": _strlang,
    "UUID": lambda: V("term", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
    "STRUUID": lambda: _string(F.uuid()),
    "ISIRI": lambda a: V("bool", T.is_iri(a.term())),
    "ISURI": lambda a: V("bool", T.is_iri(a.term())),
    "ISBLANK": lambda a: V("bool", T.is_blank(a.term())),
    "ISLITERAL": lambda a: V("bool", T.is_literal(a.term())),
    "ISNUMERIC": lambda a: V("bool", F.when(a.term().isNotNull(), a.number().isNotNull())),
    "ISTRIPLE": lambda a: V("bool", T.is_quoted(a.term())),
    "TRIPLE": lambda s, p, o: V("term", F.concat(F.lit("<< "), s.term(), F.lit(" "), p.term(), F.lit(" "), o.term(), F.lit(" >>"))),
    "SUBJECT": lambda a: _part_or_null(a, 1),
    "PREDICATE": lambda a: _part_or_null(a, 2),
    "OBJECT": lambda a: _part_or_null(a, 3),
    "SAMETERM": lambda a, b: V("bool", a.term() == b.term()),
    "STRLEN": lambda a: _num(F.length(a.string()), True),
    "SUBSTR": _substr,
    "UCASE": lambda a: _string(F.upper(a.string()), a),
    "LCASE": lambda a: _string(F.lower(a.string()), a),
    "STRSTARTS": lambda a, b: V("bool", F.startswith(a.string(), b.string())),
    "STRENDS": lambda a, b: V("bool", F.endswith(a.string(), b.string())),
    "CONTAINS": lambda a, b: V("bool", F.contains(a.string(), b.string())),
    "STRBEFORE": _strbefore,
    "STRAFTER": _strafter,
    "ENCODE_FOR_URI": lambda a: _string(F.replace(F.replace(F.replace(F.url_encode(a.string()), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))),
    "CONCAT": lambda *a: _string(F.concat(*(x.string() for x in a)) if a else F.lit("")),
    "LANGMATCHES": lambda a, b: V("bool", F.when(b.string() == "*", a.string() != "").otherwise((F.lower(a.string()) == F.lower(b.string())) | F.startswith(F.lower(a.string()), F.concat(F.lower(b.string()), F.lit("-"))))),
    "REGEX": lambda *a: V("bool", F.rlike(a[0].string(), _flags(list(a), 2))),
    "REPLACE": lambda *a: _string(F.regexp_replace(a[0].string(), _flags(list(a), 3), a[2].text()), a[0]),
    "ABS": lambda a: _num(F.abs(a.number()), a.is_whole()),
    "ROUND": _round,
    "CEIL": lambda a: _num(F.ceil(a.number()), a.is_whole()),
    "FLOOR": lambda a: _num(F.floor(a.number()), a.is_whole()),
    "RAND": lambda: _num(F.rand()),
    "YEAR": lambda a: _num(_part(a, _DATE), True),
    "MONTH": lambda a: _num(_part(a, r"^-?\d{4,}-(\d\d)-"), True),
    "DAY": lambda a: _num(_part(a, r"^-?\d{4,}-\d\d-(\d\d)"), True),
    "HOURS": lambda a: _num(_part(a, r"T(\d\d):"), True),
    "MINUTES": lambda a: _num(_part(a, r"T\d\d:(\d\d)"), True),
    "SECONDS": lambda a: _num(_part(a, r"T\d\d:\d\d:(\d\d(?:\.\d+)?)"), F.lit(True)),
    "TZ": lambda a: _string(_zone(a)),
    "TIMEZONE": lambda a: V("term", F.when(_zone(a) == "Z", F.lit(f'"PT0S"^^<{T.XSD}dayTimeDuration>')).when(_zone(a) != "", F.concat(F.lit('"'), F.when(F.startswith(_zone(a), F.lit("-")), "-").otherwise(""), F.lit("PT"), F.substring(_zone(a), 2, 2).cast("int").cast("string"), F.lit(f'H"^^<{T.XSD}dayTimeDuration>')))),
    "MD5": _hash(F.md5),
    "SHA1": _hash(F.sha1),
    "SHA256": _hash(lambda c: F.sha2(c, 256)),
    "SHA384": _hash(lambda c: F.sha2(c, 384)),
    "SHA512": _hash(lambda c: F.sha2(c, 512)),
}


def _cast(name: str, a: V) -> V:
    local = name.removeprefix(T.XSD)
    if local == "string":
        return _string(a.text())
    if local == "boolean":
        return V("bool", F.when(a.truth().isNotNull() & a.number().isNotNull(), a.truth()).when(F.lower(a.text()).isin("true", "1"), True).when(F.lower(a.text()).isin("false", "0"), False))
    if local in T.INTEGER_TYPES:
        return _num(F.coalesce(a.number(), a.text().try_cast("double")).cast("bigint"), True)
    if local in T.FLOAT_TYPES:
        return _num(F.coalesce(a.number(), a.text().try_cast("double")))
    if local in ("dateTime", "date"):
        ts = _timestamp(a)
        return V("term", T.c_typed(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss" if local == "dateTime" else "yyyy-MM-dd"), name))
    raise EvaluationError(f"unknown function <{name}>")


class Expressions:
    """Compiles expressions over the columns of a solution table."""

    def __init__(self, column_of, now: dt.datetime | None = None, exists=None):
        self.column_of, self.exists = column_of, exists
        self.now = now or _NOW(dt.timezone.utc).replace(microsecond=0)

    def __call__(self, e) -> V:
        op, args = e[0], e[1:]
        if op == "var":
            found = self.column_of(args[0])
            return found if isinstance(found, V) else V("term", F.lit(None).cast("string") if found is None else found)
        if op == "value":
            return args[0]
        if op == "term":
            return constant(args[0])
        if op == "and":
            return V("bool", self.truth(args[0]) & self.truth(args[1]))
        if op == "or":
            return V("bool", self.truth(args[0]) | self.truth(args[1]))
        if op == "not":
            return V("bool", ~self.truth(args[0]))
        if op == "=":
            return V("bool", equal(self(args[0]), self(args[1])))
        if op == "!=":
            return V("bool", ~equal(self(args[0]), self(args[1])))
        if op in ("<", ">", "<=", ">="):
            return V("bool", less(self(args[0]), self(args[1]), op))
        if op in ("+", "-", "*", "/"):
            a, b = self(args[0]), self(args[1])
            x, y = a.number(), b.number()
            if op == "/":
                return V("num", F.try_divide(x, y), F.lit(False))
            col = x + y if op == "+" else x - y if op == "-" else x * y
            return V("num", col, a.is_whole() & b.is_whole())
        if op == "neg":
            a = self(args[0])
            return V("num", -a.number(), a.is_whole())
        if op in ("in", "notin"):
            a = self(args[0])
            hit = F.lit(False)
            for x in args[1:]:
                hit = hit | equal(a, self(x))
            return V("bool", hit if op == "in" else ~hit)
        if op == "exists":
            if self.exists is None:
                raise EvaluationError("EXISTS is not allowed here")
            return V("bool", self.exists(args[0], args[1]))
        if op == "BOUND":
            return V("bool", self(args[0]).term().isNotNull())
        if op == "IF":
            c, a, b = self.truth(args[0]), self(args[1]), self(args[2])
            if a.kind == b.kind and a.kind in ("num", "bool"):
                whole = F.when(c, a.is_whole()).when(~c, b.is_whole()) if a.kind == "num" else None
                return V(a.kind, F.when(c, a.col).when(~c, b.col), whole)
            return V("term", F.when(c, a.term()).when(~c, b.term()))
        if op == "COALESCE":
            found = [self(x) for x in args]
            if found and all(x.kind == "num" for x in found):
                whole = F.lit(None).cast("boolean")
                for x in reversed(found):
                    whole = F.when(x.col.isNotNull(), x.is_whole()).otherwise(whole)
                return V("num", F.coalesce(*(x.col for x in found)), whole)
            return V("term", F.coalesce(*(x.term() for x in found)))
        if op == "NOW":
            return V("term", F.lit(T.typed(self.now.isoformat(), T.XSD + "dateTime")))
        if op == "cast":
            return _cast(args[0], self(args[1]))
        if op == "agg":
            raise EvaluationError("an aggregate is not allowed here")
        if op in FUNCTIONS:
            try:
                return FUNCTIONS[op](*(self(x) for x in args))
            except TypeError as e:
                raise EvaluationError(f"wrong arguments of {op}") from e
        raise EvaluationError(f"unknown function {op}")

    def truth(self, e) -> Column:
        return self(e).truth()


def order_key(v: V) -> Column:
    """Unbound, blank nodes, IRIs, quoted triples, literals; numbers by value, others by text."""
    t = v.term()
    rank = F.when(t.isNull(), 0).when(T.is_blank(t), 1).when(T.is_iri(t), 2).when(T.is_quoted(t), 3).otherwise(4)
    return F.struct(rank.alias("rank"), F.when(v.number().isNull(), 1).otherwise(0).alias("kind"), v.number().alias("number"), F.coalesce(v.text(), t).alias("text"))

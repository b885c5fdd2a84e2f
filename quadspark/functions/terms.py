"""RDF terms as canonical N-Triples-star strings: Python helpers and their Column twins.

`<iri>`, `"lex"`, `"lex"^^<datatype>`, `"lex"@lang`, `_:b` and `<< s p o >>`.
Term equality is string equality.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
#: The namespace of names that the engine itself reserves.
ENGINE = "urn:quadspark:"
TYPE = f"<{RDF}type>"

#: Integer datatypes of XML Schema.
INTEGER_TYPES = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")
FLOAT_TYPES = ("double", "float", "decimal")
NUMERIC_TYPES = INTEGER_TYPES + FLOAT_TYPES

LITERAL = re.compile(r'^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z][A-Za-z0-9-]*)|\^\^<([^>]+)>)?$', re.S)
LITERAL_SQL = r'(?s)^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z][A-Za-z0-9-]*)|\^\^<([^>]+)>)?$'
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_UNESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


@dataclass(frozen=True)
class QuotedTriple:
    s: Any
    p: Any
    o: Any

    def __str__(self) -> str:
        return f"<< {subject(self.s)} {predicate(self.p)} {object_(self.o)} >>"


def quoted_triple(s, p, o) -> QuotedTriple:
    return QuotedTriple(s, p, o)


def escape(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text)


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m.group(1)
        if c[0] in "uU":
            return chr(int(c[1:], 16))
        return _UNESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S) if "\\" in text else text


def iri(text: str) -> str:
    return text if text.startswith("<") else f"<{text}>"


def typed(lexical: str, datatype: str) -> str:
    return f'"{escape(lexical)}"^^<{datatype}>'


def literal(value: Any) -> str:
    """A host value as a literal term."""
    if isinstance(value, bool):
        return typed("true" if value else "false", XSD + "boolean")
    if isinstance(value, int):
        return typed(str(value), XSD + "integer")
    if isinstance(value, float):
        return typed(repr(value), XSD + "double")
    if isinstance(value, (dict, list, tuple)):
        return typed(json.dumps(value, ensure_ascii=False, separators=(",", ":")), XSD + "string")
    if isinstance(value, dt.datetime):
        return typed(value.isoformat(), XSD + "dateTime")
    if isinstance(value, dt.date):
        return typed(value.isoformat(), XSD + "date")
    if isinstance(value, decimal.Decimal):
        return f'"{value}"'
    return f'"{escape(str(value))}"'


def object_(value: Any) -> str:
    """A host value as an object: bracketed strings and quoted triples pass."""
    if isinstance(value, QuotedTriple):
        return str(value)
    if isinstance(value, (list, tuple)) and len(value) == 3:
        return str(QuotedTriple(*value))
    if isinstance(value, str) and (value.startswith("<<") and value.endswith(">>") or value.startswith("<") and value.endswith(">")):
        return value
    return literal(value)


def subject(value: Any) -> str:
    if isinstance(value, QuotedTriple):
        return str(value)
    if isinstance(value, (list, tuple)) and len(value) == 3:
        return str(QuotedTriple(*value))
    text = str(value)
    if not text or text == "<>":
        raise ValueError("empty subject")
    return text if text.startswith(("<", "_:")) else f"<{text}>"


def predicate(value: Any) -> str:
    if not isinstance(value, str):
        raise ValueError("a predicate must be an IRI")
    if not value or value == "<>" or value.startswith(("_:", "<<", '"')):
        raise ValueError(f"a predicate must be an IRI, got {value!r}")
    return value if value.startswith("<") else f"<{value}>"


def kind_of(term: str | None) -> str:
    if term is None:
        return "unknown"
    if term.startswith("<<") and term.endswith(">>"):
        return "quoted_triple"
    if term.startswith("<") and term.endswith(">"):
        return "iri"
    if term.startswith("_:"):
        return "blank_node"
    return "literal" if LITERAL.match(term) else "unknown"


def parse_typed(term: str | None) -> dict:
    """{value, kind, datatype, lang} of a cell."""
    kind = kind_of(term)
    cell = {"value": term, "kind": kind, "datatype": None, "lang": None}
    if kind == "iri":
        cell["value"] = term[1:-1]
    elif kind == "literal":
        lexical, lang, datatype = LITERAL.match(term).groups()
        lexical = unescape(lexical)
        cell |= {"value": coerce(lexical, datatype), "lang": lang, "datatype": datatype}
    return cell


def parse_plain(term: str | None) -> Any:
    """The host value of a cell."""
    return parse_typed(term)["value"]


def coerce(lexical: str, datatype: str | None) -> Any:
    name = (datatype or "").removeprefix(XSD) if (datatype or "").startswith(XSD) else ""
    try:
        if name in INTEGER_TYPES:
            return int(lexical)
        if name in FLOAT_TYPES:
            return float(lexical)
    except ValueError:
        return lexical
    return lexical == "true" if name == "boolean" else lexical


def lexical(term: str | None) -> str | None:
    """Lexical form of a literal as written, the text of an IRI, anything else as it is."""
    if term is None:
        return None
    m = LITERAL.match(term)
    if m:
        return m.group(1)
    return term[1:-1] if term.startswith("<") and term.endswith(">") and len(term) > 2 else term


def datatype_of(term: str | None) -> str | None:
    m = LITERAL.match(term) if term and term.startswith('"') else None
    if not m:
        return None
    return m.group(3) or (RDF + "langString" if m.group(2) else XSD + "string")


# Column twins -----------------------------------------------------------------


def c_escape(text: Column) -> Column:
    for a, b in _ESCAPES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def c_unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for a, b in _UNESCAPES.items():
        if a != "\\":
            out = F.replace(out, F.lit("\\" + a), F.lit(b))
    return F.when(text.contains("\\"), F.replace(out, F.lit("\x00"), F.lit("\\"))).otherwise(text)


def c_iri(text: Column) -> Column:
    return F.concat(F.lit("<"), text.cast("string"), F.lit(">"))


def c_plain(text: Column) -> Column:
    return F.concat(F.lit('"'), c_escape(text.cast("string")), F.lit('"'))


def c_typed(text: Column, datatype: str) -> Column:
    return F.concat(F.lit('"'), text.cast("string"), F.lit(f'"^^<{datatype}>'))


def c_literal(value: Column, kind: str) -> Column:
    """A column of a Spark type (its simple name) as literal terms; null gives null."""
    if kind in ("tinyint", "smallint", "int", "bigint", "byte", "short", "long", "integer"):
        return c_typed(value, XSD + "integer")
    if kind in ("float", "double"):
        return c_typed(value, XSD + "double")
    if kind == "boolean":
        return c_typed(value, XSD + "boolean")
    if kind == "date":
        return c_typed(value, XSD + "date")
    if kind.startswith("timestamp"):
        return c_typed(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), XSD + "dateTime")
    if kind.startswith(("array", "map", "struct")):
        return F.concat(F.lit('"'), c_escape(F.to_json(value)), F.lit(f'"^^<{XSD}string>'))
    return c_plain(value)


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def is_quoted(term: Column) -> Column:
    return term.startswith("<< ")


def is_iri(term: Column) -> Column:
    return term.startswith("<") & ~is_quoted(term)


def is_blank(term: Column) -> Column:
    return term.startswith("_:")


def c_raw(term: Column) -> Column:
    """Lexical form as written, of literals only."""
    return F.when(is_literal(term), F.regexp_extract(term, LITERAL_SQL, 1))


def c_lexical(term: Column) -> Column:
    """STR(): decoded lexical form of a literal, text of an IRI, null for the rest."""
    return F.when(is_literal(term), c_unescape(F.regexp_extract(term, LITERAL_SQL, 1))).when(is_iri(term), F.substring(term, F.lit(2), F.length(term) - 2))


def c_lang(term: Column) -> Column:
    return F.when(is_literal(term), F.regexp_extract(term, LITERAL_SQL, 2))


def c_datatype(term: Column) -> Column:
    own = F.regexp_extract(term, LITERAL_SQL, 3)
    named = F.when(own != "", own).when(F.regexp_extract(term, LITERAL_SQL, 2) != "", F.lit(RDF + "langString")).otherwise(F.lit(XSD + "string"))
    return F.when(is_literal(term), named)


NUMERIC_SQL = r'(?s)^"([^"\\]*)"\^\^<' + re.escape(XSD) + "(?:" + "|".join(NUMERIC_TYPES) + ")>$"
INTEGER_SQL = r'(?s)^"([^"\\]*)"\^\^<' + re.escape(XSD) + "(?:" + "|".join(INTEGER_TYPES) + ")>$"


def c_number(term: Column) -> Column:
    """Double value of a numeric literal, else null."""
    return F.regexp_extract(term, NUMERIC_SQL, 1).try_cast("double")


def c_is_integer(term: Column) -> Column:
    return term.rlike(INTEGER_SQL)


def c_kind(term: Column) -> Column:
    return F.when(is_quoted(term), "quoted_triple").when(is_iri(term), "iri").when(is_blank(term), "blank_node").when(term.rlike(LITERAL_SQL), "literal").otherwise("unknown")


def c_typed_cell(term: Column) -> Column:
    """struct(value, kind, datatype, lang); null if unbound."""
    own = F.regexp_extract(term, LITERAL_SQL, 3)
    lang = c_lang(term)
    return F.when(
        term.isNotNull(),
        F.struct(
            F.coalesce(c_lexical(term), term).alias("value"),
            c_kind(term).alias("kind"),
            F.when(is_literal(term) & (own != ""), own).alias("datatype"),
            F.when(lang != "", lang).alias("lang"),
        ),
    )

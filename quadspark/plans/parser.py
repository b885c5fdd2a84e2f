"""SPARQL 1.1 query and update text, with RDF-star, to algebra."""

from __future__ import annotations

import re
import uuid

from ..functions import terms as T
from . import algebra as A


class ParseError(ValueError):
    """Text that is not SPARQL."""


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<var>[?$][A-Za-z0-9_·-￿]+)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:[A-Za-z0-9_](?:[\w.-]*[\w-])?)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<pname>(?:[A-Za-z][\w.-]*)?:(?:[\w:%](?:[\w.:%-]*[\w:%-])?)?)
    |(?P<name>[A-Za-z][A-Za-z0-9_-]*)
    |(?P<op><<|>>|\{\||\|\}|\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,*+?/|^!=<>-])""",
    re.X | re.S,
)

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
PREFIXES = {"rdf": T.RDF, "rdfs": T.RDFS, "owl": T.OWL, "xsd": T.XSD, "sh": T.SH}


def _string(token: str) -> str:
    body = token[3:-3] if token[:3] in ('"""', "'''") else token[1:-1]
    return T.unescape(body)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected text at {text[at:at + 20]!r}")
            at = m.end()
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m.group()))
        self.i, self.prefixes, self.base, self.fresh = 0, dict(prefixes or {}), "", 0
        self.bnodes: dict[str, str] = {}

    # tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end":
            raise ParseError("unexpected end")
        self.i += 1
        return token

    def at(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind == "name" and text.upper() in words or kind == "op" and text in words

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ParseError(f"expected {word}, got {self.peek()[1]!r}")

    # prologue and forms

    def prologue(self) -> None:
        while True:
            if self.take("PREFIX"):
                kind, name = self.next()
                if kind != "pname" or not name.endswith(":"):
                    raise ParseError("a prefix ends with a colon")
                self.prefixes[name[:-1]] = self.iri()[1:-1]
            elif self.take("BASE"):
                self.base = self.iri()[1:-1]
            else:
                return

    def query(self) -> A.Query:
        self.prologue()
        if self.at("SELECT"):
            out = A.Query("select", None)
            out.select = self.select(out)
        elif self.take("ASK"):
            out = A.Query("ask", None)
            self.dataset(out)
            out.select = self.body(A.Select(None))
        elif self.take("CONSTRUCT"):
            out = A.Query("construct", None)
            if self.at("{"):
                out.template = self.template()
                self.dataset(out)
                out.select = self.body(A.Select(None))
            else:
                self.dataset(out)
                self.need("WHERE")
                out.template = self.template()
                out.select = A.Select(A.BGP([t for _, t in out.template]))
                self.modifiers(out.select)
        elif self.take("DESCRIBE"):
            out = A.Query("describe", None)
            names = []
            while self.peek()[0] in ("var", "iri", "pname"):
                names.append(self.var_or_iri())
            self.take("*")
            self.dataset(out)
            out.template = names
            out.select = self.body(A.Select(None)) if self.at("WHERE", "{") else A.Select(A.Unit())
        else:
            raise ParseError(f"unknown query form {self.peek()[1]!r}")
        if self.take("VALUES"):
            out.select.where = A.Join(out.select.where, self.values())
        if self.peek()[0] != "end":
            raise ParseError(f"unexpected {self.peek()[1]!r}")
        return out

    def dataset(self, out: A.Query) -> None:
        while self.take("FROM"):
            if self.take("NAMED"):
                out.named_graphs.append(self.iri()[1:-1])
            else:
                out.default_graphs.append(self.iri()[1:-1])

    def select(self, query: A.Query | None = None) -> A.Select:
        self.need("SELECT")
        out = A.Select(None)
        out.distinct = self.take("DISTINCT", "REDUCED")
        if self.take("*"):
            out.projection = None
        else:
            out.projection = []
            while True:
                if self.peek()[0] == "var":
                    out.projection.append((self.var(), None))
                elif self.take("("):
                    value = self.expression()
                    self.need("AS")
                    out.projection.append((self.var(), value))
                    self.need(")")
                else:
                    break
            if not out.projection:
                raise ParseError("nothing is selected")
        if query is not None:
            self.dataset(query)
        return self.body(out)

    def body(self, out: A.Select) -> A.Select:
        self.take("WHERE")
        out.where = self.group()
        self.modifiers(out)
        return out

    def modifiers(self, out: A.Select) -> None:
        if self.take("GROUP"):
            self.need("BY")
            out.grouped = True
            while True:
                if self.peek()[0] == "var":
                    v = self.var()
                    out.group.append((v, ("var", v)))
                elif self.at("("):
                    self.next()
                    value, name = self.expression(), None
                    if self.take("AS"):
                        name = self.var()
                    self.need(")")
                    out.group.append((name, value))
                elif self.peek()[0] == "name" and not self.at("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                    out.group.append((None, self.primary()))
                else:
                    break
        if self.take("HAVING"):
            while self.at("(") or self.peek()[0] == "name" and not self.at("ORDER", "LIMIT", "OFFSET", "VALUES"):
                out.having.append(self.primary())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if self.at("ASC", "DESC"):
                    down = self.next()[1].upper() == "DESC"
                    self.need("(")
                    out.order.append((self.expression(), down))
                    self.need(")")
                elif self.peek()[0] == "var" or self.at("(") or self.peek()[0] == "name" and not self.at("LIMIT", "OFFSET", "VALUES"):
                    out.order.append((self.primary(), False))
                else:
                    break
        while self.at("LIMIT", "OFFSET"):
            word, n = self.next()[1].upper(), self.next()
            if n[0] != "number" or not n[1].isdigit():
                raise ParseError(f"{word} needs a number")
            if word == "LIMIT":
                out.limit = int(n[1])
            else:
                out.offset = int(n[1])
        # a projection with aggregates is grouped even without GROUP BY
        out.grouped |= bool(out.having) or any(has_aggregate(e) for _, e in out.projection or ())

    # patterns

    def group(self):
        self.need("{")
        if self.at("SELECT"):
            node = self.select()
            if self.take("VALUES"):
                node = A.Join(node, self.values())
            self.need("}")
            return node
        node, filters, triples = A.Unit(), [], []

        def add(left, right):
            return right if isinstance(left, A.Unit) else A.Join(left, right)

        def flush(left):
            nonlocal triples
            if triples:
                left, triples = add(left, A.BGP(triples)), []
            return left

        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("FILTER"):
                filters.append(self.constraint())
            elif self.take("OPTIONAL"):
                node = flush(node)
                right, condition = self.group(), None
                if isinstance(right, A.Filter):
                    right, condition = right.node, right.condition
                node = A.LeftJoin(node, right, condition)
            elif self.take("MINUS"):
                node = A.Minus(flush(node), self.group())
            elif self.take("GRAPH"):
                node = flush(node)
                name = self.var_or_iri()
                node = add(node, A.Graph(name if A.is_var(name) else name[1:-1], self.group()))
            elif self.take("BIND"):
                node = flush(node)
                self.need("(")
                value = self.expression()
                self.need("AS")
                node = A.Extend(node, self.var(), value)
                self.need(")")
            elif self.take("VALUES"):
                node = add(flush(node), self.values())
            elif self.at("SERVICE"):
                raise ParseError("federated queries are not supported")
            elif self.at("{"):
                node = flush(node)
                inner = self.group()
                while self.take("UNION"):
                    inner = A.Union(inner, self.group())
                node = add(node, inner)
            else:
                triples += self.triples(paths=True)
        node = flush(node)
        for f in filters:
            node = A.Filter(node, f)
        return node

    def constraint(self):
        if self.at("EXISTS", "NOT"):
            return self.exists()
        return self.primary()

    def exists(self):
        negative = self.take("NOT")
        self.need("EXISTS")
        return ("exists", not negative, self.group())

    def values(self) -> A.Values:
        names, single = [], False
        if self.take("("):
            while not self.take(")"):
                names.append(self.var())
        else:
            names, single = [self.var()], True
        self.need("{")
        rows = []
        while not self.take("}"):
            if single:
                rows.append([None if self.take("UNDEF") else self.ground()])
                continue
            self.need("(")
            row = []
            while not self.take(")"):
                row.append(None if self.take("UNDEF") else self.ground())
            if len(row) != len(names):
                raise ParseError("VALUES rows must fit their variables")
            rows.append(row)
        return A.Values(names, rows)

    def template(self) -> list:
        """[(graph or None, Triple)] of { triples and GRAPH blocks }."""
        self.need("{")
        out = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("GRAPH"):
                name = self.var_or_iri()
                out += [(name if A.is_var(name) else name[1:-1], t) for _, t in self.template()]
            else:
                out += [(None, t) for t in self.triples()]
        return out

    def triples(self, paths: bool = False) -> list:
        out: list = []
        subject = self.node(out)
        if out and self.at(".", "}") and not self.at("{"):
            return out  # [ p o ] alone
        self.properties(subject, out, paths)
        return out

    def properties(self, subject, out: list, paths: bool) -> None:
        while True:
            verb = self.path() if paths else self.verb()
            while True:
                value = self.node(out)
                out.append(A.Triple(subject, verb, value))
                if self.take("{|"):
                    self.properties(A.Quoted(subject, verb, value) if _open(subject, verb, value) else f"<< {subject} {verb} {value} >>", out, False)
                    self.need("|}")
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.at(".", "}", "]", "|}"):
                return

    def verb(self):
        if self.peek() == ("name", "a"):
            self.next()
            return T.TYPE
        return self.var() if self.peek()[0] == "var" else self.iri()

    def path(self):
        if self.peek()[0] == "var":
            return self.var()
        return self._alternatives()

    def _alternatives(self):
        parts = [self._sequence()]
        while self.take("|"):
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else A.Alt(tuple(parts))

    def _sequence(self):
        parts = [self._element()]
        while self.take("/"):
            parts.append(self._element())
        return parts[0] if len(parts) == 1 else A.Seq(tuple(parts))

    def _element(self):
        inverse = self.take("^")
        if self.take("("):
            path = self._alternatives()
            self.need(")")
        elif self.take("!"):
            forward, backward = [], []
            several = self.take("(")
            while True:
                (backward if self.take("^") else forward).append(self.verb())
                if not (several and self.take("|")):
                    break
            if several:
                self.need(")")
            path = A.Neg(tuple(forward), tuple(backward))
        else:
            path = self.verb()
        if self.at("*", "+", "?"):
            mark = self.next()[1]
            path = A.Rep(path, 1 if mark == "+" else 0, mark != "?")
        return A.Inv(path) if inverse else path

    # terms

    def var(self) -> str:
        kind, text = self.next()
        if kind != "var":
            raise ParseError(f"expected a variable, got {text!r}")
        return "?" + text[1:]

    def iri(self) -> str:
        kind, text = self.next()
        if kind == "iri":
            body = T.unescape(text[1:-1])
            if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", body):
                from urllib.parse import urljoin

                body = urljoin(self.base, body)
            return f"<{body}>"
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ParseError(f"unknown prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{local}>"
        raise ParseError(f"expected an IRI, got {text!r}")

    def var_or_iri(self) -> str:
        return self.var() if self.peek()[0] == "var" else self.iri()

    def blank(self, label: str | None = None) -> str:
        """Blank nodes are hidden variables; writers turn them into fresh nodes."""
        if label is not None:
            return f"?_:{label}"
        self.fresh += 1
        return f"?_:anon{self.fresh}"

    def literal(self) -> str | None:
        kind, text = self.peek()
        sign = ""
        if kind == "op" and text in "+-" and self.peek(1)[0] == "number":
            self.next()
            sign, (kind, text) = ("-" if text == "-" else ""), self.peek()
        if kind == "string":
            self.next()
            body = T.escape(_string(text))
            if self.peek()[0] == "lang":
                return f'"{body}"{self.next()[1]}'
            if self.take("^^"):
                datatype = self.iri()
                return f'"{body}"^^{datatype}'
            return f'"{body}"'
        if kind == "number":
            self.next()
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return f'"{sign}{text}"^^<{T.XSD}{name}>'
        if kind == "name" and text.lower() in ("true", "false"):
            self.next()
            return f'"{text.lower()}"^^<{T.XSD}boolean>'
        return None

    def ground(self) -> str:
        if self.at("<<"):
            return self.node([])
        found = self.literal()
        return found if found is not None else self.iri()

    def node(self, out: list):
        """A term of a triple; [ ], ( ) and annotations add triples to out."""
        kind, text = self.peek()
        if kind == "var":
            return self.var()
        if kind == "bnode":
            self.next()
            return self.blank(text[2:])
        if self.take("<<"):
            s, p, o = self.node(out), self.verb(), self.node(out)
            self.need(">>")
            return A.Quoted(s, p, o) if _open(s, p, o) else f"<< {s} {p} {o} >>"
        if self.take("["):
            name = self.blank()
            if not self.take("]"):
                self.properties(name, out, True)
                self.need("]")
            return name
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            head = f"<{T.RDF}nil>"
            for item in reversed(items):
                cell = self.blank()
                out += [A.Triple(cell, f"<{T.RDF}first>", item), A.Triple(cell, f"<{T.RDF}rest>", head)]
                head = cell
            return head
        found = self.literal()
        return found if found is not None else self.iri()

    # expressions: ("op", args...)

    def expression(self):
        left = self._and()
        while self.take("||"):
            left = ("or", left, self._and())
        return left

    def _and(self):
        left = self._relation()
        while self.take("&&"):
            left = ("and", left, self._relation())
        return left

    def _relation(self):
        left = self._sum()
        if self.at("=", "!=", "<", ">", "<=", ">="):
            return (self.next()[1], left, self._sum())
        if self.at("IN") or self.at("NOT") and self.peek(1)[1].upper() == "IN":
            negative = self.take("NOT")
            self.need("IN")
            self.need("(")
            items = []
            while not self.take(")"):
                items.append(self.expression())
                self.take(",")
            return ("notin" if negative else "in", left, *items)
        return left

    def _sum(self):
        left = self._product()
        while self.at("+", "-"):
            left = (self.next()[1], left, self._product())
        return left

    def _product(self):
        left = self._unary()
        while self.at("*", "/"):
            left = (self.next()[1], left, self._unary())
        return left

    def _unary(self):
        if self.take("!"):
            return ("not", self._unary())
        if self.at("-", "+"):
            if self.peek(1)[0] == "number":
                return ("term", self.literal())
            sign = self.next()[1]
            return ("neg", self._unary()) if sign == "-" else self._unary()
        return self.primary()

    def primary(self):
        kind, text = self.peek()
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if kind == "var":
            return ("var", self.var())
        if self.at("EXISTS") or self.at("NOT") and self.peek(1)[1].upper() == "EXISTS":
            return self.exists()
        if self.at("<<"):
            node = self.node([])
            return ("TRIPLE", *(("var", x) if A.is_var(x) else ("term", x) for x in (node.s, node.p, node.o))) if isinstance(node, A.Quoted) else ("term", node)
        found = self.literal()
        if found is not None:
            return ("term", found)
        if kind == "name":
            name = self.next()[1].upper()
            self.need("(")
            if name in AGGREGATES:
                distinct = self.take("DISTINCT")
                if name == "COUNT" and self.take("*"):
                    self.need(")")
                    return ("agg", "COUNT", distinct, None, None)
                value, separator = self.expression(), " "
                if self.take(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    separator = _string(self.next()[1])
                self.need(")")
                return ("agg", name, distinct, value, separator)
            return (name, *self.arguments())
        name = self.iri()
        if self.take("("):
            return ("cast", name[1:-1], *self.arguments())
        return ("term", name)

    def arguments(self) -> list:
        items = []
        self.take("DISTINCT")
        while not self.take(")"):
            items.append(self.expression())
            self.take(",")
        return items

    # updates

    def updates(self) -> list[A.Update]:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                break
            out.append(self.update())
            if not self.take(";"):
                break
        if self.peek()[0] != "end":
            raise ParseError(f"unexpected {self.peek()[1]!r}")
        if not out:
            raise ParseError("empty update")
        return out

    def graph_ref(self) -> str:
        if self.at("DEFAULT", "NAMED", "ALL"):
            return self.next()[1].upper()
        self.take("GRAPH")
        return self.iri()[1:-1]

    def update(self) -> A.Update:
        if self.at("CLEAR", "DROP", "CREATE"):
            kind = self.next()[1].lower()
            silent = self.take("SILENT")
            return A.Update(kind, silent=silent, target=self.graph_ref())
        if self.take("LOAD"):
            silent = self.take("SILENT")
            source, target = self.iri()[1:-1], "DEFAULT"
            if self.take("INTO"):
                target = self.graph_ref()
            return A.Update("load", silent=silent, source=source, target=target)
        if self.at("COPY", "MOVE", "ADD"):
            kind = self.next()[1].lower()
            silent = self.take("SILENT")
            source = self.graph_ref()
            self.need("TO")
            return A.Update(kind, silent=silent, source=source, target=self.graph_ref())
        out = A.Update("modify")
        if self.take("WITH"):
            out.with_graph = self.iri()[1:-1]
        if self.take("DELETE"):
            if self.take("DATA"):
                return A.Update("delete_data", delete=self.template())
            if self.take("WHERE"):
                out.delete = self.template()
                out.where = A.Unit()
                for g, t in out.delete:
                    node = A.BGP([t]) if g is None else A.Graph(g, A.BGP([t]))
                    out.where = node if isinstance(out.where, A.Unit) else A.Join(out.where, node)
                return out
            out.delete = self.template()
        if self.take("INSERT"):
            if self.take("DATA"):
                return A.Update("insert_data", insert=self.template())
            out.insert = self.template()
        elif not out.delete:
            raise ParseError(f"unknown update form {self.peek()[1]!r}")
        while self.take("USING"):
            (out.using_named if self.take("NAMED") else out.using).append(self.iri()[1:-1])
        self.need("WHERE")
        out.where = self.group()
        return out


def _open(*terms) -> bool:
    """Whether any of a quoted triple's terms has a variable."""
    return any(A.is_var(t) or isinstance(t, A.Quoted) for t in terms)


def has_aggregate(e) -> bool:
    return isinstance(e, tuple) and (e[:1] == ("agg",) or any(has_aggregate(x) for x in e[1:]))


def parse_query(text: str, prefixes: dict[str, str] | None = None) -> A.Query:
    return Parser(text, prefixes).query()


def parse_update(text: str, prefixes: dict[str, str] | None = None) -> list[A.Update]:
    return Parser(text, prefixes).updates()


def fresh_blank(label: str, load: str | None = None) -> str:
    return f"_:{load or uuid.uuid4().hex[:8]}_{re.sub(r'[^A-Za-z0-9_]', '_', label)}"

"""Turtle text to triples, on the driver: shape and ontology files are small."""

from __future__ import annotations

import uuid

from ..functions import terms as T
from ..plans import algebra as A
from ..plans.parser import ParseError, Parser, fresh_blank


class _Turtle(Parser):
    def document(self) -> list[A.Triple]:
        out: list[A.Triple] = []
        while self.peek()[0] != "end":
            kind, text = self.peek()
            directive = text.lower().lstrip("@") if kind in ("lang", "name") else ""
            if directive in ("prefix", "base"):
                self.next()
                if directive == "prefix":
                    name = self.next()
                    if name[0] != "pname" or not name[1].endswith(":"):
                        raise ParseError("a prefix ends with a colon")
                    self.prefixes[name[1][:-1]] = self.iri()[1:-1]
                else:
                    self.base = self.iri()[1:-1]
                if kind == "lang":
                    self.need(".")
                continue
            out += self.triples()
            if self.peek()[0] != "end":
                self.need(".")
        return out


def parse(text: str, graph: str | None = None, prefixes: dict[str, str] | None = None) -> list[tuple]:
    """Quads of a Turtle text; blank labels are made unique to this load."""
    load = uuid.uuid4().hex[:8]

    def ground(x) -> str:
        if isinstance(x, A.Quoted):
            return f"<< {ground(x.s)} {ground(x.p)} {ground(x.o)} >>"
        if A.is_var(x):
            if not x.startswith("?_:"):
                raise ParseError(f"Turtle has no variables ({x})")
            return fresh_blank(x[3:], load)
        return x

    rows = []
    for t in _Turtle(text, prefixes).document():
        if not isinstance(t.p, str) or isinstance(t.s, str) and t.s.startswith('"') or T.kind_of(ground(t.p)) != "iri":
            raise ParseError("not a triple")
        rows.append((ground(t.s), ground(t.p), ground(t.o), graph))
    return rows

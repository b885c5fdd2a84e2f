"""N-Triples(-star) lines: a tokenizer, a distributed reader and a writer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T

QUADS = "s string, p string, o string, g string"
_TERM = re.compile(r'<(?!<)[^<>"{}|^`\\\s]*>|_:[^\s<>"]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z][A-Za-z0-9-]*|\^\^<[^>]+>)?|<<|>>|\.|#[^\n]*|\s+', re.S)
_PLAIN = r'^\s*(<[^<>\s]+>|_:\S+)\s+(<[^<>\s]+>)\s+(<[^<>\s]+>|_:[^\s.]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z][A-Za-z0-9-]*|\^\^<[^>]+>)?)\s*\.?\s*$'


class ParseError(ValueError):
    """Text that is not N-Triples."""


def _tokens(text: str):
    at = 0
    while at < len(text):
        m = _TERM.match(text, at)
        if not m:
            raise ParseError(f"unexpected text at {text[at:at + 30]!r}")
        at, token = m.end(), m.group()
        if not token.isspace() and not token.startswith("#"):
            yield token


def _term(first: str, rest) -> str:
    """A whole term; a quoted triple is put in canonical spacing."""
    if first != "<<":
        return first
    inner = [_term(next(rest), rest) for _ in range(3)]
    if next(rest) != ">>":
        raise ParseError("a quoted triple has three terms")
    return f"<< {' '.join(inner)} >>"


def triples(text: str) -> list[tuple[str, str, str]]:
    """All triples of a text; statements may share a line and the last dot may be missing."""
    rest, out, now = _tokens(text), [], []
    try:
        for token in rest:
            if token == ".":
                if len(now) != 3:
                    raise ParseError(f"a statement has three terms, got {now}")
                out.append(tuple(now))
                now = []
                continue
            if len(now) == 3:
                out.append(tuple(now))
                now = []
            now.append(_term(token, rest))
    except StopIteration:
        raise ParseError("unbalanced quoted triple") from None
    if now:
        if len(now) != 3:
            raise ParseError(f"a statement has three terms, got {now}")
        out.append(tuple(now))
    for s, p, o in out:
        if s.startswith('"') or s == "<>" or not p.startswith("<") or p.startswith("<<") or p == "<>" or o in ("<>", ">>"):
            raise ParseError(f"not a triple: {s} {p} {o}")
    return out


def split_line(line: str) -> tuple[str, str, str] | None:
    """The three terms of a line, or None if it has not three balanced ones."""
    try:
        found = triples(line)
    except ParseError:
        return None
    return found[0] if len(found) == 1 else None


def unquote(term: str) -> tuple[str, str, str] | None:
    """Subject, predicate and object of a quoted triple."""
    if not (term.startswith("<<") and term.endswith(">>")):
        return None
    return split_line(term[2:-2])


def read(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Quads of a text file or folder. Plain lines are matched natively; only lines with a quoted triple go to Python. Blank lines and comments are skipped, anything else is an error."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    plain = [F.regexp_extract("value", _PLAIN, i).alias(c) for i, c in enumerate("spo", 1)]
    star = F.col("value").contains("<<")
    simple = lines.where(~star).select("value", *plain)
    checked = F.when(F.col("s") != "", F.col("s")).otherwise(F.raise_error(F.concat(F.lit("not N-Triples: "), F.col("value"))))
    simple = simple.select(checked.alias("s"), "p", "o")

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            found = [t for v in batch.column(0).to_pylist() for t in triples(v)]
            yield pa.record_batch([pa.array(c, pa.string()) for c in (list(zip(*found, strict=True)) or [()] * 3)], names=["s", "p", "o"])

    nested = lines.where(star).mapInArrow(parse, "s string, p string, o string")
    return simple.unionByName(nested).withColumn("g", F.lit(graph).cast("string"))


def lines_of(quads: DataFrame) -> DataFrame:
    """One `s p o .` line per quad."""
    return quads.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def write(quads: DataFrame, path: str) -> None:
    lines_of(quads).write.text(path)


def quoted_relation(quads: DataFrame) -> DataFrame:
    """(term, qs, qp, qo) of every quoted triple in s or o, inner ones included."""
    terms = quads.select(F.col("s").alias("term")).union(quads.select(F.col("o").alias("term"))).where(T.is_quoted(F.col("term"))).distinct()

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            rows, todo = [], list(batch.column(0).to_pylist())
            while todo:
                t = todo.pop()
                parts = unquote(t)
                if parts:
                    rows.append((t, *parts))
                    todo += [x for x in parts if x.startswith("<<")]
            yield pa.record_batch([pa.array(c, pa.string()) for c in (list(zip(*rows, strict=True)) or [()] * 4)], names=["term", "qs", "qp", "qo"])

    return terms.mapInArrow(parse, "term string, qs string, qp string, qo string").distinct()

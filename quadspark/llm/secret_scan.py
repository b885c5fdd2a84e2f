"""Secret scans with multipart credential linking.

Base patterns give assigned secrets, access identifiers and long hex strings.
Weak parts (user names, 40-character keys, endpoints) say little alone; they are
reported only when complementary parts lie in the same scope (a block between
blank lines), however far apart: each weak part's scope is joined with the intervals of the
other roles by their ordered starts and running largest ends, so the work is
n log n in the parts of a text and no pairs are made.

Roles: identifier (access, user), secret (assign, hex, key), place (endpoint). A weak part is
reported if its scope holds a base span of another role, or weak parts of both other roles. A weak part
that overlaps a base span is already reported and goes.

Defined results: null text is empty: no spans, base_sha256 of the empty string, spans ''.
Repeated rows and ids give a row each. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

#: The base patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Weak parts.
USER = r"""\b(user_?name|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
KEY = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""(?:https?|s3|postgres(?:ql)?|mysql|redis|amqp)://[^\s"'<>]+"""
KINDS = ("assign", "access", "hex", "user", "key", "endpoint")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "user": "identifier", "key": "secret", "endpoint": "place"}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_USER_WORDS = ("user", "login", "account", "client")


class Scanner:
    def __init__(self):
        self.assign = re.compile(ASSIGN, re.I | re.A)
        self.access = re.compile(ACCESS)
        # a maximal run shorter than the least length would be dropped, so only long runs are looked for
        self.hex = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
        self.user = re.compile(USER, re.I | re.A)
        self.key = re.compile(KEY)
        self.endpoint = re.compile(ENDPOINT)

    def base(self, text: str, low: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the base patterns, ordered."""
        spans = []
        if any(w in low for w in _WORDS):
            spans += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if "AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        spans += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        spans.sort()
        return spans

    def weak(self, text: str, low: str, base: list) -> list[tuple[int, int, int]]:
        """Weak parts that link to complementary parts."""
        users = [(m.start(), 3, m.end()) for m in self.user.finditer(text)] if any(w in low for w in _USER_WORDS) else []
        if not base and not users:
            return []  # every link needs an identifier or a base span
        found = users + [(m.start(), 4, m.end()) for m in self.key.finditer(text)] + [(m.start(), 5, m.end()) for m in self.endpoint.finditer(text)]
        every = Intervals([(s, e) for s, _, e in base])
        found = [x for x in found if not every.meets(x[0], x[2])]
        if not found:
            return []
        strong = {r: Intervals([(s, e) for s, k, e in base if ROLE[KINDS[k]] == r]) for r in ("identifier", "secret", "place")}
        weak = {r: Intervals([(s, e) for s, k, e in found if ROLE[KINDS[k]] == r]) for r in strong}
        edges = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
        out = []
        for s, k, e in found:
            at = bisect.bisect_right(edges, s)
            lo = edges[at - 1] if at else 0
            hi = edges[at] if at < len(edges) else len(text)
            others = [r for r in strong if r != ROLE[KINDS[k]]]
            if any(strong[r].meets(lo, hi) for r in others) or all(weak[r].meets(lo, hi) for r in others):
                out.append((s, k, e))
        return out

    def scan(self, text: str) -> tuple[list, list]:
        low = text.lower()
        base = self.base(text, low)
        return base, sorted(base + self.weak(text, low, base))


class Intervals:
    """Ordered intervals that tell whether any of them meets another one."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.ends, top = [s for s, _ in spans], [], 0
        for _, e in spans:
            top = max(top, e)
            self.ends.append(top)

    def meets(self, lo: int, hi: int) -> bool:
        n = bisect.bisect_left(self.starts, hi)
        return n > 0 and self.ends[n - 1] > lo


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches):
    scanner = Scanner()
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            base, spans = scanner.scan(value.as_py() or "")
            n = [0, 0, 0]
            for _, k, _ in base:
                n[k] += 1
            rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

"""HTML main-text extraction with a host suffix array.

A page becomes a stream of blocks (texts between block-level tags), each with what its place in
the markup says: main (inside article or main), dropped (navigation, headers, footers,
sidebars, notices, adverts, forms, comments, hidden parts) or open.

Dropped blocks go. All others are judged by their host: a page's stream has the words of its open blocks, and each of its
main blocks as one token, since what an article shares with another one in parts is still article text. Words: the streams of a host's pages
are concatenated, their suffix array and its common prefixes are taken, and substrings of at least `window` words
(a shorter block: all of it) that two different pages have are boilerplate; unique runs stay. A main block's token is a substring
of its own, so its suffixes are counted by a grouping: the block goes if `support` different pages of the host and at least half of those with a main part have
it, as furniture does and a licence line or a quoted passage does not. A page that would lose all its main blocks that way keeps them.
Copies of a page (equal in all their blocks) count as one page.

Streams are dealt to tasks by the minimisers of their windows, so no task holds a whole host: equal windows have equal
minimisers. Equal pieces of one task travel once, and only as a mark if they are known to be repeated.

Markup names are evidence where all parts of a name speak of furniture (`site-footer`, not `no-sidebar` or `social-science`);
an article or main element inside such a part is main again, except among comments.

Defined results: null html is empty, its text is ''. Text outside any tag is open. Unclosed
tags end with their parent; stray end tags are ignored. Rows with a null or repeated page_id are pages of their own.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .fm_index import suffix_array
from .packed import bits_for
from .shared import bounded_batches, cut, parts_of, scratch, spread_join, with_row

#: Tags by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title svg math iframe object canvas select option button".split())
DROPPED_TAGS = frozenset("nav header footer aside form head menu dialog search fieldset figure label".split()) | RAW_TAGS
MAIN_TAGS = frozenset(("article", "main"))
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Parts of class names and ids: furniture, comments, words that go with either, and words that deny.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars header masthead footer cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay related recommended recommendations share sharing social widget widgets login signin search pagination pager toolbar skip hidden copyright legal disclaimer".split()
)
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
GENERIC = frozenset(
    "site page main global top bottom left right primary secondary inner outer box bar list lists container wrapper wrap section area block blocks panel slot unit link links item items button buttons icon icons form signup text message content header footer post posts article articles entry story stories blog user reader thread trail region group row col column fixed sticky mobile desktop small large the and of by for more".split()
)
DENIALS = frozenset("no not non has with without hide is".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def named(value: str) -> str | None:
    """What a class or id says: "comments", "furniture" or nothing. All parts of one of its names must speak of it."""
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name) if not p.isdigit()]
        if not parts or DENIALS.intersection(parts) or not all(p in FURNITURE or p in COMMENTS or p in GENERIC for p in parts):
            continue
        if COMMENTS.intersection(parts):
            return "comments"
        if FURNITURE.intersection(parts):
            return "furniture"
    return None


#: A new one of the first closes an open one of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<\?[^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACES = re.compile(r"[\s]+")
OPEN, MAIN, DROPPED, HINTED = 0, 1, 2, 3
WINDOW = 8
#: Different pages of a host that make a main block boilerplate.
SUPPORT = 3


def _place(tag: str, attributes: str, parent: int) -> int:
    """What an element says about its text, inside an element that says `parent`."""
    if parent == DROPPED or tag in DROPPED_TAGS:
        # the header and figure of an article can hold its heading and caption
        return MAIN if parent == MAIN and tag in ("header", "figure", "label") else DROPPED
    if attributes:
        for k, v in _ATTRIBUTE.findall(attributes):
            k, v = k.lower(), v.strip("\"'")
            if k == "role" and v.lower() in DROPPED_ROLES or k == "hidden" or k == "aria-hidden" and v.lower() == "true":
                return DROPPED
            if k == "role" and v.lower() in ("main", "article"):
                parent = MAIN
            if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
                return DROPPED
            if k in ("class", "id") and tag not in ("html", "body", *MAIN_TAGS) and (says := named(v)):
                if says == "comments":
                    return DROPPED
                parent = HINTED
    return MAIN if tag in MAIN_TAGS else parent


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, place) of a page's blocks, in order; white space is single, empty blocks are left out."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    now = OPEN

    def leave(i: int) -> int:
        """Closes stack[i:]; returns what held before."""
        before = stack[i][1]
        opened.subtract(t for t, _ in stack[i:])
        del stack[i:]
        return before

    def close():
        if parts:
            text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, DROPPED if now == HINTED else now))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS or now not in (DROPPED, HINTED) and tag in DROPPED_TAGS:
            close()
        elif tag == "br":
            parts.append(" ")
        if m.group(1):
            if opened[tag] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        before = leave(i)
                        if before != now:
                            close()
                        now = before
                        break
                    if tag not in BLOCK_TAGS and stack[i][0] in BLOCK_TAGS:
                        break  # an inline end tag does not close blocks
            continue
        attributes = m.group(3)
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template"):
            # raw text runs to its own end tag
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in P_CLOSERS or tag in CLOSES:
            closes = CLOSES.get(tag, ()) + (("p",) if tag in P_CLOSERS else ())
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t in closes:
                    now = leave(i)
                    break
                if t in BLOCK_TAGS:
                    break
        place = _place(tag, attributes, now)
        if place != now:
            close()
        stack.append((tag, now))
        opened[tag] += 1
        now = place
    close()
    return out


_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", re.I)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m.group(1).lower().removeprefix("www.") if m else (url or "")


def _blocks(batches):
    """The blocks of each page that are not dropped."""
    for batch in batches:
        texts, places = [], []
        for value in batch.column("html"):
            found = [x for x in blocks(value.as_py() or "") if x[1] != DROPPED]
            texts.append([t for t, _ in found])
            places.append([p for _, p in found])
        yield pa.record_batch([batch.column(c) for c in ("row", "page_id", "url")] + [pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))], names=["row", "page_id", "url", "blocks", "places"])


#: Kinds of pieces: words of an open block, an open block of fewer words than a window.
LONG, SHORT = 0, 1
#: Pieces of a bucket: kind and tokens, the different pages that have it (int64 digests), its places (row, block, first word, number of words); without places it is a mark.
PIECES_SCHEMA = "part int, pieces array<binary>, pages array<binary>, places array<binary>, done binary"
_PIECES = pa.schema([("part", pa.int32()), ("pieces", pa.list_(pa.binary())), ("pages", pa.list_(pa.binary())), ("places", pa.list_(pa.binary())), ("done", pa.binary())])
#: Bytes of pieces that a task gathers before it sends them.
GATHERED = 32 << 20


def _text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    w = K.Words.__new__(K.Words)
    w.data, w.starts, w.ends = data, offsets[:-1], offsets[1:]
    return w.hashes()


class Pages:
    """Blocks of some pages, with a hash for each block's host and for each page's content."""

    def __init__(self, batch: pa.RecordBatch):
        self.texts, places, self.row, self.number, host, page = [], [], [], [], [], []
        for row, url, found, place in zip(*(batch.column(c).to_pylist() for c in ("row", "url", "blocks", "places")), strict=True):
            if not found:
                continue
            name = int.from_bytes(hashlib.blake2b(host_of(url).encode(), digest_size=8).digest(), "little")
            content = int.from_bytes(hashlib.blake2b("\n".join(found).encode(), digest_size=8).digest(), "little")
            self.texts += found
            places += place
            self.number += range(len(found))
            self.row += [row] * len(found)
            host += [name] * len(found)
            page += [content] * len(found)
        self.main = np.array(places, np.int64) == MAIN
        self.host, self.page = np.array(host, np.uint64), np.array(page, np.uint64).view(np.int64)


def _pieces_of(texts: list[str], host: np.ndarray, window: int):
    """(block, first word, number of words, bucket hash, kind and tokens) of the pieces of some open blocks; host: a hash for each block."""
    data, offsets = K.buffers(pa.array(texts, pa.large_string()))
    whole = K.mix(_text_hashes(data, offsets) ^ host)
    w = K.Words(data, offsets, K.SPACE_SEPARATED)
    n = w.counts
    for b in np.flatnonzero(n < window).tolist():
        yield b, 0, int(n[b]), int(whole[b]), bytes([SHORT]) + whole[b].tobytes()
    token = K.mix(w.hashes() ^ host[w.row])
    m = window // 2
    low = K.sliding_min(K.windows(token, m), window - m + 1)
    row = w.row[: len(low)]
    ok = K.inside(w.first, len(token), window)
    opens = np.ones(len(low), bool)
    opens[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
    edge = np.flatnonzero(opens | ~ok)
    at = np.flatnonzero(opens & ok)
    after = np.append(edge, len(low))[np.searchsorted(edge, at, "right")]
    small = (token & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for a, e, b in zip(at.tolist(), (after + window - 1).tolist(), row[at].tolist(), strict=True):
        yield b, a - int(w.first[b]), e - a, int(low[a]), bytes([LONG]) + small[a:e].tobytes()


def _pieces(bits: int, window: int):
    """Pieces of open blocks, cut where their windows' minimisers change."""
    mask = (1 << bits) - 1

    def emit(held: dict):
        by_part: dict[int, tuple[list, list, list]] = {}
        done: list[bytes] = []
        for piece, (part, pages, *at) in held.items():
            to = by_part.setdefault(part, ([], [], []))
            known = len(pages) > 1
            to[0].append(piece)
            to[1].append(b"" if known else np.array(sorted(pages), np.int64).tobytes())
            places = np.array(at, np.int64).tobytes()
            to[2].append(b"" if known else places)
            if known:
                done.append(places)
        rest = pa.nulls(len(by_part), pa.binary())
        yield pa.record_batch([pa.array(list(by_part), pa.int32()), *(pa.array([x[k] for x in by_part.values()], pa.list_(pa.binary())) for k in range(3)), rest], schema=_PIECES)
        whole = b"".join(done)
        cuts = [whole[i : i + (1 << 20)] for i in range(0, len(whole), 1 << 20)]
        if cuts:
            none = [pa.nulls(len(cuts), pa.list_(pa.binary()))] * 3
            yield pa.record_batch([pa.array([(len(held) + k) * 0x9E3779B1 & mask for k in range(len(cuts))], pa.int32()), *none, pa.array(cuts, pa.binary())], schema=_PIECES)

    def run(batches):
        held: dict[bytes, list] = {}
        room = GATHERED
        for batch in batches:
            p = Pages(batch)
            use = np.flatnonzero(~p.main).tolist()
            if not use:
                continue
            for k, start, n, key, piece in _pieces_of([p.texts[b] for b in use], p.host[use], window):
                b = use[k]
                had = held.get(piece)
                if had is None:
                    held[piece] = [key & mask, {int(p.page[b])}, p.row[b], p.number[b], start, n]
                    room -= len(piece) + 400
                else:
                    if len(had[1]) < 2:
                        had[1].add(int(p.page[b]))
                    had += (p.row[b], p.number[b], start, n)
                    room -= 32
            if room < 0:
                yield from emit(held)
                held, room = {}, GATHERED
        if held:
            yield from emit(held)

    return run


_SPANS = pa.schema([("row", pa.int64()), ("spans", pa.binary())])


def _by_page(places: np.ndarray) -> pa.Table:
    """One row per page with its (block, first word, number of words) packed; places: (row, block, first word, number)."""
    if not len(places):
        return _SPANS.empty_table()
    places = places[np.argsort(places[:, 0], kind="stable")]
    ids = places[:, 0]
    head = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    ends = np.append(head[1:], len(ids))
    rest = places[:, 1:].astype(np.int32)
    return pa.table([pa.array(ids[head]), pa.array([rest[i:j].tobytes() for i, j in zip(head.tolist(), ends.tolist(), strict=True)], pa.binary())], schema=_SPANS)


def common_prefixes(seq: np.ndarray, sa: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, up to `most`; room: tokens up to the end of each one's stream."""
    a, b = sa[:-1], sa[1:]
    limit = np.minimum(np.minimum(room[a], room[b]), most)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(seq.astype(np.uint64) + np.uint64(1)) * K._POW(len(seq))[: len(seq)], dtype=np.uint64)])
    inverse = K._INV(len(prefix))
    length = np.zeros(len(a), np.int64)
    step = 1 << max(0, int(most).bit_length() - 1)
    while step:
        ok = np.flatnonzero(length + step <= limit)
        x, y = a[ok] + length[ok], b[ok] + length[ok]
        same = (prefix[x + step] - prefix[x]) * inverse[x] == (prefix[y + step] - prefix[y]) * inverse[y]
        length[ok[same]] += step
        step >>= 1
    return np.concatenate([[0], length])


def repeated_runs(streams: list[np.ndarray], page: np.ndarray, known: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, first token, number) of the runs that lie in substrings of `window` tokens which two different pages have; known: streams that count as two pages."""
    length = np.array([len(x) for x in streams], np.int64)
    _, symbol = np.unique(np.concatenate(streams), return_inverse=True)
    at = np.cumsum(length + 1) - length - 1
    seq = np.zeros(int((length + 1).sum()), np.int64)
    seq[K.ranges(at, length)] = symbol + 1
    stream = np.repeat(np.arange(len(streams)), length + 1)
    room = (at + length)[stream] - np.arange(len(seq))
    sa = suffix_array(seq)
    joins = common_prefixes(seq, sa, room, window) >= window
    group = np.cumsum(~joins) - 1
    head = np.flatnonzero(~joins)
    p, k = page[stream[sa]], known[stream[sa]]
    enough = np.logical_or.reduceat(k, head) | (np.minimum.reduceat(p, head) != np.maximum.reduceat(p, head))
    hit = np.zeros(len(seq) + 1, bool)
    hit[sa] = enough[group] & (room[sa] >= window)
    opens, closes = K.runs(hit[:-1])
    s = stream[opens]
    return s, opens - at[s], closes - opens + window - 1


def _main_tokens(batches):
    """(host, token, page, row, block) of main blocks: hashes of the host, the block and the page's content."""
    for batch in batches:
        p = Pages(batch)
        use = np.flatnonzero(p.main)
        data, offsets = K.buffers(pa.array([p.texts[b] for b in use.tolist()], pa.large_string()))
        token = K.mix(_text_hashes(data, offsets) ^ p.host[use]) if len(use) else np.empty(0, np.uint64)
        yield pa.record_batch([pa.array(p.host[use].view(np.int64)), pa.array(token.view(np.int64)), pa.array(p.page[use]), pa.array([p.row[b] for b in use], pa.int64()), pa.array([p.number[b] for b in use], pa.int32())], names=["host", "token", "page", "row", "block"])


def _repeated(window: int):
    """(row, spans): spans of a bucket's pieces that different pages have, by the suffix array of their streams."""

    def run(table: pa.Table) -> pa.Table:
        out = [np.frombuffer(b"".join(v.as_py() or b"" for v in table.column("done")), np.int64).reshape(-1, 4)]
        whole = table.filter(table.column("pieces").is_valid())
        found: dict[bytes, list] = {}
        streams, pages, known, places = [], [], [], []
        columns = (whole.column(c).combine_chunks() for c in ("pieces", "pages", "places")) if whole.num_rows else ()
        for piece, page, place in zip(*(c.flatten().to_pylist() for c in columns), strict=True):
            if piece[0] == LONG:
                streams.append(np.frombuffer(piece, np.uint32, offset=1))
                pages.append(int.from_bytes(page, "little", signed=True) if page else 0)
                known.append(not page)
                places.append(place)
            else:
                had = found.setdefault(piece, [set(), False, []])
                had[0].update(np.frombuffer(page, np.int64).tolist())
                had[1] |= not page
                had[2].append(place)
        for seen, sure, at in found.values():
            if sure or len(seen) > 1:
                out.append(np.frombuffer(b"".join(at), np.int64).reshape(-1, 4))
        if streams:
            s, start, n = repeated_runs(streams, np.array(pages, np.int64), np.array(known, bool), window)
            for k, a, c in zip(s.tolist(), start.tolist(), n.tolist(), strict=True):
                at = np.frombuffer(places[k], np.int64).reshape(-1, 4).copy()
                at[:, 2] += a
                at[:, 3] = c
                out.append(at)
        return _by_page(np.concatenate(out))

    return run


def _joined(share: float):
    def run(batches):
        for batch in batches:
            texts = []
            for found, places, spans, furniture in zip(*(batch.column(c).to_pylist() for c in ("blocks", "places", "spans", "furniture")), strict=True):
                span = np.frombuffer(b"".join(spans or ()), np.int32).reshape(-1, 3).astype(np.int64)
                kept, main = [], []
                for b, (text, place) in enumerate(zip(found, places, strict=True)):
                    own = span[span[:, 0] == b]
                    if place == MAIN:
                        main.append(b not in (furniture or ()))
                        kept.append((main[-1], MAIN, text))
                    elif not len(own):
                        kept.append((True, OPEN, text))
                    else:
                        words = text.encode().split()
                        gone = K.covered(own[:, 1], own[:, 2], len(words))
                        if len(words) and gone.mean() < share:
                            kept.append((True, OPEN, b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
                # where every main block repeats, the page is a variant of others rather than furniture
                texts.append("\n\n".join(t for stays, place, t in kept if stays or place == MAIN and not any(main)))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, blocks, places) of pages(row, page_id, url, html), parsed once."""
    return cut(pages.mapInArrow(_blocks, "row long, page_id long, url string, blocks array<string>, places array<int>"), "blocks", keep=True)


def repeats(pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, spans) of parsed pages: packed (block, first word, number of words) of open blocks that other pages of the host have too."""
    bits = bits_for(parts_of(pages, 16, 2))
    pieces = pages.mapInArrow(_pieces(bits, window), PIECES_SCHEMA)
    return pieces.groupBy("part").applyInArrow(_repeated(window), "row long, spans binary")


def main_furniture(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(row, block) of main blocks of parsed pages that `support` pages and half of the host's pages have."""
    with scratch():
        tokens = cut(pages.mapInArrow(_main_tokens, "host long, token long, page long, row long, block int"), "tokens")
        total = tokens.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
        times = tokens.groupBy("host", "token", "page").agg(F.count(F.lit(1)).alias("c")).groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.sum("c").alias("rows"))
        gone = times.where(F.col("pages") >= support).join(total, "host").where("2 * pages >= total").select("token", "rows")
        return cut(spread_join(tokens.select("token", "row", "block"), cut(gone, "furniture"), "token", "rows").select("row", "block"), "main_furniture", keep=True)


def extract(pages: DataFrame, window: int = WINDOW, share: float = 0.8, support: int = SUPPORT) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars). An open block goes whole if `share` of its words are repeated."""
    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = with_row(pages, "page_id", "html", "row")
    parsed = parsed_pages(pages)
    spans = cut(repeats(parsed, window), "spans", keep=True).groupBy("row").agg(F.collect_list("spans").alias("spans"))
    main = main_furniture(parsed, support).groupBy("row").agg(F.collect_list("block").alias("furniture"))
    judged = parsed.join(spans.join(main, "row", "full"), "row", "left").select("page_id", "url", "blocks", "places", "spans", "furniture")
    return judged.mapInArrow(_joined(share), "page_id long, url string, text string, n_chars long")

"""Pages: archives and main texts."""

import hashlib

import pytest

from quadspark.llm import html_extract, warc_archive
from quadspark.llm.shared import shared_dir


def test_warc_round_trip(spark):
    big, odd = "x" * 1200, "é\r\n\r\nWARC/1.1\r\n" * 100
    pages = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, "u", None), (7, "u\nv", odd), (8, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc_archive.round_trip(df).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        raw = (h or "").encode()
        r = got[i]
        assert (bytes(r.payload), r.payload_bytes, r.payload_digest) == (raw, len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: (got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, 7)} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 7: ("response", None)}
    assert warc_archive.round_trip(df.limit(0)).collect() == []


def test_warc_records_are_exact(spark):
    path = shared_dir(spark) + "/warc-test-records"
    warc_archive.write(spark.createDataFrame([(1, "http://a", "y" * 1000), (2, "http://b", "y" * 1000)], "page_id long, url string, html string"), path)
    archive = warc_archive.read(spark, path)
    records = sorted(bytes(r.record) for r in warc_archive.records(archive).collect())
    assert [r.startswith(b"WARC/1.1\r\nWARC-Type: re") for r in records] == [True, True]
    revisit, response = sorted(records, key=len)
    assert response.endswith(b"\r\n\r\n" + b"y" * 1000 + b"\r\n\r\n") and b"Content-Length: 1000" in response
    assert revisit.endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n") and b"WARC-Refers-To: <urn:page:2>" in revisit
    stored = spark.read.parquet(path + "/payloads")
    assert stored.count() == 1


def test_main_text(spark):
    boiler = "<div>Welcome to our site please subscribe to the weekly letter now ok</div>"
    pages = [
        (1, "http://a.x/1", boiler + "<p>one two three four five six seven eight nine unique"),
        (2, "http://a.x/2", boiler + "<p>something &amp; else that is only here on this page yes</p>"),
        (3, "http://b.x/2", boiler),
        (4, None, None),
        (5, "x", "plain"),
        (6, "http://a.x/3", '<nav>menu</nav><article><h1>T &lt;1&gt;</h1><p>a<br>b <aside>no</aside><p>c  <b>d</b>\n&copy &am;<script>var x="</p>";</script><div class="comments">zz</div></article><footer>f</footer>'),
        (7, "http://a.x/4", "<main><p>shared text of two articles that is long enough to repeat</p></main>"),
        (8, "http://a.x/5", "<main><p>shared text of two articles that is long enough to repeat</p></main>"),
        (9, "http://a.x/6", "<!-- <p>gone</p> --><form><p>gone</p></form><div hidden>gone</div><ul><li>x<li>y</ul>"),
    ]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, text string")).collect()}
    want = {
        1: "one two three four five six seven eight nine unique",
        2: "something & else that is only here on this page yes",
        3: "Welcome to our site please subscribe to the weekly letter now ok",
        4: "",
        5: "plain",
        6: "T <1>\n\na b\n\nc d © &am;",
        7: "shared text of two articles that is long enough to repeat",
        8: "shared text of two articles that is long enough to repeat",
        9: "x\n\ny",
    }
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_main_parts_are_judged_by_their_host(spark):
    """A line that many articles of a host carry goes, a passage of two stays, and a body beside a teaser stays."""
    line, shared = "<p>Tell your friends about this page and our weekly letter today</p>", "<p>a passage that exactly two of the articles have in common here</p>"
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(12))
    pages = [(i, f"http://h.x/{i}", f"<article><p>{body(i)}</p>{shared if i < 2 else ''}{line}</article>") for i in range(4)]
    pages += [(10, "http://h.x/10", f"<article><p>{body(10)}</p></article><div>{body(11)}</div>")]
    pages += [(20 + i, "http://copies.x/", f"<article><p>{body(20)}</p></article>") for i in range(4)]
    pages += [(30 + i, f"http://variants.x/{i}", f"<article><p>{body(30)}</p></article><div>{body(31 + i)}</div>") for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {i: body(i) + ("\n\na passage that exactly two of the articles have in common here" if i < 2 else "") for i in range(4)}
    want |= {10: body(10) + "\n\n" + body(11)} | {20 + i: body(20) for i in range(4)} | {30 + i: body(30) + "\n\n" + body(31 + i) for i in range(4)}
    assert got == want


def test_warc_missing_payload_fails(spark):
    """A header whose payload is gone does not vanish, and records are parsed from their bytes."""
    path = shared_dir(spark) + "/warc-test-missing"
    warc_archive.write(spark.createDataFrame([(1, "http://a/é", "ü\r\n\r\n" * 9), (2, "http://b", "z")], "page_id long, url string, html string"), path)
    built = warc_archive.records(warc_archive.read(spark, path))
    assert {(r.page_id, r.url, bytes(r.payload)) for r in warc_archive.parsed(built).collect()} == {(1, "http://a/é", ("ü\r\n\r\n" * 9).encode()), (2, "http://b", b"z")}
    left = spark.read.parquet(path + "/payloads").where("octet_length(payload) > 1").collect()
    spark.createDataFrame(left, "sha256 string, payload binary").write.mode("overwrite").parquet(path + "/payloads")
    with pytest.raises(Exception, match="no payload of digest"):
        warc_archive.read(spark, path).collect()


def test_warc_odd_headers(spark, monkeypatch):
    """Headers are exact whatever a url holds; null and repeated ids; a payload that most pages share is dealt to several tasks."""
    monkeypatch.setattr(warc_archive, "RECORDS_PER_TASK", 3)
    big = "z" * 1200
    urls = ["http://a/ WARC-Refers-To: <urn:page:77>", "http://a/\u0085WARC-Type: revisit", "WARC-Type: revisit", "a\r\nWARC-Refers-To: <urn:page:77>\n%0A", "%25", " "]
    pages = [(i, u, f"<p>{i}</p>" * 200) for i, u in enumerate(urls)] + [(100 + i, "u", big) for i in range(20)] + [(None, "v", big), (None, "v", "x"), (200, "w", "same"), (200, "w", "same"), (201, "q", big + "1"), (201, "q", big + "1")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = warc_archive.archived(df)
    rows = warc_archive.parsed(warc_archive.records(warc_archive.read(spark, path))).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.page_id, r.url, bytes(r.payload).decode()) for r in rows), key=key) == sorted(pages, key=key)
    brief = warc_archive.catalogued(spark, path).collect()
    assert sorted((tuple(r) for r in brief), key=key) == sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=key)
    assert {r.refers_to for r in rows if r.page_id is not None and r.page_id < 100} == {None}
    assert {(r.page_id, r.record_type) for r in rows if r.refers_to == 119} == {(100 + i, "revisit") for i in range(19)} | {(None, "revisit")}
    assert spark.read.parquet(path + "/payloads").count() == len({h for _, _, h in pages})


def test_names_of_parts():
    """Names speak of furniture as a whole, not in part; main parts inside furniture stay, comments go."""
    kept = ['<div class="content no-sidebar">text</div>', '<article class="post has-sidebar">text</article>', '<main><section id="social-science">text</section></main>', '<article><p class="share-prices">text</p></article>', '<div class="layout sidebar-left"><article>text</article></div>', '<div class="header"><main>text</main></div>']
    gone = ['<div class="site-footer">text</div>', '<div id="cookieBanner">text</div>', '<div class="x ads-top">text</div>', '<article><div class="post-comments"><article>text</article></div></article>', '<div class="menu"><p>text</p></div>', '<nav><main>text</main></nav>']
    assert [[t for t, p in html_extract.blocks(h) if p != html_extract.DROPPED] for h in kept] == [["text"]] * len(kept)
    assert [[t for t, p in html_extract.blocks(h) if p != html_extract.DROPPED] for h in gone] == [[]] * len(gone)


def test_deep_and_broken_markup_is_linear():
    import time

    begin = time.time()
    for page in ("<div>" * 60000 + "</x>" * 60000 + "a", "<b>" + "<div>" * 60000 + "</b>" * 60000 + "a"):
        assert html_extract.blocks(page) == [("a", html_extract.OPEN)]
    assert time.time() - begin < 10


def furniture(pages, window, support):
    """Brute force: page -> text, by sets of windows of each host."""
    parsed = [(i, html_extract.host_of(u), [x for x in html_extract.blocks(h or "") if x[1] != html_extract.DROPPED]) for i, u, h in pages]
    seen, total = {}, {}
    for _, host, found in parsed:
        page = tuple(t for t, _ in found)
        if any(p == html_extract.MAIN for _, p in found):
            total.setdefault(host, set()).add(page)
        for text, place in found:
            w = text.split(" ")
            keys = [("main", text)] if place == html_extract.MAIN else [tuple(w)] if len(w) < window else [tuple(w[a : a + window]) for a in range(len(w) - window + 1)]
            for k in keys:
                seen.setdefault((host, k), set()).add(page)
    out = {}
    for i, host, found in parsed:
        kept, main = [], []
        for text, place in found:
            w = text.split(" ")
            if place == html_extract.MAIN:
                n = len(seen[host, ("main", text)])
                main.append(n < support or 2 * n < len(total[host]))
                kept.append((main[-1], True, text))
                continue
            size = min(window, len(w))
            gone = {k for a in range(len(w) - size + 1) if len(seen[host, tuple(w[a : a + size])]) > 1 for k in range(a, a + size)}
            if len(gone) < 0.8 * len(w):
                kept.append((True, False, " ".join(x for k, x in enumerate(w) if k not in gone)))
        out[i] = "\n\n".join(t for stays, m, t in kept if stays or m and not any(main))
    return out


def test_repeats_against_brute_force(spark):
    """Random pages of a few hosts, whose blocks share words, phrases and whole parts."""
    import random

    r = random.Random(4)
    phrases = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 14))) for _ in range(12)]
    pages = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(0, 6)):
            body = " ".join(r.choice(phrases) if r.random() < 0.5 else f"w{r.randint(0, 400)}" for _ in range(r.randint(1, 5)))
            parts.append(f"<article><p>{body}</p></article>" if r.random() < 0.3 else f"<div>{body}</div>")
        pages.append((i, f"http://host{i % 3}.x/{i}", "".join(parts)))
    pages += [(200 + k, *pages[k][1:]) for k in range(6)]
    # a host whose articles share a line: all of them one, four of twelve another
    pages += [(300 + k, "http://lines.x/", f"<article><p>body {k}</p><p>a line of all</p>{'<p>a line of some</p>' if k % 3 == 0 else ''}</article><div>menu {k % 2}</div>") for k in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    for window in (4, 8):
        got = {x.page_id: x.text for x in html_extract.extract(df, window=window).collect()}
        assert got == furniture(pages, window, html_extract.SUPPORT)
        assert (got[300], got[301]) == ("body 0\n\na line of some", "body 1")
    through = html_extract.repeats(html_extract.parsed_pages(df.withColumn("row", df.page_id)))
    assert through.select("row").distinct().count() > 60


def test_repeated_page_ids(spark):
    pages = [(1, "http://a/", "<p>one page</p>"), (1, "http://a/", "<div>x</div><p>two</p><p>three</p>"), (None, "http://b/", "<p>null</p>"), (None, None, None), (2, "u", "")]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=str) == sorted([(1, "one page"), (1, "x\n\ntwo\n\nthree"), (None, "null"), (None, ""), (2, "")], key=str)

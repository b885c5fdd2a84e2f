"""The queries opN_* over the driver's tables, and the SQL they can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents at Jaccard 0.85 or more on four-word shingles."""
    from .jaccard_join import similarity_components

    return similarity_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside windows of 35 words that occur elsewhere."""
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), size=35)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts with thresholds per language and source."""
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in 10-word windows of benchmark items."""
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a content-addressed archive and read back."""
    from .warc_archive import archived, catalogued

    return catalogued(spark, archived(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those not held out."""
    from .language_id import predict

    return predict(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within two edits of an earlier line of at least 30 code points, or equal to one."""
    from .line_dedup import report

    return report(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as pieces: ids and losses of the three best segmentations, and the exact round trip."""
    from .sentence_pieces import encode

    return encode(table(spark, sf_dir, "documents"), n=3, with_n_best=True)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with linked parts."""
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_line_dedup,
        op3_sentencepiece,
        op4_quality_rules,
        op5_benchmark_decontamination,
        op6_warc,
        op7_language_id,
        op8_html_extraction,
        op9_secret_scan,
        op10_substring_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [len(ws) || ':' || array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: '4:' || array_to_string(ws[i:i+3], ' ')) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
        r AS (SELECT DISTINCT u AS a, u AS b FROM e UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op5_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        p AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i+9], ' '))) AS t FROM b WHERE len(ws) > 0),
        h AS (SELECT doc_id, k, i, array_to_string(ws[i:i+k-1], ' ') AS t FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(ws) >= k)),
        m AS (SELECT doc_id, item_id, i, h.k FROM h JOIN p ON h.t = p.t AND h.k = p.k),
        c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY 1),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1)
        SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op10_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i+34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
        r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM p SEMI JOIN r ON p.h = r.h),
        k AS (SELECT doc_id, k, ws[k] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w)),
        x AS (SELECT k.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k.k) AS kept FROM k ANTI JOIN c ON k.doc_id = c.doc_id AND k.k = c.k GROUP BY 1)
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN x ON x.doc_id = w.doc_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
        FROM q""",
}

"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets a few counts. Ratios of those that pass the base rules are
summarised by mergeable KLL quantile sketches per (language, source); sketches of
small groups are replaced by their language's, merged from the same sketches, and those of a small language by the
merge of all. The thresholds that follow from a group's quantiles are joined to
its documents, which must lie within them.

A ratio may exceed its group's third quartile, or mean_word fall below the first, by `spread` times the
distance between the quartiles. No fixed cutoff overrides that, so a document like the rest of its group is
kept whatever the group looks like, and up to a quarter of bad documents do not loosen a rule. Where the quartiles
(nearly) coincide, LEAST_SPREAD stands for their distance, so that one symbol does not condemn a document.

Defined results: null text -> no words, base_failed, not kept. Null language or
source is a group of its own. Repeated rows count as often as they occur.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, small

#: Groups with fewer sketched documents than this use the sketch of the next larger group.
LEAST_GROUP = 100
SKETCH_K = 400
#: ratio: the least distance of the quartiles, for groups whose documents are (nearly) equal
LEAST_SPREAD = {"symbol_ratio": 0.01, "dup_line_ratio": 0.05, "repeat_ratio": 0.05, "mean_word": 0.1}
#: ratios with a lower threshold
LOWER = ("mean_word",)


def let(value: Column, body) -> Column:
    """body(x) with x evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; w: array of words."""
    places = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

    def union_length(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    flagged = let(F.sort_array(places), lambda s: F.sort_array(F.transform(repeated(s), lambda x: x["i"])))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(flagged, union_length))


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), _repeat_words(w).cast("long").alias("r")))
    of_lines = let(lines, lambda l: F.struct(F.size(l).cast("long").alias("n"), (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("d")))
    had = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    return had.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), F.col("w.c").alias("word_chars"), "n_symbols", F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"))


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    return {"symbol_ratio": per("n_symbols", "word_chars"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words"), "mean_word": per("word_chars", "n_words")}


def thresholds(measured: DataFrame, spread: float = 4.0) -> DataFrame:
    """(lang, source, <ratio>_max, <ratio>_min) from sketches of the documents that pass the base rules."""
    good = measured.where("not base_failed")
    key = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(c) for c in ("lang", "source")]
    # each task sketches the documents it holds; only sketches are shuffled
    sketch = good.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in LEAST_SPREAD))
    sketch = cut(sketch, "sketches")
    merged = [F.kll_merge_agg_double(r).alias(f"{r}_") for r in LEAST_SPREAD]
    lang = sketch.groupBy("lang").agg(F.sum("n").alias("n_"), *merged)
    every = sketch.groupBy().agg(F.sum("n").alias("n_all"), *merged)
    every = every.select("n_all", *(F.col(f"{r}_").alias(f"{r}_all") for r in LEAST_SPREAD))
    groups = measured.select(*key).distinct()
    own = groups.join(sketch, ["lang", "source"], "left").join(lang, "lang", "left").join(F.broadcast(every))  # one row
    columns = []
    for r, least in LEAST_SPREAD.items():
        s = F.when(F.col("n") >= LEAST_GROUP, F.col(r)).when(F.col("n_") >= LEAST_GROUP, F.col(f"{r}_")).when(F.col("n_all") > 0, F.col(f"{r}_all"))  # none: nothing is known, nothing is dropped
        q = lambda p: F.kll_sketch_get_quantile_double(s, F.lit(p))  # noqa: B023,E731
        width = spread * F.greatest(q(0.75) - q(0.25), F.lit(least))
        columns.append((q(0.75) + width).alias(f"{r}_max"))
        if r in LOWER:
            columns.append((q(0.25) - width).alias(f"{r}_min"))
    return own.select("lang", "source", *columns)


def judge(docs: DataFrame, spread: float = 4.0) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, the counts, base_failed, kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    had = cut(counts(docs).withColumn("base_failed", base), "measured")
    measured = had.select("*", *(c.alias(r) for r, c in _ratios().items()))
    limits = cut(thresholds(measured, spread), "thresholds")
    d = measured.alias("d").select("d.*", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("k_lang"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("k_source"))
    t = small(limits.withColumnsRenamed({"lang": "k_lang", "source": "k_source"}), 200)
    joined = d.join(t, ["k_lang", "k_source"], "left")
    within = F.lit(True)
    for r in LEAST_SPREAD:
        within &= F.coalesce(F.col(r) <= F.col(f"{r}_max"), F.lit(True))
        if r in LOWER:
            within &= F.coalesce(F.col(r) >= F.col(f"{r}_min"), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"))

"""From raw documents to training ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents. run() writes each
stage's rows as Parquet to the shared folder and rereads them for the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.llm.decontaminate import decontaminate
from quadspark.llm.jaccard_join import similarity_components
from quadspark.llm.language_id import fit, held_out, identify
from quadspark.llm.line_dedup import dedup_lines
from quadspark.llm.sentence_pieces import encode
from quadspark.llm.shared import bounded_batches, cut, fresh_name, table, with_row

#: A document whose best language scores less has none.
LEAST_SCORE = 0.2
#: A document whose declared language is another one than its text's at this score is misfiled.
SURE_SCORE = 0.8
WORD = r"[^ \t-\r]"


def _whole(docs: DataFrame) -> Column:
    """All columns of docs in one, so that none of them clashes with what an operator adds."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")


def _with_text(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of found's `whole`, with found's text and n_chars made to fit it."""

    def value(c: str) -> Column:
        if c == "text":
            return F.col("text")
        return F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"whole.`{c}`")

    return found.select(*(value(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language, and those confidently of another language than declared."""
    bounded_batches(spark)
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(True))))
    judged = identify(docs.select("text", _whole(docs)), model, ["whole"])
    known = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)
    misfiled = F.coalesce(F.col("whole.lang") != F.col("lang_pred"), F.lit(False)) & (F.col("score") >= SURE_SCORE)
    return judged.where(known & ~misfiled).select("whole.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated and nearly repeated lines; a document of which nothing else was left goes."""
    found = dedup_lines(docs.select("doc_id", "text", _whole(docs)))
    return _with_text(found.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at Jaccard 0.8 or more on five-word shingles, the row of the least id stays; documents without a word stay. Rows with a null or repeated id are rows of their own."""
    row = fresh_name(docs, "row")
    rows = with_row(docs, "doc_id", "text", row)
    groups = similarity_components(rows.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias(row))
    return rows.join(stay, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts."""
    found = decontaminate(docs.select("doc_id", "text", _whole(docs)), table(spark, sf_dir, "benchmark"))
    return _with_text(found, docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts; the ids decode to them exactly."""
    bounded_batches(spark)
    return encode(docs, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("sentencepiece", pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

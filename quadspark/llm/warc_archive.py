"""Content-addressed WARC archive, in DataFrame functions only.

An archive is two tables in the shared folder: `payloads` keeps each payload's
bytes once under its SHA-256, `headers` keeps every record's exact header block
with the digest of its payload. Records are rebuilt by joining the two; the stored
bytes are hashed again when they are read, so a payload that is missing or does not match its digest fails.

Of records with equal payloads of at least `REVISIT_BYTES`, the one with the
largest page_id is a response, the others are revisits of it.

Payloads are written from the scan; what other pages have too is left out there, by its ids. They are shuffled once,
to meet the headers of records with a block. Revisits only need their payload's length and digest. A payload
of many records is dealt to several tasks.

Defined results: null html -> an empty payload, a response. Null url -> an empty
target. A target with CR or LF is kept exactly: `%`, CR and LF are percent-encoded, and a line says so. A null page_id
counts as smaller than any other, so it revisits an equal payload of a known page. Repeated rows with one page_id are written once
each, equal ones both as responses. Extra columns are ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, cut, scratch, shared_dir, spread_join

REVISIT_BYTES = 1000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Records that a stored payload is joined to in one task; a payload of more is copied to more tasks.
RECORDS_PER_TASK = 1000


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _header() -> Column:
    """The header block of a record, without the blank line that ends it."""
    revisit = F.col("refers_to").isNotNull()
    url = F.coalesce(F.col("url"), F.lit(""))
    odd = url.rlike(r"[\r\n]")
    escaped = F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    return F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _uri(F.col("page_id"))),
        line("WARC-Target-URI", F.when(odd, escaped).otherwise(url)),
        F.when(odd, F.lit("WARC-Target-URI-Encoding: percent")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, line("WARC-Refers-To", _uri(F.col("refers_to")))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )


def _known(c: str) -> Column:
    """An id that equals itself where it is null."""
    return F.coalesce(F.col(c), F.lit(-(1 << 63)))


def write(pages: DataFrame, path: str) -> None:
    """Writes pages(page_id, url, html) as an archive at path."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = keyed.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("sha256"))
    with scratch():
        marks = cut(keyed.select("page_id", "url", "payload_bytes", "sha256", F.sha1("payload").alias("sha1")), "marks")
        # one page stands for each digest; only ids and digests are shuffled to find it
        times = marks.groupBy("sha256", "page_id").agg(F.count(F.lit(1)).alias("c"))
        top = times.groupBy("sha256").agg(F.max(F.struct("page_id", "c")).alias("top"), F.sum("c").alias("copies"))
        first = cut(top.select("sha256", F.col("top.page_id").alias("keeper"), F.col("top.c").alias("keeper_rows"), "copies"), "keepers")
        told = spread_join(marks, first, "sha256", "copies")
        after = F.col("keeper").isNotNull() & F.coalesce(F.col("page_id") < F.col("keeper"), F.lit(True))
        header = told.withColumn("refers_to", F.when((F.col("payload_bytes") >= REVISIT_BYTES) & after, F.col("keeper")))
        header.select("sha256", _header().alias("header"), "copies").write.option("compression", "zstd").parquet(f"{path}/headers")
        # pages whose payload another page stands for; as a rule they are few, and all others are written straight from the scan
        many = first.where("copies > 1")
        gone = cut(spread_join(marks.select("sha256", "page_id"), many, "sha256", "copies").where(after).select(_known("page_id").alias("id"), "sha256").distinct(), "copies")
        few = gone.count() * 100 <= BROADCAST_BYTES
        ids = keyed.select(_known("page_id").alias("id"), "sha256", "payload")
        kept = ids.join(F.broadcast(gone) if few else gone, ["id", "sha256"], "left_anti")
        twice = many.where("keeper_rows > 1").select(_known("keeper").alias("id"), "sha256")
        if twice.limit(1).count():  # a page_id with one payload several times
            hint = F.broadcast(twice) if twice.count() * 100 <= BROADCAST_BYTES else twice
            kept = kept.join(hint, ["id", "sha256"], "left_anti").unionByName(kept.join(hint, ["id", "sha256"], "left_semi").dropDuplicates(["sha256"]))
        kept.select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload) of an archive, each payload hashed again."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("sha256"))))
    return stored.select("sha256", sound.cast("binary").alias("payload"))


def _joined(headers: DataFrame, stored: DataFrame, value: str) -> DataFrame:
    """headers with column `value` of their payloads, which must be there; frequent payloads are copied to several tasks."""
    tasks = F.ceil(F.col("copies") / RECORDS_PER_TASK).cast("int")
    often = headers.where(F.col("copies") > RECORDS_PER_TASK).groupBy("sha256").agg(F.max("copies").alias("copies"))
    often = stored.join(often, "sha256").withColumn("salt", F.explode(F.sequence(F.lit(0), tasks - 1)))
    # a digest of few records has salt -1, and copies of a payload for many are only made where there are any
    every = stored.select("sha256", F.lit(-1).alias("salt"), value)
    if headers.where(F.col("copies") > RECORDS_PER_TASK).limit(1).count():
        every = every.unionByName(often.select("sha256", "salt", value))
    salt = F.when(F.col("copies") > RECORDS_PER_TASK, F.pmod(F.xxhash64("header"), tasks)).otherwise(-1).cast("int")
    joined = headers.withColumn("salt", salt).join(every, ["sha256", "salt"], "left")
    there = F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("no payload of digest "), F.col("sha256"))).cast(joined.schema[value].dataType))
    return joined.select("header", there.alias(value))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sha256 string, header string, copies long").parquet(f"{path}/headers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload): every record's exact header block and its full payload, verified against its digest."""
    return _joined(_headers(spark, path), _stored(spark, path), "payload")


def _field(name: str, header: str = "header") -> Column:
    """A header line's value; lines end with CRLF alone, whatever else a value holds."""
    return F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def _record(header: Column, block: Column) -> Column:
    return F.concat(F.encode(F.concat(header, F.lit(CRLF + CRLF)), "UTF-8"), block, F.lit((CRLF + CRLF).encode()))


def records(archive: DataFrame) -> DataFrame:
    """read()'s rows as the bytes of WARC records (`record`), beside the payload; a revisit has an empty block."""
    block = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select(_record(F.col("header"), block).alias("record"), "payload")


def _split(built: DataFrame) -> DataFrame:
    """built's columns but `record`, with its header and its block, which must have the length that the header names."""
    # one character a byte, so that places in the string are places in the record
    rest = [c for c in built.columns if c != "record"]
    split = built.select(*rest, "record", F.locate(CRLF + CRLF, F.decode("record", "ISO-8859-1")).alias("at"))
    split = split.select(*rest, "record", "at", F.decode(F.substring("record", F.lit(1), F.col("at") - 1), "UTF-8").alias("header"))
    length = _field("Content-Length").cast("int")
    whole = F.octet_length("record") == F.col("at") + 3 + length + 4
    block = F.when(whole, F.substring("record", F.col("at") + 4, length)).otherwise(F.raise_error(F.lit("record does not have the length it names")))
    return split.select(*rest, "header", block.cast("binary").alias("block"))


def _told(split: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of parsed records with `payload_bytes` and `sha1` as measured."""
    page = lambda k: F.regexp_extract("header", rf"(?:^|\r\n){k}: <urn:page:(-?\d+)>", 1)
    digest = F.when(_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1")), F.col("sha1")).otherwise(F.raise_error(F.lit("payload does not match the digest of its record")))
    url = _field("WARC-Target-URI")
    plain = F.replace(F.replace(F.replace(url, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    return split.select(
        page("WARC-Record-ID").try_cast("long").alias("page_id"),
        F.when(_field("WARC-Target-URI-Encoding") == "percent", plain).otherwise(url).alias("url"),
        *(["payload"] if "payload" in split.columns else []),
        "payload_bytes",
        digest.cast("string").alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        F.when(page("WARC-Refers-To") != "", page("WARC-Refers-To").try_cast("long")).alias("refers_to"),
    )


def parsed(built: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to), each read from the bytes of records(); a revisit's payload is the archive's, and must have the digest that its record names."""
    payload = F.when(_field("WARC-Type") == "revisit", F.col("payload")).otherwise(F.col("block")).alias("payload")
    split = _split(built).select("header", payload)
    return _told(split.select("header", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1")))


def catalogued(spark: SparkSession, path: str) -> DataFrame:
    """parsed()'s columns without the payloads: records with a block are rebuilt and parsed, revisits take length and digest from what is stored."""
    headers, stored = _headers(spark, path), _stored(spark, path)
    revisit = _field("WARC-Type") == "revisit"
    whole = _joined(headers.where(~revisit), stored, "payload")
    split = _split(whole.select(_record(F.col("header"), F.col("payload")).alias("record")))
    blocks = split.select("header", F.octet_length("block").cast("long").alias("payload_bytes"), F.sha1("block").alias("sha1"))
    facts = stored.select("sha256", F.struct(F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1")).alias("facts"))
    empty = _joined(headers.where(revisit), facts, "facts").select(_record(F.col("header"), F.lit(b"")).alias("record"), "facts")
    return _told(blocks).unionByName(_told(_split(empty).select("header", "facts.payload_bytes", "facts.sha1")))


def archived(pages: DataFrame) -> str:
    """Path of pages as an archive in the shared folder."""
    path = f"{shared_dir(pages.sparkSession)}/quadspark/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return path


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to an archive in the shared folder, reads it back and parses the records, payloads included."""
    return parsed(records(read(pages.sparkSession, archived(pages))))

"""Tables in the folder that driver and executors share, and other plumbing."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast below this many bytes, counted before; beyond it, it is shuffled.
BROADCAST_BYTES = 16 << 20
#: Keys are frequent beyond this many rows, and beyond such a share of all rows that there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1000, 100_000
_scratch = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    return base


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most `rows` rows, where the session has Spark's own default: rows here are whole texts or sets of hashes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


@contextmanager
def scratch():
    """Tables that `cut` writes in here are deleted at the end, but for those it is told to keep; what is returned must not need them."""
    outer, made = getattr(_scratch, "made", None), []
    _scratch.made = made
    try:
        yield
    finally:
        _scratch.made = outer
        for spark, path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quadspark/{name}-{uuid.uuid4().hex}"
    if getattr(_scratch, "made", None) is not None and not keep:
        _scratch.made.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit in the limit, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def spread_join(rows: DataFrame, unique: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with `unique`, a written table of one row a key whose column `count` says how many rows have it.

    Frequent keys are at most HOT_KEYS by their definition; they are sent to the rows, so no task gets all rows of one. The others are shuffled."""
    total = unique.agg(F.sum(count)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = unique.where(F.col(count) > limit)
    if not hot.limit(1).count():
        return rows.join(unique, key)
    seldom = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(unique.where(F.col(count) <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(seldom)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row(df: DataFrame, key: str, text: str, row: str) -> DataFrame:
    """df with a long column `row` that names each row and is ordered as `key` is: the key itself where no row lacks it and no two share it.

    Otherwise rows are sorted by key (nulls first; ties by their text's hash) and numbered once, in a table of the shared folder."""
    value = F.col(key).cast("long")
    odd = df.groupBy(value.alias("k")).agg(F.count(F.lit(1)).alias("c")).where("k is null or c > 1")
    if not odd.limit(1).count():
        return df.withColumn(row, value)
    ordered = df.sort(value.asc_nulls_first(), F.xxhash64(F.col(text).cast("string")), F.rand(7))
    return cut(ordered.withColumn(row, F.monotonically_increasing_id()), "numbered", keep=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(df: DataFrame, least: int = 16, each: int = 1) -> int:
    """A number of buckets that grows with the partitions of the input."""
    n = df.rdd.getNumPartitions() if df.sparkSession.sparkContext else least
    return max(least, each * n)

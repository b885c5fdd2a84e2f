"""QuadStore: an immutable snapshot of quads, swapped as a whole on each write."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .sources.ntriples import QUADS, quoted_relation

#: Snapshots of at most this many rows are kept as local relations in the plan.
LOCAL_ROWS = 2000
#: A snapshot is written anew after so many inserts.
MOST_PIECES = 16


def shared_folder(spark: SparkSession) -> str:
    """Where snapshots are written: the folder of spark.checkpoint.dir; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)


def local_df(spark: SparkSession, rows: list, schema: str | StructType) -> DataFrame:
    """A few rows as a local relation: the optimizer knows their size and joins with them need no shuffle."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if any(f.dataType != StringType() for f in fields):
        return spark.createDataFrame(rows, fields)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    table = pa.table([pa.array(c, pa.string()) for c in columns], names=fields.names)
    return spark.createDataFrame(table, fields)


def pin(df: DataFrame) -> DataFrame:
    return pinned(df)[0]


def pinned(df: DataFrame) -> tuple[DataFrame, int]:
    """Ends df's lineage and counts its rows: written to the shared folder and reread, or a local relation if its rows are few."""
    spark = df.sparkSession
    if _is_small(df):
        rows = df.limit(LOCAL_ROWS + 1).collect()
        if len(rows) <= LOCAL_ROWS:
            return local_df(spark, rows, df.schema), len(rows)
    path = f"{shared_folder(spark)}/quadspark/pin-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    n = out.count()  # from the files' footers
    return (local_df(spark, out.collect(), df.schema) if n <= LOCAL_ROWS else out), n


def _is_small(df: DataFrame) -> bool:
    """Whether the optimizer bounds df's size so low that computing it for a look costs nothing to speak of."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 24


def empty(spark: SparkSession) -> DataFrame:
    return local_df(spark, [], QUADS)


def same_quad(a: str = "a", b: str = "b"):
    return (F.col(f"{a}.s") == F.col(f"{b}.s")) & (F.col(f"{a}.p") == F.col(f"{b}.p")) & (F.col(f"{a}.o") == F.col(f"{b}.o")) & F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Quads of left that are not in right."""
    return left.alias("a").join(right.alias("b"), same_quad(), "left_anti")


def in_graph(quads: DataFrame, graph: str | None) -> DataFrame:
    return quads.where(F.col("g").isNull() if graph is None else F.col("g") == bare(graph))


def bare(graph: str) -> str:
    return graph[1:-1] if graph.startswith("<") and graph.endswith(">") else graph


class QuadStore:
    """Set of quads (s, p, o, g); g is a graph's IRI without brackets, null for the default graph.

    A DataFrame built from `quads` before a write keeps seeing the old snapshot.
    """

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None):
        self.spark, self.lock, self.version = spark, threading.RLock(), 0
        self.quads = empty(spark) if quads is None else quads.select("s", "p", "o", "g")
        self._quoted: tuple[int, DataFrame] | None = None
        self._pieces = 1

    def quoted(self) -> DataFrame:
        if self._quoted is None or self._quoted[0] != self.version:
            self._quoted = (self.version, quoted_relation(self.quads))
        return self._quoted[1]

    def swap(self, quads: DataFrame) -> None:
        with self.lock:
            self.quads, self.version = quads, self.version + 1

    def insert(self, rows: DataFrame) -> int:
        """Adds quads; returns how many are new."""
        with self.lock:
            new, n = pinned(minus(rows.select("s", "p", "o", "g").distinct(), self.quads))
            if n:
                # the old snapshot's files are kept; only the new rows are written, until there are many pieces
                self._pieces += 1
                grown = self.quads.unionByName(new)
                if self._pieces >= MOST_PIECES or _is_small(grown):
                    grown = pin(grown)
                    self._pieces = 1
                self.swap(grown)
            return n

    def delete(self, rows: DataFrame) -> int:
        """Removes quads; returns how many there were."""
        with self.lock:
            gone, n = pinned(self.quads.alias("a").join(rows.select("s", "p", "o", "g").distinct().alias("b"), same_quad(), "left_semi"))
            if n:
                self.swap(pin(minus(self.quads, gone)))
            return n

    def change(self, removed: DataFrame, added: DataFrame) -> int:
        """(store - removed) + added in one swap; returns the net change of its size."""
        with self.lock:
            before = self.quads.count()
            kept = minus(self.quads, removed.select("s", "p", "o", "g").distinct())
            after, n = pinned(kept.unionByName(added.select("s", "p", "o", "g")).distinct())
            self.swap(after)
            return n - before

    def clear(self, graph: str | None = None, everything: bool = False, named: bool = False) -> int:
        with self.lock:
            before = self.quads.count()
            if everything:
                self.swap(empty(self.spark))
            elif named:
                self.swap(pin(self.quads.where("g is null")))
            else:
                keep = F.col("g").isNotNull() if graph is None else F.col("g").isNull() | (F.col("g") != bare(graph))
                self.swap(pin(self.quads.where(keep)))
            return self.quads.count() - before

    def size(self, graph: str | None = None, everything: bool = False) -> int:
        return (self.quads if everything else in_graph(self.quads, graph)).count()

    def rows(self, rows: list[tuple]) -> DataFrame:
        return local_df(self.spark, rows, QUADS)

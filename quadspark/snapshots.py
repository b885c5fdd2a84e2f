"""Named snapshots of a store: Parquet by graph with a manifest of JSON lines."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph, guarded
from .store import minus

MANIFEST = "id string, label string, created string, quads long"


def _manifest(graph: Graph, base: str) -> DataFrame:
    return graph.spark.read.schema(MANIFEST).json(f"{base}/manifest")


@guarded
def snapshot(graph: Graph, base: str, label: str = "") -> dict:
    """Writes the store below base; graphs are partitions, so that one graph is read alone."""
    name = uuid.uuid4().hex
    quads = graph.store.quads
    quads.withColumn("graph", F.coalesce("g", F.lit(""))).write.partitionBy("graph").parquet(f"{base}/{name}")
    n = quads.count()
    row = (name, label, dt.datetime.now(dt.timezone.utc).isoformat(), n)
    graph.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{base}/manifest")
    return {"ok": True, "id": name, "quads": n}


def read(graph: Graph, base: str, name: str) -> DataFrame:
    return graph.spark.read.schema("s string, p string, o string, g string, graph string").parquet(f"{base}/{name}").select("s", "p", "o", "g")


@guarded
def snapshots(graph: Graph, base: str) -> dict:
    """All snapshots, oldest first."""
    return {"ok": True, "snapshots": [r.asDict() for r in _manifest(graph, base).orderBy("created").collect()]}


@guarded
def prune(graph: Graph, base: str, keep: int) -> dict:
    """Deletes all but the latest `keep` snapshots."""
    rows = [r.asDict() for r in _manifest(graph, base).orderBy("created").collect()]
    gone, left = rows[: max(0, len(rows) - keep)], rows[max(0, len(rows) - keep) :]
    if gone:
        # the new manifest comes first, then the old one goes, so that none is missing at any time
        files = graph.spark.read.schema(MANIFEST).json(f"{base}/manifest").inputFiles()
        graph.spark.createDataFrame([tuple(r.values()) for r in left], MANIFEST).coalesce(1).write.mode("append").json(f"{base}/manifest")
        for path in [*files, *(f"{base}/{r['id']}" for r in gone)]:
            where = graph.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(graph.spark._jsc.hadoopConfiguration()).delete(where, True)
        graph.spark.catalog.refreshByPath(f"{base}/manifest")
    return {"ok": True, "pruned": len(gone), "kept": len(left)}


@guarded
def restore(graph: Graph, base: str, name: str) -> dict:
    """Replaces the store's quads."""
    quads = read(graph, base, name)
    graph.store.swap(quads)
    return {"ok": True, "quads": quads.count()}


@guarded
def diff(graph: Graph, base: str, before: str, after: str) -> dict:
    """How many quads were added and removed between two snapshots."""
    a, b = read(graph, base, before), read(graph, base, after)
    return {"ok": True, "added": minus(b, a).count(), "removed": minus(a, b).count()}

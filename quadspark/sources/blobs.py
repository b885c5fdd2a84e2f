"""Blobs of N-Triples text: something that is attached, downloaded and purged.

Memory and file blobs hold one text on the driver. A folder blob holds any number of triples in a folder that
all executors share; it is read and written by tasks, and no text reaches the driver.
"""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from . import ntriples as N


class Blob(Protocol):
    def attached(self) -> bool: ...
    def download(self) -> str: ...
    def attach(self, text: str, filename: str, content_type: str) -> None: ...
    def purge(self) -> None: ...


class MemoryBlob:
    def __init__(self, text: str | None = None):
        self.text, self.filename, self.content_type = text, None, None

    def attached(self) -> bool:
        return self.text is not None

    def download(self) -> str:
        return self.text or ""

    def attach(self, text: str, filename: str, content_type: str) -> None:
        self.text, self.filename, self.content_type = text, filename, content_type

    def purge(self) -> None:
        self.text = None


class FileBlob:
    """A file below a folder; written whole and renamed."""

    def __init__(self, folder: str | Path, name: str):
        self.path = Path(folder) / name

    def attached(self) -> bool:
        return self.path.exists()

    def download(self) -> str:
        return self.path.read_text(encoding="utf-8")

    def attach(self, text: str, filename: str, content_type: str) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_suffix(self.path.suffix + ".part")
        part.write_text(text, encoding="utf-8")
        os.replace(part, self.path)

    def purge(self) -> None:
        self.path.unlink(missing_ok=True)


class FolderBlob:
    """A folder of N-Triples files, one statement a line. A new version is written beside the old one, which then makes way for it; if that was cut short, the old one still counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        """The version that counts: the folder, or the one that was to make way for it."""
        files = self._files()
        return next((p for p in (self.path, self.path + ".old") if files.exists(self._path(p + "/_SUCCESS"))), None)

    def attached(self) -> bool:
        return self._current() is not None

    def empty(self) -> bool:
        return self.spark.read.text(self._current()).where(r"value rlike '^\\s*[^#\\s]'").isEmpty()

    def frame(self, graph: str | None = None) -> DataFrame:
        """Its quads, lazily."""
        return N.read(self.spark, self._current(), graph)

    def attach_frame(self, quads: DataFrame) -> int:
        """Replaces its content by the triples of quads; returns the bytes written."""
        files, part, old = self._files(), self._path(f"{self.path}.part-{uuid.uuid4().hex}"), self._path(self.path + ".old")
        N.write(quads, part.toString())
        if files.exists(self._path(self.path)):
            files.delete(old, True)
            files.rename(self._path(self.path), old)
        files.rename(part, self._path(self.path))
        files.delete(old, True)
        return files.getContentSummary(self._path(self.path)).getLength()

    def purge(self) -> None:
        for p in (self.path, self.path + ".old"):
            self._files().delete(self._path(p), True)


def slug(iri: str, limit: int = 120) -> str:
    """A file name for a graph."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", iri).strip("_")[:limit] or "graph"

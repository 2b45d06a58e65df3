"""Where a bundle lives: immutable revisions, the pointer to the current one, its index, and build caches.

Everything is below ``<folder>/.marlstone`` on a file system that all machines share; the current
revision's files also stand in the folder itself.  Tables are Parquet, so revisions and indexes are
read by the cluster; only pointers, logs and manifests, which are small, pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = ".marlstone"
FILES = "rel_path string, content binary"


class Store:
    """The state of one bundle folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = (folder if "://" in folder or folder.startswith("file:") else Path(folder).resolve().as_uri()).rstrip("/")
        self.meta = f"{self.folder}/{META}"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # -- small files and folders ------------------------------------------------------------------

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, path: Any) -> Any:
        return path.getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        path = self._path(name)
        return bool(self._fs(path).exists(path))

    def read_text(self, name: str) -> str | None:
        path = self._path(name)
        if not self._fs(path).exists(path):
            return None
        stream = self._fs(path).open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Replaces a small file at once: readers see the old text or the new one."""
        target, passing = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}")
        fs = self._fs(target)
        fs.mkdirs(target.getParent())
        stream = fs.create(passing, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        how = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(passing), context.makeQualified(target), how)

    def settle(self, passing: str, target: str) -> bool:
        """Moves a finished folder to its name; whoever comes second drops his copy."""
        a, b = self._path(passing), self._path(target)
        fs = self._fs(b)
        fs.mkdirs(b.getParent())
        if not fs.exists(b) and fs.rename(a, b) and not fs.exists(self._path(f"{target}/{a.getName()}")):
            return True
        for left in (a, self._path(f"{target}/{a.getName()}")):  # a rename into a folder that has just come
            fs.delete(left, True)
        return False

    # -- revisions --------------------------------------------------------------------------------

    def current(self) -> str | None:
        """Id of the current revision; None before the first."""
        return (self.read_text(f"{self.meta}/current") or "").strip() or None

    def revisions(self) -> list[str]:
        from marlstone.sources.records import revisions

        return revisions(self.spark, f"{self.meta}/revisions")

    def tree(self, revision: str) -> DataFrame:
        """``(rel_path, content)`` of a published revision."""
        return self.spark.read.schema(FILES).parquet(f"{self.meta}/revisions/revision_id={revision}")

    def publish(self, files: DataFrame, revision: str) -> bool:
        """Keeps the tree as an immutable revision, makes it the current one, and puts its files into the folder.

        Publishing what is current again changes nothing; a revision is never written twice.
        """
        before = self.current()
        target = f"{self.meta}/revisions/revision_id={revision}"
        if not self.exists(target):
            passing = f"{self.meta}/passing/{uuid.uuid4().hex}"
            files.select("rel_path", "content").write.parquet(passing)
            self.settle(passing, target)
        self.write_text(f"{self.meta}/current", revision + "\n")
        self.materialize(revision, before)
        return before != revision

    def materialize(self, revision: str, before: str | None = None) -> None:
        """Writes a revision's files into the folder, by the executors, and removes those only the last one had."""
        folder = self.folder

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = pafs.FileSystem.from_uri(folder)
            for b in batches:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    at = f"{base}/{path}"
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    passing = f"{at}.{uuid.uuid4().hex}"
                    with fs.open_output_stream(passing) as out:
                        out.write(content)
                    fs.move(passing, at)
                yield pa.RecordBatch.from_arrays([b.column(0)], names=["rel_path"])

        self.tree(revision).mapInArrow(write, "rel_path string").write.format("noop").mode("overwrite").save()
        if before and before != revision and self.exists(f"{self.meta}/revisions/revision_id={before}"):
            stale = self.tree(before).select("rel_path").subtract(self.tree(revision).select("rel_path"))
            for r in stale.toLocalIterator():
                path = self._path(f"{self.folder}/{r['rel_path']}")
                self._fs(path).delete(path, False)

    # -- build caches -----------------------------------------------------------------------------

    def cache(self, name: str) -> DataFrame:
        """``(key, value)`` of a build cache; the first value of a key counts."""
        path = f"{self.meta}/cache/{name}"
        if not self.exists(path):
            return self.spark.createDataFrame([], "key string, value string")
        return self.spark.read.schema("key string, value string, at timestamp").parquet(path).groupBy("key").agg(F.min_by("value", "at").alias("value"))

    def remember(self, name: str, rows: DataFrame) -> None:
        """Adds ``rows(key, value)`` whose key the cache lacks."""
        new = rows.where("key is not null and value is not null").select("key", "value").dropDuplicates(["key"]).join(self.cache(name).select("key"), "key", "left_anti")
        new.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.meta}/cache/{name}")

    def log_run(self, revision: str, report: dict[str, Any]) -> None:
        self.write_text(f"{self.meta}/runs/{revision}.json", json.dumps(report, indent=2, default=str) + "\n")

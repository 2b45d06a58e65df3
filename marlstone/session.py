"""Session settings, table loading and shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "marlstone", **conf: object) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI on; ``conf`` overrides (dots as ``__``)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily read one Parquet table of a data directory (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the session is a local one (tests, a laptop) a local folder
    is made up; on a cluster its absence is an error, for no other machine would see that folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/")


#: Paths that this process made below the shared folder.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _SCRATCH.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def drop_scratch(spark: SparkSession, start: int = 0, keep_last: int = 0) -> int:
    """Deletes the tables written since there were ``start`` of them, but the ``keep_last`` newest.

    Frames that still read them fail afterwards.
    """
    jvm, end = spark.sparkContext._jvm, len(_SCRATCH) - keep_last
    old = _SCRATCH[start:end]
    for name in old:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _SCRATCH[start:end]
    return len(old)


def scratch_count() -> int:
    """How many tables are there now."""
    return len(_SCRATCH)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return a frame over the written table.

    Cuts lineage: what reads the result never recomputes ``df``, and the files survive
    the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes the shuffle files of a write or an action once it is done, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)

"""Incremental acquisition: new files stream in, keyed tables take each content once.

A file stream with a checkpoint resumes where it stopped.  Every micro-batch is merged by content
key, so a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CONTENT = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """Files of a folder as they appear: ``(path, content, source_hash)``."""
    raw = spark.readStream.format("binaryFile").schema(CONTENT).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return raw.select("path", "content", F.sha2("content", 256).alias("source_hash"))


def upsert(stream: DataFrame, target: str, checkpoint: str, key: str = "source_hash") -> StreamingQuery:
    """Appends rows whose key the Parquet table at ``target`` lacks; runs over what is there, then stops."""

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key])
        try:
            known = batch.sparkSession.read.parquet(target).select(key)
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(known, key, "left_anti")
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(files: DataFrame, folder: str, revision: str) -> bool:
    """Writes a revision as an immutable partition; False if it is there already."""
    spark = files.sparkSession
    path = f"{folder}/revision_id={revision}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        return False
    passing = jvm.org.apache.hadoop.fs.Path(f"{folder}/_passing-{revision}")
    files.write.mode("overwrite").parquet(passing.toString())
    return bool(fs.rename(passing, target))


def new_items(items: DataFrame, after: str | None, uri: str = "uri") -> DataFrame:
    """Items behind the last one taken, in order of their URI."""
    return items if after is None else items.where(F.col(uri) > after)


#: Keeps keyed state on disk, so that it may outgrow an executor's memory.
STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rollup(events: DataFrame, time: str, key: str, groups: list[str], value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(groups.., start, n, total)`` of each time window of a stream, once it is complete.

    A key that came before is left out while its first row isn't older than ``late``; a window is complete
    when something came that is ``late`` past its end, and rows that come for it afterwards are left out.
    Seen keys and open windows are state, kept in the checkpoint and dropped by the watermark.
    """
    rows = events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    sums = rows.groupBy(F.window(time, window).alias("w"), *groups).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return sums.select(*groups, F.col("w.start").alias("start"), "n", "total")


def run_rollup(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, files_per_batch: int = 100, partitions: int = 16, **how: object) -> DataFrame:
    """Takes the Parquet files that are new at ``source`` through ``rollup`` and returns all that ``target`` has.

    A run goes on where the last one ended, a killed one is finished by the next; files are written once.
    """
    folder, _, name = source.rstrip("/").rpartition("/")
    names = {"spark.sql.streaming.stateStore.providerClass": STATE, "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{{{name}}}")  # a pattern may name one file
        out = rollup(stream, **how)
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(out.schema).parquet(target)

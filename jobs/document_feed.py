"""Feeds new documents of a growing corpus into the passages that retrieval reads; incremental.

A knowledge base is asked for passages, not for files, and most of what a source delivers again is
known already.  Each run takes the files that came since the last one and keeps two tables.

* ``items``: a row for each document that came, with the hash of its text; by language.
* ``passages``: the passages of each text, once for each hash however many documents share it and
  whichever came first; by the first two digits of the hash.

Two streams read the same files with a checkpoint each.  Known hashes are the state of the second
one, in its checkpoint: a run looks up only the hashes that came and never reads its own output.  Spark's
file sink writes a batch's files once, so a run that is killed is finished by the next one and a run
without new files changes nothing.  The state grows with the distinct texts, by a hash each, and lies
on disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobs._run import command, log, settings
from marlstone.functions.text import tokens
from marlstone.operators.chunks import chunks

DEFAULTS: dict[str, object] = {"documents": "", "output": "", "checkpoint": "", "files_per_batch": 1000, "passage_chars": 500, "state_partitions": 64}
#: The written tables; partitions come last.
ITEMS = "doc_id long, source string, source_hash string, n_chars long, lang string"
PASSAGES = "source_hash string, seq long, passage string, n_tokens long, shard string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def items_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, lang, source_hash, n_chars)``; a null text has no hash, a null language is ``und``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce("lang", F.lit("und")).alias("lang"), F.sha2("text", 256).alias("source_hash"), F.length("text").cast("long").alias("n_chars"))


def passages_of(texts: DataFrame, chars: int) -> DataFrame:
    """``(source_hash, seq, passage, n_tokens, shard)`` of ``texts(source_hash, text)``: lines packed into passages of ``chars`` characters."""
    rows = chunks(texts, "source_hash", "text", "\n", chars)
    return rows.select("source_hash", F.col("seq").cast("long").alias("seq"), F.col("chunk").alias("passage"), F.size(tokens("chunk")).cast("long").alias("n_tokens"), F.substring("source_hash", 1, 2).alias("shard"))


def _told(name: str, query: StreamingQuery) -> None:
    """Waits for a stream to end and logs what each batch read and wrote."""
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    for p in batches:
        seen = {k: v["rows"] for k, v in p["observedMetrics"].items()}
        log.info("%s: batch %s read %s rows, %s", name, p["batchId"], p["numInputRows"], ", ".join(f"{k} {v}" for k, v in seen.items()))
    if not batches:
        log.info("%s: nothing new", name)


def feed(spark: SparkSession, documents: str, output: str, checkpoint: str, files_per_batch: int = 1000, passage_chars: int = 500, state_partitions: int = 64) -> None:
    """One run over what is new in the Parquet folder or file ``documents(doc_id, text, lang, source)``.

    ``checkpoint`` belongs to ``output``.  The number of state partitions is fixed by the first run.
    """
    schema = spark.read.parquet(documents).select("doc_id", "text", "lang", "source").schema
    count = F.count(F.lit(1)).alias("rows")
    folder, _, name = documents.rstrip("/").rpartition("/")
    pattern = f"{folder}/{{{name}}}"  # a pattern may name a single file, a plain path of a stream may not

    def new_files() -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)

    def start(rows: DataFrame, name: str, by: str) -> None:
        sink = rows.observe(f"{name} written", count).writeStream.format("parquet").partitionBy(by).outputMode("append")
        _told(name, sink.option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start(f"{output}/{name}"))

    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__shuffle__partitions=str(state_partitions)):
        start(items_of(new_files()), "items", "lang")
        texts = new_files().where("text is not null").select(F.sha2("text", 256).alias("source_hash"), "text").dropDuplicates(["source_hash"])
        start(passages_of(texts.observe("new texts", count), passage_chars), "passages", "shard")


def output_of(spark: SparkSession, output: str) -> DataFrame:
    """``(doc_id, source, lang, source_hash, n_chars, seq, passage, n_tokens)``: every item with the passages of its text; one without a passage has nulls."""
    items, passages = spark.read.schema(ITEMS).parquet(f"{output}/items"), spark.read.schema(PASSAGES).parquet(f"{output}/passages").drop("shard")
    return items.join(passages, "source_hash", "left").select("doc_id", "source", "lang", "source_hash", "n_chars", "seq", "passage", "n_tokens")


if __name__ == "__main__":
    command("document-feed", DEFAULTS, feed)

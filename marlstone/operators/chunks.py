"""Chunking, hashed bag-of-words embedding, and exact cosine search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import strip, tokens
from marlstone.session import materialize

CHUNK, DIM, TOP = 500, 256, 4


def hard_split(x: Column, size: int = CHUNK) -> Column:
    """Pieces of ``size`` characters."""
    n = F.floor((F.greatest(F.length(x), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(x, i * size + 1, F.lit(size)))


def chunks(df: DataFrame, key: str, text: str, delimiter: str = "\n\n", size: int = CHUNK) -> DataFrame:
    """``(key, seq, chunk)``: paragraphs packed greedily up to ``size`` characters, joined by a newline.

    Longer paragraphs are split hard first; blank ones don't count.  Null, empty and blank texts give
    no chunk; repeated rows each give theirs; an empty table gives none.
    """
    paras = F.filter(F.transform(F.split(F.col(text), delimiter), lambda p: strip(p)), lambda p: p != "")
    pieces = F.flatten(F.transform(paras, lambda p: hard_split(p, size)))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(a: Column, p: Column) -> Column:
        full = (a["buf"] != "") & (F.length(a["buf"]) + 1 + F.length(p) > size)
        return F.struct(
            F.when(full, F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"]).alias("out"),
            F.when(full | (a["buf"] == ""), p).otherwise(F.concat_ws("\n", a["buf"], p)).alias("buf"),
        )

    end = lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"])
    return df.select(key, F.posexplode(F.aggregate(pieces, empty, step, end)).alias("seq", "chunk"))


def bucket(token: Column) -> Column:
    """Embedding bucket of a token: the first eight hexadecimal digits of its SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long"), F.lit(DIM)).cast("int")


def hashed_bow(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, bucket, weight)``: unit vectors of distinct-token counts, as sparse rows; texts without a token have none, keys must be unique."""
    counts = df.select(key, F.explode(F.transform(F.array_distinct(tokens(text)), bucket)).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)).cast("double"))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def dense(rows: DataFrame, key: str) -> DataFrame:
    """``(key, vector)`` of sparse ``rows(key, bucket, weight)``; at most ``DIM`` rows come together, which are put into their places a batch at a time."""
    cells = rows.groupBy(key).agg(F.collect_list("bucket").alias("buckets"), F.collect_list("weight").alias("weights"))
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, size = b.column(1).flatten().to_numpy(), np.diff(b.column(1).offsets.to_numpy())
            flat = np.zeros(len(b) * DIM)
            flat[np.repeat(np.arange(len(b)), size) * DIM + at] = b.column(2).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * DIM, flat)], names=[key, "vector"])

    return cells.mapInArrow(run, f"`{key}` {kind}, vector array<double>")


def sparse_topk(queries: DataFrame, index: DataFrame, qid: str, key: str, top: int = TOP) -> DataFrame:
    """``(qid, key, score, rank)``: the greatest positive dot products of sparse unit vectors, ties by key.

    Nearly every text has a word in nearly every bucket, so a join on buckets would meet all pairs of
    rows; the vectors are multiplied whole instead.
    """
    return vector_topk(dense(queries, qid), dense(index, key), qid, key, "vector", top)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """``(group, centroid)``: the unit vector of each group's mean; null vectors don't count."""
    parts = vectors.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    means = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))  # one entry a dimension
    return means.select(group, normalize(F.transform("x", lambda x: x["v"])).alias("centroid"))


#: Query vectors of one block.
QUERY_BLOCK = 1024
#: Vectors of the index that are held against a block at once; Spark's batches hold up to ten thousand.
SLICE = 512


def vector_topk(queries: DataFrame, vectors: DataFrame, qid: str, key: str, vector: str, top: int = TOP) -> DataFrame:
    """``(qid, key, score, rank)``: exact cosine search of a stated query set (vectors are unit length).

    Queries go out in blocks of about ``QUERY_BLOCK``: a block is one row of packed vectors, and every block
    meets every part of the index, which are dealt to tasks by a shuffle of parts and blocks.  So one plan
    does for any number of queries, no task holds more than a block and a batch, and a task gives back
    only its best ``top`` for each query of its block.  Null vectors match nothing; an empty side gives no rows.
    """
    kinds = dict(queries.dtypes) | {f"_{key}": dict(vectors.dtypes)[key]}
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(qid).alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    index = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    schema = f"qid {kinds[qid]}, key {kinds[f'_{key}']}, score double"
    if blocks == 1:
        found = index.mapInArrow(_best_of(asked.select("qid", "v").toArrow(), top, schema), schema)  # one block
    else:
        # a row of either side for each block and part; those of the index follow the block's queries
        parts = index.sparkSession.sparkContext.defaultParallelism
        dealt = index.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        spread = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        rows = spread.select("block", "part", F.lit(0).alias("side"), "qid", none("key", kinds[f"_{key}"]), "v").unionAll(dealt.select("block", "part", F.lit(1).alias("side"), none("qid", kinds[qid]), "key", "v"))
        rows = rows.repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "side")
        found = rows.mapInArrow(_best_of_blocks(top, schema), schema)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("qid").alias(qid), F.col("key").alias(key), "score", "rank")


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists."""
    return column.flatten().to_numpy().reshape(len(column), -1)


class _Best:
    """The best ``top`` keys of each of a block's query vectors so far."""

    def __init__(self, ids: list, vectors: np.ndarray, top: int):
        self.ids, self.vectors, self.top = ids, vectors, top
        self.best: list[list[tuple]] = [[] for _ in ids]
        self.bar = np.zeros(len(ids))

    def add(self, keys: list, vectors: np.ndarray) -> None:
        for at in range(0, len(keys), SLICE):
            self._add(keys[at : at + SLICE], vectors[at : at + SLICE])

    def _add(self, keys: list, vectors: np.ndarray) -> None:
        scores = np.round(vectors @ self.vectors.T, 6)
        # what a query holds already bars anything lower; equal scores stay in the race by key
        at, col = np.nonzero((scores >= self.bar) & (scores > 0))
        order = np.argsort(col, kind="stable")
        at, col = at[order], col[order]
        for a, z in zip(first := np.flatnonzero(np.diff(col, prepend=-1)), np.append(first[1:], len(col))):
            c, rows = col[a], at[a:z]
            values = scores[rows, c]
            if len(rows) > self.top:  # only those that reach the top-th value
                rows = rows[values >= np.partition(values, -self.top)[-self.top]]
            held = heapq.nsmallest(self.top, [*self.best[c], *((-scores[i, c], keys[i]) for i in rows)])
            self.best[c] = held
            if len(held) == self.top:
                self.bar[c] = -held[-1][0]

    def batch(self, arrow: pa.Schema) -> pa.RecordBatch:
        out = [(i, key, -s) for i, held in zip(self.ids, self.best) for s, key in held]
        cols = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _best_of(asked: pa.Table, top: int, schema: str):
    """A task's best rows of ``(key, v)`` batches for each of the ``asked(qid, v)`` vectors."""
    ids, q = asked["qid"].to_pylist(), _vectors(asked["v"].combine_chunks()) if len(asked) else None
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Best(ids, q, top)
        for b in batches:
            if len(b) and ids:
                held.add(b.column(0).to_pylist(), _vectors(b.column(1)))
        yield held.batch(arrow)

    return run


def _best_of_blocks(top: int, schema: str):
    """The same for rows ``(block, part, side, qid, key, v)`` sorted by the first three: a block's queries, then a part of the index."""
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, held = None, [], None
        for b in batches:
            if not len(b):
                continue
            place = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.append(np.flatnonzero(np.any(np.diff(place, axis=0, prepend=place[:1] - 1), axis=1)), len(b))
            for a, z in zip(cuts[:-1], cuts[1:]):
                block, part, side = place[a]
                if (block, part) != at:
                    if held is not None:
                        yield held.batch(arrow)
                    at, asked, held = (block, part), [], None
                piece = b.slice(a, z - a)
                if side == 0:
                    asked.append(piece)
                elif asked:
                    if held is None:
                        ids = [i for p in asked for i in p.column(3).to_pylist()]
                        held = _Best(ids, np.concatenate([_vectors(p.column(5)) for p in asked]), top)
                    held.add(piece.column(4).to_pylist(), _vectors(piece.column(5)))
        if held is not None:
            yield held.batch(arrow)

    return run


def budget_prefix(df: DataFrame, group: str, order: list[str], cost: Column, limit: int) -> DataFrame:
    """Rows of each group up to, and without, the first whose running cost exceeds the limit, with ``running``; a null cost counts nothing, none is negative.

    Rows are dealt by ranges and written.  The sums of a group's ranges say which of them the limit lets
    in, and only those are summed row by row, each range apart: a group of any size has no task to itself.
    """
    dealt = materialize(df.withColumn("_cost", F.coalesce(cost.cast("long"), F.lit(0))).repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.sum("_cost").alias("_sum"))
    earlier = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).where(F.col("_before") <= limit)
    rows = dealt.join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    own = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("running", F.col("_before") + F.sum("_cost").over(own)).where(F.col("running") <= limit)
    return rows.drop("_cost", "_range", "_group", "_of", "_sum", "_before")

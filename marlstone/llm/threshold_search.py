"""Ranked lexical search by Fagin's threshold algorithm.

Questions are taken in blocks of bounded size.  Each block reads the documents once and writes the
forward index of its terms; corpus statistics are counted over all of it.  The index is partitioned by
documents: a task turns batch after batch of it into impact-sorted lists, reads each question's lists
round-robin from the top, looks a document up in the forward index when it is first met, and stops
once the threshold, the sum of the impacts last read, lies strictly below the question's k-th score.
That score is carried on from batch to batch.  A task gives back its best k for each question, so
nothing but those is shuffled, and no term's list comes together anywhere, however common it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm._common import bounded_batches, gathered, give_back, map_batches
from marlstone.session import materialize, table

TOP = 10
#: Questions and distinct terms of a block: what a task holds of the questions.
MOST_QUESTIONS, MOST_TERMS = 1024, 200_000
#: Entries of each list read at first; then as many again as were read so far.
FIRST = 16

#: ASCII letters in lower case and digits stay, other ASCII parts terms; bytes of other characters stay.
_PARTS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, repeats included; a null or empty text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PARTS).split()


@dataclass
class Questions:
    """A block of questions: their ids, and numbers and counts of their terms in ``lookup``."""

    ids: list
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    lookup: dict[bytes, int]


def question_blocks(items: DataFrame, item_id: str, text: str, most: int = MOST_QUESTIONS, most_terms: int = MOST_TERMS) -> Iterator[Questions]:
    """The rows of a table in blocks of at most ``most`` questions; one that brings more than ``most_terms`` terms ends its block."""
    block = Questions([], [], [], {})
    for row in items.select(item_id, text).toLocalIterator():
        numbers = [block.lookup.setdefault(t, len(block.lookup)) for t in terms(row[1])]
        ids, counts = np.unique(np.array(numbers, np.int64), return_counts=True)
        block.ids.append(row[0]), block.terms.append(ids), block.counts.append(counts)
        if len(block.ids) >= most or len(block.lookup) >= most_terms:
            yield block
            block = Questions([], [], [], {})
    if block.ids:
        yield block


def forward_index(docs: DataFrame, lookup: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, term, tf)`` of ``docs(doc_id, text)`` that have a term: how many they have, and which of ``lookup`` how often."""

    def run(cols: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {"doc_id": [], "n": [], "term": [], "tf": []}
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            if found := terms(text):
                ids = np.fromiter(map(lookup.get, found, repeat(-1)), np.int64, len(found))
                term, tf = np.unique(ids[ids >= 0], return_counts=True)
                for name, value in zip(out, (doc_id, len(found), term.astype(np.int32), tf)):
                    out[name].append(value)
        return out

    return map_batches(docs, run, "doc_id long, n long, term array<int>, tf array<long>")


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, in 64-bit integers."""
    m = 100 - 75 + (75 * length * n_docs) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Lists:
    """Impact-sorted lists and forward index of a batch of documents."""

    def __init__(self, start: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.start, self.term, self.impact, self.n = start, term, impact, len(start) - 1
        owner = np.repeat(np.arange(self.n), np.diff(start))
        order = np.lexsort((-impact, term))
        self.sorted_doc, self.sorted_impact = owner[order], impact[order]
        self.list_start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.weight = np.zeros(n_terms, np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, from the forward index, for the terms weighted in ``weight``."""
        size = self.start[docs + 1] - self.start[docs]
        at = np.repeat(self.start[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        parts = self.weight[self.term[at]] * self.impact[at]
        return np.add.reduceat(parts, np.cumsum(size) - size) if len(docs) else parts

    def search(self, term: np.ndarray, count: np.ndarray, bar: int, full: bool, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the best k, their scores, and how many were looked up.

        ``bar`` is the k-th score known before (if ``full``): only documents that reach it are of interest.
        """
        first, end = self.list_start[term], self.list_start[term + 1]
        seen, depth, step = np.zeros(self.n, bool), 0, FIRST
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.weight[term] = count
        looked = 0
        while True:
            size = np.clip(end - first - depth, 0, step)
            at = np.repeat(first + depth - (np.cumsum(size) - size), size) + np.arange(size.sum())
            new = np.unique(self.sorted_doc[at])
            new = new[~seen[new]]
            seen[new] = True
            looked += len(new)
            docs, scores = np.concatenate((docs, new)), np.concatenate((scores, self.scores(new)))
            if len(scores) >= k:
                own = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= own  # equal scores stay in the race by doc_id
                docs, scores = docs[keep], scores[keep]
                bar, full = (max(bar, int(own)) if full else int(own)), True
            depth += step
            step = depth
            going = first + depth < end
            threshold = int((count[going] * self.sorted_impact[first[going] + depth - 1]).sum())
            if not going.any() or (full and threshold < bar):
                break
        self.weight[term] = 0
        return docs, scores, looked


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the best ``top`` documents of every item with a score above 0; equal scores by doc_id.

    Null, empty and termless texts, of documents or items, match nothing.  Every row is a document: rows
    repeated under one doc_id are ranked each; a null doc_id comes after the others of its score.  Items
    repeated under one id are ranked each.  Long texts are read whole; an empty side gives no rows.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = dict(items.dtypes)[item_id]
    found = [_ranked(source, block, kind, top) for block in question_blocks(items, item_id, item_text)]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def _ranked(docs: DataFrame, block: Questions, kind: str, top: int) -> DataFrame:
    """``search`` for one block of questions."""
    spark = docs.sparkSession
    forward = materialize(forward_index(docs, block.lookup), "forward")
    n_docs, total = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = forward.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # the block's terms
    df = np.zeros(len(block.lookup), np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    asked = [(i, t, c) for i, (t, c) in enumerate(zip(block.terms, block.counts)) if len(t)]
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # of each question, rows of score, whether the id is null, id
        for b in gathered(batches):
            if not len(b):
                continue
            term, tf = b.column(2), b.column(3)
            start = term.offsets.to_numpy().astype(np.int64)
            start, at = start - start[0], term.flatten().to_numpy()
            n = np.repeat(b.column(1).to_numpy(), np.diff(start))
            lists = Lists(start, at, impacts(weight[at], tf.flatten().to_numpy(), n, n_docs, total), len(weight))
            ids, nulls = b.column(0).fill_null(0).to_numpy(), np.asarray(b.column(0).is_null())
            for i, t, c in asked:
                held = best.get(i)
                full = held is not None and len(held) == top
                rows, scores, _ = lists.search(t, c, int(held[-1, 0]) if full else 0, full, top)
                new = np.stack((scores, nulls[rows], ids[rows]), axis=1)[scores > 0]
                if len(new):
                    new = new if held is None else np.concatenate((held, new))
                    best[i] = new[np.lexsort((new[:, 2], new[:, 1], -new[:, 0]))[:top]]
        for i, rows in best.items():
            ids = pa.array(rows[:, 2], mask=rows[:, 1].astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i), pa.int32()), ids, pa.array(rows[:, 0])], schema=schema)
        give_back()

    bounded_batches(spark)
    every = forward.select("doc_id", "n", "term", "tf").mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark passage; nulls, empty texts, repeats and ties as in ``search``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order.  Each model is a logistic regression over words and word
beginnings that also sees the probabilities of all earlier categories.  In training those come from
models that had not seen the row (out-of-fold predictions), so later models learn from the kind of
probability they will meet.

Learning takes a bounded hash sample of labelled rows for each category and class; candidate terms
are counted over all of that sample on the executors.  Every row of the table is scored, whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marlstone.llm._common import bounded_batches, map_batches
from marlstone.session import materialize, table

#: Labelled rows that learning takes for each category and class, about; terms kept; folds.
SAMPLE, TERMS, FOLDS = 4000, 4000, 5
#: A term must occur in this many sampled documents.
MIN_DOCS = 5
#: Least log-likelihood ratio statistic of a term: chance hardly gives one among 100,000 terms that much.
LEAST_G = 15.0
#: Least absolute log odds of a term: a difference in length or topic alone hardly gives that much.
LEAST_ODDS = 1.5
PREFIXES = (4, 5)
_WORD = re.compile(r"\w+|[^\w\s]+")


def terms(text: str | None) -> set[str]:
    """Lower-cased words and runs of signs, and the first four and five characters of longer ones (marked with a blank)."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({w[:n] + " " for w in words if len(w) > n} for n in PREFIXES))


class Linear:
    """Logistic regression on sparse presence features (those of ``mask``) and a few dense ones."""

    def __init__(self, mask: np.ndarray, n_dense: int):
        self.mask, self.w, self.v, self.b = mask, np.zeros(len(mask)), np.zeros(n_dense), 0.0

    def margin(self, rows: "Rows", dense: np.ndarray) -> np.ndarray:
        return rows.sum(self.w) + dense @ self.v + self.b

    def fit(self, rows: "Rows", dense: np.ndarray, y: np.ndarray, decay: float = 1e-4, rounds: int = 400, rate: float = 0.1) -> "Linear":
        """Adam on the class-balanced loss; deterministic."""
        n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
        weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
        state = [np.zeros(len(self.w) + len(self.v) + 1) for _ in range(2)]
        for step in range(1, rounds + 1):
            error = weight * (expit(self.margin(rows, dense)) - y)
            grad = np.concatenate((rows.spread(error, len(self.w)) * self.mask + decay * self.w / 10, dense.T @ error + decay * self.v / 10, [error.sum()]))
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.999 * state[1] + 0.001 * grad**2
            move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
            self.w -= move[: len(self.w)]
            self.v -= move[len(self.w) : -1]
            self.b -= move[-1]
        return self


class Rows:
    """Feature numbers of many rows, flat."""

    def __init__(self, lists: list[list[int]]):
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.at = np.repeat(np.arange(len(lists)), self.sizes)
        self.ids = np.fromiter((i for x in lists for i in x), np.int64, int(self.sizes.sum()))

    def sum(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.ids], len(self.sizes)) if len(w) else np.zeros(len(self.sizes))

    def spread(self, e: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.ids, e[self.at], n) if n else np.zeros(0)


def expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Chain:
    """One model a category, each fed by the probabilities of the categories before it."""

    def __init__(self, categories: list[str], chosen: list[list[str]]):
        self.categories = categories
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*chosen)))}
        self.masks = [np.isin(np.arange(len(self.vocabulary)), [self.vocabulary[t] for t in c]) for c in chosen]
        self.models: list[Linear] = []
        self.thresholds: list[float] = []

    def features(self, text: str | None) -> list[int]:
        return sorted(self.vocabulary[t] for t in terms(text) & self.vocabulary.keys())

    def fit(self, lists: list[list[int]], labels: np.ndarray, fold: np.ndarray) -> "Chain":
        """``labels[row, category]`` is 0, 1 or -1 for unknown; ``fold`` numbers each row's fold."""
        earlier = np.zeros((len(lists), 0))
        for k in range(len(self.categories)):
            known, out = labels[:, k] >= 0, np.zeros(len(lists))
            for f in range(FOLDS):
                learn, rest = np.flatnonzero(known & (fold != f)), np.flatnonzero(fold == f)
                model = self._new(k).fit(Rows([lists[i] for i in learn]), earlier[learn], labels[learn, k].astype(float))
                out[rest] = expit(model.margin(Rows([lists[i] for i in rest]), earlier[rest]))
            learn = np.flatnonzero(known)
            self.models.append(self._new(k).fit(Rows([lists[i] for i in learn]), earlier[learn], labels[learn, k].astype(float)))
            self.thresholds.append(best_threshold(out[known], labels[known, k]))
            earlier = np.column_stack((earlier, out))
        return self

    def _new(self, k: int) -> Linear:
        return Linear(self.masks[k], k)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each category for each text; a text without a known term gets the models' base rate."""
        rows = Rows([self.features(t) for t in texts])
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.column_stack((out, expit(model.margin(rows, out))))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest run of thresholds with the best F1 on out-of-fold predictions."""
    if not (y == 1).any() or not (y == 0).any():
        return 0.5
    grid = np.linspace(0.02, 0.98, 97)
    tp = np.array([((p >= t) & (y == 1)).sum() for t in grid])
    fp = np.array([((p >= t) & (y == 0)).sum() for t in grid])
    f1 = 2 * tp / (tp + fp + (y == 1).sum())
    good = grid[f1 >= f1.max() - 1e-12]
    return float(np.median(good))


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], size: int = SAMPLE) -> DataFrame:
    """``(doc_id, text, categories.., fold)`` of about ``size`` labelled rows at most for each category and class.

    A document labelled twice counts as positive if any of its labels says so.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in categories])
    n = known.agg(*[F.count_if(F.col(c) == v).alias(f"{c}{v}") for c in categories for v in (0, 1)]).first()
    unit = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # a row stays if it is drawn for any of its classes
    draws = [(F.col(c) == v) & (unit < min(1.0, size / max(1, n[f"{c}{v}"]))) for c in categories for v in (0, 1)]
    drawn = draws[0]
    for d in draws[1:]:
        drawn = drawn | d
    picked = known.where(F.coalesce(drawn, F.lit(False))).select("doc_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in categories])
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")  # equal texts share a fold
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("fold", fold)


def pick_terms(sample: DataFrame, categories: list[str], size: int = TERMS) -> list[list[str]]:
    """For each category the terms whose presence best tells its classes apart, by the log-likelihood ratio statistic."""

    def run(cols: dict[str, list]) -> dict[str, object]:
        found: dict[str, np.ndarray] = {}
        marks = np.array([[cols[c][i] == v for c in categories for v in (0, 1)] for i in range(len(cols["text"]))], np.int64)
        for text, mark in zip(cols["text"], marks):
            for t in terms(text):
                if t in found:
                    found[t] += mark
                else:
                    found[t] = mark.copy()
        counts = np.array(list(found.values()), np.int64).reshape(len(found), -1)
        return {"term": list(found)} | {f"n{k}": counts[:, k] for k in range(counts.shape[1])} if found else {"term": []} | {f"n{k}": [] for k in range(2 * len(categories))}

    names = [f"n{k}" for k in range(2 * len(categories))]
    counts = map_batches(sample.select("text", *categories), run, "term string, " + ", ".join(f"{n} long" for n in names))
    counts = counts.groupBy("term").agg(*[F.sum(n).alias(n) for n in names])
    counts = materialize(counts.where(" or ".join(f"n{2 * k} + n{2 * k + 1} >= {MIN_DOCS}" for k in range(len(categories)))), "terms")
    total = sample.agg(*[F.count_if(F.col(c) == v).alias(f"{c}{v}") for c in categories for v in (0, 1)]).first()
    scores = []
    for k, c in enumerate(categories):
        n1, n0 = float(total[f"{c}1"]), float(total[f"{c}0"])
        pos, neg = F.col(f"n{2 * k + 1}").cast("double"), F.col(f"n{2 * k}").cast("double")
        share1, share0 = (pos + neg) * F.lit(n1 / max(1.0, n1 + n0)), (pos + neg) * F.lit(n0 / max(1.0, n1 + n0))
        part = lambda seen, due: F.when((seen > 0) & (due > 0), seen * F.log(seen / due)).otherwise(F.lit(0.0))
        g = 2 * (part(pos, share1) + part(neg, share0) + part(F.lit(n1) - pos, F.lit(n1) - share1) + part(F.lit(n0) - neg, F.lit(n0) - share0))
        odds = F.log((pos + 0.5) / F.lit(n1 + 1)) - F.log((neg + 0.5) / F.lit(n0 + 1))
        scores.append(F.when(F.abs(odds) >= LEAST_ODDS, g).otherwise(F.lit(0.0)))
    named = [x.alias(f"s{k}") for k, x in enumerate(scores)]
    out = []
    for k in range(len(categories)):
        best = counts.select("term", *named).where(F.col(f"s{k}") >= LEAST_G).orderBy(F.desc(f"s{k}"), "term").limit(size)
        out.append([r["term"] for r in best.select("term").collect()])
    return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str]) -> Chain:
    """A chain over the label columns ``categories``, in that order.

    ``docs(doc_id, text)`` are all documents.  Without a labelled row the chain gives probability
    one half and rejects nothing.
    """
    sample = materialize(labelled_sample(docs, labels, categories), "labelled")
    chain = Chain(categories, pick_terms(sample, categories))

    def run(cols: dict[str, list]) -> dict[str, object]:
        return {k: v for k, v in cols.items() if k != "text"} | {"features": [chain.features(t) for t in cols["text"]]}

    schema = "doc_id long, " + ", ".join(f"{c} int" for c in categories) + ", fold int, features array<int>"
    rows = map_batches(sample.select(F.col("doc_id").cast("long"), "text", *categories, "fold").select("doc_id", *categories, "fold", "text"), run, schema).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    if not rows:
        return chain
    return chain.fit([r["features"] for r in rows], np.array([[r[c] for c in categories] for r in rows]), np.array([r["fold"] for r in rows]))


def score(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``df``'s rows with ``probabilities`` (one a category) and ``rejected`` (by the last category).

    Null, empty and blank texts and those of signs alone have no word and are never rejected.  Texts of
    any length are read whole; repeated rows each give a row; an empty table gives none; other columns
    pass through under their own names.
    """
    @pandas_udf("array<double>")
    def predict(texts: pd.Series) -> pd.Series:
        return pd.Series(list(chain.predict(texts.tolist())))

    bounded_batches(df.sparkSession)
    if not chain.models:
        return df.withColumns({"probabilities": F.array(*[F.lit(0.5)] * len(chain.categories)), "rejected": F.lit(False)})
    rejected = F.coalesce(F.col(text).rlike(r"(?U)\w"), F.lit(False)) & (F.get("probabilities", F.lit(len(chain.models) - 1)) >= chain.thresholds[-1])
    return df.withColumn("probabilities", predict(text)).withColumn("rejected", rejected)


#: The label columns of the chain: poor quality first, whose probability toxicity then sees.
CATEGORIES = ["low_quality", "toxic"]


def chain_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Chain:
    """The chain over ``labels``: low quality (quality 0), then toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return train(docs, labels, CATEGORIES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each category and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), chain_of(spark, docs, sf_dir))
    named = [F.get("probabilities", F.lit(k)).alias(f"p_{c}") for k, c in enumerate(CATEGORIES)]
    return out.select("doc_id", *named, F.col("rejected").alias("toxic"))

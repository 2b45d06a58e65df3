"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle's out-of-place distance).

A profile lists a text's most frequent character n-grams (one to five letters, words padded
with one blank on each side) by falling frequency.  The distance of a document to a language is
the sum, over the document's n-grams, of how far each stands out of its place in the language's
profile; an n-gram absent from that profile costs the full profile length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm._common import map_batches
from marlstone.session import table

PROFILE = 400
N_MAX = 5
#: A text is unlike every language if its likeness is under this share of the likeness that all but this
#: quantile of the learned documents of its length class reach; a class is trusted from so many documents on.
LIKE_SHARE, LIKE_QUANTILE, LIKE_DOCUMENTS = 0.8, 0.01, 100
#: Length classes: the binary logarithm of the number of letters.
CLASSES = 32
#: N-grams that are held at a time, about.
KEYS = 1 << 22
#: Steps that likenesses are counted in.
STEPS = 10_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
    return out * np.arange(0x110000, dtype=np.uint32)


def letter_stream(text: str | None) -> np.ndarray:
    """Lower-cased letters with every run of other characters as one 0, and a 0 at both ends."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.zeros(len(codes) + 2, np.uint32)
    a[1:-1] = _letters()[codes]
    keep = a != 0
    keep[1:] |= a[:-1] != 0
    keep[0] = True
    return a[keep]


def ngram_keys(a: np.ndarray) -> np.ndarray:
    """64-bit keys of all n-grams of a letter stream; a blank may stand only at an n-gram's ends."""
    letters = a != 0
    key = a.astype(np.uint64)
    parts, inner, size = [key[letters]], None, len(a)
    for n in range(2, N_MAX + 1):
        if size < n:
            break
        key = (key[: size - n + 1] * _MUL) ^ (a[n - 1 :].astype(np.uint64) + np.uint64(n))
        if n == 2:
            parts.append(key)
        else:
            mid = letters[n - 2 : size - 1][: size - n + 1]
            inner = mid if inner is None else inner[: size - n + 1] & mid
            parts.append(key[inner])
    return np.concatenate(parts)


def top_keys(keys: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, most frequent first, ties by key."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    if len(first) > size:
        keep = counts >= np.partition(counts, -size)[-size]
        first, counts = first[keep], counts[keep]
    return keys[first[np.argsort(-counts, kind="stable")[:size]]]


class Profiles:
    """Rank-order profiles of several languages, held as one rank matrix over their joint n-grams."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(ranked)
        lists = [np.array(ranked[x], np.int64).view(np.uint64) for x in self.langs]
        self.vocab = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        self.ranks = np.full((len(lists), len(self.vocab)), -1, np.int64)
        for row, keys in zip(self.ranks, lists):
            row[np.searchsorted(self.vocab, keys)] = np.arange(len(keys))

    def distances(self, text: str | None) -> np.ndarray | None:
        """Out-of-place distance to each language over the largest possible one; None without a letter."""
        stream = letter_stream(text)
        if len(stream) < 2 or not len(self.langs):
            return None
        top = top_keys(ngram_keys(stream), self.size)
        at = np.searchsorted(self.vocab, top)
        at[at == len(self.vocab)] = 0
        hit = self.vocab[at] == top
        ranks = self.ranks[:, at[hit]]
        gap = np.minimum(np.abs(ranks - np.flatnonzero(hit)), self.size)
        gap[ranks < 0] = self.size
        return (gap.sum(1) + self.size * int((~hit).sum())) / (self.size * len(top))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language (ties by name) and its likeness, 1 less the distance."""
        d = self.distances(text)
        if d is None:
            return "und", 0.0
        best = int(np.argmin(d))
        return self.langs[best], float(1 - d[best])


def length_class(text: str | None) -> int:
    """Binary logarithm of the number of letters, rounded down; 0 without a letter."""
    return min(max(int(np.count_nonzero(letter_stream(text))).bit_length() - 1, 0), CLASSES - 1)


def learn_floors(train: DataFrame, profiles: Profiles) -> list[float]:
    """For each length class the least likeness of a text in one of the languages, from all documents of a language.

    Likenesses are counted in ten-thousandths, so percentiles rest on a bounded number of rows.  Classes
    of too few documents take the lowest floor of the others; if all are such, all take the floor of the
    documents together.
    """
    if not profiles.langs:
        return [0.0] * CLASSES

    def run(cols: dict[str, list]) -> dict[str, object]:
        found = [profiles.predict(t) for t in cols["text"]]
        kept = [(length_class(t), score) for t, (lang, score) in zip(cols["text"], found) if lang != "und"]
        steps = np.unique(np.array([(c, round(s * STEPS)) for c, s in kept], np.int64).reshape(-1, 2), axis=0, return_counts=True)
        return {"class": steps[0][:, 0].astype(np.int32), "step": steps[0][:, 1], "n": steps[1].astype(np.int64)}

    steps = map_batches(train.where(F.col("lang").isNotNull()).select("text"), run, "class int, step long, n long").groupBy("class", "step").agg(F.sum("n").alias("n"))
    rows = steps.rollup("class").agg(F.sum("n").alias("n"), (F.percentile("step", F.lit(LIKE_QUANTILE), F.col("n")) / STEPS).alias("low")).collect()
    floor = {r["class"]: LIKE_SHARE * (r["low"] or 0.0) for r in rows if r["class"] is None or r["n"] >= LIKE_DOCUMENTS}
    together = floor.pop(None, 0.0)
    lowest = min(floor.values(), default=together)
    return [floor.get(c, lowest) for c in range(CLASSES)]


def learn_profiles(train: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles from all of ``train(text, lang)``.

    Rows without a language are left out.  N-gram counts are summed on the executors, some megabytes
    of text at a time before the shuffle; ``size`` n-grams for each language come to the driver.
    """

    def count(cols: dict[str, list]) -> dict[str, object]:
        out: tuple[list, list, list] = ([], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        for lang in sorted(set(cols["lang"])):
            held, size = [], 0
            for t in [*(t for t, x in zip(cols["text"], cols["lang"]) if x == lang), None]:
                if t is not None:
                    held.append(ngram_keys(letter_stream(t)))
                    size += len(held[-1])
                if held and (t is None or size >= KEYS):  # a null text, or the end, closes what is held
                    keys, counts = np.unique(np.concatenate(held), return_counts=True)
                    out[0].extend([lang] * len(keys))
                    out[1].append(keys.view(np.int64))
                    out[2].append(counts)
                    held, size = [], 0
        return {"lang": out[0], "key": np.concatenate(out[1]), "n": np.concatenate(out[2]).astype(np.int64)}

    counts = map_batches(train.where(F.col("lang").isNotNull()).select("lang", "text"), count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # the same tie order as top_keys, whose keys are unsigned
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("key") < 0, "key")
    rows = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    ranked: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        ranked.setdefault(r["lang"], []).append(r["key"])
    return Profiles(ranked, size)


def identify(df: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pass_text: bool = False, floors: list[float] | None = None) -> DataFrame:
    """``keep`` columns, the text if ``pass_text``, ``lang_pred`` and ``score`` for each row, and with ``floors`` whether it is ``known``.

    A text is known if it has a letter and its score reaches the floor of its length class.

    Null text, and text without a letter (numbers, emoji, empty), gives ``und`` with score 0.
    Whole texts of any length are read; repeated rows each get a row; an empty table gives none.
    Columns beyond ``keep`` and ``text`` are not read, so their names can't clash.
    """
    cols = {c: dict(df.dtypes)[c] for c in keep}
    source = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))

    def run(cols: dict[str, list]) -> dict[str, object]:
        found = [profiles.predict(t) for t in cols["text"]]
        out = cols | {"lang_pred": [x for x, _ in found], "score": [s for _, s in found]}
        if floors is not None:
            out["known"] = [x != "und" and s >= floors[length_class(t)] for t, (x, s) in zip(cols["text"], found)]
        return out

    schema = ", ".join(f"k{i} {t}" for i, t in enumerate(cols.values()))
    out = map_batches(source, run, f"{schema}, {'text string, ' * pass_text}lang_pred string, score double{', known boolean' * (floors is not None)}")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col("text").alias(text)] * pass_text, "lang_pred", "score", *["known"] * (floors is not None))


def held_out(doc_id: str = "doc_id"):
    """The documents that learning must not see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

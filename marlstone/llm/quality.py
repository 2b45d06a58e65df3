"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame expressions only.

Base rules count words, symbols, repeated lines and words inside repeated three-word windows.  The
verdict of the rest compares two multinomials over hashed one- and two-word grams: one of trusted
documents (the target), one of all documents.  A document's score is the mean over its grams of
log p_target / log p_corpus; every document is held against one fixed threshold, nothing is drawn.

The target is learned from one half of all trusted documents, dealt by a hash; the other half, which
the multinomial has not seen, sets the threshold: ``SPREAD`` times as far below the median as the first
percentile is.  Logarithms are rounded to ten-thousandths, so sums don't depend on order, and so are the
scores that percentiles are taken of: they are counted, so the driver and each task hold as many numbers
as there are different ones, not as there are documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.tokens import words
from marlstone.session import materialize, table

BUCKETS = 1 << 15
SPREAD = 2.5
UNIT = 10_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Bits of a window's place in the packed sort key; the others hold the window's hash.
PLACE = 24


def with_grams(df: DataFrame) -> DataFrame:
    """Adds ``h``, the hashes of the words, to ``df(.., words)``."""
    return df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def grams() -> Column:
    """Buckets of a document's one- and two-word grams, from ``h``."""
    two = F.transform(F.sequence(F.lit(2), F.size("h")), lambda i: _bucket(F.xxhash64(F.get("h", i - 2), F.get("h", i - 1))))
    return F.concat(F.transform("h", _bucket), F.when(F.size("h") > 1, two).otherwise(F.array().cast("array<int>")))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from ``h``: words covered by three-word windows that occur twice or more.

    Window hashes are packed with their places into one number, so one primitive sort brings equal
    windows together.  Where cutting the hash to fit would have merged two windows (their distinct
    counts then differ), full hashes are compared instead.
    """
    window = F.transform(F.sequence(F.lit(2), F.size("h") - 1), lambda i: F.xxhash64(F.get("h", i - 2), F.get("h", i - 1), F.get("h", i)))
    df = df.withColumn("t", F.when(F.size("h") > 2, window).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("different", F.size(F.array_distinct("t")))
    repeats = F.size("t") > F.col("different")
    cut = lambda x: F.shiftright(x, PLACE)
    packed = F.sort_array(F.transform("t", lambda x, i: F.shiftleft(cut(x), PLACE).bitwiseOR(i.cast("long"))))
    fits = (F.size("t") < (1 << PLACE)) & (F.size(F.array_distinct(F.transform("t", cut))) == F.col("different"))
    df = df.withColumn("s", F.when(repeats & fits, packed))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1))
    beside = lambda x, i: (cut(F.coalesce(F.get("s", i + 1), F.bitwise_not(x))) == cut(x)) | (cut(F.coalesce(F.get("s", i - 1), F.bitwise_not(x))) == cut(x))
    places = F.sort_array(F.transform(F.filter("s", beside), place))
    pairs = F.array_sort(F.transform("t", lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))))
    df = df.withColumn("u", F.when(repeats & F.col("s").isNull(), pairs))
    twin = lambda x, i: F.coalesce(F.get("u", i + 1)["x"] == x["x"], F.lit(False)) | F.coalesce(F.get("u", i - 1)["x"] == x["x"], F.lit(False))
    slow = F.sort_array(F.transform(F.filter("u", twin), lambda x: x["i"]))
    df = df.withColumn("p", F.coalesce(F.when(F.col("s").isNotNull(), places), F.when(F.col("u").isNotNull(), slow), F.array().cast("array<bigint>")))
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"))
    return df.withColumn("n_repeat_words", F.aggregate("p", start, step)["n"]).drop("t", "different", "s", "u", "p")


def base_counts(df: DataFrame) -> DataFrame:
    """Adds the base counts and ``base_failed`` to ``df(.., text, words, h)``."""
    n_words = F.size("words")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({
        "n_words": n_words.cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long"),
        "lines": lines,
    })
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    df = repeat_words(df)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def trusted_documents(labels: DataFrame) -> DataFrame:
    """``(doc_id, learn)`` of all documents whose every quality label is 1; the multinomial learns from half of them."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2)) == 0).alias("learn"))


def ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(bucket, w)`` for each bucket: ten-thousandths of a nat of log p_target - log p_corpus, each count plus one.

    ``docs(doc_id, text)`` are all documents.  Texts meet their ids by a shuffle at any size, for the
    ids grow with the corpus and so aren't broadcast; counts are summed before the next one, so that
    moves ``BUCKETS`` rows a task.
    """
    joined = with_grams(docs.join(trusted.where("learn").hint("shuffle_hash"), "doc_id", "left").withColumn("words", words("text"))).select("learn", F.explode(grams()).alias("bucket"))
    counts = joined.groupBy("bucket").agg(F.count("*").alias("n"), F.count("learn").alias("t"))
    counts = materialize(counts, "gram-counts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    n, t = (total["n"] or 0) + BUCKETS, (total["t"] or 0) + BUCKETS
    all_buckets = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    gain = F.log((F.coalesce("t", F.lit(0)) + 1) / F.lit(float(t))) - F.log((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(n)))
    return all_buckets.select("bucket", F.round(gain * UNIT).cast("long").alias("w"))


def assess(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, score and verdict of every document.

    Null text has no words and fails the base rules; repeated rows each get a row; an empty table
    gives none.  Without a trusted document (no labels) every ratio rests on the corpus alone and
    only the base rules decide.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    trusted = materialize(trusted_documents(labels), "trusted")
    table_ = materialize(ratios(docs, trusted), "ratios")
    # a constant number of rows: they become one literal array, looked up in place without a join
    listed = ",".join(str(r["w"]) for r in sorted(table_.collect(), key=lambda r: r["bucket"]))
    weights = F.split(F.lit(listed), ",").cast("array<bigint>")
    scored = base_counts(with_grams(docs.withColumn("words", words("text")))).withColumn("g", grams())
    score = F.aggregate("g", F.lit(0).cast("long"), lambda a, g: a + F.get(weights, g)) / (F.lit(float(UNIT)) * F.greatest(F.size("g"), F.lit(1)))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    scored = materialize(scored.select(*columns, score.alias("score")), "scored")
    held = scored.join(trusted.where(~F.col("learn")), "doc_id").where(~F.col("base_failed"))
    steps = held.groupBy(F.round(F.col("score") * UNIT).cast("long").alias("step")).agg(F.count("*").alias("n"))
    low, mid = steps.agg(*[F.percentile("step", F.lit(q), F.col("n")) / F.lit(float(UNIT)) for q in (0.01, 0.5)]).first()
    threshold = -math.inf if mid is None else mid - SPREAD * (mid - low)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; quality labels say which are trusted."""
    out = assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")

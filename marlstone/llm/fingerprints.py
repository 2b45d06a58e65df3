"""Document fingerprints by SimHash, and search within a Hamming radius, in DataFrame expressions only.

Terms are pairs of neighbouring words (a lone word is its own term).  Each occurrence votes with a
weight, the bytes of its words, so long words count for more than articles; bit i of the fingerprint
is set when the weights of terms with bit i in their hash exceed half of all weights.

Votes of two bits share one 64-bit sum (32 bits each), so plain sums over the exploded terms do all
the counting inside generated code, and only a row for each text is shuffled.

The search cuts a fingerprint into radius + 2 blocks.  Two fingerprints within the radius agree on
two blocks at least, so for every pair of blocks a table keyed by those two (a permutation that
brings them to the front) finds each other; what is found is verified on all bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.tokens import words
from marlstone.session import materialize, table

BITS, RADIUS = 128, 3
_PAIR = (1 << 32) | 1
_LOW = (1 << 32) - 1
#: Documents of one range bucket, about, and the most cells of the id histogram.
BUCKET_ROWS, CELLS = 500, 1 << 16


# -- fingerprints -----------------------------------------------------------------------------

def fingerprint(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, fp1, fp2`` for each distinct value of ``keys``, the two halves of its text's fingerprint.

    ``keys`` must tell rows apart.  A text without a word gives zeros.
    """
    split = df.select(*keys, words(text).alias("words"))
    split = split.select(*keys, F.when(F.size("words") == 0, F.array(F.lit(""))).otherwise(F.col("words")).alias("words"))
    terms = split.select(*keys, "words", F.posexplode("words").alias("i", "w"))
    after = F.get("words", F.col("i") + 1)
    lone = F.size("words") == 1
    weight = F.when(after.isNull() & ~lone, F.lit(0)).otherwise(F.octet_length("w") + F.coalesce(F.octet_length(after), F.lit(0)))
    terms = terms.select(*keys, weight.cast("long").alias("weight"), F.xxhash64("w", after).alias("h1"))
    terms = terms.select(*keys, "weight", "h1", F.xxhash64("h1").alias("h2"))
    sums = {f"{h}_{i}": F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR)) * F.col("weight")) for h in ("h1", "h2") for i in range(32)}
    votes = terms.groupBy(*keys).agg(F.sum("weight").alias("total"), *[v.alias(k) for k, v in sums.items()])
    return votes.select(*keys, _majority("h1").alias("fp1"), _majority("h2").alias("fp2"))


def _majority(h: str) -> Column:
    """The 64 bits whose summed weights exceed half the total."""
    out = F.lit(0).cast("long")
    for i in range(32):
        lanes = F.col(f"{h}_{i}")
        for bit, votes in ((i, lanes.bitwiseAND(F.lit(_LOW))), (i + 32, F.shiftrightunsigned(lanes, 32))):
            mask = 1 << bit if bit < 63 else -(1 << 63)
            out = out.bitwiseOR(F.when(votes * 2 > F.col("total"), F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Share of equal bits of two fingerprints."""
    return 1 - _differing(a, b) / F.lit(float(BITS))


def _differing(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)), F.lit(0))


def hex128(a: str, b: str) -> Column:
    """Both halves as 32 lower-case hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


# -- search -----------------------------------------------------------------------------------

def block_keys(fp: tuple[str, str], radius: int = RADIUS) -> Column:
    """Keys of a fingerprint's two halves in every permuted block table."""
    n = radius + 2
    edges = [BITS * k // n for k in range(n + 1)]
    blocks = [_block(fp, a, b - a) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(i), F.lit(j), blocks[i], blocks[j]) for i, j in combinations(range(n), 2)])


def _block(fp: tuple[str, str], at: int, width: int) -> Column:
    """Bits ``at`` to ``at + width`` of the 128, as a number."""
    parts, end = [], at + width
    for k, half in enumerate(fp):
        a, b = max(at - 64 * k, 0), min(end - 64 * k, 64)
        if a < b:
            mask = (1 << (b - a)) - 1
            parts.append(F.shiftrightunsigned(half, 64 - b).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long")))
    return parts[0] if len(parts) == 1 else F.xxhash64(*parts)


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(q1, q2, fp1, fp2, differing)``: for each distinct query fingerprint all distinct ones within the radius.

    Both sides are ``(fp1, fp2)``.  A pair that meets in several tables is reported once: in the
    first table whose key both share.  Repeated fingerprints count once, a null half meets nothing, an
    empty side gives no rows.  No side is broadcast but by Spark's own check of its written size.
    """
    def entries(df: DataFrame) -> DataFrame:
        return df.select("fp1", "fp2").distinct().select("fp1", "fp2", F.posexplode(block_keys(("fp1", "fp2"), radius)).alias("at", "key"))

    asked = entries(queries).select(F.col("fp1").alias("q1"), F.col("fp2").alias("q2"), "at", "key")
    met = asked.join(entries(fps), ["at", "key"]).withColumn("differing", _differing(("q1", "q2"), ("fp1", "fp2")))
    met = met.where(F.col("differing") <= radius)
    # both rows' keys are made again for the few pairs that met, rather than carried through the join
    shared = F.transform(block_keys(("q1", "q2"), radius), lambda k, i: F.when(F.get(block_keys(("fp1", "fp2"), radius), i) == k, i))
    first = F.array_min(shared)
    return met.where(F.col("at") == first).select("q1", "q2", "fp1", "fp2", "differing")


# -- edited neighbours ------------------------------------------------------------------------

def _ranges(ids: DataFrame) -> tuple[DataFrame, int]:
    """Range cells of doc_id: ``(cell, base, lo, span, k)`` and the width of a cell's ids.

    An equal-width histogram of at most ``CELLS`` cells; each cell with rows is cut into k buckets
    between its own least and greatest id.  The cells come to the driver, a constant number.
    """
    lo, hi, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    cells = min(CELLS, max(1, n // BUCKET_ROWS))
    width = (hi - lo) // cells + 1
    rows = ids.groupBy(_cell(lo, width).alias("cell")).agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()
    most, base, out = max(BUCKET_ROWS, n // CELLS), 0, []
    for r in sorted(rows, key=lambda r: r["cell"]):
        k = max(1, -(-r["n"] // most))
        first, last = r["lo"] or 0, r["hi"] or 0
        out.append((r["cell"], base, first, float(last - first + 1), k))
        base += k
    spark = ids.sparkSession
    return spark.createDataFrame(out, "cell long, base long, lo long, span double, k int"), (lo, width)


def _cell(lo: int, width: int) -> Column:
    return F.coalesce(F.expr(f"(doc_id - {lo}L) div {width}L"), F.lit(-1).cast("long"))


def with_edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document beside its edited text: ``(bucket, rn, doc_id, text, edited, next_bucket, next_rn)``.

    The next document is the one of next lower doc_id (null ids last, equal ids by a hash of their
    text), after the last comes the first.  Texts are dealt once, by ranges of ids; the head of each
    range also goes, as a stand-in, to the range before it, so no range waits for another.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cells, (lo, width) = _ranges(docs.select("doc_id"))
    bucket = F.col("base") + F.coalesce(F.floor((F.col("doc_id") - F.col("lo")) / F.col("span") * F.col("k")), F.lit(0))
    dealt = docs.withColumn("cell", _cell(lo, width)).join(F.broadcast(cells), "cell").select(F.least(bucket, F.col("base") + F.col("k") - 1).alias("bucket"), "doc_id", "text")
    heads = materialize(dealt.groupBy("bucket").agg(F.max("doc_id").alias("head")), "heads")
    falling = Window.orderBy(F.desc("bucket"))
    after = F.coalesce(F.lag("bucket").over(falling), F.min("bucket").over(Window.partitionBy()))
    heads = materialize(heads.select("bucket", "head", after.alias("before")), "head-order")  # a row for each range
    chosen = dealt.join(F.broadcast(heads), "bucket").where(F.col("doc_id").eqNullSafe(F.col("head")))
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("text"))
    stand_ins = chosen.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    rows = dealt.select("bucket", "doc_id", "text", F.lit(None).cast("long").alias("home"))
    rows = rows.unionAll(stand_ins.select(F.col("before").alias("bucket"), "doc_id", "text", F.col("bucket").alias("home")))
    by_id = Window.partitionBy("bucket").orderBy(F.col("home").isNotNull(), F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    rows = rows.select("*", F.row_number().over(by_id).alias("rn"), F.lead("text").over(by_id).alias("after"), F.lead("home").over(by_id).alias("after_home"))
    rows = rows.where(F.col("home").isNull())
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("after", F.lit("")), F.lit(1), cut))
    next_rn = F.when(F.col("after_home").isNull(), F.col("rn") + 1).otherwise(F.lit(1))
    return rows.select("bucket", "rn", "doc_id", "text", edited.alias("edited"), F.coalesce("after_home", "bucket").alias("next_bucket"), next_rn.alias("next_rn"))


def compare(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses.

    Null text is empty; repeated rows each get a row and are each other's neighbours; a single row
    is its own neighbour; an empty table gives none.
    """
    pairs = with_edits(df, doc_id, text).withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)})
    keys = ["bucket", "rn", "doc_id", "n_chars", "edited_sha256", "next_bucket", "next_rn", "which"]
    both = pairs.select("*", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"))
    fps = fingerprint(both.select(*keys[:-1], "x.which", "x.t"), keys, "t")
    own = [F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{p}{c}") for w, p in ((0, ""), (1, "edited_")) for c in ("fp1", "fp2")]
    fps = materialize(fps.groupBy(*keys[:-1]).agg(*own), "fingerprints")
    after = fps.select(F.col("bucket").alias("next_bucket"), F.col("rn").alias("next_rn"), F.col("fp1").alias("n1"), F.col("fp2").alias("n2"))
    return fps.join(after, ["next_bucket", "next_rn"])


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, and for each hundredth id how many distinct ones lie within the radius.

    Repeated ids are told apart by their fingerprints, so every row gives one row; null ids ask nothing.
    """
    fps = materialize(compare(table(spark, sf_dir, "documents")), "compared")
    asked = fps.where(F.col("doc_id") % 100 == 0)
    near = within_radius(asked, fps).groupBy(F.col("q1").alias("fp1"), F.col("q2").alias("fp2")).agg(F.count("*").alias("n_within"))
    hits = asked.select("doc_id", "fp1", "fp2").distinct().join(near, ["fp1", "fp2"])
    out = fps.join(hits, ["doc_id", "fp1", "fp2"], "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex128("fp1", "fp2").alias("fingerprint"),
        hex128("edited_fp1", "edited_fp2").alias("edited_fingerprint"),
        likeness(("fp1", "fp2"), ("edited_fp1", "edited_fp2")).alias("near_edited"),
        likeness(("fp1", "fp2"), ("n1", "n2")).alias("near_next"),
        "n_within",
    )

"""Evaluation: hits against gold evidence, summaries per condition, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import estimate_tokens

#: Classes of questions.
CLASSES = ("lookup", "synthesis", "multi-hop", "trust", "unanswerable")


def gold_hit(gold: Column, found: Column) -> Column:
    """Whether any gold path was found."""
    return F.coalesce(F.arrays_overlap(gold, found), F.lit(False))


def appropriate(cls: Column, abstained: Column) -> Column:
    """Abstaining is right for unanswerable questions and wrong for the others."""
    return (cls == "unanswerable") == abstained


def median(x: str) -> Column:
    """Whole-number median: the middle, or the mean of the middle two rounded down."""
    return F.floor(F.percentile(x, F.lit(0.5)))


def cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """Dollars at rates for a million tokens; null without usage."""
    return (tokens_in * rate_in + tokens_out * rate_out) / 1_000_000


def summary(results: DataFrame) -> DataFrame:
    """One row a condition of ``results(condition, abstained, appropriate, gold_hit, retrieval_hit, warnings, tool_calls, spent_tokens, latency_ms, cost_usd, exhausted)``."""
    unknown = F.bool_or(F.col("cost_usd").isNull() & ~F.col("abstained"))
    return results.groupBy("condition").agg(
        F.count("*").alias("questions"), F.count_if(~F.col("abstained")).alias("answered"), F.count_if("abstained").alias("abstained"),
        F.count_if("gold_hit").alias("gold_hits"), F.count_if("retrieval_hit").alias("retrieval_hits"), F.count_if("appropriate").alias("appropriate"),
        F.sum("warnings").alias("warnings"), F.avg("tool_calls").alias("mean_tool_calls"), median("spent_tokens").alias("median_tokens"),
        median("latency_ms").alias("median_latency_ms"), F.when(~unknown, F.sum(F.coalesce("cost_usd", F.lit(0.0)))).alias("cost_usd"), F.count_if("exhausted").alias("exhausted"),
    )


def run(explorer, questions: DataFrame, policy=None) -> DataFrame:
    """Rows for ``summary`` and more: every question of a bundle under both conditions.

    ``pd`` answers by navigation, ``rag`` by the best chunks of references; a hit is a gold path
    among what was cited or, for ``retrieval_hit``, among the evidence itself.  All questions go at
    once, so none has a latency of its own; no provider that reports usage is asked, so answers have no cost.
    """
    from marlstone.operators import ask

    q = questions.select(F.col("id").alias("qid"), F.col("question").alias("text"))
    resources = explorer.docs.select("path", F.explode("resources").alias("resource"))
    pd_ = explorer.answers(q, policy or ask.Policy())
    cited = pd_.select("qid", F.explode("citations").alias("path"))
    named = cited.unionByName(cited.join(resources, "path").select("qid", F.col("resource").alias("path"))).groupBy("qid").agg(F.collect_set("path").alias("cited"))
    navigated = pd_.join(named, "qid", "left").select("qid", F.lit("pd").alias("condition"), "abstained", "cited", F.col("citations").alias("found"), F.size("warnings").alias("warnings"), F.col("spent_chars").alias("chars"), "tool_calls", "exhausted")
    best = explorer.chunk_hits(q)
    rag = q.select("qid").join(ask.answer_rag(best.select("qid", "path", "seq", "chunk", "score")), "qid", "left")
    paths = F.transform("evidence", lambda e: e["path"])
    chars = F.aggregate("evidence", F.lit(0), lambda n, e: n + F.length(e["chunk"]))
    retrieved = rag.select("qid", F.lit("rag").alias("condition"), F.col("evidence").isNull().alias("abstained"), paths.alias("cited"), paths.alias("found"), F.lit(0).alias("warnings"), F.coalesce(chars, F.lit(0)).cast("long").alias("chars"), F.lit(1).cast("long").alias("tool_calls"), (estimate_tokens(F.coalesce(chars, F.lit(0))) >= ask.BUDGET).alias("exhausted"))
    rows = navigated.unionByName(retrieved).join(questions.select(F.col("id").alias("qid"), "class", "gold"), "qid")
    return rows.select(
        "qid", "class", "condition", "abstained", appropriate(F.col("class"), F.col("abstained")).alias("appropriate"),
        gold_hit(F.col("gold"), F.col("cited")).alias("gold_hit"), gold_hit(F.col("gold"), F.col("found")).alias("retrieval_hit"), "warnings",
        "tool_calls", estimate_tokens("chars").cast("int").alias("spent_tokens"), F.lit(None).cast("int").alias("latency_ms"),
        F.when(F.col("abstained"), F.lit(0.0)).alias("cost_usd"), "exhausted",
    )

"""Conversations: pairing questions with answers, bounded history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import drop_scratch, freed_shuffles, materialize, scratch_count

TURNS, ANSWER_CHARS = 4, 600


def qa_pairs(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, question, answer)``: each assistant turn that directly answers the last user turn.

    A user turn that another user turn follows stays unanswered; system turns don't count.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.where(F.col("role").isin("user", "assistant"))
    rows = rows.withColumns({"before": F.lag("role").over(order), "question": F.lag("text").over(order)})
    return rows.where("role = 'assistant' and before = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def recent(pairs: DataFrame, turns: int = TURNS, chars: int = ANSWER_CHARS) -> DataFrame:
    """The last pairs of each conversation, answers clipped."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = pairs.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= turns)
    return rows.select("conv_id", "turn", "question", F.substring("answer", 1, chars).alias("answer"), "back")


def user_turns(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"))


def questions_of(turns: DataFrame) -> DataFrame:
    """``(qid, conv_id, nth, turn, text)``: the user turns of each conversation, numbered from 1; null and blank ones ask nothing."""
    asked = turns.where((F.col("role") == "user") & (F.trim("text") != ""))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return asked.select("conv_id", nth.alias("nth"), "turn", "text").withColumn("qid", F.concat_ws("#", "conv_id", "nth"))


def answers(questions: DataFrame, docs: DataFrame, edges: DataFrame, found: DataFrame | None = None, **how: object) -> DataFrame:
    """``ask.answer``'s columns and ``(conv_id, nth, turn)`` for ``questions_of`` all conversations, each turn knowing the one before.

    A turn's candidates begin with what the last answer of its conversation cites.  All questions are
    searched at once; then a round answers the first turns of all conversations, the next one the second
    turns, and so on: as many rounds as the longest conversation has turns, each over its own questions.
    What a round carries over is a written table.  A round reads the documents and links that its
    candidates reach, see ``_reached``, and leaves nothing but its answers on disk.
    """
    from marlstone.operators import ask

    spark = questions.sparkSession
    with freed_shuffles(spark):
        questions = materialize(questions, "questions")
        start = scratch_count()
        found = materialize(ask.search_hits(questions, docs) if found is None else found, "found")
        drop_scratch(spark, start, 1)
        carried, rounds = None, []
        for k in range(1, (questions.agg(F.max("nth")).first()[0] or 0) + 1):
            start = scratch_count()
            now = questions.where(F.col("nth") == k).withColumn("turns", F.lit(min(k - 1, TURNS)))
            hits = found.join(now.select("qid"), "qid", "left_semi")
            near = (docs, edges) if how.get("budget") is not None else _reached(docs, edges, hits, carried, how.get("policy", ask.Policy()).reads)
            out = ask.answer(now, *near, found=hits, carried=carried, **how)
            out = materialize(out.join(now.select("qid", "conv_id", "nth", "turn"), "qid"), "answers")
            drop_scratch(spark, start, 1)
            rounds.append(out)
            cites = out.select(F.concat_ws("#", "conv_id", F.col("nth") + 1).alias("qid"), F.posexplode("citations").alias("nth", "path"))
            carried = cites.select("qid", "path", "nth")
    if not rounds:
        now = questions.withColumn("turns", F.lit(0))
        return ask.answer(now, docs, edges, found=found, **how).join(now.select("qid", "conv_id", "nth", "turn"), "qid")
    return reduce(DataFrame.unionByName, rounds)


#: Of so many documents a round may reach one and still writes them aside.
FEW = 16


def _reached(docs: DataFrame, edges: DataFrame, hits: DataFrame, carried: DataFrame | None, reads: int) -> tuple[DataFrame, DataFrame]:
    """The documents that candidates and their links lead to, and those links; enough for answers whose calls aren't priced.

    Few documents are written, so that a late round reads all of them once.
    """
    from marlstone.operators import navigate
    from marlstone.operators.bundle import kind

    wanted = navigate.candidates(hits.withColumn("kind", kind(F.col("path"))), reads, carried)
    wanted = materialize(wanted.select("path").distinct(), "wanted")
    links = materialize(edges.join(wanted.withColumnRenamed("path", "src"), "src", "left_semi"), "links")
    paths = materialize(wanted.union(links.select(F.col("dst").alias("path"))).distinct(), "paths")
    near = docs.join(paths, "path", "left_semi")
    return (materialize(near, "near") if paths.count() * FEW < docs.count() else near), links

"""Batch question answering over a bundle: search, read, one link hop, excerpts, evidence, answers.

Every question of a table goes through at once; each step is one frame.  The only bounds are the
policy's, applied by window ranks that Spark prunes inside tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import clip_words, distinct_hits, estimate_tokens, question_terms, strip, term_occurrences, title_shaped, tokens, visible_prose
from marlstone.operators import navigate
from marlstone.operators.bundle import is_concept, kind, trust_warnings
from marlstone.operators.chunks import TOP
from marlstone.operators.conversation import TURNS
from marlstone.operators.search import FIELD_WEIGHTS, bm25
from marlstone.session import materialize

BUDGET, SEARCH, HIT_CHARS = 25_000, 10, 300


@dataclass(frozen=True)
class Policy:
    """Bounds of an answer: documents read, links followed, evidence entries, characters of each."""

    version: str = "1"
    reads: int = 4
    fanout: int = 4
    evidence: int = 4
    excerpt: int = 500


def policy_for(budget: int = BUDGET) -> Policy:
    """Bounds that grow with the token budget."""
    return Policy("2", min(8, max(4, budget // 4000)), min(8, max(4, budget // 6000)), min(12, max(4, budget // 3000)), min(2000, max(500, budget // 25)))


def lead(body: Column, question: Column) -> Column:
    """A hit's snippet where no better one is asked for: how its body begins."""
    return F.substring(body, 1, 200)


def candidate_paragraphs(docs: DataFrame, key: str, body: str) -> DataFrame:
    """``(key, pos, para, section)``: prose paragraphs with the heading above them.

    Bare headings, footnote definitions and what stands under ``Sources`` are left out.
    """
    rows = docs.select(key, F.posexplode(F.split(F.col(body), "\n\n")).alias("pos", "raw")).withColumn("para", strip("raw")).where("para <> ''")
    lines = F.filter(F.split("para", "\n"), lambda x: x.rlike(r"\S"))
    rows = rows.withColumn("lines", lines).withColumn("heads", F.filter("lines", lambda x: x.rlike(r"^#{1,6}\s+")))
    named = F.when(F.size("heads") > 0, F.lower(strip(F.regexp_extract(F.element_at("heads", -1), r"^#{1,6}\s+(.*)$", 1))))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.coalesce(F.last(named, True).over(order), F.lit("")))
    prose = (F.size("heads") < F.size("lines")) & (F.col("section") != "sources") & F.exists("lines", lambda x: ~x.rlike(r"^\[\^[^\]]+\]:"))
    return rows.where(prose).select(key, "pos", "para", "section")


def excerpts(read: DataFrame, docs: DataFrame, chars: int) -> DataFrame:
    """``(qid, path, tier, place, excerpt, ..)`` of documents read for questions.

    ``read(qid, path, terms, own_terms)``: terms choose excerpts, own_terms (the question's) rank
    them.  Tier 0 is a document's best excerpt, 1 its others, 2 prose without a term of documents
    whose title holds the whole question.
    """
    paras = candidate_paragraphs(docs, "path", "body").withColumn("prose", visible_prose("para"))
    rows = read.join(paras, "path").withColumn("tokens", F.array_distinct(tokens("prose")))
    hits = F.size(F.array_intersect("tokens", "terms"))
    rows = rows.withColumns({"hits": hits, "occ": term_occurrences("prose", "terms"), "echo": F.size(F.array_except("tokens", "terms")) == 0})
    found = rows.where("hits > 0 and not echo").select("qid", "path", "terms", "own_terms", "hits", "occ", "pos", "prose")
    meta = docs.select("path", "title", F.coalesce("description", F.lit("")).alias("description"))
    bare = read.join(found.select("qid", "path").distinct(), ["qid", "path"], "left_anti").join(meta, "path")
    summary = visible_prose("description")
    bare = bare.where((distinct_hits(summary, "terms") > 0) & (F.size(F.array_except(F.array_distinct(tokens(summary)), "terms")) > 0))
    bare = bare.select("qid", "path", "terms", "own_terms", distinct_hits(summary, "terms").alias("hits"), F.lit(0).alias("occ"), F.lit(0).alias("pos"), summary.alias("prose"))
    ranked = found.unionByName(bare)
    nth = F.row_number().over(Window.partitionBy("qid", "path").orderBy(F.desc("hits"), F.desc("occ"), "pos"))
    ranked = ranked.withColumn("place", nth).withColumn("tier", F.when(F.col("place") == 1, 0).otherwise(1))
    shaped = ranked.where("place = 1").join(meta, "path").where(title_shaped("own_terms", F.coalesce("title", "path"))).select("qid", "path")
    fill = rows.where("hits = 0 and size(tokens) > 0").join(shaped, ["qid", "path"], "left_semi")
    fill = fill.select("qid", "path", "terms", "own_terms", "hits", "occ", "pos", "prose", (F.col("pos") + F.when(F.col("section") == "sections", 0).otherwise(1_000_000)).alias("place"), F.lit(2).alias("tier"))
    out = ranked.unionByName(fill).withColumn("excerpt", F.substring(strip("prose"), 1, chars))
    score = F.when(F.col("tier") == 2, 0).otherwise(distinct_hits("excerpt", "own_terms"))
    return out.select("qid", "path", "tier", "place", "excerpt", score.alias("score"))


def search_hits(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """``(qid, path, score, rank)`` of ``questions(qid, text)`` over documents read anew; a written index has ``Index.search``."""
    fields = {k: FIELD_WEIGHTS[k] for k in ("title", "description", "tags", "body")}
    flat = docs.withColumn("tags", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    return bm25(flat.where(F.col("path") != "log.md"), questions, "path", "qid", fields, top=SEARCH)


def answer(
    questions: DataFrame, docs: DataFrame, edges: DataFrame, policy: Policy = Policy(), today: str | None = None, budget: int | None = None, overview: int = 0,
    found: DataFrame | None = None, carried: DataFrame | None = None, snippet: Callable[[Column, Column], Column] = lead,
) -> DataFrame:
    """``(qid, abstained, answer, evidence, citations, warnings, tool_calls, calls, spent_chars, exhausted, carried)`` for ``questions(qid, text)``.

    ``docs(path, title, description, tags, body, status, stale_after, verified, resources)`` is the
    bundle; ``edges(src, dst, anchor)`` are its links, one row for two files (``graph.anchors``).  Ties keep navigation order: search rank,
    then hop, then place in the document.

    With a ``budget`` (tokens) calls are priced and end when it is spent (``navigate.call_log``), ``overview``
    being the price of the overview.  ``found(qid, path, score, rank)`` are hits of a written index.  In a
    conversation ``carried(qid, path, nth)`` are the last answer's citations and ``questions`` have
    ``turns``, the number of turns before.
    """
    found = (search_hits(questions, docs) if found is None else found).withColumn("kind", kind(F.col("path")))
    found = materialize(found, "found")  # each of the written frames is read several times below
    wanted = materialize(navigate.candidates(found, policy.reads, carried), "candidates")
    seeds = wanted.join(docs.select("path"), "path", "left_semi")
    searched = None if budget is None else navigate.search_prices(questions, found, docs, snippet)
    calls = navigate.call_log(questions.select("qid"), seeds, searched, docs, edges, policy.fanout, budget, overview, today)
    calls = materialize(calls, "calls")
    reads = calls.where("tool = 'read'")
    asked = questions.select("qid", question_terms("text").alias("own_terms"))
    anchors = edges.where(is_concept(F.col("dst"))).select(F.col("src").alias("via"), F.col("dst").alias("path"), "anchor")
    hopped = reads.where("via is not null").join(anchors, ["via", "path"], "left").select("qid", "path", (F.col("hop") + 1000).alias("nav"), question_terms(F.coalesce("anchor", F.lit(""))).alias("more"))
    read = reads.where("via is null").select("qid", "path", F.col("pos").alias("nav"), F.array().cast("array<string>").alias("more")).unionByName(hopped).join(asked, "qid")
    read = read.select("qid", "path", "nav", "own_terms", F.array_union("own_terms", "more").alias("terms"))
    read = materialize(read, "read")
    used_docs = docs.join(read.select("path").distinct(), "path", "left_semi")
    entries = excerpts(read.select("qid", "path", "terms", "own_terms"), used_docs, policy.excerpt).join(read.select("qid", "path", "nav"), ["qid", "path"])
    entries = materialize(entries, "entries")
    cited = entries.select("qid", "path").distinct().join(used_docs.select("path", F.explode("resources").alias("resource")), "path").select("qid", F.col("resource").alias("path")).distinct()
    entries = entries.join(cited, ["qid", "path"], "left_anti")
    best = Window.partitionBy("qid").orderBy("tier", F.when(F.col("tier") < 2, -F.col("score")).otherwise(0), "nav", "place")
    entries = entries.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= policy.evidence)
    meta = used_docs.select("path", F.coalesce("title", "path").alias("title"), trust_warnings(F.col("path"), F.col("status"), F.col("stale_after"), F.coalesce(F.size("verified") > 0, F.lit(False)), today).alias("warned"))
    entries = entries.join(meta, "path")
    item = F.struct("nth", "path", "title", "excerpt", "warned")
    grouped = entries.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("e"))  # at most policy.evidence a question
    first = wanted.where("pos = 1").select("qid", F.col("path").alias("closest"))
    used = calls.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("nth", "tool", "path", "chars"))).alias("calls"), F.max("spent").alias("spent_chars"), F.max("exhausted").alias("exhausted"))
    kept = wanted.where("carried").join(reads.where("via is null").select("qid", "path"), ["qid", "path"], "left_semi")
    kept = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("kept"))  # at most navigate.CARRIED
    turns = F.col("turns") if "turns" in questions.columns else F.lit(0)
    out = questions.select("qid", "text", turns.alias("turns")).join(grouped, "qid", "left").join(first, "qid", "left").join(asked, "qid").join(used, "qid", "left").join(kept, "qid", "left")
    wanted = F.coalesce(F.nullif(F.array_join(F.array_sort("own_terms"), ", "), F.lit("")), F.lit("the question topic"))
    gap = F.when(F.col("closest").isNotNull(), F.concat(F.lit("Insufficient evidence in this bundle to answer. The closest match is "), "closest", F.lit(", but it does not address: "), wanted, F.lit(". A concept covering "), wanted, F.lit(" would resolve the gap.")))
    gap = gap.otherwise(F.concat(F.lit("Insufficient evidence in this bundle to answer. No concept mentions: "), wanted, F.lit(". Adding a source about "), wanted, F.lit(" would resolve the gap.")))
    abstained = F.col("e").isNull()
    paths = F.array_distinct(F.transform("e", lambda x: x["path"]))
    return out.select(
        "qid", abstained.alias("abstained"), F.when(abstained, gap).otherwise(stub_answer(F.col("e"), F.col("turns"))).alias("answer"),
        F.transform("e", lambda x: F.struct(x["path"].alias("path"), x["title"].alias("title"), x["excerpt"].alias("excerpt"))).alias("evidence"),
        paths.alias("citations"), F.array_distinct(F.flatten(F.transform("e", lambda x: F.when(is_concept(x["path"]), x["warned"]).otherwise(F.array().cast("array<string>"))))).alias("warnings"),
        F.size("calls").cast("long").alias("tool_calls"), "calls", F.col("spent_chars").cast("long").alias("spent_chars"), F.coalesce("exhausted", F.lit(False)).alias("exhausted"),
        F.coalesce(F.transform("kept", lambda x: x["path"]), F.array().cast("array<string>")).alias("carried"),
    )


def stub_answer(items: Column, turns: Column) -> Column:
    """The deterministic provider's answer: its evidence, quoted; after turns of a conversation it says how many."""
    name = lambda x: F.coalesce(F.nullif(strip(x["title"]), F.lit("")), x["path"])
    lines = F.transform(items, lambda x: F.concat(F.lit("- "), name(x), F.lit(": "), strip(x["excerpt"]), F.lit(" ["), x["path"], F.lit("]")))
    prior = F.least(turns, F.lit(TURNS))
    said = F.when(prior > 0, F.concat(F.lit(" passage(s) and "), prior.cast("string"), F.lit(" prior turn(s):\n"))).otherwise(F.lit(" passage(s) retrieved from the bundle:\n"))
    return F.concat(F.lit("Based on "), F.size(items).cast("string"), said, F.array_join(lines, "\n"))


def answer_rag(hits: DataFrame, budget: int = BUDGET, top: int = TOP) -> DataFrame:
    """``(qid, evidence)`` of ranked chunks ``hits(qid, path, seq, chunk, score)``: the first ``top``, while the budget lasts."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "path", "seq")
    kept = hits.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    running = F.sum(F.length("chunk")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("running", running).where(estimate_tokens("running") <= budget)
    return kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "seq", "chunk"))).alias("evidence"))


def hit(description: Column | str) -> Column:
    """A search hit's description, clipped."""
    return clip_words(description, HIT_CHARS)


def rag_answer(hits: DataFrame, questions: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(qid, abstained, answer, evidence, citations)`` of every question from its best chunks, see ``answer_rag``."""
    rows = questions.select("qid", question_terms("text").alias("own_terms")).join(answer_rag(hits, budget), "qid", "left")
    item = F.transform("evidence", lambda e: F.struct(e["path"].alias("path"), e["path"].alias("title"), e["chunk"].alias("excerpt")))
    wanted = F.coalesce(F.nullif(F.array_join(F.array_sort("own_terms"), ", "), F.lit("")), F.lit("the question topic"))
    gap = F.concat(F.lit("Insufficient evidence in this bundle to answer. No chunk matches: "), wanted, F.lit("."))
    return rows.select("qid", F.col("evidence").isNull().alias("abstained"), F.when(F.col("evidence").isNull(), gap).otherwise(stub_answer(item, F.lit(0))).alias("answer"), item.alias("evidence"), F.array_distinct(F.transform("evidence", lambda e: e["path"])).alias("citations"))

"""Compiling documents into a bundle: sections, digests, plans, concepts, references, index.

Documents are ``(uri, source_hash, retrieved_at, title, blocks)``.  A plan groups a document's
sections into concepts; without a model every document is one concept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import cache_key, content_hash, digest_text, first_sentence, slugify
from marlstone.operators.bundle import first_per_key, unique_slugs
from marlstone.operators.graph import related
from marlstone.session import drop_scratch, materialize, scratch_count
from marlstone.sources.markdown import render

HEADING_CHARS, ENTRY_CHARS, BODY_CHARS, LEAD = 200, 500, 10_000, 3
SUBHEADINGS, SUBHEADING_CHARS, MAX_CONCEPTS, TITLE_CHARS = 8, 100, 12, 120
SPLIT_CHARS = 6_000
#: Versions that are part of the cache keys.
GENERATOR = "4"
PROMPTS = {"answer-question": "2", "chat-answer": "2", "concept-description": "1", "concept-plan": "1", "reference-description": "1", "bundle-description": "1"}


def is_heading(b: Column) -> Column:
    return b["kind"] == "heading"


def section_level(blocks: Column) -> Column:
    """The shallowest heading level used, but 2 at least; 0 without headings.  A leading level-1 heading is the title."""
    levels = F.transform(F.filter(body_blocks(blocks), is_heading), lambda b: F.coalesce(b["level"], F.lit(1)))
    return F.when(F.size(levels) > 0, F.greatest(F.lit(2), F.array_min(levels))).otherwise(F.lit(0))


def body_blocks(blocks: Column) -> Column:
    first = F.get(blocks, F.lit(0))
    titled = (first["kind"] == "heading") & (F.coalesce(first["level"], F.lit(1)) == 1)
    return F.when(F.coalesce(titled, F.lit(False)), F.slice(blocks, F.lit(2), F.size(blocks))).otherwise(blocks)


def sections(docs: DataFrame, key: str) -> DataFrame:
    """``(key, section, heading, blocks)``: blocks by the section they stand in; section -1 comes before the first."""
    rows = docs.select(key, section_level(F.col("blocks")).alias("level"), F.posexplode(body_blocks(F.col("blocks"))).alias("pos", "b"))
    opens = (F.col("b.kind") == "heading") & (F.coalesce("b.level", F.lit(1)) <= F.col("level"))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", (F.sum(opens.cast("int")).over(order) - 1).cast("int"))
    grouped = rows.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("pos", "b"))).alias("x"))
    blocks = F.transform("x", lambda x: x["b"])
    return grouped.select(key, "section", F.when(F.col("section") >= 0, F.get(blocks, F.lit(0))["text"]).alias("heading"), blocks.alias("blocks"))


def digests(docs: DataFrame, key: str) -> DataFrame:
    """``(key, digest)``: up to three lead paragraphs, then each section's heading and first prose, within a body budget.

    A section beyond the budget keeps its heading only, and goes when even that doesn't fit.
    """
    rows = sections(docs, key)
    prose = F.get(F.filter("blocks", lambda b: b["kind"].isin("paragraph", "quote", "list")), F.lit(0))["text"]
    title = F.substring(digest_text("heading"), 1, HEADING_CHARS)
    prefix = F.concat(F.lit("**"), title, F.lit("** — "))
    content = F.substring(digest_text(F.coalesce(prose, F.lit(""))), F.lit(1), ENTRY_CHARS - F.length(prefix))
    short = F.concat(F.lit("**"), title, F.lit("**"))
    leads = F.slice(F.filter(F.transform(F.filter("blocks", lambda b: b["kind"] == "paragraph"), lambda b: F.substring(digest_text(b["text"]), 1, ENTRY_CHARS)), lambda t: t != ""), 1, LEAD)
    rows = rows.select(key, "section", F.when(F.col("section") < 0, leads).alias("lead"),
                       F.when(F.col("section") >= 0, F.struct(F.col("section").alias("at"), F.when(content != "", F.concat(prefix, content)).otherwise(short).alias("entry"), short.alias("short"))).alias("e"))
    rows = rows.groupBy(key).agg(F.flatten(F.collect_list("lead")).alias("lead"), F.array_sort(F.collect_list("e")).alias("entries"))
    used = F.aggregate("lead", F.lit(0), lambda n, t: n + F.length(t) + 2)
    start = F.struct(used.alias("used"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        pick = F.when(a["used"] + F.length(e["entry"]) <= BODY_CHARS, e["entry"]).when(a["used"] + F.length(e["short"]) <= BODY_CHARS, e["short"])
        return F.struct((a["used"] + F.coalesce(F.length(pick) + 2, F.lit(0))).alias("used"), F.when(pick.isNotNull(), F.concat(a["out"], F.array(pick))).otherwise(a["out"]).alias("out"))

    out = F.aggregate("entries", start, step)["out"]
    rows = rows.select(key, "lead", out.alias("out"))
    parts = F.concat("lead", F.when(F.size("out") > 0, F.concat(F.array(F.lit("# Sections")), F.col("out"))).otherwise(F.array().cast("array<string>")))
    return rows.select(key, F.array_join(parts, "\n\n").alias("digest"))


def subheadings(blocks: Column) -> Column:
    """The next-level headings inside a section's blocks, at most eight."""
    inner = F.filter(F.slice(blocks, F.lit(2), F.size(blocks)), is_heading)
    least = F.array_min(F.transform(inner, lambda b: F.coalesce(b["level"], F.lit(1))))
    return F.slice(F.transform(F.filter(inner, lambda b: F.coalesce(b["level"], F.lit(1)) == least), lambda b: F.substring(digest_text(b["text"]), 1, SUBHEADING_CHARS)), 1, SUBHEADINGS)


def plan_valid(plan: Column, n_sections: Column) -> Column:
    """Whether ``array<struct<title, sections>>`` splits the sections exactly: each once, in order, titles given."""
    claimed = F.flatten(F.transform(plan, lambda c: c["sections"]))
    exact = F.array_sort(claimed) == F.sequence(F.lit(0), n_sections - 1)
    each = F.forall(plan, lambda c: (F.trim(digest_text(c["title"])) != "") & (F.size(c["sections"]) > 0) & (F.array_sort(c["sections"]) == c["sections"]))
    return (F.size(plan) == 0) | ((F.size(plan) <= MAX_CONCEPTS) & each & (n_sections > 0) & F.coalesce(exact, F.lit(False)))


def should_split(section: DataFrame, key: str) -> DataFrame:
    """Documents of one oversized section, without a preamble, that has three subsections at least."""
    rows = section.withColumn("chars", F.aggregate("blocks", F.lit(0), lambda n, b: n + F.length(b["text"])))
    one = rows.groupBy(key).agg(F.count_if(F.col("section") >= 0).alias("n"), F.count_if(F.col("section") < 0).alias("pre"), F.max("chars").alias("chars"), F.max(F.size(subheadings(F.col("blocks")))).alias("subs"))
    return one.where((F.col("n") == 1) & (F.col("pre") == 0) & (F.col("chars") > SPLIT_CHARS) & (F.col("subs") >= 3)).select(key)


def generation_key(content: Column, prompt: str, provider: str, version: str = "1") -> Column:
    """Cache key of one generated field."""
    return cache_key(content, F.lit(prompt), F.lit(PROMPTS[prompt]), F.lit(provider), F.lit(GENERATOR), F.lit(version))


def with_cache(df: DataFrame, cache: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Values already cached win over new ones; also returns the cache with the new keys merged in."""
    joined = df.join(cache.select(key, F.col(value).alias("_cached")), key, "left")
    joined = joined.withColumn(value, F.coalesce("_cached", value)).drop("_cached")
    return joined, cache.unionByName(joined.select(key, value).distinct().join(cache, key, "left_anti"))


def compile_bundle(docs: DataFrame, name: str, generator: str = "marlstone", at: str = "1970-01-01T00:00:00Z", concepts: DataFrame | None = None) -> DataFrame:
    """``(rel_path, content)``: references, concepts and the root index of a bundle.

    The first document of a URI wins.  Paths are slugs, numbered when taken.  ``concepts(uri, nth,
    title, blocks, description, at)`` are the planned concepts; without them every document is one,
    described by the deterministic provider's sentence.
    """
    start = scratch_count()
    docs = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    # names are made of rows without blocks, which meet their names once
    named = first_per_key(docs.select("_row", "uri", "source_hash", "title"), "uri", "source_hash", "title", "_row")
    named = unique_slugs(named.withColumn("slug", slugify("title")), "slug", "uri").select("_row", F.col("unique_slug").alias("slug"))
    docs = docs.join(named, "_row").drop("_row").withColumn("source_id", F.concat(F.lit("source-"), F.substring(F.sha2("uri", 256), 1, 12))).withColumn("ref", F.concat(F.lit("references/"), "slug", F.lit(".md")))
    docs = materialize(docs, "named")
    drop_scratch(docs.sparkSession, start, keep_last=1)
    path = lambda slug: F.concat(F.lit("concepts/"), slug, F.lit(".md")).alias("path")
    if concepts is None:
        described = F.concat(F.lit("Grounded notes on "), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("this concept")), F.lit(", generated from the acquired source material."))
        made = docs.select("uri", F.lit(0).alias("nth"), path("slug"), "title", "blocks", described.alias("description"), F.lit(at).alias("at"))
    else:
        made = unique_slugs(concepts.withColumn("slug", slugify("title")), "slug", "uri", "nth")
        made = materialize(made.select("uri", "nth", path("unique_slug"), "title", "blocks", "description", "at"), "concepts")
    text = F.array_join(F.transform("blocks", lambda b: digest_text(b["text"])), " ")
    links = related(made.select("path", "title", text.alias("text")), "path", "title", "text")
    links = links.join(made.select(F.col("path").alias("other"), F.col("title").alias("other_title")), "other")
    links = links.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "other", "other_title"))), lambda x: F.concat(F.lit("- ["), x["other_title"], F.lit("](/"), x["other"], F.lit(")"))), "\n").alias("related"))
    full = made.join(digests(made, "path"), "path").join(links, "path", "left").join(docs.select("uri", "source_id", "ref", F.col("title").alias("source_title")), "uri")
    quote = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    head = F.concat(F.lit("---\ntype: Concept\ntitle: "), quote(F.col("title")), F.lit("\ndescription: "), quote(F.col("description")), F.lit(f"\nstatus: draft\ngenerated:\n  by: {generator}\n  at: '"), F.col("at"), F.lit("'\nsources:\n- id: "), F.col("source_id"), F.lit("\n  resource: "), F.col("ref"), F.lit("\n  title: "), quote(F.col("source_title")), F.lit("\n---\n\n"))
    body = F.concat_ws("\n\n", F.concat(F.lit("# Summary\n\n"), "description", F.lit("[^"), "source_id", F.lit("]")), F.nullif(F.col("digest"), F.lit("")), F.concat(F.lit("# Related\n\n"), "related"),
                       F.concat(F.lit("# Sources\n\n- ["), "source_title", F.lit("](/"), "ref", F.lit(")")), F.concat(F.lit("[^"), "source_id", F.lit("]: "), "source_title", F.lit(" ("), "uri", F.lit(")")))
    written = full.select(F.col("path").alias("rel_path"), F.concat(head, body, F.lit("\n")).alias("content"))
    ref_head = F.concat(F.lit("---\ntype: Reference\ntitle: "), quote(F.col("title")), F.lit("\nuri: "), quote(F.col("uri")), F.lit("\nsource_hash: "), F.col("source_hash"), F.lit("\nretrieved_at: '"), F.col("retrieved_at"), F.lit("'\ncontent_hash: "), content_hash("blocks"), F.lit("\n---\n\n"))
    references = docs.select(F.col("ref").alias("rel_path"), F.concat(ref_head, render(F.col("blocks")), F.lit("\n")).alias("content"))
    entry = lambda p, title, d: F.struct(F.col(p).alias("p"), F.concat(F.lit("- ["), F.col(title), F.lit("](/"), F.col(p), F.lit(") - "), first_sentence(d)).alias("line"))
    acquired = F.concat(F.lit("Acquired source snapshot of "), F.col("title"), F.lit("."))
    # the root index is one file and lists everything; only its finished lines are gathered
    listed = lambda df, e: df.select(e.alias("e")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["line"]), "\n").alias("lines"))
    lines = listed(made, entry("path", "title", F.col("description"))).select(F.col("lines").alias("c")).join(listed(docs, entry("ref", "title", acquired)).select(F.col("lines").alias("r")))
    index = F.concat(F.lit(f"---\nokf_version: '0.2'\ntitle: {name}\n---\n\n# {name}\n\n"), F.when(F.col("c") != "", F.concat(F.lit("## Concepts\n\n"), "c", F.lit("\n\n## References\n\n"), "r")).otherwise(F.lit("No concepts yet.")), F.lit("\n"))
    return written.unionByName(references).unionByName(lines.select(F.lit("index.md").alias("rel_path"), index.alias("content")))

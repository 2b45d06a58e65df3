"""Navigation under a budget: which documents a question's answer reads, as an ordered log of priced calls.

A question looks at the overview, searches, peeks at its candidates, reads them, and follows links of
the concepts it has read.  Each call costs the characters of its result as JSON; before each peek, read
and look at links what was spent so far is held against the budget, and the first call beyond it ends
the navigation.  No call's result changes which calls come before it, so the whole log is laid out first,
all questions at once, and cut where its running sum reaches the budget.  Its length a question is
bounded by the policy.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import clip_words, estimate_tokens, is_external, links, resolve_target
from marlstone.operators.bundle import CONTENTS, CONTENTS_CHARS, PEEK_CHARS, READ_CHARS, histogram, is_concept, is_reference
from marlstone.operators.graph import NEIGHBOURS

#: Lines of a peek; documents that a conversation carries over.
PEEK, CARRIED = 20, 2


# -- characters of JSON ------------------------------------------------------------------------------


def text(x: Column) -> Column:
    """Characters of a JSON string, or of ``null``."""
    return F.coalesce(F.length(F.to_json(F.struct(x.alias("a")), {"ignoreNullFields": "false"})) - 6, F.lit(4))


def number(x: Column) -> Column:
    return F.length(F.coalesce(x.cast("string"), F.lit("null")))


def truth(x: Column) -> Column:
    return F.when(x, 4).otherwise(5)


def listing(sizes: Column) -> Column:
    """Characters of a list whose entries have the given sizes."""
    return F.aggregate(sizes, F.lit(0), lambda n, x: n + x) + 2 * F.greatest(F.size(sizes) - 1, F.lit(0)) + 2


def fields(**sizes: Column) -> Column:
    """Characters of an object whose values have the given sizes."""
    names = sum(len(k) + 4 for k in sizes) + 2 * (len(sizes) - 1) + 2
    return reduce(lambda a, b: a + b, sizes.values(), F.lit(names))


def matter_of(docs: DataFrame) -> DataFrame:
    """Adds ``matter``, the frontmatter as JSON, where ``docs`` don't bring it: title, description, tags and status that are there."""
    if "matter" in docs.columns:
        return docs
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("a"))), r"(?s)^\{\"a\":(.*)\}$", 1)
    tags = F.concat(F.lit("["), F.array_join(F.transform("tags", lambda t: F.regexp_extract(F.to_json(F.struct(t.alias("a"))), r"(?s)^\{\"a\":(.*)\}$", 1)), ", "), F.lit("]"))
    entry = lambda c, value: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{c}": '), value))
    parts = F.concat_ws(", ", entry("title", quoted("title")), entry("description", quoted("description")), entry("tags", tags), entry("status", quoted("status")))
    return docs.withColumn("matter", F.concat(F.lit("{"), parts, F.lit("}")))


def prices(docs: DataFrame, today: str | None = None) -> DataFrame:
    """``(path, peek, read)``: characters of a peek at each document, and of reading it from its start."""
    body, lines = F.coalesce("body", F.lit("")), F.split(F.coalesce("body", F.lit("")), "\n")
    start = F.substring(F.array_join(F.slice(lines, 1, PEEK), "\n"), 1, PEEK_CHARS)
    page = F.substring(body, 1, READ_CHARS)
    cut = F.length(page) < F.length(body)
    matter = F.length("matter")

    def link(x: Column) -> Column:
        outside = is_external(x["target"])
        return fields(text=text(x["text"]), target=text(x["target"]), external=truth(outside), resolved=text(F.when(~outside, resolve_target(x["target"], F.col("path")))))

    stale = F.lit(False) if today is None else F.coalesce(F.col("stale_after") < F.lit(today), F.lit(False))
    peek = fields(path=text(F.col("path")), frontmatter=matter, body_start=text(start), body_lines_total=number(F.size(lines)), truncated=truth((F.size(lines) > PEEK) | (F.length(start) < F.length(body))))
    read = fields(
        path=text(F.col("path")), frontmatter=matter, body=text(page), chars=number(F.length(page)), start_char=F.lit(1), body_total_chars=number(F.length(body)), next_start=number(F.when(cut, F.length(page))),
        truncated=truth(cut), links=listing(F.transform(links(body), link)), stale_after=text(F.col("stale_after")), stale=truth(stale),
    )
    return matter_of(docs).select("path", peek.alias("peek"), read.alias("read"))


def overview_price(docs: DataFrame, title: str, description: str | None = None, revision: str | None = None, today: str | None = None) -> int:
    """Characters of the overview of ``docs(path, title, description, tags, body, status, stale_after, verified)``, its contents in order of path."""
    import json

    concepts = docs.where(is_concept(F.col("path")))
    shown = docs.where(is_concept(F.col("path")) | is_reference(F.col("path")))
    kind = F.col("type") if "type" in docs.columns else F.lit(None).cast("string")
    entry = fields(path=text(F.col("path")), title=text(F.coalesce("title", "path")), type=text(kind), description=text(clip_words("description", CONTENTS_CHARS)))
    first = [r[0] for r in shown.orderBy("path").limit(CONTENTS).select(entry).collect()]
    verified = F.coalesce(F.size("verified") > 0, F.lit(False))
    stale = F.lit(0) if today is None else F.count_if(F.col("stale_after") < F.lit(today))
    n = concepts.agg(F.count("*").alias("concepts"), F.count_if(verified).alias("verified"), stale.alias("stale")).first()
    n_shown = shown.count()

    def counted(rows: DataFrame, name: str) -> int:
        """Characters of the object of a histogram."""
        found = histogram(rows, name).where(F.col("value").isNotNull() & (F.col("value") != ""))
        x = found.agg(F.coalesce(F.sum(text(F.col("value")) + 2 + number(F.col("n"))), F.lit(0)), F.count("*")).first()
        return x[0] + 2 * max(x[1] - 1, 0) + 2

    def objects(sizes: list[int]) -> int:
        return sum(sizes) + 2 * max(len(sizes) - 1, 0) + 2

    typed = concepts.select(kind.alias("type"))
    rest = {"title": title, "description": description, "revision_id": revision, "revision_pinned": revision is not None, "counts": {"concepts": n["concepts"], "references": n_shown - n["concepts"]}, "contents": 0, "contents_total": n_shown, "types": 0, "tags": 0,
            "trust": {"statuses": 0, "verified": n["verified"], "unverified": n["concepts"] - n["verified"]}, "freshness": {"stale": n["stale"]}}
    placeholders = 4  # a digit for each of contents, types, tags and statuses
    return len(json.dumps(rest, ensure_ascii=False)) - placeholders + objects(first) + counted(typed, "type") + counted(concepts.select(F.explode("tags").alias("tag")), "tag") + counted(concepts, "status")


def search_prices(questions: DataFrame, found: DataFrame, docs: DataFrame, snippet: Callable[[Column, Column], Column]) -> DataFrame:
    """``(qid, chars)``: characters of each question's search result; ``snippet`` makes a hit's snippet of its body and the question."""
    hits = found.join(docs.select("path", "title", "description", "body"), "path").join(questions.select("qid", "text"), "qid")
    said = clip_words(F.coalesce("description", F.lit("")), 300)
    one = fields(path=text(F.col("path")), kind=text(F.col("kind")), title=text(F.coalesce("title", "path")), description=text(said), snippet=text(snippet(F.col("body"), F.col("text"))), score=number(F.col("score")))
    sums = hits.select("qid", one.alias("one")).groupBy("qid").agg(F.collect_list("one").alias("sizes"))  # a search's hits are bounded
    return questions.select("qid", "text").join(sums, "qid", "left").select("qid", fields(query=text(F.col("text")), results=listing(F.coalesce("sizes", F.array().cast("array<int>")))).alias("chars"))


# -- candidates and the log --------------------------------------------------------------------------


def candidates(found: DataFrame, reads: int, carried: DataFrame | None = None) -> DataFrame:
    """``(qid, path, pos, carried)``: the documents a question may read, best first, at most ``reads``.

    ``found(qid, path, rank, kind)`` are search hits; concepts among them count, references only where
    there is no candidate otherwise.  ``carried(qid, path, nth)`` are documents that the conversation is
    on: its first ``CARRIED`` concepts, repeats left out, come before all hits, whether they exist or not.
    """
    rows = found.where("kind = 'concept'").select("qid", "path", (F.col("rank") + 1000).cast("long").alias("at"))
    if carried is not None:
        first = carried.where(is_concept(F.col("path"))).groupBy("qid", "path").agg(F.min("nth").cast("long").alias("at"))
        nth = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
        rows = rows.unionByName(first.withColumn("n", nth).where(F.col("n") <= CARRIED).select("qid", "path", F.col("n").cast("long").alias("at")))
    rows = rows.groupBy("qid", "path").agg(F.min("at").alias("at"))
    behind = found.where("kind = 'reference'").join(rows.select("qid").distinct(), "qid", "left_anti")
    rows = rows.unionByName(behind.select("qid", "path", (F.col("rank") + 1000).cast("long").alias("at")))
    order = Window.partitionBy("qid").orderBy("at")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= reads).select("qid", "path", "pos", (F.col("at") < 1000).alias("carried"))


def targets(seeds: DataFrame, edges: DataFrame, known: DataFrame, fanout: int) -> DataFrame:
    """``(qid, via, pos, at, path, hop, before)``: what the links of each seed concept lead to, in the order they are looked at.

    ``hop`` numbers the documents that are followed, null for those already read, seen before or no
    concept; ``before`` counts the documents followed earlier.  A seed shows its first links by name.
    """
    own = edges.select("src", "dst").distinct().join(known.select(F.col("path").alias("dst")), "dst", "left_semi")
    own = own.join(seeds.select(F.col("path").alias("src")).distinct(), "src", "left_semi")
    own = own.withColumn("at", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("at") <= NEIGHBOURS)
    rows = seeds.where(is_concept(F.col("path"))).select("qid", "pos", F.col("path").alias("src")).join(own, "src")
    read = seeds.select("qid", F.col("path").alias("dst"), F.lit(True).alias("is_read"))
    rows = rows.join(read, ["qid", "dst"], "left")
    first = F.row_number().over(Window.partitionBy("qid", "dst").orderBy("pos")) == 1
    rows = rows.withColumn("new", first & F.col("is_read").isNull() & is_concept(F.col("dst")))
    earlier = Window.partitionBy("qid").orderBy("pos", "at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.col("new").cast("int")).over(earlier), F.lit(0)).cast("int")).where(F.col("before") < fanout)
    return rows.select("qid", F.col("src").alias("via"), "pos", "at", F.col("dst").alias("path"), F.when(F.col("new"), F.col("before") + 1).alias("hop"), "before")


def call_log(questions: DataFrame, seeds: DataFrame, searched: DataFrame | None, docs: DataFrame, edges: DataFrame, fanout: int, budget: int | None = None, overview: int = 0, today: str | None = None) -> DataFrame:
    """``(qid, nth, tool, path, via, pos, hop, chars, spent, exhausted)``: the calls each question makes, in order.

    ``seeds`` are ``candidates`` that exist, ``searched(qid, chars)`` the prices of the searches (None: nothing
    is priced), ``overview`` that of the overview.  ``spent`` are the characters spent with the call; ``exhausted`` says
    of the question whether its budget (in tokens; None: without bound) kept it from something.
    """
    looked = targets(seeds, edges, docs, fanout)
    if searched is None:
        searched, paths = questions.select("qid", F.lit(0).alias("chars")), seeds.select("path").unionAll(looked.select("path")).distinct()
        priced = degree = paths.select("path", *[F.lit(0).alias(c) for c in ("peek", "read", "edges")])
    else:
        priced = prices(docs.join(seeds.select("path").unionAll(looked.where("hop is not null").select("path")).distinct(), "path", "left_semi"), today)
        degree = _edge_prices(seeds, edges, docs)
    none, no = F.lit(None).cast("string"), F.lit(None).cast("int")

    def row(df: DataFrame, a: Column, b: Column, c: Column, tool: str, path: Column, chars: Column, via: Column = none, pos: Column = no, hop: Column = no) -> DataFrame:
        return df.select("qid", F.array(a.cast("int"), b.cast("int"), c.cast("int")).alias("order"), F.lit(tool).alias("tool"), path.alias("path"), via.alias("via"), pos.cast("int").alias("pos"), hop.cast("int").alias("hop"), chars.cast("long").alias("chars"))

    z, pos, path = F.lit(0), F.col("pos"), F.col("path")
    own = seeds.join(priced, "path")
    concepts = seeds.where(is_concept(path)).join(degree, "path")
    # links of a seed are looked at while fewer than ``fanout`` were followed from the seeds before it
    full = looked.where(F.col("hop") == fanout).select("qid", F.col("pos").alias("last"))
    concepts = concepts.join(full, "qid", "left").where(F.col("last").isNull() | (pos <= F.col("last")))
    hops = looked.join(priced, "path", "left")
    rows = [
        row(questions, F.lit(0), z, z, "overview", none, F.lit(overview)),
        row(searched, F.lit(1), z, z, "search", none, F.col("chars")),
        row(own, F.lit(2), pos, z, "peek", path, F.col("peek"), pos=pos),
        row(own, F.lit(3), pos, z, "read", path, F.col("read"), pos=pos),
        row(concepts, F.lit(4), pos, z, "links", path, F.col("edges"), pos=pos),
        row(hops.where("hop is not null"), F.lit(4), pos, F.col("at"), "read", path, F.col("read"), F.col("via"), hop=F.col("hop")),
        row(hops.where("hop is null"), F.lit(4), pos, F.col("at"), "", path, z, F.col("via")),  # looked at and left out
    ]
    log = reduce(DataFrame.unionByName, rows)
    earlier = Window.partitionBy("qid").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("before", F.coalesce(F.sum("chars").over(earlier), F.lit(0)))
    made = (F.col("order")[0] < 2) | (F.lit(True) if budget is None else estimate_tokens("before") < budget)
    log = log.withColumn("made", made)
    # targets behind links that weren't looked at anymore are out of reach, not out of budget
    reached = F.max(F.when(F.col("tool") == "links", F.col("made"))).over(Window.partitionBy("qid", F.col("order")[0], F.col("order")[1]))
    kept_from = ~F.col("made") & (F.col("tool") != "links") & F.when(F.col("order")[0] == 4, reached).otherwise(F.lit(True))
    log = log.withColumn("kept_from", kept_from).withColumn("exhausted", F.max("kept_from").over(Window.partitionBy("qid")))
    calls = log.where(F.col("made") & (F.col("tool") != ""))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("order"))
    return calls.select("qid", nth.alias("nth"), "tool", "path", "via", "pos", "hop", "chars", (F.col("before") + F.col("chars")).alias("spent"), "exhausted")


def _edge_prices(seeds: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """``(path, edges)``: characters of a look at the links of each seed: its first ones by name either way, and their numbers."""
    paths, out = seeds.select("path").distinct(), None
    inner = edges.select("src", "dst").distinct().join(known.select(F.col("path").alias("dst")), "dst", "left_semi")
    for name, here, there in (("outbound", "src", "dst"), ("inbound", "dst", "src")):
        rows = inner.select(F.col(here).alias("path"), F.col(there).alias("other")).join(paths, "path", "left_semi")
        nth = F.row_number().over(Window.partitionBy("path").orderBy("other"))
        first = rows.withColumn("nth", nth).where(F.col("nth") <= NEIGHBOURS).groupBy("path").agg(F.sum(text(F.col("other")) + 2).alias(name))
        side = rows.groupBy("path").agg(F.count("*").alias(f"n_{name}")).join(first, "path")
        out = side if out is None else out.join(side, "path", "full")
    size = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(2))  # noqa: E731  the brackets stand for the comma too many
    n = lambda c: number(F.coalesce(c, F.lit(0)))
    priced = fields(path=text(F.col("path")), outbound=size("outbound"), inbound=size("inbound"), outbound_total=n("n_outbound"), inbound_total=n("n_inbound"))
    return paths.join(out, "path", "left").select("path", priced.alias("edges"))

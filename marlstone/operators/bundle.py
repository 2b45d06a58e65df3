"""Bundles of files as tables: roles, listing, bounded reads, manifests, revisions and differences.

``files(rel_path, content)`` is the base table; parsed concepts add frontmatter columns.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import estimate_tokens, links, log_entry
from marlstone.session import materialize

LIST_MOST, PEEK_LINES, PEEK_CHARS, READ_CHARS, LINKS_MOST, HISTORY_MOST = 200, 100, 8_000, 40_000, 32, 100
CONTENTS, CONTENTS_CHARS = 25, 240
#: Fixed value: characters of frontmatter that a view shows.
MATTER_CHARS = 8_000
BOOKKEEPING = ("index.md", "log.md", "manifest.json")


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def is_reference(path: Column) -> Column:
    return path.startswith("references/")


def is_index(path: Column) -> Column:
    return F.substring_index(path, "/", -1) == "index.md"


def is_concept(path: Column) -> Column:
    return path.endswith(".md") & ~is_index(path) & (path != "log.md") & ~is_reference(path)


def kind(path: Column) -> Column:
    return F.when(is_reference(path), "reference").when(is_index(path), "index").otherwise("concept")


def role(path: Column) -> Column:
    """index, log, manifest, reference, concept or other."""
    return (
        F.when(is_index(path), "index").when(path == "log.md", "log").when(path == "manifest.json", "manifest")
        .when(is_reference(path), "reference").when(path.endswith(".md"), "concept").otherwise("other")
    )


def path_order(path: Column) -> Column:
    """Orders paths part by part, so ``a/b`` comes before ``a-b``."""
    return F.split(path, "/")


def safe_path(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested paths that name a visible Markdown file of the bundle exactly; others are refused."""
    p = F.col("rel_path")
    ok = (p != "") & ~p.startswith("/") & ~p.contains("\\") & ~F.exists(F.split(p, "/"), lambda x: x.isin("", ".", "..")) & ~is_hidden(p) & p.endswith(".md")
    return requested.where(ok).join(files.select("rel_path"), "rel_path", "left_semi")


def listing(concepts: DataFrame, path: str, directory: str = "", *filters: Column, limit: int = 50) -> DataFrame:
    """Filtered concepts by path with the total before the limit (1 to 200)."""
    kept = concepts.where(F.col(path).startswith(directory))
    for f in filters:
        kept = kept.where(f)
    total = kept.agg(F.count("*").alias("total"))  # one row
    top = kept.orderBy(path).limit(max(1, min(limit, LIST_MOST)))
    return top.join(F.broadcast(total))


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    """``(facet, value, n)`` for each column, in one pass of grouping sets."""
    faces = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(faces).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def peek(text: Column, lines: int = 20) -> Column:
    """The first lines (1 to 100), at most 8000 characters."""
    n = max(1, min(lines, PEEK_LINES))
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n"), 1, PEEK_CHARS)


def read_page(df: DataFrame, text: str, max_chars: int = READ_CHARS, start: int = 0) -> DataFrame:
    """Adds ``page``, ``next_start`` (null at the end) and ``total_chars``; links come from the whole body."""
    size = max(1, min(max_chars, READ_CHARS))
    total = F.length(text)
    return df.withColumns({
        "page": F.substring(F.col(text), start + 1, size),
        "next_start": F.when(total > start + size, F.lit(start + size)),
        "total_chars": total,
        "links": links(text),
    })


def freshness(stale_after: Column, today: str | None) -> Column:
    """Stale when the text of the date lies before today's; unknown without one of them."""
    return F.lit(None).cast("boolean") if today is None else stale_after < F.lit(today)


def trust_tier(verified: Column) -> Column:
    """human-reviewed, machine-confirmed or unverified, from ``array<struct<by, at>>``."""
    human = F.exists(verified, lambda v: v["by"].startswith("human:"))
    return F.when(F.coalesce(F.size(verified), F.lit(0)) <= 0, "unverified").when(human, "human-reviewed").otherwise("machine-confirmed")


def trust_warnings(path: Column, status: Column, stale_after: Column, verified: Column, today: str | None) -> Column:
    """Warnings beside one cited concept."""
    stale = F.lit(False) if today is None else stale_after < F.lit(today)
    return F.array_compact(F.array(
        F.when(status == "draft", F.concat(path, F.lit(": status is draft — content is unreviewed")))
        .when(status == "deprecated", F.concat(path, F.lit(": status is deprecated — may no longer apply"))),
        F.when(stale, F.concat(path, F.lit(": stale since "), stale_after)),
        F.when(~verified, F.concat(path, F.lit(": unverified — no verification record"))),
    ))


def history(log: DataFrame, text: str = "content", limit: int = 20) -> DataFrame:
    """Revisions of a log, newest (last line) first."""
    rows = log.select(F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("pos", "line")).withColumn("e", log_entry("line"))
    rows = rows.where("e.revision is not null").select("pos", "e.revision", "e.summary")
    return rows.orderBy(F.desc("pos")).limit(max(1, min(limit, HISTORY_MOST))).drop("pos")


def manifest(files: DataFrame) -> DataFrame:
    """``(rel_path, sha256, bytes)`` of every file but the manifest itself."""
    return files.where(F.col("rel_path") != "manifest.json").select("rel_path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


#: Children of a node of the hash tree, as hexadecimal digits; files of a leaf node, about.
DIGITS, LEAF = 1, 16


def tree_depth(n: int) -> int:
    """Levels below the root of a hash tree over ``n`` files."""
    depth = 0
    while n > LEAF * 16 ** (DIGITS * depth):
        depth += 1
    return depth


def hash_tree(leaves: DataFrame, depth: int) -> list[DataFrame]:
    """``(prefix, digest)`` of each level of the hash tree over ``leaves(rel_path, sha256)``, the root first.

    A file belongs to the nodes whose prefix the hash of its path begins with, so a node has 16 children
    or about 16 files, however many files a folder has: no group grows with the tree.  A node's digest
    is SHA-256 over its children's prefixes and digests (a leaf node's: its files' paths and hashes) in order.
    """
    entry = F.concat_ws("\0", F.sha2("rel_path", 256), F.sha2(F.concat_ws("\0", "rel_path", "sha256"), 256))
    nodes = leaves.select(F.substring(F.sha2("rel_path", 256), 1, DIGITS * depth).alias("prefix"), entry.alias("entry"))
    levels = []
    for d in range(depth, -1, -1):
        level = nodes.groupBy("prefix").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "\n"), 256).alias("digest"))
        levels.append(level)
        nodes = level.select(F.substring("prefix", 1, DIGITS * max(d - 1, 0)).alias("prefix"), F.concat_ws("\0", "prefix", "digest").alias("entry"))
    return levels[::-1]


def revision_id(files: DataFrame) -> str:
    """Content-derived id of a tree: the root of its hash tree, without log, manifest and hidden files.

    Files are hashed where they are; only their number and the root come to the driver.
    """
    kept = files.where(~F.col("rel_path").isin("log.md", "manifest.json") & ~is_hidden(F.col("rel_path")))
    leaves = materialize(kept.select("rel_path", F.sha2("content", 256).alias("sha256")), "leaves")
    n = leaves.count()
    root = hash_tree(leaves, tree_depth(n))[0].first()
    return f"rev-{hashlib.sha256(f'{n} {root.digest if root else str()}'.encode()).hexdigest()[:12]}"


def diff_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """``tree_diff`` of two trees ``(rel_path, sha256)`` that goes down only where digests differ.

    Equal trees are told by their roots; of others only the files of differing leaf nodes are held
    against each other, so a small change to a large tree compares few files.
    """
    a, b = [materialize(x.select("rel_path", "sha256"), "leaves") for x in (a, b)]
    depth = tree_depth(max(a.count(), b.count()))
    differing = None
    for d, (x, y) in enumerate(zip(*[[materialize(level, "level") for level in hash_tree(t, depth)] for t in (a, b)])):
        parent = F.substring("prefix", 1, DIGITS * max(d - 1, 0)).alias("parent")
        x, y = x.select("prefix", "digest", parent), y.select("prefix", "digest", parent)
        if differing is not None:
            up = differing.select(F.col("prefix").alias("parent"))
            x, y = x.join(up, "parent", "left_semi"), y.join(up, "parent", "left_semi")
        both = x.select("prefix", F.col("digest").alias("x")).join(y.select("prefix", F.col("digest").alias("y")), "prefix", "full")
        differing = materialize(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("prefix"), "differing")
        if differing.isEmpty():
            break
    own = lambda t: t.withColumn("prefix", F.substring(F.sha2("rel_path", 256), 1, DIGITS * depth)).join(differing, "prefix", "left_semi").drop("prefix")
    return tree_diff(own(a), own(b)) if not differing.isEmpty() else tree_diff(a.limit(0), b.limit(0))


def tree_diff(a: DataFrame, b: DataFrame, key: str = "rel_path", value: str = "sha256") -> DataFrame:
    """``(key, change)``: added, removed or changed from a to b."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    joined = left.join(right, key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return joined.select(key, change.alias("change")).where("change is not null")


def edge_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(src, dst, change)`` between two edge sets."""
    added = b.select("src", "dst").subtract(a.select("src", "dst")).withColumn("change", F.lit("added"))
    return added.unionByName(a.select("src", "dst").subtract(b.select("src", "dst")).withColumn("change", F.lit("removed")))


def diff_revisions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Changes of content files with their role, new and old titles, and whether a concept was retitled.

    Both sides are ``files(rel_path, content, title, pin)``; bookkeeping files are left out.
    """
    side = lambda df: df.where(~F.col("rel_path").isin(*BOOKKEEPING)).withColumn("sha256", F.sha2("content", 256))
    x, y = side(a), side(b)
    out = tree_diff(x, y)
    out = out.join(x.select("rel_path", F.col("title").alias("title_a"), F.col("pin").alias("pin_a")), "rel_path", "left")
    out = out.join(y.select("rel_path", F.col("title").alias("title_b"), F.col("pin").alias("pin_b")), "rel_path", "left")
    p, both = F.col("rel_path"), F.col("change") == "changed"
    return out.select("rel_path", role(p).alias("role"), "change", "title_a", "title_b",
                      (both & ~F.col("title_a").eqNullSafe(F.col("title_b"))).alias("retitled"), (both & ~F.col("pin_a").eqNullSafe(F.col("pin_b"))).alias("repinned"))


def bounded(fields: dict, most: int = MATTER_CHARS) -> dict:
    """Fields in order while their JSON fits ``most`` characters; the one that doesn't is clipped to what is left, further ones are left out and ``_truncated`` says so."""
    out: dict = {}
    for key, value in fields.items():
        said = json.dumps(value, ensure_ascii=False, default=str)
        if len(said) > most:
            clipped = {str(key): said[:most] + "…[truncated]"} if most > 0 else {}
            return out | clipped | {"_truncated": True}
        out[str(key)] = value
        most -= len(said)
    return out


def bounded_json(frontmatter: Column | str, most: int = MATTER_CHARS) -> Column:
    """``bounded`` of frontmatter given as JSON, as JSON; null is an empty object.  Texts that fit aren't read."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if len(t) <= most else json.dumps(bounded(json.loads(t), most), ensure_ascii=False))

    return cut(F.coalesce(F.col(frontmatter) if isinstance(frontmatter, str) else frontmatter, F.lit("{}")))


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order (not just any one)."""
    rows = df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return rows.where("_nth = 1").drop("_nth")


def unique_slugs(df: DataFrame, slug: str, *order: str) -> DataFrame:
    """Adds ``unique_slug``: in the given order each row takes the first of its slug, ``slug-2``, ``slug-3``, .. that none before it has.

    A made name may be another row's own slug (``x``, ``x``, ``x-2``).  Rows first take the name of their
    number among equal slugs; of rows with one name the first keeps it, the others and those behind them
    of the same slug move on, until no name repeats.  That ends with the names that taking them one after
    another gives.  Repeats are rare, so rounds are few; each is written.
    """
    key = F.struct(*order)
    same = Window.partitionBy("_slug").orderBy("_order")
    rows = df.withColumns({"_slug": F.col(slug), "_order": key}).withColumn("_n", F.row_number().over(same)).withColumn("_k", F.col("_n"))
    named = lambda x: x.withColumn("unique_slug", F.when(F.col("_k") == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), F.col("_k").cast("string"))))
    while True:
        rows = materialize(named(rows), "names")
        late = rows.withColumn("_late", (F.row_number().over(Window.partitionBy("unique_slug").orderBy("_order")) > 1).cast("int"))
        if late.where("_late = 1").isEmpty():
            return rows.drop("_slug", "_order", "_n", "_k")
        ahead = F.max(F.col("_k") + F.col("_late") - F.col("_n")).over(same.rowsBetween(Window.unboundedPreceding, 0))
        rows = late.withColumn("_k", F.col("_n") + ahead).drop("_late", "unique_slug")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``nth``, 1 onwards in the given order, without putting all rows into one task.

    Rows are sorted by ranges and written; each range's numbers begin after the rows before it.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}  # one row a partition
    starts, total = [], 0
    for k in sorted(sizes):
        starts.append((k, total))
        total += sizes[k]
    before = df.sparkSession.createDataFrame(starts, "_range int, _before long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(before, "_range").withColumn("nth", own + F.col("_before")).drop("_range", "_before")


def source_ids(df: DataFrame, *order: str) -> DataFrame:
    """``source-001`` onwards in acquisition order."""
    return numbered(df, *order).withColumn("source_id", F.format_string("source-%03d", "nth")).drop("nth")


def contents(concepts: DataFrame, order: DataFrame, most: int = CONTENTS) -> DataFrame:
    """``concepts(path)`` in the order ``order(path, pos)`` of the root index's links, others by path behind: the first ones, and the total."""
    first = order.groupBy("path").agg(F.min("pos").alias("pos"))
    total = concepts.agg(F.count("*").alias("total"))  # one row
    top = concepts.join(first, "path", "left").orderBy(F.asc_nulls_last("pos"), "path").limit(most)
    nth = F.row_number().over(Window.orderBy(F.asc_nulls_last("pos"), "path"))  # of at most ``most`` rows
    return top.withColumn("nth", nth).drop("pos").join(F.broadcast(total))


def overview(concepts: DataFrame, references: DataFrame, today: str | None) -> DataFrame:
    """One row of counts over ``concepts(path, status, verified, stale_after)``."""
    stale = F.lit(0) if today is None else F.count_if(F.col("stale_after") < F.lit(today))
    counts = concepts.agg(
        F.count("*").alias("concepts"),
        F.count_if(F.size("verified") > 0).alias("verified"),
        F.count_if(~(F.coalesce(F.size("verified"), F.lit(0)) > 0)).alias("unverified"),
        stale.cast("long").alias("stale"),
    )
    return counts.join(references.agg(F.count("*").alias("references")))


def budget(chars: Column) -> Column:
    return estimate_tokens(chars)

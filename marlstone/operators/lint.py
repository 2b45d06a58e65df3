"""Bundle lint: each rule is a frame of findings; a report is their union.

Input is the parsed table of ``sources.markdown.parse_files``: ``rel_path, content, error, message,
has_frontmatter, frontmatter (variant as JSON text), body, type, title, status, ..``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import footnote_definitions, footnote_references, is_external, links, normalize_path, ratio, resolve_target, strip
from marlstone.operators.bundle import is_concept, is_index, is_reference
from marlstone.operators.graph import broken_links

LARGE = 50_000
STATUSES = ("draft", "stable", "deprecated")
ERROR, WARNING, INFO = "error", "warning", "info"


def finding(df: DataFrame, code: str, severity: str, message: Column, path: str | Column = "rel_path") -> DataFrame:
    """``(level, severity, code, path, message)`` for every row."""
    return df.select(F.lit(code.split("/")[0]).alias("level"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.col(path) if isinstance(path, str) else path).alias("path"), message.alias("message"))


def valid_datetime(x: Column) -> Column:
    """ISO-8601 date with an optional time."""
    return F.coalesce(F.try_to_timestamp(x).isNotNull() & x.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.lit(False))


def escapes(path: Column) -> Column:
    """Absolute, or leaving the root once normalised."""
    return path.startswith("/") | path.startswith("\\") | normalize_path(F.ltrim(path, F.lit("/"))).startswith("..")


def lint(files: DataFrame, parsed: DataFrame, manifest: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """All findings of a bundle.

    ``files(rel_path, content)`` are all visible files; ``parsed`` are its Markdown files that are
    no references; ``manifest(rel_path, sha256)`` are the entries of a manifest, if there is one.
    """
    spark, out = files.sparkSession, []
    names = files.select("rel_path")
    text = files.where("rel_path = 'manifest.json'").select("rel_path", F.decode("content", "utf-8").alias("text"))
    out.append(finding(text.where(F.try_parse_json("text").isNull()), "conformance/invalid-manifest", ERROR, F.lit("manifest.json is not valid JSON")))
    one = spark.range(1)
    for name, code, sev, msg in (("index.md", "conformance/missing-index", ERROR, "bundle has no root index.md"), ("log.md", "hygiene/missing-log", WARNING, "bundle has no revision-level log.md")):
        missing = one.join(names.where(F.col("rel_path") == name).select(F.lit(0).cast("long").alias("id")), "id", "left_anti")
        out.append(finding(missing, code, sev, F.lit(msg), F.lit("")))
    if manifest is not None:
        target = normalize_path(F.ltrim(F.col("rel_path"), F.lit("/")))
        entries = manifest.withColumn("target", target).withColumn("bad", F.col("rel_path").startswith("/") | F.col("target").startswith(".."))
        out.append(finding(entries.where("bad"), "integrity/path-traversal", ERROR, F.concat(F.lit("manifest entry escapes the bundle root: "), "rel_path"), F.lit("manifest.json")))
        actual = files.select(F.col("rel_path").alias("target"), F.sha2("content", 256).alias("actual"))
        joined = entries.where("not bad").join(actual, "target", "left")
        out.append(finding(joined.where("actual is null"), "integrity/manifest-missing-file", ERROR, F.concat(F.lit("manifest lists a file that does not exist: "), "rel_path"), F.lit("manifest.json")))
        wrong = joined.where("actual is not null and sha256 is not null and actual <> sha256")
        out.append(finding(wrong, "integrity/checksum-mismatch", ERROR, F.concat(F.lit("sha256 mismatch: manifest says "), "sha256", F.lit(", file is "), "actual"), "target"))
    for error, code in (("encoding", "conformance/invalid-encoding"), ("yaml", "conformance/unparseable-frontmatter"), ("shape", "conformance/invalid-frontmatter-shape")):
        out.append(finding(parsed.where(F.col("error") == error), code, ERROR, F.col("message")))
    good = parsed.where("error is null")
    concepts = good.where(is_concept(F.col("rel_path")))
    out += concept_rules(concepts, large)
    out += graph_rules(good, concepts, files)
    result = out[0]
    for frame in out[1:]:
        result = result.unionByName(frame)
    return result


def not_a_bundle(spark: SparkSession, root: str) -> DataFrame | None:
    """The one finding of a root that is no folder, else None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path) and fs.getFileStatus(path).isDirectory():
        return None
    return finding(spark.range(1), "conformance/not-a-bundle", ERROR, F.lit(f"{root} is not a directory"), F.lit(""))


def concept_rules(concepts: DataFrame, large: int = LARGE) -> list[DataFrame]:
    """Row-local rules of concept files."""
    matter = concepts.where("has_frontmatter")
    blank = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    rules = [
        (concepts.where("not has_frontmatter"), "conformance/missing-frontmatter", ERROR, F.lit("concept file has no frontmatter block")),
        (matter.where(blank("type")), "conformance/missing-type", ERROR, F.lit("concept frontmatter has no non-empty `type`")),
        (matter.where(blank("title")), "hygiene/missing-title", WARNING, F.lit("concept frontmatter has no title")),
        (matter.where(F.coalesce(F.size("sources"), F.lit(0)) <= 0), "quality/no-sources", INFO, F.lit("concept declares no sources (source coverage)")),
        (concepts.where(blank("body")), "hygiene/empty-body", WARNING, F.lit("concept body is empty")),
        (concepts.where(F.length("body") > large), "quality/large-concept", INFO, F.concat(F.lit("concept body is "), F.length("body").cast("string"), F.lit(f" chars (threshold {large})"))),
        (matter.where("status_given and not coalesce(status in ('draft', 'stable', 'deprecated'), false)"), "provenance/invalid-status", WARNING, F.concat(F.lit("status "), "status_text", F.lit(f" is not one of {', '.join(STATUSES)}"))),
        (matter.where("generated_given and not generated_valid"), "provenance/invalid-generated", WARNING, F.lit("`generated` must be a mapping with string `by` and ISO-8601 `at`")),
        (matter.where("verified_given and not verified_valid"), "provenance/invalid-verified", WARNING, F.lit("`verified` events need string `by` and ISO-8601 `at`")),
        (matter.where("sources_given and not sources_list"), "provenance/malformed-source", WARNING, F.lit("`sources` must be a list of {id, resource, title} entries")),
        (matter.where("stale_given and not stale_valid"), "provenance/invalid-stale-after", WARNING, F.concat(F.lit("stale_after "), "stale_text", F.lit(" is not an ISO-8601 date"))),
    ]
    out = [finding(df, code, sev, msg) for df, code, sev, msg in rules]
    bad = matter.select("rel_path", F.explode("bad_sources").alias("entry"))
    out.append(finding(bad, "provenance/malformed-source", WARNING, F.concat(F.lit("source entry lacks a string `id`: "), "entry")))
    sources = matter.select("rel_path", F.posexplode("sources").alias("pos", "s")).select("rel_path", "pos", "s.id", "s.resource")
    repeated = sources.groupBy("rel_path", "id").agg(F.count("*").alias("n")).where("n > 1")
    again = repeated.select("rel_path", "id", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    out.append(finding(again, "integrity/duplicate-id", ERROR, F.concat(F.lit("duplicate source id '"), "id", F.lit("'"))))
    outside = sources.where(F.col("resource").isNotNull() & escapes(F.col("resource")))
    out.append(finding(outside, "integrity/path-traversal", ERROR, F.concat(F.lit("source '"), "id", F.lit("' resource escapes the bundle root: "), "resource")))
    notes = concepts.select("rel_path", F.explode(footnote_references("body")).alias("ref"), footnote_definitions("body").alias("defs"), "sources")
    out.append(finding(notes.where(~F.array_contains("defs", F.col("ref"))), "hygiene/missing-footnote", WARNING, F.concat(F.lit("footnote [^"), "ref", F.lit("] is referenced but never defined"))))
    declared = F.coalesce(F.exists("sources", lambda s: s["id"] == F.col("ref")), F.lit(False))
    out.append(finding(notes.where(F.col("ref").startswith("source-") & ~declared), "provenance/unsupported-claim", WARNING, F.concat(F.lit("claim cites [^"), "ref", F.lit("] but frontmatter declares no source '"), "ref", F.lit("'"))))
    return out


def graph_rules(parsed: DataFrame, concepts: DataFrame, files: DataFrame) -> list[DataFrame]:
    """Rules over links between files."""
    found = parsed.select(F.col("rel_path").alias("src"), F.explode(links("body")).alias("l")).where(~is_external("l.target"))
    found = found.select("src", F.col("l.target").alias("target"), resolve_target("l.target", "src").alias("dst"))
    leaves = found.where("dst is null and substring_index(target, '#', 1) <> ''")
    internal = found.where("dst is not null")
    names = concepts.select("rel_path")
    to = lambda edges: edges.select(F.col("dst").alias("rel_path"))
    linked = names.join(to(internal), "rel_path", "left_semi")
    broken = broken_links(internal, files)
    sources = concepts.select("rel_path", F.explode("sources").alias("s")).where("s.resource is not null").select("rel_path", F.col("s.resource").alias("resource"))
    sources = sources.withColumn("target", normalize_path(F.ltrim("resource", F.lit("/")))).where(~F.col("target").startswith(".."))
    lost = sources.join(files.select(F.col("rel_path").alias("target")), "target", "left_anti")
    return [
        finding(leaves, "integrity/path-traversal", ERROR, F.concat(F.lit("link escapes the bundle root: "), "target"), "src"),
        finding(broken, "hygiene/broken-link", WARNING, F.concat(F.lit("link target does not exist: "), "dst"), "src"),
        finding(names.join(to(internal), "rel_path", "left_anti"), "hygiene/orphan-concept", WARNING, F.lit("concept has no inbound links")),
        finding(linked.join(to(internal.where(is_index(F.col("src")))), "rel_path", "left_anti"), "quality/unindexed-concept", INFO, F.lit("concept is not linked from any index")),
        finding(names.join(internal.select(F.col("src").alias("rel_path")), "rel_path", "left_anti"), "quality/no-outbound-links", INFO, F.lit("concept links to nothing else in the bundle")),
        finding(lost, "provenance/missing-source-resource", WARNING, F.concat(F.lit("source resource does not exist: "), "resource")),
    ]


def verdict(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row: counts by severity, codes, and whether the bundle passes."""
    fails = F.col("errors") > 0
    if strict:
        fails = fails | (F.col("warnings") > 0)
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in (ERROR, WARNING, INFO)], F.array_sort(F.collect_set("code")).alias("codes"))
    return counts.withColumn("passes", ~fails)


def health(files: DataFrame, parsed: DataFrame, findings: DataFrame, today: str | None = None) -> DataFrame:
    """One row of bundle health: coverage, orphans, broken links, freshness, uncited references."""
    concepts = parsed.where(F.col("error").isNull() & is_concept(F.col("rel_path")))
    cited = concepts.select(F.explode("sources").alias("s")).where("s.resource is not null").select(normalize_path(F.ltrim("s.resource", F.lit("/"))).alias("rel_path"))
    references = files.where(is_reference(F.col("rel_path")) & F.col("rel_path").endswith(".md")).select("rel_path")
    stale = F.lit(0).cast("long") if today is None else F.count_if(F.col("stale_after") < F.lit(today))
    base = concepts.agg(F.count("*").alias("concepts"), F.count_if(F.size("sources") > 0).alias("sourced"), F.count_if(F.coalesce("stale_after", F.lit("")) != "").alias("dated"), stale.alias("stale"))
    counted = findings.agg(F.count_if(F.col("code") == "hygiene/orphan-concept").alias("orphans"), F.count_if(F.col("code") == "hygiene/broken-link").alias("broken_links"))
    uncited = references.join(cited, "rel_path", "left_anti").agg(F.count("*").alias("uncited_references"))
    out = base.join(counted).join(uncited).join(references.agg(F.count("*").alias("references")))
    return out.withColumns({"source_coverage": ratio(F.col("sourced"), F.col("concepts")), "orphan_ratio": ratio(F.col("orphans"), F.col("concepts"))})

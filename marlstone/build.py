"""Building, importing and rebuilding a bundle: acquire, plan, generate, link, stage, lint, index, publish.

Every step is a frame.  What a build learned (when a source was first seen, what a model said) is
kept by content, before anything can fail, so a failed build is cheap to repeat and an unchanged one
changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import content_hash
from marlstone.index import Index
from marlstone.operators import bundle, compile, lint
from marlstone.providers import completions
from marlstone.session import materialize
from marlstone.sources.connectors import connect
from marlstone.sources.fetch import Fetcher
from marlstone.sources.files import bundle as read_tree
from marlstone.sources.files import capped, documents, scan, unpack
from marlstone.sources.markdown import parse_files
from marlstone.sources.records import manifest as manifest_entries
from marlstone.store import Store

STAGES = ("acquire", "plan", "generate", "link", "stage", "lint", "index", "publish")
LOG_HEAD = "# Revision log\n\n"


class BuildError(RuntimeError):
    """What stops a build or an import."""


@dataclass
class Outcome:
    """What came of a build: the staged tree, its findings, and whether it is the current revision now."""

    revision: str
    changed: bool
    published: bool
    passed: bool
    files: DataFrame
    findings: DataFrame
    report: dict[str, Any] = field(default_factory=dict)


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


#: A folder, or a connector's name and what it is to acquire.
Source = str | tuple[str, str]


def acquire(spark: SparkSession, sources: list[Source], store: Store, clock: Callable[[], str], fetcher: Callable[[], Fetcher] | None = None) -> DataFrame:
    """``(uri, source_hash, retrieved_at, title, blocks)`` of all sources; the first of a URI wins.

    A source keeps the time at which its content was first seen.  Connectors that fetch do so by
    ``fetcher()``; what they acquire is written before it is read.
    """
    def documents_of(source: Source) -> DataFrame:
        if isinstance(source, str):
            return documents(capped(scan(spark, source)))
        made = connect(source[0], fetcher)
        return made.normalize(materialize(made.acquire(spark, source[1]), "items"))

    columns = ("uri", "source_hash", "title", "blocks", "error")
    frames = [documents_of(s).select(*columns, F.lit(k).alias("source")) for k, s in enumerate(sources)]
    if not frames:
        raise BuildError("no sources")
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    docs = materialize(bundle.first_per_key(rows, "uri", "source"), "acquired")
    bad = docs.where("error is not null").select("uri", "error").limit(5).collect()
    if bad:
        raise BuildError("; ".join(f"{r['uri']}: {r['error']}" for r in bad))
    store.remember("acquired", docs.select(F.col("source_hash").alias("key"), F.lit(clock()).alias("value")).distinct())
    seen = store.cache("acquired").select(F.col("key").alias("source_hash"), F.col("value").alias("retrieved_at"))
    return docs.join(seen, "source_hash").select("uri", "source_hash", "retrieved_at", "title", "blocks")


def generated(rows: DataFrame, store: Store, prompt: str, payload: str, provider: str, version: str) -> DataFrame:
    """Adds ``value``, what the provider says for each row's payload; asked once for each content."""
    keyed = rows.withColumn("key", compile.generation_key(F.sha2(payload, 256), prompt, provider, version))
    new = keyed.select("key", payload).dropDuplicates(["key"]).join(store.cache("generated").select("key"), "key", "left_anti")
    store.remember("generated", completions(new, prompt, payload, provider).select("key", F.col("completion").alias("value")))
    return keyed.join(store.cache("generated"), "key").drop("key")


def plan(docs: DataFrame, store: Store, provider: str, version: str) -> DataFrame:
    """``(uri, nth, title, blocks)``: the concepts of each document.

    The provider may split a document with several sections; an answer that isn't an exact split
    leaves it whole, as does none.
    """
    parts = materialize(compile.sections(docs, "uri"), "sections")
    heads = parts.where("section >= 0").groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("section", "heading"))).alias("heads"))
    asked = docs.join(heads.where(F.size("heads") > 1), "uri")
    asked = asked.select("uri", F.size("heads").alias("n"), F.to_json(F.struct("title", F.transform("heads", lambda h: h["heading"]).alias("sections"))).alias("payload"))
    said = generated(asked, store, "concept-plan", "payload", provider, version)
    chosen = F.from_json("value", "concepts array<struct<title:string,sections:array<int>>>")["concepts"]
    good = said.select("uri", "n", chosen.alias("plan")).where(F.col("plan").isNotNull() & (F.size("plan") > 0) & compile.plan_valid(F.col("plan"), F.col("n")))
    split = good.select("uri", F.posexplode("plan").alias("nth", "c")).select("uri", "nth", "c.title", F.posexplode("c.sections").alias("place", "section"))
    lead = parts.where("section < 0").select("uri", F.lit(0).alias("nth"), F.lit(-1).alias("place"), "blocks")
    bodies = split.join(parts.select("uri", "section", "blocks"), ["uri", "section"]).select("uri", "nth", "place", "blocks")
    bodies = bodies.unionByName(lead.join(good.select("uri"), "uri", "left_semi"))  # what stands before the first section goes to the first concept
    blocks = bodies.groupBy("uri", "nth").agg(F.array_sort(F.collect_list(F.struct("place", "blocks"))).alias("x"))
    blocks = blocks.select("uri", "nth", F.flatten(F.transform("x", lambda x: x["blocks"])).alias("blocks"))
    concepts = split.select("uri", "nth", "title").distinct().join(blocks, ["uri", "nth"])
    whole = docs.join(good.select("uri"), "uri", "left_anti").select("uri", F.lit(0).alias("nth"), "title", "blocks")
    return concepts.select("uri", "nth", "title", "blocks").unionByName(whole)


def stage(files: DataFrame, store: Store, summary: str, log: str | None = None) -> tuple[DataFrame, str, bool]:
    """The tree with its log and manifest, its revision id, and whether that differs from the current one."""
    tree = materialize(files.where(~F.col("rel_path").isin("log.md", "manifest.json")).select("rel_path", "content"), "staged")
    revision = bundle.revision_id(tree)
    changed = revision != store.current()
    text = log if log is not None else (store.read_text(f"{store.folder}/log.md") or LOG_HEAD)
    if changed:
        text = f"{text.rstrip(chr(10))}\n- {revision} — {summary}\n" if text.strip() != LOG_HEAD.strip() else f"{LOG_HEAD}- {revision} — {summary}\n"
    spark = store.spark
    tree = tree.unionByName(spark.createDataFrame([("log.md", bytearray(text.encode()))], "rel_path string, content binary"))
    listed = {r["rel_path"]: {"sha256": r["sha256"], "bytes": r["bytes"]} for r in bundle.manifest(tree).orderBy("rel_path").toLocalIterator()}
    entry = json.dumps({"files": listed}, indent=2, ensure_ascii=False) + "\n"  # one file by its nature
    tree = tree.unionByName(spark.createDataFrame([("manifest.json", bytearray(entry.encode()))], "rel_path string, content binary"))
    return materialize(tree, "tree"), revision, changed


def finish(store: Store, files: DataFrame, summary: str, publish: bool, report: dict[str, Any], log: str | None = None) -> Outcome:
    """Stages, lints and, if nothing is wrong, indexes and publishes a tree."""
    tree, revision, changed = stage(files, store, summary, log)
    findings = materialize(lint.lint(tree, parse_files(tree), manifest_entries(tree)), "findings")
    verdict = lint.verdict(findings).first()
    published = False
    if publish and verdict["passes"]:
        Index(store, revision).ensure(tree)
        published = store.publish(tree, revision)
    report |= {"revision_id": revision, "changed": changed, "published": published, "stages": list(STAGES), "lint": {k: verdict[k] for k in ("errors", "warnings", "infos")}}
    if publish and verdict["passes"]:
        store.log_run(revision, report)
    return Outcome(revision, changed, published, verdict["passes"], tree, findings, report)


def build(spark: SparkSession, sources: list[Source], folder: str, name: str, provider: str = "stub", clock: Callable[[], str] = now, version: str = "1", publish: bool = True, fetcher: Callable[[], Fetcher] | None = None) -> Outcome:
    """Compiles folders, websites and repositories into a bundle and publishes it if its content changed and lint finds no error."""
    store = Store(spark, folder)
    docs = materialize(acquire(spark, sources, store, clock, fetcher), "docs")
    concepts = materialize(plan(docs, store, provider, version), "concepts")
    described = generated(concepts.withColumn("payload", F.to_json(F.struct("title", content_hash("blocks").alias("content")))), store, "concept-description", "payload", provider, version)
    concepts = materialize(described.select("uri", "nth", "title", "blocks", F.col("value").alias("description")), "described")
    # the time of a concept is that of the first build that gave this content
    print_of = F.sha2(F.concat_ws("\0", "uri", "title", "description", content_hash("blocks")), 256)
    store.remember("stamped", concepts.select(print_of.alias("key"), F.lit(clock()).alias("value")).distinct())
    stamped = concepts.withColumn("key", print_of).join(store.cache("stamped"), "key").select("uri", "nth", "title", "blocks", "description", F.col("value").alias("at"))
    files = compile.compile_bundle(docs, name, provider, concepts=stamped).select("rel_path", F.col("content").cast("binary").alias("content"))
    n = {"source_files": docs.count(), "concepts": concepts.count()}
    return finish(store, files, f"{n['concepts']} concept(s) from {n['source_files']} source file(s)", publish, {"project": name, "provider": provider, "counts": n})


def import_bundle(spark: SparkSession, source: str, folder: str, summary: str = "imported") -> Outcome:
    """Publishes a foreign tree, a folder or an archive, as it is, with its own log and a new manifest, if lint finds no error."""
    store = Store(spark, folder)
    if source.endswith((".tar.gz", ".tgz")):
        files = unpack(spark, source)
    elif lint.not_a_bundle(spark, source) is not None:
        raise BuildError(f"{source} is not a directory")
    else:
        files = read_tree(spark, source)
    if not files.limit(1).count():
        raise BuildError(f"no files under {source}")
    log = files.where("rel_path = 'log.md'").select(F.decode("content", "utf-8").alias("t")).first()
    return finish(store, files, summary, True, {"imported": source}, log["t"] if log else LOG_HEAD)


def drift(spark: SparkSession, sources: list[Source], folder: str, name: str, **options: Any) -> list[tuple[str, str]]:
    """What a rebuild would change against the current revision, as sorted ``(path, change)``; publishes nothing."""
    store = Store(spark, folder)
    current = store.current()
    if current is None:
        raise BuildError("no published revision yet")
    built = build(spark, sources, folder, name, publish=False, **options)
    rows = bundle.tree_diff(bundle.manifest(store.tree(current)), bundle.manifest(built.files))
    return sorted((r["rel_path"], r["change"]) for r in rows.toLocalIterator())

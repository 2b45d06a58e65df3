"""The persisted index of a revision: blocks of weighted stems, chunk vectors and links, written once and read by every search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stem import stems
from marlstone.functions.text import is_external, links, resolve_target
from marlstone.operators import chunks, graph, search
from marlstone.session import materialize
from marlstone.sources.markdown import parse_files
from marlstone.store import Store

#: The tables of an index.
PARTS = ("blocks", "vectors", "chunks", "links")


def documents(files: DataFrame) -> DataFrame:
    """``(path, title, description, tags, body)`` of the Markdown files, the log left out; tags are one text.

    The title of a file without one is its path.  A file with broken frontmatter is its whole text; one
    that isn't UTF-8 is left out.
    """
    rows = parse_files(files, references=True).where("coalesce(error, '') <> 'encoding' and rel_path <> 'log.md'")
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    return rows.select(F.col("rel_path").alias("path"), F.coalesce("title", "rel_path").alias("title"), "description", tags.alias("tags"), "body")


def tables(files: DataFrame) -> dict[str, DataFrame]:
    """The index tables of a tree."""
    docs = documents(files)
    parts = chunks.chunks(docs.where(F.col("path").startswith("references/")), "path", "body")
    parts = parts.withColumn("cid", F.concat_ws("#", "path", F.format_string("%06d", "seq")))
    found = files.where(F.col("rel_path").endswith(".md")).select(F.col("rel_path").alias("src"), F.posexplode(links(F.decode("content", "utf-8"))).alias("pos", "l"))
    found = found.where(~is_external("l.target")).select("src", resolve_target("l.target", "src").alias("dst"), "pos", F.col("l.text").alias("anchor")).where("dst is not null")
    return {
        "blocks": search.postings_blocks(materialize(search.weigh(docs, "path", search.FIELD_WEIGHTS, stems), "postings"), "path"),
        "vectors": chunks.hashed_bow(parts, "cid", "chunk"),
        "chunks": parts,
        "links": graph.anchors(found),
    }


class Index:
    """One revision's index; ``ensure`` writes it if it isn't there."""

    def __init__(self, store: Store, revision: str):
        self.store, self.revision, self.folder = store, revision, f"{store.meta}/index-2/{revision}"  # 2: blocks without the weights of terms; an older index is made anew

    def ensure(self, files: DataFrame | None = None) -> bool:
        """Writes the index aside and moves it into place; False if it was there, whoever wrote it."""
        if self.store.exists(self.folder):
            return False
        passing = f"{self.store.meta}/passing/{uuid.uuid4().hex}"
        for name, df in tables(files if files is not None else self.store.tree(self.revision)).items():
            df.write.parquet(f"{passing}/{name}")
        return self.store.settle(passing, self.folder)

    def table(self, name: str) -> DataFrame:
        self.ensure()
        return self.store.spark.read.parquet(f"{self.folder}/{name}")

    def search(self, questions: DataFrame, qid: str = "qid", text: str = "text", top: int = 10) -> DataFrame:
        """``(qid, path, score, rank)`` of the best documents for every question, from the written blocks of postings."""
        return search.block_rank(self.table("blocks"), search.asked_terms(questions, qid, text, stems), "path", qid, top)

    def retrieve(self, questions: DataFrame, qid: str = "qid", text: str = "text", top: int = chunks.TOP) -> DataFrame:
        """``(qid, path, seq, chunk, score, rank)`` of the best chunks for every question, from the written vectors."""
        best = chunks.sparse_topk(chunks.hashed_bow(questions, qid, text), self.table("vectors"), qid, "cid", top)
        return best.join(self.table("chunks"), "cid").select(qid, "path", "seq", "chunk", "score", "rank")

    def links(self) -> DataFrame:
        """``(src, dst, anchor)`` of the revision's files."""
        return self.table("links")

    def stats(self) -> dict[str, int]:
        """Nodes and edges of the link graph, and the bytes of the tree."""
        edges = self.links().select("src", "dst")
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct().count()
        size = self.store.tree(self.revision).agg(F.sum(F.octet_length("content"))).first()[0]
        return {"nodes": nodes, "edges": edges.count(), "bytes": int(size or 0)}

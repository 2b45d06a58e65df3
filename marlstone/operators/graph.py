"""Link graphs: edges, degrees, broken links, orphans, neighbours, related titles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import digest_text, is_external, links, question_terms, resolve_target, tokens

RELATED, NEIGHBOURS = 5, 16
#: Documents that a task holds the terms of, about.
PART = 32_768


def link_edges(files: DataFrame, path: str = "rel_path", text: str = "content") -> DataFrame:
    """``(src, dst)``: distinct internal links of each file's raw text (frontmatter too), resolved to the root; null texts have none."""
    rows = files.select(F.col(path).alias("src"), F.explode(links(F.col(text).cast("string"))).alias("l"))
    rows = rows.where(~is_external("l.target")).select("src", resolve_target("l.target", "src").alias("dst"))
    return rows.where("dst is not null").distinct()


def anchors(links: DataFrame) -> DataFrame:
    """``(src, dst, anchor)`` of ``links(src, dst, pos, anchor)``: the text of the last link from one file to another."""
    return links.groupBy("src", "dst").agg(F.max_by("anchor", "pos").alias("anchor"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``(path, direction, other)``: every link of every file, once as ``outbound`` and once as ``inbound``; a hub's stay rows, see ``neighbours`` for bounded lists."""
    ends = F.array(F.struct(F.col("src").alias("path"), F.lit("outbound").alias("direction"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("path"), F.lit("inbound").alias("direction"), F.col("src").alias("other")))
    return edges.select("src", "dst").distinct().select(F.explode(ends).alias("e")).select("e.*")


def neighbours(edges: DataFrame, paths: DataFrame, limit: int = NEIGHBOURS) -> DataFrame:
    """``(path, outbound, inbound, total_outbound, total_inbound)`` of the asked ``paths(path)``: the first ``limit`` (1 to 32) by name, and the true totals.

    Only the first ones are gathered: ranks are pruned inside the tasks, totals are counts, so a hub
    never comes together in one row.  A path without links has empty lists; repeated edges count once.
    """
    n = max(1, min(limit, 32))
    paths, out = paths.select("path").distinct(), None
    for name, here, there in (("outbound", "src", "dst"), ("inbound", "dst", "src")):
        own = edges.select(F.col(here).alias("path"), F.col(there).alias("other")).distinct().join(paths, "path", "left_semi")
        nth = F.row_number().over(Window.partitionBy("path").orderBy("other"))
        first = own.withColumn("nth", nth).where(F.col("nth") <= n).groupBy("path").agg(F.array_sort(F.collect_list("other")).alias(name))
        side = first.join(own.groupBy("path").agg(F.count("*").cast("int").alias(f"total_{name}")), "path")
        out = side if out is None else out.join(side, "path", "full")
    empty = F.array().cast("array<string>")
    out = paths.join(out, "path", "left")
    return out.select("path", *[F.coalesce(c, empty).alias(c) for c in ("outbound", "inbound")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_outbound", "total_inbound")])


def degrees(edges: DataFrame) -> DataFrame:
    """``(path, out_degree, in_degree)``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.path").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def broken_links(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """``occurrences(src, dst)`` whose target is neither a file nor a folder of one; each occurrence counts."""
    parts = F.split("rel_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    known = files.select("rel_path").unionAll(files.where(F.col("rel_path").contains("/")).select(F.explode(folders).alias("rel_path"))).distinct()
    return occurrences.join(known.select(F.col("rel_path").alias("dst")), "dst", "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (``path``) that nothing links to."""
    return nodes.join(edges.select(F.col("dst").alias("path")), "path", "left_anti")


def unindexed(nodes: DataFrame, edges: DataFrame, index: Column) -> DataFrame:
    """Linked nodes that no index links to; ``index`` tests an edge's ``src``."""
    linked = nodes.join(edges.select(F.col("dst").alias("path")), "path", "left_semi")
    return linked.join(edges.where(index).select(F.col("dst").alias("path")), "path", "left_anti")


def projection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two known nodes, without loops."""
    names = nodes.select("path")
    inner = edges.where("src <> dst").join(names.select(F.col("path").alias("src")), "src", "left_semi")
    return inner.join(names.select(F.col("path").alias("dst")), "dst", "left_semi")


def hops(seeds: DataFrame, edges: DataFrame, fanout: int) -> DataFrame:
    """``(qid, path, via)``: unseen targets one link from ``seeds(qid, path, pos)``, seed then target order, bounded per question."""
    found = seeds.join(edges, seeds["path"] == edges["src"]).select("qid", F.col("dst").alias("path"), F.col("src").alias("via"), "pos")
    found = found.join(seeds.select("qid", "path"), ["qid", "path"], "left_anti")
    first = Window.partitionBy("qid", "path").orderBy("pos")
    found = found.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    order = Window.partitionBy("qid").orderBy("pos", "path")
    return found.withColumn("hop", F.row_number().over(order)).where(F.col("hop") <= fanout).select("qid", "path", "via", "hop")


def related(docs: DataFrame, key: str, title: str, text: str, most: int = RELATED) -> DataFrame:
    """``(key, other, nth)``: documents whose title terms (all, or all but one of three) occur in a document's text, the first ``most`` by key.

    Documents are dealt into parts of about ``PART``; every title meets every part, in order of key, behind
    the part's terms in the same task.  A task drops documents that have their ``most`` and passes over titles
    whose terms its documents lack; so no pair becomes a row but those of the result.  Of titles of the same
    terms only those of the first ``most`` + 1 keys are dealt, for no others can be among a document's first.
    """
    held = docs.where(F.col(key).isNotNull())
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-held.count() // PART))
    listed = lambda terms: F.array_join(terms, " ").alias("terms")  # noqa: E731  # a string takes a fraction of a list's room
    dealt = held.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("side"), F.col(key).alias("key"), listed(F.array_distinct(tokens(digest_text(text)))))
    titles = held.select(F.lit(1).alias("side"), F.col(key).alias("key"), listed(F.array_sort(question_terms(title)))).where("terms <> ''")
    titles = titles.withColumn("_nth", F.dense_rank().over(Window.partitionBy("terms").orderBy("key"))).where(F.col("_nth") <= most + 1)
    spread = titles.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "side", "key", "terms")
    rows = dealt.where("terms <> ''").unionAll(spread).repartitionById(parts, "part").sortWithinPartitions("side", "key")
    kind = dict(docs.dtypes)[key]
    return rows.mapInArrow(_titles_of_part(most), f"key {kind}, other {kind}, nth int").select(F.col("key").alias(key), "other", "nth")


class _Held:
    """Which of a part's documents hold a term, and how many titles each has met; documents are numbered as they come."""

    def __init__(self, keys: pa.ChunkedArray, terms: list[pa.ListArray], most: int):
        words = pa.chunked_array([t.flatten() for t in terms]).dictionary_encode().unify_dictionaries()
        self.keys, self.words, self.most = keys.combine_chunks(), words.chunk(0).dictionary, most
        sizes = np.concatenate([pc.list_value_length(t).to_numpy() for t in terms])
        self.met = np.zeros(len(keys), int)
        self._index(np.repeat(np.arange(len(keys), dtype=np.int32), sizes), np.concatenate([c.indices.to_numpy() for c in words.chunks]))

    def _index(self, docs: np.ndarray, codes: np.ndarray) -> None:
        order = np.argsort(codes, kind="stable")
        self.docs, self.codes = docs[order], codes[order]
        self.start = np.searchsorted(self.codes, np.arange(len(self.words) + 1))
        self.length = np.append(np.diff(self.start), 0)  # the last one is that of unknown words
        self.open = int((self.met < self.most).sum())

    def forget(self) -> None:
        """Leaves documents out that have their titles, once they are half."""
        if 2 * int((self.met < self.most).sum()) <= self.open:
            kept = self.met[self.docs] < self.most
            self._index(self.docs[kept], self.codes[kept])

    def match(self, codes: np.ndarray, own: int | None) -> np.ndarray:
        """Documents, but ``own``, that hold all of a title's terms, or all but one of three or more."""
        lacking = 1 if len(codes) >= 3 else 0
        codes = codes[np.argsort(self.length[codes], kind="stable")]
        lists = [self.docs[self.start[c] : self.start[c + 1]] if c >= 0 else self.docs[:0] for c in codes]
        found = lists[0] if not lacking else np.union1d(lists[0], lists[1])  # lacking one, it holds one of any two
        found = found[(self.met[found] < self.most) & (found != (-1 if own is None else own))]
        missed = np.zeros(len(found), int)
        for docs in lists:
            if not len(found):
                break
            at = np.searchsorted(docs, found)
            missed += docs[np.minimum(at, len(docs) - 1)] != found if len(docs) else 1
            kept = missed <= lacking
            found, missed = found[kept], missed[kept]
        return found


def _titles_of_part(most: int):
    """Rows ``(key, other, nth)`` of rows ``(part, side, key, terms)``: a part's documents, then all titles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, part = [], None
        for b in batches:
            cut = int(np.searchsorted(b.column(1).to_numpy(), 1))
            if cut:
                rows.append(b.slice(0, cut).select(["key", "terms"]))
            if cut == len(b) or not rows and part is None:
                continue
            if part is None:
                part = _Held(pa.chunked_array([r.column(0) for r in rows]), [pc.split_pattern(r.column(1), " ") for r in rows], most)
                rows = []
            titles = b.slice(cut)
            terms = pc.split_pattern(titles.column(3), " ")
            codes = pc.index_in(terms.flatten(), part.words).fill_null(-1).to_numpy()
            sizes = pc.list_value_length(terms).to_numpy()
            first = np.cumsum(sizes) - sizes
            own = pc.index_in(titles.column(2), part.keys).to_pylist()
            docs, others, nth = [], [], []
            for start in range(0, len(titles), 1024):
                some = slice(start, start + 1024)
                there = np.add.reduceat(part.length[codes[first[start] : first[some][-1] + sizes[some][-1]]] > 0, first[some] - first[start], dtype=int)
                for i in start + np.flatnonzero(there >= sizes[some] - (sizes[some] >= 3)):
                    found = part.match(codes[first[i] : first[i] + sizes[i]], own[i])
                    if len(found):
                        part.met[found] += 1
                        docs.append(found)
                        others.append(np.full(len(found), i))
                        nth.append(part.met[found])
                part.forget()
            if docs:
                yield pa.RecordBatch.from_arrays([part.keys.take(pa.array(np.concatenate(docs))), titles.column(2).take(pa.array(np.concatenate(others))), pa.array(np.concatenate(nth), pa.int32())], names=["key", "other", "nth"])

    return run

"""Groups of similar documents: those that share four fifths of their five-word shingles are joined.

Two passes find the links.

* SimHash, for the bulk: documents whose length-weighted word fingerprints are linked within a radius
  form candidate groups, dealt into blocks of bounded size that all hold the group's most central
  document.  What a block shows to be alike is joined under one label.  This pass misses pairs whose
  fingerprints are far apart and pairs in different blocks.
* A prefix filter, for all the rest: shingles have one order, those common in a sample last.  Two sets
  of likeness t share a shingle among the first n - ceil(t n) + 1 of each, so documents of different
  labels meet on these, whatever their fingerprints and however large their group.  Meetings that
  sizes, places in the order and hashed shingle counts can't rule out are verified on whole sets.  A
  shingle of very many texts is dealt in blocks, each against each.

So every pair of the likeness ends in one component.  Only the cost depends on the sample and on the
first pass, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._common import bounded_batches, forget, give_back, map_batches
from marlstone.llm.components import connected_components
from marlstone.llm.simhash import BITS, components, word_fingerprint
from marlstone.session import materialize

RADIUS, WORDS, LEAST = 8, 5, 0.8
#: Distinct texts of one block of the first pass.
BLOCK = 256
#: Share of the texts sampled for the order of shingles, and how many at most; a shingle is common from so many
#: of them on; common ones told apart at most.
SHARE, SAMPLE, COMMON, MOST_COMMON = 0.25, 60_000, 3, 200_000
#: Cells of a document's hashed shingle counts.
CELLS = 128
#: Meetings in one batch.
MEETINGS = 1 << 18
#: Documents of one shingle that one group holds; more are dealt in blocks, each against each.
CROWD = 2048


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``n`` words (A-Z lower-cased); a shorter text is one shingle, a blank one none."""
    words = word_list(text)
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_digest
    data = b"".join([h(joined[a:b]) for a, b in zip(starts[: 1 - n].tolist(), ends[n - 1 :].tolist())])
    return np.unique(np.frombuffer(data, np.int64))


def joined_sets(sets: list[np.ndarray], least: float = LEAST) -> list[int]:
    """For each set the number of the first one it is connected to by likeness of ``least`` or more.

    The first set is compared with all; every set it doesn't reach is compared with all in turn.
    What the first one reaches is connected already.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    owner, ranked = owner[order], values[order]
    label = list(range(len(sets)))

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(sets)):
        if i and find(i) == find(0):
            continue
        lo, hi = np.searchsorted(ranked, sets[i]), np.searchsorted(ranked, sets[i], side="right")
        n = hi - lo
        shared = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))
        for j in np.flatnonzero((shared > 0) & (shared >= least * (size[i] + size - shared) - 1e-9)).tolist():
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def common_shingles(df: DataFrame, doc_id: str, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are common in a hash sample of the texts, and how often they are met there."""
    share = min(SHARE, SAMPLE / max(df.count(), 1))
    picked = df.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select(F.col(text).alias("text"))

    def count(cols: dict[str, list]) -> dict[str, object]:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(shingle_set(t, words) for t in cols["text"])]), return_counts=True)
        return {"key": keys, "n": n}

    counts = map_batches(picked, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).toArrow()
    keys, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float = LEAST) -> np.ndarray:
    """The first shingles of a set, of which any set of likeness ``least`` has one among its own first."""
    size, (keys, n) = len(shingles), common
    first = size - int(np.ceil(least * size - 1e-9)) + 1 if size else 0
    if not len(keys) or not size:
        return shingles[:first]
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    often = np.where(keys[at] == shingles, n[at], 0)
    return shingles[np.argsort(often, kind="stable")[:first]]


def cell_counts(shingles: np.ndarray) -> bytes:
    """Counts of a set's shingles by hash, up to 255: two sets differ in at least as many shingles as their counts do."""
    return np.minimum(np.bincount(shingles & (CELLS - 1), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _marked(df: DataFrame, doc_id: str, text: str, words: int, least: float) -> DataFrame:
    """``(doc_id, node, fp, size, tokens, cells)``: node names the words of a text, so texts of equal words are one node.

    ``size`` counts the text's shingles, ``tokens`` are the first of them and ``cells`` their hashed counts.
    """
    common = common_shingles(df, doc_id, text, words)

    def run(cols: dict[str, list]) -> dict[str, object]:
        forget()
        fp = np.array([word_fingerprint(t) for t in cols["text"]], np.uint64).view(np.int64)
        sets = [shingle_set(t, words) for t in cols["text"]]
        named = {"doc_id": cols["doc_id"], "node": [xxhash.xxh128_hexdigest(b" ".join(word_list(t))) for t in cols["text"]], "fp": fp}
        return named | {"size": [len(s) for s in sets], "tokens": [prefix(s, common, least) for s in sets], "cells": [cell_counts(s) for s in sets]}

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(source, run, "doc_id long, node string, fp long, size int, tokens array<long>, cells binary")


def _blocks(members: DataFrame) -> DataFrame:
    """``(component_id, block, doc_id, centre)`` of candidate groups of two texts or more; each block has the centre."""
    bits = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1).cast("long"))) for i in range(BITS)]
    masks = [F.when(2 * b > F.count("*"), F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i, b in enumerate(bits)]
    middle = masks[0]
    for m in masks[1:]:
        middle = middle.bitwiseOR(m)
    groups = members.groupBy("component_id").agg(F.count("*").alias("n"), middle.alias("middle")).where("n > 1")
    groups = materialize(groups, "groups")
    rows = members.join(groups, "component_id").withColumn("far", F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))))
    rows = materialize(rows.select("component_id", "n", "doc_id", "far"), "members")
    parts = F.ceil((F.col("n")) / BLOCK).cast("int")
    centres = rows.groupBy("component_id").agg(F.max(parts).alias("parts"), F.min(F.struct("far", "doc_id")).alias("c"))
    everywhere = centres.select("component_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long"))).alias("block"), F.col("c.doc_id").alias("doc_id"), F.lit(True).alias("centre"))
    dealt = rows.select("component_id", F.pmod(F.xxhash64("doc_id"), parts).cast("long").alias("block"), "doc_id", F.lit(False).alias("centre"))
    return everywhere.unionAll(dealt)


def _sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(doc_id, shingles)`` of the texts of the wanted documents."""

    def sets(cols: dict[str, list]) -> dict[str, object]:
        return {"doc_id": cols["doc_id"], "shingles": [shingle_set(t, words) for t in cols["text"]]}

    return map_batches(texts.join(wanted, "doc_id", "left_semi"), sets, "doc_id long, shingles array<long>")


def _links(blocks: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Verified links ``(u, v)`` inside blocks, a spanning tree for each set of connected documents."""
    made = _sets(texts, blocks.select("doc_id").distinct(), words).dropDuplicates(["doc_id"])
    rows = blocks.join(made, "doc_id").select("component_id", "block", "centre", "doc_id", "shingles")
    rows = rows.repartition("component_id", "block").sortWithinPartitions("component_id", "block", F.desc("centre"), "doc_id")
    bounded_batches(rows.sparkSession)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held = None, [], []

        def close() -> pa.RecordBatch:
            root = joined_sets(held, least)
            pairs = [(ids[r], ids[i]) for i, r in enumerate(root) if r != i]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], schema=schema)

        for b in batches:
            shingles = b.column(4)
            for i, at in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if at != key:
                    if len(ids) > 1:
                        yield close()
                    key, ids, held = at, [], []
                ids.append(b.column(3)[i].as_py())
                held.append(shingles[i].values.to_numpy())
        if len(ids) > 1:
            yield close()

    return rows.mapInArrow(run, "u long, v long")


def meetings(token: np.ndarray, label: np.ndarray, size: np.ndarray, place: np.ndarray, least: float = LEAST, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, sorted by token and label, of one token and different labels that may be of likeness ``least``.

    At the first shingle that two sets share, they can share no more than what follows it in either.
    With ``side``, rows of one side meet only if their side isn't negative.
    """
    rows = np.arange(len(token))
    new = np.concatenate(([True], token[1:] != token[:-1]))
    end = np.append(np.flatnonzero(new)[1:], len(token))[np.cumsum(new) - 1]
    new[1:] |= label[1:] != label[:-1]
    other = np.append(np.flatnonzero(new)[1:], len(token))[np.cumsum(new) - 1]
    left = size - place
    at = rows[other < end]
    other = other[at]
    while len(at):
        for k in range(0, len(at), MEETINGS):
            i, j = at[k : k + MEETINGS], other[k : k + MEETINGS]
            may = np.minimum(left[i], left[j]) * (1 + least) >= least * (size[i] + size[j]) - 1e-6
            if side is not None:
                may &= (side[i] != side[j]) | (side[i] >= 0)
            if may.any():
                yield i[may], j[may]
        other = other + 1
        more = other < end[at]
        at, other = at[more], other[more]


def _dealt(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``rows(token, doc_id, label, place)`` with crowded tokens cut, so that each two documents of a token share one of the result's.

    A crowded token becomes a token for each two of its parts.  In one of two different parts ``side``
    is -1 and -2, and only documents of different sides are to meet; else it is 0.
    """
    # written, so that Spark knows their size: few enough are broadcast, and the rows aren't moved for them
    sizes = materialize(rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "crowded")
    parts = F.ceil(F.col("n") / crowd).cast("long")
    own = F.pmod(F.xxhash64("doc_id", "label"), parts)
    side = lambda k: F.when(k == own, 0).when(own < k, -1).otherwise(-2)
    each = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.struct(F.xxhash64("token", F.least(own, k), F.greatest(own, k)).alias("token"), side(k).alias("side")))
    keys = F.when(F.col("n").isNull(), F.array(F.struct("token", F.lit(0).alias("side")))).otherwise(each)
    return rows.join(sizes, "token", "left").select(F.explode(keys).alias("k"), "doc_id", "label", "place").select("k.token", "doc_id", "label", "place", "k.side")


def _live_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(crowd, members)`` of each token with documents of two labels, from rows sorted by token.

    ``members`` are rows of four numbers (label, doc_id, place, side) in a fixed order; ``crowd`` is a hash of all but the positions.
    """

    def close(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        token, doc_id, label, place, side = map(np.concatenate, zip(*held))
        order = np.lexsort((side, place >> 32, doc_id, label, token))
        rows = np.stack([label, doc_id, place, side], 1)[order].astype(np.int64)
        who = np.stack([label, doc_id, place >> 32, side], 1)[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(token[order]) != 0)))
        ends = np.append(starts[1:], len(token))
        live = rows[starts, 0] != rows[ends - 1, 0]
        cuts = list(zip(starts[live].tolist(), ends[live].tolist()))
        names = pa.array([xxhash.xxh128_digest(who[a:z].tobytes()) for a, z in cuts], pa.binary())
        return pa.RecordBatch.from_arrays([names, pa.array([rows[a:z].tobytes() for a, z in cuts], pa.binary())], names=["crowd", "members"])

    forget()
    held, n = [], 0
    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        if not len(cols[0]):
            continue
        # the last token may go on in the next batch
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        n += cut
        if cut or (held and held[-1][0][-1] != cols[0][0]):
            if cut:
                held.append([c[:cut] for c in cols])
            if n >= MEETINGS or not cut:
                yield close(held)
                held, n = [], 0
        held.append([c[cut:] for c in cols])
    if held:
        yield close(held)
    give_back()


def _meetings(rows: DataFrame, least: float, crowd: int = CROWD) -> DataFrame:
    """``(u, v)``, u < v: documents of different labels that meet on a shingle of ``rows(token, doc_id, label, place)``.

    Shingles of the same documents are met once, at the least position that each document has among
    them: a text's copies share most of their shingles, and would meet on each.  No task holds more
    than two parts of a crowded shingle; a shingle of n documents makes n * n / crowd rows.
    """
    rows = _dealt(rows, crowd).repartition("token").sortWithinPartitions("token", "label")
    crowds = rows.mapInArrow(_live_tokens, "crowd binary, members binary").repartition("crowd").sortWithinPartitions("crowd")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token = np.repeat(np.arange(len(held)), [len(h) for h in held])
            label, doc_id, place, side = np.concatenate(held).T
            for i, j in meetings(token, label, place >> 32, place & 0xFFFFFFFF, least, side):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc_id[i], doc_id[j])), pa.array(np.maximum(doc_id[i], doc_id[j]))], schema=schema)

        held, n, last = [], 0, None
        for b in batches:
            for name, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = np.frombuffer(members, np.int64).reshape(-1, 4)
                if name == last:  # the same documents and sizes, so the lesser place has the lesser position
                    held[-1] = np.minimum(held[-1], found)
                    continue
                if n >= MEETINGS:
                    yield from close(held)
                    held, n = [], 0
                held.append(found)
                n, last = n + len(found), name
        if held:
            yield from close(held)
        give_back()

    return crowds.mapInArrow(run, "u long, v long")


def _kept_pairs(pairs: DataFrame, sides: DataFrame, keep: Callable[[dict[str, pa.Array]], np.ndarray]) -> DataFrame:
    """The distinct ``pairs(u, v)`` that ``keep`` accepts, a batch at a time, seeing columns of ``sides(doc_id, ...)`` with ``u_`` and ``v_`` before their names."""
    for end in ("u", "v"):
        pairs = pairs.join(sides.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in sides.columns if c != "doc_id"]), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns))
            held = keep(cols) if len(b) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(cols[c].to_numpy()[held], pa.int64()) for c in "uv"], names=["u", "v"])

    bounded_batches(pairs.sparkSession)
    return pairs.mapInArrow(run, "u long, v long").distinct()


def alike_sets(least: float) -> Callable[[dict[str, pa.Array]], np.ndarray]:
    """Whether the whole sets of each pair are of likeness ``least``."""

    def keep(cols: dict[str, pa.Array]) -> np.ndarray:
        out = []
        for a, b in zip(cols["u_shingles"], cols["v_shingles"]):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            shared = len(np.intersect1d(a, b, assume_unique=True))
            out.append(shared >= least * (len(a) + len(b) - shared) - 1e-9)
        return np.array(out, bool)

    return keep


def _further_links(marked: DataFrame, labels: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """All links ``(u, v)`` of likeness ``least`` between documents of different ``labels(node, doc_id, label)``."""
    firsts = marked.join(labels, ["node", "doc_id"])
    place = F.shiftleft(F.col("size").cast("long"), 32) + F.col("pos")
    rows = firsts.select("doc_id", "label", "size", F.posexplode("tokens").alias("pos", "token")).select("token", "doc_id", "label", place.alias("place"))
    met = materialize(_meetings(rows, least).distinct(), "meetings")

    def may(cols: dict[str, pa.Array]) -> np.ndarray:
        a, b = (np.frombuffer(b"".join(cols[c].to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in ("u_cells", "v_cells"))
        return np.abs(a - b).sum(1) * (1 + least) <= (1 - least) * (cols["u_size"].to_numpy() + cols["v_size"].to_numpy()) + 1e-6

    near = materialize(_kept_pairs(met, firsts.select("doc_id", "size", "cells").distinct(), may), "near")
    wanted = near.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = materialize(_sets(texts, wanted, words).dropDuplicates(["doc_id", "shingles"]), "sets")
    return _kept_pairs(near, sets, alike_sets(least))


def similar_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """``(doc_id, component_id)``: component_id is the smallest doc_id of the similar documents, itself included.

    Texts of the same words belong together, blank ones too.  Rows without a doc_id are left out;
    repeated rows each get a row; an empty table gives none.
    """
    df = df.where(F.col(doc_id).isNotNull())
    marked = materialize(_marked(df, doc_id, text, words, least), "marked")
    nodes = materialize(marked.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp")), "nodes")
    members = materialize(components(nodes, radius).select("doc_id", "fp", "component_id"), "candidates")
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    linked = connected_components(_links(materialize(_blocks(members), "blocks"), texts, words, least))
    labels = nodes.join(linked.select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left")
    labels = materialize(labels.select("node", "doc_id", F.coalesce("label", "doc_id").alias("label")), "labels")
    further = _further_links(marked, labels, texts, words, least)
    ends = labels.select("doc_id", "label").distinct()
    for end in ("u", "v"):
        further = further.join(ends.select(F.col("doc_id").alias(end), F.col("label").alias(f"{end}_label")), end)
    joined = connected_components(further.select(F.col("u_label").alias("u"), F.col("v_label").alias("v")))
    named = labels.join(joined.select(F.col("node").alias("label"), "component"), "label", "left").select("node", F.coalesce("component", "label").alias("component_id"))
    return marked.select("node", "doc_id").join(materialize(named, "named"), "node").select("doc_id", "component_id")

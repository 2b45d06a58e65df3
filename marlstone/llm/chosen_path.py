"""MinHash near-duplicates by a chosen-path set similarity join.

Every set of shingles has ``FUNCTIONS`` minwise tokens.  A tree branches on them: a node's documents go to
its children by the values of tokens that the node's path picks, so what a document does depends on its
own tokens only, and two sets of likeness s go the same way with chance s.

* A node of up to ``SMALL`` documents is compared exhaustively.
* A larger node branches again, on ``BRANCH`` tokens.  A child that keeps more than ``DENSE`` of its parent's
  documents has documents so alike that branching won't part them: it is compared exhaustively too, in
  blocks, each against each.  So a level never has more rows than the one before, and the depth is
  logarithmic.
* ``trees_for`` says how many independent trees find a link of exactly the least likeness with the
  wanted recall (``RECALL``, one link in a million missed); higher likenesses are missed more rarely.

Nodes propose pairs by a sketch of the tokens, by sizes and by hashed shingle counts; the last two never
reject a link, the sketch rejects one in ten million.  Every link is confirmed on full sets.  Links are
found in two turns, because groups of thousands of copies have too many pairs: first each node's
documents are held against the node's most central ones and what links is joined under one label,
then exhaustively all pairs of a node whose labels differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._common import bounded_batches, map_batches
from marlstone.llm.components import connected_components
from marlstone.llm.similar import _kept_pairs, alike_sets, joined_sets, shingle_set
from marlstone.llm.simhash import _mix
from marlstone.session import materialize, table

WORDS, LEAST, RECALL = 3, 0.85, 0.999999
#: Minwise functions; of the first so many the lowest byte makes the sketch.
FUNCTIONS, SKETCH, CELLS = 128, 64, 256
#: Children of a node that branches, documents compared exhaustively, share of the parent that makes a child dense.
BRANCH, SMALL, DENSE = 2, 1024, 0.5
#: Documents of one block of a star that is verified on full sets.
STAR = 256

_rnd = np.random.default_rng(20)
_FACTORS = _rnd.integers(0, 1 << 63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rnd.integers(0, 1 << 63, FUNCTIONS, np.uint64)


def trees_for(least: float = LEAST, recall: float = RECALL) -> int:
    """Trees that find a pair of the least likeness with the given chance, however deep its nodes are.

    A pair survives a branching node with chance p = 1 - (1 - s p) ** BRANCH, and the root with s p.
    """
    p = 1.0
    for _ in range(1000):
        p = 1 - (1 - least * p) ** BRANCH
    return max(1, ceil(log(1 - recall) / log(1 - least * p)))


def sketch_need(least: float = LEAST, miss: float = 1e-7) -> int:
    """Equal sketch bytes below which a pair of the least likeness falls with a chance under ``miss`` (Chernoff's bound)."""
    need = int(least * SKETCH)
    while need > 0:
        q = need / SKETCH
        if SKETCH * (q * log(q / least) + (1 - q) * log((1 - q) / (1 - least))) > -log(miss):
            break
        need -= 1
    return need


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``FUNCTIONS`` minwise tokens for each of the non-empty sets."""
    if not sets:
        return np.zeros((0, FUNCTIONS), np.uint32)
    values = np.concatenate(sets).view(np.uint64)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), FUNCTIONS), np.uint32)
    for i in range(FUNCTIONS):
        out[:, i] = np.minimum.reduceat(values * _FACTORS[i] + _TERMS[i], starts) >> np.uint64(32)
    return out


def cell_counts(shingles: np.ndarray) -> bytes:
    """Counts of a set's shingles by hash, up to 255: sets differ in at least as many shingles as their counts do."""
    return np.minimum(np.bincount(shingles & (CELLS - 1), minlength=CELLS), 255).astype(np.uint8).tobytes()


def set_key(shingles: np.ndarray) -> str:
    """Names a set."""
    return xxhash.xxh128_hexdigest(shingles.tobytes())


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, key, size, mins, cells)`` of ``docs(doc_id, text)``; key names the set."""

    def run(cols: dict[str, list]) -> dict[str, object]:
        sets = [shingle_set(t, words) for t in cols["text"]]
        mins = iter(minwise([s for s in sets if len(s)]))
        return {
            "doc_id": cols["doc_id"],
            "key": list(map(set_key, sets)),
            "size": [len(s) for s in sets],
            "mins": [next(mins).tobytes() if len(s) else b"" for s in sets],
            "cells": [cell_counts(s) for s in sets],
        }

    return map_batches(docs, run, "doc_id long, key string, size int, mins binary, cells binary")


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column of one width."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _branched(rows: DataFrame, pick: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """``(cid, parent, node)`` of ``rows(cid, parent, at, mins)``: the nodes that ``pick`` gives for ``at`` and the tokens."""
    schema = pa.schema([("cid", pa.int64()), ("parent", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            at, mins = b.column(2).to_numpy().view(np.uint64), _matrix(b.column(3), np.uint32, FUNCTIONS)
            for step, token in pick(at, mins):
                node = _mix(_mix(at, np.uint64(7)) ^ _mix(step.astype(np.uint64) << np.uint64(32) | token.astype(np.uint64), np.uint64(11)), np.uint64(13))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node.view(np.int64))], schema=schema)

    bounded_batches(rows.sparkSession)
    return rows.select("cid", "parent", "at", "mins").mapInArrow(run, "cid long, parent long, node long")


def _roots(trees: int):
    def pick(at: np.ndarray, mins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for t in range(trees):
            yield np.full(len(at), t, np.uint64), mins[:, t % FUNCTIONS]

    return pick


def _children(at: np.ndarray, mins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(BRANCH):
        chosen = _mix(at, np.uint64(101 + k)) % np.uint64(FUNCTIONS)
        yield np.full(len(at), 1 << 20 | k, np.uint64), mins[np.arange(len(at)), chosen.astype(np.int64)]


def grow(classes: DataFrame, trees: int, small: int = SMALL) -> DataFrame:
    """``(node, cid, n)``: the leaves of all trees over ``classes(cid, mins)`` that hold two sets or more, n of them."""
    at = F.lit(0).cast("long")
    rows, leaves = _branched(classes.select("cid", at.alias("parent"), at.alias("at"), "mins"), _roots(trees)), []
    while True:
        rows = materialize(rows, "paths")
        counts = rows.groupBy("node").agg(F.count("*").alias("n"), F.first("parent").alias("before")).where("n > 1")
        met = materialize(rows.join(counts, "node").select("node", "cid", "n", "before"), "nodes")
        dense = (F.col("before") > 0) & (F.col("n") > DENSE * F.col("before"))
        leaves.append(met.where((F.col("n") <= small) | dense))
        crowded = met.where((F.col("n") > small) & ~dense)
        if crowded.isEmpty():
            break
        rows = _branched(crowded.join(classes, "cid").select("cid", F.col("n").alias("parent"), F.col("node").alias("at"), "mins"), _children)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionAll(x)
    return out.select("node", "cid", "n")


def _dealt(leaves: DataFrame, small: int, across: bool) -> DataFrame:
    """``(block, side, cid)``: a node is one block; one of more than ``small`` is cut in parts, or, ``across``, in a block for each two parts.

    In a block of two sides only pairs of different sides are of interest.
    """
    parts = F.ceil(F.col("n") / small).cast("long")
    own = F.pmod(F.xxhash64("cid", "node"), parts)
    keys = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.xxhash64("node", F.least(own, k), F.greatest(own, k))) if across else F.array(F.xxhash64("node", own))
    return leaves.select(F.explode(F.when(parts == 1, F.array("node")).otherwise(keys)).alias("block"), own.alias("side"), "cid")


def _in_blocks(rows: DataFrame, find: Callable[[list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Distinct pairs ``(u, v)``, u < v, that ``find`` proposes inside each block of ``rows(block, cid, sketch, ...)``; it gets the block's other columns, sketches and cells (if there are any)."""
    others, counted = [c for c in rows.columns if c not in ("block", "sketch", "cells")], "cells" in rows.columns
    rows = rows.repartition("block").sortWithinPartitions("block", "cid")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(t: pa.Table) -> Iterator[pa.RecordBatch]:
            block, cols = t["block"].to_numpy(), [t[c].to_numpy() for c in others]
            sketch = _matrix(t["sketch"], np.uint8, SKETCH)
            cells = _matrix(t["cells"], np.uint8, CELLS) if counted else sketch
            edge = np.append(np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))), len(block))
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            cid = cols[others.index("cid")]
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if z - a > 1:
                    i, j = find({c: x[a:z] for c, x in zip(others, cols)}, sketch[a:z], cells[a:z])
                    us.append(cid[a + i]), vs.append(cid[a + j])
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                u, v = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

        held = None
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            block = held["block"].to_numpy()
            cut = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0  # the last block may go on
            if cut:
                yield from settled(held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
        if held is not None:
            yield from settled(held.combine_chunks())

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, "u long, v long").distinct()


def _central(least: float):
    """Pairs of a block's members with the most central one, of those that are unlike it with their own most central one, and so on."""
    need = sketch_need(least)

    def find(cols: dict[str, np.ndarray], sketch: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest, us, vs = np.arange(len(sketch)), [], []
        while len(rest) > 1:
            centre = 0
            if len(rest) > 2:
                bits = np.unpackbits(sketch[rest], axis=1)
                centre = int(np.argmin((bits != (2 * bits.sum(0) > len(rest))).sum(1)))
            c = rest[centre]
            alike = (sketch[rest] == sketch[c]).sum(1) >= need
            alike[centre] = True
            met = rest[alike]
            us.append(np.full(len(met) - 1, c)), vs.append(met[met != c])
            rest = rest[~alike]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *us]), np.concatenate([none, *vs])

    return find


def _apart(least: float):
    """All pairs of a block that have different labels, stand on different sides if it has two, and may be links."""
    need = sketch_need(least)

    def find(cols: dict[str, np.ndarray], sketch: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, label, side = cols["size"].astype(np.int64), cols["label"], cols["side"]
        two, us, vs = side.min() != side.max(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        counts = cells.astype(np.int16)
        for i in range(len(size) - 1):
            j = np.arange(i + 1, len(size))
            ok = label[j] != label[i]
            if two:
                ok &= side[j] != side[i]
            ok &= np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i]) - 1e-9
            j = j[ok]
            if len(j):
                j = j[(sketch[j] == sketch[i]).sum(1) >= need]
            if len(j):
                j = j[np.abs(counts[j] - counts[i]).sum(1) * (1 + least) <= (1 - least) * (size[j] + size[i]) + 1e-6]
                us.append(np.full(len(j), i)), vs.append(j)
        return np.concatenate(us), np.concatenate(vs)

    return find


def _class_sets(docs: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """``(cid, shingles)`` of the classes ``named(cid, key, first_id)``, from the texts of their first documents."""
    texts = docs.join(named.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def sets(cols: dict[str, list]) -> dict[str, object]:
        found = [shingle_set(t, words) for t in cols["text"]]
        return {"key": list(map(set_key, found)), "shingles": found}

    made = map_batches(texts, sets, "key string, shingles array<long>").dropDuplicates(["key"])
    return made.join(named, "key").select("cid", "shingles")


def _star_links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, least: float, words: int) -> DataFrame:
    """Links ``(u, v)`` among ``pairs(u, v)``, confirmed on full sets; a star's ends meet in blocks that have its centre, where they are held against each other too.

    Texts are moved, not sets, which are larger and don't compress; a block makes them from the texts.
    """
    hubs = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.*")
    degree = hubs.groupBy("u").agg(F.count("*").alias("n"))
    both = pairs.join(degree.select("u", F.col("n").alias("nu")), "u").join(degree.select(F.col("u").alias("v"), F.col("n").alias("nv")), "v")
    hub = F.col("nu") >= F.col("nv")
    rays = materialize(both.select(F.when(hub, F.col("u")).otherwise(F.col("v")).alias("centre"), F.when(hub, F.col("v")).otherwise(F.col("u")).alias("cid")), "rays")
    parts = rays.groupBy("centre").agg(F.ceil(F.count("*") / STAR).cast("long").alias("parts"))
    dealt = rays.join(parts, "centre").select("centre", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("block"), "cid")
    centres = parts.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"), F.col("centre").alias("cid"))
    blocks = dealt.unionAll(centres).join(classes.select("cid", "key", F.col("first_id").alias("doc_id")), "cid")
    blocks = materialize(blocks.select("doc_id", "centre", "block", (F.col("cid") == F.col("centre")).alias("first"), "cid", "key"), "blocks")
    rows = blocks.join(docs, "doc_id").select("centre", "block", "first", "cid", "key", "text")
    rows = rows.repartition("centre", "block").sortWithinPartitions("centre", "block", F.desc("first"), "cid")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, [], []

        def close() -> pa.RecordBatch:
            got = [(ids[r], ids[i]) for i, r in enumerate(joined_sets(held, least)) if r != i]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], schema=schema)

        for b in batches:
            for centre, block, _, cid, key, text in zip(*(c.to_pylist() for c in b.columns)):
                if (centre, block) != at:
                    if len(ids) > 1:
                        yield close()
                    at, ids, held = (centre, block), [], []
                shingles = shingle_set(text, words)
                # another text under the same doc_id, or a repeated row
                if set_key(shingles) == key and (not ids or ids[-1] != cid):
                    ids.append(cid), held.append(shingles)
        if len(ids) > 1:
            yield close()

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, recall: float = RECALL, small: int = SMALL) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row; component_id is the smallest doc_id that links reach, itself included.

    Null, empty and blank texts have no shingle and are linked with nothing, not even with each other.
    Equal sets of shingles are one class and link whatever their order or number.  A row without a doc_id
    is linked with nothing and kept; rows repeated under one doc_id each get a row.  Texts of any length
    are read whole, ties can't arise, and an empty table gives no rows.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = materialize(_marked(docs, words), "marked")
    first = marked.where("size > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("size", "mins", "cells")])
    classes = materialize(first.withColumn("cid", F.monotonically_increasing_id()), "classes")
    leaves = grow(classes.select("cid", "mins"), trees_for(least, recall), small)
    packed = classes.select("cid", "size", F.substring("mins", 1, 4 * SKETCH).alias("mins"), "cells")
    sketch = map_batches(packed.join(leaves.select("cid").distinct(), "cid", "left_semi"), _sketched, "cid long, size int, sketch binary, cells binary")
    sketch = materialize(sketch, "sketches")

    proposed = materialize(_in_blocks(_dealt(leaves, small, False).select("block", "cid").join(sketch.select("cid", "sketch"), "cid"), _central(least)), "proposed")
    linked = connected_components(_star_links(proposed, docs, classes, least, words)).select(F.col("node").alias("cid"), F.col("component").alias("label"))
    labels = materialize(classes.select("cid", "first_id").join(linked, "cid", "left").select("cid", "first_id", F.coalesce("label", "cid").alias("label")), "labels")
    blocks = materialize(_dealt(leaves, small, True).join(labels.select("cid", "label"), "cid"), "blocks")
    mixed = blocks.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("block")
    near = materialize(_in_blocks(blocks.join(mixed, "block", "left_semi").join(sketch, "cid"), _apart(least)), "near")

    wanted = near.select(F.explode(F.array("u", "v")).alias("cid")).distinct()
    named = materialize(classes.join(wanted, "cid", "left_semi").select("cid", "key", "first_id"), "wanted")  # written, so Spark knows whether it is small
    further = _kept_pairs(near, materialize(_class_sets(docs, named, words).withColumnRenamed("cid", "doc_id"), "sets"), alike_sets(least))
    for end in ("u", "v"):
        further = further.join(labels.select(F.col("cid").alias(end), F.col("label").alias(f"{end}_label")), end)
    joined = connected_components(further.select(F.col("u_label").alias("u"), F.col("v_label").alias("v")))
    named = labels.join(joined.select(F.col("node").alias("label"), "component"), "label", "left").select("cid", "first_id", F.coalesce("component", "label").alias("component"))
    named = materialize(named, "named")
    least_id = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_key = named.join(least_id, "component").join(classes.select("cid", "key"), "cid").select("key", "component_id")
    out = marked.where("size > 0 and doc_id is not null").select("doc_id", "size", "key").join(by_key, "key").select("doc_id", "size", "component_id")
    out = out.unionAll(marked.where("size = 0 or doc_id is null").select("doc_id", "size", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def _sketched(cols: dict[str, list]) -> dict[str, object]:
    """The lowest byte of each of the first tokens."""
    mins = np.frombuffer(b"".join(cols["mins"]), np.uint32).reshape(-1, SKETCH)
    return {"cid": cols["cid"], "size": cols["size"], "cells": cols["cells"], "sketch": [r.tobytes() for r in (mins & 255).astype(np.uint8)]}


def op12_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles, component and verdict of every document; nulls, empty texts, repeats and clashing names as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))

"""SimHash near-duplicate detection by the generalised pigeonhole principle.

The 64 bits are grouped into m partitions, correlated bits together.  If thresholds t_1..t_m add
up to radius - m + 1, any fingerprint within the radius of a query differs from it in at most t_i
bits of some partition i (t_i = -1 leaves partition i out).  For each query the thresholds are
picked by dynamic programming over estimated candidate counts, so a query whose projection on one
partition is crowded is probed elsewhere.  Probes and index entries meet in buckets keyed by
partition and value; each met pair is verified on all 64 bits.

Only distinct fingerprints take part, and a bucket reports a spanning forest of its verified
links, never all pairs: links inside one component add nothing to the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._common import map_batches
from marlstone.llm.components import connected_components
from marlstone.session import materialize, table

BITS, RADIUS, SHINGLE = 64, 3, 3
#: Comparing two members of a bucket costs this much of moving and sorting one entry (measured: about
#: two nanoseconds against seven microseconds).
PAIR_COST = 1 / 4000
#: A threshold is offered only where it has at most so many signatures.
MOST_SIGNATURES = 100_000
#: Highest bits of a partition's value whose counts are known, for the estimates.
CELL_BITS = 12
#: A value is crowded from this share of all rows on (so a partition has at most so many crowded values).
CROWDED = 1 / 16384
#: Members of a bucket that one group holds; more are dealt in blocks, each against each.
SPLIT = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles (A-Z lower-cased, repeats voting again).

    Null and blank texts give 0; fewer words than a shingle vote as one sequence.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(joined, 42)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        view, h = joined, xxhash.xxh64_digest
        digests = b"".join([h(view[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())])
    votes = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(digests) // 8).tobytes(), "big")


def word_fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's words (A-Z lower-cased), each voting with its squared length in bytes.

    Long words carry the content, so texts that share only articles differ in half the bits, while
    replacing a few words in a hundred moves a few bits.  Null and blank texts give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(42))), np.uint8).reshape(-1, 8), axis=1)
    weight = np.fromiter(map(len, words), np.float64, len(words)) ** 2
    return int.from_bytes(np.packbits((weight @ bits) * 2 > weight.sum()).tobytes(), "big")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", make: Callable[[str | None], int] = fingerprint) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of each row's whole text as a signed 64-bit integer."""

    def run(cols: dict[str, list]) -> dict[str, object]:
        fp = np.array([make(t) for t in cols["text"]], np.uint64).view(np.int64)
        return {"doc_id": cols["doc_id"], "fp": fp}

    return map_batches(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each fingerprint, highest bit first."""
    return np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each pair of bits is set together, over all of them."""

    def run(cols: dict[str, list]) -> dict[str, object]:
        b = _bits(np.array(cols["fp"], np.int64).view(np.uint64)).astype(np.float64)
        both = (b.T @ b).astype(np.int64).ravel()
        return {"cell": np.append(np.arange(BITS * BITS), -1), "n": np.append(both, len(b))}

    rows = map_batches(fps.select("fp"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    got = {r["cell"]: r["n"] for r in rows}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(BITS * BITS)], np.float64).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal width; each grows by the bit most correlated with those it has."""
    if n < 2:
        corr = np.zeros((BITS, BITS))
    else:
        p = np.diag(both) / n
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    free, out = set(range(BITS)), []
    for k in range(m):
        width = (BITS - sum(map(len, out))) // (m - k)
        own = [min(free, key=lambda b: (-sum(corr[b, c] for c in free if c != b), b))]
        free.remove(own[0])
        while len(own) < width:
            best = min(free, key=lambda b: (-sum(corr[b, c] for c in own), b))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def masks_within(width: int, radius: int) -> list[np.ndarray]:
    """For each e up to radius, the values with exactly e of ``width`` bits set."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(width), e)], np.uint64) for e in range(radius + 1)]


def most_offered(width: int, radius: int) -> int:
    """The greatest threshold up to the radius with few enough signatures."""
    return max(e for e in range(radius + 1) if comb(width, e) <= MOST_SIGNATURES)


def project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of the given bits (0 is the highest of 64) of each fingerprint."""
    out = np.zeros(len(fp), np.uint64)
    for b in bits:
        out = (out << np.uint64(1)) | ((fp >> np.uint64(BITS - 1 - b)) & np.uint64(1))
    return out


def allocate(cost: np.ndarray, total: int) -> np.ndarray:
    """Thresholds of least summed cost for each query, by dynamic programming over partitions.

    ``cost[q, i, e + 1]`` is query q's cost of threshold e (from -1) on partition i; the thresholds
    of a query add up to ``total``.
    """
    q, m, levels = cost.shape
    goal = total + m  # thresholds counted from -1
    best = np.full((q, goal + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for i in range(m):
        new, pick = np.full((q, goal + 1), np.inf), np.zeros((q, goal + 1), np.int64)
        for e in range(min(levels, goal + 1)):
            with_e = np.full((q, goal + 1), np.inf)
            with_e[:, e:] = best[:, : goal + 1 - e] + cost[:, i, e][:, None]
            better = with_e < new
            new, pick = np.where(better, with_e, new), np.where(better, e, pick)
        best = new
        picks.append(pick)
    at, out = np.full(q, goal), np.zeros((q, m), np.int64)
    for i in reversed(range(m)):
        out[:, i] = picks[i][np.arange(q), at]
        at = at - out[:, i]
    return out - 1


class Plan:
    """How fingerprints are indexed and probed: bit groups, counts by the highest bits of each group, crowded values."""

    def __init__(self, groups: list[list[int]], n: int, crowded: list[dict[int, int]], radius: int = RADIUS, cells: list[np.ndarray] | None = None):
        self.groups, self.radius, self.n, self.crowded = groups, radius, n, crowded
        self.total = radius - len(groups) + 1
        self.crowded_values = [np.array(sorted(c), np.uint64) for c in crowded]
        self.crowded_counts = [np.array([c[v] for v in sorted(c)], float) for c in crowded]
        self.masks = [masks_within(len(g), most_offered(len(g), radius)) for g in groups]
        known = [min(CELL_BITS, len(g)) for g in groups]
        cells = cells or [np.full(1 << k, n / 2.0**k) for k in known]
        # near[i][e, cell]: expected members of the buckets that exactly e flips of a value of this cell reach
        self.near = []
        for g, k, count, masks in zip(groups, known, cells, self.masks):
            at, rest, none = np.arange(1 << k), len(g) - k, np.zeros(1 << k)
            reached = [sum((count[at ^ int(m)] for m in flips), none) for flips in masks_within(k, min(len(masks) - 1, k))]
            exactly = [sum((comb(rest, e - f) * reached[f] for f in range(min(e, len(reached) - 1) + 1)), none) for e in range(len(masks))]
            self.near.append(np.array(exactly) / 2.0**rest)

    def costs(self, fp: np.ndarray) -> np.ndarray:
        """Estimated price of signatures and candidates for each query, partition and threshold from -1 on.

        A threshold that isn't offered costs so much that it is never taken.
        """
        levels = self.radius + 2
        out = np.zeros((len(fp), len(self.groups), levels))
        for i, g in enumerate(self.groups):
            value = project(fp, g)
            cell = (value >> np.uint64(len(g) - min(CELL_BITS, len(g)))).astype(np.int64)
            candidates = self.near[i][:, cell]
            if len(self.crowded_values[i]):
                at = np.minimum(np.searchsorted(self.crowded_values[i], value), len(self.crowded_values[i]) - 1)
                candidates[0] = np.where(self.crowded_values[i][at] == value, self.crowded_counts[i][at], candidates[0])
            out[:, i, len(self.masks[i]) + 1 :] = 1e18
            for e in range(len(self.masks[i])):
                out[:, i, e + 1] = out[:, i, e] + len(self.masks[i][e]) + PAIR_COST * candidates[e]
        return out

    def entries(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bucket, fp)`` of every index entry and probe; a bucket is a hash of partition and value.

        A crowded value has no bucket of its own.  Its members agree, pair by pair within the
        radius, on one of radius + 1 blocks of bits at least, so they meet in a bucket for each block.
        """
        t = allocate(self.costs(fp), self.total)
        keys, owners = [], []

        def put(part: int, value: np.ndarray, own: np.ndarray) -> None:
            seed = np.uint64((part + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
            key, crowd = _mix(value, seed), np.isin(value, self.crowded_values[part])
            keys.append(key[~crowd]), owners.append(own[~crowd])
            if crowd.any():
                step = BITS // (self.radius + 1)
                for i in range(self.radius + 1):
                    block = (own[crowd] >> np.uint64(i * step)) & np.uint64((1 << step) - 1)
                    keys.append(_mix(key[crowd] ^ _mix(block, np.uint64(i + 1)), seed)), owners.append(own[crowd])

        for i, g in enumerate(self.groups):
            value = project(fp, g)
            put(i, value, fp)
            for e in range(1, len(self.masks[i])):
                chosen = np.flatnonzero(t[:, i] >= e)
                if len(chosen):
                    masks = self.masks[i][e]
                    put(i, (value[chosen][:, None] ^ masks[None, :]).ravel(), np.repeat(fp[chosen], len(masks)))
        return np.concatenate(keys), np.concatenate(owners)


def _mix(value: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A bijection of 64 bits that differs for each seed (the finaliser of splitmix64)."""
    x = value * np.uint64(0x9E3779B97F4A7C15) + seed
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def make_plan(fps: DataFrame, radius: int = RADIUS) -> Plan:
    """A plan for distinct ``fps(fp)``: the number of partitions with the least expected work, the
    correlated bit groups, how many rows each value of a group's highest bits has (``CELL_BITS``), and the
    crowded values: over ``CROWDED`` of all rows and over eight times an even share."""
    n, both = bit_moments(fps)

    def work(m: int) -> float:
        t = radius - m + 1
        widths = [len(range(i, BITS, m)) for i in range(m)]
        # the dynamic programme may do better for a query; price thresholds spread evenly
        each = [t // m + (i < t % m) for i in range(m)]
        if any(e > most_offered(w, radius) for w, e in zip(widths, each)):
            return float("inf")
        return sum((1 + sum(comb(w, k) for k in range(1, e + 1))) * (1 + PAIR_COST * n / 2.0**w) for w, e in zip(widths, each))

    m = min(range(2, radius + 2), key=work)
    groups = group_bits(n, both, m)
    sources = [F.struct(F.lit(i).alias("part"), _project_sql(g).alias("value")) for i, g in enumerate(groups)]
    counts = fps.select(F.explode(F.array(*sources)).alias("x")).groupBy("x.part", "x.value").agg(F.count("*").alias("n"))
    least = F.element_at(F.array(*[F.lit(float(max(64, n * CROWDED, 8 * n / 2.0 ** len(g)))) for g in groups]), F.col("part") + 1)
    rows = counts.where(F.col("n") > least).collect()
    known = [min(CELL_BITS, len(g)) for g in groups]
    cells = [np.zeros(1 << k) for k in known]
    tops = [F.struct(F.lit(i).alias("part"), _project_sql(g[:k]).cast("int").alias("cell")) for i, (g, k) in enumerate(zip(groups, known))]
    for r in fps.select(F.explode(F.array(*tops)).alias("x")).groupBy("x.part", "x.cell").agg(F.count("*").alias("n")).collect():
        cells[r["part"]][r["cell"]] = r["n"]
    return Plan(groups, n, [{r["value"]: r["n"] for r in rows if r["part"] == i} for i in range(m)], radius, cells)


def _project_sql(bits: list[int]):
    """``project`` as a SQL expression."""
    out = F.lit(0).cast("long")
    for b in bits:
        out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(F.col("fp"), BITS - 1 - b).bitwiseAND(F.lit(1).cast("long")))
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing bits."""
    return np.bitwise_count(a ^ b)


def forest(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that connect exactly what links within the radius connect among ``fp``.

    Breadth first over an array of unvisited members, so a dense bucket is settled after a few
    passes instead of a pass for each pair.
    """
    rest, out = np.unique(fp), []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            x, front = front[0], front[1:]
            near = distance(rest, x) <= radius
            if near.any():
                got = rest[near]
                out.extend((int(x), int(y)) for y in got)
                front, rest = np.concatenate((front, got)), rest[~near]
    return out


def _links_in(keys: np.ndarray, fp: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Verified links inside runs of equal keys (sorted by key)."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    two = first[size == 2]
    ok = distance(fp[two], fp[two + 1]) <= radius
    us, vs = [fp[two][ok]], [fp[two + 1][ok]]
    for a, k in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        if got := forest(fp[a : a + k], radius):
            us.append(np.array([x for x, _ in got], np.uint64)), vs.append(np.array([y for _, y in got], np.uint64))
    return us, vs


def bucket_links(entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(u, v)`` between the fingerprints that share a bucket of ``entries(bucket, fp)``.

    Rows come sorted by bucket; a bucket cut by a batch boundary is carried over.  A bucket of more
    than ``SPLIT`` members is dealt in blocks by hash, each block against each, so no task holds more
    than two blocks of it.  Repeated entries count once, none give no links, nulls are not allowed.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            us, vs = _links_in(keys[:cut], fp[:cut], radius) if cut else ([], [])
            keys, fp = keys[cut:], fp[cut:]
            if us and sum(map(len, us)):
                yield pa.RecordBatch.from_arrays([np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)], schema=schema)
        if len(keys):
            us, vs = _links_in(keys, fp, radius)
            yield pa.RecordBatch.from_arrays([np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)], schema=schema)

    return _dealt(entries).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


def _dealt(entries: DataFrame, split: int = SPLIT) -> DataFrame:
    """``entries(bucket, fp)`` with large buckets cut: every two members of a bucket share a bucket of the result."""
    entries = materialize(entries.select("bucket", "fp"), "entries")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > split)
    parts = F.ceil(F.col("n") / split)
    own = F.pmod(F.xxhash64("fp"), parts)
    others = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.xxhash64("bucket", F.least(own, k), F.greatest(own, k)))
    keys = F.when(F.col("n").isNull(), F.array("bucket")).otherwise(others)
    return entries.join(sizes, "bucket", "left").select(F.explode(keys).alias("bucket"), "fp")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)`` links that connect the distinct ``fps(fp)`` exactly as all pairs within the radius do.

    Repeated fingerprints give no link of their own; null ones are not allowed; no rows give no links.
    """
    plan = make_plan(fps, radius)
    spark = fps.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20_000)
    schema = pa.schema([("bucket", pa.int64()), ("fp", pa.int64())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(all_fp), 4096):
                k, f = plan.entries(all_fp[at : at + 4096])
                yield pa.RecordBatch.from_arrays([k.view(np.int64), f.view(np.int64)], schema=schema)

    entries = fps.select("fp").mapInArrow(expand, "bucket long, fp long")
    return bucket_links(entries, radius)


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of ``docs(doc_id, fp)``.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits reach, the
    document itself included.  Repeated rows stay; a null doc_id keeps its row and is never the
    smallest unless its whole component has none.
    """
    docs = materialize(docs.select("doc_id", "fp"), "fingerprints")
    first = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    linked = connected_components(links(first.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    linked = materialize(linked.join(first, "fp"), "linked")
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "component").select("fp", "component_id")
    named = first.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return docs.join(materialize(named, "components"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", make: Callable[[str | None], int] = fingerprint, radius: int = RADIUS) -> DataFrame:
    """Near-duplicate components of the texts of a table, see ``components``; an empty table gives no rows."""
    return components(fingerprints(df, doc_id, text, make), radius)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

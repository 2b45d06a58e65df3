"""Best-fit packing of documents into fixed-length sequences after Martello-Toth reduction.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most that many
cells however large the corpus is.  The histogram is solved on the driver:

* reduction fixes a set of one or two pieces as a sequence when no other choice can be better: a piece
  alone when nothing fits beside it; a piece and its best partner when the partner fills the rest or
  when no two pieces fit beside it (or none that beat the partner); larger sets are left to best-fit;
* the remainder is packed best-fit in falling length, equal lengths and equal sequences in bulk.

The solution says which ranks of each length go to which sequences; every piece finds its rank by
counts for (length, hash bucket), so no task sees more of a hot length than its share, and looks
its place up in the solution's interval table, whose size the capacity bounds.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm._common import BATCH_BYTES, bounded_batches, gathered, give_back
from marlstone.session import materialize, table

CAPACITY, END = 4096, 1
#: Longer texts are encoded alone, in parts of about so many code points.
LONG_TEXT = 4 << 20
#: Bytes of text whose words are looked up together: half of what other operators take, for a word's ids
#: weigh much more than its letters.  Words that the library encodes at once.
BATCH, WORDS = BATCH_BYTES // 2, 1 << 15
#: Rows of one length that share a rank bucket, about.
BUCKET_ROWS = 2000


class WordIds:
    """Ids of texts by the tokenizers library, asked once for each distinct word of a batch.

    The vocabulary drops white space and no pattern of its splits crosses it, so the parts of a text
    between blanks and line ends can be encoded apart.  A batch's words are dictionary-encoded in
    Arrow; nothing is remembered from one batch to the next.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already share the cores
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f) | {"truncation": None, "padding": None}
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        # for runs of lower-case letters, which normaliser and split would pass unchanged, between blanks
        by_byte = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, by_byte]}}
        self.plain = Tokenizer.from_str(json.dumps(spec))
        suffix = spec["model"]["end_of_word_suffix"]
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def ids(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text and then ``END``, as unsigned 32-bit integers; null is empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        longest = pc.max(pc.binary_length(texts)).as_py() or 0
        if longest <= LONG_TEXT:
            yield from self._batch(texts)
            return
        for text in texts.to_pylist():
            parts = list(_parts(text or ""))
            yield np.concatenate([got[: len(got) - (k < len(parts) - 1)] for k, p in enumerate(parts) for got in self._batch(pa.array([p]))])

    def _batch(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        first, n, tokens = self._distinct(words.dictionary)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        # one word more, of the one token END, after each text
        order = np.insert(words.indices.to_numpy().astype(np.int64), ends[1:], len(n))
        first, n, tokens = np.append(first, len(tokens)), np.append(n, 1), np.append(tokens, np.uint32(END))
        flat = tokens[_ragged(first[order], n[order])]
        cuts = np.cumsum(n[order])[ends[1:] + np.arange(len(texts))]
        return np.split(flat, cuts)[: len(texts)]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's ids start, how many they are, and all of them."""
        simple = pc.match_substring_regex(words, _SIMPLE).to_numpy(zero_copy_only=False)
        closed = pc.utf8_lower(words.filter(pa.array(simple)))
        sign = pc.utf8_slice_codeunits(closed, -1)
        signed = pc.is_in(sign, pa.array([".", ","], sign.type)).to_numpy(zero_copy_only=False)
        core = pc.if_else(pa.array(signed), pc.utf8_slice_codeunits(closed, 0, -1), closed).dictionary_encode()
        # some at a time: an encoding weighs a hundred times its text
        own = np.concatenate([np.zeros(0, np.uint32), *(self._joined(core.dictionary.slice(k, WORDS)) for k in range(0, len(core.dictionary), WORDS))])
        end = np.flatnonzero(self.closes[own]) + 1
        if len(end) != len(core.dictionary):
            raise ValueError("a word has not exactly one closing token")
        start = np.append(0, end)[:-1]
        odd = words.filter(pa.array(~simple))
        rest = [x.ids for k in range(0, len(odd), WORDS) for x in self.tokenizer.encode_batch_fast(odd.slice(k, WORDS).to_pylist(), add_special_tokens=False)]
        signs = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,"}
        if any(len(x) != 1 for x in signs.values()):
            raise ValueError("a closing sign is not one token")
        at = core.indices.to_numpy()
        n = np.zeros(len(words), np.int64)
        n[simple] = (end - start)[at] + signed
        n[~simple] = [len(x) for x in rest]
        first = np.cumsum(n) - n
        tokens = np.zeros(int(n.sum()), np.uint32)
        tokens[_ragged(first[simple], (end - start)[at])] = own[_ragged(start[at], (end - start)[at])]
        closing = np.where(pc.equal(sign, ".").to_numpy(zero_copy_only=False), *(signs[c][0] for c in ".,"))
        tokens[(first[simple] + n[simple] - 1)[signed]] = closing[signed]
        tokens[_ragged(first[~simple], n[~simple])] = [i for x in rest for i in x]
        return first, n, tokens

    def _joined(self, words: pa.Array) -> np.ndarray:
        """Ids of plain words, one after another."""
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        return np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


#: Letters of the first 256 code points whose normal form and lower case are letters of them too, and
#: perhaps a full stop or comma after them, which is always a split of its own.
_SIMPLE = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?$"


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` (``n[i]`` numbers) for each i, joined."""
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) + np.repeat(first - (total - n), n)


def _parts(text: str) -> Iterator[str]:
    """A text cut at blanks or line ends into parts of about ``LONG_TEXT`` code points, the first blank of a cut left out."""
    at, cut = 0, re.compile("[ \n]")
    while len(text) - at > LONG_TEXT and (m := cut.search(text, at + LONG_TEXT)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


@lru_cache(4)
def load(path: str) -> WordIds:
    """The vocabulary at ``path``, once for each Python worker."""
    return WordIds(path)


def cut_pieces(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids cut into pieces of ``capacity``.

    Null and empty texts have the closing id alone; a text of any length is read whole; repeated rows
    each give their pieces; an empty table gives none; other columns aren't read, so can't clash.
    """

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, BATCH):
            rows: list[tuple] = []
            for d, ids in zip(b.column(0).to_pylist(), load(path).ids(b.column(1))):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((d, k, at, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 5, types)], names=names)
        give_back()

    bounded_batches(df.sparkSession)
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Histogram:
    """Counts of lengths with the neighbour searches that reduction and best-fit need."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def largest(self, at_most: int) -> int | None:
        """The largest length there is of at most ``at_most``."""
        i = bisect_left(self.lengths, at_most + 1)
        return self.lengths[i - 1] if i else None

    def best_two(self, room: int) -> int:
        """The largest sum of two pieces that fits ``room``, or 0."""
        best, i, j = 0, 0, bisect_left(self.lengths, room) - 1
        while i <= j:
            a, b = self.lengths[i], self.lengths[j]
            if a + b > room:
                j -= 1
            elif i == j and self.counts[a] < 2:
                break
            else:
                best = max(best, a + b)
                if best == room:
                    break
                i += 1
        return best


def reduce_instance(h: Histogram, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences ``(lengths, how many)`` fixed by dominance, longest piece first; takes them out of ``h``."""
    fixed = []
    for w in sorted(h.lengths, reverse=True):
        while (n := h.counts.get(w, 0)) > 0:
            room = capacity - w
            h.take(w, 1)  # w itself is not its own partner unless there is another
            partner = h.largest(room)
            least = h.lengths[0] if h.lengths else None
            h.take(w, -1) if w in h.counts else _put_back(h, w)
            if partner is None:
                fixed.append(((w,), n))
                h.take(w, n)
                continue
            many = n // 2 if partner == w else min(n, h.counts[partner])
            two = least is not None and 2 * least <= room
            if w + partner == capacity or not two:
                fixed.append(((w, partner), many))
                _take_set(h, (w, partner), many)
                continue
            if 3 * least > room:  # three never fit beside w
                h.take(w, 1)
                pair = h.best_two(room)
                h.take(w, -1) if w in h.counts else _put_back(h, w)
                if partner >= pair:
                    fixed.append(((w, partner), 1))
                    _take_set(h, (w, partner), 1)
                    continue
            break
    return fixed


def _put_back(h: Histogram, w: int) -> None:
    h.counts[w] = 1
    insort(h.lengths, w)


def _take_set(h: Histogram, lengths: tuple[int, ...], n: int) -> None:
    for x in lengths:
        h.take(x, n)


def best_fit(h: Histogram, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit in falling length; sequences with equal contents are held and filled as one group."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def open_group(room: int, lengths: tuple[int, ...], n: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((lengths, n))

    for w in sorted(h.lengths, reverse=True):
        n = h.counts[w]
        while n:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                k = capacity // w  # equal pieces go on filling the sequence that the last one left tightest
                full, rest = divmod(n, k)
                if full:
                    open_group(capacity - k * w, (w,) * k, full)
                if rest:
                    open_group(capacity - rest * w, (w,) * rest, 1)
                break
            room = rooms[i]
            lengths, m = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            k = room // w
            used = min(m, n // k)
            if used:
                open_group(room - k * w, lengths + (w,) * k, used)
                n -= used * k
            if used < m:
                if rest := min(n, k):
                    open_group(room - rest * w, lengths + (w,) * rest, 1)
                    n -= rest
                if m - used - bool(rest):
                    open_group(room, lengths, m - used - bool(rest))
    return [g for room in rooms for g in groups[room]]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences ``(lengths, how many)`` that hold all pieces of a length histogram."""
    h = Histogram(counts)
    return reduce_instance(h, capacity) + best_fit(h, capacity)


def intervals(solution: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows ``(length, first rank, how many, first sequence, offset)``, sorted: ranks of a length, in order, to slots."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in solution:
        offset = 0
        for w in lengths:
            rows.append((w, used.get(w, 0), n, sequence, offset))
            used[w] = used.get(w, 0) + n
            offset += w
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces(doc_id, piece, start, length, ids_crc32)``.

    Every row gets a place, repeated rows and null doc_ids too; no rows give none.
    """
    pieces = materialize(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    solution = intervals(solve(counts, capacity))
    buckets = max(64, sum(counts.values()) // BUCKET_ROWS)
    split = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = split.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = split.withColumn("own", own).join(starts, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))
    return _place(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), solution)


def _place(ranked: DataFrame, solution: np.ndarray) -> DataFrame:
    """Looks each ``(length, rank)`` up in the interval table (bounded by the capacity, not by the corpus)."""
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    shift = np.int64(1 << 44)
    keys = solution[:, 0] * shift + solution[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            row = solution[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=names)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))

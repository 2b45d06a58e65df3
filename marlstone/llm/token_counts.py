"""Token counts by rank-synchronous array merging over a piece vocabulary with byte fallback.

Pre-tokens of a batch stand as ragged numpy arrays: one flat array of symbols and one of sequence
numbers.  Each step finds every sequence's best pair (lowest rank, leftmost on ties) and applies all
of them at once; sequences without a pair left leave the arrays.  A sequence merges one pair a step
because a merge here may make a pair of a better rank than its own, which has to go next.  What
counts is the symbols that survive, a character outside the vocabulary counting as its UTF-8 bytes.

A pre-token is cut where two characters stand side by side in no piece: no merge ever joins them.  Of
what is longer still, such as a page of letters without a blank, a rescan at each step would cost the
square of its length; there the lowest rank is kept for each block of symbols.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._common import Memo, map_batches
from marlstone.session import table

LIMIT = 4096
#: Pre-tokens remembered by one Python worker, and the longest that is.
CACHE_ENTRIES, CACHE_LENGTH = 250_000, 40
#: Longer sequences keep their lowest ranks by blocks of so many symbols.
BLOCK = 256
SPACE = "▁"
_NONE = 1 << 62
#: Within a text no piece goes from another character to a space mark, so these parts never merge.
PRETOKEN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceCounter:
    """Merge table of a sentence-piece BPE model, and the batch counter over it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in normal}
        rank = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i)))}
        if any(SPACE in p.lstrip(SPACE) for p in ids) or any(p[0] == p[1] == SPACE and p.strip(SPACE) for p in ids if len(p) > 1):
            raise ValueError("a piece crosses a pre-token's end")
        if {c for p in ids for c in p} - ids.keys():
            raise ValueError("a piece has a character that is no piece")
        pairs = sorted((ids[p[:i]] << 20 | ids[p[i:]], rank[ids[p]], ids[p]) for p in ids for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids)
        self.keys, self.rank, self.merged = (np.array(x, np.int64) for x in zip(*pairs))
        self.chars = {c: i for c, i in ids.items() if len(c) == 1}
        self.beside = np.unique([self.chars[p[i]] << 20 | self.chars[p[i + 1]] for p in ids for i in range(len(p) - 1)])
        self.merges = {int(k): int(r) << 20 | int(m) for k, r, m in zip(self.keys, self.rank, self.merged)}
        self.cache = Memo(CACHE_ENTRIES, CACHE_LENGTH, lambda piece: int(self.count_pretokens([piece])[0]))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and its place in the merge table; no such merge gives the highest rank."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (left >= 0) & (right >= 0) & (self.keys[at] == key)
        return np.where(known, self.rank[at], len(self.keys)), at

    def count_pretokens(self, pieces: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        text = "".join(pieces)
        sym = np.fromiter((self.chars.get(c, -1) for c in text), np.int64, len(text))
        seq = np.repeat(np.arange(len(pieces)), lens)
        unknown = np.flatnonzero(sym < 0)
        # a character outside the vocabulary never merges; its further bytes are added to the count
        extra = np.array([len(text[i].encode("utf-8", "surrogatepass")) - 1 for i in unknown.tolist()], np.int64)
        counts = np.bincount(seq, minlength=len(pieces)) + np.bincount(seq[unknown], extra, len(pieces)).astype(np.int64)
        piece = seq
        joined = (seq[1:] == seq[:-1]) & (sym[:-1] >= 0) & (sym[1:] >= 0) & np.isin(sym[:-1] << 20 | sym[1:], self.beside)
        seq = np.concatenate(([0], np.cumsum(~joined))) if len(sym) else seq
        size = np.bincount(seq)
        for k in np.flatnonzero(size > BLOCK).tolist():
            at = np.searchsorted(seq, k)
            counts[piece[at]] -= self._merges_of_long(sym[at : at + size[k]])
        short = (size > 1)[seq] & (size <= BLOCK)[seq]
        owner = piece[np.searchsorted(seq, np.arange(len(size)))]
        sym, seq = sym[short], seq[short]
        same = seq[1:] == seq[:-1]
        rank, at = self.pair_ranks(sym[:-1], sym[1:])
        rank = np.append(np.where(same, rank, len(self.keys)), len(self.keys))[: len(sym)]
        at = np.append(at, 0)[: len(sym)]
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            best = np.minimum.reduceat(rank, first)
            live = np.repeat(best < len(self.keys), np.diff(np.append(first, len(seq))))
            if not live.all():
                sym, seq, rank, at = sym[live], seq[live], rank[live], at[live]
                if not len(sym):
                    break
                best = best[best < len(self.keys)]
                first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            hits = np.flatnonzero(rank == np.repeat(best, np.diff(np.append(first, len(seq)))))
            hits = hits[np.concatenate(([True], seq[hits][1:] != seq[hits][:-1]))]  # leftmost in its sequence
            np.subtract.at(counts, owner[seq[hits]], 1)
            sym[hits] = self.merged[at[hits]]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            moved = hits - np.arange(len(hits))  # where the merged symbols are after the others went
            sym, seq, rank, at = sym[keep], seq[keep], rank[keep], at[keep]
            for i in (moved, moved[moved > 0] - 1):
                i = i[i < len(sym)]
                j = np.minimum(i + 1, len(sym) - 1)
                r, a = self.pair_ranks(sym[i], sym[j])
                rank[i], at[i] = np.where((seq[i] == seq[j]) & (i != j), r, len(self.keys)), a
        return counts

    def _merges_of_long(self, sym: np.ndarray) -> int:
        """Number of merges of one long sequence: the lowest rank, leftmost on ties, found by the blocks' lowest ones."""
        get, mask = self.merges.get, (1 << 20) - 1
        blocks = [sym[i : i + BLOCK].tolist() for i in range(0, len(sym), BLOCK)]
        flat = sym.tolist()
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(flat, flat[1:])] + [_NONE]
        order = [ranks[i : i + BLOCK] for i in range(0, len(sym), BLOCK)]
        after, before = list(range(1, len(blocks) + 1)), list(range(-1, len(blocks) - 1))
        best = [min(o) for o in order]
        heap, n = [(b, k) for k, b in enumerate(best)], 0
        heapify(heap)

        def pair(k: int, i: int) -> int:
            if i + 1 < len(blocks[k]):
                return get(blocks[k][i] << 20 | blocks[k][i + 1], _NONE)
            return get(blocks[k][i] << 20 | blocks[after[k]][0], _NONE) if after[k] < len(blocks) else _NONE

        while heap and heap[0][0] < _NONE:
            b, k = heap[0]
            if b != best[k]:
                heappop(heap)
                continue
            i, n = order[k].index(b), n + 1
            blocks[k][i] = b & mask
            j, at = (k, i + 1) if i + 1 < len(blocks[k]) else (after[k], 0)
            del blocks[j][at], order[j][at]
            if not blocks[j]:
                after[before[j]] = after[j]
                if after[j] < len(blocks):
                    before[after[j]] = before[j]
            order[k][i] = pair(k, i)
            touched = {k, j}
            if i:
                order[k][i - 1] = pair(k, i - 1)
            elif before[k] >= 0:
                touched.add(before[k])
                order[before[k]][-1] = pair(before[k], len(blocks[before[k]]) - 1)
            for t in touched:
                low = min(order[t], default=_NONE)
                if low != best[t]:
                    best[t] = low
                    heappush(heap, (low, t))
        return n

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each whole text; the pre-tokens new to the worker go through the arrays at once."""
        split = [PRETOKEN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.cache.fill(set().union(*split), lambda new: self.count_pretokens(new).tolist())
        return [sum(map(self.cache.__getitem__, parts)) for parts in split]


@lru_cache(4)
def load(path: str) -> PieceCounter:
    """The model at ``path``, once for each Python worker."""
    return PieceCounter(path)


def count_tokens(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each whole text.

    Null and empty texts count 0; repeated rows each give a row; an empty table gives none.
    """

    def run(cols: dict[str, list]) -> dict[str, object]:
        return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], "n_tokens": load(path).count(cols["text"])}

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    out = map_batches(source, run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 32k piece model, and which exceed 4096."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

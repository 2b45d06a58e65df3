"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental decoder.

A merge list makes the token at a place depend only on a bounded number of bytes to its right: a
merge of rank r is undone only by an earlier merge of its right part's tail with what follows, that
one only by a still earlier merge further right, and so on down the ranks.  The longest such chain
of falling ranks, measured in bytes, is the list's sufficient lookahead.  The encoder holds one
window of a pre-token, emits a token as soon as that many bytes follow it, and moves on; what it
keeps does not grow with the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._common import Memo, map_batches
from marlstone.session import table

#: The split of byte-level BPE vocabularies of this family (fixed by the vocabulary's public format).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered by one Python worker, and the longest that is.
CACHE_ENTRIES, CACHE_LENGTH = 250_000, 40
#: Texts of more code points are scanned match by match, and so many matches' ids are held.
CHUNK = 1 << 16
#: Code points of a pre-token given to the transducer at once.
STEP = 4096


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A merge list with its vocabulary, its sufficient lookahead, an encoder and a decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.pieces: list[bytes] = [b""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in self.vocab.items():
            self.pieces[i] = token
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.merges: dict[int, int] = {}
        pairs = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            pairs.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
            self.merges[self.vocab[a] << 20 | self.vocab[b]] = rank << 20 | self.vocab[a + b]
        self.byte_ids = [self.vocab[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.vocab))
        self.lookahead = self._lookahead(pairs)
        self.pattern = regex.compile(PRETOKEN)
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache = Memo(CACHE_ENTRIES, CACHE_LENGTH, self.encode_pretoken)

    def _lookahead(self, pairs: list[tuple[int, int, int]]) -> int:
        """Bytes to the right of a token's end that settle it: the longest chain of falling ranks.

        ``reach[t]`` is how far a chain goes whose first merge has the token t on its left.
        """
        tail: dict[int, int] = {c: b for _, b, c in reversed(pairs)}
        reach: dict[int, int] = {}
        longest = 0
        for a, b, _ in pairs:
            t, most = b, 0
            while True:  # b, its right part, that one's right part, ...
                most = max(most, reach.get(t, 0))
                if t not in tail:
                    break
                t = tail[t]
            far = len(self.pieces[b]) + most
            reach[a] = max(reach.get(a, 0), far)
            longest = max(longest, far)
        return longest

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one short byte string: the lowest-rank pair merges first, leftmost first."""
        ids = [self.byte_ids[b] for b in data]
        get, none = self.merges.get, 1 << 62
        order = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]  # rank and merged id in one number
        while order and (best := min(order)) < none:
            i = order.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], order[i]
            if i:
                order[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(order):
                order[i] = get(ids[i] << 20 | ids[i + 1], none)
        return ids

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one pre-token given in chunks of any size; a window of two lookaheads is all it holds."""
        window = self.longest + 2 * self.lookahead
        held = b""
        for chunk in chunks:
            held += chunk
            while len(held) > window:
                ids, end, stable = self.merge(held[:window]), 0, []
                for i in ids:
                    if end + len(self.pieces[i]) + self.lookahead > window:
                        break
                    end += len(self.pieces[i])
                    stable.append(i)
                yield stable
                held = held[end:]
        if held:
            yield self.merge(held)

    def encode_pretoken(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        return b"".join(self._streamed(piece, 0, len(piece)))

    def _streamed(self, text: str, at: int, end: int) -> Iterator[bytes]:
        chunks = (text[i : min(i + STEP, end)].encode("utf-8", "surrogatepass") for i in range(at, end, STEP))
        for ids in self.stream(chunks):
            yield np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Ids of a text, a chunk at a time; strings of special tokens in it become those tokens."""
        at, text = 0, text or ""
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            yield from self._ordinary(text, at, m.start())
            yield np.array([self.special[m[0]]], "<u4").tobytes()
            at = m.end()
        yield from self._ordinary(text, at, len(text))

    def _ordinary(self, text: str, at: int, end: int) -> Iterator[bytes]:
        if end - at <= CHUNK:
            yield b"".join(map(self.cache.__getitem__, self.pattern.findall(text, at, end)))
            return
        held = []
        for m in self.pattern.finditer(text, at, end):
            if m.end() - m.start() > STEP:  # its ids leave while it is still read
                yield b"".join(held)
                held = []
                yield from self._streamed(text, m.start(), m.end())
                continue
            held.append(self.cache[m[0]])
            if len(held) >= CHUNK:
                yield b"".join(held)
                held = []
        yield b"".join(held)

    def decoder(self) -> "Decoder":
        return Decoder(self.pieces)


class Decoder:
    """Byte-to-text state machine: ids in, text out as soon as its bytes make whole characters.

    Ill-formed bytes become U+FFFD, one for each maximal ill-formed part.
    """

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.state = pieces, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes, last: bool = False) -> str:
        """Text of further ids (little-endian unsigned 32-bit), all but an unfinished character."""
        got = np.frombuffer(ids, "<u4").tolist()
        return self.state.decode(b"".join(map(self.pieces.__getitem__, got)), last)


@lru_cache(4)
def load(path: str) -> Bpe:
    """The vocabulary at ``path``, once for each Python worker."""
    return Bpe(path)


def digest(bpe: Bpe, text: str | None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids, and SHA-256 of what they decode to, in one pass."""
    n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), bpe.decoder()
    for ids in bpe.encode(text):
        n += len(ids) // 4
        ids_hash.update(ids)
        text_hash.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
    text_hash.update(decoder.feed(b"", True).encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of each whole text; null and empty texts give an empty list, repeated rows each a row, an empty table none."""

    def run(cols: dict[str, list]) -> dict[str, object]:
        bpe = load(path)
        return {"doc_id": cols["doc_id"], "ids": [np.frombuffer(b"".join(bpe.encode(t)), "<u4").astype(np.int32) for t in cols["text"]]}

    return map_batches(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of each list of ids; null and empty lists give an empty text, repeated rows each a row, an empty table none."""

    def run(cols: dict[str, list]) -> dict[str, object]:
        bpe = load(path)
        return {"doc_id": cols["doc_id"], "text": [bpe.decoder().feed(np.array(x or [], "<u4").tobytes(), True) for x in cols["ids"]]}

    return map_batches(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")), run, "doc_id long, text string")


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each whole text.

    Null and empty texts have no ids; repeated rows each give a row; an empty table gives none.
    """

    def run(cols: dict[str, list]) -> dict[str, object]:
        bpe = load(path)
        got = [digest(bpe, t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_tokens": [x[0] for x in got], "ids_sha256": [x[1] for x in got], "decoded_sha256": [x[2] for x in got]}

    return map_batches(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the 50k byte-level vocabulary and decoded again."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

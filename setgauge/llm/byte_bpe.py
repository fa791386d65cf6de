"""Byte-level BPE by backtracking over longest matches.

A split piece is mapped byte by byte to Latin-1, so pyahocorasick can search it; the automaton of all
tokens, turned around, runs once over the turned piece and gives the longest token that starts at each byte.
The encoder walks from the left: it takes the longest token that fits the one before, else the next
shorter one that is a prefix of it, else it steps back over the last token and never returns to that place. Two
tokens fit if merging their joined bytes by rank gives just the two; a row of tokens in which all neighbours
fit is what the merges give, so the result is exact. Answers are remembered per pair, and each place is left for
good at most once, so time is linear in the piece.

Distinct pieces are encoded once as long as the memory of a worker holds; it is bounded in bytes, and long
pieces are not remembered. Texts are split in slices, so of a very long text only the text itself is held.

Cases: null and empty texts have no ids and decode to nothing. Repeated rows give repeated rows. An empty table
gives an empty table. Other columns are ignored. The ranks must hold all 256 single bytes. doc_id keeps its type.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from setgauge.llm.common import map_texts

#: Bytes of pieces, ids and overhead that a worker remembers, twice over; bytes of the longest piece remembered.
MEMORY, LONG = 48 << 20, 128
#: Pairs of tokens remembered, pieces taken from a text at once, characters of a text that is split at once.
PAIRS, SLICE, WHOLE = 1 << 19, 1 << 16, 1 << 20

#: Fixed value: how texts are split for these ranks.
SPLITS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of ASCII and Latin-1 without control characters; the splits above, spelled out for them.
WESTERN = re.compile("[\t-\r -~\xa1-\xff]*").fullmatch
LETTER, NUMBER, BLANK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r "
WESTERN_SPLITS = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
)

ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
DIGEST = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
)


class Pieces(dict):
    """Piece to its ids as little-endian bytes; encodes what it lacks and forgets the older half when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older, self.held = encode, {}, 0

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.encode(piece)
        if len(piece) <= LONG:
            self.held += len(piece) + len(found) + 250  # about what two objects and a place in the table take
            if self.held > MEMORY:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = found
        return found


class BacktrackingEncoder:
    """Ids of one file of ranks, split by one pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, file)}
        if not all(chr(b) in self.ranks for b in range(256)):
            raise ValueError(f"{path} lacks single bytes")
        self.size = max(self.ranks.values()) + 1
        self.token = [""] * self.size
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.bytes_of = [t.encode("latin-1") for t in self.token]
        self.shorter = array("l", [-1]) * self.size
        self.turned = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.turned.add_word(token[::-1], rank)
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in self.ranks:
                    self.shorter[rank] = self.ranks[token[:n]]
                    break
        self.turned.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known = Pieces(self.piece)
        self.splits = regex.compile(pattern)
        self.short = pattern == SPLITS

    def merged(self, text: str) -> list[int]:
        """Ids by the merges themselves, lowest rank first; for a few joined bytes only."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, self.size) for a, b in zip(parts, parts[1:])]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == self.size:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two neighbours (left -1: this token alone) as they are."""
        pair = left * self.size + right
        answer = self.pairs.get(pair)
        if answer is None:
            if left < 0:
                answer = self.merged(self.token[right]) == [right]
            else:
                answer = self.merged(self.token[left] + self.token[right]) == [left, right]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[pair] = answer
        return answer

    def longest(self, text: str) -> array:
        """For each byte, the longest token that starts there."""
        found, last = array("l", [-1]) * len(text), len(text) - 1
        for end, rank in self.turned.iter(text[::-1]):
            at = last - end
            if found[at] < 0 or len(self.token[rank]) > len(self.token[found[at]]):
                found[at] = rank
        return found

    def backtracked(self, text: str) -> array:
        """Ids of bytes in Latin-1."""
        longest, size = self.longest(text), len(text)
        closed, ids, at, next_id = bytearray(size + 1), array("l"), 0, longest[0]
        while True:
            before = ids[-1] if ids else -1
            while next_id >= 0:
                end = at + len(self.token[next_id])
                if not closed[end] and self.fits(before, next_id):
                    break
                next_id = self.shorter[next_id]
            if next_id >= 0:
                ids.append(next_id)
                at = end
                if at == size:
                    return ids
                next_id = longest[at]
            else:  # nothing fits here: the last token must be a shorter one
                closed[at] = 1
                next_id = ids.pop()
                at -= len(self.token[next_id])

    def piece(self, piece: str) -> bytes:
        """Ids of one split piece as little-endian bytes."""
        text = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        rank = self.ranks.get(text)
        ids = [rank] if rank is not None else self.backtracked(text)
        return np.asarray(ids, "<u4").tobytes()

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The split pieces of a text, many at a time."""
        splits = WESTERN_SPLITS if self.short and WESTERN(text) else self.splits
        if len(text) <= WHOLE:
            yield splits.findall(text)
            return
        found = (m.group() for m in splits.finditer(text))
        while part := list(islice(found, SLICE)):
            yield part

    def parts(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian bytes, slice by slice."""
        for pieces in self.pieces(text):
            yield b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.parts(text)), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BacktrackingEncoder:
    """One encoder per worker, file and pattern."""
    return BacktrackingEncoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str = SPLITS) -> DataFrame:
    """(doc_id, ids) of whole texts."""
    return map_texts(docs, lambda texts: {"ids": [encoder(path, pattern).encode(t) for t in texts]}, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str = SPLITS) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids); null ids give no bytes, and an id outside the vocabulary is an error."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encoder(path, pattern).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str = SPLITS) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them, in one pass."""

    def work(texts: list[str]) -> dict[str, list]:
        own, out = encoder(path, pattern), {n: [] for n in DIGEST.names}
        for text in texts:
            n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            for part in own.parts(text):
                n += len(part) // 4
                ids.update(part)
                decoded.update(own.decode(np.frombuffer(part, "<u4").tolist()))
            for name, value in zip(DIGEST.names, (n, ids.hexdigest(), decoded.hexdigest())):
                out[name].append(value)
        return out

    return map_texts(docs, work, DIGEST)

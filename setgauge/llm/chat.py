"""Chat formatting by token-level assembly.

Each text is encoded on its own and put between reserved ids: one that opens a turn of its role and
one that closes it. Reserved ids lie above the vocabulary, so no text can give one. The loss mask
comes from prefix sums over the ids: a token counts where more assistant turns were opened than
closed before it. As text, a conversation reads

    ### Role: text
    </turn>

and control strings inside a text (or a role that has no marker of its own) get a backslash in
front, however many they have already; reading back takes one away, so any text survives.

Cases: null texts and roles are empty strings. Rows are ordered by turn, then role, then text; null
turns come first; equal rows stay as often as they are there. A null conv_id is a conversation. An empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Roles with a marker of their own; any other role is written out between the next two.
ROLES = ("system", "user", "assistant", "tool")
OTHER = "### Role:"
NAMED = "</role>"
CLOSE = "</turn>"
OPEN = {role: f"### {role.capitalize()}:" for role in ROLES}
CONTROLS = (*OPEN.values(), OTHER, NAMED, CLOSE)
CONTROL = "|".join(map(re.escape, CONTROLS))
ESCAPE = re.compile(rf"\\*(?:{CONTROL})")
UNESCAPE = re.compile(rf"\\(\\*(?:{CONTROL}))")
#: Turns of this role are learned.
LOSS_ROLE = "assistant"

ENCODED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("loss_mask", T.ArrayType(T.ByteType(), False)),
        T.StructField("formatted", T.StringType()),
    ]
)
DIGEST = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
    ]
)


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


class Template:
    """Reserved ids, and what they stand for in text, on top of a byte-level vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.coding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.opening = {role: first + i for i, role in enumerate(ROLES)}
        self.other, self.named, self.close = (first + len(ROLES) + i for i in range(3))
        self.role_of = {i: role for role, i in self.opening.items()}
        self.first = first

    def turn(self, role: str, text: str) -> list[int]:
        """Ids of one turn: opening marker, escaped text, closing marker."""
        body = self.coding.encode_ordinary(escape(text))
        if role in self.opening:
            return [self.opening[role], *body, self.close]
        return [self.other, *self.coding.encode_ordinary(escape(role)), self.named, *body, self.close]

    def loss_mask(self, ids: np.ndarray) -> np.ndarray:
        """1 on the tokens between an assistant marker and the next closing marker, by prefix sums."""
        opens, closes = ids == self.opening[LOSS_ROLE], ids == self.close
        begun, ended = np.cumsum(opens), np.cumsum(closes)
        # turns closed before the last assistant marker; the turn is open while no more are
        before = np.maximum.accumulate(np.where(opens, ended, -1))
        return ((begun > 0) & (ended == before) & ~opens).astype(np.int8)

    def pieces(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(reserved id, start, stop): each marker with the ordinary ids that follow it."""
        marks = np.flatnonzero(ids >= self.first)
        for at, stop in zip(marks.tolist(), [*marks[1:].tolist(), len(ids)]):
            yield int(ids[at]), at + 1, stop

    def read(self, ids: list[int]) -> list[tuple[str, str]]:
        """(role, text) of each turn in the ids."""
        array, turns, role = np.asarray(ids, np.int64), [], None
        for mark, a, b in self.pieces(array):
            body = self.coding.decode_bytes(ids[a:b]).decode() if b > a else ""
            if mark in self.role_of:
                turns.append((self.role_of[mark], unescape(body)))
            elif mark == self.other:
                role = unescape(body)
            elif mark == self.named:
                turns.append((role, unescape(body)))
        return turns

    def loss_text(self, ids: list[int], mask: np.ndarray) -> str:
        """Unescaped text under the mask; a run of masked tokens is one text."""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
        runs = zip(edges[::2].tolist(), edges[1::2].tolist())
        return "".join(unescape(self.coding.decode_bytes(ids[a:b]).decode()) for a, b in runs)

    def text(self, ids: list[int]) -> str:
        """The conversation as text, markers written out."""
        out = []
        for mark, a, b in self.pieces(np.asarray(ids, np.int64)):
            body = self.coding.decode_bytes(ids[a:b]).decode() if b > a else ""
            if mark in self.role_of:
                out.append(f"{OPEN[self.role_of[mark]]} {body}\n")
            elif mark == self.other:
                out.append(f"{OTHER} {body}\n")
            elif mark == self.named:
                out.append(f"{NAMED} {body}\n")
            else:
                out.append(f"{CLOSE}\n")
        return "".join(out)


TURN = re.compile(rf"(?:({'|'.join(map(re.escape, OPEN.values()))}) |{re.escape(OTHER)} (.*?)\n{re.escape(NAMED)} )(.*?)\n{re.escape(CLOSE)}\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the text form alone."""
    by_marker = {v: k for k, v in OPEN.items()}
    return [(by_marker[m[1]] if m[1] else unescape(m[2]), unescape(m[3])) for m in TURN.finditer(formatted)]


@lru_cache(maxsize=2)
def template(path: str, pattern: str) -> Template:
    return Template(path, pattern)


def encode_turns(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every row with its ids, loss mask and text form; no rows meet, so no conversation is too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(ENCODED)
        for batch in batches:
            t = template(path, pattern)
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = part.to_pydict()
                ids = [t.turn(r, x) for r, x in zip(rows["role"], rows["text"])]
                masks = [t.loss_mask(np.asarray(i)).tolist() for i in ids]
                columns = [rows[n] for n in ("conv_id", "turn", "role", "text")] + [ids, masks, [t.text(i) for i in ids]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    clean = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return clean.mapInArrow(run, ENCODED)


def in_order(encoded: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order; sorted on disk where memory is short."""
    return encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digests(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per conversation, read back from ids and masks.

    The sorted turns stream by; of a conversation only running digests and counts are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(DIGEST)
        t = template(path, pattern)
        open_id, held, done = object(), None, []

        def row():
            return (open_id, held["turns"], held["all"].hexdigest(), held["loss_chars"], held["loss"].hexdigest(), held["chars"], held["tokens"], held["loss_tokens"])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for conv, ids, mask, formatted in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "ids", "loss_mask", "formatted"))):
                if held is None or conv != open_id:
                    if held is not None:
                        done.append(row())
                    open_id = conv
                    held = {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0, "loss_tokens": 0}
                for role, text in t.read(ids):
                    held["turns"] += 1
                    held["all"].update(f"{role}\n{text}\n".encode())
                under = t.loss_text(ids, np.asarray(mask, np.int8))
                held["loss"].update(under.encode())
                held["loss_chars"] += len(under)
                held["chars"] += len(formatted)
                held["tokens"] += len(ids)
                held["loss_tokens"] += sum(mask)
                if len(done) >= 1000:
                    yield batch_of(done)
                    done = []
        if held is not None:
            done.append(row())
        if done:
            yield batch_of(done)

    return in_order(encoded).select("conv_id", "ids", "loss_mask", "formatted").mapInArrow(run, DIGEST)

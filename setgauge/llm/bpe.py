"""BPE encoding and decoding with forced boundaries.

The vocabulary decides which pairs of neighbouring bytes occur inside some token. A pair that
occurs in none can never be merged over, so the text can be cut there for certain: white space
first (dropped by the tokenizer, in no token at all), then the unseen pairs inside a word. The
fragments are encoded independently, each distinct one once per worker as long as the bounded
memory holds, and their ids are concatenated.

Cases: null and empty texts have no ids, an empty id string and an empty decoded text. Repeated
rows give repeated rows. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Distinct words that a worker remembers; of those before them it keeps as many again.
MEMORY = 200_000
#: White space that the tokenizer drops and that is in no token.
BLANK = " \t\n\r\x0b\x0c"

#: Fixed value of the tokenizer file: how it splits words.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Text of printable ASCII and Latin-1 is in NFC already, and its lower case has no context; the split above, spelled out for it.
WESTERN = re.compile("[\t-\r -~\xa1-\xff]+").fullmatch
WESTERN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+").findall


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = byte_letters()

ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
DIGEST = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
)


class ForcedBoundaryEncoder:
    """Ids of one tokenizer file (BPE over byte letters with word ends), fragment by fragment."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.end = described["model"].get("end_of_word_suffix") or ""
        inner = json.loads(json.dumps(described))
        inner["model"]["end_of_word_suffix"] = None
        self.inner = Tokenizer.from_str(json.dumps(inner))
        self.added = [t["content"] for t in described.get("added_tokens", [])]
        self.seen = set()
        for token in described["model"]["vocab"]:
            if self.end and token.endswith(self.end):
                token = token[: -len(self.end)]
            self.seen.update(zip(token, token[1:]))
        self.normalize = self.whole.normalizer.normalize_str if self.whole.normalizer else str
        self.pieces = self.whole.pre_tokenizer.pre_tokenize_str
        self.tokenize, self.tokenize_inner = self.whole.model.tokenize, self.inner.model.tokenize
        self.tokens = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        # the short way below holds for files that normalise and split as this one; any other takes the library's steps
        steps = [n.get("type") for n in (described.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (described.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.short = steps == ["NFC", "Replace", "Lowercase"] and splits == [SPLITS, None]
        self.words: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.fragments: dict[str, tuple[str, int, str]] = {}

    def cuts(self, word: str) -> list[str]:
        """A word in byte letters, cut between letters that are neighbours in no token."""
        if all(map(self.seen.__contains__, zip(word, word[1:]))):
            return [word]
        starts = [0, *(i + 1 for i, pair in enumerate(zip(word, word[1:])) if pair not in self.seen), len(word)]
        return [word[a:b] for a, b in zip(starts, starts[1:])]

    def word(self, word: str) -> tuple[str, int, str]:
        """Of a word in byte letters: decimal ids, their number, and the tokens, both joined by one space."""
        *inner, last = self.cuts(word)
        ids = [t.id for part in inner for t in self.tokenize_inner(part)] + [t.id for t in self.tokenize(last)]
        return self.described(ids)

    def described(self, ids: list[int]) -> tuple[str, int, str]:
        return " ".join(map(str, ids)), len(ids), " ".join(map(self.tokens.__getitem__, ids))

    def western(self, word: str) -> tuple[str, int, str]:
        """The same of a word in lower-case Latin letters."""
        found = self.older.pop(word, None) or self.word(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS))
        if len(self.words) >= MEMORY:
            self.older, self.words = self.words, {}
        self.words[word] = found
        return found

    def fragment(self, fragment: str) -> tuple[str, int, str]:
        """The same of any piece of text without white space."""
        found = self.fragments.get(fragment)
        if found is None:
            if any(t in fragment for t in self.added):
                found = self.described(self.whole.encode(fragment, add_special_tokens=False).ids)
            else:
                parts = [self.word(w) for w, _ in self.pieces(self.normalize(fragment))]
                found = joined([p for p in parts if p[1]])
            if len(self.fragments) >= MEMORY:
                self.fragments.clear()
            self.fragments[fragment] = found
        return found

    def encode_and_decode(self, text: str) -> tuple[str, int, str]:
        """Decimal ids, their number, and the decoded text."""
        if self.short and WESTERN(text) and not any(t in text for t in self.added):
            return joined([self.words.get(w) or self.western(w) for w in WESTERN_WORDS(text.lower())])
        return joined([f for f in map(self.fragment, split(text)) if f[1]])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_and_decode(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library does for a file without a decoder: the tokens, joined by a space."""
        return " ".join(t for t in map(self.tokens.get, ids) if t is not None)


def joined(parts: list[tuple[str, int, str]]) -> tuple[str, int, str]:
    return (" ".join([p[0] for p in parts]), sum([p[1] for p in parts]), " ".join([p[2] for p in parts]))


split = re.compile(f"[^{BLANK}]+").findall


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    """One encoder per worker and file."""
    return ForcedBoundaryEncoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of whole texts."""
    from setgauge.llm.common import map_texts

    return map_texts(docs, lambda texts: {"ids": [encoder(path).encode(t) for t in texts]}, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [encoder(path).decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text, in one pass."""
    from setgauge.llm.common import map_texts

    def work(texts):
        enc, out = encoder(path), {n: [] for n in DIGEST.names}
        for text in texts:
            ids, n, decoded = enc.encode_and_decode(text)
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        return out

    return map_texts(docs, work, DIGEST)

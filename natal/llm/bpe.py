"""Byte-pair encoding and decoding with forced-boundary splitting.

A merge joins two neighbouring tokens into a longer token of the vocabulary, so the two bytes at
the join are neighbours inside that token. A pair of bytes that is a neighbour inside no token
can therefore never be merged across: between such bytes a cut is certain. Texts are cut at
certain spaces, into the tokenizer's own pieces and at those byte pairs; each fragment is encoded
by itself and the ids are concatenated. Fragments recur, so their ids are kept per worker.

Cases: a null text counts as empty and has no ids; the special token's string is one id, as the
library has it; texts of any length; repeated and null ids keep their rows; an empty table gives an
empty result; other columns stay, one that has the name of the added column is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from natal.llm.common import rows_of, tokenizer_path

#: A space between white space on both sides: not a certain cut, such texts are pre-split whole.
_UNSURE = re.compile(r"\s (?:\s|\Z)")
#: Fixed value: the public pattern by which vocabularies of this kind pre-split texts.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Below this character all Unicode versions agree on what is a letter, a number or white space.
_SETTLED = re.compile("[\0-\u024f]*")
#: Marks that the pattern takes together after a word.
_MARKS = ".,;:!?()\"%&*#$"
#: Fragments kept per worker; clearing the store changes no result.
KEPT = 700_000
#: Rank of a pair that no merge joins, and the bits below a rank that hold the new id.
_NEVER, _BITS = 1 << 60, 24
#: Longer strings are not kept.
LONG = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Kept(dict):
    """Values by key, made on demand and dropped when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder for a byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        vocabulary = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in [*vocabulary.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.table[i] = token
        self.byte_ids = [vocabulary[bytes([b])] for b in range(256)]
        ids = {token: i for token, i in spec["model"]["vocab"].items()}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left] << _BITS | ids[right]] = rank << _BITS | ids[left + right]
        # Pairs of bytes that are neighbours inside some token; all others force a boundary.
        inside = np.zeros((256, 256), dtype=bool)
        for token in vocabulary:
            if len(token) > 1:
                b = np.frombuffer(token, dtype=np.uint8)
                inside[b[:-1], b[1:]] = True
        self.inside = inside
        self.joined = set(zip(*(a.tolist() for a in np.nonzero(inside))))
        self.split = ByteLevel(add_prefix_space=False, use_regex=True)
        self.byte_of = byte_of
        self.whole = self._engine(vocabulary)
        self.fragments = _Kept(self._fragment)
        self.firsts = _Kept(lambda word: self._chunk("", word))
        self.spaced = _Kept(lambda word: self._chunk(" ", word))
        self.cuts = re.compile("|".join(re.escape(t) for t in self.special)) if self.special else None

    def pieces(self, text: str) -> list[bytes]:
        """The tokenizer's own pre-split, as bytes."""
        if _SETTLED.fullmatch(text):
            return [p.encode() for p in PATTERN.findall(text)]
        return [bytes(map(self.byte_of.__getitem__, shown)) for shown, _ in self.split.pre_tokenize_str(text)]

    def forced(self, piece: bytes) -> list[bytes]:
        """Cut a piece wherever its neighbouring bytes are neighbours inside no token."""
        if self.joined.issuperset(zip(piece, piece[1:])):
            return [piece]
        cuts = [i for i, pair in enumerate(zip(piece, piece[1:]), 1) if pair not in self.joined]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])]

    def _piece(self, piece: bytes) -> bytes:
        found = self.forced(piece)
        return self._fragment(piece) if len(found) == 1 else b"".join(map(self.fragments.__getitem__, found))

    def _chunk(self, lead: str, word: str) -> bytes:
        """Ids of what stands between two certain spaces; ``lead`` is the first space or empty."""
        same = self.spaced if lead else self.firsts
        core = word.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or _SETTLED.fullmatch(core)):
            if len(core) == len(word):
                return self._piece((lead + word).encode())
            return same[core] + self.firsts[word[len(core) :]]
        if len(word) <= LONG:  # a line break between two words is a piece of its own
            left, line, right = word.partition("\n")
            if line and left and right and not left[-1].isspace() and not right[0].isspace():
                return same[left] + self.fragments[b"\n"] + self.firsts[right]
        return self._split(lead + word)

    def _split(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.pieces(text)))

    def _engine(self, vocabulary: dict[bytes, int]):
        """The rank-based engine for whole fragments, where ids rise with the ranks of merges."""
        new = [m & ((1 << _BITS) - 1) for m in self.merges.values()]
        if sorted(vocabulary.values()) != list(range(len(vocabulary))) or new != sorted(set(new)) or max(self.byte_ids) > new[0]:
            return None
        import tiktoken

        return tiktoken.Encoding("fragments", pat_str=r"(?s:.+)", mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary

    def _fragment(self, fragment: bytes) -> bytes:
        if self.whole and len(fragment) <= LONG:
            try:
                ids = self.whole(fragment.decode())
                return struct.pack(f"<{len(ids)}I", *ids)
            except UnicodeDecodeError:  # cut inside a character
                pass
        ids = [self.byte_ids[b] for b in fragment]
        ids = self._merge_few(ids) if len(ids) <= 48 else self._merge_many(ids)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge_few(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        find, new_id = self.merges.get, (1 << _BITS) - 1
        ranks = [find(a << _BITS | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < _NEVER:
            at = ranks.index(best)
            ids[at : at + 2] = [best & new_id]
            del ranks[at]
            if at:
                ranks[at - 1] = find(ids[at - 1] << _BITS | ids[at], _NEVER)
            if at < len(ranks):
                ranks[at] = find(ids[at] << _BITS | ids[at + 1], _NEVER)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for long fragments."""
        n, find, new_id = len(ids), self.merges.get, (1 << _BITS) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := find(ids[i] << _BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = m & new_id, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := find(ids[a] << _BITS | ids[b])) is not None:
                    heapq.heappush(heap, (m, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def _plain(self, text: str) -> bytes:
        if _UNSURE.search(text):
            return self._split(text)
        first, *rest = text.split(" ")
        return (self.firsts[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """Ids as packed little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.cuts is None or not self.cuts.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cuts.finditer(text):
            out += [self._plain(text[at : m.start()]) if m.start() > at else b"", np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join(out) + (self._plain(text[at:]) if at < len(text) else b"")

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


def encode(df: DataFrame, column: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``into``: the token ids of ``column`` as an array."""
    path = path or tokenizer_path()
    schema = StructType([f for f in df.schema if f.name != into] + [StructField(into, ArrayType(IntegerType(), False), False)])
    names = [f.name for f in schema][:-1]

    def run(batches):
        coder = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed = [coder.encode(t) for t in rows_of(part, column)]
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], ids], [*names, into])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """Replace ``ids`` by ``into``: the text that the ids stand for (empty for null or no ids)."""
    path = path or tokenizer_path()
    schema = StructType([f for f in df.schema if f.name not in (ids, into)] + [StructField(into, StringType(), False)])
    names = [f.name for f in schema][:-1]

    def run(batches):
        coder = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = pa.array([coder.decode(v or ()) for v in rows_of(part, ids, 16)], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], text], [*names, into])

    return df.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of encoding and decoding every text: the query's columns."""
    coded = encode(docs.select("doc_id", "text"), path=path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        "ids",
    )
    return decode(coded, path=path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )

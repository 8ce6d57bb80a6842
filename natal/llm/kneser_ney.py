"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays.

Counting. Each task turns its texts into 64-bit word hashes with numpy, folds equal word pairs
and sends them to shards of the pair's hash. A second hash of every word goes along once per fold, and
two words that share the first one make training fail instead of merging unseen; another
``seed`` draws other hashes. A shard adds up its pairs and writes two arrays to the
shared folder: sorted 64-bit pair hashes and counts. From its pairs it sends on, per context, how
many types were seen once, twice and more, and per word its count and its number of different
contexts; a second round of shards writes these as sorted arrays by word. A frequent context is
spread over eight shards, a frequent pair is folded in every task before it moves.

Scoring. Workers memory-map the arrays, so all tasks of a machine share one copy in the page
cache, and look up whole blocks of pairs by binary search. With

    p(w)   = (n(.w) - D) / n(..) + g / (V + 1)
    p(w|v) = (c(vw) - D) / c(v)  + g(v) p(w)

n(.w) is the number of contexts of w, D the modified discounts from counts of counts, and g the
mass that they free; an unseen context leaves p(w), an unseen word g / (V + 1).

The order is two: on the test corpus 27 million tokens hold 19 million different triples, 16 million
of them seen once, and whole (unpruned) triples would not fit the disk that the counts may use.

The shared folder must be one that workers can map (a mounted path); from any other store that
pyarrow can open each machine copies the arrays it needs to the folder that Spark keeps for the
application's files, and Spark removes it.

Cases: null texts count as empty and hold the end token only; a null id is never trained on;
repeated rows count as often as they occur; without any training text every token has
probability 1; texts of any length; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from natal.llm.common import remainder, rows_of, tasks
from natal.session import scratch_path

HELD_OUT_OF, HELD_OUT = 7, 2
#: Bytes of text per shard of word pairs.
SHARD = 8 << 20
#: Tokens that a task folds at a time, and bytes of text that are hashed at a time.
FOLD = 1_000_000
CHUNK = 1 << 19
#: Words whose second hash a task remembers to have sent.
REMEMBERED = 1_000_000
#: Hashes of the two markers; word hashes are larger.
START, END = 0, 1
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
SEED = 7


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


@lru_cache(maxsize=8)
def _letters(seed: int) -> np.ndarray:
    """A random odd number for every byte."""
    return np.random.default_rng(seed).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return out[0], out[1]


def word_hashes(buffer: bytes, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of lower-cased bytes."""
    b = np.frombuffer(buffer, dtype=np.uint8)
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = np.r_[False, ~_SPACE[b], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(1 << max(20, int(len(b)).bit_length()))
    sums = np.r_[np.uint64(0), np.cumsum(_letters(seed)[b] * powers[: len(b)])]
    h = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    return starts, np.maximum(_mix(h), np.uint64(2))


def sequences(texts: list[bytes], seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, text number) of every token of some texts, the end token included."""
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts, h = word_hashes(b" ".join(texts).lower(), seed)
    upto = np.searchsorted(starts, np.cumsum(lengths))
    ends = upto + np.arange(len(texts))
    word = np.empty(len(h) + len(texts), dtype=np.uint64)
    is_end = np.zeros(len(word), dtype=bool)
    is_end[ends] = True
    word[ends], word[~is_end] = END, h
    context = np.r_[np.uint64(START), word[:-1]]
    context[context == END] = START
    return context, word, np.repeat(np.arange(len(texts)), np.diff(np.r_[-1, ends]))


def chunks(texts, size: int = CHUNK):
    """Lists of encoded texts of about ``size`` bytes; a longer text is a list of its own."""
    held, total = [], 0
    for t in texts:
        t = (t or "").encode()
        held.append(t)
        total += len(t)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(context * np.uint64(_BASE) + word)


def shard_of(context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    """A context's pairs are spread over eight shards."""
    return (_mix(context * np.uint64(8) + (word & np.uint64(7))) % np.uint64(shards)).astype(np.int64)


def _folded(context, word, count):
    """Equal pairs added up, in the order of their hashes."""
    key = pair_hash(context, word)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
    total = np.add.reduceat(count[order], first) if len(first) else count[:0]
    at = order[first]
    return key[first], context[at], word[at], total


def _packed(h: np.ndarray) -> bytes:
    return h.astype("<u8").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u8")


def _small(count: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as single bytes; those of 255 and more again in full."""
    return np.minimum(count, 255).astype(np.uint8).tobytes(), count[count >= 255].astype("<u8").tobytes()


def _large(low: bytes, high: bytes) -> np.ndarray:
    count = np.frombuffer(low, dtype=np.uint8).astype(np.int64)
    count[count == 255] = np.frombuffer(high, dtype="<u8")
    return count


class Store:
    """Arrays in the shared folder: written whole, read by memory map."""

    def __init__(self, uri: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)

    def put(self, name: str, **arrays: np.ndarray) -> None:
        """Write next to the place and move there, so a repeated task does no harm."""
        self.fs.create_dir(self.root, recursive=True)
        for part, array in arrays.items():
            held = io.BytesIO()
            np.save(held, array)
            spare = f"{self.root}/.{name}.{part}.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(spare) as out:
                out.write(held.getvalue())
            self.fs.move(spare, f"{self.root}/{name}.{part}.npy")

    def get(self, name: str, *parts: str) -> list[np.ndarray]:
        return [self._map(f"{name}.{part}.npy") for part in parts]

    @lru_cache(maxsize=8192)  # noqa: B019  one store per worker
    def _map(self, name: str) -> np.ndarray:
        path = f"{self.root}/{name}"
        if not isinstance(self.fs, pafs.LocalFileSystem):
            local = os.path.join(SparkFiles.getRootDirectory(), f"lm-{hashlib.sha1(self.root.encode()).hexdigest()}-{name}")
            if not os.path.exists(local):
                pafs.copy_files(path, f"{local}.{os.getpid()}", source_filesystem=self.fs, destination_filesystem=pafs.LocalFileSystem())
                os.replace(f"{local}.{os.getpid()}", local)
            path = local
        return np.load(path, mmap_mode="r")


@lru_cache(maxsize=2)
def store(uri: str) -> Store:
    return Store(uri)


@dataclass(frozen=True)
class Model:
    """What scoring needs besides the arrays: shard counts, totals and discounts."""

    uri: str
    shards: int
    word_shards: int
    tokens: int
    distinct: int
    pairs: int
    texts: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    freed: float
    seed: int = SEED

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, number of contexts, mass freed as a context) of sorted word hashes."""
        count, wide, freed = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys))
        shard = (_mix(keys) % np.uint64(self.word_shards)).astype(np.int64)
        for s, rows in _by(shard):
            key, n, contexts, types = store(self.uri).get(f"words-{s}", "key", "count", "contexts", "types")
            at, hit = _find(key, keys[rows])
            rows = rows[hit]
            count[rows], wide[rows] = n[at], contexts[at]
            freed[rows] = types[at] @ np.array(self.pair_discounts)
        return count, wide, freed

    def pair_counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), np.int64)
        if not self.pairs:
            return out
        wanted = pair_hash(context, word)
        for s, rows in _by(shard_of(context, word, self.shards)):
            key, low, high_key, high = store(self.uri).get(f"pairs-{s}", "key", "low", "high_key", "high")
            at, hit = _find(key, wanted[rows])
            out[rows[hit]] = low[at]
            big = rows[out[rows] == 255]
            if len(big):
                out[big] = high[np.searchsorted(high_key, wanted[big])]
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, log10 of the base, log10 of the model."""
        context, word, text = sequences(texts, self.seed)
        number = np.bincount(text, minlength=len(texts))
        if not self.tokens:
            none = np.zeros(len(texts))
            return number, none.astype(np.int64), none, none
        keys, inverse = np.unique(np.r_[np.uint64(START), word], return_inverse=True)
        count, wide, freed = self.words(keys)
        w = inverse[1:]
        v = np.where(context == START, inverse[0], np.r_[0, w[:-1]])
        total = count.copy()
        total[inverse[0]] = self.texts  # a start stands before each text
        p = np.maximum(wide - _discount(wide, self.word_discounts), 0) / self.pairs + self.freed / (self.distinct + 1)
        c = self.pair_counts(context, word)
        seen = total[v] > 0
        base = np.maximum(total[v], 1)
        model = np.where(seen, np.maximum(c - _discount(c, self.pair_discounts), 0) / base + freed[v] / base * p[w], p[w])
        plain = np.log10((count[w] + 1) / (self.tokens + self.distinct + 1))
        add = lambda x: np.bincount(text, x, minlength=len(texts))
        return number, add(count[w] > 0).astype(np.int64), add(plain), add(np.log10(model))


def _discount(count: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(count, 3)]


def _by(shard: np.ndarray):
    """(shard, its rows) for each shard that occurs."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:]):
        yield int(shard[order[a]]), order[a:b]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in sorted ``keys``, which of ``wanted`` are there), searched in rising order."""
    order = np.argsort(wanted, kind="stable")
    at = np.empty(len(wanted), np.int64)
    at[order] = np.searchsorted(keys, wanted[order])
    hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == wanted) if len(keys) else np.empty(0, np.int64)
    return at[hit], hit


def discounts(once: int, twice: int, thrice: int, four: int) -> tuple[float, float, float]:
    """Modified discounts from the numbers of types seen one to four times."""
    if not (once and twice and thrice):  # too few types to estimate from
        return 0.5, 0.75, 0.9
    y = once / (once + 2 * twice)
    found = (1 - 2 * y * twice / once, 2 - 3 * y * thrice / twice, 3 - 4 * y * four / thrice)
    return tuple(min(max(d, 0.0), k) for k, d in enumerate(found, 1))


PAIRS = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("context", "word", "low", "high", "own", "check")]])


def _count_pairs(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """Pairs of every task, folded and packed: one row per fold and shard.

    ``own`` and ``check`` are the two hashes of the words that belong to the shard and that the task has
    not sent before; of the second hash 16 bits tell two words apart well enough.
    """

    def fold(held, sent):
        context, word = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        own, check = (np.concatenate([h[k] for h in held]) for k in (2, 3))
        held.clear()
        own, at = np.unique(own, return_index=True)
        new = ~np.isin(own, sent[0], assume_unique=True)
        own, check = own[new], check[at[new]].astype("<u2")
        sent[0] = np.r_[sent[0], own] if len(sent[0]) + len(own) <= REMEMBERED else own
        _, context, word, count = _folded(context, word, np.ones(len(word), np.int64))
        parts: dict[int, list[bytes]] = {}
        for s, rows in _by(shard_of(context, word, shards)):
            # By context, so that the shuffle packs its repetitions.
            rows = rows[np.argsort(context[rows], kind="stable")]
            parts[s] = [_packed(context[rows]), _packed(word[rows]), *_small(count[rows]), b"", b""]
        for s, rows in _by((_mix(own) % np.uint64(shards)).astype(np.int64)):
            parts.setdefault(s, [b""] * 6)[4:] = [_packed(own[rows]), check[rows].tobytes()]
        columns = [pa.array(list(parts), pa.int32()), *[pa.array(list(c), pa.binary()) for c in zip(*parts.values())]]
        return pa.RecordBatch.from_arrays(columns, schema=PAIRS)

    def run(batches):
        held, total, sent = [], 0, [np.empty(0, np.uint64)]
        for batch in batches:
            for texts in chunks(rows_of(batch, "text")):
                context, word, _ = sequences(texts, seed)
                held.append((context, word, *_distinct(texts, seed)))
                total += len(word)
                if total >= FOLD:
                    yield fold(held, sent)
                    total = 0
        if held:
            yield fold(held, sent)

    return docs.select("text").mapInArrow(run, "shard int, context binary, word binary, low binary, high binary, own binary, check binary")


_STATS = "shard int, role string, key binary, numbers binary"


def _joined(t: pa.Table, column: str) -> list[bytes]:
    return t.column(column).to_pylist()


def _distinct(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every different word of some texts."""
    line = b" ".join(texts).lower()
    own, check = word_hashes(line, seed)[1], word_hashes(line, seed + (1 << 32))[1]
    own, at = np.unique(own, return_index=True)
    return own, check[at]


def _no_clash(own: np.ndarray, check: np.ndarray) -> None:
    order = np.lexsort((check, own))
    own, check = own[order], check[order]
    if ((own[1:] == own[:-1]) & (check[1:] != check[:-1])).any():
        raise ValueError("two words share a hash; train with another seed")


def _write_pairs(uri: str, word_shards: int):
    """Per shard: write its arrays; send on what contexts and words need."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        own = np.concatenate([_unpacked(b) for b in _joined(t, "own")])
        _no_clash(own, np.concatenate([np.frombuffer(b, "<u2") for b in _joined(t, "check")]))
        context = np.concatenate([_unpacked(b) for b in _joined(t, "context")])
        word = np.concatenate([_unpacked(b) for b in _joined(t, "word")])
        count = np.concatenate([_large(a, b) for a, b in zip(_joined(t, "low"), _joined(t, "high"))])
        hashes, context, word, count = _folded(context, word, count)
        big = count >= 255
        store(uri).put(
            f"pairs-{key[0].as_py()}",
            key=hashes,
            low=np.minimum(count, 255).astype(np.uint8),
            high_key=hashes[big],
            high=count[big],
        )
        out = [[] for _ in range(4)]

        def send(role, keys, numbers):
            for s, rows in _by((_mix(keys) % np.uint64(word_shards)).astype(np.int64)):
                for column, v in zip(out, (s, role, _packed(keys[rows]), numbers[rows].astype("<u8").tobytes())):
                    column.append(v)

        keys, place = np.unique(context, return_inverse=True)
        kinds = np.minimum(count, 3)
        send("context", keys, np.column_stack([np.bincount(place[kinds == k], minlength=len(keys)) for k in (1, 2, 3)]))
        keys, place = np.unique(word, return_inverse=True)
        raw = np.zeros(len(keys), np.int64)
        np.add.at(raw, place, count)
        send("word", keys, np.column_stack([np.bincount(place, minlength=len(keys)), raw]))
        totals = np.array([(count == k).sum() for k in (1, 2, 3, 4)] + [len(count)], dtype="<u8")
        for column, v in zip(out, (0, "totals", b"", totals.tobytes())):
            column.append(v)
        return pa.Table.from_arrays(
            [pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
            ["shard", "role", "key", "numbers"],
        )

    return run


def _write_words(uri: str):
    """Per shard of words: write its arrays; return totals."""

    def gather(t: pa.Table, role: str, width: int):
        rows = [(k, n) for r, k, n in zip(_joined(t, "role"), _joined(t, "key"), _joined(t, "numbers")) if r == role]
        keys = np.concatenate([np.empty(0, np.uint64), *(_unpacked(k) for k, _ in rows)])
        numbers = np.concatenate([np.empty((0, width), np.int64), *(np.frombuffer(n, "<u8").astype(np.int64).reshape(-1, width) for _, n in rows)])
        return keys, numbers

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        (ck, cn), (wk, wn) = gather(t, "context", 3), gather(t, "word", 2)
        keys = np.unique(np.r_[ck, wk])
        types, counts = np.zeros((len(keys), 3), np.int64), np.zeros((len(keys), 2), np.int64)
        np.add.at(types, np.searchsorted(keys, ck), cn)
        np.add.at(counts, np.searchsorted(keys, wk), wn)
        store(uri).put(f"words-{key[0].as_py()}", key=keys, count=counts[:, 1], contexts=counts[:, 0], types=types.astype(np.uint32 if types.max(initial=0) < 1 << 32 else np.int64))
        wide = counts[:, 0]
        starts = int(counts[keys == END, 1].sum())
        pairs = sum((np.frombuffer(n, "<u8").astype(np.int64) for r, n in zip(_joined(t, "role"), _joined(t, "numbers")) if r == "totals"), np.zeros(5, np.int64))
        numbers = [int(counts[:, 1].sum()), int((wide > 0).sum()), starts, *((wide == k).sum() for k in (1, 2, 3, 4)), int((wide > 2).sum()), *pairs]
        return pa.Table.from_arrays([pa.array([[int(x) for x in numbers]], pa.list_(pa.int64()))], ["numbers"])

    return run


def train(docs: DataFrame, seed: int = SEED) -> Model:
    """Count the texts of ``docs`` and write the model's arrays to the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(tasks(spark), size // SHARD)
    word_shards = max(tasks(spark), shards // 16)
    uri = scratch_path(spark, "lm")
    pairs = _count_pairs(docs, shards, seed).groupBy("shard").applyInArrow(_write_pairs(uri, word_shards), _STATS)
    totals = pairs.groupBy("shard").applyInArrow(_write_words(uri), "numbers array<bigint>")
    # One row of 13 numbers per shard of words.
    rows = np.array([r[0] for r in totals.collect()], dtype=np.int64).reshape(-1, 13).sum(axis=0)
    tokens, distinct, texts, w1, w2, w3, w4, more, p1, p2, p3, p4, n = map(int, rows)
    wd, pd = discounts(w1, w2, w3, w4), discounts(p1, p2, p3, p4)
    freed = (wd[0] * w1 + wd[1] * w2 + wd[2] * more) / n if n else 1.0
    return Model(uri, shards, word_shards, tokens, distinct, n, texts, pd, wd, freed, seed)


def score(model: Model, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, n_known, base_score and score (log10) for every row."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def run(batches):
        for batch in batches:
            parts = [model.score(texts) for texts in chunks(rows_of(batch, "text"))]
            if parts:
                n, known, base, own = (np.concatenate(c) for c in zip(*parts))
                columns = [pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(own)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], [*keep, "n_tokens", "n_known", "base_score", "score"])

    schema = f"{kinds}, n_tokens bigint, n_known bigint, base_score double, score double"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """The query's columns: learn from the training texts, score all."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = train(docs.filter(remainder("doc_id", HELD_OUT_OF) != HELD_OUT))
    return score(model, docs).select(
        "doc_id",
        F.coalesce(remainder("doc_id", HELD_OUT_OF) == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )

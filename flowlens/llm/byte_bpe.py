"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut into pre-tokens.  The distinct pre-tokens of a batch go through two tiers: a minimal perfect hash
over the vocabulary (hash and displace, built once on the driver, broadcast with the vocabulary, whose size is
fixed) finds those that are one token; the rest are merged by rank with a heap over a linked list of bytes.
A worker remembers up to ``REMEMBERED`` words with their ids.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm.common import mix, pack_ids, prepare, split_at_spaces, text_of

REMEMBERED = 600_000
#: Keys to a displacement bucket of the perfect hash.
BUCKET_KEYS = 4
_PRIME = np.uint64(0x100000001B3)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings: all of one length at once."""
    out = np.empty(len(words), np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        chars = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), n).astype(np.uint64)
        h = np.full(len(at), 0xCBF29CE484222325 ^ int(n), np.uint64)
        for k in range(n):
            h = (h ^ chars[:, k]) * _PRIME
            h ^= h >> np.uint64(29)
        out[at] = mix(h)
    return out


class PerfectHash:
    """Minimal perfect hash: slot = mix(hash + shift[bucket]) mod n, one slot for each key."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // BUCKET_KEYS)
        h = hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("two vocabulary entries share a hash")
        bucket = self._bucket(h)
        self.shift = np.zeros(self.buckets, np.uint64)
        self.key_at = np.zeros(n, np.int64)
        taken = np.zeros(n, bool)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        # Large buckets first, while there is room; the last keys need many tries, made many at a time.
        for b in np.argsort(-np.diff(starts), kind="stable"):
            mine = order[starts[b] : starts[b + 1]]
            shift, tries = 1, 16
            while len(mine):
                tried = np.arange(shift, shift + tries, dtype=np.uint64)[:, None]
                slots = self._slot(h[mine], tried)
                good = [k for k in np.flatnonzero(~taken[slots].any(1)) if len(set(slots[k].tolist())) == len(mine)]
                if good:
                    self.shift[b] = shift + good[0]
                    taken[slots[good[0]]] = True
                    self.key_at[slots[good[0]]] = mine
                    break
                shift, tries = shift + tries, min(tries * 4, 4096)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h + shift * _STEP) % np.uint64(self.n)).astype(np.int64)

    def slots(self, words: list[bytes]) -> np.ndarray:
        h = hashes(words)
        return self._slot(h, self.shift[self._bucket(h)])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """Two neighbouring ids (as one number) to the id they merge into."""
    out = {}
    for word, rank in ranks.items():
        for cut in range(1, len(word)):
            left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
            if left is not None and right is not None:
                out[left << 32 | right] = rank
    return out


def merge(word: bytes, single: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank first, of equal ranks the leftmost, until none is left."""
    part = [single[b] for b in word]
    n = len(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    find = pairs.get
    heap = []
    for i in range(n - 1):
        rank = find(part[i] << 32 | part[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    heapq.heapify(heap)
    while heap:
        first = heapq.heappop(heap)
        rank, i = first >> 32, first & 0xFFFFFFFF
        j = after[i]
        # Stale: one side was merged away or has grown into something else.
        if part[i] < 0 or j >= n or find(part[i] << 32 | part[j]) != rank:
            continue
        part[i], part[j] = rank, -1
        j = after[i] = after[j]
        if j < n:
            before[j] = i
            ahead = find(rank << 32 | part[j])
            if ahead is not None:
                heapq.heappush(heap, ahead << 32 | i)
        h = before[i]
        if h >= 0:
            behind = find(part[h] << 32 | rank)
            if behind is not None:
                heapq.heappush(heap, behind << 32 | h)
    return [p for p in part if p >= 0]


class Codec:
    """Encoder and decoder over a rank file; made on the driver and broadcast."""

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern
        self.words = sorted(read_ranks(path).items())
        self.hash = PerfectHash([w for w, _ in self.words])
        self._ready = False

    def __getstate__(self):
        return {"pattern": self.pattern, "words": self.words, "hash": self.hash, "_ready": False}

    def _prepare(self) -> None:
        import regex

        self.ranks = dict(self.words)
        self.find = regex.compile(self.pattern).findall
        keys = [w for w, _ in self.words]
        self.slot_word = [keys[i] for i in self.hash.key_at.tolist()]
        self.slot_id = [self.words[i][1] for i in self.hash.key_at.tolist()]
        self.pairs = pair_table(self.ranks)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for w, rank in self.words:
            by_id[rank] = w
        self.by_id = pa.array(by_id, pa.large_binary())
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self._ready = True

    def pre_tokens(self, tokens: list[str]) -> None:
        """Remember the ids of distinct pre-tokens: perfect hash first, heap for what it doesn't hold."""
        raw = [t.encode("utf-8") for t in tokens]
        single, pairs, pieces = self.single, self.pairs, self.pieces
        for token, word, slot in zip(tokens, raw, self.hash.slots(raw).tolist()):
            ids = [self.slot_id[slot]] if self.slot_word[slot] == word else merge(word, single, pairs)
            pieces[token] = pack_ids(ids)

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if not self._ready:
            self._prepare()
        cut = [split_at_spaces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        known, pieces, find = self.known, self.pieces, self.find
        fresh = {w: find(w) for w in set().union(*cut).difference(known)}
        missing = set().union(*fresh.values()).difference(pieces)
        if missing:
            self.pre_tokens(sorted(missing))
        for w, own in fresh.items():
            known[w] = pieces[own[0]] if len(own) == 1 else b"".join(map(pieces.__getitem__, own))
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
        """The bytes of each row; ``ids`` of all rows together, ``ends`` where rows begin and end in them."""
        if not self._ready:
            self._prepare()
        flat = self.by_id.take(pa.array(ids))
        _, offsets, data = flat.buffers()
        bounds = np.frombuffer(offsets, np.int64)[: len(ids) + 1][ends]
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(bounds.copy()), data])


def codec(spark: SparkSession, path: str, pattern: str):
    """The codec as a broadcast; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(Codec(path, pattern))


def encode(docs: DataFrame, shared) -> DataFrame:
    """One row per document: doc_id, ids (array of int).

    A null or empty text has no ids.  Rows are independent: repeated rows and null ids pass through; columns
    besides doc_id and text are ignored.
    """

    def run(batches):
        for batch in batches:
            raw = shared.value.packed(batch.column(1).to_pylist())
            sizes = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(raw), np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(sizes), flat)], names=["doc_id", "ids"]
            )

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>"
    )


def decode(encoded: DataFrame, shared) -> DataFrame:
    """(doc_id, ids, data): the bytes the ids stand for; null ids stand for none."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            data = shared.value.decode(flat, np.cumsum([0, *sizes]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, data.cast(pa.binary())], names=["doc_id", "ids", "data"]
            )

    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")

"""Packing documents into sequences: best-fit decreasing with certified bin counts.

Documents become token pieces (a document longer than a sequence is cut so that all pieces but the first are
full; a full piece is a sequence of its own).  The other pieces are packed inside partitions of bounded size by
best-fit decreasing.  Dual-feasible functions give a lower bound for each partition; a partition that meets its
bound is certified and offers no more than its emptiest bin.  The others hand the documents of their bins with
space to a common pool of up to ``FAN_IN`` partitions, which runs best-fit decreasing over them again and keeps the
better packing; rounds go on until one pool is left, however many that takes.  A pool is bounded: a partition offers
the emptiest of its bins, and bins that it does not offer are done.  :func:`certificate` gives the number of sequences
and the bound for all of them.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import pack_ids, prepare, release_memory, text_of
from flowlens.session import materialize

LENGTH = 1024
END = 2
#: Pieces that one packing partition is made for, partitions that join in a pool.
PART_ITEMS, FAN_IN = 4096, 8
_encoders: dict[str, "_Encoder"] = {}


class _Encoder:
    """Text to packed ids with the vocabulary of a ``tokenizers`` byte-level BPE file.

    The merges run in tiktoken over the same vocabulary and ranks (same ids, several times as fast).  The tokens that
    the file adds to the vocabulary are found in a text first, as that library does, and what is between them is
    encoded apart.  Words are not remembered: most words of a task's texts occur there once or twice.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.finds = _added_pattern(whole["added_tokens"])
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain}
        letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {
            bytes(map(letters.__getitem__, w)): i for w, i in whole["model"]["vocab"].items() if w not in self.added
        }
        self.encode = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.finds is None or not any(content in text for content in self.added):
            return self.encode(text)
        out, at = [], 0
        for m in self.finds.finditer(text):
            out += self.encode(text[at : m.start()])
            out.append(self.added[next(g for g in m.groups() if g is not None)])
            at = m.end()
        return out + self.encode(text[at:])

    def packed(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()


def _added_pattern(tokens: list[dict]) -> re.Pattern | None:
    """Where added tokens stand: the longest first, with the white space beside them that their flags take in."""
    parts = []
    for t in sorted(tokens, key=lambda t: -len(t["content"])):
        part = f"({re.escape(t['content'])})"
        if t["single_word"]:
            part = rf"(?<!\w){part}(?!\w)"
        parts.append((r"\s*" if t["lstrip"] else "") + part + (r"\s*" if t["rstrip"] else ""))
    return re.compile("|".join(parts)) if parts else None


def encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """The token pieces of every document; ``sequence_id`` is set for full ones, ``ids`` are the tokens if asked."""
    schema = PIECES + (", ids array<long>" if with_ids else "")

    def run(batches):
        encode = encoder(path).packed
        part, uid, full = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encode(text) + pack_ids([end])
                n = len(raw) // 4
                first = n if n <= length else n % length or length
                cuts = [0, *range(first, n + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    sequence = None
                    if b - a == length:
                        full += 1
                        sequence = -((part << 40) + full)
                    row = ((part << 40) + uid, doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), sequence)
                    rows.append(row + ((np.frombuffer(raw, "<u4")[a:b].tolist(),) if with_ids else ()))
                    uid += 1
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names
            )
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(run, schema)


def best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The bin of each item, bins counted from 0.  Ties go by position."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(length + 1)]
    open_rooms = 0  # bit r: some bin has exactly r left
    count = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                open_rooms &= ~(1 << room)
        else:
            room, b = length, count
            count += 1
        bins[i] = b
        left = room - size
        if left:
            rooms[left].append(b)
            open_rooms |= 1 << left
    return bins


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """No packing has fewer bins: the best of the bounds of several dual-feasible functions.

    The functions: the size itself; for each limit e up to half a bin, sizes over ``length - e`` count as whole
    bins and those under e as nothing; and for k, the rounding of size * (k + 1) / length down to k-ths.
    """
    return _bound_of_counts(np.bincount(sizes, minlength=length + 1), length) if len(sizes) else 0


def _bound_of_counts(counts: np.ndarray, length: int) -> int:
    values = np.arange(length + 1)
    best = -(-int(counts @ values) // length)
    amount = np.cumsum(counts * values)
    number = np.cumsum(counts)
    for e in range(1, length // 2 + 1):
        large = int(number[-1] - number[length - e])
        middle = int(amount[length - e] - amount[e - 1])
        best = max(best, -(-(large * length + middle) // length))
    for k in range(1, 51):
        scaled = values * (k + 1)
        exact = scaled % length == 0
        worth = np.where(exact, values * k, scaled // length * length)
        best = max(best, -(-int(counts @ worth) // (k * length)))
    return best


#: Room for bins of one round and for rounds in a bin's number.
BIN_BITS, PART_SHIFT = 26, 32
PACKED = "uid long, part long, bin long, offset long, length long, loose boolean"


def _rows(frame: pd.DataFrame, part: int, bins: np.ndarray, first: int, loose: np.ndarray) -> pd.DataFrame:
    sizes = frame["length"].to_numpy(np.int64)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    offset = np.empty(len(sizes), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], bins[order][1:] != bins[order][:-1]])) if len(bins) else []
    offset[order] = before - np.repeat(before[starts], np.diff([*starts, len(bins)])) if len(bins) else before
    return pd.DataFrame(
        {
            "uid": frame["uid"].to_numpy(np.int64), "part": part, "bin": bins + first, "offset": offset,
            "length": sizes, "loose": loose[bins] if len(bins) else np.zeros(0, bool),
        }
    )


def _loose_bins(sizes: np.ndarray, bins: np.ndarray, length: int, most: int) -> np.ndarray:
    """Bins whose documents go to the pool: those with the most space, as many as keep the pool bounded.

    A certified partition offers its emptiest bin only: its bound is rounded up to a whole bin.
    """
    fill, items = np.bincount(bins, sizes).astype(np.int64), np.bincount(bins)
    order = np.argsort(fill, kind="stable")
    if len(fill) == lower_bound(sizes, length):
        order = order[:1]
    within = np.cumsum(items[order]) <= most
    loose = np.zeros(len(fill), bool)
    loose[order[within & (fill[order] < length)]] = True
    return loose


def _first_round(length: int, offered: int):
    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid", kind="stable")
        sizes = frame["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(sizes, length)
        return _rows(frame, int(key[0]), bins, 0, _loose_bins(sizes, bins, length, offered))

    return pack


def _exchange(length: int, offered: int, step: int, last: bool):
    """A pool's documents again; bins are numbered apart from those of other rounds."""

    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "bin", "offset"], kind="stable")
        sizes = frame["length"].to_numpy(np.int64)
        old = frame["part"].to_numpy(np.int64) * (1 << 32) + frame["bin"].to_numpy(np.int64)
        old = np.unique(old, return_inverse=True)[1].ravel()
        bins = best_fit_decreasing(sizes, length)
        if bins.max() >= old.max():
            bins = old
        loose = np.zeros(bins.max() + 1, bool) if last else _loose_bins(sizes, bins, length, offered)
        return _rows(frame, int(key[0]), bins, step << BIN_BITS, loose)

    return pack


def pack(
    docs: DataFrame, path: str, length: int = LENGTH, end: int = END,
    part_items: int = PART_ITEMS, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``part_items`` pieces make a partition, ``fan_in`` partitions join in a pool and offer it an equal share of
    that many.

    A null or empty text is the single end token.  Repeated rows and null ids are packed like any others.
    Columns besides doc_id and text are ignored.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    made = materialize(pieces(docs, path, length, end), "pieces")
    items = made.where("sequence_id is null").select("uid", "length")
    parts = max(1, -(-items.count() // part_items))
    offered = max(1, part_items // fan_in)
    state = materialize(
        items.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)))
        .groupBy("part").applyInPandas(_first_round(length, offered), PACKED), "packed",
    )
    done = [state.where("not loose")]
    step = 0
    while parts > 1:
        step, parts = step + 1, -(-parts // fan_in)
        pooled = state.where("loose").groupBy(F.expr(f"part div {fan_in}").alias("pool"))
        state = pooled.applyInPandas(_exchange(length, offered, step, last=parts == 1), PACKED)
        if parts > 1:
            state = materialize(state, "pooled")
        done.append(state.where("not loose"))
    if step == 0:  # one partition has nobody to exchange with
        done.append(state.where("loose"))
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    placed = placed.select(
        "uid", (F.col("part") * (1 << PART_SHIFT) + F.col("bin")).alias("packed_id"), F.col("offset").alias("place")
    )
    return made.join(placed, "uid", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", "packed_id").alias("sequence_id"),
        F.coalesce("place", F.lit(0)).cast("long").alias("offset"),
    )


def certificate(packed: DataFrame, length: int = LENGTH) -> tuple[int, int]:
    """Number of sequences of :func:`pack`'s result, and a number that no packing of all its pieces is below.

    The bound is that of :func:`lower_bound` over the sizes of all pieces; there are at most ``length`` sizes.
    """
    used = packed.agg(F.count_distinct("sequence_id")).first()[0]
    counts = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    by_size = np.zeros(length + 1, np.int64)
    for r in counts:
        by_size[r.length] = r.n
    return used, _bound_of_counts(by_size, length)

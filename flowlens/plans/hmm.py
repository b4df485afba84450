"""Gaussian hidden Markov model with diagonal covariance, trained and decoded on Spark.

Flows are laid out once: hash-partitioned by sequence, ordered inside, cached.
A training round is one narrow job over that layout: every partition runs
forward-backward on its own sequences and returns only sums (some hundred
numbers), which Spark adds up; the parameters are then re-estimated from them.
NumPy works inside the tasks, many sequences side by side.
"""

from __future__ import annotations

import json
import operator
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from flowlens.functions.columns import bucket
from flowlens.operators.features import FEATURES
from flowlens.schema import FLOW_ID, START, STATE
from flowlens.session import materialize, storage_memory

# Fixed values of the model and its training.
MIN_VARIANCE = 1e-4
MIN_PROBABILITY = 1e-300
STAY = 0.7
KMEANS_ROUNDS, KMEANS_TOL = 10, 1e-4
K_RANGE = range(2, 11)

CHUNK_ROWS = 500_000  # longest run of one sequence handled as a unit
RANGE_SHIFT = 32  # a chunk number is the range, then the place in it
BROADCAST_KEYS = 100_000  # so many long sequences may be broadcast
FAN_BITS = 8  # ranges chained as one group: two to the power of this
SAMPLE_GRAIN_MS = 3_600_000
BLOCK_ROWS = 250_000  # rows a task works on at a time
PARTITION_ROWS = 250_000  # rows per partition of the layout, on average
SMALL_PARTITION_ROWS = 10_000  # fewer are not worth a task
PIECE_ROWS = 256  # shortest run worth cutting a sequence into
PART_BYTES, PARTS_AT_ONCE = 1 << 17, 64  # most bytes of a packed block in one row; rows handed over together


@dataclass
class HmmModel:
    means: np.ndarray
    variances: np.ndarray
    transition: np.ndarray
    initial: np.ndarray

    @property
    def k(self) -> int:
        return len(self.initial)

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return (k - 1) + k * (k - 1) + 2 * k * d

    def log_emission(self, x: np.ndarray) -> np.ndarray:
        """Log density of every row under every state, as matrix products."""
        inv = 1.0 / self.variances
        const = (np.log(2 * np.pi * self.variances) + self.means**2 * inv).sum(axis=1)
        return (x @ (self.means * inv).T) - 0.5 * ((x * x) @ inv.T + const)

    def relabelled(self) -> "HmmModel":
        """States ordered by their mean of the first features, so that runs compare."""
        order = np.lexsort(self.means.T[::-1])
        return HmmModel(
            self.means[order],
            self.variances[order],
            self.transition[np.ix_(order, order)],
            self.initial[order],
        )

    def to_json(self) -> str:
        return json.dumps({name: getattr(self, name).tolist() for name in self.__dict__})

    @classmethod
    def from_json(cls, text: str) -> "HmmModel":
        return cls(**{name: np.asarray(v, dtype=float) for name, v in json.loads(text).items()})


@dataclass
class FitResult:
    model: HmmModel
    log_likelihood: float
    iterations: int
    converged: bool
    history: list[float] = field(default_factory=list)


# --------------------------------------------------------------- layout

# A sequence is (key, run); a long one is cut into chunks, numbered in order.
RUN, CHUNK, LONG = "run", "chunk", "long"


def _number_task(ids: list[str], chunk_rows: int):
    """Chunk numbers for the ordered rows of a range: the range, then the place in it."""

    def run(frames):
        last, seen = None, 0
        for frame in frames:
            if frame.empty:
                continue
            columns = [frame[c].to_numpy() for c in ids]
            new = np.zeros(len(frame), dtype=bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            new[0] = tuple(c[0] for c in columns) != last
            row = np.arange(len(frame))
            begin = np.maximum.accumulate(np.where(new, row, -seen))
            place = row - begin
            last, seen = tuple(c[-1] for c in columns), int(place[-1]) + 1
            frame[CHUNK] = (frame["_range"].to_numpy(dtype=np.int64) << RANGE_SHIFT) + place // chunk_rows
            yield frame.drop(columns="_range")

    return run


def _same(left: list[str], right: list[str]):
    """Equality of columns in which a missing value equals itself."""
    return reduce(operator.and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def with_chunks(rows: DataFrame, ids: list[str], chunk_rows: int) -> tuple[DataFrame, int, int, int]:
    """Cut sequences longer than ``chunk_rows`` rows into chunks of at most that many.

    Only long sequences pay for it: their rows are range-partitioned by (sequence, start, flow id), so a
    sequence with a third of all rows, or all rows of one instant, is spread over many tasks, and each task
    numbers the chunks of its range.  Adds ``chunk`` and ``long``; also returns the number of ranges (0 if no
    sequence is long), the number of rows and that of the shortest sequence.
    """
    sizes = rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"))
    is_long = F.col("_n") > chunk_rows
    total, in_long, keys, shortest = sizes.agg(
        F.sum("_n"), F.sum(F.when(is_long, F.col("_n"))), F.count_if(is_long), F.min("_n")
    ).first()
    plain = {CHUNK: F.lit(0).cast("long"), LONG: F.lit(False)}
    if not in_long:
        return rows.withColumns(plain), 0, total or 0, shortest or 0
    named = [f"_{c}" for c in ids]
    long = sizes.where(is_long).select(*[F.col(c).alias(n) for c, n in zip(ids, named)])
    long = F.broadcast(long) if keys <= BROADCAST_KEYS else long
    ranges = _partitions(rows, in_long)
    order = [*ids, START, FLOW_ID]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    numbered = (
        rows.join(long, _same(ids, named), "left_semi")
        .repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .mapInPandas(_number_task(ids, chunk_rows), f"{kinds}, {CHUNK} long")
        .withColumn(LONG, F.lit(True))
    )
    short = rows.join(long, _same(ids, named), "left_anti").withColumns(plain)
    return short.unionByName(numbered), ranges, total, shortest


def _partitions(rows: DataFrame, count: int) -> int:
    busy = rows.sparkSession.sparkContext.defaultParallelism
    return max(min(busy, count // SMALL_PARTITION_ROWS), -(-count // PARTITION_ROWS), 1)


def _crowds(rows: DataFrame, count: int, width: int) -> bool:
    """Whether so many rows of a layout are more than the executors' memory for cached tables.

    They would fill it all the time, and each task that reads rows back from disk would make room for them there; on
    disk they are read batch by batch and leave the memory to the tasks.
    """
    return count * (width + 3) * 8 > storage_memory(rows.sparkSession)


def _level(on_disk: bool) -> StorageLevel:
    return StorageLevel.DISK_ONLY if on_disk else StorageLevel.MEMORY_AND_DISK_DESER


@dataclass
class Sequences:
    """Rows (FLOW_ID, key, run, chunk, long, start, features), partitioned and ordered by sequence.

    ``ranges`` is the number of ranges that long sequences were cut from, 0 if none was cut.  ``on_disk`` keeps
    whatever is cached of them out of memory.
    """

    rows: DataFrame
    features: list[str]
    key: str
    ranges: int
    cached: DataFrame | None = None  # what ``rows`` is a projection of
    blocks: DataFrame | None = None  # the whole sequences again, packed for training
    on_disk: bool = False

    @property
    def ids(self) -> list[str]:
        return [self.key, RUN]

    @property
    def cut(self) -> bool:
        return self.ranges > 0

    @property
    def level(self) -> StorageLevel:
        return _level(self.on_disk)

    def packed(self) -> "Sequences":
        """With the whole sequences packed into cached blocks, which rounds read without converting rows."""
        if self.blocks is not None:
            return self
        whole = self.rows.where(~F.col(LONG)) if self.cut else self.rows
        blocks = whole.select(*self.ids, CHUNK, *self.features).mapInPandas(
            _pack_task(self.features, self.ids), "lengths binary, x binary"
        )
        return replace(self, blocks=blocks.persist(self.level))

    def unpack(self) -> None:
        """Drop the packed blocks."""
        if self.blocks is not None:
            self.blocks.unpersist()
            self.blocks = None

    def unpersist(self) -> None:
        self.unpack()
        (self.rows if self.cached is None else self.cached).unpersist()


def sequences(
    rows: DataFrame,
    features=FEATURES,
    key: str = "dst_ip",
    chunk_rows: int = CHUNK_ROWS,
    sample_rows: int | None = None,
    min_rows: int = 1,
    seed: int = 42,
    persist: bool = True,
) -> Sequences:
    """Lay rows out for training or decoding; each round then reads without a shuffle.

    ``chunk_rows`` bounds what a task holds of a sequence and changes no result.  ``sample_rows`` keeps about
    that many rows, as whole sequences, before anything is moved; a sequence with more rows than the whole
    sample is sampled by the hour, and each hour taken is a sequence of its own (a ``run``).  Sequences shorter
    than ``min_rows`` are left out.  The cached layout is rebuilt from ``rows`` where an executor is lost; a
    layout with cut sequences is always cached, as it is read several times.
    """
    ids = [key, RUN]
    picked = rows.select(
        FLOW_ID, key, F.lit(0).cast("long").alias(RUN), START, *[F.col(c).cast("double").alias(c) for c in features]
    )
    if sample_rows is not None:
        picked = _sampled(picked, key, sample_rows, seed)
    chunked, ranges, total, shortest = with_chunks(picked, ids, chunk_rows)
    laid = chunked.repartition(_partitions(rows, total), *ids, CHUNK)
    laid = laid.sortWithinPartitions(*ids, CHUNK, START, FLOW_ID)
    if shortest < min_rows:
        laid = laid.mapInPandas(_drop_short_task(ids, min_rows), laid.schema)
        if ranges:  # tell the planner again how the rows lie
            laid = laid.repartition(_partitions(rows, total), *ids, CHUNK).sortWithinPartitions(*ids, CHUNK, START, FLOW_ID)
    on_disk = _crowds(rows, total, len(features))
    laid = laid.persist(_level(on_disk)) if persist or ranges else laid
    return Sequences(laid, list(features), key, ranges, on_disk=on_disk)


def _sampled(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """About ``count`` of the rows as whole sequences, of very long ones as whole hours."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total, longest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if (total or 0) <= count:
        return rows
    if longest > count:  # at most total / count keys
        long = sizes.where(F.col("_n") > count).select(F.col(key).alias("_key"), F.lit(True).alias("_long"))
        hour = bucket(START, SAMPLE_GRAIN_MS) + 1
        rows = rows.join(long, _same([key], ["_key"]), "left")
        rows = rows.withColumn(RUN, F.when(F.col("_long"), hour).otherwise(F.col(RUN))).drop("_key", "_long")
    return rows.where(_share([key, RUN], count / total, seed))


def _share(ids: list[str], share: float, seed: int):
    """True for about this share of the sequences."""
    part = F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1 << 30))
    return part < F.lit(int(share * (1 << 30)))


def sample_sequences(seqs: Sequences, rows: int, seed: int = 42) -> Sequences:
    """About ``rows`` rows of a layout as whole sequences; nothing is shuffled."""
    kept, total = seqs.rows, seqs.rows.count()
    if total > rows:
        kept = kept.where(_share(seqs.ids, rows / total, seed))
    return replace(seqs, rows=kept.persist(), cached=None, blocks=None)


# ------------------------------------------------------------- task side


def _blocks(frames, ids: list[str], block_rows: int = BLOCK_ROWS):
    """Whole sequences (or chunks of them) from the batches of a partition, some at a time.

    Yields (frame, lengths).  Batches split sequences anywhere; the unfinished
    last one is held back for the next block.
    """
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size < block_rows:
            continue
        block = pd.concat(held, ignore_index=True)
        starts = _starts(block, ids)
        last = starts[-1]
        if last > 0:
            yield block.iloc[:last], np.diff(starts)
        held, size = [block.iloc[last:]], len(block) - last
        block_rows = max(block_rows, 2 * size)  # a long sequence: wait for more
    if size:
        block = pd.concat(held, ignore_index=True)
        starts = _starts(block, ids)
        yield block, np.diff(np.append(starts, len(block)))


def _starts(block: pd.DataFrame, ids: list[str]) -> np.ndarray:
    new = np.zeros(len(block) - 1, dtype=bool)
    for name in [*ids, CHUNK]:
        c = block[name].to_numpy()
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _drop_short_task(ids: list[str], min_rows: int):
    def run(frames):
        for block, lengths in _blocks(frames, ids):
            yield block[np.repeat(lengths >= min_rows, lengths) | block[LONG].to_numpy(dtype=bool)]

    return run


def _pack_task(features: list[str], ids: list[str]):
    """The numbers of each block as bytes: the lengths of its sequences, the features of its rows.

    The features of a block may take a hundred megabytes, and the JVM holds a row several times, each in one piece, while
    it moves it: they are cut into rows of ``PART_BYTES``, the lengths stand in the first.
    """

    def run(frames):
        for block, lengths in _blocks(frames, ids):
            x = np.ascontiguousarray(block[features].to_numpy(dtype=float)).ravel().view(np.uint8)
            head = lengths.astype(np.int64).tobytes()
            for at in range(0, len(x), PART_BYTES * PARTS_AT_ONCE):
                some = x[at : at + PART_BYTES * PARTS_AT_ONCE]
                parts = [some[i : i + PART_BYTES].tobytes() for i in range(0, len(some), PART_BYTES)]
                yield pd.DataFrame({"lengths": [None if at else head, *[None] * (len(parts) - 1)], "x": parts})

    return run


def _unpacked(frames, width: int):
    """(features, lengths) of packed blocks, put together from their rows."""
    lengths, parts, missing = None, [], 0
    for frame in frames:
        for head, x in zip(frame["lengths"], frame["x"]):
            if head is not None:
                lengths = np.frombuffer(head, dtype=np.int64)
                missing = int(lengths.sum()) * width * 8
            parts.append(x)
            missing -= len(x)
            if missing == 0:
                block = np.frombuffer(b"".join(parts), dtype=float).reshape(-1, width)
                parts = []
                yield block, lengths


class _Lockstep:
    """Index helper: step t of all sequences that are longer than t, longest first."""

    def __init__(self, lengths: np.ndarray, begin: np.ndarray | None = None):
        if begin is None:
            begin = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        self.first = begin[order]
        self.lengths = lengths[order]
        self.steps = int(self.lengths[0])
        # how many sequences reach step t
        self.active = np.searchsorted(-self.lengths, -np.arange(self.steps), side="left")

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.active[t]] + t


@dataclass
class _Pieces:
    """Sequences cut so that long ones also run side by side.

    A sequence of n rows takes n dependent steps; as about sqrt(n) pieces it
    takes sqrt(n) steps to sum up every piece, sqrt(n) to chain the pieces, and
    sqrt(n) to walk through all of them with what enters and leaves known.
    """

    lengths: np.ndarray  # rows per piece
    first: np.ndarray  # first piece of each sequence
    count: np.ndarray  # pieces per sequence

    @classmethod
    def of(cls, lengths: np.ndarray) -> "_Pieces":
        size = max(PIECE_ROWS, int(np.sqrt(lengths.max())))
        count = -(-lengths // size)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        rows = np.full(int(count.sum()), size)
        rows[first + count - 1] = lengths - (count - 1) * size
        return cls(rows, first, count)

    def steps(self):
        """Piece numbers by place in their sequence; all that have a next piece."""
        for j in range(int(self.count.max()) - 1):
            yield self.first[self.count > j + 1] + j

    @property
    def chained(self) -> np.ndarray:
        """Pieces of sequences that have more than one."""
        return np.flatnonzero(np.repeat(self.count > 1, self.count))


class _Steps:
    """Rows of pieces by step: all first rows, then all second rows, ..., the longest piece first in each.

    With one row per state and one column per row of the block, a step is a run of neighbouring columns, so the
    loops over steps are a few operations on whole arrays each.
    """

    def __init__(self, lengths: np.ndarray, begin: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.steps = int(self.lengths[0])
        # how many pieces reach step t, and where its columns begin
        self.active = np.searchsorted(-self.lengths, -np.arange(self.steps), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        step = np.repeat(np.arange(self.steps), self.active)
        lane = np.arange(self.offset[-1]) - self.offset[step]
        self.rows = begin[self.order][lane] + step  # the row of each column
        self.goes_on = step < self.lengths[lane] - 1
        place = np.empty_like(self.order)
        place[self.order] = np.arange(len(lengths))
        self.first = place  # the column of the first and of the last row of each piece
        self.last = self.offset[lengths - 1] + place


def _sum_pieces(b, move, steps: _Steps):
    """Per piece: how its last row is spread over states when its first is in i, and the weight of i (largest 1).

    ``b`` is (states, columns).  The tables of all pieces are one matrix, a row per last state, so that a step is one
    product; each piece is kept at a sum of one, which is divided out with the densities of the next step.
    """
    k, lanes = len(b), int(steps.active[0])
    turn = np.ascontiguousarray(move.T)
    table = np.eye(k)[:, :, None] * b[:, None, :lanes]
    for t in range(1, steps.steps):
        n, begin = int(steps.active[t]), steps.offset[t]
        now = table if n == lanes else table[:, :, :n]
        size = np.maximum(now.sum(axis=(0, 1)), MIN_PROBABILITY)
        now = (turn @ now.reshape(k, k * n)).reshape(k, k, n)
        now *= (b[:, begin : begin + n] / size)[:, None, :]
        if n == lanes:
            table = now
        else:
            table[:, :, :n] = now
    weight = table.sum(axis=0)
    table /= np.maximum(weight, MIN_PROBABILITY)
    weight /= np.maximum(weight.max(axis=0), MIN_PROBABILITY)
    out, out_weight = np.empty((lanes, k, k)), np.empty((lanes, k))
    out[steps.order], out_weight[steps.order] = table.transpose(2, 1, 0), weight.T
    return out, out_weight


def _piece_edges(b, move, pieces: _Pieces, steps: "_Steps | None", start, end):
    """What each piece is entered with (state weights) and followed by (likelihoods).

    ``start`` and ``end`` are these for the first and the last piece of a sequence.  ``b`` and ``steps`` are those
    of the chained pieces, ``steps`` is None if there are none.
    """
    n, k = len(pieces.lengths), len(move)
    enter = np.broadcast_to(start, (n, k)).copy()
    follow = np.broadcast_to(end, (n, k)).copy()
    if steps is None:
        return enter, follow
    chained = pieces.chained
    table, weight = np.zeros((n, k, k)), np.zeros((n, k))
    table[chained], weight[chained] = _sum_pieces(b, move, steps)
    links = list(pieces.steps())
    for p in links:
        out = np.einsum("pi,pij->pj", enter[p] * weight[p], table[p])
        out /= np.maximum(out.sum(axis=1, keepdims=True), MIN_PROBABILITY)
        enter[p + 1] = out @ move
    for p in reversed(links):
        tail = np.einsum("pij,pj->pi", table[p + 1], follow[p + 1]) * weight[p + 1]
        back = tail @ move.T
        follow[p] = back / np.maximum(back.max(axis=1, keepdims=True), MIN_PROBABILITY)
    return enter, follow


def _emission(model: HmmModel, x: np.ndarray, square: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Densities of the rows over their largest, one row per state, and the logarithm of that."""
    square = x * x if square is None else square
    inv = 1.0 / model.variances
    const = (np.log(2 * np.pi * model.variances) + model.means**2 * inv).sum(axis=1)
    log_b = (model.means * inv) @ x
    log_b -= 0.5 * (inv @ square + const[:, None])
    peak = log_b.max(axis=0)
    log_b -= peak
    return np.exp(log_b, out=log_b), peak


def _moves(model: HmmModel) -> np.ndarray:
    return np.maximum(model.transition, MIN_PROBABILITY)


class _Block:
    """Rows of a block laid out by step; serves any number of models."""

    def __init__(self, x: np.ndarray, lengths: np.ndarray):
        self.pieces = _Pieces.of(lengths)
        size = self.pieces.lengths
        begin = np.cumsum(size) - size
        self.steps = _Steps(size, begin)
        self.x = np.ascontiguousarray(x[self.steps.rows].T)
        self.square = self.x * self.x
        self.chained = chained = self.pieces.chained
        self.chain, self.columns = None, slice(None)
        if len(chained) == len(size):
            self.chain = self.steps
        elif len(chained):
            self.chain = _Steps(size[chained], begin[chained])
            column = np.empty(len(x), dtype=np.int64)
            column[self.steps.rows] = np.arange(len(x))
            self.columns = column[self.chain.rows]


def _sufficient_statistics(
    model: HmmModel, x: np.ndarray | _Block, lengths: np.ndarray | None = None,
    before: np.ndarray | None = None, after: np.ndarray | None = None,
) -> np.ndarray:
    """Expected counts of a block: [log-likelihood, rows, first, moves, mass, x, x*x].

    A chunk of a longer sequence is given what surrounds it: ``before``, the state weights of the row before
    its first, and ``after``, the likelihoods of all that follows its last row.
    """
    block = x if isinstance(x, _Block) else _Block(x, lengths)
    k, x, pieces, steps = model.k, block.x, block.pieces, block.steps
    active, offset = steps.active, steps.offset
    b, peak = _emission(model, x, block.square)
    move = _moves(model)
    turn = np.ascontiguousarray(move.T)
    start = model.initial if before is None else before @ move
    edge = b if block.chain is None else b[:, block.columns]
    enter, follow = _piece_edges(edge, move, pieces, block.chain, start, np.ones(k) if after is None else after)
    alpha, norm = np.empty_like(b), np.empty(b.shape[1])
    ahead = enter[steps.order].T
    for t in range(steps.steps):
        n, at = active[t], offset[t]
        if t:
            ahead = turn @ alpha[:, offset[t - 1] : offset[t - 1] + n]
        a = ahead * b[:, at : at + n]
        size = np.maximum(a.sum(axis=0), MIN_PROBABILITY, out=norm[at : at + n])
        np.divide(a, size, out=alpha[:, at : at + n])
    # beta of a row, and (tail) that times its density
    beta, tail, scale = np.empty_like(b), np.empty_like(b), np.empty(b.shape[1])
    beta[:, steps.last] = follow.T
    for t in range(steps.steps - 1, 0, -1):
        n, at, now = active[t], offset[t], offset[t - 1]
        later = np.multiply(b[:, at : at + n], beta[:, at : at + n], out=tail[:, at : at + n])
        back = move @ later
        size = np.maximum(back.max(axis=0), MIN_PROBABILITY, out=scale[now : now + n])
        np.divide(back, size, out=beta[:, now : now + n])
    gamma = alpha * beta
    mass = gamma.sum(axis=0)
    # rows that go on are, in this order, the ones before the rows of all later steps
    on = steps.goes_on
    weight = np.maximum(mass[on] * scale[on], MIN_PROBABILITY)
    moves = (alpha[:, on] / weight) @ tail[:, offset[1] :].T

    def count_moves(now, first):
        """Expected moves into the first rows of pieces."""
        later = b[:, first] * beta[:, first]
        weight = np.maximum((now * (move @ later)).sum(axis=0), MIN_PROBABILITY)
        return (now / weight) @ later.T

    inner = np.ones(len(pieces.lengths), dtype=bool)
    inner[pieces.first] = False
    if inner.any():  # from the last row of one piece to the next piece
        inner = np.flatnonzero(inner)
        moves += count_moves(alpha[:, steps.last[inner - 1]], steps.first[inner])
    heads = steps.first[pieces.first]
    if before is not None:  # from the chunk before
        moves += count_moves(np.broadcast_to(before[:, None], (k, len(heads))), heads)
    gamma /= np.maximum(mass, MIN_PROBABILITY)
    return np.concatenate(
        [
            [np.log(norm).sum() + peak.sum(), x.shape[1]],
            gamma[:, heads].sum(axis=1) if before is None else np.zeros(k),
            (moves * move).ravel(),
            gamma.sum(axis=1),
            (gamma @ x.T).ravel(),
            (gamma @ block.square.T).ravel(),
        ]
    )


STATISTICS = "m int, pos int, value double"


def _statistics_task(models: dict[int, HmmModel], features: list[str], ids: list[str], packed: bool = False):
    """Sums over the whole sequences of a partition."""

    def loose(frames):
        for block, lengths in _blocks(frames, ids):
            yield block[features].to_numpy(dtype=float), lengths

    def run(frames):
        sums: dict[int, np.ndarray] = {}
        for x, lengths in _unpacked(frames, len(features)) if packed else loose(frames):
            laid = _Block(x, lengths)
            for m, model in models.items():
                s = _sufficient_statistics(model, laid)
                sums[m] = sums[m] + s if m in sums else s
        for m, s in sums.items():
            yield pd.DataFrame({"m": m, "pos": np.arange(len(s)), "value": s})

    return run


def _chunk_statistics(models: dict[int, HmmModel], features: list[str]):
    """Sums over one chunk, given what surrounds it under each model."""

    def run(frame: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values([START, FLOW_ID])[features].to_numpy(dtype=float)
        out = [pd.DataFrame({"m": [], "pos": [], "value": []})]
        laid = _Block(x, np.array([len(x)])) if len(x) else None
        for edge in edges.itertuples() if len(x) else ():
            before = np.asarray(edge.before) if len(edge.before) else None
            s = _sufficient_statistics(models[edge.m], laid, None, before, np.asarray(edge.after))
            out.append(pd.DataFrame({"m": edge.m, "pos": np.arange(len(s)), "value": s}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return run


def expectation(seqs: Sequences, models: dict[int, HmmModel]) -> dict[int, np.ndarray]:
    """Expected counts for any number of models; sums only come back.

    Whole sequences take one pass.  Of cut sequences a first pass sums up every chunk as a small matrix per
    model, a tree chains these (:class:`_SumTree`), and a second pass counts in each chunk with its known edges.
    """
    ids, features = seqs.ids, seqs.features
    if seqs.blocks is not None:
        counted = seqs.blocks.mapInPandas(_statistics_task(models, features, ids, packed=True), STATISTICS)
    else:
        whole = seqs.rows.where(~F.col(LONG)) if seqs.cut else seqs.rows
        counted = whole.select(*ids, CHUNK, *features).mapInPandas(_statistics_task(models, features, ids), STATISTICS)
    nodes = None
    if seqs.cut:
        rows = seqs.rows.where(LONG)
        tree = _SumTree(models)
        nodes = _nodes(rows, seqs, tree).persist()
        edges = _tree_edges(nodes, seqs, tree)
        counted = counted.unionByName(
            rows.select(*ids, CHUNK, START, FLOW_ID, *features).groupBy(*ids, CHUNK)
            .cogroup(edges.withColumnRenamed("node", CHUNK).groupBy(*ids, CHUNK))
            .applyInPandas(_chunk_statistics(models, features), STATISTICS)
        )
    rows = counted.groupBy("m", "pos").agg(F.sum("value").alias("value")).collect()
    if nodes is not None:
        nodes.unpersist()
    sizes = {m: 2 + 2 * mod.k + mod.k**2 + 2 * mod.means.size for m, mod in models.items()}
    out = {m: np.zeros(n) for m, n in sizes.items()}
    for r in rows:
        out[r.m][r.pos] = r.value
    return out


# ------------------------------------------------- chains of cut sequences


class _SumTree:
    """Sums over paths: how a run of rows carries state weights from its first row to its last.

    A node is (table, weight): table[i] is the normalised outcome of starting in i, weight[i] its relative size.
    """

    def __init__(self, models: dict[int, HmmModel]):
        self.models = models

    def leaves(self, m: int, x: np.ndarray, lengths: np.ndarray):
        """Nodes of the chunks of a block."""
        pieces = _Pieces.of(lengths)
        steps = _Steps(pieces.lengths, np.cumsum(pieces.lengths) - pieces.lengths)
        b, _ = _emission(self.models[m], np.ascontiguousarray(x[steps.rows].T))
        table, weight = _sum_pieces(b, _moves(self.models[m]), steps)
        out = [(table[f], weight[f]) for f in pieces.first]
        for c, (first, count) in enumerate(zip(pieces.first, pieces.count)):
            for p in range(first + 1, first + count):
                out[c] = self.join(m, out[c], (table[p], weight[p]))
        return out

    def join(self, m: int, one, other):
        table = one[0] @ (_moves(self.models[m]) @ (other[1][:, None] * other[0]))
        size = np.maximum(table.sum(axis=1), MIN_PROBABILITY)
        weight = one[1] * size
        return table / size[:, None], weight / max(weight.max(), MIN_PROBABILITY)

    def edges(self, m: int, nodes, outside):
        """(before, after) of each node in a row of nodes; ``outside`` is that of the whole row."""
        model, move = self.models[m], _moves(self.models[m])
        none = np.empty(0)
        before, after = outside or (none, np.ones(model.k))
        befores, afters = [], []
        for table, weight in nodes:
            befores.append(before)
            enter = before @ move if len(before) else model.initial
            out = (enter * weight) @ table
            before = out / max(out.sum(), MIN_PROBABILITY)
        for table, weight in reversed(nodes):
            afters.append(after)
            back = move @ ((table @ after) * weight)
            after = back / max(back.max(), MIN_PROBABILITY)
        return list(zip(befores, reversed(afters)))


class _BestTree:
    """Best paths: the score of the best path through a run of rows from each first to each last state.

    The edges of a node are the scores it is entered with and the state its last row is in.
    """

    def __init__(self, model: HmmModel):
        self.models = {0: model}
        self.log_start = np.log(np.maximum(model.initial, MIN_PROBABILITY))
        self.log_move = np.log(_moves(model))

    def leaves(self, m: int, x: np.ndarray, lengths: np.ndarray):
        log_b = self.models[0].log_emission(x)
        pieces = _Pieces.of(lengths)
        begin = np.cumsum(pieces.lengths) - pieces.lengths
        table = _best_of_pieces(log_b, self.log_move, begin, pieces.lengths)
        out = [(table[f], np.empty(0)) for f in pieces.first]
        for c, (first, count) in enumerate(zip(pieces.first, pieces.count)):
            for p in range(first + 1, first + count):
                out[c] = self.join(m, out[c], (table[p], np.empty(0)))
        return [(t - t.max(), none) for t, none in out]

    def join(self, m: int, one, other):
        moved = _best_move(one[0], self.log_move)
        table = (moved[:, :, None] + other[0][None]).max(axis=1)
        return table - table.max(), np.empty(0)

    def edges(self, m: int, nodes, outside):
        entry, leave = outside or (self.log_start, None)
        entries, finals = [], []
        for table, _ in nodes:
            entries.append(entry)
            final = (entry[:, None] + table).max(axis=0)
            finals.append(final - final.max())
            entry = _best_move(finals[-1], self.log_move)
        state = int(finals[-1].argmax()) if leave is None else int(leave[0])
        leaves = [state]
        for p in range(len(nodes) - 1, 0, -1):
            started = int((entries[p] + nodes[p][0][:, state]).argmax())
            state = int((finals[p - 1] + self.log_move[:, started]).argmax())
            leaves.append(state)
        return [(e, np.array([s], float)) for e, s in zip(entries, reversed(leaves))]


def _id_kinds(rows: DataFrame, ids: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in ids)


def _nodes(rows: DataFrame, seqs: Sequences, tree) -> DataFrame:
    """One small matrix per chunk and model; nothing is shuffled."""
    ids, features = seqs.ids, seqs.features

    def run(frames):
        for block, lengths in _blocks(frames, ids):
            x = block[features].to_numpy(dtype=float)
            heads = block.iloc[np.cumsum(lengths) - lengths][[*ids, CHUNK]].rename(columns={CHUNK: "node"})
            for m in tree.models:
                made = tree.leaves(m, x, lengths)
                yield heads.assign(m=m, table=[t.ravel() for t, _ in made], weight=[w for _, w in made])

    kind = f"{_id_kinds(rows, ids)}, node long, m int, table array<double>, weight array<double>"
    return rows.select(*ids, CHUNK, *features).mapInPandas(run, kind)


def _tree_edges(nodes: DataFrame, seqs: Sequences, tree) -> DataFrame:
    """What surrounds every node: (ids, node, m, before, after).

    The nodes of a sequence are joined in groups, those of one range first, then 2^``FAN_BITS`` neighbours at a
    time, up to one group; then the edges go down the same way.  No group grows with the sequence.
    """
    ids = seqs.ids
    kinds = _id_kinds(nodes, ids)
    shifts = [RANGE_SHIFT] + [FAN_BITS] * -(-(seqs.ranges - 1).bit_length() // FAN_BITS)

    def row_of(frame):
        m = int(frame["m"].iloc[0])
        frame = frame.sort_values("node")
        k = tree.models[m].k
        return m, frame, [(np.reshape(t, (k, k)), np.asarray(w)) for t, w in zip(frame["table"], frame["weight"])]

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        m, frame, row = row_of(frame)
        table, weight = reduce(lambda a, b: tree.join(m, a, b), row)
        head = frame.iloc[:1][[*ids]]
        return head.assign(node=frame["parent"].iloc[0], m=m, table=[table.ravel()], weight=[weight])

    def spread(frame: pd.DataFrame, outside: pd.DataFrame | None = None) -> pd.DataFrame:
        m, frame, row = row_of(frame)
        given = None
        if outside is not None:
            given = tuple(np.asarray(outside[c].iloc[0], dtype=float) for c in ("before", "after"))
        found = tree.edges(m, row, given)
        return frame[[*ids, "node"]].assign(m=m, before=[e[0] for e in found], after=[e[1] for e in found])

    levels = []
    for shift in shifts:
        levels.append(nodes.withColumn("parent", F.shiftright("node", shift)))
        nodes = levels[-1].groupBy(*ids, "m", "parent").applyInPandas(
            join, f"{kinds}, node long, m int, table array<double>, weight array<double>"
        )
    edge = f"{kinds}, node long, m int, before array<double>, after array<double>"
    edges = levels[-1].groupBy(*ids, "m").applyInPandas(lambda frame: spread(frame), edge)
    for level in reversed(levels[:-1]):
        above = edges.withColumnRenamed("node", "parent").groupBy(*ids, "m", "parent")
        edges = level.groupBy(*ids, "m", "parent").cogroup(above).applyInPandas(
            lambda frame, outside: spread(frame, outside), edge
        )
    return edges


def maximization(model: HmmModel, sums: np.ndarray) -> HmmModel:
    """New parameters from the sums; a state that explains nothing keeps its own."""
    k, d = model.means.shape
    _, first, moves, mass, sx, sxx = np.split(
        sums, np.cumsum([2, k, k * k, k, k * d])
    )
    moves = moves.reshape(k, k)
    initial = first / first.sum() if first.sum() > 0 else np.full(k, 1 / k)
    leaving = moves.sum(axis=1, keepdims=True)
    transition = np.where(leaving > 0, moves / np.where(leaving > 0, leaving, 1), 1 / k)
    seen = (mass > 0)[:, None]
    weight = np.where(mass > 0, mass, 1)[:, None]
    means = np.where(seen, sx.reshape(k, d) / weight, model.means)
    spread = np.maximum(sxx.reshape(k, d) / weight - means**2, MIN_VARIANCE)
    return HmmModel(
        means,
        np.where(seen, spread, model.variances),
        np.maximum(transition, MIN_PROBABILITY),
        np.maximum(initial, MIN_PROBABILITY),
    )


# --------------------------------------------------------------- training


def _first_centers(seqs: Sequences, ks: list[int], seed: int) -> dict[int, np.ndarray]:
    """Where k-means begins for each number of clusters; fewer centres where there are fewer distinct points.

    Several searches read one cached table of vectors.  k-means turns a table that is not itself cached into cached
    objects, which are faster while they fit into memory; a layout on disk is searched on the cached table.
    """
    shared = seqs.rows.select(array_to_vector(F.array(*seqs.features)).alias("vector"))
    shared = shared.persist(seqs.level) if seqs.on_disk or len(ks) > 1 else shared
    vectors = shared if seqs.on_disk else shared.select(F.col("vector"))

    def search(k: int) -> np.ndarray:
        if k == 1:
            return np.zeros((1, len(seqs.features)))
        fitted = KMeans(k=k, maxIter=0, seed=seed, featuresCol="vector", predictionCol="cluster").fit(vectors)
        return np.array(fitted.clusterCenters())

    # each search caches all rows for itself: several run at a time only where tables are small
    spark = vectors.sparkSession
    large = seqs.rows.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    try:
        with ThreadPool(1 if large else 4) as pool:
            return dict(zip(ks, pool.map(inheritable_thread_target(spark)(search), ks)))
    finally:
        if shared.is_cached:
            shared.unpersist()


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centre of every row, the first of equals."""
    score = (centers * centers).sum(axis=1)[:, None] - 2 * (centers @ x.T)
    best, nearest = score[0], np.zeros(len(x), dtype=np.int64)
    for j in range(1, len(centers)):
        nearest[score[j] < best] = j
        best = np.minimum(best, score[j])
    return nearest


def _count_task(centers: dict[int, np.ndarray], x: np.ndarray) -> dict[int, np.ndarray]:
    """Per clustering and cluster: rows and their sums."""
    out = {}
    for m, c in centers.items():
        member = np.equal.outer(np.arange(len(c)), _nearest(x, c)).astype(float)
        out[m] = np.hstack([member.sum(axis=1, keepdims=True), member @ x])
    return out


def _spread_task(centers: dict[int, np.ndarray], x: np.ndarray) -> dict[int, np.ndarray]:
    """Per clustering and cluster: rows, and the sums of differences from the centre and of their squares."""
    out = {}
    for m, c in centers.items():
        nearest = _nearest(x, c)
        away = (x[nearest == j] - c[j] for j in range(len(c)))
        out[m] = np.array([[len(a), *a.sum(axis=0), *(a * a).sum(axis=0)] for a in away])
    return out


def _cluster_sums(seqs: Sequences, centers: dict[int, np.ndarray], task) -> dict[int, np.ndarray]:
    """What ``task`` counts in the rows, added up; one pass for all clusterings."""
    features = seqs.features

    def run(packed: bool):
        def added(frames):
            sums: dict[int, np.ndarray] = {}
            loose = lambda: ((frame[features].to_numpy(dtype=float), None) for frame in frames)
            for x, _ in _unpacked(frames, len(features)) if packed else loose():
                for m, s in task(centers, x).items():
                    sums[m] = sums[m] + s if m in sums else s
            for m, s in sums.items():
                yield pd.DataFrame({"m": m, "pos": np.arange(s.size), "value": s.ravel()})

        return added

    if seqs.blocks is None:
        counted = seqs.rows.select(*features).mapInPandas(run(False), STATISTICS)
    else:
        counted = seqs.blocks.mapInPandas(run(True), STATISTICS)
        if seqs.cut:
            long = seqs.rows.where(LONG).select(*features)
            counted = counted.unionByName(long.mapInPandas(run(False), STATISTICS))
    width = task(centers, np.zeros((0, len(features))))
    sums = {m: np.zeros(w.size) for m, w in width.items()}
    for r in counted.groupBy("m", "pos").agg(F.sum("value").alias("value")).collect():
        sums[r.m][r.pos] = r.value
    return {m: s.reshape(width[m].shape) for m, s in sums.items()}


def _moved_centers(seqs: Sequences, centers: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Centres of the k-means clusters of all rows from where they begin; all clusterings share the passes."""
    centers = {m: c.copy() for m, c in centers.items()}
    open_ = {m: c for m, c in centers.items() if len(c) > 1}
    for _ in range(KMEANS_ROUNDS):
        if not open_:
            break
        for m, sums in _cluster_sums(seqs, open_, _count_task).items():
            held = sums[:, 0] > 0  # a cluster without rows keeps its centre
            moved = sums[held, 1:] / sums[held, :1]
            gone = ((moved - centers[m][held]) ** 2).sum(axis=1)
            centers[m][held] = moved
            if (gone <= KMEANS_TOL**2).all():
                del open_[m]
    return centers


def _centers(seqs: Sequences, k: int, seed: int) -> np.ndarray:
    """Centres of k-means clusters of all rows; fewer than ``k`` where there are fewer distinct points."""
    return _moved_centers(seqs, _first_centers(seqs, [k], seed))[k]


def _start_models(seqs: Sequences, centers: dict[int, np.ndarray]) -> dict[int, HmmModel]:
    """Start values from k-means centres, one pass for all."""
    d = len(seqs.features)
    sums = _cluster_sums(seqs, centers, _spread_task)
    models = {}
    for k, center in centers.items():
        # fewer distinct points than states: repeat some
        means, variances = center[np.arange(k) % len(center)], np.full((k, d), MIN_VARIANCE)
        for j, (n, *rest) in enumerate(sums[k]):
            if n:
                away, square = np.array(rest[:d]) / n, np.array(rest[d:]) / n
                means[j] = center[j] + away
                variances[j] = np.maximum(square - away**2, MIN_VARIANCE)
        transition = np.full((k, k), (1 - STAY) / (k - 1)) if k > 1 else np.ones((1, 1))
        if k > 1:
            np.fill_diagonal(transition, STAY)
        models[k] = HmmModel(means, variances, transition, np.full(k, 1 / k))
    return models


def _started(seqs: Sequences, ks: list[int], seed: int) -> tuple[Sequences, dict[int, HmmModel]]:
    """The packed layout and start values for each number of states."""
    first = _first_centers(seqs, ks, seed)
    packed = seqs.packed()  # after the search, which caches rows of its own
    return packed, _start_models(packed, _moved_centers(packed, first))


def init_model(seqs: Sequences, k: int, seed: int = 42) -> HmmModel:
    """Start values: k-means clusters, their variances, sticky transitions."""
    packed, models = _started(seqs, [k], seed)
    if packed is not seqs:
        packed.unpack()
    return models[k]


def fit_models(
    seqs: Sequences, start: dict[int, HmmModel], max_iter: int, tol: float
) -> dict[int, FitResult]:
    """Expectation-maximization for several models at once, one data pass per round."""
    fits = {m: FitResult(model, -np.inf, 0, False) for m, model in start.items()}
    for _ in range(max_iter):
        open_fits = {m: fit for m, fit in fits.items() if not fit.converged}
        if not open_fits:
            break
        sums = expectation(seqs, {m: fit.model for m, fit in open_fits.items()})
        for m, fit in open_fits.items():
            ll, rows = sums[m][:2]
            if rows == 0:
                raise ValueError("cannot fit a model on no rows")
            fit.model = maximization(fit.model, sums[m])
            fit.iterations += 1
            fit.converged = fit.iterations > 1 and abs(ll - fit.log_likelihood) < tol
            fit.log_likelihood = ll
            fit.history.append(ll)
    return fits


def fit_hmm(
    seqs: Sequences, k: int, max_iter: int = 100, tol: float = 1e-4, seed: int = 42
) -> FitResult:
    """Train one model.  Cut sequences count as the whole sequences they are."""
    packed, start = _started(seqs, [k], seed)
    fit = fit_models(packed, start, max_iter, tol)[k]
    if packed is not seqs:
        packed.unpack()
    fit.model = fit.model.relabelled()
    return fit


def bic(seqs: Sequences, models: dict[int, HmmModel]) -> dict[int, float]:
    """Bayesian information criterion, one scoring pass for all models."""
    sums = expectation(seqs, models)
    return {
        m: -2 * sums[m][0] + model.parameters * np.log(sums[m][1]) for m, model in models.items()
    }


def select_k(
    seqs: Sequences, rows: int | None = None, seed: int = 42
) -> tuple[int, dict[int, float]]:
    """Number of states with the lowest criterion; two rises in a row end the search.

    Short fits on all rows, or on whole sequences of about ``rows`` if given; all
    candidates share the passes.
    """
    sample = seqs if rows is None else sample_sequences(seqs, rows, seed)
    packed, start = _started(sample, list(K_RANGE), seed)
    fits = fit_models(packed, start, max_iter=10, tol=0.1)
    scores = bic(packed, {k: fit.model for k, fit in fits.items()})
    if packed is not sample:
        packed.unpack()
    if sample is not seqs:
        sample.unpersist()
    best, rises = min(K_RANGE), 0
    lowest = np.inf
    for k in K_RANGE:
        if scores[k] < lowest:
            best, lowest, rises = k, scores[k], 0
        else:
            rises += 1
            if rises == 2:
                break
    return best, scores


# --------------------------------------------------------------- decoding


def _best_of_pieces(log_b, log_move, begin, lengths):
    """Per piece: best score of ending in j when its first row is in i."""
    k = log_b.shape[1]
    order = np.argsort(-lengths, kind="stable")
    steps = _Lockstep(lengths, begin)
    table = log_b[steps.at(0)][:, None, :] + np.where(np.eye(k) > 0, 0.0, -np.inf)
    for t in range(1, steps.steps):
        at = steps.at(t)
        table[: len(at)] = _best_move(table[: len(at)], log_move) + log_b[at][:, None, :]
    out = np.empty_like(table)
    out[order] = table
    return out


def _best_move(score: np.ndarray, log_move: np.ndarray) -> np.ndarray:
    """Best score per next state: max over i of score[..., i] + move[i, j]."""
    return (score[..., :, None] + log_move).max(axis=-2)


def _best_paths(log_b, lengths, entry, log_move, leave=None) -> np.ndarray:
    """Most likely states of each sequence.

    ``entry`` holds the scores each sequence starts from (one row per sequence,
    before its first emission); ``leave`` fixes the last state where given.
    """
    pieces = _Pieces.of(lengths)
    n, k = len(pieces.lengths), log_b.shape[1]
    begin = np.cumsum(pieces.lengths) - pieces.lengths
    enter = np.empty((n, k))
    enter[pieces.first] = entry
    leaves = np.full(n, -1)
    if leave is not None:
        leaves[pieces.first + pieces.count - 1] = leave
    chained = pieces.chained
    if len(chained):
        table, final = np.zeros((n, k, k)), np.zeros((n, k))
        table[chained] = _best_of_pieces(log_b, log_move, begin[chained], pieces.lengths[chained])
        links = list(pieces.steps())
        for p in links:
            final[p] = (enter[p][:, :, None] + table[p]).max(axis=1)
            enter[p + 1] = _best_move(final[p], log_move)
        last = (pieces.first + pieces.count - 1)[pieces.count > 1]
        final[last] = (enter[last][:, :, None] + table[last]).max(axis=1)
        leaves[last] = np.where(leaves[last] < 0, final[last].argmax(axis=1), leaves[last])
        for p in reversed(links):
            through = table[p + 1, :, leaves[p + 1]]
            started = (enter[p + 1] + through).argmax(axis=1)
            leaves[p] = (final[p] + log_move.T[started]).argmax(axis=1)
    return _walk(log_b, begin, pieces.lengths, enter, leaves, log_move)


def _walk(log_b, begin, lengths, enter, leaves, log_move) -> np.ndarray:
    """Best path of every piece; a last state of -1 is free."""
    order = np.argsort(-lengths, kind="stable")
    steps = _Lockstep(lengths, begin)
    back = np.zeros(log_b.shape, dtype=np.int16)
    score = enter[order] + log_b[steps.at(0)]
    final = np.zeros((len(lengths), log_b.shape[1]))
    for t in range(1, steps.steps):
        at = steps.at(t)
        final[len(at) : len(score)] = score[len(at) :]
        options = score[: len(at), :, None] + log_move[None]
        back[at] = options.argmax(axis=1)
        score = options.max(axis=1) + log_b[at]
    final[: len(score)] = score
    path = np.zeros(len(log_b), dtype=np.int32)
    fixed = leaves[order]
    path[steps.first + steps.lengths - 1] = np.where(fixed < 0, final.argmax(axis=1), fixed)
    for t in range(steps.steps - 1, 0, -1):
        at = steps.at(t)
        path[at - 1] = back[at, path[at]]
    return path


def _decode_task(model: HmmModel, features: list[str], ids: list[str]):
    log_start = np.log(np.maximum(model.initial, MIN_PROBABILITY))
    log_move = np.log(_moves(model))

    def run(frames):
        for block, lengths in _blocks(frames, ids):
            log_b = model.log_emission(block[features].to_numpy(dtype=float))
            entry = np.broadcast_to(log_start, (len(lengths), model.k))
            states = _best_paths(log_b, lengths, entry, log_move)
            yield pd.DataFrame({FLOW_ID: block[FLOW_ID].to_numpy(), STATE: states})

    return run


def _decode_chunk(model: HmmModel, features: list[str]):
    log_move = np.log(_moves(model))

    def run(frame: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([START, FLOW_ID])
        log_b = model.log_emission(frame[features].to_numpy(dtype=float))
        entry = np.asarray(edge["before"].iloc[0])[None, :]
        leave = np.array([int(edge["after"].iloc[0][0])])
        states = _best_paths(log_b, np.array([len(frame)]), entry, log_move, leave)
        return pd.DataFrame({FLOW_ID: frame[FLOW_ID].to_numpy(), STATE: states})

    return run


def decode(seqs: Sequences, model: HmmModel) -> DataFrame:
    """The most likely state of every flow: FLOW_ID, HMM_STATE.

    A cut sequence is decoded exactly: each chunk first reports, for every state it could be entered from, the
    best score of leaving in every state; a tree chains these small matrices (:class:`_BestTree`); then every
    chunk is decoded with its known entry scores and last state.
    """
    out = f"{FLOW_ID} long, {STATE} int"
    ids, features = seqs.ids, seqs.features
    names = [FLOW_ID, *ids, CHUNK, *features]
    task = _decode_task(model, features, ids)
    if not seqs.cut:
        return seqs.rows.select(*names).mapInPandas(task, out)
    whole = seqs.rows.where(~F.col(LONG)).select(*names).mapInPandas(task, out)
    rows = seqs.rows.where(LONG)
    tree = _BestTree(model)
    edges = _tree_edges(materialize(_nodes(rows, seqs, tree), "nodes"), seqs, tree)
    cut = (
        rows.select(*names, START).groupBy(*ids, CHUNK)
        .cogroup(edges.withColumnRenamed("node", CHUNK).groupBy(*ids, CHUNK))
        .applyInPandas(_decode_chunk(model, features), out)
    )
    return whole.unionByName(cut)

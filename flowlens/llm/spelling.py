"""Spelling variants by blocked Gram matrices of letter counts.

Two words that differ by one inserted, deleted or replaced letter have letter counts at a squared distance of one
(length differs by one) or two (equal lengths).  Words of one length are blocks; a block is cut further by how many
letters it has of each of a few letter groups, which one edit changes by at most one in one group, or by one up and
one down in two.  So only adjacent blocks can hold near words.  For each two adjacent blocks one matrix product of
letter counts gives all squared distances; pairs at most two apart are compared letter by letter.

Only blocks of bounded size and pairs of their numbers are shuffled, and only near words come out.  A large cell
is dealt over as many blocks as its words and bytes need.  Letter groups follow the size of the vocabulary: a finer
cut changes how many pairs are multiplied, never which are found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import pieces, prepare, text_of
from flowlens.session import materialize

#: Shortest word, fewest occurrences, how many times as frequent a form is, and which share of runs loses a letter.
SHORTEST, LEAST, TIMES, DAMAGED = 7, 2, 10, 31
#: Words and letters to a block.
BLOCK_WORDS, BLOCK_LETTERS = 2048, 1 << 16
#: Counts of different words a task holds before it sends them on.
HELD_WORDS = 100_000
#: Letters compared at a time when candidates are verified.
COMPARED = 4 << 20

LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(65, 91)}
_PLACE = np.zeros(256, np.int64)
_PLACE[LETTERS] = np.arange(len(LETTERS))


def _count_task(batches):
    """Words of all texts with their counts; what a task holds is bounded."""
    held: Counter[str] = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            prefix = f"{'' if doc is None else doc}:"
            for part in pieces(text, _OTHER):
                for run, n in Counter(_RUN.findall(part.translate(_LOWER))).items():
                    h = zlib.crc32((prefix + run).encode())
                    if h % DAMAGED == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < SHORTEST:
                            continue
                    held[run] += n
                if len(held) >= HELD_WORDS:
                    yield rows()
    if held:
        yield rows()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of ``docs`` of ``SHORTEST`` letters or more that occur ``LEAST`` times or more."""
    texts = prepare_texts(docs)
    counted = texts.mapInArrow(_count_task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST)


def prepare_texts(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))


def letter_groups(words: int) -> int:
    """How many letter groups cut the blocks of a length: one more each time the vocabulary doubles."""
    return max(2, words.bit_length() - 14)


def _cells(words: DataFrame, groups: int) -> DataFrame:
    """Each word with ``cell``: how many letters it has of each group; the sum is its length."""
    counts = []
    for g in range(groups):
        mine = "".join(chr(c) for c in LETTERS if c % groups == g)
        counts.append(F.length("word") - F.length(F.translate("word", mine, "")))
    return words.withColumn("cell", F.array(*counts))


def _adjacent(cell: str, groups: int) -> F.Column:
    """The cells that one edit can lead to from ``cell``, each pair of cells from one side only."""
    steps = [[0] * groups]
    for i in range(groups):
        steps.append([int(g == i) for g in range(groups)])
        steps += [[int(g == i) - int(g == j) for g in range(groups)] for j in range(i + 1, groups)]
    moved = [F.array(*[F.col(cell)[g] + s for g, s in enumerate(step)]) for step in steps]
    return F.array(*moved)


def _matrix(letters: np.ndarray) -> np.ndarray:
    """Letter counts of the rows of a block."""
    m = len(letters)
    at = _PLACE[letters] + (np.arange(m) * len(LETTERS))[:, None]
    return np.bincount(at.ravel(), minlength=m * len(LETTERS)).reshape(m, len(LETTERS))


def near_pairs(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks (letters as bytes, one length each, the second as long or one letter longer) one edit apart."""
    exact = np.float32 if other.shape[1] <= 2000 else np.float64
    a, b = _matrix(one).astype(exact), _matrix(other).astype(exact)
    size_a, size_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    left = np.column_stack([2 * a, -size_a, -np.ones_like(size_a)])
    right = np.column_stack([b, np.ones_like(size_b), size_b])
    x, y = np.nonzero(left @ right.T >= -2)  # minus the squared distance
    keep = np.zeros(len(x), bool)
    width = one.shape[1]
    step = max(1, COMPARED // max(1, width))
    for k in range(0, len(x), step):
        p, q = one[x[k : k + step]], other[y[k : k + step]]
        if width == other.shape[1]:
            keep[k : k + step] = (p != q).sum(axis=1) == 1
        else:  # what agrees from the left and what agrees from the right cover the shorter word
            same = np.ones((len(p), 2, width + 1), bool)
            same[:, 0, :width], same[:, 1, :width] = p == q[:, :-1], (p == q[:, 1:])[:, ::-1]
            same[:, :, width] = False
            keep[k : k + step] = same.argmin(axis=2).sum(axis=1) >= width
    return x[keep], y[keep]


NEAR = "word string, other string, n_other long"


def _near_task(batches):
    for batch in batches:
        found: list[tuple[list, list, np.ndarray]] = []
        cols = [batch.column(i) for i in range(batch.num_columns)]
        for k in range(batch.num_rows):
            la, wa, na, lb, wb, nb, same = (c[k].as_py() if i not in (2, 5) else c[k] for i, c in enumerate(cols))
            one = np.frombuffer(wa, np.uint8).reshape(-1, la)
            other = np.frombuffer(wb, np.uint8).reshape(-1, lb)
            x, y = near_pairs(one, other)
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                n_one, n_other = na.values.to_numpy(), nb.values.to_numpy()
                words_one = [one[i].tobytes().decode("latin-1") for i in x]
                words_other = [other[i].tobytes().decode("latin-1") for i in y]
                found += [(words_one, words_other, n_other[y]), (words_other, words_one, n_one[x])]
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w for f in found for w in f[0]]),
                    pa.array([w for f in found for w in f[1]]),
                    pa.array(np.concatenate([f[2] for f in found])),
                ],
                ["word", "other", "n_other"],
            )


def near_words(words: DataFrame, groups: int) -> DataFrame:
    """(word, other, n_other): all pairs of (word, n) one edit apart, in both directions."""
    placed = _cells(words, groups)
    sizes = placed.groupBy("cell").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_WORDS), F.ceil(F.sum(F.length("word")) / BLOCK_LETTERS)
        ).alias("chunks")
    )
    sizes = materialize(sizes, "cells")
    chunk = F.pmod(F.xxhash64("word"), F.col("chunks")).alias("chunk")
    blocks = (
        placed.join(sizes, "cell").select("cell", chunk, "word", "n")
        .groupBy("cell", "chunk").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w"))
        .select(
            "cell", "chunk", F.length(F.col("w")[0]["word"]).alias("length"),
            F.encode(F.array_join("w.word", ""), "ISO-8859-1").alias("letters"), F.col("w.n").alias("n"),
        )
    )
    blocks = materialize(blocks, "blocks")
    inside = F.aggregate("to", F.lit(True), lambda ok, c: ok & (c >= 0))
    pairs = (
        sizes.select("cell", F.col("chunks").alias("ca"), F.explode(_adjacent("cell", groups)).alias("to"))
        .where(inside).join(sizes.select(F.col("cell").alias("to"), F.col("chunks").alias("cb")), "to")
        .withColumn("same", F.col("cell") == F.col("to"))
        .withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ca") - 1)))
        .withColumn("b", F.explode(F.sequence(F.when(F.col("same"), F.col("a")).otherwise(0), F.col("cb") - 1)))
    )
    one = blocks.select(
        "cell", F.col("chunk").alias("a"), F.col("length").alias("la"), F.col("letters").alias("wa"), F.col("n").alias("na")
    )
    other = blocks.select(
        F.col("cell").alias("to"), F.col("chunk").alias("b"), F.col("length").alias("lb"), F.col("letters").alias("wb"),
        F.col("n").alias("nb"),
    )
    met = pairs.join(one, ["cell", "a"]).join(other, ["to", "b"])
    met = met.select("la", "wa", "na", "lb", "wb", "nb", (F.col("same") & (F.col("a") == F.col("b"))).alias("same"))
    return met.mapInArrow(_near_task, NEAR)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form.

    A form is ``TIMES`` times as frequent as its word, so a chain is short; each round doubles the steps taken.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = at.join(beyond, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
        )
        after = materialize(after, "roots")
        moved = after.where("moved").limit(1).count()
        at = after.drop("moved")
        if not moved:
            return at


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of ``docs``: word, form, root, n, n_near, form_n.

    Words are maximal runs of Latin-1 letters (and the two signs between them), A-Z lower-cased; of every run of a
    document whose crc32 of ``<doc_id>:<run>`` 31 divides, one letter is deleted.  Words shorter than ``SHORTEST``
    or rarer than ``LEAST`` are left out.  ``form`` is the most frequent near word (ties: the smallest in code point
    order) if it is ``TIMES`` times as frequent, ``root`` the end of the chain of forms.

    Null and empty texts have no words; a null doc_id is written as nothing before the colon.  Repeated rows count
    as often as they stand there.  Very long texts are read in pieces, very long words fill blocks of their own.
    Columns besides doc_id and text are ignored; an empty table gives no rows.
    """
    words = materialize(vocabulary(docs), "words")
    near = near_words(words, letter_groups(words.count()))
    best = F.min(F.struct(-F.col("n_other"), "other"))
    best = materialize(near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near")
    top = -F.col("best")["col1"]
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(top >= TIMES * F.col("n"), F.col("best")["other"]).alias("form"),
        F.when(top >= TIMES * F.col("n"), top).alias("form_n"),
    )
    known = materialize(known, "forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, those with the smallest hash of
their id), whose statistics are the only thing that reaches the driver.  The fitted trees are flattened into
arrays (perfect binary trees by level), broadcast at a size fixed by ``TREES`` and ``DEPTH``, and walked for
a whole batch of documents at once.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import prepare, release_memory, text_of

#: At most so many labelled rows are used to fit the trees.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_CHILD = 80, 4, 64, 0.2, 1.0, 5.0

# Classes of bytes counted for each text.
_KINDS = np.zeros(256, np.uint8)
for _kind, _members in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!", b"|",
     b"#$%&*@^~+=<>\\/_", b"'\"()[]{}:;?-"), start=1,
):
    _KINDS[list(_members)] = _kind
_KINDS[128:] = 12
N_KINDS = 13


def statistics(text: str) -> list[float]:
    """The inputs of the classifier; an empty text gives zeros throughout."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    counts = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=N_KINDS) / size
    words = text.split()
    n = max(1, len(words))
    often = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    top = often.most_common(1)[0][1] if often else 0
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    upper = sum(map(str.isupper, words))
    again = sum(map(eq, words, islice(words, 1, None)))
    pairs = len(set(zip(words, islice(words, 1, None))))
    return [
        log1p(len(text)), log1p(len(words)), log1p(len(lines)), len(words) / n_lines,
        *counts.tolist(),
        float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        len(often) / n, top / n, upper / n, again / n, pairs / n,
        len(set(lines)) / n_lines, sum(1 for w in words if not any(map(str.isalnum, w))) / n,
        sum(1 for w in words if w[-1] in ".,;:!?") / n,
    ]


N_FEATURES = len(statistics(""))


def fit_trees(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Boosted trees for labels 0 and 1, as arrays: feature, cut (go right if above), leaf; and a base score.

    Without rows of both labels the trees are empty and every score is the share of label 1 (a half without rows).
    """
    n, inner, leaves = len(y), (1 << DEPTH) - 1, 1 << DEPTH
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    feature, cut, leaf = (
        np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)),
    )
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        raw = np.full(n, base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(DEPTH):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    slot, cells = node * BINS + binned[:, f], width * BINS
                    g = np.bincount(slot, grad, cells).reshape(width, BINS)
                    h = np.bincount(slot, hess, cells).reshape(width, BINS)
                    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                    g_all, h_all = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                    gr, hr = g_all - gl, h_all - hl
                    gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - g_all**2 / (h_all + L2)
                    gain[(hl < LEAST_CHILD / 4) | (hr < LEAST_CHILD / 4)] = 0
                    gain[:, len(e):] = 0
                    at = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(width), at] > best):
                        best[k] = gain[k, at[k]]
                        feature[t, first + k], cut[t, first + k] = f, e[at[k]]
                go = x[np.arange(n), feature[t, first + node]] > cut[t, first + node]
                node = node * 2 + go
            g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
            leaf[t] = RATE * g / (h + L2)
            raw += leaf[t][node]
    return {"feature": feature, "cut": cut, "leaf": leaf, "base": np.array([base])}


def walk(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores of a batch: all rows go down all trees together, a level at a time."""
    trees = np.arange(len(model["leaf"]))
    rows = np.arange(len(x))[:, None]
    at = np.zeros((len(x), len(trees)), np.int64)
    for _ in range(DEPTH):
        at = 2 * at + 1 + (x[rows, model["feature"][trees, at]] > model["cut"][trees, at])
    raw = model["base"][0] + model["leaf"][trees, at - ((1 << DEPTH) - 1)].sum(1)
    return 1 / (1 + np.exp(-raw))


def _held_out(column):
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def _stats_batches(batches):
    for batch in batches:
        flat = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("y"), pa.array(flat, pa.list_(pa.float64()))], names=["y", "x"]
        )
    release_memory()


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Trees fitted on labelled rows outside the held-out fold (crc32 of the id mod 3 is 1), whole texts.

    Of several texts of one id the smallest counts.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~_held_out(F.col("doc_id")))
    chosen = (
        known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # Bounded by sample_rows: a few bytes for each chosen row, one text of each id however often it is repeated.
    texts = docs.select(F.col("doc_id"), text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    rows = texts.select("y", "text").mapInArrow(_stats_batches, "y double, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), N_FEATURES)
    # The order of rows from tasks varies; a fixed one makes equal sums and equal trees.
    order = np.lexsort(x.T[::-1])
    return fit_trees(x[order], rows["y"].to_numpy(np.float64)[order])


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score, text) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float64)
            values = walk(shared.value, x.reshape(batch.num_rows, N_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", "score"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null texts are scored as empty ones.  A null doc_id is in no fold (held_out false).  Repeated rows are
    scored each.  Labels with a null id or value are not used; of several labels of one id the larger counts.
    Language, source, id and other columns are never inputs.
    """
    prepare(docs.sparkSession)
    scored = score(docs, fit(docs, labels, sample_rows))
    return scored.select(
        "doc_id",
        _held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` the classifier accepts, with all their columns.

    Null texts are scored as empty ones; repeated rows and rows without an id are scored each.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            x = np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), N_FEATURES)
            yield batch.filter(pa.array(walk(shared.value, x) >= least))
        release_memory()

    return docs.mapInArrow(run, docs.schema)

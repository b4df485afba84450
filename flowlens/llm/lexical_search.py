"""Ranked lexical search over a length-stratified index.

Documents are dealt into shards of bounded size as they are read.  Inside a shard the documents with an equal
normaliser m form a stratum; its postings stand by term and falling term frequency.  The part of a score that a
posting brings depends only on m and the frequency, so it is computed once for each frequency of a stratum, and the
first posting of a term bounds what the term can bring there.  For each item a shard adds these bounds up, visits
its strata from the highest on and stops where the bound is below the score of its k-th document; a document lies in
one stratum, so its score is whole when that is visited.  The best of all shards are then ranked.

Scores are 64-bit integers, so nothing depends on the order of additions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.common import pieces, prepare, runs, text_of
from flowlens.session import materialize

#: Documents to an item.
BEST = 50
#: Documents and postings to a shard.
SHARD_DOCS, SHARD_POSTINGS = 65_000, 2_000_000
#: Most different terms that an index can be restricted to; with more, all terms are indexed.
MOST_TERMS = 1_000_000
#: Items, and terms of items, that are searched at a time.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 500_000
#: Groups of shards that are ranked before all shards are.
RANK_GROUPS = 64

_SEPARATOR = "\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # the same in UTF-8
_BREAK = re.compile(f"[{_SEPARATOR}]")


def term_counts(text: str | None) -> Counter[bytes]:
    """Occurrences of the terms of a text, A-Z lower-cased, as UTF-8."""
    counts: Counter[bytes] = Counter()
    for part in pieces(text or "", _BREAK):
        counts.update(_TERM.findall(part.encode().lower()))
    return counts


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Index:
    """Strata (one row per shard and m), and the statistics of the documents that have a term."""

    strata: DataFrame
    documents: int
    terms: int

    def frequencies(self, wanted: list[str]) -> dict[str, int]:
        """Number of documents that hold each of these terms."""
        spark = self.strata.sparkSession
        asked = spark.createDataFrame(pd.DataFrame({"term": pd.Series(wanted, dtype="object")}), "term string")
        held = self.strata.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).groupBy("t.terms")
        df = held.agg(F.sum("t.held").alias("df")).withColumnRenamed("terms", "term")
        return {r.term: r.df for r in df.join(asked, "term", "left_semi").collect()}


_COUNTED = "shard long, n long, doc long, known boolean, place int, terms array<string>, tfs array<int>"
_STRATA = (
    "shard long, m long, docs array<long>, known array<boolean>, "
    "terms array<string>, held array<int>, tfs array<int>, places array<int>"
)


def _count_task(wanted: frozenset[bytes] | None):
    def run(batches):
        part = TaskContext.get().partitionId()
        shard, docs, postings = part << 32, 0, 0
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = term_counts(text)
                n = sum(counts.values())
                if not n:
                    continue
                held = counts.keys() if wanted is None else wanted & counts.keys()
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    shard, docs, postings = shard + 1, 0, 0
                names = sorted(held)
                tfs = [counts[t] for t in names]
                out.append((shard, n, doc or 0, doc is not None, docs, [t.decode() for t in names], tfs))
                docs, postings = docs + 1, postings + len(names)
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
                names = [c.split()[0] for c in _COUNTED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def _stratify(frame: pd.DataFrame) -> pd.DataFrame:
    """The documents of one shard and m as a stratum: postings by term, highest frequency first."""
    frame = frame.sort_values("place")
    per_doc = frame["terms"].map(len).to_numpy()
    place = np.repeat(np.arange(len(frame)), per_doc)
    text = np.array([t for ts in frame["terms"] for t in ts], dtype=object)
    names, code = np.unique(text, return_inverse=True) if len(text) else (text, np.empty(0, np.int64))
    tfs = np.array([x for xs in frame["tfs"] for x in xs], np.int64)
    order = np.lexsort((place, -tfs, code))
    return pd.DataFrame(
        {
            "shard": [int(frame["shard"].iloc[0])],
            "m": [int(frame["m"].iloc[0])],
            "docs": [frame["doc"].tolist()],
            "known": [frame["known"].tolist()],
            "terms": [names.tolist()],
            "held": [np.bincount(code, minlength=len(names)).tolist()],
            "tfs": [tfs[order].tolist()],
            "places": [place[order].tolist()],
        }
    )


def build_index(docs: DataFrame, wanted: set[str] | None = None) -> Index:
    """Index every document that has a term; ``wanted`` leaves out the postings of all other terms.

    Texts are read once: shards carry term counts, and strata follow when N and L are known.
    """
    prepare(docs.sparkSession)
    names = None if wanted is None else frozenset(t.encode() for t in wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    counted = materialize(texts.mapInArrow(_count_task(names), _COUNTED), "counted")
    documents, terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"50 + (50 * n * {documents}L) div {max(1, terms)}L")
    strata = counted.withColumn("m", m).groupBy("shard", "m").applyInPandas(_stratify, _STRATA)
    return Index(materialize(strata, "strata"), documents, terms)


class _Shard:
    """Postings of one shard, stratum after stratum, for the terms that are asked for."""

    def __init__(self, rows: pd.DataFrame, asked: dict[str, int]):
        doc, known, segments, places, impacts = [], [], [], [], []
        docs = at = 0
        for s, row in enumerate(rows.itertuples(index=False)):
            ends = np.cumsum(row.held)
            values, which = np.unique(np.asarray(row.tfs, np.int64), return_inverse=True)
            of_tf = impact(values, row.m)  # once for each frequency
            brought = of_tf[which]
            for t, end, held in zip(row.terms, ends, row.held):
                code = asked.get(t)
                if code is not None:
                    segments.append((code, s, at + end - held, at + end))
            places.append(np.asarray(row.places, np.int64) + docs)
            impacts.append(brought)
            doc.append(np.asarray(row.docs, np.int64))
            known.append(np.asarray(row.known, bool))
            docs, at = docs + len(row.docs), at + len(row.tfs)
        self.strata = len(rows)
        self.doc = np.concatenate(doc)
        self.known = np.concatenate(known)
        self.place = np.concatenate(places)
        self.impact = np.concatenate(impacts)
        table = np.array(sorted(segments), np.int64).reshape(-1, 4)
        self.stratum, self.start, self.end = table[:, 1], table[:, 2], table[:, 3]
        first, count = runs(table[:, 0])
        self.of_term = {int(c): slice(f, f + k) for c, f, k in zip(table[first, 0], first, count)}
        self.scores = np.zeros(docs, np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents: highest score, then smallest id, ids known first."""
        slices = [(self.of_term[t], w) for t, w in zip(terms.tolist(), weights.tolist()) if t in self.of_term]
        none = np.empty(0, np.int64)
        if not slices:
            return none, none
        segment = np.concatenate([np.arange(s.start, s.stop) for s, _ in slices])
        weight = np.repeat(np.array([w for _, w in slices], np.int64), [s.stop - s.start for s, _ in slices])
        bounds = np.zeros(self.strata, np.int64)
        np.add.at(bounds, self.stratum[segment], weight * self.impact[self.start[segment]])
        by_stratum = np.argsort(-bounds[self.stratum[segment]], kind="stable")
        segment, weight = segment[by_stratum], weight[by_stratum]
        limit = bounds[self.stratum[segment]]  # falling
        found, scores, lowest = none, none, 1
        at, step = 0, 256
        while at < len(segment) and limit[at] >= lowest:
            to = min(len(segment), at + step)
            to = int(np.searchsorted(-limit, -limit[to - 1], side="right"))  # whole strata
            place, score = self._visit(segment[at:to], weight[at:to])
            found, scores = np.concatenate([found, place]), np.concatenate([scores, score])
            order = np.lexsort((self.doc[found], ~self.known[found], -scores))[:k]
            found, scores = found[order], scores[order]
            lowest = int(scores[-1]) if len(scores) == k else 1
            at, step = to, step * 2
        return found, scores

    def _visit(self, segment: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents with a score above 0 in these strata."""
        start, size = self.start[segment], self.end[segment] - self.start[segment]
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        posting = np.arange(len(shift)) + shift
        place = self.place[posting]
        np.add.at(self.scores, place, np.repeat(weight, size) * self.impact[posting])
        place = np.unique(place)
        score = self.scores[place]
        self.scores[place] = 0
        return place[score > 0], score[score > 0]


def _search_task(items: list[tuple[int, np.ndarray, np.ndarray]], asked: dict[str, int], k: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        shard = _Shard(frame.sort_values("m"), asked)
        out = []
        for item, terms, weights in items:
            place, score = shard.best(terms, weights, k)
            if len(place):
                doc = pd.Series(shard.doc[place], dtype="Int64").mask(~shard.known[place])
                out.append(pd.DataFrame({"item": item, "shard": int(key[0]), "doc_id": doc, "score": score}))
        if not out:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("item", "shard", "doc_id", "score")})
        return pd.concat(out, ignore_index=True)

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter[bytes]]]]:
    """(item_id, terms) of the distinct items, some at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").distinct().toLocalIterator():
        block.append((row.item_id, term_counts(row.text)))
        size += len(block[-1][1])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def item_terms(items: DataFrame, most: int = MOST_TERMS) -> set[str] | None:
    """All terms of the items, or nothing if there are more than ``most``."""
    found: set[str] = set()
    for block in _blocks(items):
        for _, counts in block:
            found.update(t.decode() for t in counts)
        if len(found) > most:
            return None
    return found


def search(index: Index, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, all if fewer have a score above 0.

    Equal scores stand by doc_id, null ids last; ranks are unique.  Items are searched against all shards in
    blocks.  A repeated item is searched once; items of one id but different texts are ranked apart.  Items with a
    null or empty text, or without any known term, give no rows.
    """
    spark = index.strata.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for block in _blocks(items):
        wanted = sorted({t.decode() for _, counts in block for t in counts})
        df = index.frequencies(wanted)
        asked = {t: c for c, t in enumerate(t for t in wanted if t in df)}
        weight = {t: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df[t] + 1))) for t in asked}
        queries = []
        for number, (_, counts) in enumerate(block):
            known = [t for t in sorted(x.decode() for x in counts) if t in asked]
            queries.append((number, np.array([asked[t] for t in known], np.int64), np.array([weight[t] for t in known], np.int64)))
        names = spark.createDataFrame(list(enumerate(item for item, _ in block)), f"item long, item_id {kind}")
        task = _search_task(queries, asked, k)
        hits = index.strata.groupBy("shard").applyInPandas(task, "item long, shard long, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        group = Window.partitionBy("item", F.pmod("shard", F.lit(RANK_GROUPS))).orderBy(*order)
        hits = hits.withColumn("nth", F.row_number().over(group)).where(F.col("nth") <= k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
        hits = hits.withColumn("rank", rank).where(F.col("rank") <= k)
        hits = materialize(hits.join(names, "item").select("item_id", "rank", "doc_id", "score"), "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """Search all ``docs`` for each of ``items``: :func:`build_index` over the items' terms, then :func:`search`.

    Documents without a term (null and empty texts among them) are in no stratum and count for nothing; each of
    repeated rows is a document of its own; very long texts are read in pieces.  Other columns are ignored.  With
    an empty table of documents or items there are no rows.
    """
    return search(build_index(docs, item_terms(items)), items, k)

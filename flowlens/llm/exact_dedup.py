"""Exact deduplication with a sharded cuckoo-filter index over live digests.

Every shard of the index holds a cuckoo filter (16-bit fingerprints, four to a bucket) and, by bucket, the
stored keys: the full digest, the largest id and the number of rows.  A lookup asks the filter first; a hit is
verified against the keys of its bucket.  Entries can be inserted and deleted; when an insertion finds no
place, the filter is doubled and filled again from the stored keys.  Shards hold a bounded number of keys:
their number follows the number of rows.

Rows of one text are combined per (digest, salt) in the map tasks first, so a text that a third of all rows
share reaches its shard as a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.common import prepare, spare, text_of
from flowlens.session import materialize

SLOTS = 4
KICKS = 200
#: Rows of input that one shard of the index is made for.
SHARD_ROWS = 50_000
#: Parts into which the rows of one text are combined before they meet in the index.
SALTS = 16


class CuckooIndex:
    """Cuckoo filter and the stored keys behind it, both by bucket."""

    def __init__(self, buckets: int = 64):
        self.buckets = 1 << max(2, (buckets - 1).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.filter = np.zeros((self.buckets, SLOTS), np.uint16).tolist()
        self.keys: dict[int, dict[bytes, tuple]] = {}
        self.size = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[8:16], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def find(self, digest: bytes) -> tuple | None:
        """The value stored for a digest; a filter hit alone never counts."""
        mark, first, second = self._places(digest)
        if mark not in self.filter[first] and mark not in self.filter[second]:
            return None
        return self.keys.get(first, {}).get(digest)

    def insert(self, digest: bytes, value: tuple) -> None:
        """Store a digest that is not in the index."""
        mark, first, second = self._places(digest)
        self.keys.setdefault(first, {})[digest] = value
        self.size += 1
        if not self._place(mark, first, second):
            self._grow()

    def _place(self, mark: int, first: int, second: int) -> bool:
        for bucket in (first, second):
            slots = self.filter[bucket]
            if 0 in slots:
                slots[slots.index(0)] = mark
                return True
        bucket = second
        for kick in range(KICKS):
            slots = self.filter[bucket]
            at = (kick * 7 + mark) % SLOTS
            slots[at], mark = mark, slots[at]
            bucket = self._other(bucket, mark)
            slots = self.filter[bucket]
            if 0 in slots:
                slots[slots.index(0)] = mark
                return True
        return False

    def _grow(self) -> None:
        stored = list(self.items())
        self.buckets *= 2
        self._clear()
        for digest, value in stored:
            self.insert(digest, value)

    def delete(self, digest: bytes) -> tuple | None:
        """Take a live digest out of filter and keys; what was stored for it."""
        value = self.find(digest)
        if value is None:
            return None
        mark, first, second = self._places(digest)
        del self.keys[first][digest]
        slots = self.filter[first] if mark in self.filter[first] else self.filter[second]
        slots[slots.index(mark)] = 0
        self.size -= 1
        return value

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        for stored in self.keys.values():
            yield from stored.items()


INDEX_SCHEMA = "shard int, digest binary, keep_id long, group_size long"


def _merged(old: tuple | None, new: tuple) -> tuple:
    if old is None:
        return new
    ids = [x for x in (old[0], new[0]) if x is not None]
    return (max(ids) if ids else None, old[1] + new[1])


def _table(shard: int, index: CuckooIndex) -> pd.DataFrame:
    rows = list(index.items())
    return pd.DataFrame(
        {
            "shard": np.full(len(rows), shard, np.int32),
            "digest": [d for d, _ in rows],
            "keep_id": pd.array([v[0] for _, v in rows], dtype="Int64"),
            "group_size": np.array([v[1] for _, v in rows], np.int64),
        }
    )


def _fill(index: CuckooIndex, rows: pd.DataFrame) -> None:
    ids = rows["keep_id"].astype("Int64")
    for digest, i, null, n in zip(rows["digest"], ids.fillna(0), ids.isna(), rows["group_size"], strict=True):
        digest, new = bytes(digest), (None if null else int(i), int(n))
        # The live entry of a text gives way to one with the larger id.
        index.insert(digest, _merged(index.delete(digest), new))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row; a null text counts as empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)).alias("digest"),
    )


def _combined(keyed: DataFrame, shards: int) -> DataFrame:
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = salted.groupBy("digest", "salt").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return parts.select(
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"),
        "digest",
        "keep_id",
        "group_size",
    )


def build_index(keyed: DataFrame, rows: int) -> DataFrame:
    """The index over (doc_id, digest) rows: one row per live digest, by shard."""
    shards = max(64, -(-rows // SHARD_ROWS))

    def build(key, group: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex(len(group) // 3)
        _fill(index, group)
        return _table(int(key[0]), index)

    return _combined(keyed, shards).groupBy("shard").applyInPandas(build, INDEX_SCHEMA)


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, shards: int) -> DataFrame:
    """A stored index after digests were withdrawn (``deletes``: digest) and rows added (doc_id, digest)."""
    added = _combined(inserts, shards).withColumn("step", F.lit(2))
    gone = deletes.select(
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"),
        "digest",
        F.lit(None).cast("long").alias("keep_id"),
        F.lit(0).cast("long").alias("group_size"),
        F.lit(1).alias("step"),
    ).distinct()
    changes = index.withColumn("step", F.lit(0)).unionByName(gone).unionByName(added)

    def apply(key, group: pd.DataFrame) -> pd.DataFrame:
        live = CuckooIndex(len(group) // 3)
        _fill(live, group[group.step == 0])
        for digest in group[group.step == 1].digest:
            live.delete(bytes(digest))
        _fill(live, group[group.step == 2])
        return _table(int(key[0]), live)

    return changes.groupBy("shard").applyInPandas(apply, INDEX_SCHEMA)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with identical text the one with the largest id stays.  A null text is the empty text.  Null ids
    count as smaller than any other; rows that repeat both id and text are reported once each, all with the
    same answer.  Other columns of the input are not looked at.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    keyed = materialize(digests(docs, id_col, text_col), "digests")
    index = build_index(keyed, keyed.count()).select("digest", "keep_id", "group_size")
    return keyed.join(index, "digest", "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of fully repeated rows one stays."""
    doc, sha, key, nth = spare(docs.columns, "__id", "__sha", "__key", "__nth")
    stay = exact_dedup(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias(doc), F.col("text_sha256").alias(sha)
    ).distinct()
    here = docs.withColumn(key, F.sha2(text_of(text_col).cast("binary"), 256))
    kept = here.join(
        stay,
        F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(sha)),
        "left_semi",
    )
    one = Window.partitionBy(F.col(f"`{id_col}`"), key).orderBy(F.lit(0))
    return kept.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).drop(nth, key)

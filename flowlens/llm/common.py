"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows an Arrow batch holds at most: texts can be long, a Python worker's memory is small.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches; changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text of a column, null as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def spare(columns: list[str], *names: str) -> list[str]:
    """These names, lengthened where a column has one of them already (upper and lower case are the same)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """At the end of a task: give freed memory back, as idle workers share an executor with busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Join batches into larger ones of about ``most`` bytes of text, never more than one document over."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = batch.schema.get_field_index(column)
        held.append(batch)
        size += batch.column(at).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pieces(text: str, separator: re.Pattern, most: int = 1 << 20) -> Iterator[str]:
    """A text in parts of about ``most`` characters, cut only at separators; joined, the parts are the text."""
    at = 0
    while len(text) - at > most:
        cut = separator.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column without nulls, and where each row starts (one more than rows)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (constants of the splitmix64 generator)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def split_at_spaces(text: str) -> list[str]:
    """Cut a text before every space that a non-space follows; joined, the parts are the text.

    Byte-level BPE pre-tokens never run over such a place, and what stands on one side does not change
    how the other side is cut, so parts can be encoded on their own and remembered.
    """
    if _LOOSE_SPACE.search(text):
        parts = _BEFORE_WORD.split(text)
    else:
        parts = text.split(" ")
    return [parts[0], *map(" ".__add__, parts[1:])] if len(parts) > 1 else parts


_LOOSE_SPACE = re.compile(r" (?:\s|$)")
_BEFORE_WORD = re.compile(r" (?=\S)")


def pack_ids(ids: list[int]) -> bytes:
    """Token ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every run of equal neighbours."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(values)]]))

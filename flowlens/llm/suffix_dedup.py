"""Removal of repeated byte strings through partitioned suffixes.

Only suffixes that can matter are sorted.  Each window of ``LENGTH`` bytes is led by one of its grams (the one with
the smallest hash, leftmost), so equal windows have equal leading grams at equal places; windows whose leading gram
no other place has cannot repeat.  The leading grams are combined in fragments (see :mod:`fragments`); the suffixes
with a repeated one are range-partitioned by splitters sampled from them.  In each bucket the windows are sorted by multikey
quicksort, eight bytes at a time and only where the bytes before tie; of equal windows all but the first are removed.
Equal windows have equal leading grams and splitters cut between grams, so none of them lie across a boundary.
Chunks of documents are compared inside the map task first (by 64-bit hash, then byte by byte), so a passage in a
third of all documents reaches its bucket as one window for each chunk; what is left of the commonest leading grams
(windows over the edge of such a passage, each different) is dealt out window by window instead of by gram.
A leading gram is known by a second hash: the smallest hashes lie close together, fragments have to be even.  Windows
are sorted some ``AT_ONCE`` at a time, equal ones together; each other window of a bucket takes three bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import fragments as fr
from flowlens.llm.common import mix, partitions, prepare, release_memory, runs, text_bytes, text_of
from flowlens.session import materialize

LENGTH, GRAM = 100, 30
_GRAMS = LENGTH - GRAM + 1
#: A document is indexed in pieces of at most so many bytes (a place and a count share 32 bits).
PIECE = 1 << 24
#: Text that a map task compares at once, in bytes.
CHUNK_TEXT = 8 << 20
#: Suffixes to a bucket, about.
SUFFIXES_OF_BUCKET = 100_000
#: Leading grams with more than one HOT-th of all suffixes, or more than a bucket is meant for, are dealt out by window:
#: there are fewer than HOT, or than buckets.
HOT = 1000
#: Windows that are sorted at once.
AT_ONCE = 1 << 19
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK + LENGTH, np.uint64(_BASE))]))
_INVERSE = np.cumprod(
    np.concatenate([[np.uint64(1)], np.full(_BLOCK + LENGTH, np.uint64(pow(_BASE, -1, 1 << 64)))])
)
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0xA11CE))
_PLACE = np.uint64((1 << 21) - 1)


def _prefix(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * _POWER[: len(raw)])])


def leaders(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one leading gram: the gram's second hash, the first window, the number of windows."""
    tokens, first, count = [], [], []
    for a in range(0, max(0, len(raw) - LENGTH + 1), _BLOCK):
        part = raw[a : a + _BLOCK + LENGTH - 1]
        sums = _prefix(part)
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * _INVERSE[: len(part) - GRAM + 1])
        n = len(gram)
        ranked = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64)
        # Sliding minimum: smallest to the end and from the beginning of blocks as long as the window.
        padded = np.full(-(-n // _GRAMS) * _GRAMS, ~np.uint64(0))
        padded[:n] = ranked
        blocks = padded.reshape(-1, _GRAMS)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        lead = np.minimum(behind[: n - _GRAMS + 1], ahead[_GRAMS - 1 : n])
        start, many = runs(lead)
        tokens.append(mix(gram[(lead[start] & _PLACE).astype(np.int64)] + np.uint64(_BASE)))
        first.append(start + a)
        count.append(many)
    if not tokens:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(tokens), np.concatenate(first), np.concatenate(count)


def window_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the windows at ascending ``starts``."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(raw), _BLOCK):
        i, j = np.searchsorted(starts, [a, a + _BLOCK])
        if i < j:
            sums = _prefix(raw[a : a + _BLOCK + LENGTH - 1])
            at = starts[i:j] - a
            out[i:j] = mix((sums[at + LENGTH] - sums[at]) * _INVERSE[at])
    return out


def shares(n: int, keys):
    """The numbers below ``n`` in shares of about ``AT_ONCE``, ascending; those of one key are in one share.

    ``keys(a, b)`` gives the keys from a to b, spread over 64 bits.
    """
    several = -(-n // AT_ONCE)
    if several < 2:
        yield np.arange(n)
        return
    share = np.empty(n, np.uint16)
    for a in range(0, n, AT_ONCE):
        share[a : a + AT_ONCE] = keys(a, min(n, a + AT_ONCE)) % np.uint64(several)
    for k in range(several):
        yield np.flatnonzero(share == k)


def later_copies(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows equal an earlier one (in the order given), and the hashes; ``starts`` ascend."""
    hashes = window_hashes(raw, starts)
    later = np.zeros(len(starts), bool)
    for own in shares(len(starts), lambda a, b: hashes[a:b]):
        order = own[np.argsort(hashes[own], kind="stable")]
        begin, count = runs(hashes[order])
        several = count > 1
        mine, first = order[np.repeat(several, count)], np.repeat(order[begin[several]], count[several])
        if not len(mine):
            continue
        views = sliding_window_view(raw, LENGTH)
        same = np.empty(len(mine), bool)
        for a in range(0, len(mine), 1 << 15):
            b = a + (1 << 15)
            same[a:b] = (views[starts[mine[a:b]]] == views[starts[first[a:b]]]).all(axis=1)
        later[mine] = same & (mine != first)
        for clash in np.unique(hashes[mine[~same]]):  # different windows of one hash: by their bytes
            seen: set[bytes] = set()
            for i in mine[hashes[mine] == clash].tolist():
                data = raw[starts[i] : starts[i] + LENGTH].tobytes()
                later[i] = data in seen
                seen.add(data)
    return later, hashes


#: Where the characters of a window start: eight bytes each, the last one reaching back over the one before.
_CHARACTERS = (*range(0, LENGTH - 8, 8), LENGTH - 8)


def _characters(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place."""
    return np.ndarray(max(0, len(raw) - 7), "<u8", np.ascontiguousarray(raw), strides=(1,))


def _window_keys(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers that equal windows have in common, from characters at both ends and in the middle."""
    characters, keys = _characters(raw), np.zeros(len(starts), np.uint64)
    for depth in (0, LENGTH // 2, LENGTH - 8):
        keys = mix(keys + np.uint64(_BASE) ^ characters[starts + depth])
    return keys


def multikey_copies(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows equal one listed before them.

    Multikey quicksort over eight-byte characters, all ranges of one depth together: a range of ties is sorted by
    its next character and falls into smaller ranges; single windows are done, and a range that shares its next
    character moves on unsorted.
    """
    later = np.zeros(len(starts), bool)
    order = np.arange(len(starts))
    head = np.zeros(len(starts), np.int64)  # for each window still tied, where its range begins in ``order``
    characters = _characters(raw)
    for depth in _CHARACTERS:
        if not len(order):
            break
        value = characters[starts[order] + depth].byteswap()
        mixed = np.zeros(len(order), bool)
        mixed[head[value != value[head]]] = True
        moved = np.flatnonzero(mixed[head])
        if len(moved) == len(order) and not head.any():
            by = np.argsort(value)
        else:
            by = np.lexsort((value[moved], head[moved]))
        order[moved], value[moved] = order[moved][by], value[moved][by]
        first = np.ones(len(order), bool)
        first[1:] = (head[1:] != head[:-1]) | (value[1:] != value[:-1])
        begin = np.flatnonzero(first)
        count = np.diff(np.append(begin, len(order)))
        tied = np.repeat(count > 1, count)
        order, count = order[tied], count[count > 1]
        head = np.repeat(np.cumsum(count) - count, count)
    if len(order):
        later[order] = True
        later[np.minimum.reduceat(order, np.unique(head))] = False
    return later


_META = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("sent", "u1"), ("offset", "<i8"), ("n", "<i8"), ("sha", "V32")])


def _scan(bits: int):
    def run(batches):
        part, given = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        meta: list[tuple] = []
        seen: set[bytes] = set()
        size = 0

        def flush():
            base = (part << 36) + given
            columns = [np.concatenate(c) for c in zip(*held)] if held else [np.empty(0, np.uint64)] * 3
            rows = [(fr.META, base, (7 * part + given) % (1 << bits), np.array(meta, _META).tobytes())]
            rows += fr.send(columns[0], columns[1], base, bits, columns[2])
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                names=["kind", "base", "frag", "payload"],
            )

        for batch in batches:
            ids, shas = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            raw, starts = text_bytes(batch.column(1))
            for k, doc_id in enumerate(ids):
                own, sha = raw[starts[k] : starts[k + 1]], shas[k]
                sent = sha not in seen
                seen.add(sha)
                for offset in range(0, max(1, len(own)), PIECE):
                    piece = own[offset : offset + PIECE + LENGTH - 1]
                    if sent and len(piece) >= LENGTH:
                        tokens, first, count = leaders(piece)
                        held.append((tokens, np.full(len(tokens), len(meta)), (first << 7) | count))
                        size += len(tokens)
                    meta.append((doc_id or 0, doc_id is not None, sent, offset, len(own), sha))
                    if size >= fr.CHUNK_TOKENS or len(meta) >= fr.CHUNK_DOCS:
                        yield flush()
                        given += len(meta)
                        held, meta, size = [], [], 0
                        seen = set()
        if meta:
            yield flush()
        held, meta, seen = [], [], set()
        release_memory()

    return run


PIECES = (
    "uid long, doc_id long, sent boolean, offset long, n long, sha binary, tokens array<long>, places array<long>"
)


def _gather(bits: int):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        meta = np.frombuffer(group[group.kind == fr.META].payload.iloc[0], _META)
        blocks = [fr.unpack(p, f, bits) for k, p, f in zip(group.kind, group.payload, group.frag) if k == fr.SHARED]
        tokens = np.concatenate([b[0] for b in blocks]) if blocks else np.empty(0, np.uint64)
        docs = np.concatenate([b[1] for b in blocks]).astype(np.int64) if blocks else np.empty(0, np.int64)
        places = np.concatenate([b[2] for b in blocks]).astype(np.int64) if blocks else np.empty(0, np.int64)
        order = np.lexsort((places, docs))
        tokens, places = tokens[order].view(np.int64), places[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(meta)))])
        cut = list(zip(ends[:-1], ends[1:]))
        return pd.DataFrame(
            {
                "uid": int(key[0]) + np.arange(len(meta)),
                "doc_id": pd.Series(meta["doc_id"].astype(np.int64), dtype="Int64").mask(meta["known"] == 0),
                "sent": meta["sent"] == 1,
                "offset": meta["offset"].astype(np.int64),
                "n": meta["n"].astype(np.int64),
                "sha": [x.tobytes() for x in meta["sha"]],
                "tokens": [tokens[a:b] for a, b in cut],
                "places": [places[a:b] for a, b in cut],
            }
        )

    return run


BUCKETED = "kind int, bucket int, payload binary"
_ENTRY = np.dtype([("doc", "<i8"), ("uid", "<i8"), ("start", "<i8"), ("count", "<i4"), ("size", "<i4")])
_ROW = np.dtype([("doc", "<i8"), ("uid", "<i8"), ("start", "<i8"), ("a", "<u8"), ("b", "<u8")])
SUFFIXES, WINDOWS, REMOVED = 0, 1, 2
_NO_ID = -(2**63)


def _expand(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the entries of a chunk: its entry, and its place from the entry's first window."""
    count = entries["count"]
    owner = np.repeat(np.arange(len(entries), dtype=np.int32), count)
    before = np.repeat(np.cumsum(count, dtype=np.int32) - count, count)
    return owner, (np.arange(len(owner), dtype=np.int32) - before).astype(np.uint8)


def _spans(keys: np.ndarray, starts: np.ndarray) -> list[tuple[int, list[int], list[int]]]:
    """Merged byte spans of removed windows by uid."""
    order = np.lexsort((starts, keys))
    keys, starts = keys[order], starts[order]
    out = []
    begin, count = runs(keys)
    for a, n in zip(begin.tolist(), count.tolist()):
        own = starts[a : a + n]
        new = np.concatenate([[True], own[1:] > own[:-1] + LENGTH])
        last = np.concatenate([new[1:], [True]])
        out.append((int(keys[a]), own[new].tolist(), (own[last] + LENGTH).tolist()))
    return out


def _removed_rows(keys: np.ndarray, starts: np.ndarray) -> bytes:
    return np.array([(0, k, a, 0, b) for k, s, e in _spans(keys, starts) for a, b in zip(s, e)], _ROW).tobytes()


def _compare(splitters: np.ndarray, hot: np.ndarray):
    """Map side: compare a chunk of documents, send on what the chunk leaves open."""
    buckets = len(splitters) + 1

    def resolve(chunk):
        """chunk: (doc key, uid, first byte of the piece in its document, bytes, tokens, places) per piece."""
        chunk.sort(key=lambda x: (x[0], x[1]))
        raw = np.concatenate([c[3] for c in chunk])
        shift = np.cumsum([0, *(len(c[3]) for c in chunk)])[:-1]
        sizes = [len(c[5]) for c in chunk]
        which = np.repeat(np.arange(len(chunk)), sizes)
        places = np.concatenate([c[5] for c in chunk])
        tokens = np.concatenate([c[4] for c in chunk])
        entries = np.zeros(len(places), _ENTRY)
        entries["start"], entries["count"] = places >> 7, places & 127
        owner, step = _expand(entries)
        at = (entries["start"] + shift[which])[owner] + step
        later, hashes = later_copies(raw, at)
        doc = np.array([c[0] for c in chunk], np.int64)
        uid = np.array([c[1] for c in chunk], np.int64)
        origin = np.array([c[2] for c in chunk], np.int64)
        begins = entries["start"] + origin[which]
        removed = np.flatnonzero(later)
        for a in range(0, len(removed), AT_ONCE):
            pick = removed[a : a + AT_ONCE]
            yield REMOVED, 0, _removed_rows(uid[which[owner[pick]]], begins[owner[pick]] + step[pick])
        left = ~later
        is_hot = np.isin(tokens, hot)
        single = left & is_hot[owner]
        if single.any():
            rows = np.zeros(int(single.sum()), _ROW)
            o = owner[single]
            w = which[o]
            rows["doc"], rows["uid"], rows["start"] = doc[w], uid[w], begins[o] + step[single]
            rows["a"] = hashes[single]
            views = sliding_window_view(raw, LENGTH)
            rows["b"] = [
                int.from_bytes(hashlib.blake2b(views[i].tobytes(), digest_size=8).digest(), "little")
                for i in at[single].tolist()
            ]
            bucket = (rows["a"] % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket).tolist():
                yield WINDOWS, b, rows[bucket == b].tobytes()
        keep = left & ~is_hot[owner]
        if keep.any():
            # Of each suffix the span from its first to its last open window.
            o, s = owner[keep], step[keep]
            begin, many = runs(o)
            low, high = s[begin].astype(np.int64), s[begin + many - 1].astype(np.int64)
            e = entries[o[begin]].copy()
            w = which[o[begin]]
            e["doc"], e["uid"] = doc[w], uid[w]
            here = e["start"] + low + shift[w]
            e["start"] += low + origin[w]
            e["count"] = high - low + 1
            e["size"] = e["count"] + LENGTH - 1
            bucket = np.searchsorted(splitters, tokens[o[begin]], side="right")
            pack = zstandard.ZstdCompressor(level=1).compress
            for b in np.unique(bucket).tolist():
                pick = np.flatnonzero(bucket == b)
                data = b"".join(raw[here[i] : here[i] + e["size"][i]].tobytes() for i in pick.tolist())
                yield SUFFIXES, b, len(pick).to_bytes(4, "little") + pack(e[pick].tobytes() + data)

    def run(batches):
        chunk, size = [], 0
        for batch in batches:
            raw, starts = text_bytes(batch.column("text"))
            docs = zip(*(batch.column(n).to_pylist() for n in ("doc_id", "pieces")), strict=True)
            for k, (doc_id, pieces) in enumerate(docs):
                own = raw[starts[k] : starts[k + 1]]
                for p in pieces:
                    part = own[p["offset"] : p["offset"] + PIECE + LENGTH - 1]
                    key = _NO_ID if doc_id is None else doc_id
                    tokens = np.array(p["tokens"], np.int64).view(np.uint64)
                    chunk.append((key, p["uid"], p["offset"], part, tokens, np.array(p["places"], np.int64)))
                    size += len(part)
                    if size >= CHUNK_TEXT:
                        yield _batch(resolve(chunk))
                        chunk, size = [], 0
        if chunk:
            yield _batch(resolve(chunk))
        chunk = []
        release_memory()

    return run


def _batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    columns = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))],
        names=["kind", "bucket", "payload"],
    )


SPANS = "uid long, starts array<long>, ends array<long>"


def _bucket(key, group: pd.DataFrame) -> pd.DataFrame:
    """All open suffixes of one range: the windows that come after an equal one."""
    out: list[tuple] = []
    unpack = zstandard.ZstdDecompressor().decompress
    entries, data = [], []
    for payload in group[group.kind == SUFFIXES].payload:
        n, plain = int.from_bytes(payload[:4], "little"), unpack(payload[4:])
        entries.append(np.frombuffer(plain[: n * _ENTRY.itemsize], _ENTRY))
        data.append(np.frombuffer(plain[n * _ENTRY.itemsize :], np.uint8))
    if entries:
        e, raw = np.concatenate(entries), np.concatenate(data)
        del entries, data
        at = np.cumsum(e["size"].astype(np.int64)) - e["size"]
        # The suffixes in the order of documents, so that order among equal windows is that of positions.
        order = np.lexsort((e["start"], e["uid"], e["doc"]))
        e, at = e[order], at[order]
        ends = np.cumsum(e["count"].astype(np.int64))
        begins = ends - e["count"]
        later = np.zeros(int(ends[-1]), bool)

        def windows(numbers):
            owner = np.searchsorted(ends, numbers, side="right")
            return owner, numbers - begins[owner]

        def starts(numbers):
            owner, step = windows(numbers)
            return at[owner] + step

        for own in shares(len(later), lambda a, b: _window_keys(raw, starts(np.arange(a, b)))):
            later[own] = multikey_copies(raw, starts(own))
        for a in range(0, len(later), AT_ONCE):
            owner, step = windows(a + np.flatnonzero(later[a : a + AT_ONCE]))
            out += _spans(e["uid"][owner], e["start"][owner] + step)
        del raw, later
    windows = [np.frombuffer(p, _ROW) for p in group[group.kind == WINDOWS].payload]
    if windows:
        w = np.concatenate(windows)
        w = w[np.lexsort((w["start"], w["uid"], w["doc"], w["b"], w["a"]))]
        later = np.zeros(len(w), bool)
        later[1:] = (w["a"][1:] == w["a"][:-1]) & (w["b"][1:] == w["b"][:-1])
        out += _spans(w["uid"][later], w["start"][later])
    for payload in group[group.kind == REMOVED].payload:
        rows = np.frombuffer(payload, _ROW)
        begin, count = runs(rows["uid"])
        for a, n in zip(begin.tolist(), count.tolist()):
            part = rows[a : a + n]
            out.append((int(part["uid"][0]), part["start"].tolist(), part["b"].astype(np.int64).tolist()))
    release_memory()
    return pd.DataFrame(out, columns=["uid", "starts", "ends"])


def _cut(batches):
    for batch in batches:
        kept, n_removed, n_spans, n_bytes = [], [], [], []
        raw, at = text_bytes(batch.column("text"))
        columns = (batch.column(n).to_pylist() for n in ("copy", "starts", "ends"))
        for k, (copy, starts, ends) in enumerate(zip(*columns, strict=True)):
            own = raw[at[k] : at[k + 1]]
            if copy and len(own) >= LENGTH:
                starts, ends = [0], [len(own)]
            parts, here, spans = [], 0, 0
            for a, b in sorted(zip(starts or (), ends or ())):
                if a > here or not spans:
                    spans += 1
                    parts.append(own[here:a])
                here = max(here, b)
            parts.append(own[here:])
            left = b"".join(p.tobytes() for p in parts)
            kept.append(left)
            n_bytes.append(len(own))
            n_removed.append(len(own) - len(left))
            n_spans.append(spans)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Removed is every byte covered by a ``LENGTH``-byte string that also starts earlier: in a document with a
    smaller id (null ids first), or earlier in the same one.  A null text is empty; a text shorter than
    ``LENGTH`` loses nothing.  Rows that repeat both id and text count as one document and all get its result.
    Columns besides doc_id and text are ignored.  An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of("text").alias("text"),
        F.unhex(F.sha2(text_of("text").cast("binary"), 256)).alias("sha"),
    )
    bits = fr.fragment_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 16 << 20)
    sent = rows.mapInArrow(_scan(bits), fr.SCHEMA)
    answers = sent.groupBy("frag").applyInPandas(fr.answer(bits), fr.SCHEMA)
    pieces = materialize(answers.groupBy("base").applyInPandas(_gather(bits), PIECES), "pieces")

    # Of equal texts one stands for all, at the place of the first.
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    texts = pieces.groupBy("sha").agg(
        F.min(order)["doc_id"].alias("first_id"),
        F.min(F.when(F.col("sent") & (F.col("offset") == 0), F.col("uid"))).alias("first_uid"),
        F.count_distinct(F.coalesce("doc_id", F.lit(_NO_ID))).alias("ids"),
    )
    texts = materialize(texts, "texts")
    lead = pieces.where(F.col("sent") & (F.size("tokens") > 0)).join(texts, "sha")
    # The pieces of a long text follow each other, all sent by one task.
    span = F.ceil(F.col("n") / PIECE)
    lead = lead.where((F.col("uid") >= F.col("first_uid")) & (F.col("uid") < F.col("first_uid") + span)).select(
        "sha", "first_id", "first_uid", F.struct("uid", "offset", "tokens", "places").alias("piece")
    )
    lead = materialize(lead, "suffixes")

    tokens = lead.select(F.explode("piece.tokens").alias("token"))
    counts = tokens.groupBy("token").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    many = max(100, min(total // HOT, SUFFIXES_OF_BUCKET))
    hot = [r[0] for r in counts.where(F.col("count") > many).select("token").collect()]
    hot = np.array(sorted(hot), np.int64).view(np.uint64)
    n_buckets = max(64, 2 * partitions(spark), total // SUFFIXES_OF_BUCKET)
    at = [k / n_buckets for k in range(1, n_buckets)]
    found = tokens.agg(F.percentile_approx("token", F.lit(at), F.lit(20 * n_buckets)).alias("q")).first()["q"] or []
    splitters = np.array(sorted(set(found)), np.int64).view(np.uint64)

    grouped = lead.groupBy("sha", "first_id").agg(F.collect_list("piece").alias("pieces"))
    grouped = grouped.select(F.col("sha").alias("its_sha"), "first_id", "pieces")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("sha") == F.col("its_sha"))
    given = rows.join(grouped, same).select("doc_id", "text", "pieces")
    open_rows = given.mapInArrow(_compare(splitters, hot), BUCKETED)
    dealt = open_rows.withColumn("bucket", F.when(F.col("kind") == REMOVED, F.crc32("payload") % n_buckets).otherwise(
        F.col("bucket")).cast("int"))
    spans = dealt.groupBy("bucket").applyInPandas(_bucket, SPANS)
    ids = lead.select(F.col("piece.uid").alias("uid"), F.col("sha").alias("its_sha"), F.col("first_id").alias("its_id"))
    cuts = spans.join(ids, "uid").groupBy("its_sha", "its_id").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")
    )
    copies = pieces.where("offset = 0").join(texts.where("ids > 1").select("sha", "first_id"), "sha").where(
        ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    ).select(F.col("sha").alias("its_sha"), F.col("doc_id").alias("its_id")).distinct()
    verdicts = cuts.withColumn("copy", F.lit(False)).unionByName(
        copies.withColumn("copy", F.lit(True)), allowMissingColumns=True
    )
    verdicts = materialize(verdicts, "verdicts")
    mine = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("sha") == F.col("its_sha"))
    return rows.join(verdicts, mine, "left").select("doc_id", "text", "copy", "starts", "ends").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )

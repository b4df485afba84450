"""Finding tokens that several documents share, fragment by fragment of their order.

Used where 64-bit tokens of all documents have to meet without a row for each: a map task combines the tokens of a
bounded chunk of documents, cuts their order into fragments (ranges of the leading bits) and sends each fragment
one packed block.  A token that the chunk itself holds twice is known to be shared; only one marker of it travels,
so a token in a third of all documents reaches its fragment as one entry for each chunk.  The fragment's task
answers each chunk with its entries that are shared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from flowlens.llm.common import runs

#: Documents and tokens to a chunk; documents are counted by 16-bit numbers, the last of which marks.
CHUNK_DOCS, CHUNK_TOKENS = 65_000, 2_000_000
MARK = 65_535
#: Bytes of a token that travel besides its fragment.
LOW = 6
SCHEMA = "kind int, base long, frag int, payload binary"
META, SINGLE, SHARED = 0, 1, 2


def fragment_bits(total_bytes: int, per_fragment: int = 12 << 20) -> int:
    """Bits of the fragment number: fragments follow the size of the input, 64 at least."""
    return min(16, max(6, int(np.ceil(np.log2(max(1, total_bytes) / per_fragment)))))


def _low(tokens: np.ndarray, bits: int) -> bytes:
    """The ``LOW`` bytes below the fragment bits."""
    kept = (tokens << np.uint64(bits)) >> np.uint64(64 - 8 * LOW)
    return kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW].tobytes()


def _whole(raw: bytes, frag: int, bits: int) -> np.ndarray:
    wide = np.zeros((len(raw) // LOW, 8), np.uint8)
    wide[:, :LOW] = np.frombuffer(raw, np.uint8).reshape(-1, LOW)
    return (np.uint64(frag) << np.uint64(8 * LOW)) | wide.view("<u8").ravel()


def send(tokens: np.ndarray, docs: np.ndarray, base: int, bits: int, extra: np.ndarray | None = None):
    """Blocks of one chunk: (kind, base, fragment, payload).

    ``tokens`` may repeat; ``docs`` says whose each one is.  ``extra`` (32-bit) travels with each token.
    """
    extra = np.zeros(len(tokens), np.uint32) if extra is None else extra.astype(np.uint32)
    order = np.argsort(tokens, kind="stable")
    tokens, docs, extra = tokens[order], docs[order].astype(np.uint16), extra[order]
    # Equal as far as they travel is equal.
    tokens = (tokens >> np.uint64(64 - bits - 8 * LOW)) << np.uint64(64 - bits - 8 * LOW)
    start, count = runs(tokens)
    several = np.repeat(count > 1, count)
    first = np.zeros(len(tokens), bool)
    first[start] = True
    travels = ~several | first
    sent, who, more = tokens[travels], np.where(several, MARK, docs)[travels].astype(np.uint16), extra[travels]
    frag = (sent >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(frag, np.arange((1 << bits) + 1))
    has_extra = bool(extra.any())
    for f in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[f], cuts[f + 1]
        tail = more[a:b].tobytes() if has_extra else b""
        yield SINGLE, base, f, _block(_low(sent[a:b], bits), who[a:b], tail)
    own, who, more = tokens[several], docs[several], extra[several]
    frag = (own >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(frag, np.arange((1 << bits) + 1))
    for f in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[f], cuts[f + 1]
        tail = more[a:b].tobytes() if has_extra else b""
        yield SHARED, base, f, _block(_low(own[a:b], bits), who[a:b], tail)


def _block(low: bytes, docs: np.ndarray, tail: bytes) -> bytes:
    return len(docs).to_bytes(4, "little") + low + docs.tobytes() + tail


def unpack(payload: bytes, frag: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (fragment and low bytes as one number), documents, extras of a block."""
    n = int.from_bytes(payload[:4], "little")
    a, b = 4 + n * LOW, 4 + n * (LOW + 2)
    tail = np.frombuffer(payload[b:], np.uint32) if len(payload) > b else np.zeros(n, np.uint32)
    return _whole(payload[4:a], frag, bits), np.frombuffer(payload[a:b], np.uint16), tail


def answer(bits: int):
    """For groupBy("frag").applyInPandas: the blocks of a fragment in, what each chunk shares with others out."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        passed = group[group.kind != SINGLE]
        singles = group[group.kind == SINGLE].sort_values("base")
        out = [passed]
        if len(singles) > 1:
            frag = int(singles.frag.iloc[0])
            blocks = [unpack(p, frag, bits) for p in singles.payload]
            tokens = np.concatenate([b[0] for b in blocks])
            sizes = [len(b[0]) for b in blocks]
            order = np.argsort(tokens, kind="stable")
            _, count = runs(tokens[order])
            shared = np.empty(len(tokens), bool)
            shared[order] = np.repeat(count > 1, count)
            rows, at = [], 0
            for base, size, (own, docs, extra), raw in zip(singles.base, sizes, blocks, singles.payload, strict=True):
                take = shared[at : at + size] & (docs != MARK)
                at += size
                if take.any():
                    low = np.frombuffer(raw[4 : 4 + size * LOW], np.uint8).reshape(-1, LOW)[take].tobytes()
                    tail = extra[take].tobytes() if extra.any() else b""
                    rows.append((SHARED, base, frag, _block(low, docs[take], tail)))
            if rows:
                out.append(pd.DataFrame(rows, columns=["kind", "base", "frag", "payload"]))
        return pd.concat(out, ignore_index=True)

    return run

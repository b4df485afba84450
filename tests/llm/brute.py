"""Plain versions of the operators over lists of (id, text), for comparison."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def components(docs: list[tuple[int, str | None]], shingle: int = 5) -> dict[int, tuple[int, int]]:
    """op4, op13: id -> (set size, smallest id reachable), all pairs compared."""
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        last = len(w) - shingle
        sets[i] = {tuple(w[k : k + shingle]) for k in range(last + 1)} if last >= 0 else ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common: dict[tuple[int, int], int] = defaultdict(int)
    for held in holders.values():
        for a in range(len(held)):
            for b in range(a):
                common[held[b], held[a]] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in common.items():
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """op8: id -> (bytes, removed, spans, sha256 of the rest)."""
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return out


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """op3: (start, kind, end) of the base kinds, in order."""
    text = text or ""
    assign = re.compile(
        r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])"
        r"|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    )
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def edited(docs: list[tuple[int, str | None]]) -> dict[int, str]:
    """op2: id -> text with its last half replaced by the beginning of the next one's."""
    rows = sorted((i, t or "") for i, t in docs)
    return {
        i: t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2] for k, (i, t) in enumerate(rows)
    }


UNSPACED = (
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029),
    (0x3038, 0x303B), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)


def winnow_tokens(text: str) -> list[str]:
    """op2: words of at most 16 characters, all other characters alone."""
    out = []
    for run in re.findall(r"[^ \t\n\x0b\f\r]+", text):
        word = ""
        for c in [*run, None]:
            if c is not None and not any(a <= ord(c) <= b for a, b in UNSPACED):
                word += c
                continue
            out += [word] if 0 < len(word) <= 16 else list(word)
            out += [] if c is None else [c]
            word = ""
    return out


def winnowed(text: str, token_hash, k: int = 5, window: int = 6) -> list[int]:
    """op2: the positions chosen; hashes of grams are summed up anew at each place."""
    h = [token_hash[t] % (2**31 - 1) for t in winnow_tokens(text)]
    if len(h) < k:
        return [0] if h else []
    grams = []
    for i in range(len(h) - k + 1):
        g = 0
        for x in h[i : i + k]:
            g = (g * 1_000_003 + x) % (2**31 - 1)
        grams.append(g)
    spans = [range(j, j + window) for j in range(len(grams) - window + 1)] or [range(len(grams))]
    return sorted({min(span, key=lambda i: (grams[i], -i)) for span in spans})


def token_pieces(ids: list[int], length: int = 1024) -> list[tuple[int, int, int]]:
    """op10: (start, length, crc32) of the pieces of one document's ids, end token included."""
    first = len(ids) if len(ids) <= length else len(ids) % length or length
    cuts = [0, *range(first, len(ids) + 1, length)]
    return [
        (a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for a, b in zip(cuts, cuts[1:])
    ]


_DOWN = {i: i + 32 for i in range(65, 91)}


def spelling(docs: list[tuple[int | None, str | None]]) -> dict[str, tuple]:
    """op11: word -> (form, root, n, n_near, form_n); near words by deleting each letter, no letter counts."""
    counts: dict[str, int] = defaultdict(int)
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(_DOWN)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near: dict[str, set[str]] = {w: set() for w in n}
    holes = defaultdict(list)
    for w in n:
        for k in range(len(w)):
            rest = w[:k] + w[k + 1 :]
            holes[k, rest].append(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for held in holes.values():
        for a in held:
            near[a].update(b for b in held if b != a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def ranked(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], k: int = 50) -> set[tuple]:
    """op12: (item, rank, doc, score), every document scored."""
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    held = {i: Counter(term.findall((t or "").translate(_DOWN))) for i, t in docs}
    held = {i: c for i, c in held.items() if c}
    total, df = sum(sum(c.values()) for c in held.values()), Counter(t for c in held.values() for t in c)
    out = set()
    for item, text in items:
        scores = []
        for i, c in held.items():
            m = 50 + (50 * sum(c.values()) * len(held)) // total
            score = 0
            for t in set(term.findall((text or "").translate(_DOWN))) & c.keys():
                w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, i))
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out

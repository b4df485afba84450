"""Spelling variants, ranked search and MinHash duplicates against plain versions."""

from __future__ import annotations

import re

import numpy as np
import pytest

from flowlens.llm import common, lexical_search, minhash, spelling
from tests.llm import brute
from tests.llm.test_operators import DOCS, by_id, docs, nothing, prose  # noqa: F401

LETTERS = "abcdeéñ"


def rare_words(seed: int, n: int) -> list[str]:
    """Words of 7 to 9 of few letters, some of them one edit of another, repeated unevenly."""
    rng = np.random.default_rng(seed)
    made = ["".join(rng.choice(list(LETTERS), rng.integers(7, 10))) for _ in range(n)]
    for w in made[: n // 2]:
        k = int(rng.integers(0, len(w)))
        made.append(w[:k] + "x" + w[k + int(rng.integers(0, 2)) :])
    return [w for w in made for _ in range(int(rng.choice([1, 2, 3, 40])))]


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling(spark, docs, nothing):  # noqa: F811
    words = rare_words(1, 300)
    rows = [(i, " ".join(words[i::7])) for i in range(7)]
    rows += [(7, None), (None, " ".join(words[:90])), (8, "Zzzzzzzz " * 30 + "zzzzzzz1zzzzzzzzz! " * 2), (8, "É" * 5000 + " " + "É" * 5000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.spelling(rows)
    assert spelled(spelling.variants(table)) == want
    assert sum(v[0] is not None for v in want.values()) > 20 and sum(v[3] for v in want.values()) > 100
    assert spelled(spelling.variants(docs)) == brute.spelling(DOCS)
    twice = docs.unionByName(docs)
    assert spelled(spelling.variants(twice)) == brute.spelling(DOCS + DOCS)
    assert spelling.variants(nothing).collect() == []


def test_small_blocks_and_other_groups_find_the_same(spark, monkeypatch):
    words = sorted(set(rare_words(2, 200)))
    table = spark.createDataFrame([(w, k + 2) for k, w in enumerate(words)], "word string, n long")
    want = None
    for block, groups in ((2048, 2), (3, 2), (5, 7)):
        monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
        got = sorted(tuple(r) for r in spelling.near_words(table, groups).collect())
        assert got and len(got) == len(set(got)) and (want is None or got == want)
        want = got
    assert [(a, b) for a, b, _ in want] == sorted((b, a) for a, b, _ in want)


def test_near_pairs_of_blocks():
    rng = np.random.default_rng(3)
    for wide in (7, 8):
        one = np.unique(rng.integers(97, 100, (80, 7), dtype=np.uint8), axis=0)
        other = np.unique(rng.integers(97, 100, (80, wide), dtype=np.uint8), axis=0)

        def edit(a: bytes, b: bytes) -> bool:
            if len(a) == len(b):
                return sum(x != y for x, y in zip(a, b)) == 1
            return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

        want = {(i, j) for i, a in enumerate(one) for j, b in enumerate(other) if edit(a.tobytes(), b.tobytes())}
        assert set(zip(*(x.tolist() for x in spelling.near_pairs(one, other)))) == want and want


def test_texts_in_pieces():
    text = "abc def  ghi" * 50 + "x" * 70 + " y"
    parts = list(common.pieces(text, re.compile(" "), 10))
    assert "".join(parts) == text and len(parts) > 20 and all(len(p) < 100 for p in parts)
    assert list(common.pieces("", re.compile(" "))) == [""]
    assert list(common.pieces("x" * 30, re.compile(" "), 10)) == ["x" * 30]


ITEMS = [
    (1, "alpha beta ALPHA theta"), (2, None), (3, ""), (4, "no such words"), (5, "漢 one é漢🙂"), (6, prose(9, 40)),
    (6, prose(9, 40)), (7, "x" * 100),
]


def hits(df):
    rows = [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_ranked_search(spark, docs, nothing, monkeypatch):  # noqa: F811
    items = spark.createDataFrame(ITEMS, "item_id int, text string").selectExpr("*", "1 AS doc_id", "2 AS score")
    want = brute.ranked(DOCS, dict(ITEMS).items(), 5)
    assert hits(lexical_search.rank_documents(docs, items, 5)) == want and {w[0] for w in want} == {1, 5, 6, 7}
    full = lexical_search.build_index(docs)
    assert hits(lexical_search.search(full, items, 5)) == want
    assert lexical_search.item_terms(items, 3) is None
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 3)
    assert hits(lexical_search.rank_documents(docs, items, 5)) == want
    assert hits(lexical_search.rank_documents(nothing, items)) == set()
    assert hits(lexical_search.rank_documents(docs, items.where("item_id < 0"))) == set()


def test_ties_and_early_end(spark):
    rows = [(i, f"common w{i % 50} " * (1 + i % 4)) for i in range(600)] + [(None, "common w1 ")]
    items = [(1, "common w1 w2"), (2, "w7")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = hits(lexical_search.rank_documents(table, spark.createDataFrame(items, "item_id long, text string"), 20))
    want = brute.ranked([(10**9 if i is None else i, t) for i, t in rows], items, 20)
    assert got == {(a, b, None if c == 10**9 else c, d) for a, b, c, d in want}


def test_minhash_components(spark, docs, nothing):  # noqa: F811
    got = by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept")
    want = brute.components(DOCS, 2)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert minhash.near_duplicates(nothing).count() == 0
    rows = [(None, "some words of a text"), (None, "some words of a text"), (4, "some words of a text"), (3, "some words of a text"), (None, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("3", "3", True), ("4", "3", False), ("None", "3", False), ("None", "3", False), ("None", "None", True),
    ]


def edited_copies(count: int, seed: int) -> list[tuple[int, str]]:
    """Copies of one text with a few words replaced, so that links form chains, and texts that share half of it."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(count):
        words = list(base)
        for k in rng.choice(60, rng.integers(0, 5), replace=False):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words if i % 3 else words[:30] + [f"else{i % 7}x{k}" for k in range(18)])))
    return rows


def test_minhash_on_groups_of_edited_copies(spark, monkeypatch):
    rows = edited_copies(150, 1)
    want = brute.components(rows, 2)
    assert 5 < len({c for _, c in want.values()}) < 60
    monkeypatch.setattr(minhash, "BLOCK", 16)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for rounds in (2, 0):  # without hubs every pair comes from the blocks
        monkeypatch.setattr(minhash, "HUB_ROUNDS", rounds)
        assert by_id(minhash.near_duplicates(table), "n_shingles", "component_id") == want


def test_signatures_and_posterior():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 3, 40_000, 70_000, 2)]
    counts = np.array([len(s) for s in sets])
    got = minhash.signatures(np.concatenate(sets), counts)
    for row, s in zip(got, sets):
        for h in (0, 7, minhash.HASHES - 1):
            least = min((int(x) * int(minhash._FACTOR[h]) + int(minhash._SHIFT[h])) % 2**64 for x in s)
            assert int(row[h]) == least >> 32
    agree = np.array(minhash.least_agreements())
    assert (np.diff(agree) > 0).all() and agree[-1] < 0.7 * minhash.HASHES
    # A pair that agrees in just enough places of each batch stays; one fewer in the first batch and it goes.
    one = np.zeros((2, minhash.HASHES), np.uint32)
    other = np.ones_like(one)
    for k, step in enumerate(np.diff([0, *agree])):
        other[:, k * minhash.BATCH : k * minhash.BATCH + step] = 0
    other[1, 0] = 1
    assert minhash.unpruned(one, other).tolist() == [0]


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_estimates_follow_the_similarity(share):
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    common_part = int(2000 * share)
    rest = 2000 - common_part
    one = np.unique(pool[: common_part + rest // 2])
    other = np.unique(np.concatenate([pool[:common_part], pool[common_part + rest // 2 :]]))
    a, b = minhash.signatures(np.concatenate([one, other]), np.array([len(one), len(other)]))
    assert abs((a == b).mean() - share) < 0.1

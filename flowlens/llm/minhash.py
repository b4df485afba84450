"""MinHash near-duplicate detection with sequential Bayesian verification.

Equal shingle sets are one class.  Each class has a signature of ``HASHES`` minima; bands of ``ROWS`` minima are its
buckets, and classes that share a bucket are candidates.  The signatures of a candidate pair are compared batch by
batch: after n minima of which m agree, the posterior of the similarity (uniform prior) is a Beta(m + 1, n - m + 1)
distribution, and the pair is pruned as soon as the similarity reaches the threshold with a probability below
``MISS``.  What survives all batches is verified on the full sets.

A bucket may hold a third of all classes, so its pairs are not listed.  First every class of a bucket is compared
with one hub of it, the class that meets the most others; classes found connected are not compared again.  In buckets
that then still hold unconnected classes all pairs of these are compared inside tasks, a block of bounded size
against another, and only pairs that the posterior does not prune come out.

Two sets of a similarity of 0.8 share no bucket with a probability of 3e-6, more similar ones with less.
"""

from __future__ import annotations

from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import mix, prepare, text_bytes, text_of
from flowlens.llm.ngram_join import link_components, words
from flowlens.session import materialize

SHINGLE, THRESHOLD = 2, 80
#: Bands and minima to a band.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Minima to a batch of the comparison, and the chosen probability of pruning a pair that links.
BATCH, MISS = 32, 1e-6
#: Rounds of comparison with a hub.
HUB_ROUNDS = 2
#: Classes and shingles to a block of a bucket.
BLOCK, BLOCK_TOKENS = 512, 1 << 20
#: Bytes of text a task works on at a time, shingles hashed at a time.
TEXT_BLOCK, HASHED = 2 << 20, 1 << 15

_TURN = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_FACTOR = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFT = mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(1 << 40))


def shingle_sets(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and how many each row has."""
    hashes, count = words(raw, rows)
    owner = np.repeat(np.arange(len(count)), count)
    inside = owner[1:] == owner[:-1]
    pairs = mix(hashes[:-1] * _TURN[0] + hashes[1:] * _TURN[1])[inside] if len(hashes) else hashes
    alone = count == 1
    single = mix(hashes[(np.cumsum(count) - count)[alone]] + np.uint64(1))
    tokens = np.concatenate([pairs, single])
    docs = np.concatenate([owner[:-1][inside], np.flatnonzero(alone)])
    order = np.lexsort((tokens, docs))
    tokens, docs = tokens[order], docs[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (docs[1:] != docs[:-1])
    return tokens[fresh], np.bincount(docs[fresh], minlength=len(count))


def signatures(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minima of each of these sets, none of them empty: the upper halves, one row per set."""
    out = np.full((len(counts), HASHES), np.iinfo(np.uint64).max, np.uint64)
    ends = np.cumsum(counts)
    begins = ends - counts
    a = 0
    while a < len(tokens):  # a block may begin and end inside a set
        b = min(len(tokens), a + HASHED)
        lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(begins, b, side="left")
        starts = np.maximum(begins[lo:hi], a) - a
        part, buffer = tokens[a:b], np.empty(b - a, np.uint64)
        for h in range(HASHES):
            np.multiply(part, _FACTOR[h], out=buffer)
            np.add(buffer, _SHIFT[h], out=buffer)
            out[lo:hi, h] = np.minimum(out[lo:hi, h], np.minimum.reduceat(buffer, starts))
        a = b
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row."""
    bands = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), bands.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix(keys ^ (bands[:, :, r] + np.uint64(0x9E3779B97F4A7C15)))
    return keys.view(np.int64)


def least_agreements() -> list[int]:
    """For each batch boundary n the fewest agreeing minima with which a pair goes on.

    With m of n agreeing the posterior probability of a similarity of t or more is that of at most m successes in
    n + 1 trials of probability t.
    """
    t, out = THRESHOLD / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= MISS:
                break
            m += 1
        out.append(m)
    return out


_LEAST = least_agreements()


def unpruned(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (row by row) the posterior never prunes."""
    alive, agree = np.arange(len(one)), np.zeros(len(one), np.int64)
    for k, least in enumerate(_LEAST):
        batch = slice(k * BATCH, (k + 1) * BATCH)
        agree = agree + (one[alive, batch] == other[alive, batch]).sum(axis=1)
        stay = agree >= least
        alive, agree = alive[stay], agree[stay]
    return alive


DOCUMENTS = "uid long, row long, again long, doc_id long, n long, digest binary, bands array<long>"
SETS = "uid long, tokens array<long>, signature binary"


def _blocks_of(batches):
    """Batches of (..., text), cut into blocks of about ``TEXT_BLOCK``, with the shingle sets of their rows."""
    for batch in batches:
        raw, starts = text_bytes(batch.column(batch.num_columns - 1))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + TEXT_BLOCK)) - 1)
            to = min(to, batch.num_rows)
            tokens, counts = shingle_sets(raw[starts[at] : starts[to]], starts[at : to + 1] - starts[at])
            ends = np.cumsum(counts)
            yield batch.slice(at, to - at), [tokens[e - c : e] for e, c in zip(ends, counts)]
            at = to


def _scan(batches):
    """Digest and bands of every set; of equal sets of a block only the first has bands."""
    part, given = TaskContext.get().partitionId(), 0
    for block, sets in _blocks_of(batches):
        digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        first = {d: k for k, d in reversed(list(enumerate(digests)))}
        own = [k for k, d in enumerate(digests) if len(sets[k]) and first[d] == k]
        bands: list = [None] * len(sets)
        if own:
            made = signatures(np.concatenate([sets[k] for k in own]), np.array([len(sets[k]) for k in own]))
            for k, keys in zip(own, band_keys(made)):
                bands[k] = keys
        uid = (part << 36) + given + np.arange(len(sets))
        given += len(sets)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(uid), block.column(0), block.column(1), block.column(2),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["uid", "row", "again", "doc_id", "n", "digest", "bands"],
        )


def _set_task(batches):
    for block, sets in _blocks_of(batches):
        made = signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
        yield pa.RecordBatch.from_arrays(
            [
                block.column(0),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([m.tobytes() for m in made], pa.binary()),
            ],
            names=["uid", "tokens", "signature"],
        )


def _prune_task(batches):
    for batch in batches:
        one, other = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in (4, 5)
        )
        yield batch.take(pa.array(unpruned(one, other))).select(["a", "b", "na", "nb"])


_FIT = f"100 * least(na, nb) >= {THRESHOLD} * greatest(na, nb)"
PAIRS = "a long, b long, na long, nb long"


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b, na, nb) those whose full sets link."""
    mine = sets.select(F.col("uid").alias("a"), F.col("tokens").alias("mine"))
    other = sets.select(F.col("uid").alias("b"), F.col("tokens").alias("other"))
    counted = pairs.join(mine, "a").join(other, "b").select(
        "a", "b", "na", "nb", F.size(F.array_intersect("mine", "other")).alias("common")
    )
    return counted.where(f"100 * common >= {THRESHOLD} * (na + nb - common)").select("a", "b")


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return buckets.withColumn("label", F.col("uid"))
    return buckets.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))


def _hub_pairs(buckets: DataFrame, step: int) -> DataFrame:
    """Every class of a bucket with its hub, where the two are not known to be connected."""
    first = -F.col("meets") if step == 0 else F.lit(0)
    hub = F.min(F.struct(first, F.xxhash64("uid", F.lit(step)), "uid", "n", "label"))
    hubs = buckets.groupBy("key").agg(hub.alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    hubs = hubs.where("lo <> hi").select(
        "key", F.col("h.uid").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.label").alias("hub_label")
    )
    small = F.col("uid") < F.col("hub")
    return buckets.join(hubs, "key").where("label <> hub_label").select(
        F.least("uid", "hub").alias("a"), F.greatest("uid", "hub").alias("b"),
        F.when(small, F.col("n")).otherwise(F.col("hub_n")).alias("na"),
        F.when(small, F.col("hub_n")).otherwise(F.col("n")).alias("nb"),
    ).where(_FIT).distinct()


def _compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of listed pairs those that the posterior does not prune."""
    mine = classes.select(F.col("uid").alias("a"), F.col("signature").alias("sa"))
    other = classes.select(F.col("uid").alias("b"), F.col("signature").alias("sb"))
    joined = pairs.join(mine, "a").join(other, "b").select("a", "b", "na", "nb", "sa", "sb")
    return joined.mapInArrow(_prune_task, PAIRS)


def block_pairs(key: int, one: tuple, other: tuple, same: bool):
    """Pairs of two blocks of a bucket that are to be verified: each i with all its j.

    A block is (uids, sizes, labels, signatures).  The labels of a pair differ, its sizes allow a link, the
    posterior does not prune it, and no earlier band holds it too.  Of a block with itself each pair comes once.
    """
    _, na, la, sa = one
    _, nb, lb, sb = other
    ka, kb = band_keys(sa), band_keys(sb)
    band = int(np.flatnonzero(ka[0] == key)[0])
    for i in range(len(na)):
        able = (lb != la[i]) & (100 * np.minimum(nb, na[i]) >= THRESHOLD * np.maximum(nb, na[i]))
        if same:
            able[: i + 1] = False
        j = np.flatnonzero(able)
        if len(j):
            j = j[(kb[j] == ka[i]).argmax(axis=1) == band]
            j = j[unpruned(np.broadcast_to(sa[i], (len(j), HASHES)), sb[j])]
            if len(j):
                yield i, j


#: What a pair of blocks has to verify: pairs (uid a, uid b, their sizes), or for many pairs the members of the two
#: blocks that are in one (uid a, block 0 or 1 as b, size na, label nb).
FOUND = "key long, ca long, cb long, dense boolean, a long, b long, na long, nb long"


def _block_task(batches):
    """Compare the signatures of two blocks; neither pairs nor members that come out outgrow the members."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            cols = [batch.column(c)[k] for c in range(batch.num_columns)]
            key, ca, cb = (c.as_py() for c in cols[:3])
            one, other = (
                (*(c.values.to_numpy() for c in part[:3]), np.frombuffer(b"".join(part[3].as_py()), np.uint32).reshape(-1, HASHES))
                for part in (cols[3:7], cols[7:11])
            )
            found = list(block_pairs(key, one, other, ca == cb))
            mine = {i for i, _ in found}
            theirs = set(np.concatenate([j for _, j in found]).tolist()) if found else set()
            if sum(len(j) for _, j in found) <= len(mine) + len(theirs):
                out += [
                    (key, ca, cb, False, one[0][i], other[0][x], one[1][i], other[1][x]) for i, j in found for x in j
                ]
            else:
                if ca == cb:
                    mine, theirs = mine | theirs, set()
                for side, block, members in ((0, one, mine), (1, other, theirs)):
                    out += [(key, ca, cb, True, block[0][i], side, block[1][i], block[2][i]) for i in sorted(members)]
        if out:
            types = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def shared_bits(sets: list[np.ndarray]) -> np.ndarray:
    """The sets as rows of bits, one for each token that several sets hold."""
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    width = -(-(int(number[-1]) + 1) // 64) if len(number) else 0
    bits = np.zeros((len(sets), max(1, width)), np.uint64)
    at = number[place[keep]]
    np.bitwise_or.at(bits, (owner[keep], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return bits


def _dense_task(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Verify the pairs of two blocks on the full sets; links that join what is already joined are not given out."""
    same = key[1] == key[2]
    frame = frame.sort_values(["side", "uid"], ignore_index=True)
    bits, sizes = shared_bits(frame["tokens"].tolist()), frame["n"].to_numpy()
    uid, label = frame["uid"].to_numpy(), frame["label"].to_numpy()
    sign = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(-1, HASHES)
    side = frame["side"].to_numpy()
    where = [np.arange(len(frame))] * 2 if same else [np.flatnonzero(side == s) for s in (0, 1)]
    blocks = [(uid[w], sizes[w], label[w], sign[w]) for w in where]
    links = []
    label = label.copy()  # joined labels become one
    for i, js in block_pairs(key[0], *blocks, same):
        i, js = int(where[0][i]), where[1][js]
        js = js[label[js] != label[i]]
        common = np.bitwise_count(bits[js] & bits[i]).sum(axis=1, dtype=np.int64)
        for j in js[100 * common >= THRESHOLD * (sizes[i] + sizes[js] - common)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((min(uid[i], uid[j]), max(uid[i], uid[j])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _other_links(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes of different labels, from the buckets that hold several labels."""
    sizes = buckets.groupBy("key").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("chunks"),
        F.min("label").alias("lo"), F.max("label").alias("hi"),
    )
    sizes = sizes.where("lo <> hi").select("key", "chunks")
    mixed = buckets.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")))
    mixed = mixed.join(classes.select("uid", "signature"), "uid")
    member = F.sort_array(F.collect_list(F.struct("uid", "n", "label", "signature")))
    blocks = mixed.groupBy("key", "chunk", "chunks").agg(member.alias("m"))
    blocks = materialize(
        blocks.select("key", "chunk", "chunks", "m.uid", "m.n", "m.label", "m.signature"), "blocks"
    )
    names = ("uid", "n", "label", "signature")
    one = blocks.select(
        "key", F.col("chunk").alias("ca"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("cb"),
        *[F.col(c).alias(f"{c}_a") for c in names],
    )
    other = blocks.select("key", F.col("chunk").alias("cb"), *[F.col(c).alias(f"{c}_b") for c in names])
    several = "array_min(array_union(label_a, label_b)) <> array_max(array_union(label_a, label_b))"
    met = one.join(other, ["key", "cb"]).where(several).select(
        "key", "ca", "cb", *[f"{c}_a" for c in names], *[f"{c}_b" for c in names]
    )
    found = materialize(met.mapInArrow(_block_task, FOUND), "met")
    sparse = _verified(found.where("not dense").select("a", "b", "na", "nb").distinct(), classes)
    dense = found.where("dense").select(
        "key", "ca", "cb", F.col("a").alias("uid"), F.col("b").alias("side"), F.col("na").alias("n"), F.col("nb").alias("label")
    )
    dense = dense.join(classes, "uid").groupBy("key", "ca", "cb").applyInPandas(_dense_task, "a long, b long")
    return sparse.unionByName(dense)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    The set of a document: its distinct shingles of two words, A-Z lower-cased; of one word, that word; empty for a
    null or empty text or one of white space, which links with nothing and is its own component.  Two documents link
    when their sets have a Jaccard similarity of ``THRESHOLD`` per cent or more.  ``component_id`` is the smallest
    doc_id reachable (null ids are passed over unless a component has no other), ``kept`` marks the row that has it.

    Repeated rows are linked copies: all rows with the smallest id are kept.  Shingles are compared as 64-bit hashes.
    Very long texts are hashed in blocks.  Columns besides doc_id and text are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    # Two hashes that find a row again; equal rows have equal ones.
    rows = rows.select(
        F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("again"), "doc_id", "text"
    )
    all_docs = materialize(rows.mapInArrow(_scan, DOCUMENTS), "documents")
    known = all_docs.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("smallest"), F.min(F.when(F.col("bands").isNotNull(), F.col("uid"))).alias("uid")
    )
    known = materialize(known, "classes")
    one_each = known.select("uid")
    classes = all_docs.where("bands is not null")

    flat = classes.join(one_each, "uid", "left_semi").select("uid", "n", F.explode("bands").alias("key"))
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    buckets = materialize(flat.join(shared, "key").select("key", "uid", "n", "k"), "buckets")
    meets = buckets.groupBy("uid").agg(F.sum(F.col("k") - 1).alias("meets"))
    buckets = materialize(buckets.drop("k").join(meets, "uid"), "buckets")
    # Full sets and signatures are made again from the texts of the classes that share a bucket, not kept for all.
    wanted = classes.join(buckets.select("uid").distinct(), "uid", "left_semi").select("uid", "row", "again")
    texts = rows.join(wanted, ["row", "again"]).dropDuplicates(["uid"]).select("uid", "text")
    able = materialize(texts.mapInArrow(_set_task, SETS), "able")

    links = labels = None
    for step in range(HUB_ROUNDS + 1):
        rows_of = _labelled(buckets, labels)
        if step < HUB_ROUNDS:
            found = _verified(_compared(_hub_pairs(rows_of, step), able), able)
        else:
            found = _other_links(rows_of, able)
        found = materialize(found, "found")
        links = found if links is None else links.unionByName(found)
        labels = link_components(links)

    whole = known.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    roots = whole.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = whole.join(roots, "label").select("digest", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return all_docs.select("doc_id", "n", "digest").join(named, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )

"""N-gram Jaccard join with vertical partitioning.

The global order of shingle hashes is cut into fragments.  Fragment by fragment it is found which shingles of a
document any other document has, and the counts are summed for each document: only a document whose shared
shingles reach the threshold of its own size can link with anything, and only shared shingles can be common to
two documents, so all later steps run on these.

Copies of one shingle set are one class.  Candidates among classes come from prefixes (rarest shingle first).
In the group of a prefix shingle every class is first compared with one hub; classes found connected are not
compared again; what is left between unconnected classes is compared in full.  So a group of thousands of near
copies costs a few comparisons for each, and no link between components is lost.  The overlap of a pair is counted
in each fragment apart and summed.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm import fragments as fr
from flowlens.llm.common import mix, prepare, spare, text_bytes, text_of
from flowlens.session import materialize

SHINGLE, THRESHOLD = 5, 80
#: Rounds of comparison with a hub before the rest is compared in full.
HUB_ROUNDS = 2
#: Fragments in which the overlap of a pair is counted: quarters of the order.
PAIR_FRAGMENTS = 4
_BLOCK = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BYTE = mix(_LOWER + np.uint64(0x51ED27))
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TURN = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def _word_block(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; ``breaks`` marks bytes before which a word ends anyway."""
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1] | breaks[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lengths = np.diff(np.concatenate([starts, [len(raw)]]))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE))
    values = _BYTE[raw[starts[0] :]] * powers[place]
    return starts, mix(np.add.reduceat(values, starts - starts[0]))


def words(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows (A-Z lower-cased), and how many each row has; a block at a time."""
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[rows[:-1]] = True
    found, at, a = [], [], 0
    while a < len(raw):
        b = min(len(raw), a + _BLOCK)
        while b < len(raw):  # to the end of a word
            part = raw[b : b + 4096]
            ends = np.flatnonzero(_SPACE[part] | breaks[b : b + len(part)])
            if len(ends):
                b += int(ends[0])
                break
            b += len(part)
        starts, hashes = _word_block(raw[a:b], breaks[a:b])
        at.append(starts + a)
        found.append(hashes)
        a = b
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(rows) - 1, np.int64)
    place = np.concatenate(at)
    return np.concatenate(found), np.diff(np.searchsorted(place, rows))


def shingles(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and how many each has."""
    hashes, count = words(raw, rows)
    first = np.cumsum(count) - count
    n = len(hashes)
    owner = np.repeat(np.arange(len(count)), count)
    out, whose = [], []
    if n >= SHINGLE:
        inside = owner[: n - SHINGLE + 1] == owner[SHINGLE - 1 :]
        total = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            total += hashes[k : n - SHINGLE + 1 + k] * _TURN[k]
        out.append(mix(total[inside]))
        whose.append(owner[: n - SHINGLE + 1][inside])
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        single = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = count[short] > k
            single[has] += hashes[first[short[has]] + k] * _TURN[k]
        out.append(mix(single + count[short].astype(np.uint64)))
        whose.append(short)
    if not out:
        return np.empty(0, np.uint64), np.zeros(len(count), np.int64)
    tokens, docs = np.concatenate(out), np.concatenate(whose)
    order = np.lexsort((tokens, docs))
    tokens, docs = tokens[order], docs[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (docs[1:] != docs[:-1])
    return tokens[fresh], np.bincount(docs[fresh], minlength=len(count))


_META = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("sent", "u1"), ("n", "<u4"), ("digest", "V16")])


def _scan(bits: int):
    def run(batches):
        part, given = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        meta: list[tuple] = []
        seen: set[bytes] = set()
        size = 0

        def flush():
            base = (part << 36) + given
            tokens = np.concatenate([h[0] for h in held]) if held else np.empty(0, np.uint64)
            docs = np.concatenate([h[1] for h in held]) if held else np.empty(0, np.uint16)
            rows = [(fr.META, base, (7 * part + given) % (1 << bits), np.array(meta, _META).tobytes())]
            rows += fr.send(tokens, docs, base, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                names=["kind", "base", "frag", "payload"],
            )

        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, starts = text_bytes(batch.column(1))
            at = 0
            while at < len(ids):  # rows of about a block at a time
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK)) - 1)
                to = min(to, len(ids))
                tokens, counts = shingles(raw[starts[at] : starts[to]], starts[at : to + 1] - starts[at])
                ends = np.cumsum(counts)
                for k in range(to - at):
                    own = tokens[ends[k] - counts[k] : ends[k]]
                    digest = blake2b(own.tobytes(), digest_size=16).digest()
                    sent = len(own) > 0 and digest not in seen
                    if sent:
                        seen.add(digest)
                        held.append((own, np.full(len(own), len(meta), np.uint16)))
                        size += len(own)
                    doc_id = ids[at + k]
                    meta.append((doc_id or 0, doc_id is not None, sent, len(own), digest))
                    if size >= fr.CHUNK_TOKENS or len(meta) >= fr.CHUNK_DOCS:
                        yield flush()
                        given += len(meta)
                        held, meta, seen, size = [], [], set(), 0
                at = to
        if meta:
            yield flush()

    return run


DOCUMENTS = "uid long, doc_id long, n long, digest binary, sent boolean, tokens array<long>"


def _gather(bits: int):
    """Sum the shared shingles of each document of a chunk; keep those of documents that can link."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        meta = np.frombuffer(group[group.kind == fr.META].payload.iloc[0], _META)
        blocks = [fr.unpack(p, f, bits) for k, p, f in zip(group.kind, group.payload, group.frag) if k == fr.SHARED]
        tokens = np.concatenate([b[0] for b in blocks]) if blocks else np.empty(0, np.uint64)
        docs = np.concatenate([b[1] for b in blocks]).astype(np.int64) if blocks else np.empty(0, np.int64)
        shared = np.bincount(docs, minlength=len(meta))
        n = meta["n"].astype(np.int64)
        able = (n > 0) & (meta["sent"] == 1) & (shared * 100 >= THRESHOLD * n)
        take = able[docs]
        tokens, docs = tokens[take], docs[take]
        order = np.lexsort((tokens, docs))
        tokens = tokens[order].view(np.int64)
        ends = np.cumsum(np.bincount(docs, minlength=len(meta)))
        lists = [tokens[e - s : e] if a else None for a, s, e in zip(able, np.diff([0, *ends]), ends)]
        ids = pd.Series(meta["doc_id"].astype(np.int64), dtype="Int64").mask(meta["known"] == 0)
        return pd.DataFrame(
            {
                "uid": int(key[0]) + np.arange(len(meta)),
                "doc_id": ids,
                "n": n,
                "digest": [x.tobytes() for x in meta["digest"]],
                "sent": meta["sent"] == 1,
                "tokens": lists,
            }
        )

    return run


def link_components(links: DataFrame) -> DataFrame:
    """(uid, label) of every end of the links (a, b): the smallest uid reachable.

    Labels spread along links and jump to the label of their label, until none changes.  Each round is written to
    shared storage.
    """
    both = links.select(F.col("a").alias("uid"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("uid"), F.col("a").alias("other"))
    )
    both = materialize(both.distinct(), "links")
    state = materialize(both.groupBy("uid").agg(F.least(F.min("other"), F.min("uid")).alias("label")), "labels")
    while True:
        spread = (
            both.join(state.select(F.col("uid").alias("other"), "label"), "other")
            .groupBy("uid").agg(F.min("label").alias("near"))
        )
        lower = state.join(spread, "uid").select("uid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = state.select(F.col("uid").alias("label"), F.col("label").alias("beyond"))
        after = materialize(
            lower.join(jump, "label").select("uid", "old", F.least("label", "beyond").alias("label")), "labels"
        )
        changed = after.where("old <> label").limit(1).count()
        state = after.select("uid", "label")
        if not changed:
            return state


def _verified(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b, na, nb) those that link: overlaps counted in fragments, summed per pair."""
    mine = parts.select(F.col("uid").alias("a"), "part", F.col("tokens").alias("mine"))
    other = parts.select(F.col("uid").alias("b"), "part", F.col("tokens").alias("other"))
    counted = (
        pairs.join(mine, "a").join(other, ["b", "part"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("mine", "other")).alias("common"))
        .groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    )
    return counted.where(f"100 * common >= {THRESHOLD} * (na + nb - common)").select("a", "b")


_FIT = f"100 * least(n, hub_n) >= {THRESHOLD} * greatest(n, hub_n)"


def _ordered(rows: DataFrame) -> DataFrame:
    small, large = F.col("uid") < F.col("hub"), F.col("uid") >= F.col("hub")
    return rows.select(
        F.least("uid", "hub").alias("a"), F.greatest("uid", "hub").alias("b"),
        F.when(small, F.col("n")).when(large, F.col("hub_n")).alias("na"),
        F.when(small, F.col("hub_n")).when(large, F.col("n")).alias("nb"),
    ).distinct()


def _labelled(prefixes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return prefixes.withColumn("label", F.col("uid"))
    return prefixes.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))


def _hub_pairs(rows: DataFrame, step: int) -> DataFrame:
    """Every row of a group with the group's hub, where the two are not known to be connected.

    The hub is the class with the smallest share of shingles of its own, the one in the middle of a group of
    edited copies; in later rounds one by chance.
    """
    middle = F.col("own") / F.col("n") if step == 0 else F.lit(0.0)
    hub = F.min(F.struct(middle, F.xxhash64("uid", F.lit(step)), "uid", "n", "label"))
    hubs = rows.groupBy("token").agg(hub.alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    hubs = hubs.where("lo <> hi").select(
        "token", F.col("h.uid").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.label").alias("hub_label")
    )
    return _ordered(rows.join(hubs, "token").where("label <> hub_label").where(_FIT))


def _other_pairs(rows: DataFrame) -> DataFrame:
    """All pairs in groups between rows of different labels, except that the commonest label is not listed twice."""
    sizes = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    common = sizes.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("k"))
    common = common.where("k > 1").select("token", F.col("m.label").alias("main"))
    mixed = rows.join(common, "token")
    few = mixed.where("label <> main").select(
        "token", F.col("uid").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"),
        F.col("place").alias("hub_place"),
    )
    # What two classes can have in common if this shingle is the first they share; a pair that links passes there.
    rest = "1 + least(n - place, hub_n - hub_place)"
    return _ordered(
        mixed.join(few, "token").where("label <> hub_label and (label = main or uid < hub)").where(_FIT)
        .where(f"100 * ({rest}) >= {THRESHOLD} * (n + hub_n - ({rest}))")
    )


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    The set of a document: its distinct shingles of five words; with fewer words, all of them as one; empty for
    a null or empty text or one of white space, which links with nothing and is its own component.
    Two documents link when their sets have a Jaccard similarity of ``THRESHOLD`` per cent or more.
    ``component_id`` is the smallest doc_id reachable (null ids are passed over unless a component has no other).
    Repeated rows are linked copies.  Columns besides doc_id and text are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    bits = fr.fragment_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    sent = rows.mapInArrow(_scan(bits), fr.SCHEMA)
    answers = sent.groupBy("frag").applyInPandas(fr.answer(bits), fr.SCHEMA)
    all_docs = materialize(answers.groupBy("base").applyInPandas(_gather(bits), DOCUMENTS), "documents")

    classes = all_docs.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("smallest"), F.min(F.when(F.col("sent"), F.col("uid"))).alias("uid")
    )
    classes = materialize(classes, "classes")
    able = all_docs.where("tokens is not null").join(classes.select("uid"), "uid", "left_semi")
    able = materialize(able.select("uid", "n", "tokens"), "able")

    flat = able.select("uid", "n", F.explode("tokens").alias("token"))
    often = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rank = Window.partitionBy("uid").orderBy("df", "token")
    ranked = flat.join(often, "token").select(
        "uid", "n", "token",
        F.row_number().over(rank).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("uid")).alias("r"),
    )
    # Shingles nobody else has come first in the order; they are counted, not listed.
    place = F.col("k") + F.col("n") - F.col("r")
    prefix = F.expr(f"n - (n * {THRESHOLD} + 99) div 100 + 1")
    prefixes = materialize(
        ranked.withColumn("place", place).where(F.col("place") <= prefix)
        .select("uid", "n", "token", "place", (F.col("n") - F.col("r")).alias("own")), "prefixes",
    )

    # Ranges of the order of shingles, as the fragments above but coarser.
    part_of = f"cast(shiftrightunsigned(t, {bits + 8 * fr.LOW - 2}) as int)"
    parts = able.select(
        "uid",
        F.explode(F.array(*map(F.lit, range(PAIR_FRAGMENTS)))).alias("part"),
        "tokens",
    ).select(
        "uid", "part",
        F.expr(f"filter(tokens, t -> {part_of} = part)").alias("tokens"),
    )
    parts = materialize(parts.where(F.size("tokens") > 0), "segments")

    links = labels = None
    for step in range(HUB_ROUNDS + 1):
        grouped = _labelled(prefixes, labels)
        pairs = _hub_pairs(grouped, step) if step < HUB_ROUNDS else _other_pairs(grouped)
        found = materialize(_verified(pairs, parts), "found")
        links = found if links is None else links.unionByName(found)
        labels = link_components(links)

    whole = classes.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    roots = whole.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = whole.join(roots, "label").select("digest", "component_id")
    return all_docs.select("doc_id", "n", "digest").join(named, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component (the one with the smallest id), with all columns of ``docs``.

    Rows without an id stay, except that of fully repeated rows one stays; so do texts of one id that differ.
    """
    doc, nth = spare(docs.columns, "__id", "__nth")
    stay = jaccard_join(docs).where("doc_id = component_id").select(F.col("doc_id").alias(doc)).distinct()
    stay = materialize(stay, "stay")
    kept = docs.where("doc_id is not null").join(stay, F.col("doc_id").cast("long") == F.col(doc), "left_semi")
    one = Window.partitionBy("doc_id", F.sha2(text_of("text").cast("binary"), 256)).orderBy(F.lit(0))
    kept = kept.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).drop(nth)
    return kept.unionByName(docs.where("doc_id is null").distinct())

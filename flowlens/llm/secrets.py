"""Secret scans with corpus-wide ownership frequency.

Candidates are the matches of three fixed patterns and, beside them, long tokens that mix letters and digits.
The hash of each candidate's value is aggregated over the whole corpus by distinct repositories and owners: the
repository is the source of a document, the owner its text, so exact copies of one document are one owner and a value
that many different documents of one source carry has many.  A value of many repositories or owners is a copied
example; one that stays with few and looks random is live.  Live long tokens are added to the spans of the fixed
patterns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import prepare, spare, text_of
from flowlens.session import materialize

# The patterns of the base kinds and the least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
#: Order of the kinds among spans with one start.
KINDS = ("assign", "access", "hex", "owned")
# Added candidates: whole tokens of this many characters with letters and digits and this entropy in bits.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")
LEAST_ENTROPY = 3.0
#: Assigned and hexadecimal values look random with a letter, a digit and this entropy in bits; an access key by its form.
LOOK_ENTROPY = 2.5
#: A value seen in more repositories, or with more owners, than this is a copied example.
MOST_REPOS, MOST_OWNERS = 3, 5
#: Values with more than one HOT-th of all candidates are joined by broadcast: there are fewer than HOT of them.
HOT = 1000

CANDIDATES = "array<struct<kind:int,start:int,end:int,value:string,random:boolean>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def looks_random(kind: int, value: str) -> bool:
    """Whether a value can be a credential: ``password: required`` and ``000...`` cannot."""
    if kind in (1, 3):  # the form, or the pattern of added candidates, says so
        return True
    letter, digit = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    return letter and digit and entropy(value) >= LOOK_ENTROPY


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind; offsets in code points, end exclusive."""
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    starts: list[int] = []  # of the stretches that base spans cover
    ends: list[int] = []
    for _, a, b, _ in sorted(found, key=lambda x: x[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for m in TOKEN.finditer(text):
        k = bisect_right(ends, m.start())  # the first stretch that ends beyond the token's start
        if (k == len(starts) or starts[k] >= m.end()) and entropy(m[0]) >= LEAST_ENTROPY:
            found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _scan(batches):
    kind = pa.list_(
        pa.struct(
            [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("random", pa.bool_())]
        )
    )
    names = ("kind", "start", "end", "value", "random")
    for batch in batches:
        found = [
            [dict(zip(names, (*c, looks_random(c[0], c[3])))) for c in candidates(t)]
            for t in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("doc_id", "key", "repo", "owner")), pa.array(found, kind)],
            names=["doc_id", "key", "repo", "owner", "found"],
        )


def value_counts(exploded: DataFrame) -> DataFrame:
    """By value hash: rows, distinct repositories and distinct owners (null counts as one of its own).

    Counted in two steps: distinct (value, repository, owner) first, combined in the map tasks, so a value in a
    third of all rows arrives as one row for each repository and owner.
    """
    owners = exploded.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("hash").agg(
        F.sum("n").alias("n_rows"),
        F.countDistinct(F.coalesce(F.col("repo"), F.lit("\0"))).alias("n_repos"),
        F.countDistinct(F.coalesce(F.col("owner"), F.lit("\0"))).alias("n_owners"),
    )


def scan(docs: DataFrame, repo_col: str = "source", owner_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, row, key, spans (array of kind, start, end, live, n_repos, n_owners), in order.

    ``row`` tells rows with the same id apart, ``key`` is a hash of the text, which is the owner where no
    ``owner_col`` is named.  A null text is empty and has no spans.  Null repositories or owners count as one unknown
    repository or owner.  Repeated rows are rows, of one owner.  An empty table gives no rows.  Other columns are
    ignored.
    """
    prepare(docs.sparkSession)
    owner = F.sha2(text_of("text").cast("binary"), 256) if owner_col is None else F.col(f"`{owner_col}`").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(f"`{repo_col}`").cast("string").alias("repo"),
        owner.alias("owner"),
        F.xxhash64(text_of("text")).alias("key"),
        text_of("text").alias("text"),
    ).mapInArrow(_scan, f"doc_id long, key long, repo string, owner string, found {CANDIDATES}")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")
    flat = rows.where(F.size("found") > 0).select("doc_id", "row", "repo", "owner", F.explode("found").alias("c"))
    flat = flat.select(
        "doc_id", "row", "repo", "owner", "c.kind", "c.start", "c.end", "c.random",
        F.sha2(F.col("c.value").cast("binary"), 256).alias("hash"), F.length("c.value").alias("size"),
    )
    counts = materialize(value_counts(flat), "ownership")
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    hot = counts.where(F.col("n_rows") * HOT > total)
    rest = counts.where(F.col("n_rows") * HOT <= total)
    columns = ["doc_id", "row", "kind", "start", "end", "random", "n_repos", "n_owners"]
    # Fewer than HOT values are hot: their rows stay where they are.
    marked = flat.join(F.broadcast(hot), "hash", "left").withColumn("cold", F.col("n_rows").isNull())
    known = marked.where("not cold").select(columns)
    other = marked.where("cold").drop("n_rows", "n_repos", "n_owners").join(rest, "hash").select(columns)
    live = F.col("random") & (F.col("n_repos") <= MOST_REPOS) & (F.col("n_owners") <= MOST_OWNERS)
    spans = (
        known.unionByName(other).withColumn("live", live)
        .where((F.col("kind") < 3) | F.col("live"))
        .groupBy("doc_id", "row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "n_repos", "n_owners"))).alias("spans"))
    )
    empty = spans.schema["spans"].dataType.simpleString()
    none = rows.where(F.size("found") == 0).select(
        "doc_id", "row", "key", F.expr(f"cast(array() as {empty})").alias("spans")
    )
    bare = rows.where(F.size("found") > 0).select("doc_id", "row", "key").join(spans.drop("doc_id"), "row", "left")
    bare = bare.select(
        "doc_id", "row", "key", F.coalesce("spans", F.expr(f"cast(array() as {empty})")).alias("spans")
    )
    return none.unionByName(bare)


def report(spans: DataFrame) -> DataFrame:
    """Counts and texts of the spans of :func:`scan`."""
    kinds = F.array(*map(F.lit, KINDS))

    def written(column):
        shown = F.transform(
            column, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.array_join(shown, ",")

    def count(k):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return spans.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


MASK = "[SECRET]"


def _mask(text: str, spans: list) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        out.append(text[at : max(at, start)])
        if start >= at:
            out.append(MASK)
        at = end
    return "".join(out) + text[at:]


def mask_live(docs: DataFrame, repo_col: str = "source", owner_col: str | None = None) -> DataFrame:
    """``docs`` with every live-looking span replaced by ``MASK`` and ``n_chars`` counted anew where text changed.

    Widely copied examples and phrases stay.  All rows and columns stay.  Spans belong to an id and a text, so rows that share
    an id, or have none, are cut each by its own.
    """
    prepare(docs.sparkSession)
    doc, key, cuts = spare(docs.columns, "__doc", "__key", "__cut")
    cut = F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    live = (
        scan(docs, repo_col, owner_col)
        .select("doc_id", "key", F.explode(F.filter("spans", lambda s: s["live"])).alias("s"))
        .groupBy(F.col("doc_id").alias(doc), F.col("key").alias(key)).agg(F.collect_set(cut).alias(cuts))
    )
    live = materialize(live, "live")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_of("text")) == F.col(key))
    joined = docs.join(live, same, "left").drop(doc, key)
    at = {name: k for k, name in enumerate(docs.columns)}

    def run(batches):
        for batch in batches:
            found = batch.column(len(at)).to_pylist()
            if not any(found):
                yield batch.select(list(range(len(at))))
                continue
            columns = [batch.column(k) for k in range(len(at))]
            texts = columns[at["text"]].to_pylist()
            new = [
                _mask(t, [(s["start"], s["end"]) for s in c]) if c and t else t
                for t, c in zip(texts, found, strict=True)
            ]
            columns[at["text"]] = pa.array(new, columns[at["text"]].type)
            if "n_chars" in at:
                old = columns[at["n_chars"]]
                counts = [
                    len(n) if c and n else o for n, c, o in zip(new, found, old.to_pylist(), strict=True)
                ]
                columns[at["n_chars"]] = pa.array(counts, old.type)
            yield pa.RecordBatch.from_arrays(columns, names=list(at))

    return joined.mapInArrow(run, docs.schema)

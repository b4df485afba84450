"""Document fingerprints by winnowing, in SQL functions only.

Tokens are words: runs of up to ``TOKEN_CHARS`` non-space characters.  A longer run (minified code, base64) and the
scripts written without spaces have every character as a token, so that grams start at each.  Every token is hashed
once; the polynomial hash of ``K`` successive ones is rolled together from those of two and of four.  Of every
``WINDOW`` successive hashes the smallest is chosen, of equal ones the rightmost, again from the minima of two and of
four.  Positions are kept, so two texts that share ``K + WINDOW - 1`` successive tokens always share a fingerprint,
and so do two that share a passage of more than ``TOKEN_CHARS`` characters without spaces, wherever it stands in its
run.  A chosen gram is given out with a 64-bit hash of its tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.common import partitions, prepare, text_of
from flowlens.session import materialize

K, WINDOW, TOKEN_CHARS = 5, 6, 16
# The code points of scripts without spaces (Thai to Myanmar, Khmer, Han, kana, Bopomofo), and white space.
_UNSPACED = (
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029),
    (0x3038, 0x303B), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
_SPACE = ((0x09, 0x0D), (0x20, 0x20))


def _others(ranges: tuple[tuple[int, int], ...]) -> str:
    """A class of all other code points; the range with the commonest ones is tried first."""
    ends = [(-1, -1), *sorted(ranges), (0x110000, 0x110000)]
    free = [(a[1] + 1, b[0] - 1) for a, b in zip(ends, ends[1:]) if a[1] + 1 < b[0]]
    free.sort(key=lambda r: not r[0] <= ord("a") <= r[1])
    return "[" + "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in free) + "]"


_OF_WORD = _others(_UNSPACED + _SPACE)
TOKEN = rf"(?<!{_OF_WORD}){_OF_WORD}{{1,{TOKEN_CHARS}}}+(?!{_OF_WORD})|\S"
# The same for texts without a code point from the first unspaced script on, which most texts are: much cheaper.
_FAR = rf"[\x{{{_UNSPACED[0][0]:X}}}-\x{{10FFFF}}]"
_NEAR_TOKEN = rf"(?<!\S)\S{{1,{TOKEN_CHARS}}}+(?!\S)|\S"
#: Prime that rolled hashes are taken by (products of two stay below 2^62), their base, bits of a position.
PRIME, BASE, PLACE_BITS = (1 << 31) - 1, 1_000_003, 31
#: Buckets of neighbouring documents to a shuffle partition, and at most in all (they are listed in the plan).
BUCKETS, MOST_BUCKETS = 4, 20_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _rolled(tokens: Column) -> Column:
    """The polynomial hash of the ``K`` = 5 tokens from each place: of two, of four, and one more."""
    square = BASE * BASE % PRIME

    def then(values: Column, other: Column, ahead: int, base: int) -> Column:
        return F.transform(values, lambda x, i: (x * F.lit(base) + F.get(other, i + ahead)) % F.lit(PRIME))

    small = F.transform(tokens, lambda t: F.pmod(t, F.lit(PRIME)))
    return _let(
        small,
        lambda one: _let(
            then(one, one, 1, BASE),
            lambda two: then(F.slice(then(two, two, 2, square), 1, F.size(one) - K + 1), one, K - 1, BASE),
        ),
    )


def _minima(values: Column, width: Column) -> Column:
    """The least of the ``WINDOW`` = 6 values from each place, each once, in order; of all if there are fewer."""

    def least(here: Column, other: Column, ahead: int) -> Column:
        return F.transform(here, lambda x, i: F.least(x, F.get(other, i + ahead)))

    windows = _let(
        least(values, values, 1),
        lambda two: F.array_distinct(F.slice(least(least(two, two, 2), two, 4), 1, F.greatest(width - WINDOW + 1, F.lit(0)))),
    )
    return F.when(width < WINDOW, F.array(F.array_min(values))).otherwise(windows)


def fingerprint(text: Column) -> Column:
    """array<struct<pos int, hash bigint>> of a text; empty for one without tokens.

    A text with fewer than ``K`` tokens has one hash, over all of them; fewer hashes than a window are one window.
    """
    far, near = (F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) for pattern in (TOKEN, _NEAR_TOKEN))
    tokens = F.transform(F.when(text.rlike(_FAR), far).otherwise(near), lambda t: F.xxhash64(t))
    last = F.lit((1 << PLACE_BITS) - 1)

    def chosen(t: Column) -> Column:
        # Hash and place in one number: the place counts down, so that of equal hashes the rightmost is least.
        numbered = F.transform(_rolled(t), lambda g, i: F.shiftleft(g, PLACE_BITS) + (last - i))
        return F.transform(
            _let(numbered, lambda v: _minima(v, F.size(t) - K + 1)),
            lambda v: _let(
                (last - v.bitwiseAND(last)).cast("int"),
                lambda p: F.struct(p.alias("pos"), F.xxhash64(*(F.get(t, p + k) for k in range(K))).alias("hash")),
            ),
        )

    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    short = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).cast("long").alias("hash")))
    return _let(
        tokens,
        lambda t: F.when(F.size(t) == 0, none)
        .when(F.size(t) < K, F.transform(short, lambda s: F.struct(s["pos"].alias("pos"), F.xxhash64(t).alias("hash"))))
        .otherwise(chosen(t)),
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all hashes of two fingerprints; 1 when both are empty."""

    def distinct(x):
        return F.array_distinct(F.transform(x, lambda e: e["hash"]))

    return _let(
        F.struct(distinct(a).alias("a"), distinct(b).alias("b")),
        lambda s: _let(
            F.size(F.array_intersect(s["a"], s["b"])),
            lambda both: F.when(F.size(s["a"]) + F.size(s["b"]) == 0, F.lit(1.0)).otherwise(
                both / (F.size(s["a"]) + F.size(s["b"]) - both)
            ),
        ),
    )


def written(prints: Column) -> Column:
    """A fingerprint as text: position:hash, comma-joined."""
    return F.array_join(F.transform(prints, lambda e: F.concat_ws(":", e["pos"].cast("string"), F.hex(e["hash"]))), ",")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``key``: looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    all_bounds, coarse = F.lit(bounds), F.lit(bounds[step - 1 :: step])
    return _let(
        F.size(F.filter(coarse, lambda x: x <= key)),
        lambda c: c * step + F.size(F.filter(F.slice(all_bounds, c * step + 1, step), lambda x: x <= key)),
    )


def with_neighbours(rows: DataFrame) -> tuple[DataFrame, Window]:
    """``rows`` (key, text) by buckets of neighbouring keys, and the window along a bucket.

    The first row of each bucket also stands at the end of the bucket before (``guest``), the very first row at
    the end of the last one; so ``lead`` over the window is the next row of all for every row that is no guest.
    Keys that tie go by text.
    """
    spark = rows.sparkSession
    count = min(MOST_BUCKETS, BUCKETS * partitions(spark))
    at = [k / count for k in range(1, count)]
    found = rows.agg(F.percentile_approx("key", F.lit(at), F.lit(10 * count)).alias("b")).first()["b"] or []
    bounds = sorted(set(found))
    heads = rows.groupBy(_bucket(F.col("key"), bounds).alias("bucket")).agg(F.min("key").alias("head"))
    along = Window.orderBy("bucket")  # one row for each bucket
    heads = heads.select(
        "head",
        F.coalesce(F.lag("bucket").over(along), F.max("bucket").over(Window.partitionBy())).alias("before"),
        F.lag("bucket").over(along).isNull().alias("wraps"),
    )
    heads = materialize(heads, "heads")
    own = F.struct(_bucket(F.col("key"), bounds).alias("bucket"), F.lit(False).alias("wraps"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("before").alias("bucket"), F.col("wraps"), F.lit(True).alias("guest"))
    placed = rows.join(F.broadcast(heads), F.col("key") == F.col("head"), "left").select(
        *rows.columns, F.inline(F.when(F.col("head").isNull(), F.array(own)).otherwise(F.array(own, visit)))
    )
    return placed, Window.partitionBy("bucket").orderBy("wraps", "key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, prints, edited, edited_prints, next_prints.

    ``edited`` is the text with its last half replaced by the beginning of the next document's (ascending
    doc_id, null ids first, rows of one id by text; after the last the first).  A null text is empty.  Other
    columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"),
        text_of("text").alias("text"),
    )
    placed, along = with_neighbours(rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    first = placed.withColumn("next", F.lead("text").over(along)).select(
        "doc_id", "key", "text", "bucket", "wraps", "guest", n.cast("long").alias("n_chars"), edited.alias("edited")
    )
    made = first.withColumn("prints", fingerprint(F.col("text"))).withColumn(
        "edited_prints", F.when(~F.col("guest"), fingerprint(F.col("edited")))
    )
    return (
        made.withColumn("next_prints", F.lead("prints").over(along)).where("not guest")
        .select("doc_id", "n_chars", "prints", "edited", "edited_prints", "next_prints")
    )


def report(made: DataFrame) -> DataFrame:
    """Digests and likenesses of :func:`fingerprints`."""
    return made.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("prints")).alias("fingerprint"),
        written(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )

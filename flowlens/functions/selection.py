"""Order statistics of many columns at once, by refining histograms.

A round counts the rows of the bracket that a value is known to be in by ``BINS`` bins of equal width and narrows the
bracket to the extremes of the one bin that holds the rank; it ends when these are equal.  Only bins are shuffled and
collected, never ranked rows, so neither heavy ties nor the number of rows put a group into one task, and small and
large tables take the same way.  A quantile sketch chooses the first bracket; where it misses, the bins beside it take
over.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

#: Bins to a column and round.
BINS = 2048
#: Accuracy of the sketch, and the share of rows its bracket spans on either side.
SKETCH, BESIDE = 1000, 0.01


@dataclass
class _Search:
    rank: int  # among the rows of the bracket, from 1
    low: float
    high: float

    @property
    def done(self) -> bool:
        return self.low == self.high or (math.isnan(self.low) and math.isnan(self.high))


def _bin(value, s: _Search):
    """0 below the bracket, 1 to BINS inside, BINS + 1 above; grows with the value, NaN last."""
    v, half = F.col(value), s.high * 0.5 - s.low * 0.5  # halves: the width itself may overflow
    above = F.when(v > s.high, BINS + 1)
    if not (math.isfinite(half) and half > 0):  # an end is infinite, or all that is left are neighbours
        return F.when(v < s.low, 0).when(v == s.low, 1).when(v < s.high, 2).when(v == s.high, 3).otherwise(above)
    place = F.floor((v * 0.5 - s.low * 0.5) / half * BINS)
    inside = F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)) + 1
    return F.when(v < s.low, 0).when(v > s.high, BINS + 1).otherwise(inside).cast("int")


def select_ranks(df: DataFrame, ranks: dict[str, int]) -> dict[str, float | None]:
    """Of each named double column the value at its rank (from 1) among the values that are not null.

    NaN counts as the largest value.  A rank beyond the number of values gives nothing.
    """
    counts = dict(zip(ranks, df.agg(*[F.count(c) for c in ranks]).first()))
    open_ = {c: r for c, r in ranks.items() if 1 <= r <= counts[c]}
    found: dict[str, float | None] = dict.fromkeys(ranks)
    if not open_:
        return found
    ends = [
        [min(1.0, max(0.0, r / counts[c] + d)) for d in (-BESIDE, BESIDE)] for c, r in open_.items()
    ]
    sketched = df.agg(*[F.percentile_approx(c, e, SKETCH) for c, e in zip(open_, ends)]).first()
    search = {c: _Search(r, float(b[0]), float(b[1])) for (c, r), b in zip(open_.items(), sketched)}
    first = True
    while search:
        bins = _count(df, search, whole=first)
        first = False
        for c, s in list(search.items()):
            before = 0
            for n, low, high in (bins[c][b] for b in sorted(bins[c])):
                if before + n >= s.rank:
                    search[c] = _Search(s.rank - before, low, high)
                    break
                before += n
            if search[c].done:
                found[c] = search.pop(c).low
    return found


def _count(df: DataFrame, search: dict[str, _Search], whole: bool) -> dict[str, dict[int, tuple[int, float, float]]]:
    """By column and bin: rows, least and greatest value.  Later rounds leave out what lies beside the brackets."""
    cells = []
    for c, s in search.items():
        cell = F.struct(F.lit(c).alias("c"), _bin(c, s).alias("b"), F.col(c).cast("double").alias("v"))
        inside = F.col(c).isNotNull()
        if not whole:
            inside = F.isnan(c) if math.isnan(s.low) else inside & (F.col(c) >= s.low) & (F.col(c) <= s.high)
        cells.append(F.when(inside, cell))
    rows = df.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x"))
    counted = rows.groupBy("x.c", "x.b").agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))
    out: dict[str, dict[int, tuple[int, float, float]]] = {c: {} for c in search}
    for r in counted.collect():  # at most BINS + 2 rows for each column
        out[r.c][r.b] = (r.n, r.lo, r.hi)
    return out


def upper_medians(df: DataFrame, columns: list[str]) -> list[float | None]:
    """The value at place floor(n/2), from 0, of each sorted column (nulls left out)."""
    counts = df.agg(*[F.count(c) for c in columns]).first()
    found = select_ranks(df, {c: n // 2 + 1 for c, n in zip(columns, counts)})
    return [found[c] for c in columns]

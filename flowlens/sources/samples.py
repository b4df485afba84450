"""Repeatable samples: exact sizes, order by a seeded hash of the flow id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowlens.schema import FLOW_ID
from flowlens.session import materialize

#: Bits of the hash that one round of counting resolves, and most rows of a group that are ranked at the end.
ROUND_BITS, RANKED_ROWS = 14, 100_000


def _key(seed: int):
    return F.xxhash64(F.col(FLOW_ID), F.lit(seed))


def _cuts(bins: DataFrame) -> DataFrame:
    """Of counted bins (_by, _quota, _bin, _n) the one of each group where the quota is reached, and what is left of it."""
    upto = F.sum("_n").over(Window.partitionBy("_by").orderBy("_bin"))
    return (
        bins.withColumn("_before", upto - F.col("_n"))
        .where((F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("_n")))
        .select("_by", F.col("_bin").alias("_cut"), (F.col("_quota") - F.col("_before")).alias("_left"), "_n")
    )


def stratified_sample(
    f: DataFrame, by: str = "Attack", target: int = 200_000, seed: int = 42
) -> DataFrame:
    """Per group ``min(n, int(target * n / total))`` flows with the smallest hash.

    A group may be most of the table, so it is never sorted as one: rows are counted by the leading bits of their
    hash, then those of the bin that holds a group's cut by the next bits, until no such bin has more than
    ``RANKED_ROWS`` rows.  Bins before a cut are taken whole, the last bin is ranked.  The cuts, one row per group,
    are written out each round, so that the optimizer knows their size.
    """
    keyed = f.withColumns({"_hash": _key(seed), "_by": F.col(by)})
    shift = 64 - ROUND_BITS
    bins = keyed.groupBy("_by", F.shiftright("_hash", shift).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    bins = materialize(bins, "bins")
    sizes = bins.groupBy("_by").agg(F.sum("_n").alias("_size"))
    total = sizes.agg(F.sum("_size")).first()[0] or 1
    quota = F.least("_size", F.floor(F.lit(target) * F.col("_size") / F.lit(total)))
    quotas = sizes.select(F.col("_by").alias("_group"), quota.alias("_quota"))
    cuts = materialize(_cuts(bins.join(quotas, F.col("_by").eqNullSafe(F.col("_group"))).drop("_group")), "cuts")
    while shift > 0 and (cuts.agg(F.max("_n")).first()[0] or 0) > RANKED_ROWS:
        finer = max(0, shift - ROUND_BITS)
        named = cuts.select(F.col("_by").alias("_group"), "_cut", F.col("_left").alias("_quota"))
        inside = keyed.join(
            named, F.col("_by").eqNullSafe(F.col("_group")) & (F.shiftright("_hash", shift) == F.col("_cut"))
        )
        bins = inside.groupBy("_by", "_quota", F.shiftright("_hash", finer).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
        cuts, shift = materialize(_cuts(bins), "cuts"), finer
    place = F.shiftright("_hash", shift)
    named = cuts.select(F.col("_by").alias("_group"), "_cut", "_left")
    chosen = keyed.join(named, F.col("_by").eqNullSafe(F.col("_group")) & (place <= F.col("_cut")))
    whole = chosen.where(place < F.col("_cut")).select(*f.columns)
    rank = F.row_number().over(Window.partitionBy("_by").orderBy("_hash", FLOW_ID))
    ranked = chosen.where(place == F.col("_cut")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left"))
    return whole.unionByName(ranked.select(*f.columns))


def fast_stratified_sample(f: DataFrame, target: int = 200_000, seed: int = 42) -> DataFrame:
    """Expected sizes instead of exact ones; no shuffle of the flows.

    The expected share ``target / total`` is the same in every group, so no group column is asked for.
    """
    total = f.count()
    share = min(1.0, target / total) if total else 0.0
    return f.where(F.pmod(_key(seed), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def random_sample(f: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """``n`` flows in hash order (each task keeps only its best ``n``)."""
    return f.orderBy(_key(seed), FLOW_ID).limit(n)

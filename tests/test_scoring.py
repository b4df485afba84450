"""Golden cases of the profile rules."""

import numpy as np
import pandas as pd
import pytest

from flowlens.functions import selection
from flowlens.operators import scoring, states

BASE = dict(
    state_id=0, flow_count=260, avg_in_bytes=1400.0, avg_out_bytes=900.0, bytes_ratio=1.5,
    avg_duration_ms=3200.0, avg_pkts_per_sec=14.0, tcp_pct=0.7, udp_pct=0.2, icmp_pct=0.1,
    well_known_pct=0.45, registered_pct=0.35, ephemeral_pct=0.2,
)
OPTIONAL = ("conn_complete_pct", "no_reply_pct", "rejected_pct", "avg_bytes_per_pkt",
            "avg_inter_flow_gap_ms")


@pytest.fixture
def profiles(spark):
    def build(*changes):
        rows = [{**BASE, "state_id": i, **dict.fromkeys(OPTIONAL), **c} for i, c in enumerate(changes)]
        names = list(rows[0])
        schema = ", ".join(
            f"{n} {'int' if n == 'state_id' else 'bigint' if n == 'flow_count' else 'double'}" for n in names
        )
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    return build


def by_state(df):
    return [r for r in df.orderBy("state_id").collect()]


# ---------------------------------------------------------------- anomalies


def test_one_profile_or_equal_profiles_score_zero(profiles):
    for df in (profiles({}), profiles({}, {}, {})):
        assert all(r.anomaly_score == 0 and r.anomaly_factors == [] for r in
                   by_state(scoring.anomaly_scores(df)))


def test_outlier_scores_high_and_names_its_metric(profiles):
    df = profiles(*[{"avg_duration_ms": 5000.0 + 10 * i} for i in range(7)], {"avg_duration_ms": 900000.0})
    rows = by_state(scoring.anomaly_scores(df))
    assert rows[-1].anomaly_score == 100 and rows[-1].anomaly_factors == ["duration"]
    assert all(r.anomaly_score < 100 for r in rows[:-1])


def test_score_is_twenty_points_per_z(profiles):
    # upper median 30, deviations 20 10 0 10 60 -> MAD 10, z of the last = 60 / 14.826
    df = profiles(*[{"bytes_ratio": float(v)} for v in (10, 20, 30, 40, 90)])
    rows = by_state(scoring.anomaly_scores(df))
    assert [r.anomaly_score for r in rows] == [27, 13, 0, 13, 81]
    assert [r.anomaly_factors for r in rows] == [[], [], [], [], ["bytes_ratio"]]


def test_at_most_three_factors_largest_first(profiles):
    calm = [{"bytes_ratio": 2 + i / 10, "avg_duration_ms": 5000.0 + i, "avg_pkts_per_sec": 10 + i / 10,
             "tcp_pct": 0.8 + i / 100} for i in range(7)]
    wild = {"bytes_ratio": 50.0, "avg_duration_ms": 50000.0, "avg_pkts_per_sec": 100.0, "tcp_pct": 3.0}
    last = by_state(scoring.anomaly_scores(profiles(*calm, wild)))[-1]
    assert last.anomaly_factors == ["duration", "pkts_per_sec", "bytes_ratio"]


def test_even_count_uses_the_upper_median(spark):
    df = spark.createDataFrame([(float(v), -float(v)) for v in (4, 1, 3, 2)], "a double, b double")
    assert selection.upper_medians(df, ["a", "b"]) == [3.0, -2.0]


def columns_of(rng, n):
    """Values that are hard to narrow: ties, many orders of magnitude, far ends, no spread."""
    ties = rng.integers(0, 3, n).astype(float)
    wide = np.exp(rng.normal(0, 60, n)) * rng.choice([-1.0, 1.0], n)
    ends = np.where(rng.random(n) < 0.3, np.inf, rng.normal(0, 1, n))
    ends[rng.random(n) < 0.1] = -np.inf
    huge = rng.choice([1.7e308, -1.7e308, 5e-324, 1e-323, 0.0], n)
    hot = np.where(rng.random(n) < 0.6, 7.0, rng.normal(7, 1e-9, n))
    return {"ties": ties, "wide": wide, "ends": ends, "huge": huge, "hot": hot, "same": np.full(n, 3.5)}


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
@pytest.mark.parametrize("beside", [0.01, 0.0])
def test_ranks_are_exact(spark, monkeypatch, n, beside):
    monkeypatch.setattr(selection, "BINS", 4)
    monkeypatch.setattr(selection, "BESIDE", beside)
    made = columns_of(np.random.default_rng(n), n)
    df = spark.createDataFrame(pd.DataFrame(made).astype(float)).repartition(3)
    for share in (0.0, 0.5, 0.93, 1.0):
        rank = max(1, min(n, int(share * n) + 1))
        got = selection.select_ranks(df, dict.fromkeys(made, rank))
        assert got == {c: np.sort(v)[rank - 1] for c, v in made.items()}


def test_ranks_with_nulls_and_no_values(spark):
    rows = [(1.0, None), (None, None), (float("nan"), None), (3.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert selection.upper_medians(df, ["a", "b"]) == [3.0, None]
    assert np.isnan(selection.select_ranks(df, {"a": 3})["a"])
    assert selection.select_ranks(df, {"a": 4, "b": 1}) == {"a": None, "b": None}
    assert selection.upper_medians(df.where("a IS NULL"), ["a"]) == [None]


def test_medians_rank_no_rows(spark):
    """Rows are counted by bins; no window sees them."""
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS a")
    plans = []
    old = selection._count

    def seen(*args, **kwargs):
        out = old(*args, **kwargs)
        plans.append(out)
        return out

    selection._count = seen
    try:
        assert selection.upper_medians(df, ["a"]) == [500.0]
    finally:
        selection._count = old
    assert len(plans) <= 3 and all(len(p["a"]) <= selection.BINS + 2 for p in plans)


# ------------------------------------------------------------------ tactics


@pytest.mark.parametrize("change, tactic, confidence", [
    (dict(no_reply_pct=0.41, avg_duration_ms=72.0, avg_in_bytes=150.0, avg_out_bytes=130.0), "Reconnaissance", 0.7),
    (dict(rejected_pct=0.26, avg_duration_ms=64.0, avg_in_bytes=90.0, avg_out_bytes=75.0),
     "Reconnaissance", 0.6),
    (dict(tcp_pct=0.95, avg_bytes_per_pkt=80.0, avg_in_bytes=300.0, avg_out_bytes=300.0,
          avg_inter_flow_gap_ms=60000.0, conn_complete_pct=0.75, bytes_ratio=6.0, well_known_pct=0.1),
     "Command and Control", 0.9),
    (dict(avg_out_bytes=50000.0, bytes_ratio=0.05, avg_bytes_per_pkt=1200.0), "Exfiltration", 0.8),
    (dict(well_known_pct=0.9, tcp_pct=0.95, conn_complete_pct=0.55, bytes_ratio=6.0), "Lateral Movement", 0.8),
    (dict(ephemeral_pct=0.9, avg_duration_ms=50.0, conn_complete_pct=0.1, avg_in_bytes=100.0,
          avg_out_bytes=100.0, well_known_pct=0.0), "Discovery", 0.8),
    (dict(conn_complete_pct=0.95, well_known_pct=0.5, tcp_pct=0.6), "Normal", 0.9),
])
def test_traffic_rules(profiles, change, tactic, confidence):
    r = scoring.suggest_tactics(profiles(change)).first()
    assert (r.tactic, r.confidence) == (tactic, pytest.approx(confidence))
    assert r.reasons


def test_reasons_carry_numbers(profiles):
    r = scoring.suggest_tactics(profiles(dict(no_reply_pct=0.456, avg_duration_ms=50.0))).first()
    assert r.reasons[:2] == ["High no-reply rate (46%)", "Very short connection duration"]


def test_thresholds_are_strict(profiles):
    change = dict(no_reply_pct=0.3, rejected_pct=0.1, avg_duration_ms=100.0, avg_in_bytes=250.0,
                  avg_out_bytes=250.0, conn_complete_pct=0.0)
    rules = dict((name, tests) for name, tests, _ in scoring.TRAFFIC_RULES)
    assert len(rules) == 7
    r = scoring.suggest_tactics(profiles(change)).first()
    # only the weaker alternatives hold for Reconnaissance: 0.15 + 0.1
    assert r.confidence < 0.5


def test_nothing_scores(profiles):
    calm = dict(conn_complete_pct=0.5, no_reply_pct=0.06, bytes_ratio=5.0, avg_duration_ms=600.0, tcp_pct=0.5,
                well_known_pct=0.3, avg_bytes_per_pkt=300.0)
    r = scoring.suggest_tactics(profiles({**calm, "avg_in_bytes": 2000.0})).first()
    assert (r.tactic, r.confidence) == ("Initial Access", 0.25)
    r = scoring.suggest_tactics(profiles({**calm, "avg_in_bytes": 2000.0, "avg_duration_ms": 30000.0,
                                          "bytes_ratio": 9.0, "conn_complete_pct": 0.45})).first()
    assert r.tactic == "Initial Access"


def test_signature_rules(profiles):
    scan = dict(avg_in_bytes=100.0, avg_out_bytes=100.0, avg_duration_ms=100.0, avg_pkts_per_sec=50.0,
                well_known_pct=0.9)
    # only 1000 < duration < 30000 holds
    little = dict(avg_in_bytes=1000.0, avg_out_bytes=5000.0, bytes_ratio=0.3, avg_duration_ms=6000.0,
                   avg_pkts_per_sec=5.0, tcp_pct=0.5, udp_pct=0.05, well_known_pct=0.1, ephemeral_pct=0.4)
    rows = by_state(scoring.suggest_tactics(profiles(scan, little), rules="signature"))
    assert (rows[0].tactic, rows[0].confidence) == ("Reconnaissance", 1.0)  # Discovery ties, comes later
    assert (rows[1].tactic, rows[1].confidence) == ("Lateral Movement", 0.2)


# -------------------------------------------------------------- description


@pytest.mark.parametrize("change, text", [
    ({}, "medium-duration medium-volume predominantly TCP flows targeting mixed port ranges."),
    (dict(avg_duration_ms=99.0, avg_in_bytes=400.0, avg_out_bytes=400.0, tcp_pct=0.81, well_known_pct=0.7),
     "short-duration low-volume TCP flows bidirectional flows targeting well-known ports."),
    (dict(avg_duration_ms=10000.0, avg_in_bytes=60000.0, avg_out_bytes=0.0, tcp_pct=0.5, udp_pct=0.5,
          ephemeral_pct=0.7),
     "long-duration high-volume mixed protocol (TCP/UDP) flows inbound-heavy flows targeting ephemeral ports."),
    (dict(avg_in_bytes=0.0, avg_out_bytes=0.0, tcp_pct=0.0, udp_pct=0.0, icmp_pct=0.0, well_known_pct=0.0,
          registered_pct=0.0, ephemeral_pct=0.0),
     "medium-duration low-volume flows with unknown protocol."),
    (dict(conn_complete_pct=0.9, no_reply_pct=0.2, rejected_pct=0.06, avg_bytes_per_pkt=100.0,
          avg_inter_flow_gap_ms=100.0, icmp_pct=0.9, tcp_pct=0.05, udp_pct=0.05, avg_out_bytes=9000.0),
     "medium-duration medium-volume ICMP flows outbound-heavy flows targeting mixed port ranges"
     " with mostly completed connections with significant unanswered connection attempts"
     " with notable connection rejections with small packets consistent with signaling in rapid bursts."),
    (dict(conn_complete_pct=0.2, no_reply_pct=0.1, rejected_pct=0.05, avg_bytes_per_pkt=1001.0,
          avg_inter_flow_gap_ms=30001.0),
     "medium-duration medium-volume predominantly TCP flows targeting mixed port ranges"
     " with predominantly failed connections with large packets suggesting bulk transfer"
     " with long pauses between flows."),
])
def test_description(profiles, change, text):
    assert scoring.describe(profiles(change)).first().description == text


# ----------------------------------------------------------------- profiles


def test_compare_and_rank(profiles, spark):
    df = profiles({}, {"avg_in_bytes": 2100.0, "avg_bytes_per_pkt": 5.0, "flow_count": 10},
                  {"avg_in_bytes": 0.0, "flow_count": 500})
    row = states.compare_profiles(df, 0, 1).first()
    assert row.avg_in_bytes_delta == 50.0 and row.avg_bytes_per_pkt_delta is None
    assert states.compare_profiles(df, 2, 1).first().avg_in_bytes_delta is None
    order = lambda **k: [r.state_id for r in states.rank_profiles(df, **k).collect()]
    assert order() == [2, 0, 1]
    assert order(descending=False) == [1, 0, 2]
    assert order(sort_by="avgBytes", min_flow_count=50) == [0, 2]
    taken = spark.createDataFrame([(0,)], "state_id int")
    assert order(tactic_filter="assigned", assigned=taken) == [0]
    assert order(tactic_filter="unassigned", assigned=taken) == [2, 1]


# ------------------------------------------------- the rules and their check


def spread_profiles(n=4000, seed=11):
    """Profiles whose values lie on, just below and just above the numbers that rules compare with."""
    rng = np.random.default_rng(seed)
    shares = [0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
    sizes = [0.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0, 30000.0, 100000.0]
    pick = lambda values: np.maximum(0.0, rng.choice(values, n) + rng.choice([-0.001, 0.0, 0.001], n))
    frame = {"state_id": np.arange(n, dtype=np.int32), "flow_count": rng.choice([10, 1000, 1001], n)}
    for c in ("tcp_pct", "udp_pct", "icmp_pct", "well_known_pct", "registered_pct", "ephemeral_pct",
              "conn_complete_pct", "no_reply_pct", "rejected_pct"):
        frame[c] = pick(shares)
    for c in ("avg_in_bytes", "avg_out_bytes", "avg_bytes_per_pkt", "avg_inter_flow_gap_ms"):
        frame[c] = pick(sizes)
    frame["avg_duration_ms"] = pick([100.0, 200.0, 500.0, *sizes])
    frame["bytes_ratio"] = pick([0.1, 0.5, 1.0, 2.0, 5.0])
    frame["avg_pkts_per_sec"] = pick([2.0, 10.0])
    return pd.DataFrame(frame)


def both_ways(spark, frame, rules):
    import duckdb

    from catalog import tactics

    table, default = {"traffic": (tactics.TRAFFIC, "Normal"), "signature": (tactics.SIGNATURES, "Unknown")}[rules]
    con = duckdb.connect()
    con.register("given", frame)
    want = con.execute("WITH profiles AS (FROM given)" + tactics.tactic_sql("", "state_id", table, default)).fetchall()
    found = scoring.suggest_tactics(spark.createDataFrame(frame), rules=rules).collect()
    got = [(r.state_id, r.tactic, r.confidence, "; ".join(r.reasons)) for r in found]
    return sorted(got), sorted(want)


@pytest.mark.parametrize("rules", ["traffic", "signature"])
def test_rules_equal_the_ranges_of_the_check(spark, monkeypatch, rules):
    frame = spread_profiles()
    got, want = both_ways(spark, frame, rules)
    assert got == want and len({g[1] for g in got}) >= 5
    table, default = scoring.RULE_SETS[rules]
    for tactic in (0, 3, len(table) - 1):  # another threshold, another score: the check sees it
        name, tests, otherwise = table[tactic]
        condition, score, *rest = tests[0][0]
        words = condition.split()
        moved = " ".join([*words[:2], str(float(words[2]) * 1.5 + 0.05), *words[3:]])
        for first in ((moved, score, *rest), (condition, score + 0.2, *rest)):
            changed = [*table]
            changed[tactic] = (name, [[first, *tests[0][1:]], *tests[1:]], otherwise)
            monkeypatch.setitem(scoring.RULE_SETS, rules, (changed, default))
            got, want = both_ways(spark, frame, rules)
            assert got != want
            monkeypatch.setitem(scoring.RULE_SETS, rules, (table, default))

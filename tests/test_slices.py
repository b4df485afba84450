"""Ordered operators on skewed data equal their undivided forms."""

import random

import pytest
from pyspark.sql import Window, functions as F

from flowlens.functions.slices import SLICE, TimeSlices, time_slices, with_previous_start
from flowlens.operators import sessions, states

MIN = 60_000


def skewed(make_flows, n=1500, crowd=True):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.5
        start = 1_000_000 + rng.randrange(3_000) * 40_000
        if crowd and rng.random() < 0.35:
            start = 50_000_000  # a third of everything in one instant
        rows.append({
            "FLOW_ID": rng.randrange(10**15),
            "FLOW_START_MILLISECONDS": start,
            "IPV4_SRC_ADDR": "hot" if hot else f"s{rng.randrange(9)}",
            "IPV4_DST_ADDR": "hot" if hot else (None if rng.random() < 0.1 else f"d{rng.randrange(9)}"),
            "HMM_STATE": rng.choice([0, 1, 2, None]),
        })
    return make_flows(rows).cache()


@pytest.mark.parametrize("crowd", [False, True])
def test_slices_follow_time_and_are_even(make_flows, crowd):
    f = skewed(make_flows, crowd=crowd)
    slices = time_slices(f, rows_per_slice=100)
    sliced = slices.attach(f)
    sizes = [r["count"] for r in sliced.groupBy(SLICE).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 200
    spans = sliced.groupBy(SLICE).agg(
        F.min(F.struct("FLOW_START_MILLISECONDS", "FLOW_ID")).alias("lo"),
        F.max(F.struct("FLOW_START_MILLISECONDS", "FLOW_ID")).alias("hi"),
    ).orderBy(SLICE).collect()
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("crowd", [False, True])
def test_previous_start_equals_lag(make_flows, crowd):
    f = skewed(make_flows, crowd=crowd)
    w = Window.partitionBy("IPV4_DST_ADDR").orderBy("FLOW_START_MILLISECONDS", "FLOW_ID")
    want = f.select("FLOW_ID", F.lag("FLOW_START_MILLISECONDS").over(w).alias("p"))
    got = with_previous_start(f, ["IPV4_DST_ADDR"], "p", time_slices(f, 50)).select("FLOW_ID", "p")
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


@pytest.mark.parametrize("by", ["HMM_STATE", "IPV4_SRC_ADDR"])
@pytest.mark.parametrize("crowd", [False, True])
def test_profile_gaps_equal_brute_force(make_flows, by, crowd):
    f = skewed(make_flows, crowd=crowd)
    rows = [r for r in f.collect() if r[by] is not None]
    last, sums, counts = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.FLOW_START_MILLISECONDS, r.FLOW_ID)):
        gap = r.FLOW_START_MILLISECONDS - last.get(r.IPV4_DST_ADDR, r.FLOW_START_MILLISECONDS)
        last[r.IPV4_DST_ADDR] = r.FLOW_START_MILLISECONDS
        sums[r[by]] = sums.get(r[by], 0) + gap
        counts[r[by]] = counts.get(r[by], 0) + 1
    labelled = f.where(F.col(by).isNotNull())
    for slices in (None, TimeSlices(), time_slices(labelled, 50)):
        got = states.traffic_profiles(f, by=by, slices=slices).collect()
        assert {r[0]: r.flow_count for r in got} == counts
        assert {r[0]: r.avg_inter_flow_gap_ms for r in got} == pytest.approx({k: sums[k] / counts[k] for k in sums})


def test_profile_gaps_of_missing_starts_are_zero(make_flows):
    starts = [None, 5, None, 9, None, 30]
    f = make_flows([{"FLOW_ID": i, "HMM_STATE": i % 2} for i in range(6)]).drop("FLOW_START_MILLISECONDS")
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("FLOW_ID").cast("int") + 1)
    f = f.withColumn("FLOW_START_MILLISECONDS", start)
    for slices in (TimeSlices(), TimeSlices([9.0, 20.0]), TimeSlices([5.0, 9.0, 30.0])):
        got = {r.state_id: r.avg_inter_flow_gap_ms for r in states.traffic_profiles(f, slices=slices).collect()}
        assert got == {0: 0.0, 1: pytest.approx((4 + 21) / 3)}


def test_profiles_of_no_flows(make_flows):
    assert states.traffic_profiles(skewed(make_flows, n=20).where("FLOW_ID < 0")).count() == 0


def test_slices_are_chosen_in_one_pass(spark, make_flows):
    """A table that needs no finer sketch is read once."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    f = skewed(make_flows, crowd=False).select("FLOW_ID", "FLOW_START_MILLISECONDS")
    assert len(time_slices(f.mapInArrow(read, f.schema)).bounds) >= 3
    assert seen.value == 1500


@pytest.mark.parametrize("scope", ["global", "host"])
def test_transitions_equal_brute_force(make_flows, scope):
    f = skewed(make_flows)
    rows = sorted(
        (r for r in f.collect() if r.HMM_STATE is not None),
        key=lambda r: (r.FLOW_START_MILLISECONDS, r.FLOW_ID),
    )
    want, last = {}, {}
    for r in rows:
        key = r.IPV4_DST_ADDR if scope == "host" else 0
        if key in last:
            pair = (last[key], r.HMM_STATE)
            want[pair] = want.get(pair, 0) + 1
        last[key] = r.HMM_STATE
    labelled = f.where("HMM_STATE IS NOT NULL")
    got = states.state_transitions(f, scope, slices=time_slices(labelled, 60)).collect()
    assert {(r.from_state, r.to_state): r["count"] for r in got} == want


def test_gap_sessions_equal_brute_force(make_flows):
    f = skewed(make_flows)
    want = []
    by_source = {}
    for r in f.collect():
        by_source.setdefault(r.IPV4_SRC_ADDR, []).append(r.FLOW_START_MILLISECONDS)
    for src, starts in by_source.items():
        starts.sort()
        run = [starts[0]]
        for s in starts[1:]:
            if s - run[-1] > 30 * MIN:
                want.append((src, run[0], run[-1], len(run)))
                run = []
            run.append(s)
        want.append((src, run[0], run[-1], len(run)))
    got = sessions.gap_sessions(f, slices=time_slices(f, 60)).collect()
    assert sorted((r.src_ip, r.session_start, r.last_start, r.flow_count) for r in got) == sorted(want)


def test_gap_boundary(make_flows):
    f = make_flows([{"FLOW_START_MILLISECONDS": t} for t in (0, 30 * MIN, 60 * MIN + 1)])
    got = sessions.gap_sessions(f).orderBy("session_no").collect()
    assert [(r.session_no, r.flow_count) for r in got] == [(1, 2), (2, 1)]


def test_session_range_join_handles_long_spans(spark, make_flows):
    f = make_flows([
        {"FLOW_START_MILLISECONDS": t * MIN, "IPV4_SRC_ADDR": "hot" if t % 3 else "b"} for t in range(0, 300)
    ])
    spans = spark.createDataFrame(
        [("x", "hot", 10 * MIN, 200 * MIN), ("y", "hot", 100 * MIN, 120 * MIN), ("z", "b", 0, MIN)],
        "session_id string, src_ip string, start_time long, end_time long",
    )
    got = sessions.flows_in_sessions(f, spans).select("session_id", "FLOW_ID").collect()
    want = [
        (s.session_id, r.FLOW_ID)
        for s in spans.collect() for r in f.collect()
        if r.IPV4_SRC_ADDR == s.src_ip and r.FLOW_START_MILLISECONDS >= s.start_time
        and r.FLOW_END_MILLISECONDS <= s.end_time
    ]
    assert sorted(map(tuple, got)) == sorted(want)

"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from flowlens.functions.predicates import FlowFilter, flow_filter
from flowlens.functions.slices import time_slices
from flowlens.operators import features, filters, sessions, states, summaries
from flowlens.session import scratch_path
from flowlens.sources.writers import write_flows


@pytest.fixture(scope="module")
def table(spark, fixture_flows):
    path = scratch_path(spark, "t-plan")
    write_flows(fixture_flows, path)
    return spark.read.parquet(path)


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def scanned(text) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>\n", text)]


def test_timeline_reads_two_columns(table):
    text = plan(summaries.timeline(table, where=F.col("Attack") != "Benign"))
    assert scanned(text) == [{"FLOW_START_MILLISECONDS", "Attack"}]
    assert "PushedFilters: [IsNotNull(Attack), Not(EqualTo(Attack,Benign))]" in text


def test_filters_reach_the_scan_and_prune_dates(table):
    spec = FlowFilter(start=1709300000000, end=1709400000000, src_ips=["10.0.0.5"])
    text = plan(filters.flow_page(table, flow_filter(spec, "flow_date")))
    assert "GreaterThanOrEqual(FLOW_START_MILLISECONDS,1709300000000)" in text
    assert "EqualTo(IPV4_SRC_ADDR,10.0.0.5)" in text
    assert re.search(r"PartitionFilters: \[.*flow_date", text)
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("make", [
    lambda f: summaries.top_talkers(f, "src", "bytes"),
    lambda f: summaries.network_edges(f),
    lambda f: summaries.port_scanners(f),
])
def test_rankings_never_sort_everything(table, make):
    text = plan(make(table))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_global_transitions_keep_flows_apart(table):
    """The only single-partition window is the one over slice edges."""
    labelled = table.where("HMM_STATE IS NOT NULL")
    text = plan(states.state_transitions(table, slices=time_slices(labelled)))
    assert text.count("SinglePartition") == 1
    edge = text[: text.index("SinglePartition")]
    assert "first" in edge.splitlines()[-2] + edge.splitlines()[-1]
    assert not re.search(r"\(\d+\) (CartesianProduct|BroadcastNestedLoopJoin)", text)


def test_ordered_features_shuffle_flows_once(table):
    text = plan(features.flow_features(table, slices=time_slices(table)))
    exchanges = re.findall(r"hashpartitioning\((.*?)\)", text)
    # flows by (destination, slice); slice ends by (destination, slice), then by destination
    assert len(exchanges) == 3 and "SinglePartition" not in text
    assert not any("L4_SRC_PORT" in cols for cols in scanned(text))


def test_profiles_order_only_what_gaps_need(table):
    """Bytes, packets and flags are summed up where they are read."""
    text = plan(states.traffic_profiles(table, by="SERVICE", slices=time_slices(table, 1000)))
    assert text.count("hashpartitioning(_slice") == 1
    read = [cols for cols in scanned(text) if "FLOW_ID" in cols]
    assert len(read) == 1 and not any("BYTES" in c or "PROTOCOL" in c for c in read)


def test_targets_are_cut_before_the_shuffle(table):
    assert "WindowGroupLimit" not in plan(sessions.attack_sessions(table))  # all targets are asked for
    text = plan(sessions.attack_sessions(table, max_targets=10, max_ports=20))
    assert "WindowGroupLimit" in text
    # the newest sessions lie in a short span, and only that is read
    assert "GreaterThanOrEqual(FLOW_START_MILLISECONDS," in text
    assert not re.search(r"\(\d+\) (CartesianProduct|BroadcastNestedLoopJoin)", text)


def test_range_join_is_an_equi_join(table):
    found = sessions.attack_sessions(table, limit=None)
    text = plan(sessions.flows_in_sessions(table, found))
    assert not re.search(r"\(\d+\) (CartesianProduct|BroadcastNestedLoopJoin)", text)


def test_range_join_reads_the_span_of_its_sessions(table):
    """Dates and times outside the sessions are not read, flows of other sources not shuffled."""
    found = sessions.attack_sessions(table, limit=3, targets=False)
    first, last = found.agg(F.min("start_time"), F.max("end_time")).first()
    text = plan(sessions.flows_in_sessions(table, found))
    assert f"GreaterThanOrEqual(FLOW_START_MILLISECONDS,{first})" in text
    assert f"LessThanOrEqual(FLOW_END_MILLISECONDS,{last})" in text
    assert re.search(r"PartitionFilters: \[.*flow_date", text)
    assert re.search(r"BroadcastHashJoin.*LeftSemi|LeftSemi.*BroadcastHashJoin", text.replace("\n", " "))
    assert "_salt" not in text  # nothing here needs more than one task


def test_salts_follow_measured_rows(table, fixture_flows):
    """A hot source is split by as many salts as its rows need, and no flow is lost or doubled."""
    hot = {(r.IPV4_SRC_ADDR, r._bucket): r._salts for r in sessions.hot_buckets(table, 1_800_000, 3).collect()}
    counts = table.groupBy("IPV4_SRC_ADDR", F.expr("FLOW_START_MILLISECONDS div 1800000 AS b")).count().collect()
    assert hot and hot == {(r.IPV4_SRC_ADDR, r.b): -(-r["count"] // 3) for r in counts if r["count"] > 3}
    found = sessions.attack_sessions(table, limit=None, targets=False)
    plain = sessions.flows_in_sessions(table, found).select("session_id", "FLOW_ID")
    salted = sessions.flows_in_sessions(table, found, rows_per_salt=1)
    assert "_salt" in plan(salted)
    salted = salted.select("session_id", "FLOW_ID")
    assert plain.count() == salted.count() > 0 and plain.exceptAll(salted).isEmpty()


def test_dedup_takes_one_scan_and_one_exchange(table):
    text = plan(summaries.dedup_flows(table))
    tree = text[: text.index("\n\n")]
    assert tree.count("Exchange") == 1 and tree.count("Scan parquet") == 1 and "Join" not in tree


def test_pages_read_two_columns_first(table):
    """The rows of a page are found on (start, flow id); whole rows come from the span of the page only."""
    where = F.col("PROTOCOL") == 6
    text = plan(filters.page_rows(table, where, 50, 100))
    assert scanned(text) == [{"FLOW_START_MILLISECONDS", "FLOW_ID", "PROTOCOL"}] and "TakeOrderedAndProject" in text
    starts = [r.FLOW_START_MILLISECONDS for r in filters.page_rows(table, where, 50, 100).collect()]
    text = plan(filters.flow_page(table, where, 50, 100))
    assert f"GreaterThanOrEqual(FLOW_START_MILLISECONDS,{min(starts)})" in text
    assert f"LessThanOrEqual(FLOW_START_MILLISECONDS,{max(starts)})" in text
    assert re.search(r"PartitionFilters: \[.*flow_date", text)


def test_samples_are_cut_before_the_shuffle(table):
    assert "WindowGroupLimit" in plan(states.state_samples(table))
    assert "WindowGroupLimit" in plan(states.state_top_hosts(table))


def test_model_rounds_do_not_shuffle_flows(spark, table):
    from flowlens.plans import hmm

    seqs = hmm.sequences(features.flow_features(table))
    model = hmm.init_model(seqs, 2)
    task = hmm._statistics_task({2: model}, seqs.features, seqs.ids)
    out = seqs.rows.select("dst_ip", "run", "chunk", *seqs.features).mapInPandas(
        task, "m int, pos int, value double"
    )
    text = plan(out)
    above_cache = text[: text.index("InMemoryRelation")] if "InMemoryRelation" in text else text
    assert "InMemoryTableScan" in text and "Exchange" not in above_cache
    seqs.unpersist()


def test_dedup_with_large_tuples_gives_the_same(spark, make_flows, monkeypatch):
    """Tuples with a large share of the rows are merged apart from the others; a page moves only tuples and times."""
    rows = [dict(IPV4_SRC_ADDR="10.0.0.9", Label="Attack", Attack="Discovery") for _ in range(30)]
    rows += [dict(L4_SRC_PORT=i % 20, SERVICE=None) for i in range(40)]
    f = make_flows(rows)
    whole = lambda df: sorted(map(str, df.collect()))
    flows, page = whole(summaries.dedup_flows(f)), whole(summaries.dedup_page(f, limit=5, offset=3))
    monkeypatch.setattr(summaries, "PARTITION_ROWS", 10)
    monkeypatch.setattr(summaries, "LARGE_SHARE", 0.2)
    assert len(summaries._apart(f)) == 2 and len(flows) == 21 and len(page) == 5
    assert whole(summaries.dedup_flows(f)) == flows and whole(summaries.dedup_page(f, limit=5, offset=3)) == page

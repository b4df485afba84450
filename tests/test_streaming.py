"""Live jobs equal their batch forms on the same rows."""

import pytest

from flowlens.operators.sessions import gap_sessions
from flowlens.operators.summaries import timeline
from flowlens.schema import FLOW_ID
from flowlens.session import scratch_path
from flowlens.streaming import jobs
from tests.conftest import SF

WEEK = 7 * 86_400_000


@pytest.fixture
def landed(spark):
    """Flows in two deliveries (earlier and later half) and a far-off last flow."""
    from flow_fixture import flows

    f = flows(spark, SF)
    middle = 1709251200000 + WEEK // 2
    first = f.where(f.FLOW_START_MILLISECONDS < middle)
    second = f.where(f.FLOW_START_MILLISECONDS >= middle)
    last = f.limit(1).selectExpr(
        *[c if c not in ("FLOW_START_MILLISECONDS", FLOW_ID) else
          ("FLOW_START_MILLISECONDS + 864000000 AS FLOW_START_MILLISECONDS"
           if c != FLOW_ID else f"-1L AS {FLOW_ID}") for c in f.columns]
    )
    return f, [first, second, last]


def deliver(folder, rows):
    rows.coalesce(2).write.mode("append").parquet(folder)


def run_all(spark, landed, make, name):
    f, parts = landed
    folder, out, state = (scratch_path(spark, f"{name}-{n}") for n in ("in", "out", "state"))
    for part in parts:
        deliver(folder, part)
        live = make(jobs.stream_flows(spark, folder, f.schema))
        table = jobs.run_to_table(live, out, state)
    return table


def rows(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_live_timeline(spark, landed):
    got = run_all(spark, landed, jobs.live_timeline, "t-tl")
    columns = ["time", "attack", "count"]
    assert rows(got, columns) == rows(timeline(landed[0]), columns)


def test_live_sessions(spark, landed):
    got = run_all(spark, landed, jobs.live_sessions, "t-gs")
    columns = ["src_ip", "session_start", "last_start", "session_end", "flow_count", "total_bytes"]
    assert rows(got, columns) == rows(gap_sessions(landed[0]), columns)


def test_rows_behind_the_watermark_are_dropped(spark, make_flows):
    folder, out, state = (scratch_path(spark, f"t-late-{n}") for n in ("in", "out", "state"))
    hour = 3_600_000
    make = lambda ts: make_flows([{"FLOW_START_MILLISECONDS": t} for t in ts])
    schema = make([0]).schema
    for ts in ([0, hour, 5 * hour], [10, 6 * hour], [9 * hour]):
        deliver(folder, make(ts))
        table = jobs.run_to_table(
            jobs.live_timeline(jobs.stream_flows(spark, folder, schema)), out, state
        )
    assert rows(table, ["time", "count"]) == [(0, 1), (hour, 1), (5 * hour, 1), (6 * hour, 1)]


def ingest(spark, folder, table, state, schema, **more):
    jobs.ingest_new_files(spark, folder, table, state, schema, files_per_batch=1, **more).awaitTermination()


def test_ingest_takes_each_file_once(spark, make_flows):
    folder, table, state = (scratch_path(spark, f"t-in-{n}") for n in ("in", "table", "state"))
    f = make_flows([{"IN_BYTES": i} for i in range(40)]).drop(FLOW_ID)
    for part in (f.where("IN_BYTES < 10"), f.where("IN_BYTES >= 10")):
        deliver(folder, part)
        for _ in range(2):  # the second run finds nothing new
            ingest(spark, folder, table, state, f.schema)
    out = jobs.ingested(spark, table)
    assert out.count() == 40 and out.select(FLOW_ID).distinct().count() == 40
    assert sorted(r.IN_BYTES for r in out.collect()) == list(range(40))
    notes = [tuple(r) for r in jobs._noted(spark, table).orderBy("batch").collect()]
    assert sum(n[1] for n in notes) == 40 and all(a[2] <= b[2] for a, b in zip(notes, notes[1:]))


DAY = 86_400_000


def test_a_repeated_batch_replaces_its_rows(spark, make_flows):
    """As after a failure between writing a batch and ending it; other batches and dates stay as they are."""
    folder, table, state = (scratch_path(spark, f"t-again-{n}") for n in ("in", "table", "state"))
    f = make_flows([{"IN_BYTES": i, "FLOW_START_MILLISECONDS": DAY * (19_700 + i % 3)} for i in range(12)]).drop(FLOW_ID)
    for low in (0, 6):
        f.where(f"IN_BYTES >= {low} AND IN_BYTES < {low + 6}").coalesce(1).write.mode("append").parquet(folder)
        ingest(spark, folder, table, state, f.schema)
    before = rows(jobs.ingested(spark, table), [FLOW_ID, "IN_BYTES"])
    again = jobs.with_flow_id(spark.read.parquet(folder).where("IN_BYTES >= 6"), jobs._next_id(spark, table, 1))
    jobs.write_flows(again, table, batch=1)
    assert [b for _, b in rows(jobs.ingested(spark, table), [FLOW_ID, "IN_BYTES"])] == [b for _, b in before]
    assert len({i for i, _ in rows(jobs.ingested(spark, table), [FLOW_ID, "IN_BYTES"])}) == 12


def test_a_batch_is_seen_when_it_is_noted(spark, make_flows):
    table = scratch_path(spark, "t-noted")
    f = make_flows([{"IN_BYTES": i} for i in range(4)])
    jobs.write_flows(f, table, batch=0)
    jobs._note_batch(spark, table, 0, 0)
    jobs.write_flows(f, table, batch=1)  # and no note yet
    assert spark.read.parquet(table).count() == 8 and jobs.ingested(spark, table).count() == 4


def test_ingest_into_a_loaded_table(spark, make_flows):
    from flowlens.sources.writers import load

    source, folder, table, state = (scratch_path(spark, f"t-loaded-{n}") for n in ("src", "in", "table", "state"))
    f = make_flows([{"IN_BYTES": i} for i in range(10)]).drop(FLOW_ID)
    f.where("IN_BYTES < 5").write.parquet(source)
    load(spark, source, table, for_ingest=True)
    deliver(folder, f.where("IN_BYTES >= 5"))
    ingest(spark, folder, table, state, f.schema)
    out = jobs.ingested(spark, table)
    assert rows(out, ["IN_BYTES"]) == [(i,) for i in range(10)] and out.select(FLOW_ID).distinct().count() == 10
    other = scratch_path(spark, "t-loaded-plain")
    load(spark, source, other)
    with pytest.raises(ValueError, match="for_ingest"):
        jobs._next_id(spark, other, 0)


def test_ingested_dates_are_pruned(spark, make_flows):
    from flowlens.functions.predicates import FlowFilter, flow_filter
    from tests.test_plans import plan

    table = scratch_path(spark, "t-prune")
    f = make_flows([{"FLOW_START_MILLISECONDS": DAY * (19_700 + i)} for i in range(5)])
    jobs.write_flows(f, table, batch=0)
    jobs._note_batch(spark, table, 0, 0)
    spec = FlowFilter(start=DAY * 19_701, end=DAY * 19_703)
    hits = jobs.ingested(spark, table).where(flow_filter(spec, "flow_date"))
    text = plan(hits)
    filters = text[text.index("PartitionFilters") :].split("\n")[0]
    assert "flow_date" in filters and "ingest_batch" in filters and hits.count() == 2


def test_ids_that_do_not_fit_are_refused(spark, make_flows):
    from flowlens.sources.readers import MAX_ID, with_flow_id

    f = make_flows([{}] * 3).drop(FLOW_ID)
    assert with_flow_id(f, 7).count() == 3
    with pytest.raises(OverflowError):
        with_flow_id(f, MAX_ID - 5)


def keep(spark, folder, schema, part, name):
    view, state = scratch_path(spark, f"{name}-view"), scratch_path(spark, f"{name}-state")

    def run():
        live = jobs.stream_flows(spark, folder, schema, files_per_batch=1)
        jobs.keep_view(live, part, view, state).awaitTermination()
        return view

    return run


SESSION = ["src_ip", "session_start", "last_start", "session_end", "flow_count", "total_bytes"]


def test_views_equal_batch_results_with_late_files(spark, landed):
    """Later and earlier halves in the wrong order, a second run, and an untouched input folder."""
    f, (first, second, _) = landed
    folder = scratch_path(spark, "t-view-in")
    timelines = keep(spark, folder, f.schema, jobs.timeline_part(), "t-tl-view")
    sessions = keep(spark, folder, f.schema, jobs.sessions_part(), "t-gs-view")
    for part in (second, first):
        deliver(folder, part)
        timelines(), sessions()
    assert spark.read.parquet(folder).count() == f.count()
    got = jobs.timeline_view(spark, timelines())
    assert rows(got, ["time", "attack", "count"]) == rows(timeline(f), ["time", "attack", "count"])
    assert rows(jobs.sessions_view(spark, sessions()), SESSION) == rows(gap_sessions(f), SESSION)


def test_merged_parts_stand_for_their_batches(spark, landed):
    """Merging between deliveries changes no result; a merge that is not whole is passed over."""
    f, (first, second, _) = landed
    folder = scratch_path(spark, "t-merge-in")
    timelines = keep(spark, folder, f.schema, jobs.timeline_part(), "t-tl-merge")
    sessions = keep(spark, folder, f.schema, jobs.sessions_part(), "t-gs-merge")
    for part in (second, first):
        deliver(folder, part)
        hours, runs = timelines(), sessions()
        assert jobs.merge_parts(spark, hours, jobs.merged_timeline) == jobs.merge_parts(spark, hours, jobs.merged_timeline)
        last = jobs.merge_parts(spark, runs, jobs.merged_sessions())
        assert jobs._merged_upto(spark, runs) == last and len(jobs._parts(spark, runs).inputFiles()) >= 1
        assert not any("batch=" in name for name in jobs._parts(spark, runs).inputFiles())
    spark.range(1).write.parquet(f"{hours}/merged/upto=99")
    place, files = jobs.located(spark, f"{hours}/merged/upto=99/_SUCCESS")
    files.delete(place, False)
    got = jobs.timeline_view(spark, hours)
    assert rows(got, ["time", "attack", "count"]) == rows(timeline(f), ["time", "attack", "count"])
    assert rows(jobs.sessions_view(spark, runs), SESSION) == rows(gap_sessions(f), SESSION)
    with pytest.raises(FileNotFoundError):
        jobs.timeline_view(spark, scratch_path(spark, "t-no-view"))


def test_sessions_of_a_hot_source_merge_across_batches(spark, make_flows):
    """A third of all flows of one source, dealt over batches so that parts interleave and enclose one another."""
    minute = 60_000
    starts = [k * 7 * minute for k in range(40)] + [2000 * minute, 2029 * minute, 2060 * minute]
    made = [{"IPV4_SRC_ADDR": "hot", "FLOW_START_MILLISECONDS": t} for t in starts]
    made += [{"IPV4_SRC_ADDR": f"s{k % 9}", "FLOW_START_MILLISECONDS": k * 11 * minute} for k in range(80)]
    f = make_flows(made)
    folder = scratch_path(spark, "t-hot-in")
    run = keep(spark, folder, f.schema, jobs.sessions_part(), "t-hot")
    for k in (2, 0, 1):
        f.where(f"FLOW_ID % 3 = {k}").coalesce(1).write.mode("append").parquet(folder)
        view = run()
    assert rows(jobs.sessions_view(spark, view), SESSION) == rows(gap_sessions(f), SESSION)
    hot = [r for r in rows(jobs.sessions_view(spark, view), SESSION) if r[0] == "hot"]
    assert [r[4] for r in hot] == [40, 2, 1]
    ended = jobs.sessions_view(spark, view, until=2031 * minute)
    assert [r[4] for r in rows(ended, SESSION) if r[0] == "hot"] == [40]
    early = rows(jobs.timeline_view(spark, keep(spark, folder, f.schema, jobs.timeline_part(), "t-early")(), until=120 * minute), ["time", "count"])
    assert {t for t, _ in early} == {0, 60 * minute}


def test_csv_stream(spark, make_flows):
    folder, table, state = (scratch_path(spark, f"t-csv-{n}") for n in ("in", "table", "state"))
    f = make_flows([{"IN_BYTES": i} for i in range(5)])
    f.write.option("header", True).csv(folder)
    jobs.ingest_new_files(spark, folder, table, state, f.schema, "csv").awaitTermination()
    assert jobs.ingested(spark, table).count() == 5


def test_quarters_are_written_by_all_tasks(spark, make_flows, tmp_path):
    """A table read by several tasks is delivered by as many, and two quarters stay one batch."""
    from catalog import behaviour

    f = make_flows([{"IN_BYTES": i} for i in range(200)]).repartition(4).localCheckpoint()
    folder = str(tmp_path / "in")
    files = behaviour._land(f, folder, 0, 3)
    assert files == 12 and behaviour._half(files, 3) == 8
    assert behaviour._land(f, folder, 3, 4) == 16
    assert rows(spark.read.parquet(folder), ["IN_BYTES"]) == [(i,) for i in range(200)]
    assert (behaviour._half(3, 3), behaviour._half(4, 4)) == (2, 2)


def test_views_hold_only_the_columns_they_need(spark, make_flows):
    for part in (jobs.timeline_part(), jobs.sessions_part()):
        f = make_flows([{"FLOW_START_MILLISECONDS": i * DAY // 4} for i in range(8)])
        assert set(part.columns) < set(f.columns)
        assert part(f.select(*part.columns)).exceptAll(part(f)).count() == 0

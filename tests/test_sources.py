import pytest
from pyspark.sql import functions as F

from flowlens.schema import FLOW_ID, FLOW_SCHEMA, conform
from flowlens.session import scratch_path
from flowlens.sources import readers, samples, writers


@pytest.mark.parametrize("headers", [
    "sa da sp dp pr ibyt obyt ipkt opkt",
    "sIP dIP sPort dPort proto bytes_in bytes_out pkts_in pkts_out",
    "Source Destination src_port dest_port IP_Protocol rxbytes txbytes rxpackets txpackets",
])
def test_header_variants(headers):
    found = readers.detect_columns(headers.split())
    assert list(found.values()) == headers.split()
    assert list(found)[:5] == [
        "IPV4_SRC_ADDR", "IPV4_DST_ADDR", "L4_SRC_PORT", "L4_DST_PORT", "PROTOCOL"
    ]


def test_files_with_other_column_order_and_empty_text(spark, tmp_path):
    from flowlens.sources.readers import read_csv

    (tmp_path / "a.csv").write_text('sa,da,ibyt,obyt,note\n1.1.1.1,2.2.2.2,10,20,""\n')
    (tmp_path / "b.csv").write_text("obyt,ibyt,da,sa,note\n200,100,4.4.4.4,3.3.3.3,\n")
    rows = read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("ibyt").collect()
    assert [(r.sa, r.ibyt, r.obyt, r.note) for r in rows] == [("1.1.1.1", 10, 20, ""), ("3.3.3.3", 100, 200, None)]


def test_first_alias_wins():
    assert readers.detect_columns(["source", "src_ip", "da"])["IPV4_SRC_ADDR"] == "src_ip"


def test_missing_address_is_an_error(spark):
    with pytest.raises(ValueError, match="IPV4_DST_ADDR"):
        readers.map_columns(spark.createDataFrame([("a", 1)], "sa string, sp int"))


def test_conform_fills_and_maps_labels(spark):
    df = spark.createDataFrame(
        [("a", "b", "1"), ("a", "b", "Normal"), ("a", "b", None), ("a", "b", "Attack")],
        "IPV4_SRC_ADDR string, IPV4_DST_ADDR string, Label string",
    )
    out = conform(df)
    assert set(out.columns) == {f.name for f in FLOW_SCHEMA.fields} - {FLOW_ID}
    assert [r.Label for r in out.collect()] == ["Attack", "Benign", None, "Attack"]


def test_csv_types(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(
        "sa,da,dp,ibyt,L7_PROTO,note,is_attack\n"
        '1.1.1.1,2.2.2.2,80,1500.0,7.5,hello,0\n'
        '1.1.1.1,2.2.2.3,bad,,x,,1\n'
    )
    rows = readers.read_flows(spark, str(path)).orderBy("IPV4_DST_ADDR").collect()
    assert (rows[0].L4_DST_PORT, rows[0].IN_BYTES, rows[0].L7_PROTO) == (80, 1500, 7.5)
    assert (rows[1].L4_DST_PORT, rows[1].IN_BYTES, rows[1].L7_PROTO) == (None, None, None)
    assert [r.Label for r in rows] == ["Benign", "Attack"] and rows[0].note == "hello"


def test_zeek_row(spark):
    log = spark.createDataFrame(
        [("1.1.1.1", "2.2.2.2", "udp", "SF", None, None, "1:x", 5.0, None, 10, None, 1, 2,
          1700000000.5, 1.25, "Duplicate", "Duplicate", "none"),
         ("1.1.1.1", "2.2.2.2", "sctp", "S0", "dns", "D", "1:y", 5.0, 53.0, None, 7, None, 2,
          1700000000.0, None, None, "none", "T1046")],
        "src_ip_zeek string, dest_ip_zeek string, proto string, conn_state string, service string,"
        " history string, community_id string, src_port_zeek double, dest_port_zeek double,"
        " orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long, ts double,"
        " duration double, label_binary string, label_tactic string, label_technique string",
    )
    a, b = readers.from_zeek(log).orderBy("L4_DST_PORT").collect()
    assert (a.PROTOCOL, a.L4_DST_PORT, a.IN_BYTES, a.OUT_BYTES) == (17, 0, 10, 0)
    assert a.FLOW_START_MILLISECONDS == 1700000000500
    assert (a.FLOW_END_MILLISECONDS, a.FLOW_DURATION_MILLISECONDS) == (1700000001750, 1250)
    assert (a.Label, a.Attack, a.MITRE_TACTIC, a.MITRE_TECHNIQUE) == ("Attack", "Unknown", "", "")
    assert (b.PROTOCOL, b.Label, b.Attack, b.MITRE_TECHNIQUE) == (0, "Benign", "Benign", "T1046")
    assert (b.MAX_TTL, b.MAX_IP_PKT_LEN, b.MIN_TTL, b.SERVICE) == (64, 1500, 0, "dns")


def test_load_append_gives_unique_ids(spark, make_flows):
    parts = [scratch_path(spark, f"t-{i}") for i in range(3)]
    for i, part in enumerate(parts):
        make_flows([{"IN_BYTES": i}] * 50).drop(FLOW_ID).repartition(3).write.parquet(part)
    table = scratch_path(spark, "t-table")
    writers.load(spark, parts[0], table)
    writers.append(spark, parts[1], table)
    out = writers.append(spark, parts[2], table)
    assert out.count() == 150
    assert out.select(FLOW_ID).distinct().count() == 150
    assert "flow_date" in out.columns
    again = writers.load(spark, parts[0], table)  # replaces
    assert again.count() == 50


def test_save_table(spark, make_flows):
    writers.save_table(make_flows([{}] * 2), "t_flows", scratch_path(spark, "t-catalog"))
    assert spark.table("t_flows").count() == 2
    spark.sql("DROP TABLE t_flows")


def test_stratified_sample_is_exact_and_keeps_the_group(spark):
    f = spark.range(20_000).select(
        F.col("id").alias(FLOW_ID),
        F.when(F.col("id") % 10 < 8, "Benign").when(F.col("id") % 10 == 8, "DoS").alias("Attack"),
    )
    out = samples.stratified_sample(f, target=1000)
    counts = {r.Attack: r["count"] for r in out.groupBy("Attack").count().collect()}
    assert counts == {"Benign": 800, "DoS": 100, None: 100}
    assert out.select(FLOW_ID).distinct().count() == 1000
    same = samples.stratified_sample(f.repartition(7), target=1000)
    assert out.exceptAll(same).isEmpty()
    other = samples.stratified_sample(f, target=1000, seed=7)
    assert not out.exceptAll(other).isEmpty()
    everything = samples.stratified_sample(f, target=10**6)
    assert everything.count() == 20_000


@pytest.mark.parametrize("bits, ranked", [(14, 100_000), (3, 5), (2, 1), (20, 2)])
def test_stratified_sample_takes_the_smallest_hashes(spark, monkeypatch, bits, ranked):
    """Rounds of counting and ranks of a few rows give the sample of a full sort, groups without a name too."""
    monkeypatch.setattr(samples, "ROUND_BITS", bits)
    monkeypatch.setattr(samples, "RANKED_ROWS", ranked)
    f = spark.range(600).selectExpr(
        f"id AS {FLOW_ID}", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS Attack"
    ).repartition(3)
    rows = f.withColumn("h", samples._key(42)).collect()
    want = set()
    for group in (None, "a", "b"):
        mine = sorted((r.h, r[FLOW_ID]) for r in rows if r.Attack == group)
        want |= {i for _, i in mine[: int(100 * len(mine) / 600)]}
    got = [r[FLOW_ID] for r in samples.stratified_sample(f, target=100).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert samples.stratified_sample(f.limit(0)).count() == 0


def test_random_sample(spark):
    f = spark.range(1000).withColumnRenamed("id", FLOW_ID)
    a = samples.random_sample(f, 50)
    assert a.count() == 50 and a.exceptAll(samples.random_sample(f.repartition(5), 50)).isEmpty()


def test_assignments_keep_the_rest(spark, make_flows):
    f = make_flows([{"HMM_STATE": 1}, {"HMM_STATE": None}, {"HMM_STATE": 3, "MITRE_TACTIC": "old"}])
    new = spark.createDataFrame([(1, 7)], "FLOW_ID long, HMM_STATE int")
    out = writers.assign_states(f, new)
    assert [r.HMM_STATE for r in out.orderBy(FLOW_ID).collect()] == [1, 7, 3]
    out = writers.assign_tactics(out, {7: "Impact"})
    assert [r.MITRE_TACTIC for r in out.orderBy(FLOW_ID).collect()] == [None, "Impact", "old"]
    assert out.columns == f.columns or set(out.columns) == set(f.columns)


def test_weeks_are_written_in_one_pass(spark):
    import catalog
    import catalog.basics  # noqa: F401
    from flowlens import session

    before = len(session._scratch)
    catalog.QUERIES["S10_concat_weeks"](spark, "/root/testdata/sf0.001")
    assert len(session._scratch) == before + 1

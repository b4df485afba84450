import pytest

from flowlens.functions import predicates as p
from flowlens.operators import filters
from flowlens.plans.sqlapi import is_read_only, query


def ids(df):
    return sorted(r.FLOW_ID for r in df.select("FLOW_ID").collect())


def test_empty_predicates_keep_all_rows(make_flows):
    f = make_flows([{}, {}])
    nothing = p.all_of(p.is_in("Attack", []), p.in_range("IN_BYTES"), p.contains("Attack", "  "),
                       p.custom(""), p.flow_filter(p.FlowFilter()), p.column_filters({}))
    assert ids(f.where(nothing)) == [0, 1]


def test_contains_takes_wildcards_literally(make_flows):
    f = make_flows([{"SERVICE": "50%_x"}, {"SERVICE": "50abx"}, {"SERVICE": None}])
    assert ids(f.where(p.contains("SERVICE", "%_"))) == [0]


def test_range_is_inclusive(make_flows):
    f = make_flows([{"IN_BYTES": b} for b in (9, 10, 20, 21)])
    assert ids(f.where(p.in_range("IN_BYTES", 10, 20))) == [1, 2]
    assert ids(f.where(p.in_range("IN_BYTES", high=10))) == [0, 1]


def test_quotes_are_data(make_flows):
    f = make_flows([{"Attack": "O'Brien"}, {"Attack": "x' OR '1'='1"}])
    assert ids(f.where(p.compare("Attack", "=", "O'Brien"))) == [0]
    assert ids(f.where(p.is_in("Attack", ["x' OR '1'='1"]))) == [1]


def test_unknown_operator():
    with pytest.raises(ValueError):
        p.compare("IN_BYTES", "LIKE", 1)


@pytest.mark.parametrize("text", [
    "1=1; DROP TABLE flows", "IN_BYTES > 1 -- x", "IN_BYTES /* x */ > 1", "x UNION SELECT 1",
    "Attack = '' OR '1'='1'", "delete from flows", "Alter x", "1;truncate t",
    "SERVICE = ';drop'",
])
def test_custom_refuses_statements(text):
    with pytest.raises(ValueError):
        p.custom(text)


def test_custom_allows_semicolons_in_text(make_flows):
    f = make_flows([{"SERVICE": "a;b"}, {"SERVICE": "ab"}])
    assert ids(f.where(p.custom("SERVICE = 'a;b'"))) == [0]


def test_custom_keeps_precedence(make_flows):
    f = make_flows([{"IN_BYTES": 1}, {"IN_BYTES": 5, "PROTOCOL": 17}, {"IN_BYTES": 9}])
    both = p.all_of(p.compare("PROTOCOL", "=", 6), p.custom("IN_BYTES = 5 OR IN_BYTES = 9"))
    assert ids(f.where(both)) == [2]


def test_date_column_prunes_but_does_not_change_rows(spark, make_flows):
    from flowlens.sources.writers import with_flow_date

    day = 86_400_000
    f = with_flow_date(make_flows([{"FLOW_START_MILLISECONDS": i * day} for i in range(5)]))
    spec = p.FlowFilter(start=day, end=3 * day + 2000)
    assert ids(f.where(p.flow_filter(spec, "flow_date"))) == ids(f.where(p.flow_filter(spec))) == [1, 2, 3]


def test_long_value_lists_join(spark, make_flows):
    f = make_flows([{"IPV4_SRC_ADDR": a} for a in "abca"])
    values = spark.createDataFrame([("a",), ("c",), ("a",)], "v string")
    assert ids(p.any_value_join(f, "IPV4_SRC_ADDR", values)) == [0, 2, 3]


def test_filter_by_label(make_flows):
    f = make_flows([{"L4_DST_PORT": 22}, {"Attack": "DoS"}])
    assert ids(filters.filter_by(f, "Dst Port", "22")) == [0]
    assert ids(filters.filter_by(f, " attack ", "DoS")) == [1]
    with pytest.raises(ValueError):
        filters.filter_by(f, "colour", "red")


def test_pages_do_not_overlap(make_flows):
    f = make_flows([{"FLOW_START_MILLISECONDS": 5000 - i // 3} for i in range(20)])
    pages = [filters.flow_page(f, limit=6, offset=o).collect() for o in (0, 6, 12, 18)]
    seen = [r.FLOW_ID for page in pages for r in page]
    assert len(seen) == 20 and len(set(seen)) == 20
    walked, after = [], None
    while True:
        page = filters.flow_page(f, limit=6, after=after).collect()
        if not page:
            break
        walked += [r.FLOW_ID for r in page]
        after = (page[-1].FLOW_START_MILLISECONDS, page[-1].FLOW_ID)
    assert walked == seen


def test_sql_is_read_only(make_flows):
    assert is_read_only("select 1") and is_read_only(" WITH x AS (SELECT 1) SELECT * FROM x")
    for text in ("DROP TABLE flows", "SELECT 1; DELETE FROM flows", "EXPLAIN SELECT 1", "SELECTED"):
        assert not is_read_only(text)
    assert is_read_only("SELECT updated_at FROM flows")
    f = make_flows([{}] * 3)
    with pytest.raises(ValueError):
        query(f, "CREATE TABLE x AS SELECT 1")
    assert query(f, "SELECT * FROM flows", max_rows=2).count() == 2


def test_sql_reads_only_the_view(spark, make_flows):
    f = make_flows([{}] * 2)
    for text in (
        "SELECT TRANSFORM(FLOW_ID) USING 'cat' AS (x STRING) FROM flows",
        "SELECT reflect('java.lang.System', 'currentTimeMillis') FROM flows",
        "SELECT (SELECT java_method('java.lang.System', 'currentTimeMillis')) FROM flows",
        "SELECT * FROM parquet.`/tmp/x`",
        "SELECT * FROM other",
        "WITH a AS (SELECT * FROM other) SELECT * FROM a",
        "SELECT * FROM flows WHERE FLOW_ID IN (SELECT x FROM other)",
    ):
        with pytest.raises(ValueError):
            query(f, text)
    assert query(f, "WITH a AS (SELECT FLOW_ID FROM flows) SELECT max(FLOW_ID) FROM a").count() == 1
    spark.range(3).createOrReplaceTempView("hidden")
    for text in (  # a name is known only inside the WITH that defines it
        "SELECT * FROM hidden WHERE EXISTS (WITH hidden AS (SELECT 1 AS x) SELECT * FROM hidden)",
        "WITH a AS (SELECT * FROM hidden), hidden AS (SELECT 1 AS id) SELECT * FROM a",
        "SELECT * FROM (WITH hidden AS (SELECT 1 AS id) SELECT * FROM hidden) JOIN hidden USING (id)",
        "SELECT (SELECT max(id) FROM hidden) FROM flows",
        "SELECT * FROM flows, LATERAL (SELECT * FROM hidden)",
        "SELECT * FROM IDENTIFIER('hidden')",
        "SELECT * FROM flows WHERE FLOW_ID IN (SELECT id FROM (WITH b AS (SELECT 1) SELECT id FROM hidden))",
        "SELECT rank() OVER w FROM flows WINDOW w AS (ORDER BY (SELECT max(id) FROM hidden))",
        "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden",
        "SELECT * FROM range(5)",
        "SELECT input_file_name() FROM flows",
        "SELECT current_user() FROM flows",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'currentTimeMillis') FROM flows",
        "SELECT rank() OVER w FROM flows WINDOW w AS (ORDER BY reflect('java.lang.System', 'currentTimeMillis'))",
        "SELECT no_such_function(1) FROM flows",
        "SELECT * FROM flows LATERAL VIEW java_method('java.lang.System', 'currentTimeMillis') t",
    ):
        with pytest.raises(ValueError):
            query(f, text)
    spark.udf.register("mine", lambda: 1, "int")
    with pytest.raises(ValueError):
        query(f, "SELECT mine() FROM flows")
    spark.catalog.dropTempView("hidden")
    for text, n in (
        ("WITH hidden AS (SELECT FLOW_ID FROM flows), b AS (SELECT * FROM hidden) SELECT * FROM b", 2),
        ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT * FROM r", 4),
        ("SELECT * FROM flows WHERE EXISTS (WITH x AS (SELECT max(FLOW_ID) AS m FROM flows) SELECT * FROM x)", 2),
        ("SELECT x FROM flows LATERAL VIEW explode(array(1, 2, 3)) t AS x", 6),
        ("SELECT coalesce(upper(Attack), 'x'), count(*), sum(IN_BYTES) FROM flows GROUP BY 1", 1),
        ("SELECT date_trunc('hour', timestamp_millis(FLOW_START_MILLISECONDS)), row_number() OVER w FROM flows"
         " WINDOW w AS (PARTITION BY IPV4_SRC_ADDR ORDER BY FLOW_ID)", 2),
        ("SELECT transform(array(1, 2), v -> v + FLOW_ID) FROM flows", 2),
    ):
        assert query(f, text).count() == n
    with pytest.raises(ValueError):
        p.custom("reflect('java.lang.System', 'currentTimeMillis') <> ''")
    with pytest.raises(ValueError):
        p.custom("FLOW_ID IN (SELECT x FROM other)")


def test_sql_row_limits(spark, make_flows):
    f = make_flows([{}])
    many = "SELECT e.id FROM flows JOIN (SELECT explode(sequence(1, 20000)) AS id) e ON TRUE"
    assert query(f, many).count() == query(f, many, max_rows=None).count() > 10_000
    assert query(f, many + " LIMIT 15000").count() == 15_000
    assert query(f, many + " LIMIT 1500").count() == 1500


def test_tables_named_flows_are_left_alone(spark, make_flows):
    f = make_flows([{}] * 2)
    spark.sql("DROP TABLE IF EXISTS flows")
    spark.range(7).write.saveAsTable("flows")
    try:
        assert query(f, "SELECT * FROM flows").count() == 2
        assert spark.table("flows").count() == 7
        spark.range(5).createOrReplaceTempView("flows")
        assert query(f, "SELECT * FROM flows").count() == 2
        assert spark.table("flows").count() == 5
        spark.catalog.dropTempView("flows")
        assert spark.table("flows").count() == 7
    finally:
        spark.catalog.dropTempView("flows")
        spark.sql("DROP TABLE flows")


@pytest.mark.parametrize("where", [None, "IN_BYTES % 3 <> 0"])
def test_pages_equal_a_full_sort(make_flows, where):
    """Many ties, rows without a start, every offset."""
    from pyspark.sql import functions as F

    f = make_flows([{"FLOW_START_MILLISECONDS": 1000 * (i % 5), "IN_BYTES": i} for i in range(44)])
    f = f.withColumn("FLOW_START_MILLISECONDS", F.expr("CASE WHEN IN_BYTES % 11 <> 0 THEN FLOW_START_MILLISECONDS END"))
    condition = None if where is None else F.expr(where)
    rows = [r for r in f.collect() if where is None or r.IN_BYTES % 3]
    rows.sort(key=lambda r: (r.FLOW_START_MILLISECONDS is None, -(r.FLOW_START_MILLISECONDS or 0), r.FLOW_ID))
    order = [r.FLOW_ID for r in rows]
    for offset in (0, 3, 9, 25, len(order) - 2, len(order), 90):
        got = [r.FLOW_ID for r in filters.flow_page(f, condition, limit=7, offset=offset).collect()]
        assert got == order[offset : offset + 7]

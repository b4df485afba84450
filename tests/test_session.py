"""Scratch storage and finding the package in workers."""

import os
import subprocess
import sys

from flowlens import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scratch_is_cleared(spark):
    path = session.scratch_path(spark, "t-clear")
    spark.range(3).write.parquet(path)
    assert session.path_exists(spark, path)
    kept, session._scratch[:] = session._scratch[:-1], [path, path + "-never-written"]
    try:
        assert session.clear_scratch(spark) == 1
        assert not session.path_exists(spark, path) and session._scratch == []
    finally:
        session._scratch[:] = kept


def test_methods_the_jvm_leaves_uncompiled_are_not_run(spark):
    """A filter on a long CASE makes a method beyond the JVM's 8000 bytes; tuned sessions do without it."""
    cases = " ".join(f"WHEN (id * {i} + id % 7) % {i} = 1 THEN id % {i}" for i in range(3, 50))
    long = spark.range(10).where(f"CASE {cases} ELSE 0 END = 1")
    stages = long._jdf.queryExecution().debug().codegenToSeq()
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert max(sizes) > 8000 >= int(spark.conf.get("spark.sql.codegen.hugeMethodLimit"))


def test_workers_find_the_package(tmp_path):
    """A script elsewhere that extends its own path only."""
    script = tmp_path / "elsewhere.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {ROOT!r})
from flowlens.session import local_session
spark = local_session("1", 1)

def run(frames):
    import flowlens.schema
    yield from frames

print("rows", spark.range(5).mapInPandas(run, "id long").count())
"""
    )
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=120)
    assert "rows 5" in out.stdout, out.stderr[-2000:]


def test_writes_into_few_folders_do_not_sort(spark, tmp_path):
    spark.sql(f"CREATE TABLE t_weeks (id BIGINT, week INT) USING parquet PARTITIONED BY (week) LOCATION '{tmp_path}/t'")
    try:
        plan = spark.sql("EXPLAIN INSERT INTO t_weeks SELECT id, CAST(id % 2 AS INT) FROM range(9)").first()[0]
        assert "Sort" not in plan
        spark.range(40).selectExpr("id", "CAST(id % 9 AS INT) AS week").write.insertInto("t_weeks")  # more than are held open
        assert sorted(r.id for r in spark.table("t_weeks").where("week = id % 9").collect()) == list(range(40))
    finally:
        spark.sql("DROP TABLE t_weeks")


def test_shuffles_of_written_tables_are_dropped(spark, monkeypatch):
    """Only while the table is written, and the table is whole."""
    from flowlens import session

    seen = []
    with session.shuffles_dropped(spark):
        seen.append(spark.conf.get(session.DROP_SHUFFLES))
    seen.append(spark.conf.get(session.DROP_SHUFFLES))
    assert seen == ["true", "false"]
    table = session.materialize(spark.range(100).repartition(3), "t", drop_shuffles=True)
    assert table.count() == 100 and spark.conf.get(session.DROP_SHUFFLES) == "false"


def test_memory_for_cached_tables_is_known(spark):
    from flowlens import session

    assert session.storage_memory(spark) > 1 << 20

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from flowlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fixture_flows(spark):
    from flow_fixture import state_flows

    return state_flows(spark, SF).cache()


@pytest.fixture
def make_flows(spark):
    """Flows from short dicts; what is not given gets a plain value."""
    from flowlens.schema import conform

    plain = dict(
        FLOW_START_MILLISECONDS=1_700_000_000_000, FLOW_DURATION_MILLISECONDS=1000,
        IPV4_SRC_ADDR="10.0.0.1", IPV4_DST_ADDR="10.0.0.2", L4_SRC_PORT=40000, L4_DST_PORT=80,
        PROTOCOL=6, IN_BYTES=1000, OUT_BYTES=500, IN_PKTS=10, OUT_PKTS=5, Label="Benign",
        Attack="Benign",
    )

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            r = {**plain, "FLOW_ID": i, **row}
            r.setdefault(
                "FLOW_END_MILLISECONDS",
                r["FLOW_START_MILLISECONDS"] + r["FLOW_DURATION_MILLISECONDS"],
            )
            full.append(r)
        names = sorted({k for r in full for k in r})
        from flowlens.schema import FLOW_TYPES
        from pyspark.sql import types as T

        schema = T.StructType([T.StructField(n, FLOW_TYPES[n]) for n in names])
        return conform(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema))

    return build

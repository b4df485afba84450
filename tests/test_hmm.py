"""The model on synthetic sequences with two known states."""

import numpy as np
import pytest

from flowlens.plans import hmm
from flowlens.schema import FLOW_ID

NAMES = ["x", "y"]


def synthetic(spark, n_seq=6, length=120, seed=3, stay=0.9):
    rng = np.random.default_rng(seed)
    centers = np.array([[0.0, 0.0], [5.0, 5.0]])
    rows, truth, number = [], {}, 0
    for s in range(n_seq):
        state = int(rng.integers(2))
        for t in range(length):
            if t and rng.random() > stay:
                state = 1 - state
            v = centers[state] + rng.normal(0, 0.5, 2)
            rows.append((number, f"d{s}", 60_000 * t, float(v[0]), float(v[1])))
            truth[number] = state
            number += 1
    df = spark.createDataFrame(
        rows, f"{FLOW_ID} long, dst_ip string, FLOW_START_MILLISECONDS long, x double, y double"
    )
    return df, truth


@pytest.fixture(scope="module")
def data(spark):
    df, truth = synthetic(spark)
    return hmm.sequences(df, NAMES), truth


@pytest.fixture(scope="module")
def fitted(data):
    return hmm.fit_hmm(data[0], 2, max_iter=30)


def test_recovers_states(data, fitted):
    seqs, truth = data
    assert fitted.converged and fitted.iterations <= 30
    assert np.allclose(fitted.model.means, [[0, 0], [5, 5]], atol=0.2)
    assert np.allclose(fitted.model.variances, 0.25, atol=0.08)
    assert np.all(np.diag(fitted.model.transition) > 0.8)
    assert np.allclose(fitted.model.transition.sum(axis=1), 1)
    got = {r[FLOW_ID]: r.HMM_STATE for r in hmm.decode(seqs, fitted.model).collect()}
    assert set(got) == set(truth)
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.99


def test_likelihood_never_falls(fitted):
    assert np.all(np.diff(fitted.history) > -1e-6)


def test_criterion_prefers_two_states(data):
    seqs, _ = data
    start = {k: hmm.init_model(seqs, k) for k in (1, 2, 5)}
    fits = hmm.fit_models(seqs, start, 15, 1e-2)
    scores = hmm.bic(seqs, {k: f.model for k, f in fits.items()})
    assert scores[2] < scores[5] and scores[2] < scores[1]
    assert fits[1].model.transition.tolist() == [[1.0]]


def test_select_k(data):
    best, scores = hmm.select_k(data[0])
    assert best == 2 and set(scores) == set(range(2, 11))


def test_round_trip(fitted):
    again = hmm.HmmModel.from_json(fitted.model.to_json())
    assert again.to_json() == fitted.model.to_json()


def test_statistics_equal_brute_force():
    """Sums over all state paths of short sequences."""
    rng = np.random.default_rng(0)
    k, d = 3, 2
    model = hmm.HmmModel(
        rng.normal(size=(k, d)), rng.uniform(0.5, 2, (k, d)),
        rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(k)),
    )
    lengths = np.array([1, 4, 2, 4])
    x = rng.normal(size=(lengths.sum(), d))
    got = hmm._sufficient_statistics(model, x, lengths)
    ll, first, moves, mass = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(k)
    sx = np.zeros((k, d))
    best = []
    begin = 0
    for n in lengths:
        seq = x[begin : begin + n]
        begin += n
        log_b = -0.5 * (
            np.log(2 * np.pi * model.variances)[None] + (seq[:, None] - model.means) ** 2 / model.variances
        ).sum(axis=2)
        paths = np.array(np.meshgrid(*[range(k)] * n, indexing="ij")).reshape(n, -1).T
        score = np.array([
            np.log(model.initial[p[0]]) + sum(np.log(model.transition[a, b]) for a, b in zip(p, p[1:]))
            + sum(log_b[t, s] for t, s in enumerate(p)) for p in paths
        ])
        total = np.logaddexp.reduce(score)
        ll += total
        best += paths[score.argmax()].tolist()
        for p, w in zip(paths, np.exp(score - total)):
            first[p[0]] += w
            for a, b in zip(p, p[1:]):
                moves[a, b] += w
            for t, s in enumerate(p):
                mass[s] += w
                sx[s] += w * seq[t]
    want = np.concatenate([[ll, len(x)], first, moves.ravel(), mass, sx.ravel()])
    assert np.allclose(got[: len(want)], want)
    entry = np.broadcast_to(np.log(model.initial), (len(lengths), k))
    assert hmm._best_paths(model.log_emission(x), lengths, entry, np.log(model.transition)).tolist() == best


@pytest.mark.parametrize("rows", [1, 3, 7])
def test_pieces_change_nothing(monkeypatch, rows):
    """Cutting sequences inside a task gives the sums and paths of whole ones."""
    rng = np.random.default_rng(5)
    k, d = 4, 3
    model = hmm.HmmModel(
        rng.normal(size=(k, d)), rng.uniform(0.5, 2, (k, d)),
        rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(k)),
    )
    lengths = np.array([40, 1, 7, 23, 2, 40])
    x = rng.normal(size=(lengths.sum(), d))
    log_b, move = model.log_emission(x), np.log(model.transition)
    entry = np.broadcast_to(np.log(model.initial), (len(lengths), k))
    leave = np.array([0, 1, 2, 3, 0, 1])
    run = lambda: (
        hmm._sufficient_statistics(model, x, lengths),
        hmm._best_paths(log_b, lengths, entry, move),
        hmm._best_paths(log_b, lengths, entry, move, leave),
        np.array([t for t, _ in hmm._BestTree(model).leaves(0, x, lengths)]),
        np.array([t for t, _ in hmm._SumTree({0: model}).leaves(0, x, lengths)]),
    )
    whole = run()
    monkeypatch.setattr(hmm, "PIECE_ROWS", rows)
    for a, b in zip(whole, run()):
        assert np.allclose(a, b)


def test_batches_may_split_sequences_anywhere(spark):
    import pandas as pd

    frame = pd.DataFrame({"dst_ip": list("aaabbbbbcd"), "run": 0, "chunk": [0, 0, 1, 0, 0, 0, 0, 0, 0, 0], "v": range(10)})
    for size in (1, 2, 3, 10):
        parts = [frame.iloc[i : i + size] for i in range(0, 10, size)]
        blocks = list(hmm._blocks(iter(parts), ["dst_ip", "run"], block_rows=2))
        assert [v for b, _ in blocks for v in b["v"]] == list(range(10))
        assert [n for _, lengths in blocks for n in lengths] == [2, 1, 5, 1, 1]


def overlapping(fitted):
    """States that overlap make paths and counts depend on their neighbours."""
    model = fitted.model
    return hmm.HmmModel(
        model.means, model.variances * 60, np.array([[0.97, 0.03], [0.1, 0.9]]), np.array([0.3, 0.7])
    )


@pytest.fixture(scope="module")
def skewed(spark):
    """One destination with most rows, half of these in a single instant, and some short ones, one without a key."""
    df, _ = synthetic(spark, n_seq=1, length=700, seed=9, stay=0.8)
    few, _ = synthetic(spark, n_seq=9, length=23, seed=4)
    instant = f"CASE WHEN {FLOW_ID} < 350 THEN 5 ELSE FLOW_START_MILLISECONDS END AS FLOW_START_MILLISECONDS"
    return df.selectExpr(FLOW_ID, "dst_ip", instant, "x", "y").unionByName(few.selectExpr(
        f"{FLOW_ID} + 100000 AS {FLOW_ID}", "CASE WHEN dst_ip <> 'd3' THEN 's' || dst_ip END AS dst_ip",
        "FLOW_START_MILLISECONDS", "x", "y")).repartition(3)


@pytest.fixture(scope="module", params=[40, 3])
def both(spark, skewed, request):
    """The layout whole, and cut into chunks that stand in many ranges."""
    old = hmm.SMALL_PARTITION_ROWS, hmm.PARTITION_ROWS, hmm.FAN_BITS
    whole = hmm.sequences(skewed, NAMES)
    hmm.SMALL_PARTITION_ROWS, hmm.PARTITION_ROWS, hmm.FAN_BITS = 20, 60, 2
    yield whole, hmm.sequences(skewed, NAMES, chunk_rows=request.param)
    hmm.SMALL_PARTITION_ROWS, hmm.PARTITION_ROWS, hmm.FAN_BITS = old


def test_chunks_are_small_and_in_order(both):
    whole, cut = both
    assert not whole.cut and cut.ranges > 8
    rows = cut.rows.toPandas().sort_values(["dst_ip", "FLOW_START_MILLISECONDS", FLOW_ID])
    assert len(rows) == whole.rows.count() == 907
    assert rows.groupby(["dst_ip", "chunk"], dropna=False).size().max() <= 40
    assert rows["long"].sum() >= 700 and rows.loc[rows.dst_ip == "d0", "chunk"].is_monotonic_increasing
    assert rows.loc[rows.dst_ip == "d0", "chunk"].nunique() > 17


def test_cut_sequences_decode_exactly(both, fitted):
    model = overlapping(fitted)
    a, b = (hmm.decode(s, model) for s in both)
    assert a.count() == 907 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert 0 < a.where("HMM_STATE = 0").count() < 907


def test_cut_sequences_count_exactly(both, fitted):
    """Expected counts of two models at once do not depend on the cuts."""
    models = {2: overlapping(fitted), 7: fitted.model}
    a, b = (hmm.expectation(s, models) for s in both)
    for m in models:
        assert np.allclose(a[m], b[m], rtol=1e-9, atol=1e-9)
        assert a[m][2:4].sum() == pytest.approx(10)  # one first row per sequence


def test_training_does_not_depend_on_chunks(both):
    start = {3: hmm.init_model(both[0], 3)}
    a, b = (hmm.fit_models(s, start, 6, 0.0)[3] for s in both)
    assert a.iterations == b.iterations == 6 and np.allclose(a.history, b.history)
    for name in ("means", "variances", "transition", "initial"):
        assert np.allclose(getattr(a.model, name), getattr(b.model, name), atol=1e-6)
    a, b = (hmm.fit_hmm(s, 2, max_iter=8) for s in both)
    assert a.log_likelihood == pytest.approx(b.log_likelihood) and np.allclose(a.model.means, b.model.means, atol=1e-6)


def test_rounds_over_cut_sequences_move_no_rows(both, fitted):
    """Only edges and sums are shuffled; the rows of chunks lie where the layout put them."""
    cut = both[1]
    tree = hmm._BestTree(fitted.model)
    rows = cut.rows.where("long")
    edges = hmm._tree_edges(hmm._nodes(rows, cut, tree), cut, tree).withColumnRenamed("node", "chunk")
    met = rows.groupBy(*cut.ids, "chunk").cogroup(edges.groupBy(*cut.ids, "chunk")).applyInPandas(
        hmm._decode_chunk(fitted.model, NAMES), f"{FLOW_ID} long, HMM_STATE int"
    )
    plan = met._jdf.queryExecution().executedPlan().toString()
    top = plan[plan.index("FlatMapCoGroupsInPandas") :]
    assert "Exchange" not in top[: top.index("InMemoryTableScan")]


def test_logarithms_of_far_states():
    """A state that is impossible for a whole piece takes the counts of others with it nowhere."""
    rng = np.random.default_rng(1)
    model = hmm.HmmModel(
        np.array([[0.0], [40.0]]), np.full((2, 1), 0.01), np.array([[1.0, 1e-300], [1e-300, 1.0]]), np.array([0.5, 0.5])
    )
    x = np.concatenate([rng.normal(0, 0.1, (50, 1)), rng.normal(40, 0.1, (50, 1))])
    tree = hmm._SumTree({0: model})
    nodes = [tree.leaves(0, part, np.array([len(part)]))[0] for part in np.split(x, [30, 55, 80])]
    edges = tree.edges(0, nodes, None)
    parts = [
        hmm._sufficient_statistics(model, part, np.array([len(part)]), before if len(before) else None, after)
        for part, (before, after) in zip(np.split(x, [30, 55, 80]), edges)
    ]
    whole = hmm._sufficient_statistics(model, x, np.array([100]))
    assert np.isfinite(whole).all() and np.allclose(sum(parts), whole)


def test_samples_cut_long_sequences_by_the_hour(spark, skewed):
    seqs = hmm.sequences(skewed.where("dst_ip = 'd0' AND FLOW_START_MILLISECONDS > 10"), NAMES, sample_rows=200)
    sizes = seqs.rows.groupBy("dst_ip", "run").count().collect()
    assert 1 <= len(sizes) < 7 and all(r["count"] <= 60 for r in sizes)


def test_sequences_of_one_and_few_points(spark):
    df, _ = synthetic(spark, n_seq=4, length=1)
    seqs = hmm.sequences(df, NAMES)
    fit = hmm.fit_hmm(seqs, 2, max_iter=5)
    assert np.isfinite(fit.log_likelihood)
    assert hmm.decode(seqs, fit.model).count() == 4


def test_short_sequences_are_left_out(spark):
    df, _ = synthetic(spark, n_seq=2, length=20)
    short, _ = synthetic(spark, n_seq=1, length=2)
    both = df.unionByName(short.selectExpr(
        f"{FLOW_ID} + 1000 AS {FLOW_ID}", "'s' AS dst_ip", "FLOW_START_MILLISECONDS", "x", "y"))
    assert hmm.sequences(both, NAMES, min_rows=3).rows.count() == 40
    assert hmm.sequences(both, NAMES).rows.count() == 42


def test_samples_are_whole_sequences(spark):
    df, _ = synthetic(spark, n_seq=60, length=20)
    for seqs in (
        hmm.sequences(df, NAMES, sample_rows=300),
        hmm.sample_sequences(hmm.sequences(df, NAMES), 300),
    ):
        sizes = [r["count"] for r in seqs.rows.groupBy("dst_ip").count().collect()]
        assert set(sizes) == {20} and 2 <= len(sizes) <= 40


def test_discovery(fixture_flows):
    from flowlens.plans.discovery import discover_states

    found = discover_states(fixture_flows.drop("HMM_STATE"), k=3, sample=3000)
    n = fixture_flows.count()
    assert found.flows.count() == n
    assert found.flows.where("HMM_STATE IS NULL").count() == 0
    profiles = found.profiles.collect()
    assert sum(r.flow_count for r in profiles) == n and 1 <= len(profiles) <= 3
    assert found.tactics.count() == found.anomalies.count() == len(profiles)


def test_discovery_needs_data(fixture_flows):
    from flowlens.plans.discovery import discover_states

    with pytest.raises(ValueError, match="insufficient"):
        discover_states(fixture_flows.limit(5))


def test_rounds_read_packed_blocks(spark, both):
    """Training on packed blocks gives the sums of the rows, and leaves nothing cached behind."""
    start = {k: hmm.init_model(both[0], k) for k in (2, 4)}
    for seqs in both:
        packed = seqs.packed()
        assert seqs.blocks is None and set(packed.blocks.columns) == {"lengths", "x"}
        for k, sums in hmm.expectation(packed, start).items():
            assert np.allclose(sums, hmm.expectation(seqs, start)[k], rtol=1e-9)
        for k, model in hmm._start_models(packed, {k: hmm._centers(both[0], k, 42) for k in start}).items():
            assert np.allclose(model.means, start[k].means) and np.allclose(model.variances, start[k].variances)
        blocks = packed.blocks
        packed.unpack()
        assert packed.blocks is None and not blocks.storageLevel.useMemory


def test_start_values_are_those_of_the_clusters(spark):
    rows = [(i, "a", i, float(v), 1000.0 + v) for i, v in enumerate([0, 1, 2, 50, 51, 55])]
    df = spark.createDataFrame(rows, f"{FLOW_ID} long, dst_ip string, FLOW_START_MILLISECONDS long, x double, y double")
    model = hmm.init_model(hmm.sequences(df, NAMES), 2).relabelled()
    assert np.allclose(model.means, [[1, 1001], [52, 1052]])
    assert np.allclose(model.variances, [[2 / 3] * 2, [14 / 3] * 2])


def test_layout_bounds_what_a_task_reads(spark, data):
    assert hmm._partitions(data[0].rows, 36_000_000) >= 72


def test_no_python_pass_over_the_layout_where_no_sequence_is_short(spark):
    df = synthetic(spark, n_seq=2, length=40)[0]
    plan_of = lambda n: hmm.sequences(df, NAMES, min_rows=n, persist=False).rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan_of(40) and "MapInPandas" in plan_of(41)


def test_clusterings_share_passes_and_are_those_of_spark(spark, both):
    """All searches take their rounds together, and end where k-means of Spark ends."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    seqs = both[0]
    vectors = seqs.rows.select(array_to_vector(F.array(*seqs.features)).alias("vector"))
    found = hmm._moved_centers(seqs, hmm._first_centers(seqs, [2, 4], 42))
    for k, centers in found.items():
        fitted = KMeans(k=k, maxIter=hmm.KMEANS_ROUNDS, seed=42, featuresCol="vector").fit(vectors)
        assert np.allclose(centers, fitted.clusterCenters())


def test_partitions_stay_small(data):
    assert hmm._partitions(data[0].rows, 36_000_000) >= 144


def test_packed_blocks_travel_in_small_rows():
    """A block is cut into rows of bounded size and put together again, wherever batches end."""
    import pandas as pd

    x = np.random.default_rng(2).normal(size=(50_000, 2))
    frame = pd.DataFrame({"dst_ip": ["a"] * 30_000 + ["b"] * 20_000, "run": 0, "chunk": 0, "x": x[:, 0], "y": x[:, 1]})
    out = list(hmm._pack_task(NAMES, ["dst_ip", "run"])(iter([frame, frame.iloc[:7].assign(dst_ip="c")])))
    assert max(len(part) for f in out for part in f["x"]) <= 1 << 17
    rows = pd.concat(out, ignore_index=True)
    for size in (1, 3, len(rows)):
        back = list(hmm._unpacked((rows.iloc[i : i + size] for i in range(0, len(rows), size)), 2))
        assert np.array_equal(np.concatenate([b for b, _ in back]), np.concatenate([x, x[:7]]))
        assert [n for _, lengths in back for n in lengths] == [30_000, 20_000, 7]


def test_layouts_beyond_memory_stay_on_disk(spark, monkeypatch):
    """What is cached of a layout that would crowd the memory out is on disk; the model is the same."""
    plain = hmm.sequences(synthetic(spark)[0], NAMES)
    want, centers = hmm.fit_hmm(plain, 2, max_iter=3), hmm._first_centers(plain, [2, 3], 1)
    assert plain.rows.storageLevel.useMemory
    monkeypatch.setattr(hmm, "storage_memory", lambda _: 1)
    seqs = hmm.sequences(synthetic(spark)[0], NAMES)
    packed = seqs.packed()
    for cached in (seqs.rows, packed.blocks):
        assert cached.storageLevel.useDisk and not cached.storageLevel.useMemory
    packed.unpack()
    got = hmm.fit_hmm(seqs, 2, max_iter=3)
    assert np.allclose(got.history, want.history) and np.allclose(got.model.means, want.model.means)
    assert all(np.allclose(c, centers[k]) for k, c in hmm._first_centers(seqs, [2, 3], 1).items())
    plain.unpersist()
    seqs.unpersist()

"""State discovery end to end: features, training, labelling, profiling."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from flowlens.operators.features import Scaler, flow_features
from flowlens.operators.scoring import anomaly_scores, describe, suggest_tactics
from flowlens.operators.states import traffic_profiles
from flowlens.plans.hmm import (
    FitResult,
    Sequences,
    decode,
    fit_hmm,
    select_k,
    sequences,
)
from flowlens.session import materialize
from flowlens.sources.writers import assign_states

MIN_ROWS = 10
# Training effort during discovery.
MAX_ITER, TOL = 50, 1e-2


@dataclass
class Discovery:
    flows: DataFrame
    profiles: DataFrame
    anomalies: DataFrame
    tactics: DataFrame
    descriptions: DataFrame
    fit: FitResult
    scaler: Scaler


def training_sequences(
    features: DataFrame, sample: int | None = None, min_flows: int = 3, seed: int = 42
) -> tuple[Sequences, Scaler]:
    """Cached, scaled sequences of all flows, or of about ``sample`` if given.

    ``features`` is read more than once; pass a written table.
    """
    train = sequences(features, sample_rows=sample, min_rows=min_flows, seed=seed)
    if train.rows.count() < MIN_ROWS:
        raise ValueError(f"insufficient data for training (need at least {MIN_ROWS} flows)")
    scaler = Scaler.fit(train.rows)
    # scaling is a projection of the cached layout: order and partitions stay
    return replace(train, rows=scaler.transform(train.rows), cached=train.rows), scaler


def discover_states(
    f: DataFrame,
    k: int = 0,
    sample: int | None = None,
    min_flows: int = 3,
    seed: int = 42,
) -> Discovery:
    """Find behaviour states, label every flow, and describe the states.

    Training and scaling use the flows of destinations with at least
    ``min_flows`` flows: all of them, or about ``sample`` in whole destinations.
    Decoding covers all flows.  ``k`` = 0 chooses the number of states.
    """
    features = materialize(flow_features(f), "features", drop_shuffles=True)
    train, scaler = training_sequences(features, sample, min_flows, seed)
    if k <= 0:
        k, _ = select_k(train, seed=seed)
    fit = fit_hmm(train, k, MAX_ITER, TOL, seed)
    train.unpersist()
    everything = sequences(scaler.transform(features), persist=False)
    states = materialize(decode(everything, fit.model), "states", drop_shuffles=True)
    everything.unpersist()
    # Written once: the profiles read this several times, the caller again.
    flows = materialize(assign_states(f, states), "flows", drop_shuffles=True)
    profiles = materialize(traffic_profiles(flows), "profiles")
    return Discovery(
        flows,
        profiles,
        anomaly_scores(profiles),
        suggest_tactics(profiles),
        describe(profiles),
        fit,
        scaler,
    )

"""Recipe health as a stream: each recipe's state is kept by the engine, moved by every run, and a timer tells when runs stay away."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsweft.operators.health import Limits

STATE = "last_run long, failures long, empty_runs long, rebuild boolean, status string, freshness string, correctness string, drifts long, fingerprint string, published_at timestamp, last_at timestamp"
OUTPUT = "recipe_id string, last_run long, failures long, empty_runs long, rebuild boolean, status string, freshness string, correctness string, drifts long, fingerprint string, published_at timestamp, late boolean"
_BEGIN = (-1, 0, 0, False, "failed", "unknown", "unknown", 0, None, None, None)


def next_state(state: tuple, run: dict, limits: Limits) -> tuple:
    """A recipe's state after one more run; what ``fold_recipe_state`` says of all runs together."""
    _, failures, empty, rebuild, _, fresh, right, drifts, fingerprint, published, _ = state
    at, correct = run["started_at"], run["correct"]
    if run["published_at"] is not None:
        published = run["published_at"]
    if run["fingerprint"] is not None:
        drifts += fingerprint is not None and fingerprint != run["fingerprint"]
        fingerprint = run["fingerprint"]
    if not run["transient"]:
        failures, empty = 0 if correct else failures + 1, empty + 1 if run["accepted"] == 0 else 0
        rebuild = failures >= limits.failures or empty >= limits.empty
        right = "passing" if correct else "failing"
        if not run["dates_complete"]:
            fresh = "unknown" if correct else "overdue"
        elif published is not None and published < at - timedelta(seconds=limits.stale_after):
            fresh = "content_stale"
        else:
            fresh = "overdue" if not correct else "unknown" if published is None else "fresh"
    return (run["run_id"], failures, empty, rebuild, "stale" if rebuild else "passed" if correct else "failed", fresh, right, drifts, fingerprint, published, at)


class RecipeHealth(StatefulProcessor):
    """One recipe's runs, batch by batch, in order of their ids; a recipe silent for ``late_after`` seconds of event time is told late, once."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("health", STATE)

    def _row(self, key: tuple, state: tuple, late: bool) -> pd.DataFrame:
        names = [f.split()[0] for f in OUTPUT.split(", ")]
        return pd.DataFrame([(key[0], *state[:-1], late)], columns=names).astype({"published_at": "datetime64[ns]"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else _BEGIN
        runs = pd.concat(list(rows)).sort_values("run_id").astype(object)
        # What an earlier attempt or batch has counted is not counted again.
        for run in runs.where(runs.notna(), None).to_dict("records"):
            if run["run_id"] > known[0]:
                known = next_state(tuple(known), run, self.limits)
        known = tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in known)
        self.state.update(known)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(_millis(known[-1]) + self.limits.late_after * 1000)
        yield self._row(key, known, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield self._row(key, self.state.get(), True)

    def close(self) -> None:
        pass


def _millis(at: datetime) -> int:
    return int(pd.Timestamp(at).tz_localize("UTC").value // 1_000_000) if pd.Timestamp(at).tzinfo is None else int(pd.Timestamp(at).value // 1_000_000)


def recipe_health_stream(runs: DataFrame, limits: Limits = Limits(), delay: str = "0 seconds") -> DataFrame:
    """A row (OUTPUT) for each recipe and batch with runs, and one when its timer tells that it is late.

    ``runs`` is a stream of recipe runs with ``started_at`` as a timestamp. The session needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), which holds the state and survives restarts by the checkpoint.
    """
    keyed = runs.withWatermark("started_at", delay).groupBy("recipe_id")
    return keyed.transformWithStateInPandas(RecipeHealth(limits), OUTPUT, "Append", "EventTime")

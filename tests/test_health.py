"""Recipe and source health: the aggregates against a fold run by run, and the stream against the aggregates, with restarts."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsweft.operators import health as H
from newsweft.streaming import health as S

RUN = "run_id long, recipe_id string, started_at timestamp, correct boolean, transient boolean, accepted int, fingerprint string, published_at timestamp, dates_complete boolean"
START = dt.datetime(2024, 1, 1)


def made(seed, n=300, recipes=7):
    r, rows = random.Random(seed), []
    for i in range(n):
        at = START + dt.timedelta(hours=i)
        transient = r.random() < 0.15
        correct = not transient and r.random() < 0.6
        published = at - dt.timedelta(days=r.randint(0, 40)) if r.random() < 0.5 else None
        rows.append((i, f"r{r.randrange(recipes)}", at, correct, transient, r.choice([0, 0, 3]), r.choice([None, "a", "a", "b"]), published, r.random() < 0.8))
    return rows


def slow(rows, limits=H.Limits()):
    names, state = [f.split()[0] for f in RUN.split(", ")], {}
    for row in sorted(rows):
        run = dict(zip(names, row))
        state[run["recipe_id"]] = S.next_state(state.get(run["recipe_id"], S._BEGIN), run, limits)
    newest = max(r[2] for r in rows)
    return {k: (*s[:-1], s[-1] + dt.timedelta(seconds=limits.late_after) < newest) for k, s in state.items()}


@pytest.mark.parametrize("seed,piece", [(1, 4096), (2, 16), (3, 1)])
def test_fold_against_run_by_run(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(H, "PIECE", piece)
    rows = made(seed) + [(1000, "only-transient", START, False, True, 0, None, None, True), (1001, "once", START, True, False, 0, "x", START, True)]
    got = {r["recipe_id"]: tuple(r)[1:] for r in H.fold_recipe_state(spark.createDataFrame(rows, RUN)).collect()}
    assert got == slow(rows)


def test_limits_and_no_runs(spark):
    df = spark.createDataFrame([(i, "a", START, False, False, 0, None, None, True) for i in range(3)], RUN)
    state = lambda **k: H.fold_recipe_state(df, H.Limits(**k)).select("rebuild", "status").first()
    assert tuple(state()) == (True, "stale") and tuple(state(failures=4, empty=4)) == (False, "failed") and state(failures=4)["rebuild"]
    assert not H.fold_recipe_state(spark.createDataFrame([], RUN)).count()
    assert not H.fold_source_state(spark.createDataFrame([], "run_id long, source_id string, started_at timestamp, succeeded boolean, items_found int")).count()


def test_backoff_doubles_to_an_hour(spark):
    rows = [(i, "a", START, i == 0, 2) for i in range(9)] + [(i, "b", START, False, 0) for i in range(2)] + [(5, "c", START, True, 4)]
    got = {r["source_id"]: r for r in H.fold_source_state(spark.createDataFrame(rows, "run_id long, source_id string, started_at timestamp, succeeded boolean, items_found int")).collect()}
    waits = {k: r["backoff_until"] and (r["backoff_until"] - START).total_seconds() for k, r in got.items()}
    assert waits == {"a": 3600, "b": 240, "c": None} and (got["a"]["failures"], got["a"]["items"], got["c"]["zero_runs"]) == (8, 2, 0)


def test_stream_equals_the_fold_with_restarts(spark, tmp_path):
    provider, key = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"
    rows = made(4, 200) + [(500, "silent", START, True, False, 1, "a", None, True)]
    rows.sort(key=lambda r: r[2])
    spark.conf.set(key, provider)
    try:
        for part in range(3):  # each part is a query of its own on the same checkpoint
            spark.createDataFrame(rows[part * 67 : (part + 1) * 67], RUN).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
            stream = spark.readStream.schema(RUN).parquet(str(tmp_path / "in/*"))
            out = S.recipe_health_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            out.awaitTermination()
    finally:
        spark.conf.unset(key)
    told = spark.read.parquet(str(tmp_path / "out"))
    last = told.groupBy("recipe_id").agg(F.max_by(F.struct(*[c for c in told.columns if c not in ("recipe_id", "late")]), "last_run").alias("s")).select("recipe_id", "s.*")
    want = {k: s[:-1] for k, s in slow(rows).items()}
    assert {r["recipe_id"]: tuple(r)[1:] for r in last.collect()} == want
    assert [r["last_run"] for r in told.where("late and recipe_id = 'silent'").collect()] == [500]

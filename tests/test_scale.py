"""Queries on what only larger tables hold: prices of 0, groups and series that no task can hold."""

from __future__ import annotations

import math
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldcast.contract import SeriesSpec
from foldcast.operators import fits
from foldcast.operators import kernels as K
from foldcast.plans.queries import ORACLES, QUERIES
from foldcast.sources.simulate import garch_path

from .conftest import DATA


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """A folder whose events have prices of 0 (twice in a row for b), and its SQL results by name."""
    import duckdb

    at = tmp_path_factory.mktemp("zeros")
    prices = {"a": [5.0, 0.0, 4.0, 2.0, 3.0], "b": [3.0, 0.0, 0.0, 7.0, 6.0], "c": [1.0, 2.0, 1.5, 1.75, 1.25]}
    start = datetime(2024, 1, 1)
    rows = [(10 * i + j, start + timedelta(minutes=j), 1, k, v, "{}") for i, (k, p) in enumerate(prices.items()) for j, v in enumerate(p)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{at}/events.parquet/*.parquet')")
    return str(at), lambda name: con.sql(ORACLES[name])


def same_values(df, relation) -> None:
    """Equal rows by the first column, where NULL, NaN and the infinities are four things."""
    said = lambda v: None if v is None else "nan" if v != v else v
    rows = lambda x: sorted([tuple(map(said, r)) for r in x], key=lambda r: r[0])
    got, want = rows(df.collect()), rows(relation.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


def test_log_returns_of_a_total_loss(spark, zeros):
    d, sql = zeros
    got = {r.event_id: r.r for r in QUERIES["log_returns"](spark, d).collect()}
    assert got[0] is None and got[1] == -math.inf and got[2] == math.inf and math.isnan(got[12])
    same_values(QUERIES["log_returns"](spark, d), sql("log_returns"))


def test_kelly_of_a_total_loss(spark, zeros):
    d, sql = zeros
    got = {r.key: r.kelly for r in QUERIES["kelly_by_type"](spark, d).collect()}
    assert math.isnan(got["a"]) and math.isnan(got["b"]) and math.isfinite(got["c"])
    same_values(QUERIES["kelly_by_type"](spark, d), sql("kelly_by_type"))


def test_summary_of_a_total_loss(spark, zeros):
    d, sql = zeros
    got = {r.key: r.max_drawdown for r in QUERIES["strategy_summary"](spark, d).collect()}
    assert got["a"] == -math.inf and math.isfinite(got["c"])
    same_values(QUERIES["strategy_summary"](spark, d), sql("strategy_summary"))


def test_no_task_gathers_a_group_of_a_ridge_fit(spark):
    """A fit over many tasks and batches has the coefficients of one over all rows, and what meets by key are states, not rows."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(9000, 2)) + [1e9, -3.0]
    y = x @ [0.5, -2.0] + rng.normal(size=9000)
    keys = [None, "a", "b"]
    rows = [(keys[i % 3], float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))] + [("gap", 1.0, None, 1.0), ("gap", 1.0, 2.0, 3.0), ("short", 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double").repartition(7)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        states = fits.ridge_states(df, ["a", "b", "y"], ["k"])
        assert states.count() <= 7 * 5 and states.agg(F.max(F.size("_r"))).first()[0] <= 9
        got = {r.k: r for r in fits.ridge_fit(df, ["a", "b"], "y", ["k"], []).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {k: r.status for k, r in got.items()} == {None: 0, "a": 0, "b": 0, "gap": 1, "short": 4}
    for i, k in enumerate(keys):
        w, b = K.ridge_fit(x[i::3], y[i::3])
        assert np.allclose(got[k].coef, w, rtol=1e-11) and math.isclose(got[k].intercept, b, rel_tol=1e-9)


def test_states_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(fits, "HELD", 2)
    df = spark.range(0, 60, 1, 1).selectExpr("id % 6 AS k", "cast(id AS double) AS a", "2D * id + 1 AS y")
    got = {r.k: (r.status, round(r.coef[0], 9), round(r.intercept, 9)) for r in fits.ridge_fit(df, ["a"], "y", ["k"], []).collect()}
    assert got == dict.fromkeys(range(6), (0, 2.0, 1.0))
    one = fits.ridge_fit(df, ["a"], "y", [], []).collect()
    assert len(one) == 1 and math.isclose(one[0].coef[0], 2.0, rel_tol=1e-12)


def test_rows_of_ridge_1d_are_not_shuffled(spark):
    plan = QUERIES["ridge_1d"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Exchange") < plan.index("MapInArrow") and plan.count("Exchange") == 1


def test_fits_of_long_series_hold_little_besides_the_returns(monkeypatch):
    x = np.random.default_rng(5).normal(scale=0.01, size=2_000_000)
    f, p = K.Likelihood(x, 1e-4), np.array([1e-6, 0.05, 0.9])
    tracemalloc.start()
    whole = f(p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * x.nbytes
    monkeypatch.setattr(K.Likelihood, "PART", 10**9)
    assert math.isclose(K.Likelihood(x, 1e-4)(p), whole, rel_tol=1e-12)
    r = garch_path(12345, 2000, 2e-6, 0.10, 0.85)
    want = K.garch_fit(r)
    monkeypatch.setattr(K.Likelihood, "PART", 300)
    got = K.garch_fit(r)
    assert all(math.isclose(got[k], v, rel_tol=1e-5) for k, v in want.items())


def test_garch_fit_reads_series_in_order(spark):
    """Rows dealt out at random, in many batches: the fits are those of the ordered series, bit for bit."""
    series = {k: garch_path(s, 1500, 5e-6, 0.05, 0.93) for s, k in ((777, "a"), (3, None), (4, "c"))}
    rows = [(k, i // 2, i if i % 2 else None, float(v)) for k, r in series.items() for i, v in enumerate(r)]
    df = spark.createDataFrame(rows, "k string, t long, u long, r double").orderBy(F.rand(1)).repartition(6)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "128")
    try:
        m = fits.garch_fit(df, "r", SeriesSpec.of("k", ["t", "u"]))
        got = {x.k: x for x in m.collect()}
        plan = m._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert plan.count("Sort [") == 2  # of the two plans printed (final, initial): no second sort that could undo the first
    for k, r in series.items():
        want = K.garch_fit(r)
        assert all(got[k][n] == v for n, v in want.items()), k

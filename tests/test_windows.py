from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldcast.contract import FORWARD, PREDICTIVE, DomainError, SeriesSpec, check_order, count, declared, timing_of
from foldcast.functions import scalars as S
from foldcast.operators import recurrences
from foldcast.operators import windows as W

T = SeriesSpec.of(None, "t")


def series(spark, values, name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"t long, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


def close(a, b, tol=1e-12):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x is None) == (y is None), (a, b)
        assert x is None or abs(x - y) <= tol * max(1, abs(y)), (x, y)


@pytest.mark.parametrize("method", ["exact", "fast"])
def test_known_rolling_answers(spark, method):
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    close(column(W.rolling_mean(df, "x", T, 3, "m", method), "m"), [None, None, 2.0, 3.0, 4.0])
    close(column(W.rolling_std(df, "x", T, 3, "s", method), "s"), [None, None, *[math.sqrt(2 / 3)] * 3])
    four = series(spark, [1.0, 2.0, 3.0, 4.0])
    close(column(W.rolling_mean(four, "x", T, 4, "m", method), "m"), [None] * 3 + [2.5])
    close(column(W.rolling_std(four, "x", T, 4, "s", method), "s"), [None] * 3 + [math.sqrt(1.25)])
    assert column(W.rolling_mean(four, "x", T, 5, "m", method), "m") == [None] * 4


def test_constants_and_single_rows_have_no_deviation(spark):
    df = series(spark, [0.1] * 6)
    assert column(W.rolling_std(df, "x", T, 4, "s"), "s")[3:] == [0.0] * 3
    assert column(W.rolling_std(df, "x", T, 1, "s"), "s") == [0.0] * 6


def test_missing_values_void_their_windows_only(spark):
    v = [float(i) for i in range(20)]
    v[7], v[12] = math.nan, math.inf
    got = column(W.rolling_mean(series(spark, v), "x", T, 3, "m"), "m")
    want = [None if i < 2 or any(not math.isfinite(x) for x in v[i - 2 : i + 1]) else sum(v[i - 2 : i + 1]) / 3 for i in range(20)]
    close(got, want)


def test_large_levels_and_outliers_leave_no_trace(spark):
    rng = np.random.default_rng(3)
    v = 1e9 + rng.normal(size=80)
    v[10] = 1e15
    got = column(W.rolling_std(series(spark, v.tolist()), "x", T, 20, "s"), "s")
    for i in range(35, 80):
        w = [Fraction(x) for x in v[i - 19 : i + 1].tolist()]
        m = sum(w) / 20
        exact = math.sqrt(sum((x - m) ** 2 for x in w) / 20)
        assert abs(got[i] / exact - 1) < 1e-12


def test_overflow_is_missing_then_recovers(spark):
    got = column(W.rolling_mean(series(spark, [-1e308, 1.0, 2.0, 3.0]), "x", T, 2, "m"), "m")
    close(got[1:], [-5e307, 1.5, 2.5])
    assert column(W.rolling_std(series(spark, [1e308, -1e308, 1.0, 2.0]), "x", T, 2, "s"), "s")[1] is None


def test_prefix_is_stable(spark):
    v = np.random.default_rng(5).normal(size=60).tolist()
    full = column(W.rolling_std(series(spark, v), "x", T, 7, "s"), "s")
    part = column(W.rolling_std(series(spark, v[:40]), "x", T, 7, "s"), "s")
    assert full[:40] == part


def test_lag_and_timing(spark):
    df = W.rolling_std(series(spark, [1.0, 2.0, 4.0, 8.0]), "x", T, 2, "s")
    df = df.withColumn("price", df.x)
    with pytest.raises(ValueError, match="lag"):
        W.vol_target(df, "s", "price", 0.01, 1e4, 2.0)
    W.vol_target(df, "s", "price", 0.01, 1e4, 2.0, unsafe=True)
    lagged = W.lag(df, "s", T, 1, "before")
    assert column(lagged, "before") == [None, None, 0.5, 1.0]
    W.vol_target(lagged, "before", "price", 0.01, 1e4, 2.0)
    assert column(W.lag(df, "x", T, 0, "same"), "same") == [1.0, 2.0, 4.0, 8.0]
    assert column(W.lag(df, "x", T, 9, "none"), "none") == [None] * 4


@pytest.mark.parametrize("horizon", [1, 3, 5])
def test_nothing_that_looks_ahead_becomes_predictive_early(spark, horizon):
    df = W.simple_returns(series(spark, [float(i + 1) for i in range(12)]), "x", T, "r")
    label = W.forward_label(df, "r", T, horizon, "label")
    assert timing_of(label, "label") == FORWARD
    for k in range(horizon + 2):
        d = W.lag(label, "label", T, k, "seen")
        known = k >= horizon
        assert timing_of(d, "seen") == (PREDICTIVE if known else FORWARD)
        # what each row of it reads: no later return than the one before its own period, once it is predictive
        vals = [r.seen for r in d.orderBy("t").collect()]
        changed = W.lag(W.forward_label(df.withColumn("r", F.when(F.col("t") == 7, 9.0).otherwise(F.col("r"))), "r", T, horizon, "label"), "label", T, k, "seen")
        moved = [i for i, (a, b) in enumerate(zip(vals, [r.seen for r in changed.orderBy("t").collect()], strict=True)) if a != b]
        assert bool(moved) and (min(moved) > 7 if known else min(moved) <= 7)
        for made in (W.rolling_mean(d, "seen", T, 2, "m"), W.rolling_std(d, "seen", T, 2, "m"), W.running_max(d, "seen", T, "m")):
            assert timing_of(made, "m") == timing_of(d, "seen")
        e = recurrences.ewma_vol(d, "seen", T, out="m")
        assert timing_of(e, "m") == (PREDICTIVE if k >= horizon - 1 else FORWARD)
        if not known:
            with pytest.raises(ValueError, match="forward"):
                W.vol_target(d, "seen", "x", 0.01, 1e4, 2.0)


def test_columns_without_a_class_are_refused(spark):
    df = W.lag(series(spark, [1.0, 2.0, 4.0]), "x", T, 1, "s").withColumn("twice", F.col("s") * 2)
    with pytest.raises(ValueError, match="declare"):
        W.vol_target(df, "twice", "x", 0.01, 1e4, 2.0)
    out = W.vol_target(declared(df, "twice", PREDICTIVE), "twice", "x", 0.01, 1e4, 2.0)
    assert timing_of(out, "units") == PREDICTIVE
    with pytest.raises(ValueError):
        declared(df, "twice", "someday")


def test_signed_positions_and_the_leak_they_refuse(spark):
    """The sign of tomorrow's return earns its absolute value every period; the lagged one doesn't."""
    prices = [100.0, 101.0, 99.0, 103.0, 102.0, 105.0, 101.0]
    df = W.simple_returns(series(spark, prices), "x", T, "r").withColumn("one", F.lit(1.0))
    with pytest.raises(ValueError, match="contemporaneous"):
        W.signed(df, "one", "r")
    leak = W.period_pnl(W.signed(df, "one", "r", unsafe=True), "position", "x", "r", T)
    fair = W.period_pnl(W.signed(W.lag(df, "r", T, 1, "known"), "one", "known"), "position", "x", "r", T)
    moves = [b - a for a, b in zip(prices, prices[1:], strict=False)]
    assert np.allclose(column(leak, "pnl"), [0.0, *map(abs, moves)])
    assert np.allclose(column(fair, "pnl"), [0.0, 0.0, *(np.sign(a) * b for a, b in zip(moves, moves[1:], strict=False))])


def test_drawdown(spark):
    e = series(spark, [100.0, 110.0, 99.0, 104.5, 120.0], "e")
    close(column(W.drawdown_scale(e, "e", T, 0.2), "scale"), [1, 1, 0.5, 0.75, 1])
    with pytest.raises(DomainError):
        W.drawdown_scale(series(spark, [1.0, -1.0, math.nan], "e"), "e", T, 0.2)
    with pytest.raises(ValueError):
        W.drawdown_scale(series(spark, [1.0, math.nan, -1.0], "e"), "e", T, 0.2)
    loose = W.drawdown_scale(series(spark, [1.0, math.nan, 2.0], "e"), "e", T, 0.2, strict=False)
    assert column(loose, "scale") == [1.0, None, None]
    assert column(loose, "scale_status") == [0, 1, 1]


def test_sizing(spark):
    df = spark.createDataFrame([(0, 0.01, 100.0), (1, 0.02, 100.0), (2, 0.015, 100.0), (3, math.nan, 100.0), (4, 0.01, math.inf), (5, 0.0, 1.0), (6, -1.0, 1.0), (7, None, 1.0)], "t long, s double, p double")
    close(column(df.select("t", S.vol_target_position("s", 0.01, 1e4, "p", 10.0).alias("u")), "u"), [100, 50, 200 / 3, 0, 0, 0, 0, 0])
    close(column(df.select("t", S.vol_target_position("s", 1.0, 1e4, "p", 2.0).alias("u")), "u")[:3], [200.0] * 3)
    for bad in (0, -1, math.inf, math.nan):
        with pytest.raises(ValueError):
            S.vol_target_position("s", bad, 1e4, "p", 1.0)


def test_range_volatility(spark):
    rows = [(0, 10.0, 12.0, 9.0, 11.0), (1, 10.0, 10.0, 10.0, 10.0), (2, 10.0, 9.0, 12.0, 11.0), (3, 13.0, 12.0, 9.0, 11.0), (4, 10.0, math.nan, 9.0, 9.5), (5, -1.0, 12.0, -2.0, 1.0)]
    df = spark.createDataFrame(rows, "t long, o double, h double, l double, c double")
    p = column(df.select("t", S.parkinson_vol("h", "l").alias("v")), "v")
    g = column(df.select("t", S.garman_klass_vol("o", "h", "l", "c").alias("v")), "v")
    hl, co = math.log(12 / 9), math.log(11 / 10)
    close(p, [math.sqrt(hl * hl / (4 * math.log(2))), 0, None, math.sqrt(hl * hl / (4 * math.log(2))), None, None])
    close(g, [math.sqrt(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co), 0, None, None, None, None])


def test_arguments(spark):
    df = series(spark, [1.0, 2.0])
    for bad in (0, -1, 1.5, "2", True):
        with pytest.raises((ValueError, TypeError)):
            W.rolling_mean(df, "x", T, bad)
    with pytest.raises(TypeError):
        W.rolling_mean(df.selectExpr("t", "cast(x as string) x"), "x", T, 2)
    assert count(3.0, "n") == 3
    with pytest.raises(ValueError):
        check_order(df.union(df), T)
    assert check_order(df, T) is df


def test_forward_label_and_keys(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2), ("b", 0, -1.0), ("b", 1, 0.5), ("b", 2, None)], "k string, t long, r double")
    spec = SeriesSpec.of("k", "t")
    got = {(r.k, r.t): r.label for r in W.forward_label(df, "r", spec, 2).collect()}
    close([got[("a", 0)], got[("a", 1)], got[("b", 0)], got[("b", 1)], got[("b", 2)]], [0.32, None, -1.0, None, None])

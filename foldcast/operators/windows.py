"""Windowed operators: lag, rolling mean and deviation, drawdown scaling, labels, equity curves, positions.

Each adds one column to a frame. All windows of one SeriesSpec share a partitioning and an order, so operators that
follow each other cost one shuffle and one sort together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import FORWARD, PREDICTIVE, DomainError, SeriesSpec, count, lagged, numeric, reach_of, timing_of, with_timed
from ..functions import scalars as S


def lag(df: DataFrame, x: str, spec: SeriesSpec, periods: int = 1, out: str | None = None) -> DataFrame:
    """The value ``periods`` rows before; what was contemporaneous is predictive then, and what looks ahead once it is
    lagged by all that it looks ahead."""
    k = count(periods, "periods")
    c = F.lag(F.col(x), k).over(spec.window()) if k else F.col(x)
    return with_timed(df, c, out or f"{x}_lag{k}", *lagged(*reach_of(df, x), k))


def position(df: DataFrame, spec: SeriesSpec, out: str = "pos") -> DataFrame:
    """Row number within its series, from 0."""
    return df.withColumn(out, (F.row_number().over(spec.window()) - 1).cast("long"))


def simple_returns(df: DataFrame, price: str, spec: SeriesSpec, out: str = "r") -> DataFrame:
    p = S.normalise(price)
    return with_timed(df, S.simple_return(p, F.lag(p).over(spec.window())), out, *reach_of(df, price))


def log_returns(df: DataFrame, price: str, spec: SeriesSpec, out: str = "r") -> DataFrame:
    p = S.normalise(price)
    return with_timed(df, S.log_return(p, F.lag(p).over(spec.window())), out, *reach_of(df, price))


def _values(x: str, spec: SeriesSpec, window: int) -> Column:
    """The finite values of the trailing frame (nulls are not collected)."""
    return F.collect_list(S.normalise(x)).over(spec.trailing(window))


def _mean(a: Column, n: int) -> Column:
    """Mean of an array, summed as offsets from its last value so that large levels don't overflow or cancel."""
    last = F.get(a, F.lit(n - 1))
    return last + F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - last)) / F.lit(float(n))


def rolling_mean(df: DataFrame, x: str, spec: SeriesSpec, window: int, out: str | None = None, method: str = "exact") -> DataFrame:
    """Mean of the last ``window`` rows; missing until there are so many, and while one of them is missing.

    ``exact`` sums offsets from the frame's last value; ``fast`` is the built-in average over the same frame.
    """
    numeric(df, x)
    w = count(window, "window", 1)
    name = out or f"{x}_mean{w}"
    if method == "fast":
        frame, v = spec.trailing(w), S.normalise(x)
        return with_timed(df, S.normalise(F.when(F.count(v).over(frame) == w, F.avg(v).over(frame))), name, *reach_of(df, x))
    held = f"_{name}_a"
    df = df.withColumn(held, _values(x, spec, w))
    return with_timed(df, S.normalise(F.when(F.size(held) == w, _mean(F.col(held), w))), name, *reach_of(df, x)).drop(held)


def rolling_std(df: DataFrame, x: str, spec: SeriesSpec, window: int, out: str | None = None, method: str = "exact") -> DataFrame:
    """Population deviation of the last ``window`` rows; missing as in rolling_mean; exactly 0 for constants.

    ``exact`` makes two passes over the frame's offsets from its last value; ``fast`` is the built-in, which loses
    digits where the level is large against the deviation.
    """
    numeric(df, x)
    w = count(window, "window", 1)
    name = out or f"{x}_std{w}"
    if method == "fast":
        frame, v = spec.trailing(w), S.normalise(x)
        return with_timed(df, S.normalise(F.when(F.count(v).over(frame) == w, F.stddev_pop(v).over(frame))), name, *reach_of(df, x))
    held, off, mean = f"_{name}_a", f"_{name}_o", f"_{name}_m"
    df = df.withColumn(held, _values(x, spec, w))
    df = df.withColumn(off, F.when(F.size(held) == w, F.transform(held, lambda v: v - F.get(held, F.lit(w - 1)))))
    df = df.withColumn(mean, F.aggregate(off, F.lit(0.0), lambda s, v: s + v) / F.lit(float(w)))
    var = F.aggregate(off, F.lit(0.0), lambda s, v: s + (v - F.col(mean)) * (v - F.col(mean))) / F.lit(float(w))
    return with_timed(df, S.normalise(F.sqrt(var)), name, *reach_of(df, x)).drop(held, off, mean)


def drawdown_scale(df: DataFrame, equity: str, spec: SeriesSpec, max_dd: float, out: str = "scale", strict: bool = True) -> DataFrame:
    """1 at a running peak of equity, falling to 0 where the drawdown reaches ``max_dd``.

    Equity must be finite and over 0 throughout: ``strict`` runs a job and raises for the first row that isn't;
    otherwise a series' rows from its first bad one are NULL, with ``<out>_status`` telling why.
    """
    if not 0 < float(max_dd) <= 1:
        raise ValueError(f"max_dd must be over 0 and at most 1: {max_dd!r}")
    numeric(df, equity)
    e = F.col(equity).cast("double")
    bad = F.when(~S.is_finite(e), 1).when(e <= 0, 4).otherwise(0)
    if strict:
        first = df.withColumn("_bad", bad).where("_bad > 0").orderBy(*spec.key, *spec.order).select("_bad").first()
        if first:
            raise (ValueError if first[0] == 1 else DomainError)("equity is not finite" if first[0] == 1 else "no drawdown from an equity that isn't over 0")
    run = spec.running()
    status = f"{out}_status"
    df = df.withColumn(status, F.coalesce(F.first(F.when(bad > 0, bad), ignorenulls=True).over(run), F.lit(0)))
    peak = F.max(F.when(bad == 0, e)).over(run)
    scale = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (1 - e / peak) / F.lit(float(max_dd))))
    df = with_timed(df, F.when(F.col(status) == 0, scale), out, *reach_of(df, equity))
    return df.drop(status) if strict else df


def forward_label(df: DataFrame, r: str, spec: SeriesSpec, horizon: int, out: str = "label") -> DataFrame:
    """Compounded return over [t, t + horizon): it looks ahead on purpose, as a label for fits only."""
    h = count(horizon, "horizon", 1)
    v, frame = S.normalise(r), spec.ahead(h)
    return with_timed(df, F.when(F.count(v).over(frame) == h, F.product(1 + v).over(frame) - 1), out, FORWARD, reach_of(df, r)[1] + h - 1)


def equity_curve(df: DataFrame, r: str, spec: SeriesSpec, out: str = "equity") -> DataFrame:
    """Running product of 1 + r (missing returns count as 0)."""
    return with_timed(df, F.product(1 + F.coalesce(S.normalise(r), F.lit(0.0))).over(spec.running()), out, *reach_of(df, r))


def running_max(df: DataFrame, x: str, spec: SeriesSpec, out: str = "peak") -> DataFrame:
    return with_timed(df, F.max(S.normalise(x)).over(spec.running()), out, *reach_of(df, x))


def vol_target(df: DataFrame, sigma: str, price: str, target_vol: float, equity: float, max_leverage: float, out: str = "units", unsafe: bool = False) -> DataFrame:
    """Positions from a forecast; refuses a sigma that isn't known before its own period, which must pass through lag first,
    and one without a class (an expression's): see contract.declared."""
    timing = timing_of(df, sigma)
    if timing != PREDICTIVE and not unsafe:
        raise ValueError(f"{sigma} is {timing or 'of no timing class'}: pass it through lag, declare it, or say unsafe=True")
    return with_timed(df, S.vol_target_position(sigma, target_vol, equity, price, max_leverage), out, *reach_of(df, sigma))


def signed(df: DataFrame, units: str, signal: str, out: str = "position", unsafe: bool = False) -> DataFrame:
    """Units in the direction of a signal: its sign times the units; 0 where either is missing. As in vol_target, the signal must
    be known before its period."""
    timing = timing_of(df, signal)
    if timing != PREDICTIVE and not unsafe:
        raise ValueError(f"{signal} is {timing or 'of no timing class'}: pass it through lag, declare it, or say unsafe=True")
    held = F.signum(S.normalise(signal)) * S.normalise(units)
    return with_timed(df, F.coalesce(held, F.lit(0.0)), out, *reach_of(df, units, signal))


def period_pnl(df: DataFrame, units: str, price: str, r: str, spec: SeriesSpec, out: str = "pnl") -> DataFrame:
    """units[t] * price[t-1] * r[t]."""
    return df.withColumn(out, F.coalesce(F.col(units) * F.lag(F.col(price)).over(spec.window()) * F.col(r), F.lit(0.0)))


__all__ = ["Window", "drawdown_scale", "equity_curve", "forward_label", "lag", "log_returns", "period_pnl", "position", "rolling_mean", "rolling_std", "running_max", "signed", "simple_returns", "vol_target"]

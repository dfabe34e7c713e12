"""Queries by name: each operator applied to the driver's tables, and the SQL that must give the same rows.

``px`` are daily bars of orders, ``tk`` ticks of events per event type. Results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import PREDICTIVE, SeriesSpec, declared
from ..functions import scalars as S
from ..operators import fits, folds, recurrences
from ..operators import windows as W
from ..sources import bars
from . import lookback

Query = Callable[[SparkSession, str], DataFrame]

PX = SeriesSpec.of(None, "d")
TK = SeriesSpec.of("key", ["ts", "event_id"])
MODEL = {"omega": 2e-3, "alpha": 0.05, "beta": 0.85, "backcast": 0.5, "sigma2_next": 0.3}
GAP = 100_000.0  # bars that close lower count as missing in the queries on gaps
FOLD = {"train_size": 120, "test_size": 40, "step": 40, "label_horizon": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.daily_bars(table(spark, sf_dir, "orders"))


def tk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "ts", "event_id", F.col("value").alias("price"))


def r6(c: Column | str, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name)


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PX_SQL = "px AS (SELECT o_orderdate AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS n FROM orders GROUP BY 1)"
PR_SQL = PX_SQL + ", pr AS (SELECT *, close / lag(close) OVER (ORDER BY d) - 1 AS r, row_number() OVER (ORDER BY d) - 1 AS pos FROM px)"
TK_SQL = "tk AS (SELECT event_type AS key, ts, event_id, value AS price FROM events)"
TR_SQL = TK_SQL + ", tr AS (SELECT *, ln(price) - ln(lag(price) OVER (PARTITION BY key ORDER BY ts, event_id)) AS r FROM tk)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


@query(f"WITH {PX_SQL} SELECT d, open, high, low, close, n FROM px")
def daily_bars(spark, d):
    return px(spark, d)


@query(f"WITH {PX_SQL} SELECT d, lag(close, 3) OVER (ORDER BY d) AS lagged FROM px")
def lag_close(spark, d):
    return W.lag(px(spark, d), "close", PX, 3, "lagged").select("d", "lagged")


@query(f"WITH {PR_SQL} SELECT d, round(r, 6) AS r FROM pr")
def simple_returns(spark, d):
    return W.simple_returns(px(spark, d), "close", PX).select("d", r6("r", "r"))


@query(f"WITH {TR_SQL} SELECT event_id, round(r, 6) AS r FROM tr")
def log_returns(spark, d):
    return W.log_returns(tk(spark, d), "price", TK).select("event_id", r6("r", "r"))


def rolled(what: str, by: str, order: str, x: str) -> str:
    frame = f"OVER ({by} ORDER BY {order} ROWS 19 PRECEDING)"
    return f"CASE WHEN count({x}) {frame} = 20 THEN round({what}({x}) {frame}, 6) END"


@query(f"WITH {PX_SQL} SELECT d, {rolled('avg', '', 'd', 'close')} AS m FROM px")
def rolling_mean_20(spark, d):
    return W.rolling_mean(px(spark, d), "close", PX, 20, "m").select("d", r6("m", "m"))


@query(f"WITH {TK_SQL} SELECT event_id, {rolled('avg', 'PARTITION BY key', 'ts, event_id', 'price')} AS m FROM tk")
def rolling_mean_20_ticks(spark, d):
    return W.rolling_mean(tk(spark, d), "price", TK, 20, "m", method="fast").select("event_id", r6("m", "m"))


@query(f"WITH {PX_SQL} SELECT d, {rolled('stddev_pop', '', 'd', 'close')} AS sd FROM px")
def rolling_std_20(spark, d):
    return W.rolling_std(px(spark, d), "close", PX, 20, "sd").select("d", r6("sd", "sd"))


@query(f"WITH {TK_SQL} SELECT event_id, {rolled('stddev_pop', 'PARTITION BY key', 'ts, event_id', 'price')} AS sd FROM tk")
def rolling_std_20_ticks(spark, d):
    return W.rolling_std(tk(spark, d), "price", TK, 20, "sd").select("event_id", r6("sd", "sd"))


@query(f"WITH {PX_SQL}, x AS (SELECT d, {rolled('avg', '', 'd', 'close')} AS m FROM px) SELECT d, m FROM x WHERE d >= TIMESTAMP '1996-01-01' AND d < TIMESTAMP '1996-07-01'")
def rolling_mean_stretch(spark, d):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-07-01"))
    x = lookback.between(px(spark, d).select("d", "close"), PX, low, high, 19, lambda rows: W.rolling_mean(rows, "close", PX, 20, "m"))
    return x.select("d", r6("m", "m"))


@query(f"WITH {PX_SQL} SELECT round(stddev_pop(r) / 0.5, 6) AS ratio FROM (SELECT close / lag(close) OVER (ORDER BY d) - 1 AS r FROM px)")
def realised_over_target(spark, d):
    x = W.simple_returns(px(spark, d), "close", PX)
    return fits.realised_over_target(x, "r", [], 0.5).select(r6("ratio", "ratio"))


@query(f"WITH {PX_SQL} SELECT d, open, close FROM px WHERE close >= {GAP} AND open >= {GAP}")
def complete_cases(spark, d):
    x = px(spark, d).select("d", *[F.when(F.col(c) >= GAP, F.col(c)).otherwise(F.lit(float("nan"))).alias(c) for c in ("open", "close")])
    return S.complete_cases(x, ["open", "close"])


@query(f"WITH {TK_SQL} SELECT event_id, {rolled('stddev_pop', 'PARTITION BY key', 'ts, event_id', 'price')} AS sd FROM tk")
def rolling_std_fast(spark, d):
    return W.rolling_std(tk(spark, d), "price", TK, 20, "sd", method="fast").select("event_id", r6("sd", "sd"))


@query(f"WITH {PX_SQL}, g AS (SELECT d, CASE WHEN close >= {GAP} THEN close END AS x FROM px) SELECT d, {rolled('stddev_pop', '', 'd', 'x').replace('19', '4').replace('20', '5')} AS sd, {rolled('avg', '', 'd', 'x').replace('19', '4').replace('20', '5')} AS m FROM g")
def rolling_gaps(spark, d):
    g = px(spark, d).select("d", F.when(F.col("close") >= GAP, F.col("close")).otherwise(F.lit(float("nan"))).alias("x"))
    g = W.rolling_mean(W.rolling_std(g, "x", PX, 5, "sd"), "x", PX, 5, "m")
    return g.select("d", r6("sd", "sd"), r6("m", "m"))


@query(f"WITH {PX_SQL} SELECT d, round(abs(ln(high / low)) / sqrt(4 * ln(2)), 6) AS v FROM px")
def parkinson(spark, d):
    return px(spark, d).select("d", r6(S.parkinson_vol("high", "low"), "v"))


@query(f"WITH {PX_SQL} SELECT d, round(sqrt(greatest(0, 0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open))), 6) AS v FROM px")
def garman_klass(spark, d):
    return px(spark, d).select("d", r6(S.garman_klass_vol("open", "high", "low", "close"), "v"))


@query(f"WITH {PX_SQL}, b AS (SELECT d, CASE WHEN close < {GAP} THEN low ELSE high END AS high, CASE WHEN close < {GAP} THEN high ELSE low END AS low FROM px) SELECT count(*) FILTER (WHERE high < low) AS bad, count(*) AS n FROM b")
def bad_bars(spark, d):
    swap = F.col("close") < GAP
    b = px(spark, d).select(F.when(swap, F.col("low")).otherwise(F.col("high")).alias("high"), F.when(swap, F.col("high")).otherwise(F.col("low")).alias("low"))
    return b.agg(F.count_if(S.parkinson_vol("high", "low").isNull()).alias("bad"), F.count("*").alias("n"))


@query("SELECT event_type AS key, time_bucket(INTERVAL '1 day', ts) AS d, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def tick_bars(spark, d):
    t = tk(spark, d).withColumn("o", F.struct("ts", "event_id")).withColumn("d", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return bars.bars(t, ["key", "d"], "price", "o")


def ewma_sql(base: str, part: str, order: str, ids: str, lam: float = 0.94) -> str:
    """Closed form: after return i, var = lam^i * (r0^2 + (1 - lam) * sum over j >= 1 of r_j^2 / lam^j)."""
    return f"""
, u AS (SELECT *, count(r) OVER ({part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM {base}),
s AS (SELECT *, sum(CASE WHEN r IS NULL THEN 0 WHEN k = 0 THEN r * r ELSE {1 - lam} * r * r * pow({lam}, -k) END) OVER ({part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM u)
SELECT {ids}, CASE WHEN k > 0 THEN round(sqrt(c * pow({lam}, k - 1)), 6) END AS vol FROM s"""


@query(f"WITH {PR_SQL} {ewma_sql('pr', '', 'd', 'd')}")
def ewma_094(spark, d):
    return recurrences.ewma_vol(W.simple_returns(px(spark, d), "close", PX), "r", PX, out="vol").select("d", r6("vol", "vol"))


@query(f"WITH {PR_SQL} {ewma_sql('pr', '', 'd', 'd')}")
def ewma_blocked(spark, d):
    return recurrences.ewma_vol_blocked(W.simple_returns(px(spark, d), "close", PX), "r", PX, out="vol", block=256).select("d", r6("vol", "vol"))


@query(f"WITH {TR_SQL} {ewma_sql('tr', 'PARTITION BY key', 'ts, event_id', 'event_id')}")
def ewma_by_type(spark, d):
    return recurrences.ewma_vol(W.log_returns(tk(spark, d), "price", TK), "r", TK, out="vol").select("event_id", r6("vol", "vol"))


@query(f"WITH {PR_SQL}, g AS (SELECT d, CASE WHEN close >= {GAP} THEN r END AS r FROM pr) {ewma_sql('g', '', 'd', 'd', 0.9)}")
def ewma_gaps(spark, d):
    x = W.simple_returns(px(spark, d), "close", PX).withColumn("r", F.when(F.col("close") >= GAP, F.col("r")))
    return recurrences.ewma_vol(x, "r", PX, 0.9, "vol").select("d", r6("vol", "vol"))


def garch_sql(base: str, first: str) -> str:
    """Closed form of the affine recurrence: s_t = A_t * (s_0 + sum over i < t of b_i / A_{i+1})."""
    m = MODEL
    run = "OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
, c AS (SELECT d, ln(CASE WHEN r IS NULL THEN {m['alpha'] + m['beta']} ELSE {m['beta']} END) AS la, CASE WHEN r IS NULL THEN {m['omega']} ELSE {m['omega']} + {m['alpha']} * r * r END AS b FROM {base}),
e AS (SELECT *, coalesce(sum(la) {run}, 0) AS lt, sum(la) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS lu FROM c),
f AS (SELECT d, exp(lt) * ({first} + coalesce(sum(b * exp(-lu)) {run}, 0)) AS s2 FROM e)
SELECT d, round(sqrt(s2), 6) AS vol FROM f"""


SEED = MODEL["omega"] + (MODEL["alpha"] + MODEL["beta"]) * MODEL["backcast"]


@query(f"WITH {PR_SQL} {garch_sql('pr', repr(SEED))}")
def garch_filter_fixed(spark, d):
    return recurrences.garch_filter(W.simple_returns(px(spark, d), "close", PX), "r", PX, MODEL, "vol").select("d", r6("vol", "vol"))


@query(f"WITH {PR_SQL} {garch_sql('pr', repr(SEED))}")
def garch_filter_blocked(spark, d):
    return recurrences.garch_filter_blocked(W.simple_returns(px(spark, d), "close", PX), "r", PX, MODEL, "vol", block=200).select("d", r6("vol", "vol"))


@query(f"WITH {PR_SQL} {garch_sql('pr', repr(MODEL['sigma2_next']))}")
def garch_filter_from_fixed(spark, d):
    return recurrences.garch_filter(W.simple_returns(px(spark, d), "close", PX), "r", PX, MODEL, "vol", resume=True).select("d", r6("vol", "vol"))


@query(f"WITH {PR_SQL}, g AS (SELECT d, CASE WHEN close >= {GAP} THEN r END AS r FROM pr) {garch_sql('g', repr(SEED))}")
def garch_filter_gaps(spark, d):
    x = W.simple_returns(px(spark, d), "close", PX).withColumn("r", F.when(F.col("close") >= GAP, F.col("r")))
    return recurrences.garch_filter(x, "r", PX, MODEL, "vol").select("d", r6("vol", "vol"))


MODELS = [("a", 2e-6, 0.10, 0.85, 5e-5), ("b", 5e-6, 0.05, 0.93, 1e-4), ("c", 1e-5, 0.0, 0.0, 2e-5)]
MODELS_SQL = "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {o}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE, {s}::DOUBLE)" for k, o, a, b, s in MODELS) + ") v(key, omega, alpha, beta, sigma2_next))"


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "key string, omega double, alpha double, beta double, sigma2_next double")


@query(f"WITH {MODELS_SQL} SELECT key, h::INT AS h, round(sqrt(omega / (1 - alpha - beta) + pow(alpha + beta, h) * (sigma2_next - omega / (1 - alpha - beta))), 6) AS vol FROM m, range(20) t(h)")
def garch_forecast_fixed(spark, d):
    return recurrences.garch_forecast(models(spark), 20).select("key", "h", r6("vol", "vol"))


@query(f"WITH {MODELS_SQL} SELECT key, round(alpha + beta, 6) AS persistence, round(omega / (1 - alpha - beta), 6) AS variance, round(sqrt(omega / (1 - alpha - beta)), 6) AS vol, round(CASE WHEN alpha + beta <= 0 THEN 0 ELSE ln(0.5) / ln(alpha + beta) END, 6) AS half_life FROM m")
def garch_derived(spark, d):
    return recurrences.garch_derived(models(spark)).select("key", r6("persistence", "persistence"), r6("unconditional_variance", "variance"), r6("unconditional_vol", "vol"), r6("half_life", "half_life"))


def sized_sql(sigma: str, leverage: float) -> str:
    free = f"0.01 / ({sigma}) * (100000.0 / close)"
    return f"CASE WHEN ({sigma}) > 0 AND close > 0 THEN round(CASE WHEN {free} * close > {leverage * 1e5} THEN {leverage * 1e5} / close ELSE {free} END, 6) ELSE 0 END AS units"


PARK = "abs(ln(high / low)) / sqrt(4 * ln(2))"


@query(f"WITH {PX_SQL} SELECT d, {sized_sql(PARK, 1e6)} FROM px")
def vol_target(spark, d):
    x = px(spark, d).withColumn("sigma", S.parkinson_vol("high", "low"))
    return x.select("d", r6(S.vol_target_position("sigma", 0.01, 1e5, "close", 1e6), "units"))


@query(f"WITH {PX_SQL} SELECT d, {sized_sql(PARK, 0.02)} FROM px")
def vol_target_capped(spark, d):
    x = px(spark, d).withColumn("sigma", S.parkinson_vol("high", "low"))
    return x.select("d", r6(S.vol_target_position("sigma", 0.01, 1e5, "close", 0.02), "units"))


@query(f"WITH {PX_SQL}, b AS (SELECT d, close, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN -1.0 WHEN 2 THEN 0.0 ELSE 0.05 END::DOUBLE AS sigma FROM px) SELECT d, {sized_sql('sigma', 2.0)} FROM b")
def vol_target_bad_inputs(spark, d):
    n = F.col("n") % 4
    x = px(spark, d).withColumn("sigma", F.when(n == 0, F.lit(float("nan"))).when(n == 1, F.lit(-1.0)).when(n == 2, F.lit(0.0)).otherwise(F.lit(0.05)))
    return x.select("d", r6(S.vol_target_position("sigma", 0.01, 1e5, "close", 2.0), "units"))


@query(f"WITH {TR_SQL} SELECT key, round(0.5 * avg(r) / var_samp(r), 6) AS kelly, 0 AS status FROM tr WHERE r IS NOT NULL GROUP BY key")
def kelly_by_type(spark, d):
    x = W.log_returns(tk(spark, d), "price", TK).where("r IS NOT NULL")
    return fits.kelly_fraction(x, "r", ["key"], 0.5, infinite=True).select("key", r6("kelly", "kelly"), "status")


@query(f"WITH {PX_SQL}, p AS (SELECT d, close, max(close) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM px) SELECT d, round(greatest(0, least(1, 1 - (1 - close / peak) / 0.5)), 6) AS scale FROM p")
def drawdown_scale_px(spark, d):
    return W.drawdown_scale(px(spark, d), "close", PX, 0.5).select("d", r6("scale", "scale"))


@query(f"WITH {PR_SQL} SELECT d, CASE WHEN count(r) OVER w = 5 THEN round(product(1 + r) OVER w - 1, 6) END AS label FROM pr WINDOW w AS (ORDER BY d ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)")
def forward_label_5(spark, d):
    return W.forward_label(W.simple_returns(px(spark, d), "close", PX), "r", PX, 5).select("d", r6("label", "label"))


def splits_sql(n: int, train: int, test: int, step: int, purge: int, post: int | None = None) -> str:
    last = f"CASE WHEN i * {step} + {train + test + post} < {n} THEN i * {step} + {train + test + post} ELSE {n} END" if post is not None else str(n)
    return f"SELECT i AS fold, i * {step} AS train_start, i * {step} + {train - purge} AS train_end, i * {step} + {train} AS test_start, i * {step} + {train + test} AS test_end, ({last})::BIGINT AS train_post_start, {n}::BIGINT AS train_post_end FROM range(0, ({n} - {train + test}) // {step} + 1) t(i)"


@query(splits_sql(1000, 200, 50, 25, 0))
def splits_plain(spark, d):
    return folds.walk_forward_splits(spark, 1000, 200, 50, 25)


@query(splits_sql(1000, 200, 50, 50, 4))
def splits_purged(spark, d):
    return folds.walk_forward_splits(spark, 1000, 200, 50, label_horizon=5)


@query(splits_sql(60, 20, 10, 10, 3, 5))
def splits_post_train(spark, d):
    return folds.walk_forward_splits(spark, 60, 20, 10, 10, purge=3, embargo=5, include_post_train=True)


def positioned(spark: SparkSession, d: str) -> DataFrame:
    x = W.position(W.simple_returns(px(spark, d), "close", PX), PX)
    return x.withColumn("size", F.count("*").over(SeriesSpec.of(None, "d").window().rowsBetween(-(2**63), 2**63 - 1)))


def folded(spark: SparkSession, d: str, **other) -> DataFrame:
    return folds.assign_folds(positioned(spark, d), "pos", "size", **(FOLD | other))


def fold_rows_sql(purge: int = 4, post: bool = False) -> str:
    extra = " UNION ALL SELECT fold, pos, d, r, close, 'post' AS role FROM f, pr WHERE pos >= fold * 40 + 165" if post else ""
    return f"""{PR_SQL}, sz AS (SELECT count(*) AS n FROM pr), f AS (SELECT unnest(range((n - 160) // 40 + 1)) AS fold FROM sz WHERE n >= 160),
fr AS (SELECT fold, pos, d, r, close, CASE WHEN pos < fold * 40 + {120 - purge} THEN 'train' WHEN pos < fold * 40 + 120 THEN 'gap' ELSE 'test' END AS role FROM f, pr WHERE pos >= fold * 40 AND pos < fold * 40 + 160{extra})"""


@query(f"WITH {fold_rows_sql()} SELECT fold, pos, role FROM fr")
def fold_rows(spark, d):
    return folded(spark, d).select("fold", "pos", "role")


@query(f"WITH {fold_rows_sql(post=True)} SELECT fold, role, count(*) AS n, min(pos) AS first, max(pos) AS last FROM fr GROUP BY fold, role")
def fold_roles_post(spark, d):
    return folded(spark, d, embargo=5, include_post_train=True).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query(f"WITH {fold_rows_sql(4)}, gr AS (SELECT * FROM fr), a AS (SELECT count(*) FILTER (WHERE role = 'train' AND pos + 5 > fold * 40 + 120) AS leaks FROM fr) SELECT 4 AS purge, leaks FROM a UNION ALL SELECT 3 AS purge, (SELECT max(fold) + 1 FROM fr) AS leaks")
def leak_count(spark, d):
    out = None
    for purge in (4, 3):
        leak = F.count_if((F.col("role") == "train") & (F.col("pos") + 5 > F.col("fold") * 40 + 120))
        one = folded(spark, d, purge=purge).agg(F.lit(purge).alias("purge"), leak.alias("leaks"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT l_returnflag, round(regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 10), 6) AS slope, round(avg(l_extendedprice) - regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 10) * avg(l_quantity), 4) AS intercept, 0 AS status FROM lineitem GROUP BY 1")
def ridge_1d(spark, d):
    m = fits.ridge_fit(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", ["l_returnflag"], [], 10.0)
    return m.select("l_returnflag", r6(F.col("coef")[0], "slope"), F.round("intercept", 4).alias("intercept"), "status")


TWO_SQL = "s AS (SELECT regr_sxx(l_extendedprice, l_quantity) + 2 AS a, regr_sxx(l_extendedprice, l_discount) + 2 AS c, regr_sxy(l_discount, l_quantity) AS b, regr_sxy(l_extendedprice, l_quantity) AS u, regr_sxy(l_extendedprice, l_discount) AS v, avg(l_extendedprice) AS y, avg(l_quantity) AS q, avg(l_discount) AS p FROM lineitem), w AS (SELECT (c * u - b * v) / (a * c - b * b) AS w1, (a * v - b * u) / (a * c - b * b) AS w2, y, q, p FROM s)"


@query(f"WITH {TWO_SQL} SELECT round(w1, 4) AS w1, round(w2, 4) AS w2, round(y - w1 * q - w2 * p, 3) AS intercept FROM w")
def ridge_2d(spark, d):
    m = fits.ridge_fit_large(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", 2.0)
    return spark.range(1).select(F.round(F.lit(m["coef"][0]), 4).alias("w1"), F.round(F.lit(m["coef"][1]), 4).alias("w2"), F.round(F.lit(m["intercept"]), 3).alias("intercept"))


@query(f"WITH {TWO_SQL} SELECT l_returnflag, round(avg(y + w1 * (l_quantity - q) + w2 * (l_discount - p)), 3) AS predicted, round(avg(l_extendedprice), 3) AS actual FROM lineitem, w GROUP BY 1")
def ridge_predict(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_extendedprice")
    p = fits.Ridge(2.0).fit(x, ["l_quantity", "l_discount"], "l_extendedprice").predict(x)
    return p.groupBy("l_returnflag").agg(F.round(F.avg("prediction"), 3).alias("predicted"), F.round(F.avg("l_extendedprice"), 3).alias("actual"))


TWO_BY_SQL = TWO_SQL.replace("s AS (SELECT ", "s AS (SELECT l_returnflag, ").replace("FROM lineitem)", "FROM lineitem GROUP BY l_returnflag)").replace("w AS (SELECT ", "w AS (SELECT l_returnflag, ")


@query(f"WITH {TWO_BY_SQL} SELECT l_returnflag, round(avg((y + w1 * (l_quantity - q) + w2 * (l_discount - p)) * l_quantity), 2) AS moment FROM lineitem JOIN w USING (l_returnflag) GROUP BY 1")
def ridge_predict_reordered(spark, d):
    """A model table's coefficients are found by name: asked in another order than fitted."""
    x = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_extendedprice")
    m = fits.ridge_fit(x, ["l_quantity", "l_discount"], "l_extendedprice", ["l_returnflag"], [], 2.0)
    p = fits.ridge_predict(x, m, ["l_discount", "l_quantity"], ["l_returnflag"])
    return p.groupBy("l_returnflag").agg(F.round(F.avg(F.col("prediction") * F.col("l_quantity")), 2).alias("moment"))


LAGGED_SQL = fold_rows_sql() + ", lg AS (SELECT fr.*, pr2.r AS x FROM fr LEFT JOIN pr pr2 ON pr2.pos = fr.pos - 1), tr AS (SELECT fold, regr_slope(r, x) AS w, regr_intercept(r, x) AS b FROM lg WHERE role = 'train' AND x IS NOT NULL AND r IS NOT NULL GROUP BY fold)"


def fold_regression(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = positioned(spark, d)
    x = W.lag(x, "r", PX, 1, "x")
    f = folds.assign_folds(x, "pos", "size", **FOLD).where("x IS NOT NULL AND r IS NOT NULL")
    return f, fits.ridge_fit(f.where("role = 'train'"), ["x"], "r", ["fold"], ["pos"])


@query(f"WITH {LAGGED_SQL} SELECT fold, round(w, 6) AS slope, round(b, 6) AS intercept FROM tr")
def ols_1d_by_fold(spark, d):
    return fold_regression(spark, d)[1].select("fold", r6(F.col("coef")[0], "slope"), r6("intercept", "intercept"))


@query(f"WITH {LAGGED_SQL}, p AS (SELECT lg.fold, r, b + w * x AS p FROM lg JOIN tr ON tr.fold = lg.fold WHERE role = 'test') SELECT fold, round(avg(CASE WHEN sign(p) = sign(r) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(corr(p, r), 6) AS correlation, count(*) AS n FROM p GROUP BY fold")
def fold_hit_rate(spark, d):
    f, m = fold_regression(spark, d)
    p = fits.ridge_predict(f.where("role = 'test'"), m, ["x"], ["fold"])
    return fits.hit_rate(p, "prediction", "r", ["fold"]).select("fold", r6("hit_rate", "hit_rate"), r6("correlation", "correlation"), "n")


@query(f"WITH {fold_rows_sql()}, t AS (SELECT fold, avg(close) AS m, stddev_pop(close) AS s FROM fr WHERE role = 'train' GROUP BY fold) SELECT fr.fold, pos, round((close - m) / s, 6) AS z, round(close - m, 4) AS dm FROM fr JOIN t ON t.fold = fr.fold WHERE role = 'test'")
def fold_standardised(spark, d):
    f = fits.demeaned(fits.standardised(folded(spark, d), ["close"], ["fold"]), "close", ["fold"])
    return f.where("role = 'test'").select("fold", "pos", r6("close_z", "z"), F.round("close_d", 4).alias("dm"))


@query(f"WITH {TR_SQL}, x AS (SELECT key, ts, event_id, coalesce(r, 0) / 100 AS r FROM tr), e AS (SELECT *, product(1 + r) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS e FROM x), p AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p FROM e) SELECT key, round(avg(r) * 252, 6) AS annual_return, round(stddev_samp(r) * sqrt(252), 6) AS annual_vol, round(min(e / p - 1), 6) AS max_drawdown, round(avg(r) * 252 / (stddev_samp(r) * sqrt(252)), 6) AS sharpe, count(*) AS n FROM p GROUP BY key")
def strategy_summary(spark, d):
    x = W.log_returns(tk(spark, d), "price", TK).withColumn("r", F.col("r") / 100)
    return fits.strategy_summary(x, "r", TK, infinite=True).select("key", *[r6(c, c) for c in ("annual_return", "annual_vol", "max_drawdown", "sharpe")], "n")


@query(f"WITH {PR_SQL}, x AS (SELECT d, coalesce(r, 0) / 1000 AS r FROM pr), e AS (SELECT d, product(1 + r) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS equity FROM x) SELECT d, round(equity, 6) AS equity, round(max(equity) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 6) AS peak FROM e")
def equity_curve(spark, d):
    x = W.simple_returns(px(spark, d), "close", PX).withColumn("r", F.col("r") / 1000)
    return W.running_max(W.equity_curve(x, "r", PX), "equity", PX).select("d", r6("equity", "equity"), r6("peak", "peak"))


@query(f"WITH {PX_SQL} SELECT d, round({PARK}, 6) AS park, round(0.16 / sqrt(252), 6) AS period FROM px")
def sql_functions(spark, d):
    S.register_sql(spark)
    return px(spark, d).select("d", F.expr("round(parkinson_vol(high, low), 6)").alias("park"), F.expr("round(period_vol(0.16D, 252D), 6)").alias("period"))


@query(f"WITH {PX_SQL}, b AS (SELECT d, high, low, close, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN -1.0 WHEN 2 THEN 1e300 ELSE 0.05 END::DOUBLE AS sigma FROM px) SELECT d, CASE WHEN sigma > 1 THEN 0 WHEN sigma > 0 THEN round(least(0.01 / sigma * (100000.0 / close), 200000.0 / close), 6) ELSE 0 END AS units, round({PARK}, 6) AS park, NULL::DOUBLE AS overflow, NULL::DOUBLE AS refused FROM b")
def sql_functions_edges(spark, d):
    """The SQL forms where column forms are missing or 0: no forecast, a position under the least normal number, overflow."""
    S.register_sql(spark)
    n = F.col("n") % 4
    x = px(spark, d).withColumn("sigma", F.when(n == 0, F.lit(None)).when(n == 1, F.lit(-1.0)).when(n == 2, F.lit(1e300)).otherwise(F.lit(0.05)).cast("double"))
    units = "CASE WHEN sigma > 1 THEN vol_target_position(sigma, 1e-10D, 1D, 1D, 1D) ELSE round(vol_target_position(sigma, 0.01D, 100000D, close, 2D), 6) END AS units"
    return x.selectExpr("d", units, "round(parkinson_vol(high, low), 6) AS park", "parkinson_vol(1e308D, 1e-308D) AS overflow", "vol_target_position(sigma, -1D, 1D, close, 1D) AS refused")


@query(f"WITH {PX_SQL} SELECT d, {sized_sql(PARK, 1.5)} FROM px")
def risk_cap(spark, d):
    x = px(spark, d).withColumn("sigma", S.parkinson_vol("high", "low"))
    return x.select("d", r6(S.risk_cap_position("sigma", 0.01, 1e5, "close", 1.5), "units"))


@query("SELECT k, CASE WHEN o > 0 AND a >= 0 AND b >= 0 AND a + b < 0.9999 THEN true ELSE false END AS feasible FROM (VALUES (1, 1e-6, 0.1, 0.85), (2, 0.0, 0.1, 0.8), (3, 1e-6, 0.2, 0.8), (4, 1e-6, -0.1, 0.8), (5, 1e-6, 0.1, 0.8998), (6, 1e-6, 0.1, 0.89991), (7, NULL, 0.1, 0.8)) t(k, o, a, b)")
def garch_feasible(spark, d):
    rows = [(1, 1e-6, 0.1, 0.85), (2, 0.0, 0.1, 0.8), (3, 1e-6, 0.2, 0.8), (4, 1e-6, -0.1, 0.8), (5, 1e-6, 0.1, 0.8998), (6, 1e-6, 0.1, 0.89991), (7, None, 0.1, 0.8)]
    return spark.createDataFrame(rows, "k int, o double, a double, b double").select("k", F.coalesce(S.valid_garch("o", "a", "b"), F.lit(False)).alias("feasible"))


@query(f"WITH {PR_SQL} SELECT d, round(coalesce(sign(x) * u, 0), 6) AS position FROM (SELECT d, lag(r) OVER (ORDER BY d) AS x, CASE WHEN b > 0 THEN least(0.01 / 0.05 * (100000.0 / b), 200000.0 / b) END AS u FROM (SELECT *, lag(close) OVER (ORDER BY d) AS b FROM pr))")
def signed_positions(spark, d):
    """Positions in the direction of what was known: the return of the period before."""
    x = W.simple_returns(px(spark, d), "close", PX)
    x = W.lag(W.lag(x, "r", PX, 1, "signal"), "close", PX, 1, "before")
    x = declared(x.withColumn("sigma", F.lit(0.05)), "sigma", PREDICTIVE)
    x = W.vol_target(x, "sigma", "before", 0.01, 1e5, 2.0)
    return W.signed(x, "units", "signal").select("d", r6("position", "position"))


@query(splits_sql(500, 100, 20, 10, 2))
def splits_table_function(spark, d):
    folds.register_folds(spark)
    return spark.sql("SELECT * FROM walk_forward_splits(500, 100, 20, 10, 2, 0, false)")


VOL_TARGET_SQL = f"WITH {PR_SQL} {ewma_sql('pr', '', 'd', 'd, r, close').replace('round(sqrt(c * pow(0.94, k - 1)), 6)', 'sqrt(c * pow(0.94, k - 1))')}"


@query(f"""SELECT d, round(units, 6) AS units, round(coalesce(units * before * r, 0), 4) AS pnl FROM (
SELECT d, r, before, CASE WHEN vol > 0 AND before > 0 THEN least(0.01 / vol * (100000.0 / before), 200000.0 / before) ELSE 0 END AS units
FROM (SELECT *, lag(close) OVER (ORDER BY d) AS before FROM ({VOL_TARGET_SQL})))""")
def vol_target_strategy(spark, d):
    """The whole loop: daily returns, EWMA forecast, position on the previous close, profit."""
    x = W.simple_returns(px(spark, d), "close", PX)
    x = recurrences.ewma_vol(x, "r", PX, out="vol")
    x = W.lag(x, "close", PX, 1, "before")
    x = W.vol_target(x, "vol", "before", 0.01, 1e5, 2.0)
    return W.period_pnl(x, "units", "close", "r", PX).select("d", r6("units", "units"), F.round("pnl", 4).alias("pnl"))


@query()
def garch_fit_by_type(spark, d):
    x = W.log_returns(tk(spark, d), "price", TK).where(S.is_finite("r"))
    m = fits.garch_fit(x, "r", TK)
    return m.select("key", r6("omega", "omega"), r6("alpha", "alpha"), r6("beta", "beta"), r6("loglik", "loglik"), "converged", "status")


@query()
def fold_vol_target_summary(spark, d):
    """Per fold: a GARCH model of the training rows, filtered through gap and test, sized on test rows, summed up."""
    spec = SeriesSpec.of("fold", "pos")
    x = W.lag(positioned(spark, d), "close", PX, 1, "before")
    f = folds.assign_folds(x, "pos", "size", 250, 100, 100, label_horizon=5).where("r IS NOT NULL")
    f = fits.demeaned(f, "r", ["fold"]).select("fold", "pos", "role", "r", "r_d", "before")
    models_ = fits.garch_fit(f.where("role = 'train'"), "r_d", spec)
    later = recurrences.garch_filter(f.where("role <> 'train'"), "r_d", spec, models_.where("status = 0"), "vol", resume=True)
    sized = W.vol_target(later.where("role = 'test'"), "vol", "before", 0.01, 1e5, 2.0)
    ret = sized.withColumn("pnl", F.col("units") * F.col("before") * F.col("r") / 1e5)
    return fits.strategy_summary(ret, "pnl", spec).select("fold", r6("annual_return", "annual_return"), r6("annual_vol", "annual_vol"), r6("max_drawdown", "max_drawdown"), "n")


@query(f"WITH {TK_SQL}, g AS (SELECT key, ts, event_id, price AS r FROM tk) {ewma_sql('g', 'PARTITION BY key', 'ts, event_id', 'key, ts, 0::BIGINT AS late')}")
def stream_ewma_by_type(spark, d):
    """The streaming EWMA over the event files, run to the end of what is there."""
    from ..streaming import replay_ewma

    return replay_ewma(spark, f"{d}/events.parquet").select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("vol", "vol"), "late")

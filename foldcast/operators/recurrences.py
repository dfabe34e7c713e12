"""First-order recurrences over series: EWMA volatility and the GARCH(1,1) filter, and forecasts.

Default: one Arrow group per series, in order, bit for bit the same however a series is cut and continued. For series
too long for one task there are ``ewma_vol_blocked`` and ``garch_filter_blocked``: both recurrences are affine maps of the
state, maps of blocks compose, so blocks are mapped, the few maps are scanned, and blocks are replayed from their start, all
in parallel. Rows are numbered in two levels (``numbered``), so no task sorts a whole series.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import PREDICTIVE, SeriesSpec, count, lagged, numeric, reach_of, shared_dir, ship_code, with_timed
from ..functions import scalars as S
from . import kernels as K


def _check_lam(lam: float) -> float:
    if not 0 <= float(lam) < 1:
        raise ValueError(f"lam must be at least 0 and under 1: {lam!r}")
    return float(lam)


def _per_series(df: DataFrame, spec: SeriesSpec, needs: list[str], out: str, make) -> DataFrame:
    """``df`` with the column that make(dict of arrays) gives for each series in order."""
    ship_code(df.sparkSession)
    plain = [c for c in df.columns if c != out]
    df = df.select(*plain)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(o, "ascending") for o in spec.order])
        made = make({n: np.asarray(table.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for n in needs})
        return table.append_column(out, pa.array(made, pa.float64(), from_pandas=True))

    got = df.groupBy(*spec.key).applyInArrow(run, schema)
    # a forecast before each row: what is made of a column is known one period before it
    return with_timed(got, F.col(out), out, *lagged(*reach_of(df, needs[0]), 1))


def ewma_vol(df: DataFrame, r: str, spec: SeriesSpec, lam: float = 0.94, out: str = "ewma_vol") -> DataFrame:
    """Volatility forecast before each return; missing until one return was seen; missing returns leave it as it is."""
    lam = _check_lam(lam)
    numeric(df, r)
    return _per_series(df, spec, [r], out, lambda a: K.ewma(a[r], lam)[0])


def numbered(df: DataFrame, spec: SeriesSpec, out: str = "pos", parts: int | None = None) -> DataFrame:
    """Row numbers from 0 within each series, in two levels: rows are dealt out by ranges of (key, order) and written with
    their range's number; within a range they are counted by one task, and ranges are summed up.

    Rows of one series that share an order are numbered in any order.
    """
    spark = df.sparkSession
    ranges = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = f"{shared_dir(spark)}/foldcast/numbered-{uuid.uuid4().hex}"
    cut = df.repartitionByRange(ranges, *spec.key, *spec.order).withColumn("_range", F.spark_partition_id())
    cut.write.parquet(at)
    held = spark.read.schema(cut.schema).parquet(at)
    inner = F.row_number().over(Window.partitionBy(*spec.key, "_range").orderBy(*spec.order)) - 1
    sizes = held.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(spec.key)], F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(spec.key))]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(spec.key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    each = held.withColumn("_inner", inner).join(sizes, same)
    # columns are taken over with their timing classes, which files don't keep
    plain = [F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in df.schema.fields if f.name != out]
    return each.select(*plain, (F.col("_base") + F.col("_inner")).cast("long").alias(out))


def garch_filter_blocked(df: DataFrame, r: str, spec: SeriesSpec, model: dict, out: str = "garch_vol", resume: bool = False, block: int = 65_536, pos: str | None = None) -> DataFrame:
    """garch_filter with one model for very long series (equal to rounding): no task holds more than a block of a series."""
    numeric(df, r)
    o, al, be, start = (float(model.get(n, 0.0)) for n in ("omega", "alpha", "beta", "sigma2_next" if resume else "backcast"))
    _check_model(o, al, be, start, resume)
    first = start if resume else K.garch_seed(o, al, be, start)
    at = pos or "_pos"
    if pos is None:
        df = numbered(df, spec, at)
    df = df.withColumn("_block", F.floor(F.col(at) / count(block, "block", 1)))
    blocks = SeriesSpec((*spec.key, "_block"), (at,))
    # a block's map of the variance, v -> m * v + c: a row multiplies by beta (missing: by alpha + beta) and adds
    ok = S.usable(r)
    after = lambda what: (F.count_if(what).over(blocks.whole()) - F.count_if(what).over(blocks.running())).cast("double")
    seen, gaps = after(ok), after(~ok)
    rest = F.pow(F.lit(be), seen) * F.pow(F.lit(al + be), gaps)
    added = F.lit(o) + F.when(ok, F.lit(al) * F.col(r).cast("double") * F.col(r).cast("double")).otherwise(F.lit(0.0))
    terms = df.select(*spec.key, "_block", ok.alias("ok"), (added * rest).alias("c"))
    terms = terms.groupBy(*spec.key, "_block").agg(F.count_if("ok").cast("double").alias("n"), F.count_if(~F.col("ok")).cast("double").alias("g"), F.sum("c").alias("c"))
    scanned = terms.groupBy(*spec.key).agg(F.sort_array(F.collect_list(F.struct("_block", "n", "g", "c"))).alias("s"))

    def follow(state, x):
        then = F.pow(F.lit(be), x["n"]) * F.pow(F.lit(al + be), x["g"]) * state["v"] + x["c"]
        return F.struct(then.alias("v"), F.concat(state["o"], F.array(F.struct(x["_block"].alias("_block"), state["v"].alias("v")))).alias("o"))

    zero = F.struct(F.lit(first).alias("v"), F.array().cast("array<struct<_block:bigint,v:double>>").alias("o"))
    starts = scanned.select(*spec.key, F.explode(F.aggregate("s", zero, follow, lambda s: s["o"])).alias("x")).select(*spec.key, F.col("x._block").alias("_block"), F.col("x.v").alias("_v"))
    got = _per_series(df.join(starts, [*spec.key, "_block"]), blocks, [r, "_v"], out, lambda a: K.garch_filter(a[r], o, al, be, float(a["_v"][0]))[0] if len(a[r]) else a[r])
    return got.drop("_block", "_v", *([] if pos else ["_pos"]))


def ewma_vol_blocked(df: DataFrame, r: str, spec: SeriesSpec, lam: float = 0.94, out: str = "ewma_vol", block: int = 65_536, pos: str | None = None) -> DataFrame:
    """The same for very long series (equal to rounding): no task holds more than a block of one series.

    ``pos`` names a column with row numbers from 0; without it they are made by ``numbered``.
    """
    lam = _check_lam(lam)
    at = pos or "_pos"
    if pos is None:
        df = numbered(df, spec, at)
    b = F.floor(F.col(at) / count(block, "block", 1))
    sq = F.when(S.usable(r), F.col(r).cast("double") * F.col(r).cast("double"))
    df = df.withColumn("_block", b)
    blocks = SeriesSpec((*spec.key, "_block"), (at,))
    # a block's map of the state: v -> a * v + c; of a block that is the first to see a return, c is the state itself
    left = F.count(sq).over(blocks.whole()) - F.count(sq).over(blocks.running())
    terms = df.select(*spec.key, "_block", sq.alias("sq"), left.alias("left"))
    terms = terms.groupBy(*spec.key, "_block").agg(F.count("sq").alias("n"), F.sum(F.col("sq") * (1 - lam) * F.pow(F.lit(lam), F.col("left"))).alias("c"), F.max_by(F.col("sq"), F.when(F.col("sq").isNotNull(), F.col("left"))).alias("first"))
    steps = F.sort_array(F.collect_list(F.struct("_block", "n", "c", "first")))
    scanned = terms.groupBy(*spec.key).agg(steps.alias("s"))
    none = F.lit(None).cast("double")
    def follow(state, x):
        seeded = x["c"] + F.pow(F.lit(lam), x["n"].cast("double") - 1) * x["first"] * F.lit(lam)  # the first return counts whole
        after = F.when(x["n"] == 0, state["v"]).when(state["v"].isNull(), seeded).otherwise(F.pow(F.lit(lam), x["n"].cast("double")) * state["v"] + x["c"])
        return F.struct(after.alias("v"), F.concat(state["o"], F.array(F.struct(x["_block"].alias("_block"), state["v"].alias("v")))).alias("o"))
    zero = F.struct(none.alias("v"), F.array().cast("array<struct<_block:bigint,v:double>>").alias("o"))
    starts = scanned.select(*spec.key, F.explode(F.aggregate("s", zero, follow, lambda s: s["o"])).alias("x")).select(*spec.key, F.col("x._block").alias("_block"), F.col("x.v").alias("_v"))
    df = df.join(starts, [*spec.key, "_block"])
    def make(a):
        v = a["_v"][0] if len(a["_v"]) else math.nan
        return K.ewma(a[r], lam, None if math.isnan(v) else float(v))[0]
    got = _per_series(df, blocks, [r, "_v"], out, make)
    return got.drop("_block", "_v", *([] if pos else ["_pos"]))


def garch_filter(df: DataFrame, r: str, spec: SeriesSpec, model: DataFrame | dict, out: str = "garch_vol", resume: bool = False, status: bool = False) -> DataFrame:
    """Volatility forecasts of a GARCH(1,1) model before each return.

    ``model`` is one dict for all series or a model table, joined on the key columns it shares. Starting variance:
    from the model's backcast, or with ``resume`` its sigma2_next, so that a continuation has the bits of one run. A dict
    that is no model is refused. A table's row that is none, or whose variance grows over all bounds, leaves its series
    without forecasts (NULL), and with ``status`` a column ``<out>_status`` tells: 0 fine, 1 no model.
    """
    numeric(df, r)
    names = ["omega", "alpha", "beta", "sigma2_next" if resume else "backcast"]
    one = isinstance(model, dict)
    if one:
        given = [float(model.get(n, 0.0)) for n in names]
        _check_model(*given, resume)
        joined = df.select("*", *[F.lit(v).alias(f"_{n}") for n, v in zip(names, given, strict=True)])
    else:
        on = [k for k in spec.key if k in model.columns]
        joined = df.join(model.select(*on, *[F.col(n).cast("double").alias(f"_{n}") for n in names]), on)

    def make(a):
        if not len(a[r]):
            return a[r]
        o, al, be, start = (float(a[f"_{n}"][0]) for n in names)
        try:
            _check_model(o, al, be, start, resume)
            return K.garch_filter(a[r], o, al, be, start if resume else K.garch_seed(o, al, be, start))[0]
        except ValueError:
            if one:
                raise
            return np.full(len(a[r]), math.nan)

    got = _per_series(joined, spec, [r, *[f"_{n}" for n in names]], out, make)
    if status:
        ok = S.valid_garch("_omega", "_alpha", "_beta") & ((F.col("_sigma2_next") > 0) & S.is_finite("_sigma2_next") if resume else F.lit(True))
        got = got.withColumn(f"{out}_status", F.when(ok, 0).otherwise(1))
    return got.drop(*[f"_{n}" for n in names])


def _check_model(omega: float, alpha: float, beta: float, start: float, resume: bool) -> None:
    if not (0 < omega < math.inf and alpha >= 0 and beta >= 0 and alpha + beta < K.GARCH_MAX_PERSISTENCE):
        raise ValueError("the model's parameters are not those of a stationary GARCH(1,1)")
    if resume and not 0 < start < math.inf:
        raise ValueError("the model has no current variance")


def garch_forecast(models: DataFrame, horizon: int, out: str = "vol") -> DataFrame:
    """Each model with its volatility of the next periods, a row per period h from 0. Plain expressions only."""
    h = count(horizon, "horizon", 1)
    u, p = S.unconditional_variance("omega", "alpha", "beta"), S.persistence("alpha", "beta")
    ok = S.valid_garch("omega", "alpha", "beta") & S.is_finite("sigma2_next") & (F.col("sigma2_next") > 0)
    rows = models.select("*", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h"))
    s2 = F.when(ok, u + F.pow(p, F.col("h").cast("double")) * (F.col("sigma2_next") - u))
    return with_timed(rows, F.sqrt(S.normalise(s2)), out, PREDICTIVE)


def garch_derived(models: DataFrame) -> DataFrame:
    """A model table with persistence, unconditional variance and volatility, and half-life of shocks."""
    a = ("alpha", "beta")
    return models.select("*", S.persistence(*a).alias("persistence"), S.unconditional_variance("omega", *a).alias("unconditional_variance"), S.unconditional_vol("omega", *a).alias("unconditional_vol"), S.half_life(*a).alias("half_life"))

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldcast.contract import DomainError, SeriesSpec
from foldcast.operators import fits, folds, recurrences
from foldcast.operators import kernels as K
from foldcast.sources.simulate import garch_path, simulated_garch

T = SeriesSpec.of(None, "t")
KT = SeriesSpec.of("k", "t")


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "t long, r double")


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


def test_ewma_known_answer_and_gaps(spark):
    got = column(recurrences.ewma_vol(frame(spark, [0.01, -0.02, 0.015]), "r", T, 0.9, "v"), "v")
    assert got[0] is None and got[1] == 0.01
    assert math.isclose(got[2], math.sqrt(0.9e-4 + 0.1 * 4e-4), rel_tol=1e-15)
    gaps = column(recurrences.ewma_vol(frame(spark, [None, math.nan, 0.01, 1e200, math.inf, 0.02, 0.0]), "r", T, 0.0, "v"), "v")
    assert gaps == [None, None, None, 0.01, 0.01, 0.01, 0.02]
    with pytest.raises(ValueError):
        recurrences.ewma_vol(frame(spark, [0.1]), "r", T, 1.0)


def test_blocked_ewma_is_the_sequential_one(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(v) if rng.random() > 0.1 else None) for k in ("a", "b") for i, v in enumerate(rng.normal(size=500))]
    rows += [("c", i, None) for i in range(70)] + [("c", 70, 0.5), ("c", 71, 0.1)]
    df = spark.createDataFrame(rows, "k string, t long, r double")
    a = {(r.k, r.t): r.v for r in recurrences.ewma_vol(df, "r", KT, 0.94, "v").collect()}
    b = {(r.k, r.t): r.v for r in recurrences.ewma_vol_blocked(df, "r", KT, 0.94, "v", block=32).collect()}
    assert a.keys() == b.keys()
    for k, v in a.items():
        assert (v is None) == (b[k] is None), k
        assert v is None or math.isclose(v, b[k], rel_tol=1e-12)


def test_garch_filter_known_answer(spark):
    model = {"omega": 0.2, "alpha": 0.3, "beta": 0.5, "backcast": 0.0, "sigma2_next": 1.9}
    got = column(recurrences.garch_filter(frame(spark, [1.0, -2.0, 3.0]), "r", T, model, "v"), "v")
    assert np.allclose(np.square(got), [1.0, 1.0, 1.9], rtol=1e-14)
    missing = column(recurrences.garch_filter(frame(spark, [None, 1e200, 0.0]), "r", T, model, "v", resume=True), "v")
    assert np.allclose(np.square(missing), [1.9, 0.2 + 0.8 * 1.9, 0.2 + 0.8 * (0.2 + 0.8 * 1.9)], rtol=1e-14)


def test_continuation_has_the_same_bits(spark):
    for seed in range(20):
        r = garch_path(seed, 300, 2e-6, 0.1, 0.85)
        s = K.garch_seed(2e-6, 0.1, 0.85, 1e-4)
        whole, end = K.garch_filter(r, 2e-6, 0.1, 0.85, s)
        a, mid = K.garch_filter(r[:137], 2e-6, 0.1, 0.85, s)
        b, last = K.garch_filter(r[137:], 2e-6, 0.1, 0.85, mid)
        assert np.array_equal(whole, np.concatenate([a, b])) and end == last
        e, v = K.ewma(r, 0.94)
        x, y = K.ewma(r[:137], 0.94)
        z, w = K.ewma(r[137:], 0.94, y)
        assert np.array_equal(e, np.concatenate([x, z]), equal_nan=True) and v == w


def test_shock_moves_only_later_forecasts():
    r = garch_path(4, 200, 2e-6, 0.1, 0.85)
    q = r.copy()
    q[100] += 0.2
    for f in (lambda x: K.ewma(x, 0.94)[0], lambda x: K.garch_filter(x, 2e-6, 0.1, 0.85, 4e-5)[0]):
        a, b = f(r), f(q)
        assert np.array_equal(a[:101], b[:101], equal_nan=True) and b[101] > a[101]


def test_forecast(spark):
    m = spark.createDataFrame([(0.2, 0.3, 0.5, 2.5)], "omega double, alpha double, beta double, sigma2_next double")
    got = [r.vol for r in recurrences.garch_forecast(m, 60).orderBy("h").collect()]
    assert np.allclose(got[:2], [math.sqrt(2.5), math.sqrt(1 + 0.8 * 1.5)], rtol=1e-14) and abs(got[-1] - 1) < 1e-5
    assert np.allclose(got, K.garch_forecast(0.2, 0.3, 0.5, 2.5, 60), rtol=1e-13)


#: Parameters of two simulated series and of their maximum likelihood fits.
GOLDEN = [
    (12345, 2000, (2e-6, 0.10, 0.85), (1.355607201170e-06, 0.081035203406, 0.883501535165, 9259.949082)),
    (777, 1500, (5e-6, 0.05, 0.93), (5.176457051708e-06, 0.050852929935, 0.925219134086, 5606.487198)),
]


@pytest.mark.parametrize(("seed", "n", "truth", "want"), GOLDEN)
def test_garch_fit_golden(spark, seed, n, truth, want):
    r = garch_path(seed, n, *truth)
    m = fits.garch_fit_one(frame(spark, r.tolist()), "r", ["t"])
    assert abs(m["alpha"] - want[1]) < 1e-5 and abs(m["beta"] - want[2]) < 1e-5
    assert abs(m["omega"] / want[0] - 1) < 1e-4 and abs(m["loglik"] / want[3] - 1) < 1e-8
    assert m["converged"] and math.isclose(m["backcast"], float((r * r).mean()), rel_tol=1e-14)


def test_likelihood_is_that_of_the_recurrence():
    r = garch_path(9, 777, 2e-6, 0.1, 0.85)
    f = K.Likelihood(r, 3e-5)
    s2, out = K.garch_seed(1e-6, 0.07, 0.9, 3e-5), 0.0
    for x in r.tolist():
        out += 0.5 * (math.log(s2) + x * x / s2)
        s2 = 1e-6 + 0.07 * x * x + 0.9 * s2
    assert math.isclose(f(np.array([1e-6, 0.07, 0.9])), out, rel_tol=1e-12)
    assert f(np.array([1e-6, 0.2, 0.85])) == math.inf


def test_garch_fit_scale_and_refusals(spark):
    r = garch_path(3, 400, 2e-6, 0.1, 0.85)
    a, b = K.garch_fit(r), K.garch_fit(r * 1e4)
    assert abs(a["alpha"] - b["alpha"]) < 1e-6 and abs(a["beta"] - b["beta"]) < 1e-6
    for bad, kind in ((r[:99], ValueError), (np.append(r, math.nan), ValueError), (np.zeros(200), DomainError), (r * 1e-158, DomainError)):
        with pytest.raises(kind):
            K.garch_fit(bad)
    rows = [("ok", i, float(v)) for i, v in enumerate(r)] + [("short", i, 0.1) for i in range(5)] + [("flat", i, 0.0) for i in range(150)]
    got = {x.k: (x.status, x.omega is None) for x in fits.garch_fit(spark.createDataFrame(rows, "k string, t long, r double"), "r", KT).collect()}
    assert got == {"ok": (0, False), "short": (1, True), "flat": (4, True)}


def test_kelly(spark):
    rows = [("a", v) for v in (0.1, -0.05, 0.1, -0.05)] + [("one", 0.1), ("nan", 0.1), ("nan", math.nan), ("same", 0.1), ("same", 0.1), ("same", 0.1)]
    got = {x.k: x for x in fits.kelly_fraction(spark.createDataFrame(rows, "k string, r double"), "r", ["k"], 1.0).collect()}
    assert math.isclose(got["a"].kelly, 10 / 3, rel_tol=1e-12) and math.isclose(K.kelly(np.array([0.1, -0.05, 0.1, -0.05]), 0.5), 5 / 3, rel_tol=1e-12)
    assert [got[k].status for k in ("a", "one", "nan", "same")] == [0, 1, 1, 4]


def test_ridge_kernel():
    rng = np.random.default_rng(1)
    for d in (1, 3, 8):
        for ridge in (0.0, 0.5, 10.0):
            x, y = rng.normal(size=(60, d)), rng.normal(size=60)
            w, b = K.ridge_fit(x, y, ridge)
            xc, yc = x - x.mean(0), y - y.mean()
            want = np.linalg.solve(xc.T @ xc + ridge * np.eye(d), xc.T @ yc)
            assert np.allclose(w, want, atol=1e-10) and math.isclose(b, y.mean() - x.mean(0) @ want, abs_tol=1e-10)
    level = rng.normal(size=(500, 1)) + 1e12
    w, _ = K.ridge_fit(level, 2 * (level[:, 0] - 1e12))
    assert abs(w[0] - 2) < 1e-12
    w, b = K.ridge_fit(np.ones((1, 2)), np.array([3.0]), 1.0)
    assert w.tolist() == [0, 0] and b == 3
    for x, y in ((np.ones((5, 1)), np.arange(5.0)), (np.column_stack([np.arange(5.0)] * 2), np.arange(5.0)), (np.array([[1e200], [-1e200], [0]]), np.arange(3.0)), (np.ones((1, 1)), np.ones(1))):
        with pytest.raises(DomainError):
            K.ridge_fit(x, y)
    w, _ = K.ridge_fit(np.column_stack([np.arange(5.0)] * 2), np.arange(5.0), 1.0)
    assert np.allclose(w, 10 / 21)


def test_ridge_forms_agree(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2)) + [1e6, -5]
    y = x @ [0.5, -2.0] + rng.normal(size=300)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "t long, a double, b double, y double").repartition(5)
    w, b = K.ridge_fit(x, y, 1.5)
    one = fits.ridge_fit(df.selectExpr("*", "0 AS g"), ["a", "b"], "y", ["g"], ["t"], 1.5).first()
    big = fits.Ridge(1.5).fit(df, ["a", "b"], "y")
    for coef, c in ((one.coef, one.intercept), (big.coef_, big.intercept_)):
        assert np.allclose(coef, w, rtol=1e-9) and math.isclose(c, b, rel_tol=1e-9)
    p = big.predict(df).select("y", "prediction").toPandas()
    assert ((p.y - p.prediction) ** 2).mean() < 1.3
    with pytest.raises(ValueError):
        big.predict(df, ["b", "a"])
    with pytest.raises(ValueError):
        fits.Ridge().predict(df)


def plain_folds(n, train, test, step, purge, embargo, post):
    out, start = [], 0
    while start + train + test <= n:
        end = start + train + test
        after = end + embargo if post and end + embargo < n else n
        out.append((start, start + train - purge, start + train, end, after, n))
        start += step
    return out


def test_split_arguments_sweep():
    for n in (0, 1, 19, 30, 31, 60, 61):
        for train in (1, 5, 20):
            for test in (1, 10):
                for step in (1, 7, 10):
                    for purge in (0, train - 1):
                        for embargo, post in ((0, False), (5, True), (0, True)):
                            a = folds.SplitArgs.of(train, test, step, purge=purge, embargo=embargo, include_post_train=post)
                            assert [a.bounds(i, n) for i in range(a.folds(n))] == plain_folds(n, train, test, step, purge, embargo, post)
    for bad in ((0, 1), (1, 0), (5, 1, 0)):
        with pytest.raises(ValueError):
            folds.SplitArgs.of(*bad)
    with pytest.raises(ValueError, match="label_horizon"):
        folds.SplitArgs.of(5, 1, label_horizon=6)
    assert folds.SplitArgs.of(10, 5).folds(2**62) > 2**59


def test_rows_meet_their_folds(spark):
    for args in ({"train_size": 20, "test_size": 10, "step": 7, "purge": 3}, {"train_size": 9, "test_size": 4, "step": 15, "purge": 0}, {"train_size": 20, "test_size": 10, "step": 10, "purge": 3, "embargo": 5, "include_post_train": True}):
        n = 73
        a = folds.SplitArgs.of(**args)
        want = set()
        for i in range(a.folds(n)):
            t0, t1, e0, e1, again, _ = a.bounds(i, n)
            want |= {(i, p, "train") for p in range(t0, t1)} | {(i, p, "gap") for p in range(t1, e0)} | {(i, p, "test") for p in range(e0, e1)} | {(i, p, "post") for p in range(again, n)}
        got = folds.assign_folds(spark.range(n).withColumnRenamed("id", "pos"), "pos", n, **args)
        assert {tuple(r) for r in got.select("fold", "pos", "role").collect()} == want
        rel = folds.walk_forward_splits(spark, n, **args).orderBy("fold").collect()
        assert [tuple(r)[1:] for r in rel] == [a.bounds(i, n) for i in range(a.folds(n))]


def test_cross_validator(spark):
    cv = folds.PurgedWalkForward(20, 10, label_horizon=4)
    pairs = [(list(a), list(b)) for a, b in cv.split(np.zeros(50))]
    assert len(pairs) == cv.get_n_splits(np.zeros(50)) == 3
    assert all(max(a) + 4 <= min(b) for a, b in pairs)
    assert "label_horizon=4" in repr(cv)
    with pytest.raises(ValueError):
        cv.get_n_splits()
    assert cv.get_n_splits(spark.range(50)) == 3


def test_fold_job_equals_a_loop(spark):
    r = garch_path(11, 700, 2e-6, 0.1, 0.85)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "pos long, r double")
    f = fits.demeaned(folds.assign_folds(df, "pos", 700, 300, 100, purge=4), "r", ["fold"])
    spec = SeriesSpec.of("fold", "pos")
    m = fits.garch_fit(f.where("role = 'train'"), "r_d", spec)
    later = recurrences.garch_filter(f.where("role <> 'train'").select("fold", "pos", "role", "r_d"), "r_d", spec, m, "v", resume=True)
    got = {(x.fold, x.pos): x.v for x in later.where("role = 'test'").collect()}
    a = folds.SplitArgs.of(300, 100, purge=4)
    for i in range(a.folds(700)):
        t0, t1, e0, e1, *_ = a.bounds(i, 700)
        mean = r[t0:t1].mean()
        k = K.garch_fit(r[t0:t1] - mean)
        out, _ = K.garch_filter(r[t1:e1] - mean, k["omega"], k["alpha"], k["beta"], k["sigma2_next"])
        assert np.allclose([got[(i, p)] for p in range(e0, e1)], out[e0 - t1 :], rtol=1e-6)


def test_simulated_source(spark):
    df = simulated_garch(spark, [1, 2], 50)
    got = [x.r for x in df.where("key = 2").orderBy("t").collect()]
    assert got == garch_path(2, 50, 2e-6, 0.1, 0.85).tolist()


def test_read_ohlc(spark, tmp_path):
    from foldcast.sources import read_column, read_ohlc

    p = tmp_path / "x.csv"
    p.write_text("Date,Open,HIGH,Low,Close,AdjClose\n2024-01-02,1,2,0.5,1.5,1.4\n2024-01-01,1,2,0.5,,1\n")
    assert [tuple(r)[1:] for r in read_ohlc(spark, str(p)).collect()] == [(1.0, 2.0, 0.5, 1.5, 1.4)]
    assert read_ohlc(spark, str(p), complete=False).count() == 2
    assert {r[0] for r in read_column(spark, str(p), "adjclose").collect()} == {1.4, 1.0}


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from foldcast.streaming import stream_bars, stream_ewma, stream_garch

    rng = np.random.default_rng(8)
    rows = [(k, 60 * i, float(v)) for k in ("a", "b") for i, v in enumerate(rng.normal(size=90))]
    df = spark.createDataFrame(rows, "key string, s long, r double").select("key", F.timestamp_seconds("s").alias("ts"), "r")
    src = str(tmp_path / "in")
    for lo in (0, 1800, 3600):
        df.where(f"unix_timestamp(ts) >= {lo} AND unix_timestamp(ts) < {lo + 1800}").coalesce(1).write.mode("append").parquet(src)
    df.where("unix_timestamp(ts) = 60").coalesce(1).write.mode("append").parquet(src)  # late again
    model = {"omega": 0.1, "alpha": 0.1, "beta": 0.8, "sigma2_next": 1.0}
    want = {"e": {}, "g": {}}
    for k in ("a", "b"):
        x = np.array([r for kk, _, r in rows if kk == k])
        for name, v in (("e", K.ewma(x, 0.94)[0]), ("g", K.garch_filter(x, 0.1, 0.1, 0.8, 1.0)[0])):
            want[name] |= {(k, 60 * i): (None if math.isnan(z) else z) for i, z in enumerate(v.tolist())}
    for name, make in (("e", lambda s: stream_ewma(s, "key", "ts", "r")), ("g", lambda s: stream_garch(s, "key", "ts", "r", model))):
        s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
        q = make(s).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r.key, r.s): r.vol for r in spark.table(f"out_{name}").select("key", F.unix_timestamp("ts").alias("s"), "vol").collect()}
        assert got == want[name]
    s = spark.readStream.schema(df.schema).parquet(src).withColumnRenamed("r", "price")
    q = stream_bars(s, "10 minutes", "1 minute").writeStream.format("memory").queryName("out_bars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("out_bars").count() >= 2 * 8


def test_stream_keeps_rows_of_one_time(spark, tmp_path):
    from pyspark.sql import functions as F

    from foldcast.plans.queries import stream_ewma_by_type
    from foldcast.streaming import stream_ewma

    rng = np.random.default_rng(9)
    rows = [(i, 60 * (i // 5), "ab"[i % 2], float(v)) for i, v in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "event_id long, s long, event_type string, value double")
    df = df.select("event_id", F.timestamp_seconds("s").alias("ts"), "event_type", "value")
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = stream_ewma_by_type(spark, str(tmp_path)).collect()
    src = str(tmp_path / "in")
    for part in ("event_id < 61", "event_id >= 61", "event_id = 119"):  # cut between two rows of a time; the last again
        df.where(part).coalesce(1).write.mode("append").parquet(src)
    for k in "ab":
        x = np.array([v for _, _, kk, v in rows if kk == k])
        want = sorted(0.0 if math.isnan(z) else z for z in K.ewma(x, 0.94)[0].tolist())
        mine = sorted(r.vol or 0.0 for r in got if r.key == k)
        assert len(mine) == 60 and np.allclose(mine, want, atol=1e-6)
    assert all(r.late == 0 for r in got)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    q = stream_ewma(s, "event_type", "ts", "value", tie="event_id").writeStream.format("memory").queryName("out_tied").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    parts = spark.table("out_tied").collect()
    for k in "ab":
        x = np.array([v for _, _, kk, v in rows if kk == k])
        assert sorted(r.vol or 0.0 for r in parts if r.key == k) == sorted(0.0 if math.isnan(z) else z for z in K.ewma(x, 0.94)[0].tolist())


def test_model_object(spark):
    from foldcast.operators.models import GarchModel

    m = GarchModel(0.2, 0.3, 0.5)
    assert (m.persistence, m.unconditional_vol) == (0.8, math.sqrt(0.2 / (1 - 0.8))) and math.isclose(m.half_life, math.log(0.5) / math.log(0.8))
    df = frame(spark, [1.0, -2.0, 3.0])
    assert np.allclose(np.square(column(m.filter(df, "r", T, "v"), "v")), [1.0, 1.0, 1.9])
    for f in (lambda: m.filter_from(df, "r", T), lambda: m.forecast(spark, 3), lambda: GarchModel(0.0, 0.1, 0.1), lambda: GarchModel(0.1, 0.5, 0.5)):
        with pytest.raises(ValueError):
            f()
    assert column(m.filter_from(df, "r", T, 4.0, "v"), "v")[0] == 2.0
    vol = [r.vol for r in GarchModel(0.2, 0.3, 0.5, 2.5).forecast(spark, 3).orderBy("h").collect()]
    assert np.allclose(vol, K.garch_forecast(0.2, 0.3, 0.5, 2.5, 3), rtol=1e-14)
    r = garch_path(2, 300, 2e-6, 0.1, 0.85)
    fitted = GarchModel.fit(frame(spark, r.tolist()), "r", ["t"])
    assert fitted.converged and fitted.sigma2_next > 0


def test_ridge_table_is_read_by_name(spark):
    m = spark.createDataFrame([("k", [1.0, 10.0], 0.0, 0.0, ["a", "b"], 0), ("other", [1.0, 10.0], 0.0, 0.0, ["a", "z"], 0), ("less", [1.0], 0.0, 0.0, ["a"], 0)], "key string, coef array<double>, intercept double, ridge double, feature_names array<string>, status int")
    x = spark.createDataFrame([(k, 1.0, 2.0) for k in ("k", "other", "less")], "key string, a double, b double")
    got = {r.key: r.prediction for r in fits.ridge_predict(x, m, ["b", "a"], ["key"]).collect()}
    assert got == {"k": 21.0, "other": None, "less": None}
    one = m.where("key = 'k'").drop("key")
    assert {r.prediction for r in fits.ridge_predict(x, one, ["b", "a"]).collect()} == {21.0}
    for bad in (m, m.where("key = 'other'"), m.limit(0)):
        with pytest.raises(ValueError):
            fits.ridge_predict(x, bad, ["b", "a"])


def test_estimator_protocol(spark):
    from sys import modules

    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(9)], "a double, y double")
    e = fits.Ridge(0.5)
    with pytest.raises(fits.NotFittedError):
        e.predict(df)
    twin = type(e)(**e.get_params())
    assert twin is not e and twin.get_params() == e.get_params() and not hasattr(twin, "coef_")
    e.fit(df, ["a"], "y")
    before = e.coef_
    with pytest.raises(ValueError):
        e.fit(df.withColumn("a", F.lit(None).cast("double")), ["a"], "y")
    assert e.coef_ is before and "sklearn" not in modules


def test_cross_validator_chooses_a_penalty(spark):
    """A model selection loop: each penalty judged on the test rows of purged folds."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=160)
    df = spark.createDataFrame([(i, float(v), float(3 * v + rng.normal() / 10)) for i, v in enumerate(x)], "pos long, x double, y double")
    miss = {}
    for penalty in (0.0, 1e4):
        f = folds.assign_folds(df, "pos", 160, 60, 20, label_horizon=3)
        m = fits.ridge_fit(f.where("role = 'train'"), ["x"], "y", ["fold"], ["pos"], penalty)
        p = fits.ridge_predict(f.where("role = 'test'"), m, ["x"], ["fold"])
        miss[penalty] = p.agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0]
    cv = folds.PurgedWalkForward(60, 20, label_horizon=3)
    assert miss[0.0] < 0.02 < miss[1e4] and cv.get_n_splits(x) == 5


def test_one_bad_model_leaves_other_series_alone(spark):
    df = spark.createDataFrame([(k, i, 0.01 * (i % 3 - 1)) for k in ("good", "bad", "boom") for i in range(6)], "key string, t int, r double")
    m = spark.createDataFrame([("good", 1e-6, 0.1, 0.8, 0.0, 1e-4), ("bad", 1e-6, 0.5, 0.8, 0.0, 1e-4), ("boom", 1e-6, 0.1, 0.8, 0.0, float("inf"))], "key string, omega double, alpha double, beta double, backcast double, sigma2_next double")
    spec = SeriesSpec.of("key", "t")
    got = recurrences.garch_filter(df, "r", spec, m, "v", resume=True, status=True).collect()
    assert {(r.key, r.v is None, r.v_status) for r in got} == {("good", False, 0), ("bad", True, 1), ("boom", True, 1)}
    with pytest.raises(ValueError):
        recurrences.garch_filter(df, "r", spec, {"omega": 1e-6, "alpha": 0.5, "beta": 0.8})


def test_sql_forms_are_the_column_forms(spark):
    from foldcast.functions import scalars as S

    S.register_sql(spark)
    values = [None, float("nan"), float("inf"), -1.0, 0.0, 5e-324, 1e-308, 1e-10, 0.5, 1.0, 3.0, 1e300, 1e308]
    rows = [(a, b, c) for a in values for b in values for c in values]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    both = df.select(F.expr("parkinson_vol(a, b)").alias("p"), S.parkinson_vol("a", "b").alias("q"), F.expr("garman_klass_vol(c, a, b, c)").alias("g"), S.garman_klass_vol("c", "a", "b", "c").alias("h"), F.expr("vol_target_position(a, 0.1D, 1000D, b, 2D)").alias("u"), S.vol_target_position("a", 0.1, 1000.0, "b", 2.0).alias("v"))
    for r in both.collect():
        assert r.p == r.q and r.g == r.h and r.u == r.v and r.u is not None
    assert spark.sql("SELECT parkinson_vol(1e308, 1e-308), vol_target_position(1e300, 1e-10, 1, 1, 1), vol_target_position(0.1, 0, 1, 1, 1), period_vol(0.2, 0)").first() == (None, 0.0, None, None)


def test_frames_must_have_the_same_rows(spark):
    from foldcast.contract import check_same_rows

    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "t int, x double")
    check_same_rows(a, a.select("t"), ["t"])
    for other in (a.where("t = 1"), a.union(spark.createDataFrame([(3, 1.0)], "t int, x double"))):
        with pytest.raises(ValueError, match="rows"):
            check_same_rows(a, other, ["t"])
        with pytest.raises(ValueError, match="rows"):
            check_same_rows(other, a, ["t"])


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from foldcast.contract import shared_dir

    conf = SimpleNamespace(get=lambda k, d: d, set=lambda k, v: None)
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://h:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    assert shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file:/")


@pytest.mark.parametrize("beta", [0.0, 0.85])
def test_blocked_filters_equal_the_plain_ones(spark, beta):
    r = garch_path(3, 900, 2e-6, 0.1, 0.85)
    rows = [(k, i, None if (i * 7) % 11 == 0 else math.nan if i % 97 == 5 else float(v)) for k in ("a", "b", None) for i, v in enumerate(r[: 900 if k == "a" else 40])]
    df = spark.createDataFrame(rows, "k string, t long, r double").repartition(5)
    m = {"omega": 2e-6, "alpha": 0.1, "beta": beta, "backcast": 0.0, "sigma2_next": 3e-5}
    for resume in (False, True):
        want = {(x.k, x.t): x.v for x in recurrences.garch_filter(df, "r", KT, m, "v", resume).collect()}
        for block in (1, 64, 10_000):
            got = {(x.k, x.t): x.v for x in recurrences.garch_filter_blocked(df.where("k IS NOT NULL"), "r", KT, m, "v", resume, block).collect()}
            assert got.keys() == {x for x in want if x[0]} and all(math.isclose(got[x], want[x], rel_tol=1e-12) for x in got)
    pos = {(x.k, x.t): x.pos for x in recurrences.numbered(df, KT, parts=7).collect()}
    assert pos == {(k, t): t for k, t, _ in rows}

"""Kernels, covariance joins, solvers, posterior, training against dense NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from krigora.functions import kernels as K
from krigora.operators import covariance as C
from krigora.operators import linalg as L
from krigora.operators import metrics, mixture, mixture_points, samples
from krigora.operators.gp import GaussianProcess, block, gaussian_entropy, grouped_posterior, kl_divergence
from krigora.plans import training
from krigora.sources import points as P
from krigora.sources import store


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.random((40, 2))
    return x, np.sin(5 * x[:, 0]) + x[:, 1]


def _points(spark, x, y=None, noise=None):
    rows = [(i, [float(v) for v in p]) + ((float(y[i]),) if y is not None else ()) + ((noise,) if noise else ()) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "pt_id long, x array<double>" + ", y double" * (y is not None) + ", noise_var double" * bool(noise))


def test_ball_join_equals_all_pairs(spark, data):
    x, _ = data
    pts = _points(spark, x)
    got = {(r.i, r.j): r.v for r in C.ball_join(pts, [0.3, 0.2], 2, 1.5).collect()}
    d = np.sqrt((((x[:, None] - x[None]) / [0.3, 0.2]) ** 2).sum(2))
    want = {(i, j): 1.5 * K.wendland(d[i, j], K.NUMPY) for i in range(40) for j in range(i, 40) if d[i, j] < 1}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_blocks_equal_broadcast(spark, data, monkeypatch):
    pts = _points(spark, data[0])
    kernel = lambda a, b: K.default_kernel(a, b, [1.0, 0.5, 0.5])
    whole = {(r.i, r.j): r.v for r in C.half_covariance(pts, kernel, 2).collect()}
    monkeypatch.setattr(C, "BROADCAST_POINTS", 5)
    assert {(r.i, r.j): r.v for r in C.half_covariance(pts, kernel, 2, block=7).collect()} == whole
    assert len(whole) == 40 * 41 // 2


def test_solvers_agree(spark, data):
    x, y = data
    half = C.with_noise(C.ball_join(_points(spark, x), [0.6, 0.6], 2), 0.1)
    got = half.toPandas()
    a = L.Coo(got["i"].to_numpy(), got["j"].to_numpy(), got["v"].to_numpy(), 40)
    dense = np.zeros((40, 40))
    dense[a.i, a.j] = a.v
    want = np.linalg.solve(dense, y)
    low = L.cholesky(dense)
    assert np.allclose(L.solve(low, y), want)
    assert np.allclose(L.conjugate_gradient(a, y), want, atol=1e-6)
    assert np.allclose(L.conjugate_gradient(a, y, precondition=L.block_jacobi(a, 8)), want, atol=1e-6)
    assert np.allclose(L.minres(a, y), want, atol=1e-5)
    rhs = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i long, v double")
    table = {r.i: r.v for r in L.spark_conjugate_gradient(half, rhs, tol=1e-6, most=60).collect()}
    assert np.allclose([table[i] for i in range(40)], want, atol=1e-4)
    estimate, variance = L.random_logdet(a, 40, probes=200)
    assert abs(estimate - np.linalg.slogdet(dense)[1]) < 5 * np.sqrt(variance) + 0.05
    print_ = C.fingerprint(half).first()
    assert print_["n"] == 40 and np.isclose(print_["frobenius"], np.linalg.norm(dense)) and np.isclose(print_["trace"], np.trace(dense))
    with pytest.raises(L.NotPositiveDefinite):
        L.cholesky(-np.eye(3))


def test_solver_on_tables_meets_the_local_tolerance_or_raises(spark, data, monkeypatch):
    x, y = data
    pts = _points(spark, x, y)
    half = C.with_noise(C.ball_join(pts, [0.6, 0.6], 2), 0.1)
    rhs = pts.select(F.col("pt_id").alias("i"), F.col("y").alias("v"))
    got = half.toPandas()
    dense = np.zeros((40, 40))
    dense[got["i"], got["j"]] = dense[got["j"], got["i"]] = got["v"]
    blocks = C.grid_blocks(pts, [0.6, 0.6], 2, most=16)
    table = {r.i: r.v for r in L.spark_conjugate_gradient(half, rhs, blocks=blocks).collect()}
    assert np.linalg.norm(dense @ [table[i] for i in range(40)] - y) <= 1.01e-8 * np.linalg.norm(y)
    with pytest.raises(RuntimeError):
        L.spark_conjugate_gradient(half, rhs, most=1)
    with pytest.raises(RuntimeError):
        L.conjugate_gradient(dense, y, most=2)


def test_logdet_on_tables(spark, data):
    half = C.with_noise(C.ball_join(_points(spark, data[0]), [0.6, 0.6], 2), 0.1)
    got = half.toPandas()
    dense = np.zeros((40, 40))
    dense[got["i"], got["j"]] = dense[got["j"], got["i"]] = got["v"]
    estimate, variance = L.spark_random_logdet(half, spark.range(40).withColumnRenamed("id", "i"), probes=16, degree=8)
    assert abs(estimate - np.linalg.slogdet(dense)[1]) < 5 * np.sqrt(variance) + 0.1


def test_appends_extend_factor_and_inverse(data):
    x, _ = data
    k = block(x, x, [1.0, 0.5, 0.5]) + 0.1 * np.eye(40)
    assert np.allclose(L.extended(L.cholesky(k[:30, :30]), k[:30, 30:], k[30:, 30:]), np.linalg.cholesky(k))
    assert np.allclose(L.extended_inverse(np.linalg.inv(k[:30, :30]), k[:30, 30:], k[30:, 30:]), np.linalg.inv(k))


def test_posterior_likelihood_and_gradients(spark, data):
    x, y = data
    gp = GaussianProcess(_points(spark, x, y, 0.01), [1.0, 0.5, 0.7])
    q = np.array([[0.2, 0.3], [0.9, 0.1], [5.0, 5.0]])
    k = block(x, x, gp.hyper) + 0.01 * np.eye(40)
    kq = block(x, q, gp.hyper)
    mean, cov = y.mean() + kq.T @ np.linalg.solve(k, y - y.mean()), block(q, q, gp.hyper) - kq.T @ np.linalg.solve(k, kq)
    ask = _points(spark, q).withColumnRenamed("pt_id", "pred_id")
    got = gp.predict(ask).orderBy("pred_id").toPandas()
    assert np.allclose(got["m"], mean) and np.allclose(got["v"], np.diag(cov), atol=1e-9)
    assert np.allclose(gp.posterior(q)[1], cov, atol=1e-9)
    r = y - y.mean()
    assert np.isclose(gp.log_likelihood(), -0.5 * (r @ np.linalg.solve(k, r) + np.linalg.slogdet(k)[1] + 40 * np.log(2 * np.pi)))
    slope = gp.likelihood_gradient()
    for j in range(3):
        e = np.zeros(3)
        e[j] = 1e-5
        assert np.isclose(slope[j], (gp.log_likelihood(gp.hyper + e) - gp.log_likelihood(gp.hyper - e)) / 2e-5, rtol=1e-3, atol=1e-3)
    g = {(r.pred_id, r.direction): r.dm for r in gp.predict_gradient(ask).collect()}
    up, down = gp.posterior(q[:1] + [[1e-5, 0]])[0], gp.posterior(q[:1] - [[1e-5, 0]])[0]
    assert np.isclose(g[0, 0], (up - down)[0] / 2e-5, rtol=1e-3)
    full = GaussianProcess(_points(spark, x, y, 0.01), [1.0, 0.5, 0.7])
    part = GaussianProcess(_points(spark, x[:30], y[:30], 0.01), [1.0, 0.5, 0.7])
    part.append(x[30:], y[30:], np.full(10, 0.01))
    assert np.allclose(part.alpha, full.alpha)
    h = gp.likelihood_hessian()
    assert np.allclose(h, h.T)


def test_information(spark, data):
    x, y = data
    gp = GaussianProcess(_points(spark, x, y, 0.01), [1.0, 0.5, 0.7])
    q = np.array([[0.2, 0.3], [0.9, 0.1]])
    assert gp.mutual_information(q) > 0 and gp.total_correlation(q) > 0 and gp.relative_information_entropy(q) > 0
    m, s = gp.posterior(q)
    assert gp.divergence_from(q, m, s + 1e-9 * np.eye(2)) < 1e-8
    mean, cov, density = gp.posterior_probability(q, m, s)
    assert np.allclose(mean, m) and np.allclose(cov, s / 2, atol=1e-6) and density > 0
    assert np.isclose(gaussian_entropy(np.eye(2)), 1 + np.log(2 * np.pi)) and kl_divergence(np.zeros(2), np.ones(2), np.eye(2), np.eye(2)) == pytest.approx(1.0)


def test_slopes_of_joint_quantities(spark, data):
    """Of joint prior, entropy and posterior covariance as the queries move together, against differences; and of each row by itself."""
    x, y = data
    gp = GaussianProcess(_points(spark, x, y, 0.01), [1.0, 0.5, 0.7])
    q, e = np.array([[0.2, 0.3], [0.9, 0.1], [0.55, 0.62]]), 1e-5
    for k in range(2):
        step = e * np.eye(2)[k]
        along = lambda f: (f(q + step) - f(q - step)) / (2 * e)  # noqa: B023, E731
        mean, s = gp.joint_prior_slopes(q, k)
        assert not mean.any() and not s[: len(x), : len(x)].any() and np.allclose(s, along(lambda z: gp.joint_prior(z)[1]), atol=1e-6)
        assert gp.entropy_slopes(q)[k] == pytest.approx(along(gp.entropy), rel=1e-3)
        assert np.allclose(gp.posterior_covariance_slopes(q, k), along(lambda z: gp.posterior(z)[1]), atol=1e-6)
    trend = GaussianProcess(_points(spark, x, y, 0.01), [1.0, 0.5, 0.7], mean=lambda z: 3 * z[:, 0])
    assert np.allclose(trend.joint_prior_slopes(q, 0)[0], np.r_[np.zeros(len(x)), np.full(3, 3.0)])
    ask = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "pred_id long, x array<double>")
    got = {(r.pred_id, r.direction): r.slope for r in gp.predict_entropy_slopes(ask).collect()}
    for j in range(3):
        for k in range(2):
            step = e * np.eye(2)[k]
            log = lambda z: 0.5 * np.log(gp.posterior(z)[1][0, 0])
            assert got[j, k] == pytest.approx((log(q[j : j + 1] + step) - log(q[j : j + 1] - step)) / (2 * e), rel=1e-3)


def test_groups_equal_single_models(spark, data):
    x, y = data
    pts = _points(spark, x, y).withColumn("g", F.col("pt_id") % 2)
    ask = spark.createDataFrame([(g, 0, [0.5, 0.5]) for g in (0, 1, 2)], "g long, pred_id long, x array<double>")
    got = {r.g: (r.m, r.v) for r in grouped_posterior(pts, "g", ask, [1.0, 0.5, 0.7]).collect()}
    one = GaussianProcess(_points(spark, x[::2], y[::2]), [1.0, 0.5, 0.7])
    m, s = one.posterior(np.array([[0.5, 0.5]]))
    assert got[0] == pytest.approx((m[0], s[0, 0]), abs=1e-8) and got[2] == (0.0, 1.0)


def test_points_checks_and_appends(spark, tmp_path):
    pts = _points(spark, np.ones((3, 2)), np.ones(3))
    assert P.check(pts) == {"rows": 3, "dims": 2, "bad": 0}
    for bad in ([1.0, float("nan")], [1.0]):
        with pytest.raises(ValueError):
            P.check(pts.unionByName(spark.createDataFrame([(9, bad, 1.0)], pts.schema)))
    twice = P.append(P.append(pts, pts), pts)
    assert sorted(r.batch_id for r in twice.collect()) == [0] * 3 + [1] * 3 + [2] * 3
    with pytest.raises(ValueError):
        P.append(pts, pts.withColumn("noise_var", F.lit(1.0)))
    assert P.check(pts.limit(0))["rows"] == 0
    store.save_model(spark, str(tmp_path / "m"), pts, {"hyper": [1.0, 2.0]})
    back, state = store.load_model(spark, str(tmp_path / "m"))
    assert back.count() == 3 and state == {"hyper": [1.0, 2.0]}


def test_tasks(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 4.0)], "k long, a double, b double")
    got = sorted((r.pt_id, r.task, r.y, tuple(r.x)) for r in P.unpivot_tasks(df, "k", [F.lit(0.5)], [F.col("a"), F.col("b")]).collect())
    assert got == [(1, 0, 1.0, (0.5, 0.0)), (2, 1, 4.0, (0.5, 1.0))]


def test_metrics(spark):
    rng = np.random.default_rng(3)
    m, v = rng.normal(size=500), rng.uniform(0.5, 2, 500)
    y = m + np.sqrt(v) * rng.normal(size=500)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, m, v, strict=True)], "y double, m double, v double")
    got = metrics.scores(rows, train=(0.0, 1.0)).first()
    assert np.isclose(got["rmse"], np.sqrt(((y - m) ** 2).mean())) and np.isclose(got["mae"], np.abs(y - m).mean())
    assert abs(got["picp"] - 0.95) < 0.04 and np.isclose(got["nlpd"], (0.5 * np.log(2 * np.pi * v) + 0.5 * (y - m) ** 2 / v).mean())
    grid = np.linspace(-12, 12, 24_001)
    from statistics import NormalDist

    cdf = np.array([NormalDist(m[0], v[0] ** 0.5).cdf(t) for t in grid])
    one = rows.limit(1).select(metrics.crps(F.col("y"), F.col("m"), F.col("v"))).first()[0]
    assert np.isclose(one, np.trapezoid((cdf - (grid >= y[0])) ** 2, grid), atol=1e-3)
    curve = metrics.coverage_curve(rows).orderBy("level").toPandas()
    assert len(curve) == 19 and (curve["coverage"].diff().dropna() >= 0).all()


def test_mixtures(spark):
    rng = np.random.default_rng(4)
    rows = [(s, float(v)) for s in (1, 2) for v in np.concatenate([rng.normal(-3, 0.5, 300), rng.normal(3, 0.5, 700)])]
    df = spark.createDataFrame(rows, "station int, value double")
    fit = mixture.station_mixtures(df, "station", "value", [0.3, 0.7]).where("station = 1").orderBy("k").collect()
    assert [round(r.mean) for r in fit] == [-3, 3]
    w = mixture.fit_weights(df, mixture.station_mixtures(df, "station", "value", [0.5, 0.5]), 2)
    assert abs(w[0] - 0.3) < 0.05
    a, b = df.where("station = 1"), df.where("station = 2").withColumn("value", F.col("value") + 1)
    p, q = (np.array([r.value for r in d.collect()]) for d in (a, b))
    pairs = lambda u, v: np.abs(u[:, None] - v[None]).mean()
    assert np.isclose(samples.energy_distance(a, b, "value").first()[0], 2 * pairs(p, q) - pairs(p, p) - pairs(q, q), atol=1e-9)


def test_two_samples(spark):
    rng = np.random.default_rng(4)
    p, q = rng.normal(size=(60, 3)).round(1), rng.normal(0.5, 2, size=(45, 3)).round(1)
    a, b = _points(spark, p), _points(spark, q)
    d = lambda x, y: np.linalg.norm(x[:, None] - y[None], axis=2)
    assert np.isclose(samples.energy_distance_points(a, b, 3), 2 * d(p, q).mean() - d(p, p).mean() - d(q, q).mean())
    k = lambda x, y: np.exp(-0.3 * d(x, y) ** 2)
    want = (k(p, p).sum() - 60) / (60 * 59) + (k(q, q).sum() - 45) / (45 * 44) - 2 * k(p, q).mean()
    assert np.isclose(samples.mmd_rbf(a, b, 3, 0.3), want)
    both = np.concatenate([p, q])
    assert np.isclose(samples.median_gamma(a, b, 3), 1 / (2 * np.median(d(both, both)[np.triu_indices(105, 1)] ** 2)), rtol=0.05)
    u = samples.directions(5, 3)
    w1 = []
    for x in u:
        s, t = np.sort(p @ x), np.sort(q @ x)
        at = np.sort(np.concatenate([s, t]))
        gap = np.searchsorted(s, at[:-1], "right") / 60 - np.searchsorted(t, at[:-1], "right") / 45
        w1.append((np.abs(gap) * np.diff(at)).sum())
    assert np.isclose(samples.sliced_wasserstein(a, b, u.tolist()).first()[0], np.mean(w1))
    assert samples.sliced_wasserstein(a.limit(0), b.limit(0), u.tolist()).first()[0] is None
    with pytest.raises(ValueError):
        samples.mmd_rbf(a.limit(1), b, 3, 0.3)


def test_mixtures_of_points(spark):
    rng = np.random.default_rng(6)
    at = np.array([[-3.0, 1.0], [4.0, -2.0]])
    rows = [(s, [float(v) for v in at[k] + s + rng.normal(0, 0.5, 2)]) for s in range(3) for k in (0, 1) for _ in range(200 + 200 * k)]
    df = spark.createDataFrame([*rows, (1, None), (1, [float("nan"), 1.0])], "station int, x array<double>")
    comp = mixture_points.station_mixtures(df, 2)
    got = comp.orderBy("station", "k").toPandas()
    for s in range(3):
        assert np.allclose(np.stack(got[got.station == s]["mean"]), at + s, atol=0.15) and np.allclose(got[got.station == s]["weight"], [1 / 3, 2 / 3], atol=0.01)
    w = mixture_points.em_weights(df.where("x IS NOT NULL AND NOT isnan(x[0])"), comp, [0.5, 0.5], 2)
    assert np.allclose(w, [1 / 3, 2 / 3], atol=0.01)
    turned = comp.withColumn("k", F.when(F.col("station") == 2, 1 - F.col("k")).otherwise(F.col("k")).cast("int"))
    places = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.5])], "station int, x array<double>")
    tree = mixture_points.station_tree(places)
    assert tree == [(1, 0), (1, 2)]
    for fixed in (mixture_points.aligned_along(turned, tree), mixture_points.aligned_to(turned, 0)):
        assert fixed.orderBy("station", "k").toPandas()["weight"].round(6).tolist() == got["weight"].round(6).tolist()
    assert mixture_points.best_order(np.array([[5.0, 1.0, 9.0], [1.0, 5.0, 9.0], [9.0, 9.0, 0.0]])) == [1, 0, 2]


def test_training_finds_the_optimum(spark):
    bounds = np.array([[0.01, 10.0], [0.1, 100.0]])
    f = lambda h: float(((np.log(h) - [0.0, np.log(10.0)]) ** 2).sum())
    g = lambda h: 2 * (np.log(h) - [0.0, np.log(10.0)]) / h
    assert np.allclose(training.quasi_newton(f, g, [3.0, 30.0], bounds), [1, 10], atol=1e-2)
    assert f(training.adam(g, [3.0, 12.0], bounds, 0.05, 2000)) < 1e-2
    assert f(training.evolution(spark, f, bounds, 20, 12)) < 0.3
    assert f(training.bayesian(f, bounds, 30)[0]) < 0.1
    trace = training.chains(spark, lambda h: -0.5 * float((h**2).sum()), [0.1, 0.1], np.array([[-5.0, 5.0]] * 2), 4, 800)
    got = training.trace_summary(trace, 2).orderBy("parameter").toPandas()
    assert np.abs(got["mean"]).max() < 0.5 and np.abs(got["sd"] - 1).max() < 0.4
    assert training.keep_if_better(f, np.array([1.0, 10.0]), np.array([2.0, 10.0])).tolist() == [1.0, 10.0]


def test_stream_scores_and_windows(spark, tmp_path, data):
    from krigora.streaming import appends

    x, y = data
    gp = GaussianProcess(_points(spark, x, y, 0.01), [1.0, 0.5, 0.7])
    ask = _points(spark, x[:5]).withColumnRenamed("pt_id", "pred_id")
    ask.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ask.schema).parquet(str(tmp_path / "in"))
    q = appends.scored(stream, gp).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("scored").orderBy("pred_id").toPandas()
    assert np.allclose(got["m"], gp.predict(ask).orderBy("pred_id").toPandas()["m"])

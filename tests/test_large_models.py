"""Strips, tiles, distributional models, callables and training pieces against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from krigora.functions import kernels as K
from krigora.operators import distributional, mixture_points
from krigora.operators import linalg as L
from krigora.operators.gp import GaussianProcess, block, exact_model
from krigora.operators.strips import StripGaussianProcess, wendland_block
from krigora.operators.tiles import TiledGaussianProcess
from krigora.plans import training


def _points(spark, x, y, name="pt_id"):
    return spark.createDataFrame([(i, [float(c) for c in p], float(v)) for i, (p, v) in enumerate(zip(x, y, strict=True))], f"{name} long, x array<double>, y double")


@pytest.fixture(scope="module")
def plane():
    rng = np.random.default_rng(0)
    x = np.c_[rng.uniform(0, 10, 150), rng.uniform(0, 1, 150)]
    x[x[:, 0] > 6, 0] += 4  # strips without points
    return x, np.sin(x[:, 0]) + x[:, 1], np.c_[rng.uniform(-1, 15, 40), rng.uniform(-0.2, 1.2, 40)]


def _dense(x, y, h, noise):
    low = L.cholesky(wendland_block(x, x, h) + noise * np.eye(len(y)))
    alpha = L.solve(low, y - y.mean())
    return -0.5 * ((y - y.mean()) @ alpha + L.logdet(low) + len(y) * np.log(2 * np.pi)), alpha, low


def test_strips(spark, plane):
    x, y, q = plane
    h = [1.5, 0.4, 0.5]
    want, alpha, low = _dense(x, y, h, 0.05)
    gp = StripGaussianProcess(_points(spark, x, y), h, 0.05, aim=10)
    assert gp.strips > 8 and np.isclose(gp.log_likelihood(), want)
    assert np.allclose(gp.weights().orderBy("i").toPandas()["alpha"], alpha)
    got = gp.predict(_points(spark, q, q[:, 0], "pred_id")).orderBy("pred_id").toPandas()
    k = wendland_block(q, x, h)
    assert np.allclose(got["m"], y.mean() + k @ alpha) and np.allclose(got["v"], np.maximum(0, h[0] - (L.forward(low, k.T) ** 2).sum(0)))
    slopes = [(_dense(x, y, np.array(h) + e, 0.05)[0] - _dense(x, y, np.array(h) - e, 0.05)[0]) / 2e-5 for e in 1e-5 * np.eye(3)]
    assert np.allclose(gp.likelihood_gradient(), slopes, rtol=1e-4)
    narrow = StripGaussianProcess(_points(spark, x, y), h, 0.05, aim=2, predicts=False)
    assert narrow.strips > gp.strips and np.isclose(narrow.log_likelihood(), want)
    with pytest.raises(ValueError):
        narrow.predict(_points(spark, q, q[:, 0], "pred_id"))
    with pytest.raises(ValueError):
        StripGaussianProcess(_points(spark, x, y), h, 0.05, most=5)


def test_one_strip(spark):
    x, y = np.array([[0.0], [0.1]]), np.array([1.0, 2.0])
    gp = StripGaussianProcess(_points(spark, x, y), [1.0, 5.0], 0.1)
    assert gp.strips == 1 and np.isclose(gp.log_likelihood(), _dense(x, y, [1.0, 5.0], 0.1)[0])


def test_tiles(spark, plane):
    x, y, q = plane
    h = [1.5, 0.8, 0.7]
    pts, ask = _points(spark, x, y), _points(spark, q, q[:, 0], "pred_id")
    one, many = GaussianProcess(pts, h), TiledGaussianProcess(pts, h, size=32)
    assert many.blocks == 5 and np.isclose(one.log_likelihood(), many.log_likelihood())
    assert np.isclose(one.logdet, many.logdet) and np.isclose(one.quadratic, many.quadratic)
    got, want = (m.predict(ask).orderBy("pred_id").toPandas() for m in (many, one))
    assert np.allclose(got["m"], want["m"]) and np.allclose(got["v"], want["v"], atol=1e-9)
    assert isinstance(exact_model(pts, h, most_dense=100), TiledGaussianProcess)


def test_slopes_and_callables(spark, plane):
    x, y, q = plane
    h = np.array([1.5, 0.8, 0.7])
    for slopes, f in ((K.default_kernel_slopes, K.default_kernel),):
        for d, e in zip(slopes(x[:9], x[5:15], h), 1e-6 * np.eye(3), strict=True):
            assert np.allclose(d, (block(x[:9], x[5:15], h + e, f) - block(x[:9], x[5:15], h - e, f)) / 2e-6, atol=1e-6)
    pts = _points(spark, x, y)
    gp = GaussianProcess(pts, h, mean=lambda p: 1 + p[:, 0], noise=lambda p: 0.1 + 0.01 * p[:, 0])
    k = block(x, x, h) + np.diag(0.1 + 0.01 * x[:, 0])
    want = 1 + q[:, 0] + block(q, x, h) @ np.linalg.solve(k, y - 1 - x[:, 0])
    assert np.allclose(gp.predict(_points(spark, q, q[:, 0], "pred_id")).orderBy("pred_id").toPandas()["m"], want)
    own = GaussianProcess(pts, h, kernel_slopes=K.default_kernel_slopes)
    step = [(own.log_likelihood(h + e) - own.log_likelihood(h - e)) / 2e-5 for e in 1e-5 * np.eye(3)]
    assert np.allclose(own.likelihood_gradient(), step, rtol=1e-4) and np.allclose(own.likelihood_gradient(), GaussianProcess(pts, h).likelihood_gradient())
    ask = _points(spark, q, q[:, 0], "pred_id")
    by = [gp_.orderBy("pred_id", "direction").toPandas()[["dm", "dv"]].to_numpy() for gp_ in (own.predict_slopes(ask), own.predict_gradient(ask))]
    assert np.allclose(*by, atol=1e-3)
    assert np.allclose(L.lower_inverse(own.factor, 16) @ own.factor, np.eye(150), atol=1e-8)


def test_distributional(spark):
    rng = np.random.default_rng(5)
    comp = spark.createDataFrame([(s, k, float(k * 4 + s / 3), 0.04) for s in range(6) for k in range(2)], "station int, k int, mean double, variance double")
    places = spark.createDataFrame([(s, [s / 3.0]) for s in range(6)], "station int, x array<double>")
    dgp = distributional.DistributionalProcess(comp, places, [[4.0, 1.5]] * 2)
    at = np.arange(-1, 8, 0.05)
    dens = [(s, float(t), float(0.3 * np.exp(-0.5 * (t - s / 3) ** 2 / 0.04) / np.sqrt(0.08 * np.pi) + 0.7 * np.exp(-0.5 * (t - 4 - s / 3) ** 2 / 0.04) / np.sqrt(0.08 * np.pi))) for s in range(6) for t in at]
    w = dgp.train_weights(spark.createDataFrame(dens, "station int, at double, density double"), 0.05, rounds=20)
    assert np.allclose(w, [0.3, 0.7], atol=0.01)
    got = dgp.predict(spark.createDataFrame([(0, [0.5])], "pred_id long, x array<double>")).first()
    assert abs(got["mean"] - (0.5 + 0.7 * 4)) < 0.3 and got["variance"] > 2
    assert len(dgp.log_likelihoods()) == 2 and rng is not None


def test_drawn_points(spark):
    comp = spark.createDataFrame([(1, 0, 0.25, [-3.0, 0.0], [0.25, 1.0]), (1, 1, 0.75, [3.0, 1.0], [0.25, 4.0])], "station int, k int, weight double, mean array<double>, variance array<double>")
    got = mixture_points.sampled(comp, 4000, 2)
    x = np.array([r.x for r in got.collect()])
    low = x[:, 0] < 0
    assert abs(low.mean() - 0.25) < 0.03 and abs(x[low, 0].std() - 0.5) < 0.05 and abs(x[~low, 1].std() - 2) < 0.1
    like = mixture_points.log_likelihood(got, comp, 2).first()
    dens = sum(w * np.exp(-0.5 * ((x - m) ** 2 / v).sum(1)) / (2 * np.pi * np.sqrt(v[0] * v[1])) for w, m, v in ((0.25, np.array([-3, 0]), np.array([0.25, 1])), (0.75, np.array([3, 1]), np.array([0.25, 4]))))
    assert like["n"] == 4000 and np.isclose(like["log_likelihood"], np.log(dens).sum())


def test_chains_until_settled(spark):
    f = lambda h: -0.5 * float((h**2).sum())
    trace = training.chains_until_settled(spark, f, [4.0, 4.0], np.array([[-5.0, 5.0]] * 2), 2, 400, most=3)
    assert trace.agg(F.max("iter")).first()[0] >= 399
    assert np.abs(training.trace_median(trace, 0.5).toPandas()["median"]).max() < 0.7


def test_assignments():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        for _ in range(20):
            cost = rng.integers(0, 9, (n, n)).astype(float) if n < 5 else rng.random((n, n))
            order = mixture_points.best_order(cost)
            assert sorted(order) == list(range(n))
            assert np.isclose(cost[range(n), order].sum(), min(cost[range(n), list(p)].sum() for p in permutations(range(n))))
    turned = rng.permutation(40)
    far = 10 * np.ones((40, 40))
    far[np.arange(40), turned] = 0
    assert mixture_points.best_order(far) == turned.tolist()


def test_searches_and_replaced_points(spark, plane):
    x, y, _ = plane
    f = lambda h: float(((np.log(h) - [0.0, 1.0]) ** 2).sum() + 0.3 * np.sin(3 * np.log(h[0])) ** 2)
    got = training.multi_start(spark, f, np.array([[0.05, 20.0], [0.05, 20.0]]), 8).first()
    assert got["f"] < 1e-3 and np.allclose(got["h"], [1, np.e], atol=0.05)
    gp = GaussianProcess(_points(spark, x[:60], y[:60]), [1.0, 0.5, 0.7])
    assert gp.gradient_gap() < 1e-5
    other = GaussianProcess(_points(spark, x[60:], y[60:]), [1.0, 0.5, 0.7])
    gp.replace(x[60:], y[60:], other.noise)
    assert np.isclose(gp.log_likelihood(), other.log_likelihood())


def test_cached_table(spark, tmp_path):
    from krigora.sources.store import cached

    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for key in ("a", "a", "b"):
        assert cached(spark, str(tmp_path), key, build).count() == 3
    assert len(calls) == 2


def test_objects_that_are_not_coordinates(spark):
    from krigora.operators.gp import object_posterior

    objs, y = [["a", "b"], ["b"], ["c", "d", "a"]], [1.0, 2.0, 4.0]
    pts = spark.createDataFrame([(i, o, v, 0.1) for i, (o, v) in enumerate(zip(objs, y, strict=True))], "pt_id long, obj array<string>, y double, noise_var double")
    ask = spark.createDataFrame([(7, ["a"])], "pred_id long, obj array<string>")
    shared = lambda a, b: F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b))
    k = np.array([[len(set(a) & set(b)) / np.sqrt(len(a) * len(b)) for b in objs] for a in objs]) + 0.1 * np.eye(3)
    c = np.array([1 / np.sqrt(2), 0, 1 / np.sqrt(3)])
    got = object_posterior(pts, ask, shared).first()
    assert np.isclose(got["m"], np.mean(y) + c @ np.linalg.solve(k, np.array(y) - np.mean(y))) and np.isclose(got["v"], 1 - c @ np.linalg.solve(k, c))

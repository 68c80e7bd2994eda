"""Networks that move coordinates, and the models over what they give, against NumPy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from krigora import registry
from krigora.functions.networks import Network
from krigora.operators.strips import StripGaussianProcess, wendland_block
from krigora.operators.warped import LocalWarpedProcess, WarpedProcess
from krigora.plans import training
from krigora.sources.places import Places

SF = "/root/testdata/sf0.001"

HYPER = [1.5, 0.6, 0.8]


def _points(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 2)) * 3
    y = np.sin(2 * x[:, 0]) + 0.3 * x[:, 1]
    rows = [(k, v.tolist(), float(t), 0.1 + 0.01 * (k % 4)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "pt_id long, x array<double>, y double, noise_var double").repartition(3), x, y, 0.1 + 0.01 * (np.arange(n) % 4)


def _likelihood(x, y, noise, hyper):
    k, r = wendland_block(x, x, hyper) + np.diag(noise), y - y.mean()
    return -0.5 * (r @ np.linalg.solve(k, r) + np.linalg.slogdet(k)[1] + len(y) * np.log(2 * np.pi))


@pytest.mark.parametrize(("dims", "width", "out", "rectify_last"), [(2, 4, None, False), (3, 16, 1, True), (1, 1, 3, False)])
def test_columns_give_what_arrays_give(spark, dims, width, out, rectify_last):
    net = Network(dims, width, out, rectify_last)
    p = net.start(1) + 0.1 * np.random.default_rng(2).normal(size=net.size)
    x = np.random.default_rng(3).normal(size=(20, dims))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, x array<double>")
    got = np.array([r.v for r in df.select("k", net.column(F.col("x"), p).alias("v")).orderBy("k").collect()])
    assert got.shape == (20, out or dims) and np.allclose(got, net(x, p))
    assert net.size == dims * width + width * width + width * (out or dims) + 2 * width + (out or dims)
    assert not rectify_last or (got >= 0).all()


def test_wide_network_and_odd_rows(spark):
    """64 units read one bound layer each; a null point, and one with too few coordinates, come out as nulls, never as numbers."""
    net = Network(3, 64)
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, None), (2, [1.0])], "k int, x array<double>")
    got = {r.k: r.v for r in df.select("k", net.column(F.col("x"), net.start()).alias("v")).collect()}
    assert np.allclose(got[0], net(np.array([[1.0, 2.0, 3.0]]), net.start())[0]) and got[1] == [None] * 3 and got[2] == [None] * 3
    with pytest.raises(ValueError, match="parameters"):
        net.column(F.col("x"), [1.0])


def test_slopes_of_a_network():
    net, rng = Network(2, 5, 3, True), np.random.default_rng(4)
    p, x, outer = net.start(2) + 0.05, rng.normal(size=(9, 2)), rng.normal(size=(9, 3))
    f = lambda q: (net(x, q) * outer).sum()
    want = [(f(p + e) - f(p - e)) / 2e-6 for e in 1e-6 * np.eye(net.size)]
    assert np.allclose(net.slopes(x, outer, p), want, atol=1e-6)


def test_point_slopes(spark):
    """Of the likelihood along every coordinate of every point, over several strips, against differences."""
    pts, x, y, noise = _points(spark)
    gp = StripGaussianProcess(pts, HYPER, aim=4, predicts=False)
    assert gp.strips > 3
    got = {r.i: r.slope for r in gp.point_slopes().collect()}
    assert sorted(got) == list(range(len(x)))
    for i in range(0, len(x), 7):
        for t in range(2):
            up, down = x.copy(), x.copy()
            up[i, t] += 1e-6
            down[i, t] -= 1e-6
            assert got[i][t] == pytest.approx((_likelihood(up, y, noise, HYPER) - _likelihood(down, y, noise, HYPER)) / 2e-6, abs=1e-5)


def test_warped_model(spark):
    pts, x, y, noise = _points(spark)
    net = Network(2, 3)
    p = np.round(np.cos(1.7 * np.arange(net.size)), 3)
    gp = WarpedProcess(pts, net, p, HYPER, aim=6)
    assert gp.log_likelihood() == pytest.approx(_likelihood(net(x, p), y, noise, HYPER))
    both = np.array([*HYPER, *p])
    f = lambda h: _likelihood(net(x, h[3:]), y, noise, h[:3])
    want = np.array([(f(both + e) - f(both - e)) / 2e-6 for e in 1e-6 * np.eye(len(both))])
    assert np.allclose(gp.likelihood_gradient(), want, atol=1e-4 * np.abs(want).max())
    q = np.array([[0.5, 0.5], [2.0, 1.0], [50.0, -50.0]])
    ask = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "pred_id long, x array<double>")
    rows = {r.pred_id: (r.m, r.v) for r in gp.predict(ask).collect()}
    k, c = wendland_block(net(x, p), net(x, p), HYPER) + np.diag(noise), wendland_block(net(x, p), net(q, p), HYPER)
    assert np.allclose([rows[i][0] for i in range(3)], y.mean() + c.T @ np.linalg.solve(k, y - y.mean()))
    assert np.allclose([rows[i][1] for i in range(3)], HYPER[0] - (c * np.linalg.solve(k, c)).sum(0))
    with pytest.raises(ValueError, match="coordinates"):
        WarpedProcess(pts, Network(3, 2), np.zeros(Network(3, 2).size), HYPER)


def test_training_a_network(spark):
    """A few steps over tables raise the likelihood."""
    pts, x, y, noise = _points(spark, 40)
    net = Network(2, 2)
    start = np.array([*HYPER, *np.round(np.cos(1.7 * np.arange(net.size)), 3)])
    loss = training.TableObjective(lambda h: WarpedProcess(pts, net, h[3:], h[:3], predicts=False))
    best = training.train(loss, start, np.stack([np.r_[0.1, 0.1, 0.1, start[3:] - 1], np.r_[5.0, 5.0, 5.0, start[3:] + 1]], 1), steps=3)
    assert _likelihood(net(x, best[3:]), y, noise, best[:3]) > _likelihood(net(x, start[3:]), y, noise, start[:3]) + 0.5


def test_one_matrix_gives_likelihood_and_slopes_of_the_strips(spark):
    pts, x, _, _ = _points(spark)
    both = spark.createDataFrame(pts.unionByName(pts.withColumn("pt_id", F.col("pt_id") + 1000).withColumn("y", F.col("y") + 0.1)).collect(), pts.schema)
    net, places = Network(2, 3), Places(both)
    p = np.round(np.cos(1.7 * np.arange(net.size)), 3)
    local, tables = LocalWarpedProcess(places, net, p, HYPER), WarpedProcess(places, net, p, HYPER, aim=6)
    assert places.count == len(x) and local.log_likelihood() == pytest.approx(tables.log_likelihood())
    assert np.allclose(local.likelihood_gradient(), tables.likelihood_gradient(), rtol=1e-6, atol=1e-8)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_the_query_trains_until_nothing_is_gained(spark):
    """no step along the slopes, inside the bounds, lowers the loss by more than a trifle; three steps left much to gain."""
    got = registry.QUERIES["train_warped"](spark, SF).orderBy("parameter").toPandas()
    pts, h, net = registry._suppliers(spark, SF), got["value"].to_numpy(), registry._NET
    places, start = Places(pts), np.array([*registry.SPARSE_HYPER, *registry._NET_PARAMETERS])
    bounds = np.array([*training.default_bounds(pts, net.out), *[(p - 0.5, p + 0.5) for p in registry._NET_PARAMETERS]])
    loss = training.TableObjective(lambda v: LocalWarpedProcess(places, net, v[3:], v[:3]))
    assert (h >= bounds[:, 0]).all() and (h <= bounds[:, 1]).all() and loss(h) == pytest.approx(got["loss"].iloc[0])
    slopes = loss.slopes(h)
    assert min(loss(np.clip(h - t * slopes, *bounds.T)) for t in 10.0 ** -np.arange(8)) > loss(h) - 1e-5
    assert loss(h) < loss(training.quasi_newton(loss, loss.slopes, start, bounds, 3)) - 1e-3

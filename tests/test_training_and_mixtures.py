"""Training over tables, chains that learn their jumps, models with forms of mean and noise, mixtures with full covariances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from krigora.operators import linalg as L
from krigora.operators import mixture_full as M
from krigora.operators.parametric import ParametricProcess, difference_slopes
from krigora.operators.strips import StripGaussianProcess, wendland_block, wendland_slopes
from krigora.plans import training

HYPER = [1.5, 0.6, 0.8]


def _points(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 2)) * 2
    y = np.sin(3 * x[:, 0]) + x[:, 1] + 0.3 * rng.normal(size=n)
    return spark.createDataFrame([(k, v.tolist(), float(t), 0.1) for k, (v, t) in enumerate(zip(x, y, strict=True))], "pt_id long, x array<double>, y double, noise_var double"), x, y


def _loss(x, y, noise, h, mean):
    low = L.cholesky(wendland_block(x, x, h) + np.diag(noise))
    r = y - mean
    return 0.5 * (r @ L.solve(low, r) + L.logdet(low) + len(y) * np.log(2 * np.pi))


def _slopes(x, y, noise, h, mean):
    inverse = np.linalg.inv(wendland_block(x, x, h) + np.diag(noise))
    a = inverse @ (y - mean)
    return np.array([-0.5 * (a @ d @ a - (inverse * d).sum()) for d in wendland_slopes(x, x, h)])


def test_training_on_strips_finds_the_dense_optimum(spark):
    """The same steps over tables and in NumPy end in the same place; one factor serves a value and its slopes."""
    pts, x, y = _points(spark)
    b = np.array([[0.1, 10.0], [0.2, 3.0], [0.2, 3.0]])
    f = training.TableObjective(lambda h: StripGaussianProcess(pts, h, predicts=False))
    got = training.train(f, HYPER, b, steps=5)
    noise = np.full(len(y), 0.1)
    want = training.quasi_newton(lambda h: _loss(x, y, noise, h, y.mean()), lambda h: _slopes(x, y, noise, h, y.mean()), np.array(HYPER), b, 5)
    assert np.allclose(got, want, rtol=1e-4) and abs(f(got) - _loss(x, y, noise, got, y.mean())) < 1e-6 and f(got) < f(np.array(HYPER)) - 1
    asked = f.asked
    f(got + 0.01), f.slopes(got + 0.01)
    assert f.asked == asked + 1


def test_methods_of_training(spark):
    """Every method finds the bottom of a bowl, a method of one's own too; a worse result is turned down."""
    bowl = lambda h: 20 * float((np.log(h / np.array([1.0, 2.0])) ** 2).sum())  # noqa: E731  # narrow, so that the median of chains is near its bottom
    b = np.array([[0.1, 10.0], [0.1, 10.0]])
    for method, steps in (("local", 50), ("adam", 3000), ("global", 40), ("searches", 30), ("mcmc", 600), ("bo", 25)):
        got = training.train(bowl, [5.0, 0.5], b, method, spark=spark, steps=steps)
        assert np.allclose(got, [1.0, 2.0], atol=0.5 if method == "mcmc" else 0.1), method
    assert training.train(bowl, [5.0, 0.5], b, lambda f, s, bounds: s / 2)[0] == 5.0
    assert training.train(bowl, [5.0, 0.5], b, lambda f, s, bounds: s / 2, accept_only_if_improved=False)[0] == 2.5
    with pytest.raises(ValueError, match="no method"):
        training.train(bowl, [5.0, 0.5], b, "best")


def test_covariance_without_a_factor_counts_as_worst():
    class Broken:
        def log_likelihood(self):
            raise RuntimeError("in a task: NotPositiveDefinite: no Cholesky factor")

    assert training.TableObjective(lambda h: Broken(), worst=5.0)(np.ones(1)) == 5.0


def test_chains_learn_the_covariance(spark):
    """A long, narrow normal distribution: its mean and covariance come back, and the jumps take on its shape."""
    s = np.array([[1.0, 0.95], [0.95, 1.0]])
    inverse = np.linalg.inv(s)
    target = lambda h: float(-0.5 * (h - 3) @ inverse @ (h - 3))
    b = np.array([[-7.0, 13.0], [-7.0, 13.0]])
    trace = training.learned_chains(spark, target, [0.0, 6.0], b, 4, 600, 6).cache()
    mean, seen, rate = training.pooled_covariance(trace.where("portion >= 3"))
    assert np.allclose(mean, 3, atol=0.35) and np.allclose(seen, s, atol=0.35) and 0.1 < rate < 0.5
    assert trace.count() == 4 * 600 * 6 and trace.agg(F.max("iter")).first()[0] == 3599
    # A prior of one's own, jumps of one's own, and a rule to stop.
    positive = lambda h: 0.0 if (h > 3).all() else -np.inf
    part = training.learned_chains(spark, target, [4.0, 4.0], b, 2, 100, 5, log_prior=positive, stop=lambda t: t.count() >= 400)
    assert part.agg(F.max("portion")).first()[0] == 1 and not part.where("hps[0] <= 3 OR hps[1] <= 3").count()
    steps = training.chains(spark, target, [3.0, 3.0], b, 1, 50, propose=lambda x, rng: x + rng.choice([-1.0, 1.0], 2))
    assert all(float(v).is_integer() for r in steps.collect() for v in r.hps)


def test_forms_of_mean_and_noise(spark):
    """Slopes by all parameters against differences of the dense likelihood, given or by differences; predictions; bad noise."""
    pts, x, y = _points(spark)
    mean, noise = (lambda c, p: p[0] + p[1] * c[1]), (lambda c, p: p[0] * F.exp(p[1] * c[0]))
    model = ParametricProcess(pts.drop("noise_var"), HYPER, mean, [0.2, 0.9], noise, [0.1, 0.3], noise_slopes=lambda c, p: [F.exp(p[1] * c[0]), p[0] * c[0] * F.exp(p[1] * c[0])])

    def loss(p):
        return _loss(x, y, p[5] * np.exp(p[6] * x[:, 0]), p[:3], p[3] + p[4] * x[:, 1])

    at = np.array(model.parameters)
    assert abs(model.log_likelihood() + loss(at)) < 1e-7
    g = model.likelihood_gradient()
    for k in range(7):
        e = np.zeros(7)
        e[k] = 1e-5
        assert abs((loss(at + e) - loss(at - e)) / 2e-5 + g[k]) < 1e-4 * max(1, abs(g[k])), k
    q = x[:4] + 0.05
    got = {r.pred_id: (r.m, r.v) for r in model.predict(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "pred_id long, x array<double>")).collect()}
    k, s = wendland_block(q, x, HYPER), wendland_block(x, x, HYPER) + np.diag(0.1 * np.exp(0.3 * x[:, 0]))
    assert np.allclose([got[j][0] for j in range(4)], 0.2 + 0.9 * q[:, 1] + k @ np.linalg.solve(s, y - 0.2 - 0.9 * x[:, 1]), atol=1e-7)
    assert np.allclose([got[j][1] for j in range(4)], 1.5 - np.diag(k @ np.linalg.solve(s, k.T)), atol=1e-7)
    one = spark.createDataFrame([([2.0, 3.0],)], "x array<double>")
    d = one.select(*[c.alias(f"d{j}") for j, c in enumerate(difference_slopes(noise)([F.get("x", 0), F.get("x", 1)], [0.1, 0.3]))]).first()
    assert np.allclose(d, [np.exp(0.6), 0.2 * np.exp(0.6)], rtol=1e-6)
    with pytest.raises(ValueError, match="positive"):
        ParametricProcess(pts.drop("noise_var"), HYPER, mean, [0.2, 0.9], lambda c, p: p[0] - c[0], [0.5])


def _groups(spark, n=800, seed=6):
    rng, rows = np.random.default_rng(seed), []
    parts = {1: [([0, 0], [[1, 0.8], [0.8, 1]], 0.3), ([6, 1], [[1, -0.5], [-0.5, 0.6]], 0.7)], 2: [([0, 5], [[0.5, 0], [0, 2]], 0.5), ([5, -3], [[2, 1], [1, 1]], 0.5)]}
    for station, cs in parts.items():
        for m, s, w in cs:
            rows += [(station, v.tolist()) for v in rng.multivariate_normal(m, s, int(n * w))]
    return spark.createDataFrame(rows + [(1, None), (2, [1.0, None]), (2, [float("nan"), 1.0]), (1, [1.0])], "station int, x array<double>"), parts


def test_full_mixtures_find_their_parts(spark):
    df, parts = _groups(spark)
    got = M.station_mixtures(df, 2, 2, rounds=60, tol=1e-3)
    for station, cs in parts.items():
        own = got.where(F.col("station") == station).orderBy("k").collect()
        for r, (m, s, w) in zip(own, sorted(cs, key=lambda c: c[0]), strict=True):
            assert abs(r.weight - w) < 0.05 and np.allclose(r.mean, m, atol=0.25) and np.allclose(np.reshape(r.covariance, (2, 2)), s, atol=0.35)
    # The likelihood is that of the densities written out.
    like = {r.station: (r.n, r.log_likelihood) for r in M.log_likelihood(df, got, 2, 2).collect()}
    for station in parts:
        x = np.array([r.x for r in M.usable(df, 2).where(F.col("station") == station).collect()])
        dens = np.zeros(len(x))
        for r in got.where(F.col("station") == station).collect():
            s, d = np.reshape(r.covariance, (2, 2)), x - np.array(r.mean)
            dens += r.weight * np.exp(-0.5 * (d @ np.linalg.inv(s) * d).sum(1)) / (2 * np.pi * np.linalg.det(s) ** 0.5)
        assert like[station][0] == len(x) and abs(like[station][1] - np.log(dens).sum()) < 1e-6
    draws = M.sampled(got, 3000, 2).groupBy("station").agg(F.avg(F.get("x", 0)), F.avg(F.get("x", 1))).collect()
    for station, a, b in draws:
        assert np.allclose([a, b], sum(w * np.array(m, float) for m, _, w in parts[station]), atol=0.3)
    assert M.station_mixtures(df.limit(0), 2, 2, rounds=2).count() == 0


def test_matrix_root_distance():
    rng = np.random.default_rng(1)
    a, b = (v @ v.T for v in rng.normal(size=(2, 3, 3)))
    assert np.allclose(M.root(a) @ M.root(a), a) and M.w2_squared(np.zeros(3), a, np.zeros(3), a) < 1e-9
    d1, d2 = np.diag([1.0, 4.0]), np.diag([9.0, 0.25])
    assert abs(M.w2_squared(np.zeros(2), d1, np.array([3.0, 4.0]), d2) - (25 + (1 - 3) ** 2 + (2 - 0.5) ** 2)) < 1e-9
    # Moved by the optimal map, a sample of one normal has the moments of the other, at that cost.
    r = np.linalg.inv(M.root(a))
    t = r @ M.root(M.root(a) @ b @ M.root(a)) @ r
    assert np.allclose(t @ a @ t, b) and abs(np.trace((t - np.eye(3)) @ a @ (t - np.eye(3))) - M.w2_squared(np.zeros(3), a, np.zeros(3), b)) < 1e-8
    assert np.allclose(M.full(np.array([[1.0, 2.0]])), [np.diag([1.0, 2.0])]) and np.linalg.eigvalsh(M.positive(np.diag([1.0, -1.0]))).min() > 0


def test_alignment_level_by_level(spark):
    """Components shuffled at every station get the numbers of the root's again, whatever the order of the tree's levels."""
    rng, rows, tree = np.random.default_rng(2), [], [(0, None, 0)]
    base = [([0.0, 0.0], [1.0, 0.0, 0.0, 1.0]), ([0.5, 0.0], [1.0, 0.9, 0.9, 1.0]), ([0.5, 0.2], [1.0, -0.9, -0.9, 1.0])]
    for s in range(12):
        order = rng.permutation(3) if s else np.arange(3)
        rows += [(s, k, 0.1 * (int(c) + 1), (np.array(base[c][0]) + 0.02 * s).tolist(), base[c][1]) for k, c in enumerate(order)]
        if s:
            tree.append((s, (s - 1) // 2, int(np.log2(s + 1))))
    comp = spark.createDataFrame(rows, "station int, k int, weight double, mean array<double>, covariance array<double>")
    for got in (M.aligned_by_level(comp, spark.createDataFrame(tree, "station int, parent int, level int"), 2), M.aligned_to(comp, 0, 2)):
        assert all(abs(r.weight - 0.1 * (r.k + 1)) < 1e-9 for r in got.collect()) and got.count() == 36

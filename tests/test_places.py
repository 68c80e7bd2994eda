"""Models whose points share coordinates: the results of the dense system over all points, from one of the size of the places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from krigora.functions import kernels as K
from krigora.functions.networks import Network
from krigora.operators import covariance as C
from krigora.operators.cells import CellGaussianProcess
from krigora.operators.gp import GaussianProcess, block, exact_model, gaussian_entropy
from krigora.operators.strips import StripGaussianProcess, wendland_block
from krigora.operators.tiles import TiledGaussianProcess
from krigora.operators.warped import WarpedProcess
from krigora.sources.places import Places

HYPER = [1.3, 0.7, 0.9]


@pytest.fixture(scope="module")
def repeated(spark):
    rng = np.random.default_rng(8)
    x = (rng.random((12, 2)) * 3)[rng.integers(0, 12, 70)]
    y, noise = np.sin(3 * x[:, 0]) + 0.3 * rng.normal(size=70), 0.05 + rng.random(70)
    rows = [(int(k), a.tolist(), float(b), float(c)) for k, (a, b, c) in enumerate(zip(x, y, noise))]
    return spark.createDataFrame(rows, "pt_id long, x array<double>, y double, noise_var double"), x, y, noise


def _truth(x, y, noise, q, kernel):
    s, r, k = kernel(x, x) + np.diag(noise), y - y.mean(), kernel(x, q)
    alpha, inverse = np.linalg.solve(s, r), np.linalg.inv(s)
    like = -0.5 * (r @ alpha + np.linalg.slogdet(s)[1] + len(y) * np.log(2 * np.pi))
    return alpha, inverse, like, y.mean() + k.T @ alpha, HYPER[0] - (k * (inverse @ k)).sum(0)


def _ask(spark, q):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "pred_id long, x array<double>")


def _same(got, m, v):
    got = got.orderBy("pred_id").toPandas()
    assert np.allclose(got["m"], m, atol=1e-7) and np.allclose(got["v"], v, atol=1e-7)


def test_a_dense_model_bounds_places_not_points(spark, repeated):
    pts, x, y, noise = repeated
    q = np.random.default_rng(1).random((5, 2)) * 3
    alpha, inverse, like, m, v = _truth(x, y, noise, q, lambda a, b: block(a, b, HYPER))
    gp = GaussianProcess(pts, HYPER, most_dense=12)
    assert gp.n == 70 and len(gp.x) <= 12
    assert np.isclose(gp.log_likelihood(), like) and np.isclose(gp.log_likelihood(HYPER), like)
    assert np.isclose(gp.logdet, np.linalg.slogdet(np.linalg.inv(inverse))[1])
    slopes = [0.5 * (alpha @ d @ alpha - (inverse * d).sum()) for d in K.default_kernel_slopes(x, x, np.array(HYPER))]
    assert np.allclose(gp.likelihood_gradient(), slopes)
    _same(gp.predict(_ask(spark, q)), m, v)
    _same(gp.predict(_ask(spark, q), add_noise=True), m, v + noise.mean())
    both = np.concatenate([x, q])
    assert np.isclose(gp.entropy(q), gaussian_entropy(block(both, both, HYPER) + 1e-9 * np.eye(len(both))), rtol=1e-4)
    uneven = GaussianProcess(pts, HYPER, noise=lambda z: 0.1 + z[:, 0], most_dense=12)
    assert np.isclose(uneven.log_likelihood(), _truth(x, y, 0.1 + x[:, 0], q, lambda a, b: block(a, b, HYPER))[2])
    gp.append(x[:3], y[:3], noise[:3])
    x2, y2, noise2 = (np.concatenate([a, a[:3]]) for a in (x, y, noise))
    _same(gp.predict(_ask(spark, q)), *_truth(x2, y2, noise2, q, lambda a, b: block(a, b, HYPER))[3:])


def test_tiles(spark, repeated):
    pts, x, y, noise = repeated
    q = np.random.default_rng(2).random((5, 2)) * 3
    _, _, like, m, v = _truth(x, y, noise, q, lambda a, b: block(a, b, HYPER))
    gp = exact_model(pts, HYPER, most_dense=4)
    assert isinstance(gp, TiledGaussianProcess) and np.isclose(gp.log_likelihood(), like)
    part = TiledGaussianProcess(pts.where("pt_id < 40"), HYPER, size=5)
    part.append(pts.where("pt_id >= 40"))
    assert part.blocks <= 6
    _same(part.predict(_ask(spark, q)), m, v)
    assert np.isclose(part.log_likelihood(), like)


def test_strips_and_cells(spark, repeated):
    pts, x, y, noise = repeated
    q = np.random.default_rng(3).random((5, 2)) * 3
    alpha, inverse, like, m, v = _truth(x, y, noise, q, lambda a, b: wendland_block(a, b, HYPER))
    strips = StripGaussianProcess(pts, HYPER, most=12)
    assert np.isclose(strips.log_likelihood(), like)
    _same(strips.predict(_ask(spark, q)), m, v)
    got = strips.inverse_diagonal().orderBy("i").toPandas()
    assert np.allclose(got["alpha"], alpha) and np.allclose(got["inverse"], inverse.diagonal())
    along = np.array(strips.point_slopes().orderBy("i").toPandas()["slope"].tolist())
    for i, t in ((0, 0), (41, 1)):  # the likelihood as one point moves, by differences
        moved = []
        for e in (1e-5, -1e-5):
            z = x.copy()
            z[i, t] += e
            moved.append(_truth(z, y, noise, q, lambda a, b: wendland_block(a, b, HYPER))[2])
        assert np.isclose(along[i, t], (moved[0] - moved[1]) / 2e-5, rtol=1e-4, atol=1e-6)
    cells = CellGaussianProcess(pts, HYPER)
    assert np.allclose(cells.weights().orderBy("i").toPandas()["alpha"], alpha, atol=1e-6)
    _same(cells.predict(_ask(spark, q)), m, v)


def test_weights_alone_take_cells_where_strips_are_wide(spark, repeated, monkeypatch):
    """A strip's row grows with the square of its places, so their number is bounded for weights; predictions keep their strips."""
    from krigora.operators import strips

    pts, x, y, noise = repeated
    monkeypatch.setattr(strips, "WEIGHTS_MOST", 5)
    gp = strips.compact_model(pts, HYPER, weights_only=True)
    assert isinstance(gp, CellGaussianProcess) and isinstance(strips.compact_model(pts, HYPER, predicts=False), StripGaussianProcess)
    alpha = np.linalg.solve(wendland_block(x, x, HYPER) + np.diag(noise), y - y.mean())
    assert np.allclose(gp.weights().orderBy("i").toPandas()["alpha"], alpha, atol=1e-6)


def test_a_network_over_places(spark, repeated):
    pts, x, y, noise = repeated
    net = Network(2, 3)
    w = np.round(np.cos(1.7 * np.arange(net.size)), 3)
    gp = WarpedProcess(pts, net, w, HYPER, aim=8)
    z = np.array(pts.select(net.column(F.col("x"), w).alias("z"), "pt_id").orderBy("pt_id").toPandas()["z"].tolist())
    assert np.isclose(gp.log_likelihood(), _truth(z, y, noise, z[:2], lambda a, b: wendland_block(a, b, HYPER))[2])
    g = gp.likelihood_gradient()
    for k in (0, 2, 3, len(g) - 1):
        e = np.zeros(len(g))
        e[k] = 1e-5
        likes = []
        for sign in (1, -1):
            gp.set_parameters(np.array([*HYPER, *w]) + sign * e)
            likes.append(gp.log_likelihood())
        assert np.isclose(g[k], (likes[0] - likes[1]) / 2e-5, rtol=1e-3, atol=1e-4)


def test_noise_must_be_positive(spark, repeated):
    with pytest.raises(ValueError, match="positive"):
        Places(repeated[0].withColumn("noise_var", F.lit(0.0)))


def test_sums_over_pairs_from_places(spark, repeated):
    pts, x, y, noise = repeated
    from krigora.operators import covariance as C
    from krigora.operators import samples

    kernel = lambda a, b: K.default_kernel(a, b, HYPER)
    full = block(x, x, HYPER) + 0.25 * np.eye(70)
    got = C.place_fingerprint(pts, kernel, 2, 0.25).first()
    assert (got["n"], got["nnz"]) == (70, 4900) and np.isclose(got["trace"], full.trace()) and np.isclose(got["frobenius"], np.linalg.norm(full))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    a, b = pts.where("pt_id < 30"), pts.where("pt_id >= 30")
    assert np.isclose(samples.energy_distance_points(a, b, 2), 2 * d[:30, 30:].mean() - d[:30, :30].mean() - d[30:, 30:].mean())
    k = np.exp(-0.5 * d * d)
    want = (k[:30, :30].sum() - 30) / (30 * 29) + (k[30:, 30:].sum() - 40) / (40 * 39) - 2 * k[:30, 30:].mean()
    assert np.isclose(samples.mmd_rbf(a, b, 2, 0.5), want)
    assert C._paired(C.counted(pts), C.counted(pts), 4000).count() <= 12 * 12
    v = pts.select(F.col("pt_id").alias("i"), F.col("y").alias("v"))
    product = C.ball_product(pts, v, HYPER[1:], 2, HYPER[0]).orderBy("i").toPandas()["v"]
    assert np.allclose(product, wendland_block(x, x, HYPER) @ y)


def test_pairs_are_dealt_to_as_many_tasks_as_they_need(spark, repeated, monkeypatch):
    from krigora.operators import covariance as C

    monkeypatch.setattr(C, "TASK_PAIRS", 500)
    one = repeated[0].coalesce(1)
    assert C.half_covariance(one, lambda a, b: K.default_kernel(a, b, HYPER), 2).rdd.getNumPartitions() >= 10
    monkeypatch.setattr(C, "BROADCAST_POINTS", 10)
    got = C.half_covariance(one, lambda a, b: K.default_kernel(a, b, HYPER), 2, block=20)
    assert got.rdd.getNumPartitions() >= 10 and got.count() == 70 * 71 // 2


def test_groups_of_repeated_points_and_exact_ties(spark, repeated):
    from krigora.operators.gp import grouped_posterior

    pts, x, y, _ = repeated
    q = np.random.default_rng(4).random((5, 2)) * 3
    ask = _ask(spark, q).withColumn("g", F.lit(0))
    noise = (np.abs(y).mean() / 100) ** 2
    _same(grouped_posterior(pts.drop("noise_var").withColumn("g", F.lit(0)), "g", ask, HYPER), *_truth(x, y, np.full(70, noise), q, lambda a, b: block(a, b, HYPER))[3:])
    # Two points at one distance on both sides of the query: their mean, to the last digit and in either order.
    rng = np.random.default_rng(5)
    pairs = [(g, [at], float(v)) for g in range(200) for at, v in zip(rng.permutation([0.0, 1.0]).tolist(), np.round(rng.normal(size=2), 5))]
    rows = spark.createDataFrame(pairs, "g int, x array<double>, y double")
    one = rows.select("g").distinct().select("g", F.lit(0).cast("long").alias("pred_id"), F.array(F.lit(0.5)).alias("x"))
    got = grouped_posterior(rows, "g", one, [1.0, 1.0]).orderBy("g").toPandas()["m"].to_numpy()
    assert (got == [(pairs[2 * g][2] + pairs[2 * g + 1][2]) / 2 for g in range(200)]).all()


def _repeated(spark, n=400, places=12):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((places, 2)), 2)[rng.integers(0, places, n)]
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "pt_id long, x array<double>").coalesce(1), x


def test_ball_join_is_dealt_by_pairs_and_formed_by_places(spark, monkeypatch):
    """one small file gives as many tasks as its pairs need; values are formed below the rows they are repeated for."""
    monkeypatch.setattr(C, "TASK_PAIRS", 5_000)
    monkeypatch.setattr(C, "RUN", 7)
    pts, x = _repeated(spark)
    got = C.ball_join(pts, [0.5, 0.5], 2, 1.5)
    assert got.rdd.getNumPartitions() >= 10
    d = np.sqrt((((x[:, None] - x[None]) / 0.5) ** 2).sum(2))
    rows = got.toPandas().sort_values(["i", "j"])
    i, j = np.nonzero(np.triu(d < 1))
    assert (rows["i"].to_numpy() == i).all() and (rows["j"].to_numpy() == j).all() and np.allclose(rows["v"], 1.5 * K.wendland(d[i, j], K.NUMPY))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(ids") < plan.index("(d#")  # the plan is printed from the top


@pytest.mark.parametrize("blocks", [False, True])
def test_covariances_form_a_value_once_for_a_point_and_a_place(spark, monkeypatch, blocks):
    """kernel and rounding are below the explosion of a place's ids; ids at several places are pairs both ways, as in SQL."""
    if blocks:
        monkeypatch.setattr(C, "BROADCAST_POINTS", 5)
    pts, x = _repeated(spark)
    twin = spark.createDataFrame([(3, [0.111, 0.222])], pts.schema)
    all_x, ids = np.concatenate([x, [[0.111, 0.222]]]), np.append(np.arange(len(x)), 3)
    kernel = lambda a, b: K.default_kernel(a, b, HYPER)
    got = C.half_covariance(pts.unionByName(twin), kernel, 2, block=20, noise=0.25, shown=lambda v: F.round(v, 6))
    d = np.sqrt((((all_x[:, None] - all_x[None]) / HYPER[1:]) ** 2).sum(2))
    k = HYPER[0] * (1 + np.sqrt(3) * d) * np.exp(-np.sqrt(3) * d) + 0.25 * (ids[:, None] == ids[None])
    want = sorted((int(ids[a]), int(ids[b]), k[a, b]) for a in range(len(ids)) for b in range(len(ids)) if ids[a] <= ids[b])
    rows = sorted(map(tuple, got.collect()))
    assert [r[:2] for r in rows] == [w[:2] for w in want] and np.allclose([r[2] for r in rows], [w[2] for w in want], atol=2e-6)
    cross = C.cross_covariance(pts.where("pt_id < 50"), pts.where("pt_id >= 50"), kernel, 2, block=20, shown=lambda v: F.round(v, 6))
    assert cross.count() == 50 * 350 and {(r.i, r.j): r.v for r in cross.collect()}[0, 399] == pytest.approx(k[0, 399], abs=1e-6)
    for df in (got, cross):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode(ids") < plan.index("round(")

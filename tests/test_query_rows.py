"""The rows of the queries without SQL against NumPy on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from krigora import registry
from krigora.functions import kernels as K

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def _rows(sql):
    return duckdb.sql(sql.replace("FROM ", f"FROM '{SF}/").replace(" ;", ".parquet'")).df()


def _kernel(a, b, h):
    d = np.sqrt((((a[:, None] - b[None]) / h[1:]) ** 2).sum(2))
    return h[0] * (1 + np.sqrt(3) * d) * np.exp(-np.sqrt(3) * d)


@pytest.fixture(scope="module")
def suppliers():
    s = _rows("SELECT * FROM supplier ;").sort_values("s_suppkey")
    return np.c_[s["s_nationkey"] / 5.0, (s["s_suppkey"] % 10) / 3.0], (s["s_acctbal"] / 1000).to_numpy()


def _loss(x, y, h):
    k = _kernel(x, x, np.asarray(h, float)) + 0.25 * np.eye(len(y))
    r = y - y.mean()
    return 0.5 * (r @ np.linalg.solve(k, r) + np.linalg.slogdet(k)[1] + len(y) * np.log(2 * np.pi))


@pytest.mark.parametrize("name", ["train_gradient", "train_evolution", "train_bayesian"])
def test_training(spark, suppliers, name):
    x, y = suppliers
    got = registry.QUERIES[name](spark, SF).orderBy("parameter").toPandas()
    h, loss = got["value"].to_numpy(), got["loss"].iloc[0]
    bounds = np.array([[v / 100, v * 10] for v in (y.var(), *np.ptp(x, axis=0))])
    assert np.isclose(_loss(x, y, h), loss) and (h >= bounds[:, 0] - 1e-12).all() and (h <= bounds[:, 1] + 1e-12).all()
    grid = [_loss(x, y, [a, b, c]) for a in np.geomspace(*bounds[0], 9) for b in np.geomspace(*bounds[1], 9) for c in np.geomspace(*bounds[2], 9)]
    assert loss <= (_loss(x, y, registry.HYPER) + 1e-9 if name == "train_gradient" else np.quantile(grid, 0.1))


def test_chains(spark, suppliers):
    """The chains' best point is about the best of a fine grid of the bounds; their means lie where the density does (the query's
    200 steps are few, so within two of its deviations)."""
    x, y = suppliers
    got = registry.QUERIES["train_chains"](spark, SF).orderBy("parameter").toPandas()
    bounds = np.array([[v / 100, v * 10] for v in (y.var(), *np.ptp(x, axis=0))])
    axes = [np.linspace(*b, 26)[:-1] + np.ptp(b) / 50 for b in bounds]
    grid = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
    log = -np.array([_loss(x, y, h) for h in grid])
    p = np.exp(log - log.max())
    mean = p @ grid / p.sum()
    sd = np.sqrt(p @ (grid - mean) ** 2 / p.sum())
    assert (np.abs(got["mean"] - mean) < 2 * sd).all() and _loss(x, y, got["best"]) < -log.max() + 1 and (got["best"] >= bounds[:, 0]).all() and (got["best"] <= bounds[:, 1]).all()


def test_information(spark, suppliers):
    x, y = suppliers
    n = _rows("SELECT * FROM nation ;").sort_values("n_nationkey")
    q, h = np.c_[n["n_nationkey"] / 5.0, n["n_regionkey"]].astype(float), np.array(registry.HYPER)
    entropy = lambda s: 0.5 * (len(s) * (1 + np.log(2 * np.pi)) + np.linalg.slogdet(s)[1])
    own = lambda z: _kernel(z, z, h) + 1e-9 * np.eye(len(z))
    both = own(np.concatenate([x, q]))
    kl = lambda m1, m2, s1, s2: 0.5 * (np.trace(np.linalg.solve(s2, s1)) - len(m1) + (m2 - m1) @ np.linalg.solve(s2, m2 - m1) + np.linalg.slogdet(s2)[1] - np.linalg.slogdet(s1)[1])
    k = _kernel(x, x, h) + 0.25 * np.eye(len(y))
    cross = _kernel(x, q, h)
    m, s = y.mean() + cross.T @ np.linalg.solve(k, y - y.mean()), _kernel(q, q, h) - cross.T @ np.linalg.solve(k, cross)
    apart = both.copy()
    apart[: len(y), len(y) :] = apart[len(y) :, : len(y)] = 0
    apart[len(y) :, len(y) :] = np.diag(np.diag(both)[len(y) :])
    zero, jitter = np.zeros(len(both)), 1e-9 * np.eye(len(q))
    want = [entropy(both), entropy(own(x)) + entropy(own(q)) - entropy(both), abs(kl(zero, zero, both, apart)), abs(kl(np.full(len(q), y.mean()), m, own(q), s + jitter)), abs(kl(m, m, s + jitter, s + 0.1 * np.eye(len(q))))]
    got = registry.QUERIES["gp_information"](spark, SF).first()
    assert np.allclose(list(got), want, rtol=1e-3, atol=2e-3)


def test_sparse_logdet(spark):
    p = _rows("SELECT * FROM part ;").sort_values("p_partkey")
    x = np.c_[p["p_size"] / 50.0, p["p_retailprice"] / 2000.0]
    d = np.minimum(np.sqrt((((x[:, None] - x[None]) / registry.BALL) ** 2).sum(2)), 1)
    k = 1.5 * K.wendland(d, K.NUMPY) + registry.NOISE * np.eye(len(x))
    got = registry.QUERIES["sparse_logdet"](spark, SF).first()
    assert np.isclose(got["logdet"], np.linalg.slogdet(k)[1]) and got["residual"] < 1e-9


def test_aligned_mixtures(spark):
    """EM of every nation step by step; each child's components are nearest its parent's."""
    c, n = _rows("SELECT * FROM customer ;"), _rows("SELECT * FROM nation ;").sort_values("n_nationkey")
    fits = {}
    for s, g in c.groupby("c_nationkey"):
        x = np.c_[g["c_acctbal"] / 1000, (g["c_custkey"] % 10) / 3.0]
        var = np.tile(x.var(0) + 1e-6, (2, 1))
        mean, w = x.mean(0) + np.array([[-1], [1]]) * np.sqrt(var[0]), np.full(2, 0.5)
        for _ in range(12):
            log = np.log(w) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((x[:, None] - mean) ** 2 / var).sum(2))
            r = np.exp(log - log.max(1, keepdims=True))
            r /= r.sum(1, keepdims=True)
            size = r.sum(0) + 1e-12
            mean = r.T @ x / size[:, None]
            var = np.maximum(r.T @ x**2 / size[:, None] - mean**2, 0) + 1e-6
            w = np.maximum(r.sum(0) / len(x), 1e-9)
        fits[s] = (w, mean, var)
    at = np.c_[n["n_nationkey"] / 5.0, n["n_regionkey"]].astype(float)
    root = int(((at - at.mean(0)) ** 2).sum(1).argmin())
    seen, order = [root], []
    while len(seen) < len(at):
        d = ((at[seen][:, None] - at[None]) ** 2).sum(2)
        d[:, seen] = np.inf
        p, k = np.unravel_index(d.argmin(), d.shape)
        order.append((seen[p], int(k)))
        seen.append(int(k))
    got = {s: g.sort_values("k") for s, g in registry.QUERIES["mixture_points_aligned"](spark, SF).toPandas().groupby("station")}
    assert set(got) == set(fits)
    for s, g in got.items():
        mean, w = np.stack(g["mean"]), g["weight"].to_numpy()
        turned = [np.allclose(mean, fits[s][1][o], atol=0.006) and np.allclose(w, fits[s][0][o], atol=6e-4) for o in ([0, 1], [1, 0])]
        assert any(turned), s
    cost = lambda a, b: ((np.stack(got[a]["mean"]) - np.stack(got[b]["mean"])) ** 2).sum()
    crossed = lambda a, b: ((np.stack(got[a]["mean"]) - np.stack(got[b]["mean"])[::-1]) ** 2).sum()
    # The spread of the components counts too, so a few links may cross by their means alone.
    links = [(a, b) for a, b in order if a in got and b in got]
    assert np.mean([cost(a, b) <= crossed(a, b) + 1e-9 for a, b in links]) > 0.7

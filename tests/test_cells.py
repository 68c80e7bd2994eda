"""Cells of compactly supported covariances, their solvers and preconditioners, against dense NumPy."""

import numpy as np
import pytest

from krigora.operators.cells import CellGaussianProcess, Cells, WarmSolver
from krigora.operators.strips import wendland_block
from krigora.plans import training

HYPER = [2.0, 0.3, 0.4]


def _points(spark, n=90, seed=3, dims=2):
    rng = np.random.default_rng(seed)
    x = rng.random((n, dims)) * 2 - 1
    x[: n // 4] = x[: n // 4] * 0.2  # a crowd in one place
    y = np.sin(3 * x[:, 0]) + 0.1 * rng.normal(size=n)
    rows = [(k, v.tolist(), float(t), 0.8 + 0.01 * (k % 3)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "pt_id long, x array<double>, y double, noise_var double").repartition(3), x, y


def _dense(x, hyper=HYPER):
    return wendland_block(x, x, hyper) + np.diag(0.8 + 0.01 * (np.arange(len(x)) % 3))


@pytest.fixture(scope="module")
def made(spark):
    pts, x, y = _points(spark)
    return Cells(pts, HYPER, aim=10, most=16), x, y


def _column(cells, vector):
    got = {r.i: r.v for r in cells.entries(vector).collect()}
    return np.array([got[k] for k in range(len(got))])


def test_product_and_fingerprint(made):
    cells, x, y = made
    assert cells.blocks.count() > 8 and cells.blocks.selectExpr("max(size(pts))").first()[0] < 60
    k = _dense(x)
    assert np.allclose(_column(cells, cells.product(cells.column("y", 0.5))), k @ (y - 0.5))
    f = cells.fingerprint()
    assert f["n"] == len(x) and abs(f["trace"] - k.trace()) < 1e-9 and abs(f["frobenius"] - np.linalg.norm(k)) < 1e-9


def test_solves_with_every_preconditioner(made):
    """Same solution with each, and overlap or an approximate inverse needs fewer iterations than none."""
    cells, x, y = made
    steps, want = {}, np.linalg.solve(_dense(x), y)
    for kind, p in {"none": None, "schwarz": cells.schwarz(0.5), "inverse": cells.inverse(16)}.items():
        got, steps[kind] = cells.solve(cells.column("y"), p, tol=1e-5)
        assert np.allclose(_column(cells, got), want, atol=1e-3), kind
    assert max(steps["schwarz"], steps["inverse"]) < 0.8 * steps["none"], steps


def test_preconditioners_are_symmetric(made):
    """And positive; the approximate inverse with nearly all neighbours is close to the inverse (overlapping solves count a point
    once for each domain, so they need not be)."""
    cells, x, _ = made
    for kind, p in (("schwarz", cells.schwarz(0.5)), ("inverse", cells.inverse(40))):
        u, v = cells.signs(2, 1), cells.signs(2, 2)
        a, b = (np.stack([_column(cells, cells_column(w, k)) for k in range(2)], 1) for w in (u, v))
        pa, pb = (np.stack([_column(cells, cells_column(p(w), k)) for k in range(2)], 1) for w in (u, v))
        assert np.allclose(a.T @ pb, pa.T @ b) and np.linalg.eigvalsh(a.T @ pa).min() > 0
        assert kind == "schwarz" or np.linalg.norm(_dense(x) @ pa - a) < 0.5 * np.linalg.norm(a)


def cells_column(vector, k):
    """One column of a vector."""
    from krigora.operators.cells import _mapped

    return _mapped(vector, {"v": lambda m: m["v"][:, [k]]})


def test_alike_and_empty_columns(spark, made):
    """Right sides that are equal, multiples of each other or zero."""
    from krigora.operators.cells import _mapped

    cells, x, y = made
    right = _mapped(cells.column("y"), {"v": lambda m: np.concatenate([m["v"], 2 * m["v"], 0 * m["v"], 1e-8 * m["v"] ** 2], 1)})
    got, _ = cells.solve(right, cells.inverse(30), tol=1e-8)
    want = np.linalg.solve(_dense(x), np.stack([y, 2 * y, 0 * y, 1e-8 * y**2], 1))
    for k in range(4):
        assert np.allclose(_column(cells, cells_column(got, k)), want[:, k], atol=1e-6 * max(np.abs(want[:, k]).max(), 1e-12))
    none, steps = cells.solve(_mapped(right, {"v": lambda m: 0 * m["v"]}), None)
    assert steps == 0 and not _column(cells, cells_column(none, 0)).any()


def test_warm_starts(spark, made, tmp_path):
    """Nearly equal hyperparameters start from the last solution and keep its preconditioner; far ones do neither; a second
    session goes on from what the first has left."""
    cells, x, y = made
    near, far = [2.05, 0.295, 0.4], [6.0, 0.2, 0.2]
    solver = WarmSolver(cells, cells.column("y"), f"file://{tmp_path}/state", tol=1e-6)
    _, cold = solver.solve()
    first = solver.precondition
    got, warm = solver.solve(near)
    assert warm < cold and solver.precondition is first and np.allclose(_column(cells, got), np.linalg.solve(_dense(x, near), y), atol=1e-4)
    again = WarmSolver(cells, cells.column("y"), f"file://{tmp_path}/state", tol=1e-5)
    assert again.solve(near)[1] <= 1 and again.last["served"] == 3
    assert np.allclose(_column(cells, again.solve(far)[0]), np.linalg.solve(_dense(x, far), y), atol=1e-3) and again.last["served"] == 1
    with pytest.raises(ValueError, match="reach over"):
        cells.product(cells.column("y"), [2.0, 50.0, 0.4])


def test_domains_are_rows_of_points_not_matrices(spark):
    """A domain's row grows with its points, which are bounded, and not with their square; every point is in one at least."""
    pts, x, y = _points(spark, 400, seed=5)
    cells = Cells(pts, HYPER, aim=10, most=30)
    p = cells.schwarz(0.5)
    rows = p.domains.collect()
    for r in rows:
        n = len(r.noise) // 8
        assert n <= 5 * cells.most and sum(len(v) for v in r if isinstance(v, bytearray)) + sum(map(len, r.places)) <= 40 * n
    assert max(len(r.noise) // 8 for r in rows) > 30
    got, _ = cells.solve(cells.column("y"), p, tol=1e-8)
    assert np.allclose(_column(cells, got), np.linalg.solve(_dense(x), y), atol=1e-6)


def test_warm_state_is_rows_of_points(spark, tmp_path):
    """What a warm solver keeps for its next solves, and for another session, grows with the points and not with their square."""
    cells = Cells(_points(spark, 200, seed=5)[0], HYPER, aim=60, most=120)
    solver = WarmSolver(cells, cells.column("y"), f"file://{tmp_path}/state", tol=0.1)
    solver.solve()
    for kept in (solver.precondition.domains, spark.read.parquet(f"{tmp_path}/state/domains")):
        for r in kept.collect():
            assert sum(len(v) for v in r if isinstance(v, (bytes, bytearray))) <= 8 * (cells.dims + 1) * sum(len(p) // 4 for p in r.places)


def test_work_is_dealt_by_blocks_not_bytes(made):
    cells, _, _ = made
    assert cells.product(cells.column("y")).rdd.getNumPartitions() > 1 and cells.schwarz(0.5)(cells.column("y")).rdd.getNumPartitions() > 1


def test_unfinished_solve_raises(made):
    with pytest.raises(RuntimeError, match="after 2 iterations"):
        made[0].solve(made[0].column("y"), None, most=2)


def test_random_logdet(made):
    cells, x, _ = made
    estimate, variance = cells.random_logdet(probes=24, degree=12)
    assert variance > 0 and abs(estimate - np.linalg.slogdet(_dense(x))[1]) < 4 * variance**0.5 + 0.5


@pytest.mark.parametrize("dims", [1, 4])
def test_posterior(spark, dims):
    pts, x, y = _points(spark, 60, dims=dims)
    hyper = [2.0, *[0.5] * dims]
    gp = CellGaussianProcess(pts, hyper, aim=10, most=20, tol=1e-7)
    q = np.concatenate([x[:3] + 0.01, np.full((1, dims), 50.0)])
    ask = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "pred_id long, x array<double>")
    k, s = wendland_block(q, x, hyper), _dense(x, hyper)
    m, v = y.mean() + k @ np.linalg.solve(s, y - y.mean()), 2.0 - np.diag(k @ np.linalg.solve(s, k.T))
    for columns in (2,) if dims == 1 else (64,):
        got = {r.pred_id: (r.m, r.v) for r in gp.predict(ask, columns).collect()}
        assert np.allclose([got[j] for j in range(4)], np.stack([m, v], 1), atol=1e-5)
    assert np.allclose([r.m for r in gp.predict_mean(ask).orderBy("pred_id").collect()], m, atol=1e-5)
    assert gp.predict(ask.limit(0)).collect() == []
    assert np.allclose([r.alpha for r in gp.weights().orderBy("i").collect()], np.linalg.solve(s, y - y.mean()), atol=1e-5)


def test_likelihood_estimate_decides_with_its_uncertainty(spark):
    """The estimate lies within its deviations of the exact value, and a trained value is turned down only beyond them."""
    pts, x, y = _points(spark, 60)
    gp = CellGaussianProcess(pts, HYPER, aim=20, tol=1e-7)
    s, r = _dense(x), y - y.mean()
    exact = -0.5 * (r @ np.linalg.solve(s, r) + np.linalg.slogdet(s)[1] + 60 * np.log(2 * np.pi))
    assert abs(gp.log_likelihood(24, 12) - exact) < 4 * gp.log_likelihood_variance() ** 0.5 + 0.05 and gp.log_likelihood_variance() > 0
    worse = {1.0: 10.0, 2.0: 10.5}
    f = lambda h: worse[float(h[0])]
    old, new = np.array([1.0]), np.array([2.0])
    assert training.keep_if_better(f, old, new)[0] == 1.0
    assert training.keep_if_better(f, old, new, lambda h: 0.01)[0] == 1.0 and training.keep_if_better(f, old, new, lambda h: 0.02)[0] == 2.0


def test_vectors_on_the_driver_take_the_steps_of_tables_and_write_none(made, monkeypatch):
    """the same solution after as many iterations, for one column and several, cold and warm; an iteration writes no table."""
    from krigora.operators import cells as module

    cells, x, y = made
    kept, wrote = {"schwarz": cells.schwarz(0.5), "inverse": cells.inverse(16)}, []
    near = module.written(cells.solve(cells.column("y"), kept["schwarz"], tol=1e-3)[0], "near")
    write = module.written
    monkeypatch.setattr(module, "written", lambda df, name: wrote.append(name) or write(df, name))
    for kind, start in (("schwarz", None), ("inverse", None), ("schwarz", near)):
        solved, steps = cells.solve(cells.column("y"), kept[kind], start, tol=1e-8)
        assert not wrote and np.allclose(_column(cells, solved), np.linalg.solve(_dense(x), y), atol=1e-6), kind
    solved, steps = cells.solve(cells.column("y"), kept["schwarz"], tol=1e-3)
    monkeypatch.setattr(module, "HELD_NUMBERS", 0)
    table, want = cells.solve(cells.column("y"), kept["schwarz"], tol=1e-3)
    assert wrote and steps == want and np.allclose(_column(cells, solved), _column(cells, table), atol=1e-9)

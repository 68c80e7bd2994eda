"""All registered queries of the Gaussian-process engine and their SQL, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from krigora.functions import kernels as K
from krigora.functions.networks import Network
from krigora.operators import covariance as C
from krigora.operators import distributional, metrics, mixture, mixture_full, mixture_points, samples
from krigora.operators.cells import CellGaussianProcess, Cells, WarmSolver
from krigora.operators.gp import GaussianProcess, exact_model, grouped_posterior, kl_normal, object_posterior
from krigora.operators.parametric import ParametricProcess
from krigora.operators.strips import StripGaussianProcess, compact_model
from krigora.operators.tiles import TiledGaussianProcess
from krigora.operators.warped import WarpedProcess, warped_likelihood
from krigora.plans import training
from krigora.sources import points as P
from krigora.sources.places import Places
from krigora.sources.store import written
from krigora.streaming import appends

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LENGTHS = [1.5, 2.0]
HYPER = [2.0, 1.5, 1.0]
NOISE = 0.25
BALL = [0.03, 0.003]


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return P.points(_table(spark, d, "supplier"), "s_suppkey", [F.col("s_nationkey") / 5.0, (F.col("s_suppkey") % 10) / 3.0], F.col("s_acctbal") / 1000.0, F.lit(NOISE))


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return P.points(_table(spark, d, "nation"), "n_nationkey", [F.col("n_nationkey") / 5.0, F.col("n_regionkey")])


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return P.points(_table(spark, d, "part"), "p_partkey", [F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0], F.col("p_retailprice") / 1000.0)


# --- kernels: every supplier against every nation (25 rows)

_PAIRS = f"""WITH s AS (SELECT s_suppkey AS i, s_nationkey / 5.0::DOUBLE AS a1, (s_suppkey % 10) / 3.0::DOUBLE AS a2 FROM supplier),
n AS (SELECT n_nationkey::BIGINT AS j, n_nationkey / 5.0::DOUBLE AS b1, n_regionkey::DOUBLE AS b2 FROM nation),
p AS (SELECT i, j, a1, a2, b1, b2, sqrt(((a1 - b1) / {LENGTHS[0]}) ** 2 + ((a2 - b2) / {LENGTHS[1]}) ** 2) AS d FROM s, n)
"""
_D = K.distance
_W = "least(d, 1)"
_G = "(0.7 * exp(-(({0}1 - 1) ** 2 + ({0}2 - 1) ** 2) / 4) + 0.3 * exp(-(({0}1 - 3) ** 2 + ({0}2 - 2) ** 2) / 4))"
_E = "exp(-(({0}1 - 1) ** 2 + ({0}2 - 1) ** 2) / 4)"
_GL = "((0.7 * exp(-(({0}1 - 1) ** 2 + ({0}2 - 1) ** 2) / 4) * (({0}1 - 1) ** 2 + ({0}2 - 1) ** 2) + 0.3 * exp(-(({0}1 - 3) ** 2 + ({0}2 - 2) ** 2) / 4) * (({0}1 - 3) ** 2 + ({0}2 - 2) ** 2)) / 16)"
_BUMP = "(CASE WHEN 1 - (({0}1 - {1}) ** 2 + ({0}2 - {2}) ** 2) / 9 > 0 THEN exp(-0.9 / (1 - (({0}1 - {1}) ** 2 + ({0}2 - {2}) ** 2) / 9) + 0.9) ELSE 0 END)"
_SL = "(least(CASE WHEN d = 0 THEN 1e-5 ELSE d END / 2.5, 1))"
KERNELS: dict[str, tuple[Callable, str]] = {
    "squared_exponential": (lambda d, a, b: K.squared_exponential(d, 0.8), "exp(-d * d / (2 * 0.64))"),
    "squared_exponential_robust": (lambda d, a, b: K.squared_exponential_robust(d, 0.9), "exp(-d * d * 0.81)"),
    "exponential": (lambda d, a, b: K.exponential(d, 0.8), "exp(-d / 0.8)"),
    "exponential_robust": (lambda d, a, b: K.exponential_robust(d, 0.9), "exp(-d * 0.81)"),
    "matern_3_2": (lambda d, a, b: K.matern_3_2(d, 0.8), "(1 + sqrt(3) * d / 0.8) * exp(-sqrt(3) * d / 0.8)"),
    "matern_3_2_robust": (lambda d, a, b: K.matern_3_2_robust(d, 0.9), "(1 + sqrt(3) * d * 0.81) * exp(-sqrt(3) * d * 0.81)"),
    "matern_3_2_slope": (lambda d, a, b: K.matern_3_2_slope(d, 0.5), "-3 * d * 0.5 * exp(-sqrt(3) * d)"),
    "matern_5_2": (lambda d, a, b: K.matern_5_2(d, 0.8), "(1 + sqrt(5) * d / 0.8 + 5 * d * d / (3 * 0.64)) * exp(-sqrt(5) * d / 0.8)"),
    "matern_5_2_robust": (lambda d, a, b: K.matern_5_2_robust(d, 0.9), "(1 + sqrt(5) * d * 0.81 + 5 * d * d * 3 * 0.6561) * exp(-sqrt(5) * d * 0.81)"),
    "sparse_log": (lambda d, a, b: K.sparse_log(d, 2.5), f"sqrt(2) / (3 * sqrt(pi())) * (3 * {_SL} ** 2 * ln({_SL} / (1 + sqrt(1 - {_SL} ** 2))) + (2 * {_SL} ** 2 + 1) * sqrt(1 - {_SL} ** 2))"),
    "periodic": (lambda d, a, b: K.periodic(d, 0.8, 1.3), "exp(-2 / 0.64 * sin(pi() * d / 1.3) ** 2)"),
    "linear": (lambda d, a, b: K.linear(a[0], b[0], 0.5, 2.0, 0.3), "0.5 + 2 * ((a1 - 0.3) * (b1 - 0.3))"),
    "polynomial": (lambda d, a, b: K.polynomial(a[0] * b[0] + a[1] * b[1], 3), "(1 + a1 * b1 + a2 * b2) ** 3"),
    "dot_product": (lambda d, a, b: K.dot_product(a, b, 0.5, [[2.0, 0.3], [0.3, 1.0]]), "0.5 + a1 * (2 * b1 + 0.3 * b2) + a2 * (0.3 * b1 + b2)"),
    "wendland": (lambda d, a, b: K.wendland(d), f"(1 - {_W}) ** 8 * (32 * {_W} ** 3 + 25 * {_W} ** 2 + 8 * {_W} + 1)"),
    "bump": (lambda d, a, b: K.bump(d, 2.0, 1.5, 0.9), "CASE WHEN 1 - d * d / 4 > 0 THEN 0.9 * exp(-1.5 / (1 - d * d / 4) + 1.5) ELSE 0 END"),
    "non_stationary": (lambda d, a, b: K.radial_sum(a, [[1.0, 1.0], [3.0, 2.0]], [0.7, 0.3], 4.0) * K.radial_sum(b, [[1.0, 1.0], [3.0, 2.0]], [0.7, 0.3], 4.0), f"{_G.format('a')} * {_G.format('b')}"),
    "non_stationary_weight_slope": (lambda d, a, b: K.non_stationary_slopes(a, b, [[1.0, 1.0], [3.0, 2.0]], [0.7, 0.3], 4.0)[0], f"{_E.format('a')} * {_G.format('b')} + {_E.format('b')} * {_G.format('a')}"),
    "non_stationary_width_slope": (lambda d, a, b: K.non_stationary_slopes(a, b, [[1.0, 1.0], [3.0, 2.0]], [0.7, 0.3], 4.0)[2], f"{_GL.format('a')} * {_G.format('b')} + {_GL.format('b')} * {_G.format('a')}"),
    "landmark": (lambda d, a, b: K.landmark(a, b, [[1.0, 1.0], [3.0, 2.0]], [2.0, 3.0, 0.9, 0.5]), f"2 * exp(-(({_BUMP.format('a', 1, 1)} - {_BUMP.format('b', 1, 1)}) ** 2 + ({_BUMP.format('a', 3, 2)} - {_BUMP.format('b', 3, 2)}) ** 2) / 0.5)"),
    "out_of_bounds": (lambda d, a, b: K.out_of_bounds([a[0] - b[0], b[1]], [(-2.0, 2.0), (0.5, 3.0)]).cast("double"), "CASE WHEN a1 - b1 < -2 OR a1 - b1 > 2 OR b2 < 0.5 OR b2 > 3 THEN 1 ELSE 0 END"),
    "default": (lambda d, a, b: K.default_kernel(a, b, HYPER), "2 * (1 + sqrt(3) * sqrt(((a1 - b1) / 1.5) ** 2 + (a2 - b2) ** 2)) * exp(-sqrt(3) * sqrt(((a1 - b1) / 1.5) ** 2 + (a2 - b2) ** 2))"),
    "distance": (lambda d, a, b: d, "d"),
    "normal_density": (lambda d, a, b: K.normal_density(a[0], b[0], F.lit(0.5)), "exp(-1 * (a1 - b1) ** 2 / (2 * 0.5)) / sqrt(2 * pi() * 0.5)"),
}


def _kernel_query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        pairs = C.cross_covariance(_suppliers(spark, d), _nations(spark, d), lambda a, b: F.struct(KERNELS[name][0](_D(a, b, LENGTHS), a, b).alias("v")).getField("v"), 2)
        return pairs.select("i", "j", _r(F.col("v")).alias("v"))

    return run


for _name, (_, _sql) in KERNELS.items():
    QUERIES[f"kernel_{_name}"] = _kernel_query(_name)
    ORACLE_SQL[f"kernel_{_name}"] = f"{_PAIRS} SELECT i, j, round(v, 6) + 0.0::DOUBLE AS v FROM (SELECT i, j, ({_sql})::DOUBLE AS v FROM p) WHERE v <> 0"

# --- covariance

_SELF = """WITH s AS (SELECT s_suppkey AS i, s_nationkey / 5.0::DOUBLE AS a1, (s_suppkey % 10) / 3.0::DOUBLE AS a2 FROM supplier),
k AS (SELECT s.i, t.i AS j, 2 * (1 + sqrt(3) * d) * exp(-sqrt(3) * d) + CASE WHEN s.i = t.i THEN 0.25 ELSE 0 END AS v FROM
  (SELECT s.i, t.i AS j, sqrt(((s.a1 - t.a1) / 1.5) ** 2 + (s.a2 - t.a2) ** 2) AS d FROM s, s t) x JOIN s ON s.i = x.i JOIN s t ON t.i = x.j)
"""


def _kernel(a, b):
    return K.default_kernel(a, b, HYPER)


@_query(_SELF + "SELECT i, j, round(v, 6) AS v FROM k WHERE i <= j")
def covariance_half(spark: SparkSession, d: str) -> DataFrame:
    """K + V of the suppliers, the triangle i <= j."""
    return C.half_covariance(_suppliers(spark, d), _kernel, 2, noise=NOISE, shown=_r)


@_query(_SELF + "SELECT count(*) FILTER (WHERE i = j)::BIGINT AS n, count(*)::BIGINT AS nnz, round(sum(v) FILTER (WHERE i = j), 4) AS trace, round(sqrt(sum(v * v)), 4) AS frobenius FROM k")
def covariance_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    got = C.place_fingerprint(_suppliers(spark, d), _kernel, 2, NOISE)
    return got.select("n", F.col("nnz").cast("long").alias("nnz"), _r(F.col("trace"), 4).alias("trace"), _r(F.col("frobenius"), 4).alias("frobenius"))


_BALL = """WITH s AS (SELECT p_partkey AS i, p_size / 50.0::DOUBLE AS a1, p_retailprice / 2000.0::DOUBLE AS a2 FROM part),
k AS (SELECT i, j, 1.5 * (1 - d) ** 8 * (32 * d ** 3 + 25 * d * d + 8 * d + 1) AS v FROM
  (SELECT s.i, t.i AS j, sqrt(((s.a1 - t.a1) / 0.03) ** 2 + ((s.a2 - t.a2) / 0.003) ** 2) AS d FROM s JOIN s t ON s.i <= t.i AND abs(s.a1 - t.a1) <= 0.03 AND abs(s.a2 - t.a2) <= 0.003) WHERE d < 1)
"""


@_query(_BALL + "SELECT i, j, round(v, 6) AS v FROM k")
def covariance_ball_join(spark: SparkSession, d: str) -> DataFrame:
    """Compactly supported covariance of all parts through the grid join."""
    return C.ball_join(_parts(spark, d), BALL, 2, 1.5, shown=_r)


@_query(_BALL + ", f AS (SELECT i, j, v FROM k UNION ALL SELECT j, i, v FROM k WHERE i < j) SELECT f.i, round(sum(f.v * p.p_size), 4) AS v FROM f JOIN part p ON p.p_partkey = f.j GROUP BY f.i")
def covariance_matrix_vector(spark: SparkSession, d: str) -> DataFrame:
    sizes = _table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("v"))
    return C.ball_product(_parts(spark, d), sizes, BALL, 2, 1.5).select("i", _r(F.col("v"), 4).alias("v"))


@_query(_SELF.replace("CASE WHEN s.i = t.i THEN 0.25 ELSE 0 END", "0") + "SELECT i, j, round(v, 6) AS v FROM k WHERE i <= j")
def covariance_appended(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers of the second half arrive later: old triangle, cross block and new triangle make the whole covariance."""
    s = _suppliers(spark, d)
    half = s.agg(F.max("pt_id")).first()[0] // 2
    old, new = s.where(F.col("pt_id") <= half), s.where(F.col("pt_id") > half)
    return C.stacked(C.half_covariance(old, _kernel, 2, shown=_r), C.cross_covariance(old, new, _kernel, 2, shown=_r), C.half_covariance(new, _kernel, 2, shown=_r))


@_query(
    _SELF + """, w AS (SELECT s.i, t.i AS j, 4 * (1 + sqrt(3) * d) * exp(-sqrt(3) * d) + CASE WHEN s.i = t.i THEN 0.25 ELSE 0 END AS v FROM
  (SELECT s.i, t.i AS j, sqrt(((s.a1 - t.a1) / 3) ** 2 + ((s.a2 - t.a2) / 2) ** 2) AS d FROM s, s t) x JOIN s ON s.i = x.i JOIN s t ON t.i = x.j),
f AS (SELECT (SELECT sum(v) FROM k WHERE i = j) AS t0, (SELECT sum(v) FROM w WHERE i = j) AS t1, (SELECT sqrt(sum(v * v)) FROM k) AS f0, (SELECT sqrt(sum(v * v)) FROM w) AS f1)
SELECT round(greatest(abs(t1 - t0) / greatest(t0, t1), abs(f1 - f0) / greatest(f0, f1)), 6) AS drift FROM f"""
)
def covariance_drift(spark: SparkSession, d: str) -> DataFrame:
    """How far K + V moves when all hyperparameters are doubled."""
    made = [C.place_fingerprint(_suppliers(spark, d), lambda a, b, f=f: K.default_kernel(a, b, [h * f for h in HYPER]), 2, NOISE) for f in (1, 2)]
    return C.drift(*made).select(_r(F.col("drift")).alias("drift"))


@_query()
def sparse_logdet(spark: SparkSession, d: str) -> DataFrame:
    """log|K + V| over all parts, exactly, and the residual of the solution of the same system under the ball join's product."""
    pts = _parts(spark, d)
    gp = StripGaussianProcess(pts, [1.5, *BALL], NOISE, predicts=False)
    x = written(gp.weights(), "weights")
    got = C.ball_product(pts, x.select("i", F.col("alpha").alias("v")), BALL, 2, 1.5).join(x, "i").join(pts.select(F.col("pt_id").alias("i"), (F.col("y") - gp.mean).alias("r")), "i")
    return got.agg(F.sqrt(F.sum(F.pow(F.col("v") + NOISE * F.col("alpha") - F.col("r"), 2))).alias("residual")).select(F.lit(gp.logdet).alias("logdet"), "residual")


_CG = (
    _BALL + """, t AS (SELECT p_partkey AS i, row_number() OVER (ORDER BY p_partkey) AS r, p_retailprice / 1000.0::DOUBLE - (SELECT avg(p_retailprice / 1000.0::DOUBLE) FROM part) AS y FROM part),
f AS (SELECT i, j, v + CASE WHEN i = j THEN 0.25 ELSE 0 END AS v FROM k UNION ALL SELECT j, i, v FROM k WHERE i < j),
w AS (SELECT a.r, list(b.r ORDER BY b.r) AS js, list(f.v::DOUBLE ORDER BY b.r) AS vs FROM f JOIN t a ON a.i = f.i JOIN t b ON b.i = f.j GROUP BY a.r),
m AS (SELECT list(js ORDER BY r) AS js, list(vs ORDER BY r) AS vs FROM w), y AS (SELECT list(y::DOUBLE ORDER BY r) AS y, list(i ORDER BY r) AS ids FROM t),
g AS (SELECT 0 AS it, list_transform(y, lambda c: 0.0::DOUBLE) AS x, y AS r, y AS p, list_inner_product(y, y) AS rr FROM y
  UNION ALL SELECT it + 1, nx, nr, list_transform(nr, lambda c, k: c + list_inner_product(nr, nr) / rr * p[k]), list_inner_product(nr, nr)
  FROM (SELECT it, p, rr, list_transform(x, lambda c, k: c + a * p[k]) AS nx, list_transform(r, lambda c, k: c - a * ap[k]) AS nr
    FROM (SELECT *, rr / list_inner_product(p, ap) AS a FROM (SELECT g.*, list_transform(m.vs, lambda v, k: list_inner_product(v, list_select(p, m.js[k]))) AS ap FROM g, m WHERE rr > 1e-24 AND it < 1000))))
SELECT unnest(ids) AS i, round(unnest(x), 4) + 0.0::DOUBLE AS alpha FROM (SELECT ids, x FROM g, y ORDER BY it DESC LIMIT 1)"""
).replace("WITH s AS", "WITH RECURSIVE s AS", 1)


@_query(_CG)
def sparse_solve(spark: SparkSession, d: str) -> DataFrame:
    """(K + V) a = y - mean over all parts, by strips or, where those are wide, by cells."""
    gp = compact_model(_parts(spark, d), [1.5, *BALL], NOISE, weights_only=True)
    return gp.weights().select("i", _r(F.col("alpha"), 4).alias("alpha"))


@_query(_CG)
def cell_solve(spark: SparkSession, d: str) -> DataFrame:
    """The same system by block conjugate gradients over cells, with overlapping local solves as preconditioner."""
    gp = CellGaussianProcess(_parts(spark, d), [1.5, *BALL], NOISE)
    return gp.weights().select("i", _r(F.col("alpha"), 4).alias("alpha"))


@_query(_CG.replace("1.5 * (1 - d) ** 8", "1.53 * (1 - d) ** 8").replace("AS alpha FROM", "AS alpha, TRUE AS warm, TRUE AS fewer FROM"))
def warm_solve(spark: SparkSession, d: str) -> DataFrame:
    """The system with a little more variance, started from the solution of the one before: whether the drift allowed that, and
    whether it took fewer iterations than a cold start."""
    places = Places(_parts(spark, d), NOISE)
    cells, mean = Cells(places.table, [1.5, *BALL]), places.mean
    solver = WarmSolver(cells, cells.column("y", mean))
    solver.solve()
    before = solver.precondition
    solved, warm = solver.solve([1.53, *BALL])
    cold = cells.solve(cells.column("y", mean), before, tol=solver.tol, hyper=[1.53, *BALL])[1]
    return places.weights(cells.entries(solved, "alpha")).select("i", _r(F.col("alpha"), 4).alias("alpha"), F.lit(solver.last["served"] == 2).alias("warm"), F.lit(warm < cold).alias("fewer"))


@_query(_CG.replace("SELECT unnest(ids) AS i, round(unnest(x), 4) + 0.0::DOUBLE AS alpha FROM (SELECT ids, x FROM g, y ORDER BY it DESC LIMIT 1)",
                    "SELECT kind, round(list_sum(list_transform(x, lambda c: abs(c))), 2) AS size, kind <> 'jacobi' AS fewer FROM (SELECT x FROM g ORDER BY it DESC LIMIT 1), (VALUES ('jacobi'), ('schwarz'), ('inverse')) v(kind)"))
def cell_preconditioners(spark: SparkSession, d: str) -> DataFrame:
    """The size of the solution with each preconditioner, and whether it took fewer iterations than solving cells by themselves."""
    places = Places(_parts(spark, d), NOISE)
    cells, mean = Cells(places.table, [1.5, *BALL]), places.mean
    rows, right = [], cells.column("y", mean)
    for kind, p in (("jacobi", cells.jacobi()), ("schwarz", cells.schwarz(0.5)), ("inverse", cells.inverse(24))):
        solved, steps = cells.solve(right, p, tol=1e-9)
        rows.append((kind, float(places.weights(cells.entries(solved, "alpha")).agg(F.sum(F.abs("alpha"))).first()[0] or 0.0), steps))
    return spark.createDataFrame([(k, size, steps < rows[0][2]) for k, size, steps in rows], "kind string, size double, fewer boolean").select("kind", _r(F.col("size"), 2).alias("size"), "fewer")


# --- prior, sources, tasks


@_query("SELECT round(avg(s_acctbal / 1000), 6) AS mean, round((avg(abs(s_acctbal / 1000)) / 100) ** 2, 8) AS noise, round(var_pop(s_acctbal / 1000) / 100, 6) AS low, round(var_pop(s_acctbal / 1000) * 10, 6) AS high FROM supplier")
def prior_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Default prior mean, noise variance and bounds of the signal variance."""
    y = F.col("y")
    return _suppliers(spark, d).agg(_r(F.avg(y)).alias("mean"), _r(F.pow(F.avg(F.abs(y)) / 100, F.lit(2)), 8).alias("noise"), _r(F.var_pop(y) / 100).alias("low"), _r(F.var_pop(y) * 10).alias("high"))


@_query("SELECT doc_id AS pt_id, 0::INT AS task, quality::DOUBLE AS y FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 1, toxic::DOUBLE FROM labels WHERE toxic IS NOT NULL")
def multi_task_points(spark: SparkSession, d: str) -> DataFrame:
    return P.unpivot_tasks(_table(spark, d, "labels"), "doc_id", [F.col("doc_id")], [F.col("quality"), F.col("toxic")]).select("pt_id", "task", "y")


@_query("WITH n AS (SELECT n_nationkey, n_regionkey, count(*) OVER () AS c FROM nation) SELECT (n_nationkey + t * c)::BIGINT AS flat_id, n_nationkey::BIGINT AS pred_id, t::INT AS task FROM n, (VALUES (0), (1), (2)) v(t)")
def task_grid(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d).withColumnRenamed("pt_id", "pred_id")
    return P.task_grid(n, n.count(), [0, 1, 2]).select(F.col("flat_id").cast("long").alias("flat_id"), "pred_id", "task")


@_query("SELECT i AS pred_id, round(lo + i * ((hi - lo) / 99), 6) AS a FROM (SELECT min(o_totalprice / 1000) AS lo, max(o_totalprice / 1000) AS hi FROM orders), range(100) x(i)")
def prediction_line(spark: SparkSession, d: str) -> DataFrame:
    """A line over the range of all orders' prices."""
    low, high = _table(spark, d, "orders").agg(F.min(F.col("o_totalprice") / 1000), F.max(F.col("o_totalprice") / 1000)).first()
    return P.line_grid(spark, low, high, 100).select("pred_id", _r(F.get("x", 0)).alias("a"))


@_query("SELECT i * 25 + j AS pred_id, round(l0 + i * ((h0 - l0) / 39), 6) + 0.0::DOUBLE AS a, round(l1 + j * ((h1 - l1) / 24), 6) + 0.0::DOUBLE AS b FROM (SELECT min(l_quantity) AS l0, max(l_quantity) AS h0, min(l_discount) AS l1, max(l_discount) AS h1 FROM lineitem), range(40) x(i), range(25) y(j)")
def prediction_grid(spark: SparkSession, d: str) -> DataFrame:
    """A grid over the ranges of all line items' quantities and discounts."""
    got = _table(spark, d, "lineitem").agg(*[f(c) for c in ("l_quantity", "l_discount") for f in (F.min, F.max)]).first()
    return P.plane_grid(spark, [got[0], got[2]], [got[1], got[3]], 40, 25).select("pred_id", _r(F.get("x", 0)).alias("a"), _r(F.get("x", 1)).alias("b"))


# --- likelihood and posterior: one elimination of [[K + V, B], [B', D]] in SQL

def _elimination(points: str, asked: str | None, kernel: str, mean: str = "avg(y)") -> str:
    """SQL that eliminates the points (id, x1, x2, x3, y, noise, g): z.m is then the complement of the targets (row 1) and of the
    points asked for (id, x1, x2, x3, g), or of the unit vectors, which gives the inverse, where none are asked."""
    more = "SELECT n + 1 + row_number() OVER (ORDER BY id), x1, x2, x3, 0, 2, id, 0, g FROM ask, mu" if asked else "SELECT n + 1 + row_number() OVER (ORDER BY id), 0, 0, 0, 0, 3, id, 0, g FROM pts, mu"
    return f"""WITH RECURSIVE pts AS ({points}), ask AS ({asked or "SELECT 1"}), mu AS (SELECT ({mean})::DOUBLE AS m, count(*) AS n FROM pts),
u AS (SELECT row_number() OVER (ORDER BY id) AS r, x1, x2, x3, y - m AS y, 0 AS kind, id, noise, g FROM pts, mu UNION ALL SELECT n + 1, 0, 0, 0, 0, 1, 0, 0, 0 FROM mu UNION ALL {more}),
e AS (SELECT a.r AS i, b.r AS j, CASE WHEN a.kind = 1 AND b.kind = 1 THEN 0 WHEN a.kind = 1 THEN b.y WHEN b.kind = 1 THEN a.y
    WHEN a.kind = 3 OR b.kind = 3 THEN CASE WHEN a.kind <> b.kind AND a.id = b.id THEN 1 ELSE 0 END
    ELSE {kernel} + CASE WHEN a.kind = 0 AND a.r = b.r THEN a.noise ELSE 0 END END AS v FROM u a, u b),
f AS (SELECT i, list(v::DOUBLE ORDER BY j) AS row FROM e GROUP BY i),
g AS (SELECT 0::BIGINT AS it, 0.0::DOUBLE AS ld, list(row ORDER BY i) AS m FROM f
  UNION ALL SELECT it + 1, ld + ln(m[1][1]), list_transform(m[2:], lambda row: list_transform(range(2, len(row) + 1), lambda c: row[c] - row[1] * m[1][c] / m[1][1])) FROM g WHERE it < (SELECT n FROM mu)),
z AS (SELECT ld, m FROM g WHERE it = (SELECT n FROM mu))
"""


_SUPPLIER_SQL = "SELECT s_suppkey AS id, s_nationkey / 5.0::DOUBLE AS x1, (s_suppkey % 10) / 3.0::DOUBLE AS x2, 0 AS x3, s_acctbal / 1000 AS y, 0.25 AS noise, 0 AS g FROM supplier"
_NATION_SQL = "SELECT n_nationkey AS id, n_nationkey / 5.0::DOUBLE AS x1, n_regionkey::DOUBLE AS x2, 0 AS x3, 0 AS g FROM nation"
_MATERN_SQL = "2 * (1 + sqrt(3) * {0}) * exp(-sqrt(3) * {0})"
_GAP_SQL = "sqrt(((a.x1 - b.x1) / 1.5) ** 2 + (a.x2 - b.x2) ** 2)"
_ELIMINATE = _elimination(_SUPPLIER_SQL, _NATION_SQL, _MATERN_SQL.format(_GAP_SQL))
def _inverse_of(points: str, kernel: str, mean: str = "avg(y)") -> str:
    """SQL up to inv, one row: the weights al, the inverse q, the coordinates and the mean of a model over the points."""
    return _elimination(points, None, kernel, mean) + """, l AS (SELECT list(x1::DOUBLE ORDER BY r) AS x1, list(x2::DOUBLE ORDER BY r) AS x2 FROM u WHERE kind = 0),
inv AS (SELECT list_transform(z.m[1][2:], lambda c: -c) AS al, list_transform(z.m[2:], lambda row: list_transform(row[2:], lambda c: -c)) AS q, l.x1, l.x2, mu.m AS mean FROM z, l, mu)
"""


_INVERSE = _inverse_of(_SUPPLIER_SQL, _MATERN_SQL.format(_GAP_SQL))
_GAPS_SQL = "list_transform(range(1, len(inv.x1) + 1), lambda p: sqrt(((inv.x1[p] - o.x1) / 1.5) ** 2 + (inv.x2[p] - o.x2) ** 2))"


def _model(spark: SparkSession, d: str) -> GaussianProcess:
    return GaussianProcess(_suppliers(spark, d), HYPER)


def _any_model(spark: SparkSession, d: str):
    """On the driver while the suppliers are few, else in tiles."""
    return exact_model(_suppliers(spark, d), HYPER)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return gp_posterior(spark, d)


@_query(_ELIMINATE + "SELECT id::BIGINT AS pred_id, round(mu.m - z.m[1][r - n], 5) AS m, round(z.m[r - n][r - n], 5) AS v FROM u, mu, z WHERE kind = 2")
def gp_posterior(spark: SparkSession, d: str) -> DataFrame:
    """Posterior mean and variance at every nation of a GP over all suppliers."""
    got = _any_model(spark, d).predict(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"))
    return got.select("pred_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


@_query(_ELIMINATE + "SELECT round(-0.5 * (-z.m[1][1] + ld + n * ln(2 * pi())), 4) AS log_likelihood, round(ld, 4) AS logdet, round(-z.m[1][1], 4) AS quadratic FROM z, mu")
def gp_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    gp = _any_model(spark, d)
    row = (gp.log_likelihood(), gp.logdet, gp.quadratic)
    return spark.createDataFrame([row], "log_likelihood double, logdet double, quadratic double").select(*[_r(F.col(c), 4).alias(c) for c in ("log_likelihood", "logdet", "quadratic")])


@_query(_ELIMINATE + "SELECT a.id::BIGINT AS i, b.id::BIGINT AS j, round(z.m[a.r - n][b.r - n], 5) + 0.0::DOUBLE AS s FROM u a, u b, mu, z WHERE a.kind = 2 AND b.kind = 2 AND a.id <= b.id")
def gp_posterior_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Posterior covariance of all pairs of nations."""
    ask = _nations(spark, d).orderBy("pt_id").collect()  # 25 prediction points
    s = _model(spark, d).posterior(np.array([r["x"] for r in ask]))[1]
    rows = [(a["pt_id"], b["pt_id"], float(s[i, j])) for i, a in enumerate(ask) for j, b in enumerate(ask) if a["pt_id"] <= b["pt_id"]]
    return spark.createDataFrame(rows, "i long, j long, s double").select("i", "j", _r(F.col("s"), 5).alias("s"))


_TASK_SQL = "SELECT s_suppkey * 2 + t AS id, s_nationkey / 5.0::DOUBLE AS x1, (s_suppkey % 10) / 3.0::DOUBLE AS x2, t AS x3, CASE t WHEN 0 THEN s_acctbal / 1000 ELSE abs(s_acctbal) / 1000 END AS y, 0.25 AS noise, 0 AS g FROM supplier, (VALUES (0), (1)) v(t)"


_MULTI_TASK = (
    _elimination(_TASK_SQL, "SELECT n_nationkey + t * (SELECT count(*) FROM nation) AS id, n_nationkey / 5.0::DOUBLE AS x1, n_regionkey::DOUBLE AS x2, t AS x3, 0 AS g FROM nation, (VALUES (0), (1)) v(t)",
                 _MATERN_SQL.format("sqrt(((a.x1 - b.x1) / 1.5) ** 2 + (a.x2 - b.x2) ** 2 + ((a.x3 - b.x3) / 0.8) ** 2)"))
    + "SELECT id::BIGINT AS flat_id, round(mu.m - z.m[1][r - n], 5) AS m, round(z.m[r - n][r - n], 5) AS v FROM u, mu, z WHERE kind = 2"
)


@_query(_MULTI_TASK)
def gp_multi_task(spark: SparkSession, d: str) -> DataFrame:
    """Two outputs of every supplier as one model: the task is a further coordinate."""
    return _at_nations(spark, d, exact_model(_task_points(spark, d), [*HYPER, 0.8]))


@_query(_MULTI_TASK)
def multi_task_appended(spark: SparkSession, d: str) -> DataFrame:
    """The same model in tiles from the first half of the suppliers, to which the other half's outputs are appended as block rows."""
    pts = _task_points(spark, d)
    half = pts.agg(F.max("pt_id")).first()[0] // 2
    old = Places(pts.where(F.col("pt_id") <= half))
    gp = TiledGaussianProcess(old, [*HYPER, 0.8], size=max(8, old.count // 2))
    gp.append(pts.where(F.col("pt_id") > half))
    return _at_nations(spark, d, gp)


def _task_points(spark: SparkSession, d: str) -> DataFrame:
    s = _table(spark, d, "supplier")
    long = P.unpivot_tasks(s, "s_suppkey", [F.col("s_nationkey") / 5.0, (F.col("s_suppkey") % 10) / 3.0], [F.col("s_acctbal") / 1000.0, F.abs(F.col("s_acctbal")) / 1000.0])
    return long.select((F.col("pt_id") * 2 + F.col("task")).alias("pt_id"), "x", "y").withColumn("noise_var", F.lit(NOISE))


def _at_nations(spark: SparkSession, d: str, model) -> DataFrame:
    n = _nations(spark, d).withColumnRenamed("pt_id", "pred_id")
    got = model.predict(P.task_grid(n, n.count(), [0, 1]).select("flat_id", "x"), "flat_id")
    return got.select("flat_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


@_query(
    _INVERSE + f""", o AS ({_NATION_SQL}), d AS (SELECT o.id, o.x1, o.x2, {_GAPS_SQL} AS d FROM o, inv),
k AS (SELECT d.*, list_transform(d, lambda c: {_MATERN_SQL.format("c")}) AS k FROM d),
s AS (SELECT k.id, t AS direction, k, list_transform(k.d, lambda c, p: 6 * exp(-sqrt(3) * c) * CASE t WHEN 0 THEN (inv.x1[p] - k.x1) / 2.25 ELSE inv.x2[p] - k.x2 END) AS dk FROM k, inv, (VALUES (0), (1)) v(t))
SELECT id::BIGINT AS pred_id, direction, round(list_inner_product(inv.al, dk), 4) + 0.0::DOUBLE AS dm, round(-2 * list_inner_product(dk, list_transform(inv.q, lambda row: list_inner_product(row, k))), 4) + 0.0::DOUBLE AS dv FROM s, inv"""
)
def gp_posterior_gradient(spark: SparkSession, d: str) -> DataFrame:
    got = _model(spark, d).predict_slopes(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"))
    return got.select("pred_id", "direction", _r(F.col("dm"), 4).alias("dm"), _r(F.col("dv"), 4).alias("dv"))


@_query(
    f"""WITH a AS ({_SUPPLIER_SQL}), b AS ({_NATION_SQL}) SELECT a.id::BIGINT AS i, b.id::BIGINT AS j, t AS direction,
round(6 * exp(-sqrt(3) * {_GAP_SQL}) * CASE t WHEN 0 THEN (a.x1 - b.x1) / 2.25 ELSE a.x2 - b.x2 END, 6) + 0.0::DOUBLE AS dv FROM a, b, (VALUES (0), (1)) v(t) WHERE CASE t WHEN 0 THEN a.x1 - b.x1 ELSE a.x2 - b.x2 END <> 0"""
)
def joint_prior_slopes(spark: SparkSession, d: str) -> DataFrame:
    """What of the joint prior of suppliers and nations changes as the nations move: covariances of the two, along each coordinate."""
    got = C.cross_slopes(_suppliers(spark, d), _nations(spark, d), lambda a, b: K.default_kernel_along(a, b, HYPER), 2)
    return got.select("i", "j", "direction", _r(F.col("dv")).alias("dv"))


@_query(
    _INVERSE + f""", o AS ({_NATION_SQL}), d AS (SELECT o.id, o.x1, o.x2, {_GAPS_SQL} AS d FROM o, inv),
k AS (SELECT d.*, list_transform(d, lambda c: {_MATERN_SQL.format("c")}) AS k FROM d),
s AS (SELECT k.id, t AS direction, k, list_transform(k.d, lambda c, p: 6 * exp(-sqrt(3) * c) * CASE t WHEN 0 THEN (inv.x1[p] - k.x1) / 2.25 ELSE inv.x2[p] - k.x2 END) AS dk FROM k, inv, (VALUES (0), (1)) v(t)),
w AS (SELECT id, direction, k, dk, list_transform(inv.q, lambda row: list_inner_product(row, k)) AS w FROM s, inv)
SELECT id::BIGINT AS pred_id, direction, round(-1 * list_inner_product(dk, w) / (2 - list_inner_product(k, w)), 4) + 0.0::DOUBLE AS slope FROM w"""
)
def entropy_slopes(spark: SparkSession, d: str) -> DataFrame:
    """How the entropy of the suppliers' targets and the function at a nation changes as the nation moves along each coordinate."""
    gp, ask = _model(spark, d), _nations(spark, d).withColumnRenamed("pt_id", "pred_id")
    return gp.predict_entropy_slopes(ask).select("pred_id", "direction", _r(F.col("slope"), 4).alias("slope"))


@_query(
    _INVERSE + """, p AS (SELECT i, j, inv.al[i] * inv.al[j] - inv.q[i][j] AS w, (inv.x1[i] - inv.x1[j]) ** 2 AS g1, (inv.x2[i] - inv.x2[j]) ** 2 AS g2 FROM inv, range(1, (SELECT n FROM mu) + 1) a(i), range(1, (SELECT n FROM mu) + 1) b(j)),
d AS (SELECT *, sqrt(g1 / 2.25 + g2) AS d FROM p), s AS (SELECT sum(w * (1 + sqrt(3) * d) * exp(-sqrt(3) * d)) / 2 AS s0, sum(w * 6 * exp(-sqrt(3) * d) * g1 / 3.375) / 2 AS s1, sum(w * 6 * exp(-sqrt(3) * d) * g2) / 2 AS s2 FROM d)
SELECT k AS parameter, round(CASE k WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END, 3) + 0.0::DOUBLE AS slope FROM s, (VALUES (0), (1), (2)) v(k)"""
)
def gp_likelihood_gradient(spark: SparkSession, d: str) -> DataFrame:
    g = _model(spark, d).likelihood_gradient()
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(g)], "parameter int, slope double").select("parameter", _r(F.col("slope"), 3).alias("slope"))


_POSTERIOR = ", p AS (SELECT id::BIGINT AS pred_id, mu.m - z.m[1][r - n] AS m, z.m[r - n][r - n] AS v, mu.m AS prior FROM u, mu, z WHERE kind = 2) "


@_query(_ELIMINATE + _POSTERIOR + "SELECT pred_id, round(0.5 * (2 / v - 1 + (m - prior) ** 2 / v + ln(v / 2)), 4) + 0.0::DOUBLE AS kl FROM p")
def gp_information_per_point(spark: SparkSession, d: str) -> DataFrame:
    """What the data tell about each nation by itself: divergence of the prior there from the posterior."""
    gp = _model(spark, d)
    got = gp.predict(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"))
    return got.select("pred_id", _r(kl_normal(F.lit(float(gp.mean)), F.lit(HYPER[0]), F.col("m"), F.col("v")), 4).alias("kl"))


@_query(_ELIMINATE + _POSTERIOR + "SELECT pred_id, round((m + 5 * v) / (v + 1), 5) AS m, round(v / (v + 1), 5) AS v, round(exp(-0.5 * (m - 5) ** 2 / (v + 1)) / sqrt(2 * pi() * (v + 1)), 6) AS agreement FROM p")
def gp_posterior_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Product of each nation's posterior and a normal of mean 5 and variance 1, and the density of their agreement."""
    got = _any_model(spark, d).predict(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"))
    m, v, both = F.col("m"), F.col("v"), F.col("v") + 1
    return got.select("pred_id", _r((m + 5 * v) / both, 5).alias("m"), _r(v / both, 5).alias("v"), _r(K.normal_density(m, F.lit(5.0), both)).alias("agreement"))


@_query(_ELIMINATE + _POSTERIOR + "SELECT pred_id, round(m, 5) + 0.0::DOUBLE AS m, round(v + 0.25, 5) AS v FROM p")
def gp_posterior_noisy(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of measurements: the posterior with the noise of the data."""
    got = _model(spark, d).predict(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"), add_noise=True)
    return got.select("pred_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


def _trend(x: np.ndarray) -> np.ndarray:
    return 1.0 + 0.5 * x[:, 0]


def _uneven(x: np.ndarray) -> np.ndarray:
    return 0.1 + 0.05 * x[:, 1]


@_query(
    _elimination(
        "SELECT s_suppkey AS id, s_nationkey / 5.0::DOUBLE AS x1, (s_suppkey % 10) / 3.0::DOUBLE AS x2, 0 AS x3, s_acctbal / 1000 - (1 + 0.5 * (s_nationkey / 5.0::DOUBLE)) AS y, 0.1 + 0.05 * ((s_suppkey % 10) / 3.0::DOUBLE) AS noise, 0 AS g FROM supplier",
        _NATION_SQL, _MATERN_SQL.format(_GAP_SQL), "0")
    + "SELECT id::BIGINT AS pred_id, round(1 + 0.5 * x1 - z.m[1][r - n], 5) + 0.0::DOUBLE AS m, round(z.m[r - n][r - n], 5) AS v FROM u, mu, z WHERE kind = 2"
)
def gp_posterior_trend(spark: SparkSession, d: str) -> DataFrame:
    """A model whose prior mean and noise are functions of the point."""
    gp = GaussianProcess(_suppliers(spark, d).drop("noise_var"), HYPER, mean=_trend, noise=_uneven)
    got = gp.predict(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"))
    return got.select("pred_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


@_query(
    _elimination("SELECT n_nationkey AS id, 0 AS x1, 0 AS x2, 0 AS x3, n_regionkey::DOUBLE AS y, 0.5 AS noise, n_name AS g FROM nation", "SELECT r_regionkey AS id, 0 AS x1, 0 AS x2, 0 AS x3, r_name AS g FROM region", "2 * exp(-levenshtein(a.g, b.g) / 4.0)")
    + "SELECT id::BIGINT AS pred_id, round(mu.m - z.m[1][r - n], 5) + 0.0::DOUBLE AS m, round(z.m[r - n][r - n], 5) AS v FROM u, mu, z WHERE kind = 2"
)
def gp_strings(spark: SparkSession, d: str) -> DataFrame:
    """A model over names: nations by the edit distance of their names, asked at the names of the regions."""
    pts = _table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pt_id"), F.col("n_name").alias("obj"), F.col("n_regionkey").cast("double").alias("y"), F.lit(0.5).alias("noise_var"))
    ask = _table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("pred_id"), F.col("r_name").alias("obj"))
    got = object_posterior(pts, ask, lambda a, b: 2.0 * F.exp(-F.levenshtein(a, b) / 4.0))
    return got.select("pred_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


@_query()
def gp_information(spark: SparkSession, d: str) -> DataFrame:
    """Entropy, mutual information, total correlation and relative information entropy at the nations."""
    gp = _model(spark, d)
    q = np.array([r["x"] for r in _nations(spark, d).orderBy("pt_id").collect()])
    own = gp.posterior(q)
    row = (gp.entropy(q), gp.mutual_information(q), gp.total_correlation(q), gp.relative_information_entropy(q), gp.divergence_from(q, own[0], own[1] + 0.1 * np.eye(len(q))))
    names = ("entropy", "mutual_information", "total_correlation", "relative_entropy", "kl")
    return spark.createDataFrame([tuple(map(float, row))], ", ".join(f"{n} double" for n in names)).select(*[_r(F.col(n), 3).alias(n) for n in names])


@_query(
    _INVERSE + f""", o AS (SELECT event_id AS id, (user_id % 25) / 5.0::DOUBLE AS x1, least(abs(value), 300.0) / 100.0::DOUBLE AS x2 FROM events), d AS (SELECT o.id, {_GAPS_SQL} AS d FROM o, inv),
k AS (SELECT id, list_transform(d, lambda c: {_MATERN_SQL.format("c")}) AS k FROM d)
SELECT id AS pred_id, round(mean + list_inner_product(k, al), 5) + 0.0::DOUBLE AS m, round(greatest(0, 2 - list_inner_product(k, list_transform(q, lambda row: list_inner_product(row, k)))), 5) AS v FROM k, inv"""
)
def gp_events_scored(spark: SparkSession, d: str) -> DataFrame:
    """A model over the suppliers scores every event: prediction as a job over a large table."""
    ask = _table(spark, d, "events").select(F.col("event_id").alias("pred_id"), F.array((F.col("user_id") % 25) / 5.0, F.least(F.abs("value"), F.lit(300.0)) / 100.0).alias("x"))
    return _any_model(spark, d).predict(ask).select("pred_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


@_query(
    _elimination(
        """SELECT s_suppkey AS id, (s_suppkey % 100) / 20.0::DOUBLE AS x1, 0 AS x2, 0 AS x3, s_acctbal / 1000.0 - avg(s_acctbal / 1000.0) OVER (PARTITION BY s_nationkey) AS y,
        greatest((avg(abs(s_acctbal / 1000.0)) OVER (PARTITION BY s_nationkey) / 100) ** 2, 1e-9) AS noise, s_nationkey AS g FROM supplier""",
        "SELECT n_nationkey * 5 + k AS id, k::DOUBLE AS x1, 0 AS x2, 0 AS x3, n_nationkey AS g FROM nation, range(5) v(k)",
        "CASE WHEN a.g = b.g THEN (1 + sqrt(3) * abs(a.x1 - b.x1)) * exp(-sqrt(3) * abs(a.x1 - b.x1)) ELSE 0 END", "0")
    + """, c AS (SELECT s_nationkey AS g, avg(s_acctbal / 1000.0) AS mean FROM supplier GROUP BY 1)
SELECT u.g::INT AS nation, (u.id % 5)::BIGINT AS pred_id, round(coalesce(c.mean, 0) - z.m[1][r - n], 5) + 0.0::DOUBLE AS m, round(greatest(0, z.m[r - n][r - n]), 5) AS v FROM u JOIN mu ON true JOIN z ON true LEFT JOIN c ON c.g = u.g WHERE kind = 2"""
)
def gp_per_nation(spark: SparkSession, d: str) -> DataFrame:
    """One GP per nation over its suppliers, all at once."""
    s = _table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.array((F.col("s_suppkey") % 100) / 20.0).alias("x"), (F.col("s_acctbal") / 1000.0).alias("y"))
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("k"))
    return grouped_posterior(s, "nation", n.select("nation", F.col("k").cast("long").alias("pred_id"), F.array(F.col("k").cast("double")).alias("x")), [1.0, 1.0]).select("nation", "pred_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


_WENDLAND_GAP = "least(1, sqrt(((a.x1 - b.x1) / 0.9) ** 2 + ((a.x2 - b.x2) / 1.1) ** 2))"
_SPARSE = _elimination(_SUPPLIER_SQL, _NATION_SQL, "2 * (1 - {0}) ** 8 * (32 * {0} ** 3 + 25 * {0} ** 2 + 8 * {0} + 1)".format(_WENDLAND_GAP))
SPARSE_HYPER = [2.0, 0.9, 1.1]


@_query(_SPARSE + "SELECT id::BIGINT AS pred_id, round(mu.m - z.m[1][r - n], 5) + 0.0::DOUBLE AS m, round(z.m[r - n][r - n], 5) AS v FROM u, mu, z WHERE kind = 2")
def sparse_posterior(spark: SparkSession, d: str) -> DataFrame:
    """Posterior mean and variance at every nation of a compactly supported GP over all suppliers, by strips."""
    got = compact_model(_suppliers(spark, d), SPARSE_HYPER, aim=8).predict(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"))
    return got.select("pred_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


@_query(_SPARSE + "SELECT round(-0.5 * (-z.m[1][1] + ld + n * ln(2 * pi())), 4) AS log_likelihood, round(ld, 4) AS logdet, round(-z.m[1][1], 4) AS quadratic FROM z, mu")
def sparse_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Exact likelihood of the same model, by strips."""
    gp = StripGaussianProcess(_suppliers(spark, d), SPARSE_HYPER, aim=8, predicts=False)
    row = (gp.log_likelihood(), gp.logdet, gp.quadratic)
    return spark.createDataFrame([row], "log_likelihood double, logdet double, quadratic double").select(*[_r(F.col(c), 4).alias(c) for c in ("log_likelihood", "logdet", "quadratic")])


@_query(_SPARSE + "SELECT id::BIGINT AS pred_id, round(mu.m - z.m[1][r - n], 5) + 0.0::DOUBLE AS m, round(z.m[r - n][r - n], 5) AS v FROM u, mu, z WHERE kind = 2")
def cell_posterior(spark: SparkSession, d: str) -> DataFrame:
    """The same posterior over cells, which no crowded slab limits: all nations are right sides of one solve."""
    got = CellGaussianProcess(_suppliers(spark, d), SPARSE_HYPER, aim=16).predict(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"))
    return got.select("pred_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


@_query(_SPARSE + "SELECT a.id::BIGINT AS i, b.id::BIGINT AS j, round(z.m[a.r - n][b.r - n], 5) + 0.0::DOUBLE AS s FROM u a, u b, mu, z WHERE a.kind = 2 AND b.kind = 2 AND a.id <= b.id")
def cell_posterior_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Posterior covariance of all pairs of nations over cells: no supplier comes to the driver."""
    got = CellGaussianProcess(_suppliers(spark, d), SPARSE_HYPER, aim=16).posterior(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"))[0]
    return got.where("i <= j").select("i", "j", _r(F.col("s"), 5).alias("s"))


@_query(
    _inverse_of(_SUPPLIER_SQL, "2 * (1 - {0}) ** 8 * (32 * {0} ** 3 + 25 * {0} ** 2 + 8 * {0} + 1)".format(_WENDLAND_GAP)) + f""", o AS ({_NATION_SQL}),
d AS (SELECT o.id, o.x1, o.x2, list_transform(range(1, len(inv.x1) + 1), lambda p: least(1, sqrt(((inv.x1[p] - o.x1) / 0.9) ** 2 + ((inv.x2[p] - o.x2) / 1.1) ** 2))) AS d FROM o, inv),
k AS (SELECT d.*, list_transform(d, lambda c: 2 * (1 - c) ** 8 * (32 * c ** 3 + 25 * c * c + 8 * c + 1)) AS k FROM d),
w AS (SELECT k.id, list_transform(inv.q, lambda row: list_inner_product(row, k)) AS w FROM k, inv),
h AS (SELECT k.id, t AS direction, list_transform(k.d, lambda c, p: -44 * (1 - c) ** 7 * (16 * c * c + 7 * c + 1) * CASE t WHEN 0 THEN (k.x1 - inv.x1[p]) / 0.81 ELSE (k.x2 - inv.x2[p]) / 1.21 END) AS dk FROM k, inv, (VALUES (0), (1)) v(t))
SELECT h.id::BIGINT AS i, w.id::BIGINT AS j, direction, round(-2 * list_inner_product(dk, w), 4) + 0.0::DOUBLE AS ds, CASE WHEN h.id = w.id THEN round(list_inner_product(dk, inv.al), 4) + 0.0::DOUBLE END AS dm FROM h, w, inv"""
)
def cell_posterior_slopes(spark: SparkSession, d: str) -> DataFrame:
    """Slopes of that covariance, and of the mean, along each coordinate of the nations."""
    got = CellGaussianProcess(_suppliers(spark, d), SPARSE_HYPER, aim=16).posterior(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"))[1]
    return got.select("i", "j", "direction", _r(F.col("ds"), 4).alias("ds"), _r(F.col("dm"), 4).alias("dm"))


@_query(_SPARSE + "SELECT round(ld, 4) AS logdet, round(-z.m[1][1], 4) AS quadratic, TRUE AS within FROM z")
def likelihood_estimate(spark: SparkSession, d: str) -> DataFrame:
    """The likelihood by random probes over cells beside the exact one by strips: within four deviations of the estimate, that is
    a hundredth of the log-determinant at least."""
    places = Places(_suppliers(spark, d))
    exact = StripGaussianProcess(places, SPARSE_HYPER, aim=8, predicts=False)
    gp = CellGaussianProcess(places, SPARSE_HYPER)
    gp.log_likelihood(32, 20)
    within = abs(gp.logdet - exact.logdet) <= max(4 * gp.logdet_variance**0.5, 0.01 * abs(exact.logdet))
    return spark.createDataFrame([(exact.logdet, gp.quadratic, bool(within))], "logdet double, quadratic double, within boolean").select(_r(F.col("logdet"), 4).alias("logdet"), _r(F.col("quadratic"), 4).alias("quadratic"), "within")


_WENDLAND_SQL = "2 * (1 - {0}) ** 8 * (32 * {0} ** 3 + 25 * {0} ** 2 + 8 * {0} + 1)".format(_WENDLAND_GAP)
#: Half of a'dK a - tr(K^-1 dK) by the variance and the lengths of the Wendland kernel, from inv.
_WENDLAND_SLOPES = """, p AS (SELECT inv.al[i] * inv.al[j] - inv.q[i][j] AS w, (inv.x1[i] - inv.x1[j]) ** 2 AS g1, (inv.x2[i] - inv.x2[j]) ** 2 AS g2 FROM inv, range(1, (SELECT n FROM mu) + 1) a(i), range(1, (SELECT n FROM mu) + 1) b(j)),
d AS (SELECT *, least(1, sqrt(g1 / 0.81 + g2 / 1.21)) AS d FROM p),
s AS (SELECT sum(w * (1 - d) ** 8 * (32 * d ** 3 + 25 * d * d + 8 * d + 1)) / 2 AS s0, sum(w * 44 * (1 - d) ** 7 * (16 * d * d + 7 * d + 1) * g1 / 0.729) / 2 AS s1, sum(w * 44 * (1 - d) ** 7 * (16 * d * d + 7 * d + 1) * g2 / 1.331) / 2 AS s2 FROM d)
"""


@_query(_inverse_of(_SUPPLIER_SQL, _WENDLAND_SQL) + _WENDLAND_SLOPES + "SELECT k AS parameter, round(CASE k WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END, 3) + 0.0::DOUBLE AS slope FROM s, (VALUES (0), (1), (2)) v(k)")
def sparse_likelihood_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Slopes of the exact likelihood of strips by its hyperparameters."""
    g = StripGaussianProcess(_suppliers(spark, d), SPARSE_HYPER, aim=8, predicts=False).likelihood_gradient()
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(g)], "parameter int, slope double").select("parameter", _r(F.col("slope"), 3).alias("slope"))


# --- coordinates moved by a network before the kernel sees them

_NET = Network(2, 3)
_NET_PARAMETERS = np.round(np.cos(1.7 * np.arange(_NET.size)), 3).tolist()
_LAYERS = _NET.split(_NET_PARAMETERS)


def _warp_sql(points: str) -> str:
    """SQL of points whose x1, x2 are moved by the network; p1, p2 and the hidden units a1.., b1.. stay beside them."""
    out, names = f"SELECT * REPLACE (0 AS x3), x1 AS p1, x2 AS p2 FROM ({points})", ["p1", "p2"]
    for (w, b), letter in zip(_LAYERS[:2], "ab", strict=True):
        units = [f"greatest(0, {float(c)!r}::DOUBLE + {' + '.join(f'{n} * {float(v)!r}::DOUBLE' for n, v in zip(names, row, strict=True))}) AS {letter}{k + 1}" for k, (row, c) in enumerate(zip(w, b, strict=True))]
        out, names = f"SELECT *, {', '.join(units)} FROM ({out})", [f"{letter}{k + 1}" for k in range(len(w))]
    (w, b) = _LAYERS[2]
    last = [f"{float(c)!r}::DOUBLE + {' + '.join(f'{n} * {float(v)!r}::DOUBLE' for n, v in zip(names, row, strict=True))} AS x{k + 1}" for k, (row, c) in enumerate(zip(w, b, strict=True))]
    return f"SELECT * REPLACE ({', '.join(last)}) FROM ({out})"


@_query(f"SELECT id::BIGINT AS pt_id, round(x1, 6) + 0.0::DOUBLE AS x1, round(x2, 6) + 0.0::DOUBLE AS x2 FROM ({_warp_sql(_SUPPLIER_SQL)})")
def warped_points(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers where a network of three layers puts them."""
    got = _suppliers(spark, d).select("pt_id", _NET.column(F.col("x"), _NET_PARAMETERS).alias("x"))
    return got.select("pt_id", *[_r(F.get("x", k)).alias(f"x{k + 1}") for k in range(2)])


@_query(_elimination(_warp_sql(_SUPPLIER_SQL), _warp_sql(_NATION_SQL), _WENDLAND_SQL) + "SELECT id::BIGINT AS pred_id, round(mu.m - z.m[1][r - n], 5) + 0.0::DOUBLE AS m, round(z.m[r - n][r - n], 5) AS v FROM u, mu, z WHERE kind = 2")
def warped_posterior(spark: SparkSession, d: str) -> DataFrame:
    """Posterior at every nation of a compactly supported GP over the moved suppliers, by strips."""
    got = WarpedProcess(_suppliers(spark, d), _NET, _NET_PARAMETERS, SPARSE_HYPER, aim=8).predict(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"))
    return got.select("pred_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


def _chain_rule_sql() -> str:
    """SQL after s: the slopes by the network's parameters, as the list n, from the slopes along the moved coordinates."""
    fall = "sum(w * -44 * (1 - d) ** 7 * (16 * d * d + 7 * d + 1) * {0})"
    back = lambda w, j, names: " + ".join(f"{n} * {float(row[j])!r}::DOUBLE" for n, row in zip(names, w, strict=True))
    second = ", ".join(f"CASE WHEN b{j + 1} > 0 THEN {back(_LAYERS[2][0], j, ('o1', 'o2'))} ELSE 0 END AS e{j + 1}" for j in range(3))
    first = ", ".join(f"CASE WHEN a{j + 1} > 0 THEN {back(_LAYERS[1][0], j, ('e1', 'e2', 'e3'))} ELSE 0 END AS f{j + 1}" for j in range(3))
    layers = [(("f1", "f2", "f3"), ("p1", "p2")), (("e1", "e2", "e3"), ("a1", "a2", "a3")), (("o1", "o2"), ("b1", "b2", "b3"))]
    sums = [f"sum({t} * {h})" for top, low in layers for t in top for h in low] + [f"sum({t})" for top, _ in layers for t in top]
    return f""", pr AS (SELECT i, inv.al[i] * inv.al[j] - inv.q[i][j] AS w, inv.x1[i] - inv.x1[j] AS g1, inv.x2[i] - inv.x2[j] AS g2 FROM inv, range(1, (SELECT n FROM mu) + 1) a(i), range(1, (SELECT n FROM mu) + 1) b(j)),
pw AS (SELECT *, least(1, sqrt(g1 * g1 / 0.81 + g2 * g2 / 1.21)) AS d FROM pr), o AS (SELECT i, {fall.format("g1 / 0.81")} AS o1, {fall.format("g2 / 1.21")} AS o2 FROM pw GROUP BY i),
pt AS (SELECT row_number() OVER (ORDER BY id) AS i, p1, p2, a1, a2, a3, b1, b2, b3 FROM pts),
h2 AS (SELECT *, {second} FROM pt JOIN o USING (i)), h1 AS (SELECT *, {first} FROM h2), n AS (SELECT [{", ".join(sums)}] AS n FROM h1)
"""


@_query(_inverse_of(_warp_sql(_SUPPLIER_SQL), _WENDLAND_SQL) + _WENDLAND_SLOPES + _chain_rule_sql() + f"SELECT k::INT AS parameter, round(list_concat([s0, s1, s2], n.n)[k + 1], 3) + 0.0::DOUBLE AS slope FROM s, n, range({3 + _NET.size}) v(k)")
def warped_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Slopes of that model's likelihood by the kernel's and all of the network's parameters."""
    g = WarpedProcess(_suppliers(spark, d), _NET, _NET_PARAMETERS, SPARSE_HYPER, aim=8, predicts=False).likelihood_gradient()
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(g)], "parameter int, slope double").select("parameter", _r(F.col("slope"), 3).alias("slope"))


_TREND_POINTS = "SELECT s_suppkey AS id, s_nationkey / 5.0::DOUBLE AS x1, (s_suppkey % 10) / 3.0::DOUBLE AS x2, 0 AS x3, s_acctbal / 1000 - (1 + 0.5 * (s_nationkey / 5.0::DOUBLE)) AS y, 0.1 + 0.05 * ((s_suppkey % 10) / 3.0::DOUBLE) AS noise, 0 AS g FROM supplier"


def _parametric(spark: SparkSession, d: str) -> ParametricProcess:
    """Suppliers with a trend and uneven noise, two parameters each; the trend's slopes are given, the noise's are differences."""
    line = lambda x, p: p[0] + p[1] * x[0]
    return ParametricProcess(_suppliers(spark, d).drop("noise_var"), SPARSE_HYPER, line, [1.0, 0.5], lambda x, p: p[0] + p[1] * x[1], [0.1, 0.05], mean_slopes=lambda x, p: [F.lit(1.0), x[0]], aim=8)


@_query(
    _inverse_of(_TREND_POINTS, _WENDLAND_SQL, "0") + _WENDLAND_SLOPES
    + """, o AS (SELECT sum(al[i]) AS m0, sum(al[i] * x1[i]) AS m1, sum(al[i] ** 2 - q[i][i]) / 2 AS n0, sum((al[i] ** 2 - q[i][i]) * x2[i]) / 2 AS n1 FROM inv, range(1, (SELECT n FROM mu) + 1) a(i))
SELECT k AS parameter, round([s0, s1, s2, m0, m1, n0, n1][k + 1], 3) + 0.0::DOUBLE AS slope FROM s, o, (VALUES (0), (1), (2), (3), (4), (5), (6)) v(k)"""
)
def parametric_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Slopes of the likelihood by the parameters of kernel, mean and noise, all over tables."""
    g = _parametric(spark, d).likelihood_gradient()
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(g)], "parameter int, slope double").select("parameter", _r(F.col("slope"), 3).alias("slope"))


@_query(_elimination(_TREND_POINTS, _NATION_SQL, _WENDLAND_SQL, "0") + "SELECT id::BIGINT AS pred_id, round(1 + 0.5 * x1 - z.m[1][r - n], 5) + 0.0::DOUBLE AS m, round(z.m[r - n][r - n] + 0.1 + 0.05 * x2, 5) AS v FROM u, mu, z WHERE kind = 2")
def parametric_posterior(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of measurements of the same model at every nation."""
    got = _parametric(spark, d).predict(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"), add_noise=True)
    return got.select("pred_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


@_query(_ELIMINATE + "SELECT id::BIGINT AS pred_id, round(mu.m - z.m[1][r - n], 5) + 0.0::DOUBLE AS m, round(z.m[r - n][r - n], 5) AS v FROM u, mu, z WHERE kind = 2")
def tiled_posterior(spark: SparkSession, d: str) -> DataFrame:
    """What gp_posterior gives, from a factor in tiles, as it is made beyond what the driver holds."""
    n = Places(_suppliers(spark, d))
    got = TiledGaussianProcess(n, HYPER, size=max(8, n.count // 4)).predict(_nations(spark, d).withColumnRenamed("pt_id", "pred_id"))
    return got.select("pred_id", _r(F.col("m"), 5).alias("m"), _r(F.col("v"), 5).alias("v"))


# --- metrics: orders against the mean and variance of their priority

_SCORED = """WITH g AS (SELECT o_orderpriority AS p, avg(o_totalprice / 1000) AS m, var_pop(o_totalprice / 1000) AS v FROM orders GROUP BY 1),
r AS (SELECT o_totalprice / 1000 AS y, m, v, (o_totalprice / 1000 - m) / sqrt(v) AS z, 1.959963984540054 * sqrt(v) AS h FROM orders JOIN g ON p = o_orderpriority)
"""


def _cdf_sql(z: str) -> str:
    a = f"abs({z})"
    up, down = (f"{c[0]}" for c in (metrics.NORMAL_ABOVE, metrics.NORMAL_BELOW))
    for c in metrics.NORMAL_ABOVE[1:]:
        up = f"({up} * {a} + {c}::DOUBLE)"
    for c in metrics.NORMAL_BELOW[1:]:
        down = f"({down} * {a} + {c}::DOUBLE)"
    return f"(CASE WHEN {z} > 0 THEN 1 - exp(-{z} * {z} / 2) * {up} / {down} ELSE exp(-{z} * {z} / 2) * {up} / {down} END)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), (F.col("o_totalprice") / 1000).alias("y"))
    return o.join(o.groupBy("p").agg(F.avg("y").alias("m"), F.var_pop("y").alias("v")), "p")


@_query(
    _SCORED + f""", c AS (SELECT *, sqrt(v) * (z * (2 * {_cdf_sql('z')} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())) AS s FROM r)
SELECT round(avg(s), 5) AS crps, round(stddev_pop(s), 5) AS crps_std, round(sqrt(avg((y - m) ** 2)), 5) AS rmse, round(sqrt(avg((y - m) ** 2)) / (max(y) - min(y)), 5) AS nrmse,
round(avg(0.5 * ln(2 * pi() * v) + 0.5 * (y - m) ** 2 / v), 5) AS nlpd, round(1 - sum((y - m) ** 2) / (var_pop(y) * count(y)), 5) AS r2,
round(avg(CASE WHEN y >= m - h AND y <= m + h THEN 1.0::DOUBLE ELSE 0 END), 5) AS picp, round(avg(2 * h), 5) AS mpiw,
round(avg(2 * h + 2 / 0.05 * (greatest(m - h - y, 0) + greatest(y - m - h, 0))), 4) AS interval_score, round(avg(abs(y - m)), 5) AS mae, round(avg(abs((y - m) / y)), 5) AS mape FROM c"""
)
def metric_scores(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.scores(_scored(spark, d))
    return got.select(*[_r(F.col(c), 4 if c == "interval_score" else 5).alias(c) for c in got.columns])


@_query(_SCORED + "SELECT round(avg(0.5 * ln(v) + 0.5 * (y - m) ** 2 / v - 0.5 * ln(10000.0) - 0.5 * (y - 100) ** 2 / 10000.0), 5) AS msll FROM r")
def metric_standardised_loss(spark: SparkSession, d: str) -> DataFrame:
    """Loss of the scored rows beside that of one normal of mean 100 and variance 10,000."""
    return metrics.scores(_scored(spark, d), train=(100.0, 10_000.0)).select(_r(F.col("msll"), 5).alias("msll"))


@_query(_SCORED + f"SELECT round(k / 20.0, 10)::DOUBLE AS level, round(avg(CASE WHEN 2 * {_cdf_sql('abs(z)')} - 1 <= round(k / 20.0, 10) THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM r, range(1, 20) t(k) GROUP BY k")
def metric_coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage_curve(_scored(spark, d)).select("level", _r(F.col("coverage")).alias("coverage"))


# --- distributional data: customers' balances by nation

_MOMENTS = "m AS (SELECT c_nationkey AS station, count(*)::BIGINT AS n, avg(c_acctbal) AS mean, var_pop(c_acctbal) AS variance FROM customer GROUP BY 1)"


def _balances(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select(F.col("c_nationkey").alias("station"), F.col("c_acctbal").alias("value"))


@_query(f"WITH {_MOMENTS} SELECT station, n, round(mean, 4) AS mean, round(variance, 2) AS variance FROM m")
def station_moments(spark: SparkSession, d: str) -> DataFrame:
    return mixture.station_moments(_balances(spark, d), "station", "value").select("station", "n", _r(F.col("mean"), 4).alias("mean"), _r(F.col("variance"), 2).alias("variance"))


@_query(f"WITH {_MOMENTS} SELECT station, k::INT AS k, round(mean + (k - 1) * sqrt(variance), 4) AS mean, round(variance, 2) AS variance FROM m, range(3) t(k)")
def mixture_first_components(spark: SparkSession, d: str) -> DataFrame:
    got = mixture.first_components(mixture.station_moments(_balances(spark, d), "station", "value"), 3)
    return got.select("station", "k", _r(F.col("mean"), 4).alias("mean"), _r(F.col("variance"), 2).alias("variance"))


@_query(
    f"""WITH {_MOMENTS}, d AS (SELECT k, exp(-1 * (c_acctbal - (mean + (k - 1) * sqrt(variance))) ** 2 / (2 * variance)) / sqrt(2 * pi() * variance) / 3 AS p, c_custkey AS id FROM customer JOIN m ON station = c_nationkey, range(3) t(k)),
r AS (SELECT k, p / sum(p) OVER (PARTITION BY id) AS q FROM d) SELECT k::INT AS k, round(avg(q), 6) AS weight FROM r GROUP BY k"""
)
def mixture_em_step(spark: SparkSession, d: str) -> DataFrame:
    b = _balances(spark, d)
    w = mixture.em_weights(b, mixture.first_components(mixture.station_moments(b, "station", "value"), 3), [1 / 3] * 3)
    return spark.createDataFrame(list(enumerate(w)), "k int, weight double").select("k", _r(F.col("weight")).alias("weight"))


@_query(f"WITH {_MOMENTS} SELECT station, round(mean - 0.3 * sqrt(variance), 3) AS mean, round(variance + variance * (0.5 + 0.2 - 0.3 * 0.3), 1) AS variance FROM m")
def mixture_moments(spark: SparkSession, d: str) -> DataFrame:
    comp = mixture.first_components(mixture.station_moments(_balances(spark, d), "station", "value"), 3)
    weight = F.element_at(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), F.col("k") + 1)
    return mixture.mixture_moments(comp.withColumn("weight", weight)).select("station", _r(F.col("mean"), 3).alias("mean"), _r(F.col("variance"), 1).alias("variance"))


_DENSITY = """WITH c AS (SELECT c_nationkey AS station, least(greatest(floor((c_acctbal + 1000) / 550), 0), 19)::INT AS bin FROM customer WHERE c_acctbal IS NOT NULL),
n AS (SELECT station, bin, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT station, count(*) AS total FROM c GROUP BY 1),
f AS (SELECT t.station, b::INT AS bin, greatest(coalesce(n.n, 0) / (total * 550.0::DOUBLE), 1e-12) AS raw FROM t CROSS JOIN range(20) r(b) LEFT JOIN n ON n.station = t.station AND n.bin = b),
p AS (SELECT station, bin, raw / (sum(raw) OVER (PARTITION BY station) * 550) AS density FROM f)
"""


def _densities(spark: SparkSession, d: str) -> DataFrame:
    return P.histogram_density(_balances(spark, d), "station", "value", -1000.0, 10_000.0, 20)


@_query(_DENSITY + "SELECT station, bin, round(density, 9) AS density FROM p")
def station_densities(spark: SparkSession, d: str) -> DataFrame:
    return _densities(spark, d).select("station", "bin", _r(F.col("density"), 9).alias("density"))


@_query(
    _DENSITY + """, q AS (SELECT bin, avg(density) AS other FROM p GROUP BY bin), x AS (SELECT station, density, other, sum((density - other) * 550) OVER (PARTITION BY station ORDER BY p.bin) AS gap FROM p JOIN q ON p.bin = q.bin)
SELECT station, round(sum(density * (ln(density) - ln(other)) * 550), 6) AS kl, round(-ln(sum(sqrt(density * other) * 550)), 6) AS bhattacharyya, round(sum(abs(gap) * 550), 4) AS wasserstein FROM x GROUP BY station"""
)
def density_distances(spark: SparkSession, d: str) -> DataFrame:
    p = _densities(spark, d)
    got = mixture.density_distances(p, p.groupBy("bin").agg(F.avg("density").alias("density")), 550.0)
    return got.select("station", _r(F.col("kl")).alias("kl"), _r(F.col("bhattacharyya")).alias("bhattacharyya"), _r(F.col("wasserstein"), 4).alias("wasserstein"))


@_query(
    """WITH a AS (SELECT c_acctbal AS pos, 1 AS a FROM customer UNION ALL SELECT s_acctbal, 0 FROM supplier),
g AS (SELECT pos, sum(a) AS a, sum(1 - a) AS b FROM a GROUP BY pos),
s AS (SELECT sum(a) OVER (ORDER BY pos) / sum(a) OVER () - sum(b) OVER (ORDER BY pos) / sum(b) OVER () AS gap, lead(pos) OVER (ORDER BY pos) - pos AS width FROM g)
SELECT round(sum(2 * gap * gap * width), 4) AS energy_distance FROM s"""
)
def energy_distance(spark: SparkSession, d: str) -> DataFrame:
    """All customers' balances against all suppliers'."""
    a = _table(spark, d, "customer").select(F.col("c_acctbal").alias("b"))
    return samples.energy_distance(a, _table(spark, d, "supplier").select(F.col("s_acctbal").alias("b")), "b").select(_r(F.col("energy_distance"), 4).alias("energy_distance"))


@_query(f"WITH {_MOMENTS} SELECT a.station AS a, b.station AS b, round(sqrt((a.mean - b.mean) ** 2 + (sqrt(a.variance) - sqrt(b.variance)) ** 2), 4) AS w2 FROM m a JOIN m b ON a.station < b.station")
def station_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    """2-Wasserstein distance of every two nations' normal summaries (25 rows)."""
    m = mixture.station_moments(_balances(spark, d), "station", "value")
    a, b = (m.select(F.col("station").alias(k), F.col("mean").alias(f"m{k}"), F.col("variance").alias(f"v{k}")) for k in "ab")
    w2 = mixture.gaussian_w2_squared(F.col("ma"), F.col("va"), F.col("mb"), F.col("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", _r(F.sqrt(w2), 4).alias("w2"))


_PROFILE = "list_sort(list_transform({0}, lambda x: (x::DOUBLE ** 2 + 0.01) / list_sum(list_transform({0}, lambda y: y::DOUBLE ** 2 + 0.01))))"


@_query(
    f"""WITH f AS (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY label), g AS (SELECT f.label, e.embedding AS c FROM f JOIN embeddings e ON e.vec_id = f.first),
p AS (SELECT vec_id, {_PROFILE.format("e.embedding")} AS a, {_PROFILE.format("g.c")} AS b FROM embeddings e JOIN g ON g.label = e.label)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda k: abs(a[k] - b[k]))) / 64, 6) AS v FROM p"""
)
def profile_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of the sorted, normalised energy profiles of every vector and its label's first one."""
    e = _table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * x.cast("double") + 0.01).alias("p"))
    first = e.groupBy("label").agg(F.min_by("p", "vec_id").alias("c"))
    return e.join(first, "label").select("vec_id", _r(K.sorted_profile_distance(F.col("p"), F.col("c"))).alias("v"))


@_query(
    f"""WITH RECURSIVE {_MOMENTS}, c AS (SELECT c_nationkey AS station, c_acctbal AS y FROM customer WHERE c_acctbal IS NOT NULL),
e AS (SELECT 0 AS it, station, mean - sqrt(variance) AS m0, mean AS m1, mean + sqrt(variance) AS m2, greatest(variance, 1e-9) AS v0, greatest(variance, 1e-9) AS v1, greatest(variance, 1e-9) AS v2 FROM m
  UNION ALL SELECT it + 1, station, s0 / (n0 + 1e-12), s1 / (n1 + 1e-12), s2 / (n2 + 1e-12), greatest(q0 / (n0 + 1e-12), 1e-9), greatest(q1 / (n1 + 1e-12), 1e-9), greatest(q2 / (n2 + 1e-12), 1e-9) FROM
   (SELECT it, station, n0, n1, n2, s0, s1, s2, k0 - 2 * s0 / (n0 + 1e-12) * s0 + (s0 / (n0 + 1e-12)) ** 2 * n0 AS q0, k1 - 2 * s1 / (n1 + 1e-12) * s1 + (s1 / (n1 + 1e-12)) ** 2 * n1 AS q1, k2 - 2 * s2 / (n2 + 1e-12) * s2 + (s2 / (n2 + 1e-12)) ** 2 * n2 AS q2 FROM
    (SELECT it, station, sum(p0 / p) AS n0, sum(p1 / p) AS n1, sum(p2 / p) AS n2, sum(p0 / p * y) AS s0, sum(p1 / p * y) AS s1, sum(p2 / p * y) AS s2, sum(p0 / p * y * y) AS k0, sum(p1 / p * y * y) AS k1, sum(p2 / p * y * y) AS k2 FROM
     (SELECT it, station, y, exp(l0 - t) AS p0, exp(l1 - t) AS p1, exp(l2 - t) AS p2, exp(l0 - t) + exp(l1 - t) + exp(l2 - t) AS p FROM
      (SELECT *, greatest(l0, l1, l2) AS t FROM (SELECT e.it, e.station, y, ln(0.3) - 0.5 * (ln(v0) + (y - m0) ** 2 / v0) AS l0, ln(0.4) - 0.5 * (ln(v1) + (y - m1) ** 2 / v1) AS l1, ln(0.3) - 0.5 * (ln(v2) + (y - m2) ** 2 / v2) AS l2 FROM e JOIN c ON c.station = e.station WHERE it < 12))) GROUP BY it, station))),
l AS (SELECT station, list_sort([{{'m': m0, 'w': 0.3::DOUBLE, 'v': v0}}, {{'m': m1, 'w': 0.4::DOUBLE, 'v': v1}}, {{'m': m2, 'w': 0.3::DOUBLE, 'v': v2}}]) AS c FROM e WHERE it = 12)
SELECT station, k::INT AS k, c[k + 1].w AS weight, round(c[k + 1].m, 3) AS mean, round(c[k + 1].v, 1) AS variance FROM l, range(3) t(k)"""
)
def station_mixtures(spark: SparkSession, d: str) -> DataFrame:
    """A three-part mixture with fixed weights for every nation, twelve rounds of EM over all of them at once."""
    got = mixture.station_mixtures(_balances(spark, d), "station", "value", [0.3, 0.4, 0.3], rounds=12, tol=0.0)
    return got.select("station", "k", "weight", _r(F.col("mean"), 3).alias("mean"), _r(F.col("variance"), 1).alias("variance"))


_BIN_SQL = "SELECT station, -1000 + (bin + 0.5) * 550 AS pos, density FROM p"


@_query(
    _DENSITY + f""", m AS (SELECT c_nationkey AS station, avg(c_acctbal) AS mean, var_pop(c_acctbal) AS variance FROM customer GROUP BY 1),
b AS ({_BIN_SQL}), d AS (SELECT b.station, pos, density * 550 AS mass, k, ln([0.5, 0.3, 0.2][k + 1]::DOUBLE) - 0.5 * (ln(2 * pi() * variance) + (pos - (mean + (k - 1) * sqrt(variance))) ** 2 / variance) AS l FROM b JOIN m ON m.station = b.station, range(3) t(k)),
r AS (SELECT k, mass * exp(l - max(l) OVER w) / sum(exp(l)) OVER w * exp(max(l) OVER w) AS q FROM d WINDOW w AS (PARTITION BY station, pos)), h AS (SELECT k, sum(q) AS q FROM r GROUP BY k)
SELECT k::INT AS k, round(q / sum(q) OVER (), 6) AS weight FROM h"""
)
def density_weights(spark: SparkSession, d: str) -> DataFrame:
    """One step for common weights of three components per nation, on the nations' densities."""
    comp = mixture.first_components(mixture.station_moments(_balances(spark, d), "station", "value"), 3)
    w = distributional.density_weights(_densities(spark, d), comp, [0.5, 0.3, 0.2], 550.0)
    return spark.createDataFrame(list(enumerate(w)), "k int, weight double").select("k", _r(F.col("weight")).alias("weight"))


@_query(
    _elimination(
        """SELECT c_nationkey * 3 + k AS id, c_nationkey / 5.0::DOUBLE AS x1, (c_nationkey % 5)::DOUBLE AS x2, 0 AS x3, mean + (k - 1) * sqrt(variance) - avg(mean + (k - 1) * sqrt(variance)) OVER (PARTITION BY k) AS y, variance AS noise, k AS g
        FROM (SELECT c_nationkey, avg(c_acctbal / 1000) AS mean, var_pop(c_acctbal / 1000) AS variance FROM customer GROUP BY 1), range(3) t(k)""",
        "SELECT n_nationkey * 3 + k AS id, n_nationkey / 5.0 + 0.05::DOUBLE AS x1, n_regionkey::DOUBLE AS x2, 0 AS x3, k AS g FROM nation, range(3) t(k)",
        f"CASE WHEN a.g = b.g THEN {_MATERN_SQL.format(_GAP_SQL)} ELSE 0 END", "0")
    + """, c AS (SELECT k, avg(mean + (k - 1) * sqrt(variance)) AS level FROM (SELECT c_nationkey, avg(c_acctbal / 1000) AS mean, var_pop(c_acctbal / 1000) AS variance FROM customer GROUP BY 1), range(3) t(k) GROUP BY k),
p AS (SELECT u.id // 3 AS pred_id, [0.5, 0.3, 0.2][u.g + 1]::DOUBLE AS w, c.level - z.m[1][r - n] AS m, z.m[r - n][r - n] AS v FROM u, mu, z, c WHERE kind = 2 AND c.k = u.g)
SELECT pred_id::BIGINT AS pred_id, round(sum(w * m), 5) + 0.0::DOUBLE AS mean, round(sum(w * (v + m * m)) - sum(w * m) ** 2, 5) AS variance FROM p GROUP BY 1"""
)
def distributional_posterior(spark: SparkSession, d: str) -> DataFrame:
    """Three components per nation, one model per component over the nations: mean and variance of the mixture beside each nation."""
    b = _balances(spark, d).withColumn("value", F.col("value") / 1000)
    comp = mixture.first_components(mixture.station_moments(b, "station", "value"), 3)
    places = _table(spark, d, "customer").select(F.col("c_nationkey").alias("station")).distinct().withColumn("x", F.array(F.col("station") / 5.0, (F.col("station") % 5).cast("double")))
    ask = _nations(spark, d).select(F.col("pt_id").alias("pred_id"), F.array(F.get("x", 0) + 0.05, F.get("x", 1)).alias("x"))
    got = distributional.DistributionalProcess(comp, places, [HYPER] * 3, [0.5, 0.3, 0.2]).predict(ask)
    return got.select("pred_id", _r(F.col("mean"), 5).alias("mean"), _r(F.col("variance"), 5).alias("variance"))


_TWO = """WITH a AS (SELECT s_suppkey AS i, s_nationkey / 5.0::DOUBLE AS x1, (s_suppkey % 10) / 3.0::DOUBLE AS x2 FROM supplier),
b AS (SELECT n_nationkey::BIGINT AS i, n_nationkey / 5.0::DOUBLE AS x1, n_regionkey::DOUBLE AS x2 FROM nation),
aa AS (SELECT sqrt((p.x1 - q.x1) ** 2 + (p.x2 - q.x2) ** 2) AS d FROM a p JOIN a q ON p.i < q.i), bb AS (SELECT sqrt((p.x1 - q.x1) ** 2 + (p.x2 - q.x2) ** 2) AS d FROM b p JOIN b q ON p.i < q.i),
ab AS (SELECT sqrt((p.x1 - q.x1) ** 2 + (p.x2 - q.x2) ** 2) AS d FROM a p, b q), n AS (SELECT count(*)::DOUBLE AS n FROM a), m AS (SELECT count(*)::DOUBLE AS m FROM b)
"""


@_query(_TWO + "SELECT round(2 * (SELECT sum(d) FROM ab) / (n * m) - 2 * (SELECT sum(d) FROM aa) / n ** 2 - 2 * (SELECT sum(d) FROM bb) / m ** 2, 6) AS energy_distance FROM n, m")
def energy_distance_points(spark: SparkSession, d: str) -> DataFrame:
    """Energy distance of suppliers and nations as points of a plane."""
    return spark.createDataFrame([(samples.energy_distance_points(_suppliers(spark, d), _nations(spark, d), 2),)], "v double").select(_r(F.col("v")).alias("energy_distance"))


@_query(_TWO + "SELECT round(2 * (SELECT sum(exp(-0.5 * d * d)) FROM aa) / (n * (n - 1)) + 2 * (SELECT sum(exp(-0.5 * d * d)) FROM bb) / (m * (m - 1)) - 2 * (SELECT sum(exp(-0.5 * d * d)) FROM ab) / (n * m), 6) AS mmd FROM n, m")
def mean_discrepancy(spark: SparkSession, d: str) -> DataFrame:
    """Unbiased squared maximum mean discrepancy of suppliers and nations."""
    return spark.createDataFrame([(samples.mmd_rbf(_suppliers(spark, d), _nations(spark, d), 2, 0.5),)], "v double").select(_r(F.col("v")).alias("mmd"))


_ALONG = samples.directions(16, 2).round(6).tolist()


@_query(
    f"""WITH u AS (SELECT * FROM (VALUES {", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in enumerate(_ALONG))}) t(line, u1, u2)),
c AS (SELECT line, (c_acctbal / 1000) * u1 + (c_nationkey / 5.0::DOUBLE) * u2 AS pos, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS a FROM customer, u WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL),
g AS (SELECT line, pos, sum(a) AS a, sum(1 - a) AS b FROM c GROUP BY ALL),
s AS (SELECT line, sum(a) OVER w / sum(a) OVER (PARTITION BY line) - sum(b) OVER w / sum(b) OVER (PARTITION BY line) AS gap, lead(pos) OVER w - pos AS width FROM g WINDOW w AS (PARTITION BY line ORDER BY pos)),
l AS (SELECT line, sum(abs(gap) * width) AS w1 FROM s GROUP BY line) SELECT round(avg(w1), 6) AS sliced_wasserstein FROM l"""
)
def sliced_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one segment against the others, as points of a plane, over 16 random directions."""
    c = _table(spark, d, "customer").where("c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL")
    pts = c.select("c_mktsegment", F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey") / 5.0).alias("x"))
    got = samples.sliced_wasserstein(pts.where("c_mktsegment = 'BUILDING'"), pts.where("c_mktsegment <> 'BUILDING'"), _ALONG)
    return got.select(_r(F.col("sliced_wasserstein")).alias("sliced_wasserstein"))


# --- customers' balances and ages as points of a plane, by nation


def _customer_points(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").where("c_acctbal IS NOT NULL")
    return c.select(F.col("c_nationkey").alias("station"), F.array(F.col("c_acctbal") / 1000, (F.col("c_custkey") % 10) / 3.0).alias("x"))


@_query(
    """WITH p AS (SELECT c_custkey AS id, c_nationkey AS s, c_acctbal / 1000 AS x1, (c_custkey % 10) / 3.0::DOUBLE AS x2 FROM customer WHERE c_acctbal IS NOT NULL),
m AS (SELECT s, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) + 1 AS v1, var_pop(x2) + 1 AS v2 FROM p GROUP BY s),
d AS (SELECT id, k, exp(-1 * (x1 - m1 - (k - 1) * sqrt(v1)) ** 2 / (2 * v1)) / sqrt(2 * pi() * v1) * exp(-1 * (x2 - m2 - (k - 1) * sqrt(v2)) ** 2 / (2 * v2)) / sqrt(2 * pi() * v2) / 3 AS p FROM p JOIN m ON p.s = m.s, range(3) t(k)),
r AS (SELECT k, p / sum(p) OVER (PARTITION BY id) AS q FROM d) SELECT k::INT AS k, round(avg(q), 6) AS weight FROM r GROUP BY k"""
)
def mixture_points_em_step(spark: SparkSession, d: str) -> DataFrame:
    """One step for the common weights of three components per nation, spread around its moments."""
    p = _customer_points(spark, d)
    axis = lambda f, k: f(F.get("x", k))
    m = p.groupBy("station").agg(F.array(axis(F.avg, 0), axis(F.avg, 1)).alias("m"), F.array(axis(F.var_pop, 0) + 1, axis(F.var_pop, 1) + 1).alias("variance"))
    comp = m.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn("mean", F.zip_with("m", "variance", lambda a, v: a + (F.col("k") - 1) * F.sqrt(v)))
    w = mixture_points.em_weights(p, comp.select("station", "k", "mean", "variance"), [1 / 3] * 3, 2)
    return spark.createDataFrame(list(enumerate(w)), "k int, weight double").select("k", _r(F.col("weight")).alias("weight"))


@_query(
    """WITH p AS (SELECT c_nationkey AS s, c_custkey AS id, c_acctbal / 1000 AS x1, (c_custkey % 10) / 3.0::DOUBLE AS x2 FROM customer WHERE c_acctbal IS NOT NULL),
m AS (SELECT s, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) + 1 AS v1, var_pop(x2) + 1 AS v2 FROM p GROUP BY s),
l AS (SELECT p.s, id, [0.5, 0.3, 0.2][k + 1]::DOUBLE * exp(-0.5 * ((x1 - m1 - (k - 1) * sqrt(v1)) ** 2 / v1 + (x2 - m2 - (k - 1) * sqrt(v2)) ** 2 / v2)) / (2 * pi() * sqrt(v1 * v2)) AS d FROM p JOIN m ON p.s = m.s, range(3) t(k)),
e AS (SELECT s, ln(sum(d)) AS l FROM l GROUP BY s, id) SELECT s AS station, count(*)::BIGINT AS n, round(sum(l), 4) AS log_likelihood FROM e GROUP BY s"""
)
def mixture_points_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood of every nation's customers under three components spread around its moments."""
    p = _customer_points(spark, d)
    axis = lambda f, k: f(F.get("x", k))
    m = p.groupBy("station").agg(F.array(axis(F.avg, 0), axis(F.avg, 1)).alias("m"), F.array(axis(F.var_pop, 0) + 1, axis(F.var_pop, 1) + 1).alias("variance"))
    comp = m.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn("mean", F.zip_with("m", "variance", lambda a, v: a + (F.col("k") - 1) * F.sqrt(v)))
    comp = comp.withColumn("weight", F.element_at(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), F.col("k") + 1))
    return mixture_points.log_likelihood(p, comp, 2).select("station", "n", _r(F.col("log_likelihood"), 4).alias("log_likelihood"))


@_query()
def mixture_points_aligned(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of two parts per nation, numbered alike along the shortest tree over the nations."""
    comp = mixture_points.station_mixtures(_customer_points(spark, d), 2, rounds=12, tol=0.0)
    tree = mixture_points.station_tree(_nations(spark, d).select(F.col("pt_id").cast("int").alias("station"), "x"))
    return mixture_points.aligned_along(comp, tree).select("station", "k", _r(F.col("weight"), 3).alias("weight"), F.transform("mean", lambda v: _r(v, 2)).alias("mean"))


_PLANE = """WITH p AS (SELECT c_custkey AS id, c_nationkey AS s, c_acctbal / 1000 AS x1, (c_custkey % 10) / 3.0::DOUBLE AS x2 FROM customer WHERE c_acctbal IS NOT NULL),
m AS (SELECT s, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12 FROM p GROUP BY s)
"""


@_query(
    _PLANE + """, c AS (SELECT s, k, m1 + (2 * k - 1) * sqrt(v1 + 1e-6) AS a, m2 + (2 * k - 1) * sqrt(v2 + 1e-6) AS b, v1 + 1e-6 AS v1, v2 + 1e-6 AS v2, v12 FROM m, range(2) t(k)),
d AS (SELECT p.s, p.id, k, x1, x2, exp(-0.5 * (v2 * (x1 - a) ** 2 - 2 * v12 * (x1 - a) * (x2 - b) + v1 * (x2 - b) ** 2) / (v1 * v2 - v12 * v12)) / (2 * pi() * sqrt(v1 * v2 - v12 * v12)) / 2 AS d FROM p JOIN c ON p.s = c.s),
r AS (SELECT s, k, x1, x2, d / sum(d) OVER (PARTITION BY id) AS r FROM d), t AS (SELECT s, k, sum(r) AS n, count(*) AS total, sum(r * x1) / sum(r) AS a, sum(r * x2) / sum(r) AS b, sum(r * x1 * x1) AS q11, sum(r * x1 * x2) AS q12, sum(r * x2 * x2) AS q22 FROM r GROUP BY s, k)
SELECT s AS station, k::INT AS k, round(n / total, 5) AS weight, round(a, 4) + 0.0::DOUBLE AS mean1, round(b, 4) AS mean2, round(q11 / n - a * a + 1e-6, 3) AS v11, round(q12 / n - a * b, 3) + 0.0::DOUBLE AS v12, round(q22 / n - b * b + 1e-6, 3) AS v22 FROM t"""
)
def mixture_full_em_step(spark: SparkSession, d: str) -> DataFrame:
    """One round of EM with full covariances for every nation's customers, from two components about its moments."""
    p = _customer_points(spark, d)
    got = mixture_full.em_step(p, mixture_full.first_components(mixture_full.moments(p, 2), 2, 2), 2, 2)
    at = lambda c, k, digits: _r(F.get(c, k), digits)
    return got.select("station", "k", _r(F.col("weight"), 5).alias("weight"), at("mean", 0, 4).alias("mean1"), at("mean", 1, 4).alias("mean2"), at("covariance", 0, 3).alias("v11"), at("covariance", 1, 3).alias("v12"), at("covariance", 3, 3).alias("v22"))


@_query(
    _PLANE + """SELECT a.s AS a, b.s AS b, round(sqrt(greatest(0, (a.m1 - b.m1) ** 2 + (a.m2 - b.m2) ** 2 + a.v1 + a.v2 + b.v1 + b.v2
  - 2 * sqrt(a.v1 * b.v1 + 2 * a.v12 * b.v12 + a.v2 * b.v2 + 2 * sqrt(greatest(0, (a.v1 * a.v2 - a.v12 ** 2) * (b.v1 * b.v2 - b.v12 ** 2)))))), 4) AS w2 FROM m a JOIN m b ON a.s < b.s"""
)
def station_wasserstein_full(spark: SparkSession, d: str) -> DataFrame:
    """2-Wasserstein distance, by matrix roots, of every two nations' normal summaries in the plane (25 rows)."""
    m = mixture_full.moments(_customer_points(spark, d), 2)
    a, b = (m.select(F.col("station").alias(k), F.col("mean").alias(f"mean_{k}"), F.col("covariance").alias(f"covariance_{k}")) for k in "ab")
    return mixture_full.pair_distances(a.join(b, F.col("a") < F.col("b")), 2).select("a", "b", _r(F.col("w2"), 4).alias("w2"))


@_query(
    _PLANE + """, c AS (SELECT s, k, m1 + (2 * k - 1) * sqrt(v1 + 1e-6) AS a, m2 + (2 * k - 1) * sqrt(v2 + 1e-6) AS b, v1 + 1e-6 AS v1, v2 + 1e-6 AS v2, v12 FROM m, range(2) t(k)),
d AS (SELECT p.s, p.id, sum(exp(-0.5 * (v2 * (x1 - a) ** 2 - 2 * v12 * (x1 - a) * (x2 - b) + v1 * (x2 - b) ** 2) / (v1 * v2 - v12 * v12)) / (2 * pi() * sqrt(v1 * v2 - v12 * v12)) / 2) AS d FROM p JOIN c ON p.s = c.s GROUP BY p.s, p.id)
SELECT s AS station, count(*)::BIGINT AS n, round(sum(ln(d)), 4) + 0.0::DOUBLE AS log_likelihood FROM d GROUP BY s"""
)
def mixture_full_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood of every nation's customers under the two components that the round above starts from."""
    p = _customer_points(spark, d)
    got = mixture_full.log_likelihood(p, mixture_full.first_components(mixture_full.moments(p, 2), 2, 2), 2, 2)
    return got.select("station", "n", _r(F.col("log_likelihood"), 4).alias("log_likelihood"))


# --- training and streams


def _objective(gp: GaussianProcess) -> Callable[[np.ndarray], float]:
    def loss(h: np.ndarray) -> float:
        try:
            return -gp.log_likelihood(h)
        except ValueError:
            return 1e12

    return loss


class _Data:
    """What an objective needs of a model, without its session: travels to the executors."""

    def __init__(self, gp: GaussianProcess) -> None:
        self.x, self.y, self.noise, self.mean, self.kernel, self.n, self.spare = gp.x, gp.y, gp.noise, gp.mean, gp.kernel, gp.n, gp.spare

    log_likelihood = GaussianProcess.log_likelihood


def _trained(spark: SparkSession, hyper: np.ndarray, loss: float) -> DataFrame:
    return spark.createDataFrame([(k, float(v), float(loss)) for k, v in enumerate(hyper)], "parameter int, value double, loss double")


@_query()
def train_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Adam, then quasi-Newton steps, kept only if the likelihood is better."""
    gp, b = _model(spark, d), training.default_bounds(_suppliers(spark, d), 2)
    loss, slope = _objective(gp), lambda h: -gp.likelihood_gradient(h)
    first = training.adam(slope, HYPER, b, 0.05, 20)
    best = training.keep_if_better(loss, np.array(HYPER), training.quasi_newton(loss, slope, first, b, 15))
    return _trained(spark, best, loss(best))


@_query()
def train_strips(spark: SparkSession, d: str) -> DataFrame:
    """Quasi-Newton over a model in strips: every value and slope is a few jobs over tables, no point comes to the driver."""
    pts = _suppliers(spark, d)
    places = Places(pts)
    loss = training.TableObjective(lambda h: StripGaussianProcess(places, h, predicts=False))
    best = training.train(loss, SPARSE_HYPER, training.default_bounds(pts, 2), steps=8)
    return _trained(spark, best, loss(best))


@_query()
def train_warped(spark: SparkSession, d: str) -> DataFrame:
    """Kernel and network trained together until the search can't get lower; the likelihood is that of one matrix while the places are few."""
    pts, k = _suppliers(spark, d), 1 + _NET.out
    places = Places(pts)
    loss = training.TableObjective(lambda h: warped_likelihood(places, _NET, h[k:], h[:k]))
    bounds = np.array([*training.default_bounds(pts, _NET.out), *[(p - 0.5, p + 0.5) for p in _NET_PARAMETERS]])
    best = training.train(loss, [*SPARSE_HYPER, *_NET_PARAMETERS], bounds, steps=None)
    return _trained(spark, best, loss(best))


@_query()
def train_learned_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains whose jumps take on the covariance that all of them have seen: what the later half of the portions found."""
    gp, b = _model(spark, d), training.default_bounds(_suppliers(spark, d), 2)
    loss = _objective(_Data(gp))
    trace = training.learned_chains(spark, lambda h: -loss(h), HYPER, b, 4, 60, 4)
    return training.trace_summary(trace, 3)


@_query()
def train_evolution(spark: SparkSession, d: str) -> DataFrame:
    gp, b = _model(spark, d), training.default_bounds(_suppliers(spark, d), 2)
    loss = _objective(_Data(gp))
    best = training.evolution(spark, loss, b, 16, 6)
    return _trained(spark, best, loss(best))


@_query()
def train_chains(spark: SparkSession, d: str) -> DataFrame:
    """Parallel Metropolis chains over the hyperparameters."""
    gp, b = _model(spark, d), training.default_bounds(_suppliers(spark, d), 2)
    loss = _objective(_Data(gp))
    return training.trace_summary(training.chains(spark, lambda h: -loss(h), HYPER, b, 4, 200), 3)


@_query()
def train_bayesian(spark: SparkSession, d: str) -> DataFrame:
    gp, b = _model(spark, d), training.default_bounds(_suppliers(spark, d), 2)
    loss = _objective(gp)
    best, _ = training.bayesian(loss, b, 25)
    return _trained(spark, best, loss(best))


@_query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY 1")
def stream_window_moments(spark: SparkSession, d: str) -> DataFrame:
    """The hourly moments of the event stream, as the stream's query computes them over the whole table."""
    got = appends.window_moments(_table(spark, d, "events"), "ts", "value")
    return got.select(F.unix_timestamp("start").alias("start"), "n", _r(F.col("mean")).alias("mean"), _r(F.sqrt("variance")).alias("deviation"))

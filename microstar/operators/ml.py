"""Split, fit, score (M1-M4).

The fit never leaves the cluster: every iteration is one aggregation of
(d+1)^2 weighted cross-products; only those numbers reach the driver, where
a (d+1)x(d+1) system is solved.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F


def hash_split(df: DataFrame, keys: list[str], test_below: str = "40",
               out: str = "split") -> DataFrame:
    """'test'/'train' by the first two hex digits of md5(key) (M1).

    '00'..'3f' is 64 of 256 values: a 25 % test share in expectation.
    Stable across runs and partitionings, unlike a seeded random split.
    """
    h = F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 2)
    return df.withColumn(out, F.when(h < F.lit(test_below), F.lit("test")).otherwise(F.lit("train")))


@dataclass
class LinearModel:
    features: list[str]
    weights: list[float]
    intercept: float
    iterations: int = 0
    history: list = field(default_factory=list)

    def predict(self) -> Column:
        """Prediction as a column expression (M3): sum(w_i * x_i) + b."""
        e = F.lit(self.intercept)
        for f, w in zip(self.features, self.weights):
            e = e + F.lit(w) * F.col(f).cast("double")
        return e

    def to_frame(self, spark) -> DataFrame:
        rows = [(f, float(w)) for f, w in zip(self.features, self.weights)]
        rows.append(("intercept", float(self.intercept)))
        return spark.createDataFrame(rows, "term string, weight double")


def score_linear(df: DataFrame, model: LinearModel, out: str = "PREVISAO") -> DataFrame:
    """Attach the prediction to each row (M3, M4)."""
    return df.withColumn(out, model.predict())


def _normal_equations(df: DataFrame, xs: list[Column], y: Column, w: Column,
                      extra: list[Column] | None = None):
    """One job: sums of w*z*z^T and w*z*y with z = [x, 1] (plus ``extra`` sums).

    The per-row terms (centred features, weight, target) are computed once
    in a projection; the aggregate then only multiplies plain columns.
    """
    extra = extra or []
    d = len(xs)
    proj = df.select(*[x.alias(f"_z{i}") for i, x in enumerate(xs)], y.alias("_y"), w.alias("_w"),
                     *[e.alias(f"_e{i}") for i, e in enumerate(extra)])
    z = [F.col(f"_z{i}") for i in range(d)] + [None]
    wc, yc = F.col("_w"), F.col("_y")

    def term(*cs):
        out = wc
        for c in cs:
            if c is not None:
                out = out * c
        return out

    p = d + 1
    aggs = []
    for i in range(p):
        for j in range(i, p):
            aggs.append(F.sum(term(z[i], z[j])))
    for i in range(p):
        aggs.append(F.sum(term(z[i], yc)))
    aggs += [F.sum(F.col(f"_e{i}")) for i in range(len(extra))]
    vals = [0.0 if v is None else float(v) for v in proj.agg(*aggs).first()]
    a = np.zeros((p, p))
    k = 0
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = vals[k]
            k += 1
    rhs = np.array(vals[k:k + p])
    return (a, rhs, vals[k + p:]) if extra else (a, rhs)


def _centred(df: DataFrame, features: list[str], label: str, persist: bool = False):
    cols = [F.col(c).cast("double").alias(c) for c in features + [label]]
    data = df.select(*cols).na.drop()
    if persist:
        # cached before the means pass, so that pass already fills the cache
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    means = data.agg(*[F.avg(c) for c in features + [label]]).first()
    mu = np.array([float(m) if m is not None else 0.0 for m in means])
    xs = [F.col(c) - F.lit(mu[i]) for i, c in enumerate(features)]
    y = F.col(label) - F.lit(mu[-1])
    return data, mu, xs, y


def _unshift(beta: np.ndarray, mu: np.ndarray, features: list[str]) -> tuple[list[float], float]:
    w = beta[:-1]
    b = beta[-1] + mu[-1] - float(np.dot(w, mu[:-1]))
    return [float(v) for v in w], float(b)


def fit_ols(df: DataFrame, features: list[str], label: str) -> LinearModel:
    """Least squares through the normal equations on mean-centred data.

    Two jobs (means, cross-products).  Rows with a null feature or label are
    left out, as in SQL's regr_* aggregates.
    """
    data, mu, xs, y = _centred(df, features, label)
    a, rhs = _normal_equations(data, xs, y, F.lit(1.0))
    beta = np.linalg.lstsq(a, rhs, rcond=None)[0]
    w, b = _unshift(beta, mu, features)
    return LinearModel(features, w, b, 1)


def fit_linear_svr(df: DataFrame, features: list[str], label: str, epsilon: float = 0.0,
                   C: float = 1.0, max_iter: int = 100, tol: float = 1e-4,
                   obj_tol: float = 1e-6) -> LinearModel:
    """Linear support-vector regression, distributed (M2).

    Minimises  1/2 |w|^2 + C * sum max(0, |y - w.x - b| - epsilon)  (the
    public library defaults are epsilon = 0, C = 1; the intercept is not
    penalised) by iteratively reweighted least squares: each round weights
    a row by 1 / max(|r| - epsilon, delta) (delta = 1e-6 x the least-squares
    RMS residual), shifts its target by
    epsilon*sign(r), and solves (C * X'WX + diag(1,..,1,0)) beta = C * X'Wy.
    Rows inside the epsilon tube get weight 0.  One aggregation job per
    round over a persisted, pruned, centred frame; the same job also sums
    the loss of the current beta.  Stops when the relative change of beta
    is below ``tol`` or the objective's relative decrease is below
    ``obj_tol``.  ``history`` holds the objective per round.
    """
    data, mu, xs, y = _centred(df, features, label, persist=True)
    try:
        p = len(features) + 1
        reg = np.eye(p)
        reg[-1, -1] = 0.0
        a, rhs, (yy,) = _normal_equations(data, xs, y, F.lit(1.0), extra=[y * y])
        beta = np.linalg.lstsq(a, rhs, rcond=None)[0]
        # weight floor relative to the least-squares residual scale (no extra pass:
        # SSR = y'y - beta'X'y), so the fit behaves the same whatever the units of y
        n = max(a[-1, -1], 1.0)
        rms = float(np.sqrt(max(yy - float(np.dot(beta, rhs)), 0.0) / n))
        delta = 1e-6 * max(rms, 1e-12)
        history = []
        it = 0
        prev_obj = None
        for it in range(1, max_iter + 1):
            fitted = F.lit(float(beta[-1]))
            for i, x in enumerate(xs):
                fitted = fitted + F.lit(float(beta[i])) * x
            r = y - fitted
            excess = F.abs(r) - F.lit(epsilon)
            wt = F.when(excess > 0, F.lit(1.0) / F.greatest(excess, F.lit(delta))).otherwise(F.lit(0.0))
            target = y - F.signum(r) * F.lit(epsilon) if epsilon else y
            a, rhs, (loss,) = _normal_equations(data, xs, target, wt,
                                                extra=[F.greatest(excess, F.lit(0.0))])
            obj = 0.5 * float(np.dot(beta[:-1], beta[:-1])) + C * loss
            history.append(obj)
            if prev_obj is not None and abs(prev_obj - obj) <= obj_tol * max(abs(obj), 1e-12):
                break
            prev_obj = obj
            new = np.linalg.lstsq(C * a + reg + 1e-12 * np.eye(p), C * rhs, rcond=None)[0]
            change = float(np.linalg.norm(new - beta) / max(np.linalg.norm(beta), 1e-12))
            beta = new
            if change < tol:
                break
        w, b = _unshift(beta, mu, features)
        return LinearModel(features, w, b, it, history)
    finally:
        data.unpersist()

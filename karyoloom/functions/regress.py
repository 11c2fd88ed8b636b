"""Least squares from averages of products: one pass over the rows, one small system per model, solved where it is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType


def unit_moments(df: DataFrame, columns: dict[str, Column], unit: list[str]) -> DataFrame:
    """One row `m`: mean over units of the unit means of all products of `columns` and a constant, so that every unit
    weighs the same whatever its number of rows. Products are ordered (a, b) with a <= b, the constant first."""
    names = ["_one", *columns]
    d = df.select(*unit, F.lit(1.0).alias("_one"), *[c.cast("double").alias(k) for k, c in columns.items()]).dropna(subset=list(columns))
    prods = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    per = d.groupBy(*unit).agg(*[F.avg(F.col(a) * F.col(b)).alias(f"_m{k}") for k, (a, b) in enumerate(prods)])
    return per.agg(F.array(*[F.avg(f"_m{k}") for k in range(len(prods))]).alias("m"))


def _square(m: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = m
    return out + np.triu(out, 1).T


def _solve(moments: DataFrame, fn) -> DataFrame:
    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def run(m: pd.Series) -> pd.Series:
        return pd.Series([[list(map(float, r)) for r in fn(np.asarray(v, float))] for v in m])
    return moments.select(F.posexplode(run("m")).alias("k", "v"))


def ridge(df: DataFrame, features: dict[str, Column], y: Column, unit: list[str], lam: float) -> DataFrame:
    """(feature, beta, mu, sd) of a ridge on standardised features."""
    n = len(features) + 2

    def fn(m):
        s = _square(m, n)
        mu, my = s[0, 1:-1], s[0, -1]
        cov = s[1:-1, 1:-1] - np.outer(mu, mu)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd = np.where(sd > 1e-12 * np.maximum(np.abs(mu), 1), sd, 1.0)
        beta = np.linalg.solve(cov / np.outer(sd, sd) + lam * np.eye(n - 2), (s[1:-1, -1] - mu * my) / sd)
        return np.stack([beta, mu, sd], axis=1)

    names = F.array(*[F.lit(k) for k in features])
    out = _solve(unit_moments(df, {**features, "_y": y}, unit), fn)
    return out.select(names[F.col("k")].alias("feature"), F.col("v")[0].alias("beta"), F.col("v")[1].alias("mu"), F.col("v")[2].alias("sd"))


def least_squares(df: DataFrame, features: dict[str, Column], y: Column, unit: list[str], penalty: float = 0.0) -> DataFrame:
    """(feature, beta) of y on features and an intercept ('1'); constant features are handled by the pseudo-inverse, the
    intercept is never penalised."""
    n = len(features) + 1

    def fn(m):
        s = _square(m, n + 1)
        a = s[:n, :n] + penalty * np.diag([0.0] + [1.0] * (n - 1))
        return (np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ s[:n, -1])[:, None]

    names = F.array(F.lit("1"), *[F.lit(k) for k in features])
    return _solve(unit_moments(df, {**features, "_y": y}, unit), fn).select(names[F.col("k")].alias("feature"), F.col("v")[0].alias("beta"))


def ridge_with_missing(df: DataFrame, features: list[str], y: Column, unit: list[str], lam: float = 1.0) -> DataFrame:
    """Penalised least squares on standardised features where a missing value counts as the mean."""
    st = df.agg(*[F.avg(f).alias(f"_mu_{f}") for f in features], *[F.stddev_pop(f).alias(f"_sd_{f}") for f in features])
    d = df.join(F.broadcast(st), F.lit(True))                                # one row of means and deviations
    z = {f: F.coalesce((F.col(f) - F.col(f"_mu_{f}")) / F.when(F.col(f"_sd_{f}") > 0, F.col(f"_sd_{f}")).otherwise(1.0), F.lit(0.0)) for f in features}
    return least_squares(d, z, y, unit, lam)

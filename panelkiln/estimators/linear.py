"""Least squares by moments: rows are reduced to sums of products, and a small system is solved on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import erfc, exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns up to which products are SQL sums; beyond, a generated aggregate would be larger than the JVM compiles well.
WIDE = 8


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """X'X over the named columns and the number of rows; one aggregate with partial sums."""
    k = len(columns)
    if k > WIDE:
        return _wide_moments(df, columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(F.count("*").alias("n"), *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"m{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((k, k))
    for i, j in pairs:
        out[i, j] = out[j, i] = float(row[f"m{i}_{j}"] or 0.0)
    return out, int(row["n"])


def _wide_moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Products by Arrow batch, a partition's sum as one row per entry; entries are summed where they meet."""
    k = len(columns)
    schema = pa.schema([("at", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, k)), 0
        for batch in batches:
            x = np.stack([np.nan_to_num(c.to_numpy(zero_copy_only=False)) for c in batch.columns], 1) if batch.num_rows else np.zeros((0, k))
            total += x.T @ x
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + 1), pa.int32()), pa.array(np.append(total.ravel(), n))], schema=schema)

    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, "at int, v double")
    out = np.zeros(k * k + 1)
    for at, v in parts.groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    return out[:-1].reshape(k, k), int(out[-1])


def solve(xx: np.ndarray, xy: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """The least-norm solution; directions without variation get zero."""
    return np.linalg.pinv(xx, rcond=tol, hermitian=True) @ xy


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    r2: float | None = None

    @property
    def error(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    def rows(self) -> list[tuple[str, float, float, float]]:
        return [(n, float(b), float(s), normal_p(b / s) if s > 0 else None) for n, b, s in zip(self.names, self.beta, self.error, strict=True)]


def ols(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True) -> Fit:
    """Ordinary least squares with the classical covariance."""
    one = df.dropna(subset=[y, *xs]).select(F.col(y).cast("double").alias(y), *[F.col(x).cast("double").alias(x) for x in xs])
    names = [*(["const"] if intercept else []), *xs]
    m, n = moments(one.withColumn("const", F.lit(1.0)), [*names, y] if intercept else [*xs, y])
    xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    beta = solve(xx, xy)
    rss = yy - beta @ xy
    total = yy - (xy[0] ** 2 / n if intercept and n else 0)
    return Fit(list(names), beta, np.linalg.pinv(xx, hermitian=True) * rss / max(1, n - len(names)), n, 1 - rss / total if total > 0 else None)


def demeaned(df: DataFrame, unit: str, columns: Sequence[str], weight: Column | None = None) -> DataFrame:
    """The columns less their unit means (over rows where the condition holds); a grouping and a join on the unit."""
    pick = (lambda c: F.when(weight, F.col(c))) if weight is not None else F.col
    means = df.groupBy(unit).agg(*[F.avg(pick(c)).alias(f"_m_{c}") for c in columns])
    out = df.join(means, unit)
    return out.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def clustered(df: DataFrame, unit: str, xs: Sequence[str], residual: Column, xx: np.ndarray, df_correction: bool = True) -> np.ndarray:
    """Covariance with clusters by unit: scores are summed by unit, their products over units."""
    scores = df.groupBy(unit).agg(*[F.sum(F.col(x) * residual).alias(x) for x in xs])
    meat, groups = moments(scores, xs)
    bread = np.linalg.pinv(xx, hermitian=True)
    return bread @ meat @ bread * (groups / (groups - 1) if df_correction and groups > 1 else 1)


def normal_p(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def chi2_sf(x: float, k: float) -> float:
    """P(chi-squared with k degrees > x): the regularised incomplete gamma function, by series or continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    scale = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


def wald(beta: np.ndarray, cov: np.ndarray) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p of all being zero; the pseudo-inverse serves where cov is singular."""
    rank = int(np.linalg.matrix_rank(cov, hermitian=True))
    stat = float(beta @ np.linalg.pinv(cov, hermitian=True) @ beta)
    return stat, rank, chi2_sf(stat, rank) if rank else float("nan")

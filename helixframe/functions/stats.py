"""Statistics that SQL lacks, as Arrow-batched functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_factorials(most: int) -> np.ndarray:
    """log(i!) for i of 0 to ``most``."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1, dtype=float)))])


def fisher_exact(a: int, b: int, c: int, d: int, logs: np.ndarray) -> tuple[float, float, float, float]:
    """(probability of the table, left, right, two-tailed) of a 2 x 2 table with fixed margins."""
    row, column, total = a + b, a + c, a + b + c + d
    least, most = max(0, row + column - total), min(row, column)
    if least == most:
        return 1.0, 1.0, 1.0, 1.0
    x = np.arange(least, most + 1)
    constant = logs[row] + logs[total - row] + logs[column] + logs[total - column] - logs[total]
    p = np.exp(constant - logs[x] - logs[row - x] - logs[column - x] - logs[total - row - column + x])
    own = p[a - least]
    tails = p[: a - least + 1].sum(), p[a - least :].sum(), p[p <= own * (1 + 1e-7)].sum()
    return float(own), *(min(1.0, float(t)) for t in tails)


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<p, left, right, two>: Fisher's exact test of a 2 x 2 table; null where a count is null.

    A batch shares one table of log factorials up to its largest total, and equal
    tables are computed once.
    """

    @F.pandas_udf("struct<p: double, left: double, right: double, two: double>")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        tables = pd.DataFrame({"a": a, "b": b, "c": c, "d": d})
        known = tables.dropna().drop_duplicates().astype("int64")
        logs = _log_factorials(int(known.sum(axis=1).max()) if len(known) else 0)
        found = known.assign(**dict(zip(("p", "left", "right", "two"), zip(*(fisher_exact(*map(int, t), logs) for t in known.itertuples(index=False)), strict=True), strict=False))) if len(known) else known.assign(p=0.0, left=0.0, right=0.0, two=0.0)
        return tables.merge(found, on=["a", "b", "c", "d"], how="left")[["p", "left", "right", "two"]]

    return run(a, b, c, d)


def fisher_two_tailed(a: Column, b: Column, c: Column, d: Column) -> Column:
    return fisher(a, b, c, d)["two"]


def gamma_p(s: float, z: float) -> float:
    """Regularised lower incomplete gamma function; a series below s + 1, a continued fraction beyond."""
    if z <= 0:
        return 0.0
    scale = math.exp(s * math.log(z) - z - math.lgamma(s))
    if z < s + 1:
        term = total = 1 / s
        i = s
        while term > total * 1e-15:
            i += 1
            term *= z / i
            total += term
        return total * scale
    return 1 - scale * _fraction(lambda k: (1.0, z - s + 1) if k == 0 else (k * (s - k), z - s + 1 + 2 * k))


def gamma_q(s: float, z: float) -> float:
    """Regularised upper incomplete gamma function."""
    if z < s + 1:
        return 1 - gamma_p(s, z)
    scale = math.exp(s * math.log(z) - z - math.lgamma(s))
    return scale * _fraction(lambda k: (1.0, z - s + 1) if k == 0 else (k * (s - k), z - s + 1 + 2 * k))


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def part(k: int) -> tuple[float, float]:
        if k == 0:
            return 1.0, 1.0
        m = k // 2
        return (m * (b - m) * x / ((a + k - 1) * (a + k)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + k - 1) * (a + k))), 1.0

    return scale * _fraction(part)


def _fraction(part: object, most: int = 10_000) -> float:
    """Value of a0 / (b0 + a1 / (b1 + ...)) with (a, b) = part(k), from its convergents."""
    upper, lower, last_upper, last_lower, value = 0.0, 1.0, 1.0, 0.0, math.inf
    for k in range(most):
        a, b = part(k)
        upper, last_upper = b * upper + a * last_upper, upper
        lower, last_lower = b * lower + a * last_lower, lower
        if lower:
            # Kept near 1, so that neither over- nor underflows.
            upper, last_upper, last_lower, lower = upper / lower, last_upper / lower, last_lower / lower, 1.0
            if k and abs(upper - value) <= 1e-15 * abs(upper):
                return upper
            value = upper
    return value


def special(name: str, *arguments: Column) -> Column:
    """lgamma, erfc, gamma_p, gamma_q or beta_i over columns; null where an argument is null."""
    one = {"lgamma": math.lgamma, "erfc": math.erfc, "gamma_p": gamma_p, "gamma_q": gamma_q, "beta_i": beta_i}[name]

    @F.pandas_udf("double")
    def run(packed: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else one(*row) for row in packed.itertuples(index=False)], dtype=float)

    return run(F.struct(*(x.cast("double").alias(f"x{i}") for i, x in enumerate(arguments))))

"""Causal discovery on small correlation matrices: conditional independence tests and the PC skeleton with v-structures."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlation_matrix(rows: DataFrame, variables: list[str]) -> tuple[np.ndarray, int]:
    """(Pearson correlations, rows): all pairs in one aggregate; only the matrix of the stated variables reaches the driver."""
    pairs = list(combinations(range(len(variables)), 2))
    got = rows.agg(F.count(F.lit(1)).alias("n"), *(F.corr(variables[i], variables[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    m = np.eye(len(variables))
    for i, j in pairs:
        m[i, j] = m[j, i] = got[f"c{i}_{j}"] if got[f"c{i}_{j}"] is not None else 0.0
    return m, got["n"]


def partial(m: np.ndarray, i: int, j: int, given: tuple[int, ...]) -> float:
    """Partial correlation from the inverse of the submatrix."""
    if not given:
        return float(m[i, j])
    inverse = np.linalg.pinv(m[np.ix_([i, j, *given], [i, j, *given])])
    scale = math.sqrt(max(inverse[0, 0] * inverse[1, 1], 1e-300))
    return float(np.clip(-inverse[0, 1] / scale, -1, 1))


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + top / c
            c = c if abs(c) > 1e-300 else 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def p_value(r: float, n: int, given: int) -> float:
    """Two-sided p of a (partial) correlation by Student's t."""
    df = n - 2 - given
    if df <= 0:
        return 1.0
    if abs(r) >= 1 - 1e-12:
        return 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + r * r * df / (1 - r * r)))


def pc(rows: DataFrame, variables: list[str], alpha: float = 0.05, most: int = 3) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
    """(directed, undirected) edges between variables. Edges of a level are removed when the level ends."""
    m, n = correlation_matrix(rows, variables)
    k = len(variables)
    near = {i: set(range(k)) - {i} for i in range(k)}
    apart: dict[frozenset[int], tuple[int, ...]] = {}
    for level in range(most + 1):
        gone = []
        for i, j in combinations(range(k), 2):
            if j not in near[i]:
                continue
            for given in sorted({*combinations(sorted(near[i] - {j}), level), *combinations(sorted(near[j] - {i}), level)}):
                if p_value(partial(m, i, j, given), n, level) > alpha:
                    apart[frozenset((i, j))] = given
                    gone.append((i, j))
                    break
        for i, j in gone:
            near[i].discard(j)
            near[j].discard(i)
    directed: set[tuple[int, int]] = set()
    for i, j in combinations(range(k), 2):
        for mid in sorted(near[i] & near[j]) if j not in near[i] else ():
            if mid not in apart.get(frozenset((i, j)), ()):
                directed |= {(i, mid), (j, mid)}
    grown = True
    while grown:
        new = set()
        for a, b in directed:
            for c in near[b] - {a}:
                if c not in near[a] and (b, c) not in directed and (c, b) not in directed:
                    new.add((b, c))
        for a in range(k):
            for c in near[a]:
                if (a, c) not in directed and (c, a) not in directed and any((a, b) in directed and (b, c) in directed for b in range(k)):
                    new.add((a, c))
        grown = bool(new - directed)
        directed |= new
    both = {(i, j) for i, j in directed if (j, i) in directed}
    name = lambda e: (variables[e[0]], variables[e[1]])
    plain = {(i, j) for i in range(k) for j in near[i] if i < j and (i, j) not in directed and (j, i) not in directed}
    return {name(e) for e in directed - both}, {name(e) for e in plain | {(min(e), max(e)) for e in both}}


def partial_table(rows: DataFrame, variables: list[str]) -> DataFrame:
    """(a, b, given, r, t, p) of every pair under each single other variable: partial correlation, its t and two-sided p."""
    m, n = correlation_matrix(rows, variables)
    out = []
    for i, j in combinations(range(len(variables)), 2):
        for k in range(len(variables)):
            if k not in (i, j):
                r = partial(m, i, j, (k,))
                t = r * math.sqrt(max(n - 3, 0) / max(1 - r * r, 1e-300))
                out.append((variables[i], variables[j], variables[k], round(r, 6), round(t, 6), round(p_value(r, n, 1), 6)))
    return rows.sparkSession.createDataFrame(out, "a string, b string, given string, r double, t double, p double")

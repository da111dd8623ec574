"""Repeated-measures ANCOVA from moments.

One row per subject holds the waves and the between-subject terms. The design
is fully crossed: the product of every subset of the terms, factors being
effect-coded. One pass gives the cross-products of design and waves (per
subgroup if wanted); the tests are small matrix algebra on those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dist import f_tail
from .moments import as_matrix, cross_products

RESULT = (
    "term string, part string, df1 double, df2 double, epsilon double, ss double, "
    "ss_error double, f double, p double, ges double, reason string"
)


def _codes(name: str, levels: Sequence | None) -> list[Column]:
    """A covariate as it is; a factor as effect codes, last level -1."""
    c = F.col(name)
    if levels is None:
        return [c.cast("double")]
    last = F.lit(levels[-1])
    return [
        F.when(c == F.lit(v), 1.0).when(c == last, -1.0).when(c.isin(list(levels)), 0.0)
        for v in levels[:-1]
    ]


def contrasts(waves: int) -> np.ndarray:
    """Orthonormal contrasts between waves (waves x (waves - 1))."""
    full = np.column_stack([np.ones(waves), np.eye(waves)[:, 1:]])
    return np.linalg.qr(full)[0][:, 1:]


def tests_from_moments(
    m: np.ndarray, terms: Sequence[tuple[str, list[int]]], waves: Sequence[int],
    observed: Sequence[str], within: str,
) -> pd.DataFrame:
    """All between and within tests, type-III, with the Greenhouse-Geisser
    correction. ``m`` holds uncentred cross-products. A model that cannot be fitted
    keeps its terms, without figures and with the reason."""
    x = sorted({i for _, at in terms for i in at})
    # The tests do not depend on the units of the columns, so units must not decide
    # whether the columns count as independent.
    norm = np.sqrt(np.diag(m)[x])
    unit = 1 / np.where(norm > 0, norm, 1)
    xx, xy, yy = m[np.ix_(x, x)] * np.outer(unit, unit), m[np.ix_(x, waves)] * unit[:, None], m[np.ix_(waves, waves)]
    n, w = m[0, 0], len(waves)
    left = n - len(x)
    named = lambda name, part: name if part == "between" else (within if name == "(Intercept)" else f"{name}:{within}")
    reason = "too few subjects" if left < 1 else "terms depend on each other" if np.linalg.matrix_rank(xx) < len(x) else None
    if reason:
        return pd.DataFrame([(named(name, part), part, *[np.nan] * 8, reason) for part in ("between", "within") for name, _ in terms],
                            columns=["term", "part", "df1", "df2", "epsilon", "ss", "ss_error", "f", "p", "ges", "reason"])
    inv = np.linalg.inv(xx)
    rows = []
    for part, c in (("between", np.full((w, 1), 1 / np.sqrt(w))), ("within", contrasts(w))):
        b = inv @ xy @ c
        error = c.T @ yy @ c - b.T @ (xy @ c)
        q = c.shape[1]
        eps = 1.0 if q == 1 else np.trace(error) ** 2 / (q * np.trace(error @ error))
        for name, at in terms:
            pos = [x.index(i) for i in at]
            h = b[pos].T @ np.linalg.solve(inv[np.ix_(pos, pos)], b[pos])
            ss, sse = float(np.trace(h)), float(np.trace(error))
            df1, df2 = len(pos) * q, left * q
            f = (ss / df1) / (sse / df2)
            rows.append((named(name, part), part, eps * df1, eps * df2, eps, ss, sse, f,
                         float(f_tail(f, eps * df1, eps * df2))))
    out = pd.DataFrame(rows, columns=["term", "part", "df1", "df2", "epsilon", "ss", "ss_error", "f", "p"])
    # Generalised eta squared: variation of measured (not manipulated) terms
    # belongs to the denominator.
    seen = out["term"].map(lambda t: bool(set(t.split(":")) & set(observed)))
    errors = out.groupby("part")["ss_error"].first().sum()
    measured = (out["ss"] * seen).sum()
    out["ges"] = out["ss"] / (out["ss"] + errors + measured - out["ss"] * seen)
    out["reason"] = None
    return out


def rm_ancova(
    wide: DataFrame, waves: Sequence[str], between: Mapping[str, Sequence | None],
    observed: Sequence[str] | None = None, by: Sequence[str] = (), within: str = "time",
) -> DataFrame:
    """Tests of time, the between terms and all their interactions.

    ``between`` maps each term to its levels, or to None for a covariate.
    Covariates enter as they are, so scale them first. Subjects missing a wave
    or a term are left out. With ``by``, every subgroup gets its own model from
    the same pass; where the design cannot be fitted (too few subjects, a factor
    with one level), figures are missing and ``reason`` says why.
    """
    observed = list(between) if observed is None else list(observed)
    codes: list[Column] = []
    places: dict[str, list[int]] = {}
    for name, levels in between.items():
        coded = _codes(name, levels)
        places[name] = list(range(len(codes), len(codes) + len(coded)))
        codes += coded
    factors: list[tuple[int, ...]] = []
    terms: list[tuple[str, list[int]]] = [("(Intercept)", [0])]
    for size in range(1, len(between) + 1):
        for chosen in combinations(between, size):
            columns = list(product(*[places[t] for t in chosen]))
            terms.append((":".join(chosen), list(range(len(factors) + 1, len(factors) + len(columns) + 1))))
            factors += columns
    n_codes, n_waves = len(codes), len(waves)

    def design(x: np.ndarray) -> np.ndarray:
        products = [np.prod(x[:, list(f)], axis=1) for f in factors]
        return np.column_stack([*products, x[:, n_codes:]])

    width = len(factors) + n_waves
    at_waves = list(range(len(factors) + 1, width + 1))
    names = [f"_c{i}" for i in range(n_codes)]
    rows = wide.select(*by, *[c.alias(n) for n, c in zip(names, codes)], *waves)
    cols = [*names, *waves]
    sums = cross_products(rows, cols, by, [0.0] * len(cols), design, width)
    keys = list(by)
    schema = T.StructType([sums.schema[b] for b in keys] + list(T.StructType.fromDDL(RESULT)))

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = tests_from_moments(as_matrix(part, width), terms, at_waves, observed, within)
        for name, v in zip(keys, key):
            out[name] = v
        return out[[f.name for f in schema]]

    if keys:
        out = sums.groupBy(*keys).applyInPandas(finish, schema)
    else:
        out = sums.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda part: finish((), part), schema)
    return out.withColumns({f.name: F.nanvl(f.name, F.lit(None)) for f in T.StructType.fromDDL(RESULT) if f.dataType == T.DoubleType()})

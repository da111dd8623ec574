"""Pieces of SQL for statistics DuckDB has no function for."""

from __future__ import annotations

from collections.abc import Sequence

NORMAL = 1.959963984540054


def _simpson(weight_of: str, upper: str, steps: int) -> str:
    return (
        f"({upper}) / {steps} / 3 * list_sum([(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
        f" * {weight_of} FOR i IN range(0, {steps + 1})])"
    )


def p_t(t: str, df: str, steps: int = 1000) -> str:
    """Two-sided p of t by numeric integration of the density."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    area = _simpson(f"pow(cos({angle} * i / {steps}), ({df}) - 1)", angle, steps)
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi()) * {area})"


def p_f(f: str, d1: str, d2: str, steps: int = 20000) -> str:
    """Upper p of F by numeric integration of the density."""
    angle = f"asin(sqrt(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2}))))"
    area = _simpson(
        f"pow(sin({angle} * i / {steps}), ({d1}) - 1) * pow(cos({angle} * i / {steps}), ({d2}) - 1)", angle, steps
    )
    front = f"2 * exp(lgamma((({d1}) + ({d2})) / 2) - lgamma(({d1}) / 2) - lgamma(({d2}) / 2))"
    return f"(1 - {front} * {area})"


def corr_test(a: str, b: str, x: str, y: str, keys: Sequence[str] = ()) -> str:
    """Select list of a correlation test on columns ``a`` and ``b``."""
    both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    head = "".join(f"{k}, " for k in keys)
    return f"{head}'{x}' AS x, '{y}' AS y, corr({a}, {b}) AS r, count(*) {both} AS n"


def finish_corr(inner: str, keys: Sequence[str] = (), digits: int = 6) -> str:
    head = "".join(f"{k}, " for k in keys)
    return f"""
    SELECT {head}x, y, round(r, {digits}) AS r, n, CAST(n - 2 AS DOUBLE) AS df,
           round(r * sqrt(n - 2) / sqrt(1 - r * r), {digits}) AS t,
           round((exp(2 * (atanh(r) - {NORMAL} / sqrt(n - 3))) - 1) / (exp(2 * (atanh(r) - {NORMAL} / sqrt(n - 3))) + 1), {digits}) AS lo,
           round((exp(2 * (atanh(r) + {NORMAL} / sqrt(n - 3))) - 1) / (exp(2 * (atanh(r) + {NORMAL} / sqrt(n - 3))) + 1), {digits}) AS hi,
           round({p_t('r * sqrt(n - 2) / sqrt(1 - r * r)', 'n - 2')}, {digits}) AS p
    FROM ({inner})"""


def orthogonal(source: str, cols: Sequence[str], prefix: str, over: str = "") -> tuple[list[str], str]:
    """CTEs that orthogonalise columns one after the other (Gram-Schmidt).

    Returns the CTEs and the name of the last; its columns are prefix1..k.
    """
    ctes, last = [], source
    for k, col in enumerate(cols, 1):
        minus = "".join(
            f" - {prefix}{j} * (sum(({col}) * {prefix}{j}) OVER ({over})) / (sum({prefix}{j} * {prefix}{j}) OVER ({over}))"
            for j in range(1, k)
        )
        ctes.append(f"{prefix}_{k} AS (SELECT *, ({col}){minus} AS {prefix}{k} FROM {last})")
        last = f"{prefix}_{k}"
    return ctes, last

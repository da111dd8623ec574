"""The numbers behind each figure."""

from __future__ import annotations

from ..operators import groups, plotdata
from ..stats import corr
from .aggregate_queries import CELL_SQL
from .registry import query, rounded
from .stat_queries import EIGEN_SQL, ITEMS, MATRIX_SQL


@query("g1_histogram", """
    SELECT c_mktsegment, treated, CAST(floor((n_orders + 0.5) / 1.0) AS DOUBLE) AS bin, count(*) AS n FROM twins GROUP BY ALL""")
def _(t):
    return plotdata.histogram(t.twins, "n_orders", 1.0, ["c_mktsegment", "treated"])


@query("g2_density_histogram", """
    SELECT event_type, bin, n, round(n / (sum(n) OVER (PARTITION BY event_type) * 2.5), 8) AS density
    FROM (SELECT event_type, floor((value + 1.25) / 2.5) * 2.5::DOUBLE AS bin, count(*) AS n FROM events GROUP BY ALL)""")
def _(t):
    return rounded(plotdata.density_histogram(t.events, "value", 2.5, ["event_type"]), 8)


@query("g3_box_stats", """
    WITH q AS (SELECT event_type AS k, quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1),
    m AS (SELECT *, value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM events JOIN q ON event_type = k)
    SELECT event_type, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, min(value) FILTER (inside) AS lower,
           max(value) FILTER (inside) AS upper, count(*) FILTER (NOT inside) AS n_outliers FROM m GROUP BY event_type, q25, median, q75""")
def _(t):
    return rounded(plotdata.box_stats(t.events, "value", ["event_type"]))


@query("g4_network_edges", f"SELECT x, y, n, round(r, 8) AS r FROM ({MATRIX_SQL}) WHERE abs(r) >= 0.003")
def _(t):
    return rounded(corr.network_edges(t.items, ITEMS, 0.003), 8)


@query("g5_cell_intervals", f"SELECT wave, c_mktsegment, {CELL_SQL.format(v='max_price')} FROM panel GROUP BY wave, c_mktsegment")
def _(t):
    return rounded(groups.cell_means(t.panel, "max_price", ["wave", "c_mktsegment"]), 4)


@query("g6_density_curve", """
    WITH q AS (SELECT event_type AS k, count(*) AS n, stddev_samp(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
                      min(value) AS lo, max(value) AS hi FROM events WHERE isfinite(value) GROUP BY 1),
    s AS (SELECT *, 0.9 * coalesce(CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) END, nullif(sd, 0), nullif(abs(lo), 0), 1)
                 * pow(n, -0.2::DOUBLE) AS bw, (hi - lo) / 63 AS gap FROM q),
    b AS (SELECT k, n, lo, bw, gap, floor((value - lo) / (bw / 16)) AS bin, count(*) AS w, avg(value) - any_value(lo) AS c FROM events JOIN s ON event_type = k GROUP BY ALL),
    g AS (SELECT s.*, CAST(p AS INT) AS point, lo + p * gap AS x FROM s, (SELECT unnest(range(0, 64)) AS p))
    SELECT g.k AS event_type, point, round(x, 6) AS x, round(coalesce(sum(w * exp(-pow((point * g.gap - c) / g.bw, 2) / 2)
             / sqrt(2 * pi()) / (g.n * g.bw)) FILTER (abs(point * g.gap - c) <= 8 * g.bw), 0), 8) AS density
    FROM g LEFT JOIN b ON g.k = b.k GROUP BY g.k, point, x""")
def _(t):
    return rounded(plotdata.density_curve(t.events, "value", ["event_type"]), 8, x=6)


@query("g9_scree_table", EIGEN_SQL + "SELECT k, round(eigenvalue, 6) AS eigenvalue, round(eigenvalue / 3, 6) AS share FROM v")
def _(t):
    return rounded(corr.factor_screen(t.items, ["i1", "i4", "i5"]).select("k", "eigenvalue", "share"))

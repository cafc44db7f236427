"""Ranks, quantiles, moments, densities and tail diagnostics of one column, per group.

Exact order statistics come from the distinct values with running counts
(``rank_values``) or from numbered rows (``number_rows``); both are balanced scans.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from orderweave.functions.columns import kolmogorov_tail, normal_cdf, normal_quantile
from orderweave.operators.scan import Chunks, attach
from orderweave.session import pin, sql


def rank_values(df: DataFrame, by, column: str) -> DataFrame:
    """Distinct non-null values: ``x``, copies ``n``, rows strictly below ``below``, rows of the group ``total``."""
    keys = ", ".join(by)
    values = sql(
        f"""select {keys}, {column} as x, count(*) as n from {{df}}
            where {column} is not null group by {keys}, {column}""",
        df=df,
    )
    counted = Chunks(values, by, ["x"], "values").scan(sums={"upto": "n"}, totals={"total": "n"})
    return counted.selectExpr(*by, "x", "n", "upto - n as below", "total")


def number_rows(df: DataFrame, by, order, tag: str = "numbered") -> DataFrame:
    """Rows with their 1-based ``row_no`` in ``order`` and the group size ``total``."""
    taken = {"row_no", "total"} & set(df.columns)
    if taken:
        raise ValueError(f"column(s) {sorted(taken)} would be overwritten")
    return Chunks(df, by, order, tag).scan(sums={"row_no": "1L"}, totals={"total": "1L"}).drop("_chunk")


def quantiles(ranked: DataFrame, by, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``wanted``, and the group size ``total``."""
    picks, results = [], []
    for name, q in wanted.items():
        place = f"{q}D * (total - 1)"
        picks.append(f"min(x) filter (where below + n > floor({place})) as _lo_{name}")
        picks.append(f"min(x) filter (where below + n > ceil({place})) as _hi_{name}")
        results.append(f"_lo_{name} + (_hi_{name} - _lo_{name}) * ({place} - floor({place})) as {name}")
    keys = ", ".join(by)
    return sql(
        f"""select {keys}, {", ".join(results)}, total from (
              select {keys}, max(total) as total, {", ".join(picks)} from {{ranked}} group by {keys})""",
        ranked=ranked,
    )


def moments(df: DataFrame, by, column: str) -> DataFrame:
    """Count, range, mean, sample deviation, population skewness and excess kurtosis, with the two flags."""
    keys = ", ".join(by)
    return sql(
        f"""
        select *, kurt > 1 as heavy_tails, skew > 0.5 as right_skew from (
          select {keys}, count({column}) as n, min({column}) as low, max({column}) as high,
            avg({column}) as mean, stddev_samp({column}) as sd,
            nullif(skewness({column}), double('NaN')) as skew, nullif(kurtosis({column}), double('NaN')) as kurt
          from {{df}} group by {keys})
        """,
        df=df,
    )


def density_hist(df: DataFrame, by, column: str, bins: int, above: float | None = None) -> DataFrame:
    """Density histogram between the extremes (one unit wide if they are equal); the last bin is closed.
    ``above`` keeps the values beyond that quantile. Works on distinct values with their counts."""
    keys = ", ".join(by)
    values = rank_values(df, by, column)
    if above is not None:
        floor = quantiles(values, by, {"floor_value": above})
        values = attach(values, floor, by, ["floor_value"], "x", rows="total").where("x > floor_value")
    span = sql(
        f"""
        select {keys}, n_used, n_values, if(high = low, low - 0.5, low) as low,
          (if(high = low, high + 0.5, high) - if(high = low, low - 0.5, low)) / {bins} as width
        from (select {keys}, min(x) as low, max(x) as high, sum(n) as n_used, count(*) as n_values
              from {{values}} group by {keys})
        """,
        values=values,
    )
    return sql(
        f"""
        select {keys}, bin, sum(n) as n_rows, min(low) + bin * min(width) as left_edge,
          sum(n) / (min(n_used) * min(width)) as density
        from (select *, cast(least(floor((x - low) / width), {bins - 1}) as int) as bin from {{placed}})
        group by {keys}, bin
        """,
        placed=attach(values, span, by, ["low", "width", "n_used"], "x", rows="n_values"),
    )


#: Moments of a cell, and bandwidths beyond which a kernel counts for nothing (it is below 1e-19 there).
TERMS, REACH = 14, 9.5


def kde(ranked: DataFrame, by, points: int, high_q: float | None = None, low_q: float | None = None) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid, beside the normal density of the
    same mean and deviation.

    The grid runs from the minimum to the ``high_q`` quantile (or maximum). With ``low_q`` only values
    above that quantile are used and the grid starts there; the normal reference still describes all
    values.

    The kernel sums are a fast Gauss transform: values are put into cells of half a bandwidth, each cell keeps TERMS moments
    about its centre, and a grid point within REACH bandwidths of it gets their Hermite series. Moments are added up
    before the shuffle, and after it the work is that of cells and grid, not of values; the error of the density times the
    bandwidth is below 1e-12."""
    used, shape = _kde_shape(ranked, by, high_q, low_q)
    grid = _kde_grid(shape, by, points)
    keys = ", ".join(by)
    moments = [f"sum(n * pow(u, {k})) / {math.factorial(k)} as m{k}" for k in range(TERMS)]
    # the series by powers of the distance: coefficients of the Hermite polynomials, gathered by power
    hermite = [[1], [0, 1]]
    for k in range(1, TERMS - 1):
        a, b = [0, *hermite[k]], [*(k * c for c in hermite[k - 1]), 0, 0]
        hermite.append([x - y for x, y in zip(a, b)])
    by_power = [" + ".join(f"{hermite[k][j]} * m{k}" for k in range(j, TERMS) if hermite[k][j]) + f" as c{j}" for j in range(TERMS)]
    horner = f"c{TERMS - 1}"
    for j in range(TERMS - 2, -1, -1):
        horner = f"(c{j} + v * {horner})"
    sums = sql(
        f"""
        with placed as (
          select {keys}, n, cell, low, high, h, (x - low) / h - (cell + 0.5D) / 2 as u
          from (select *, floor((x - low) / h * 2) as cell from {{used}})
        ), cells as (
          select {keys}, cell, min(low) as low, min(h) as h, min((high - low) / {points - 1} / h) as step, {", ".join(moments)}
          from placed group by {keys}, cell
        ), series as (
          select {keys}, (cell + 0.5D) / 2 as centre, step, {", ".join(by_power)} from cells
        ), reached as (
          select *, explode(filter(if(step > 0, sequence(
              cast(greatest(0, ceil((centre - {REACH}) / step)) as int),
              cast(least({points - 1}, floor((centre + {REACH}) / step)) as int)), sequence(0, {points - 1})),
            p -> abs(p * step - centre) <= {REACH})) as point
          from series where centre + {REACH} >= 0 and centre - {REACH} <= {points - 1} * step
        )
        select {keys}, point, sum(exp(-0.5D * v * v) * {horner}) as kernel
        from (select *, point * step - centre as v from reached) group by {keys}, point
        """,
        used=used,
    )
    same = " and ".join([*[f"g.{k} <=> s.{k}" for k in by], "g.point = s.point"])
    return sql(
        f"""select {", ".join(f"g.{k}" for k in by)}, g.point, grid_x, coalesce(kernel, 0D) / (n_used * h * sqrt(2 * pi())) as density, normal_density
            from {{grid}} g left join {{sums}} s on {same}""",
        grid=grid,
        sums=sums,
    )


def normal_on_grid(ranked: DataFrame, by, points: int, high_q: float | None = None, low_q: float | None = None) -> DataFrame:
    """The grid of ``kde`` with the normal density of the same mean and deviation; no kernel is summed."""
    return _kde_grid(_kde_shape(ranked, by, high_q, low_q)[1], by, points).select(*by, "point", "grid_x", "normal_density")


def _kde_grid(shape: DataFrame, by, points: int) -> DataFrame:
    keys = ", ".join(by)
    return sql(
        f"""
        select {keys}, point, grid_x, n_used, h,
          exp(-0.5D * pow((grid_x - mean_all) / sd_all, 2)) / (sd_all * sqrt(2 * pi())) as normal_density
        from (select *, low + point * (high - low) / {points - 1} as grid_x
              from {{shape}} lateral view explode(sequence(0, {points - 1})) as point)
        """,
        shape=shape,
    )


def _kde_shape(ranked: DataFrame, by, high_q: float | None, low_q: float | None) -> tuple[DataFrame, DataFrame]:
    """The values used, with ends and bandwidth of their group, and a row of these for each group."""
    keys = ", ".join(by)
    wanted = {"q_low": low_q if low_q is not None else 0.0, "q_high": high_q if high_q is not None else 1.0}
    ends = quantiles(ranked, by, wanted)
    values = attach(ranked, ends, by, ["q_low", "q_high"], "x", rows="total").selectExpr(
        *by, "x", "n", "q_low", "q_high", "x > q_low as used" if low_q is not None else "true as used"
    )
    # two passes: centre first, then squares
    means = sql(
        f"""select {keys}, count(*) as n_values, sum(n) as n_all, sum(n * x) / sum(n) as mean_all,
              sum(n) filter (where used) as n_used,
              sum(n * x) filter (where used) / sum(n) filter (where used) as mean_used
            from {{values}} group by {keys}""",
        values=values,
    )
    centred = attach(values, means, by, ["n_all", "mean_all", "n_used", "mean_used"], "x", rows="n_values")
    shape = sql(
        f"""
        select * from (
          select {keys}, count(*) as n_values, min(q_low) as low, min(q_high) as high, min(mean_all) as mean_all,
            min(n_used) as n_used, sqrt(sum(n * pow(x - mean_all, 2)) / nullif(min(n_all) - 1, 0)) as sd_all,
            sqrt(sum(n * pow(x - mean_used, 2)) filter (where used) / nullif(min(n_used) - 1, 0))
              * pow(min(n_used), -0.2D) as h
          from {{centred}} group by {keys})
        where h > 0
        """,
        centred=centred,
    )
    shape = pin(shape, "shape")
    return attach(values.where("used"), shape, by, ["low", "high", "h"], "x", rows="n_values").where("h > 0"), shape


def ks_normal(ranked: DataFrame, moment: DataFrame, by) -> DataFrame:
    """Kolmogorov-Smirnov distance to the normal with the sample mean and deviation, asymptotic p-value."""
    keys = ", ".join(by)
    return sql(
        f"""
        with gaps as (
          select {keys}, total, below / total as before, (below + n) / total as after, {normal_cdf("z")} as cdf
          from (select *, (x - mean) / sd as z from {{scaled}} where sd > 0)
        ), distance as (
          select {keys}, max(total) as total, greatest(max(after - cdf), max(cdf - before)) as ks_stat
          from gaps group by {keys}
        )
        select {keys}, ks_stat, {kolmogorov_tail("t")} as p_value
        from (select *, sqrt(total) * ks_stat as t from distance)
        """,
        scaled=attach(ranked, moment, by, ["mean", "sd"], "x", rows="n"),
    )


def hill_index(ranked: DataFrame, by) -> DataFrame:
    """Hill tail index with k = max(50, 5 % of the rows). Null where k reaches the whole sample or a
    value in the tail is not positive."""
    keys = ", ".join(by)
    return sql(
        f"""
        with tail as (
          select {keys}, x, total, greatest(50L, cast(floor(0.05D * total) as bigint)) as k,
            n, total - below - n as above
          from {{ranked}}
        ), cut as (
          select {keys}, min(total) as total, min(k) as k,
            sum(if(above < k, least(n, k - above) * ln(nullif(greatest(x, 0), 0)), 0)) as log_top,
            min(x) filter (where above <= k) as threshold
          from tail group by {keys}
        )
        select {keys}, k, if(total > k and threshold > 0, 1 / (log_top / k - ln(threshold)), null) as hill_alpha
        from cut
        """,
        ranked=ranked,
    )


def hill_curve(df: DataFrame, by, column: str, first: int = 20, last: int = 500) -> DataFrame:
    """Hill index for k = first .. min(15 % of the rows, last) - 1, from the ``last`` + 1 largest values.

    The row_number filter is applied per task before the shuffle, so at most ``last`` rows of a
    group leave each task."""
    keys = ", ".join(by)
    return sql(
        f"""
        with sizes as (select {keys}, count(*) as total from {{df}} where {column} is not null group by {keys}),
        logs as (
          select {keys}, r, x, avg(ln(nullif(greatest(x, 0), 0)))
              over (partition by {keys} order by r rows between unbounded preceding and 1 preceding) as mean_log
          from {{top}}
        )
        select {keys}, cast(r - 1 as int) as k, 1 / nullif(mean_log - ln(x), 0) as hill_alpha
        from logs join sizes using ({keys})
        where r - 1 >= {first} and r - 1 < least(floor(0.15D * total), {last}) and x > 0
        """,
        df=df,
        top=top_values(df, by, column, last),
    )


def ccdf_tail(df: DataFrame, by, column: str, ties, above: float = 0.7) -> DataFrame:
    """Descending rank share of every value beyond the ``above`` quantile, and the power law through the
    largest one with the Hill index."""
    keys = ", ".join(by)
    rows = df.where(f"{column} is not null").selectExpr(*by, f"-{column} as neg", *ties)
    numbered = number_rows(rows, by, ["neg", *ties], "tail")
    ranked = pin(rank_values(df, by, column), "ranks")
    law = sql(
        f"""
        select {keys}, f.total, floor_value, top_x, hill_alpha
        from {{floor}} f join {{hill}} using ({keys})
          join (select {keys}, max(x) as top_x from {{ranked}} group by {keys}) using ({keys})
        """,
        floor=quantiles(ranked, by, {"floor_value": above}),
        hill=hill_index(ranked, by),
        ranked=ranked,
    )
    placed = attach(numbered.drop("total"), law, by, ["total", "floor_value", "top_x", "hill_alpha"], "row_no", rows="total")
    return placed.where("-neg > floor_value").selectExpr(
        *by, "row_no", "-neg as x", "row_no / total as ccdf", "1 / total * pow(-neg / top_x, -hill_alpha) as power_law"
    )


def qq_points(df: DataFrame, by, column: str, ties) -> DataFrame:
    """Sorted values against normal quantiles of Filliben's medians."""
    keys = ", ".join(by)
    rows = df.where(f"{column} is not null").selectExpr(*by, f"{column} as x", *ties)
    numbered = number_rows(rows, by, ["x", *ties], "qq")
    return sql(
        f"""
        select {keys}, row_no, x, {normal_quantile("p")} as q from (
          select *, case when row_no = total then pow(0.5D, 1D / total)
                         when row_no = 1 then 1 - pow(0.5D, 1D / total)
                         else (row_no - 0.3175D) / (total + 0.365D) end as p
          from {{numbered}})
        """,
        numbered=numbered,
    )


def qq_normal(points: DataFrame, by) -> DataFrame:
    """Least-squares line of the Q-Q points and its correlation."""
    keys = ", ".join(by)
    return sql(
        f"""select {keys}, regr_slope(x, q) as slope, regr_intercept(x, q) as intercept, covar_pop(x, q) / nullif(stddev_pop(x) * stddev_pop(q), 0) as r
            from {{points}} group by {keys}""",
        points=points,
    )


def top_values(df: DataFrame, by, column: str, k: int) -> DataFrame:
    """The ``k`` largest values of each group, numbered from the largest; cut per task before the shuffle."""
    keys = ", ".join(by)
    return sql(
        f"""select * from (
              select {keys}, {column} as x, row_number() over (partition by {keys} order by {column} desc) as r
              from {{df}} where {column} is not null)
            where r <= {k}""",
        df=df,
    )

"""Dependence of fill probability on distance: rolling rate, ranks, copula summaries, principal axes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderweave.operators.distribution import number_rows, quantiles, rank_values
from orderweave.operators.scan import Chunks, attach
from orderweave.session import pin, sql

_PAIR_ORDER = ["ts", "order_id", "session_id", "price", "size"]
_BLOCK = 50_000


def rolling_fill_rate(orders: DataFrame, by, window: int = 500, min_rows: int = 50) -> DataFrame:
    """Centred moving share of filled orders in time order; null below ``min_rows`` rows.

    Numbered rows are cut into blocks, and each block borrows the few rows it needs from its neighbours. What lies in a
    row's window is the difference of two running counts, so the cost of a row does not follow ``window``."""
    keys = ", ".join(by)
    back, ahead = window // 2, window - window // 2 - 1
    assert _BLOCK > window
    numbered = number_rows(orders, by, _PAIR_ORDER, "orders")
    return sql(
        f"""
        with homes as (
          select *, (row_no - 1) div {_BLOCK} as home, (row_no - 1) % {_BLOCK} as place from {{numbered}}
        ), shared as (
          select *, explode(filter(array(home,
              if(place < {ahead}, home - 1, null), if(place >= {_BLOCK} - {back}, home + 1, null)),
            b -> b is not null)) as block
          from homes
        ), counted as (
          select *, coalesce(sum(filled) over so_far, 0) as filled_so_far, count(filled) over so_far as seen_so_far from shared
          window so_far as (partition by {keys}, block order by row_no rows between unbounded preceding and current row)
        ), edges as (
          select *, struct(filled_so_far as filled, seen_so_far as seen) as upto,
            last(struct(filled_so_far as filled, seen_so_far as seen)) over (partition by {keys}, block order by row_no
              rows between unbounded preceding and unbounded following) as whole from counted
        ), spans as (
          select *, lead(upto, {ahead}, null) over in_order as high, lag(upto, {back} + 1, null) over in_order as low from edges
          window in_order as (partition by {keys}, block order by row_no)
        ), averaged as (
          select *, coalesce(high.seen, whole.seen) - coalesce(low.seen, 0) as seen,
            (coalesce(high.filled, whole.filled) - coalesce(low.filled, 0)) / nullif(coalesce(high.seen, whole.seen) - coalesce(low.seen, 0), 0) as rate
          from spans
        )
        select {keys}, row_no, ts, order_id, session_id, price, size, filled, abs_dist,
          if(seen >= {min_rows}, rate, null) as fill_prob
        from averaged where block = home
        """,
        numbered=numbered,
    )


def pair_frame(orders: DataFrame, by, cut: float = 0.995) -> DataFrame:
    """(distance, rolling fill rate) per order, without nulls, up to the ``cut`` quantile of distance."""
    pairs = pin(
        rolling_fill_rate(orders, by).where("abs_dist is not null and fill_prob is not null"), "rolling"
    )
    limit = quantiles(rank_values(pairs, by, "abs_dist"), by, {"top": cut})
    kept = attach(pairs, limit, by, ["top"], "row_no", rows="total").where("abs_dist <= top")
    return kept.selectExpr(*by, "row_no", "abs_dist as x", "fill_prob as y")


def average_ranks(pairs: DataFrame, by) -> DataFrame:
    """Pairs with tie-averaged ranks ``rx`` and ``ry`` and the group size ``total``."""
    out = pairs
    for column, rank in (("x", "rx"), ("y", "ry")):
        values = rank_values(pairs, by, column).selectExpr(
            *by, f"x as {column}" if column == "x" else "x as y", "n as n_rows",
            f"below + (n + 1) / 2 as {rank}", "total" if column == "x" else "total as total_y",
        )
        wanted = [rank, "total"] if column == "x" else [rank]
        out = attach(out, values, [*by, column], wanted, "row_no")
    return out


def _corr(a: str, b: str) -> str:
    """Correlation, null where one side is constant."""
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def spearman(ranks: DataFrame, by) -> DataFrame:
    """Correlation of the average ranks."""
    keys = ", ".join(by)
    return sql(f"select {keys}, {_corr('rx', 'ry')} as spearman from {{ranks}} group by {keys}", ranks=ranks)


#: Bits of a digit in ``kendall``: a point makes a row for each digit of its rank, with a count for each of its 16 values.
DIGIT = 4


def kendall(pairs: DataFrame, by) -> DataFrame:
    """Kendall's tau-b, exact, without comparing pairs of rows.

    Pairs that fall in one order and rise in the other first differ in one digit of the dense rank of y. So each
    point is counted once per digit (of DIGIT bits) under its higher digits: with x rising, every digit meets the larger
    ones seen before it, of which one row keeps the counts."""
    keys = ", ".join(by)
    points = pin(
        sql(f"select {keys}, x, y, count(*) as n from {{pairs}} group by {keys}, x, y", pairs=pairs), "points"
    )
    sizes = sql(f"select {keys}, y, sum(n) as n_rows from {{points}} group by {keys}, y", points=points)
    levels = Chunks(sizes, by, ["y"], "y-values").scan(sums={"place": "1L"}, totals={"n_levels": "1L"})
    placed = attach(points, levels, [*by, "y"], ["place", "n_levels"], "x")
    counts = [f"sum(if(shiftright(place, {DIGIT} * level) & {(1 << DIGIT) - 1}L = {d}, n, 0L)) as n{d}" for d in range(1 << DIGIT)]
    split = sql(
        f"""
        with bits as (
          select {keys}, x, n, place - 1 as place,
            explode(sequence(0, cast(floor(log2(n_levels - 0.5D) / {DIGIT}) as int))) as level
          from {{placed}} where n_levels > 1
        )
        select {keys}, level, shiftright(place, {DIGIT} * (level + 1)) as node, x, {", ".join(counts)}
        from bits group by {keys}, level, shiftright(place, {DIGIT} * (level + 1)), x
        """,
        placed=placed,
    )
    # what a digit meets: the larger ones of smaller x
    met = Chunks(split, [*by, "level", "node"], ["x"], "digits").scan(sums={f"upto{d}": f"n{d}" for d in range(1, 1 << DIGIT)})
    larger, terms = "", []
    for d in range((1 << DIGIT) - 1, 0, -1):
        larger = f"({larger}{' + ' if larger else ''}upto{d} - n{d})"
        terms.append(f"cast(n{d - 1} as double) * {larger}")
    return sql(
        f"""
        with discordant as (
          select {keys}, sum({" + ".join(terms)}) as n_dis from {{met}} group by {keys}
        ), x_ties as (
          select {keys}, sum(n * (n - 1) / 2) as t from (select {keys}, cast(sum(n) as double) as n
            from {{points}} group by {keys}, x) group by {keys}
        ), y_ties as (
          select {keys}, sum(n * (n - 1) / 2) as t from (select {keys}, cast(sum(n) as double) as n
            from {{points}} group by {keys}, y) group by {keys}
        ), both_ties as (
          select {keys}, sum(cast(n as double) * (n - 1) / 2) as t, cast(sum(n) as double) as rows
          from {{points}} group by {keys}
        )
        select {keys},
          (rows * (rows - 1) / 2 - x.t - y.t + b.t - 2 * coalesce(n_dis, 0))
            / nullif(sqrt(rows * (rows - 1) / 2 - x.t) * sqrt(rows * (rows - 1) / 2 - y.t), 0) as kendall
        from both_ties b join x_ties x using ({keys}) join y_ties y using ({keys})
          left join discordant using ({keys})
        """,
        met=met,
        points=points,
    )


def pseudo_obs(ranks: DataFrame, by) -> DataFrame:
    """Ranks scaled into (0, 1)."""
    return ranks.selectExpr(*by, "row_no", "rx / (total + 1) as u", "ry / (total + 1) as v")


def copula_density(uv: DataFrame, by, bins: int = 40) -> DataFrame:
    """Two-way density histogram of (u, v) between their extremes, non-empty cells; last bins closed."""
    keys = ", ".join(by)
    span = sql(
        f"""select {keys}, count(*) as n, min(u) as u0, (max(u) - min(u)) / {bins} as du,
              min(v) as v0, (max(v) - min(v)) / {bins} as dv
            from {{uv}} group by {keys}""",
        uv=uv,
    )
    placed = attach(uv, span, by, ["n", "u0", "du", "v0", "dv"], "row_no", rows="n").where("du > 0 and dv > 0")
    return sql(
        f"""
        select {keys}, u_bin, v_bin, count(*) as n_rows, count(*) / (min(n) * min(du * dv)) as density
        from (select *, cast(least(floor((u - u0) / du), {bins - 1}) as int) as u_bin,
                cast(least(floor((v - v0) / dv), {bins - 1}) as int) as v_bin from {{placed}})
        group by {keys}, u_bin, v_bin
        """,
        placed=placed,
    )


def copula_parameters(rho: DataFrame, tau: DataFrame, by) -> DataFrame:
    """Gaussian parameter from Spearman's rho, Gumbel parameter from Kendall's tau, and a verdict in words."""
    keys = ", ".join(by)
    return sql(
        f"""
        select {keys}, spearman, kendall, 2 * sin(pi() * spearman / 6) as gauss_theta,
          if(kendall is null, null, 1 / greatest(1e-6D, 1 - kendall)) as gumbel_theta,
          case when spearman < -0.3 then 'strong negative' when spearman < 0 then 'weak negative'
               else 'positive or none' end as dependence
        from {{rho}} join {{tau}} using ({keys})
        """,
        rho=rho,
        tau=tau,
    )


def sample_rows(df: DataFrame, n: int, identity, seed: int = 42) -> DataFrame:
    """Uniform sample of ``n`` rows without replacement, the same on every run and in every engine: those of
    smallest MD5 over the seed and the text of their ``identity``."""
    key = ", ".join(identity)
    return sql(f"select * from {{df}} order by md5(concat_ws('|', '{seed}', {key})), {key} limit {n}", df=df)


# --------------------------------------------------------- principal axes ----


def mean_cov(df: DataFrame, by, a: str, b: str) -> DataFrame:
    """Size, means, variances and covariance (n - 1) of two columns."""
    keys = ", ".join(by)
    return sql(
        f"""select {keys}, count(*) as n, avg({a}) as mean_a, avg({b}) as mean_b, var_samp({a}) as var_a,
              var_samp({b}) as var_b, covar_samp({a}, {b}) as cov_ab
            from {{df}} where {a} is not null and {b} is not null group by {keys}""",
        df=df,
    )


def trimmed_mean(df: DataFrame, by, column: str, share: float = 0.05) -> DataFrame:
    """Mean without the ``share`` smallest and largest rows; ties are cut by count."""
    keys = ", ".join(by)
    return sql(
        f"""
        select {keys}, sum(x * kept) / sum(kept) as trimmed from (
          select {keys}, x, greatest(0, least(below + n, total - k) - greatest(below, k)) as kept
          from (select *, cast(floor({share}D * total) as bigint) as k from {{ranked}}))
        group by {keys}
        """,
        ranked=rank_values(df, by, column),
    )


def trimmed_mean_cov(df: DataFrame, by, a: str, b: str, share: float = 0.05) -> DataFrame:
    """Trimmed means, and the covariance of all rows about them."""
    keys = ", ".join(by)
    return sql(
        f"""
        select {keys}, n, a.trimmed as mean_a, b.trimmed as mean_b,
          var_a + n / (n - 1) * pow(mean_a - a.trimmed, 2) as var_a,
          var_b + n / (n - 1) * pow(mean_b - b.trimmed, 2) as var_b,
          cov_ab + n / (n - 1) * (mean_a - a.trimmed) * (mean_b - b.trimmed) as cov_ab
        from {{plain}} join {{ta}} a using ({keys}) join {{tb}} b using ({keys})
        """,
        plain=mean_cov(df, by, a, b),
        ta=trimmed_mean(df, by, a, share),
        tb=trimmed_mean(df, by, b, share),
    )


def pca_2d(cov: DataFrame, by) -> DataFrame:
    """Eigenvalues (descending), first eigenvector (first component not negative) and its share of variance."""
    keys = ", ".join(by)
    return sql(
        f"""
        with roots as (
          select *, (var_a + var_b) / 2 as half, sqrt(pow((var_a - var_b) / 2, 2) + cov_ab * cov_ab) as spread
          from {{cov}}
        ), axes as (
          select *, half + spread as eig1, half - spread as eig2,
            case when cov_ab = 0 and var_a >= var_b then 1D when cov_ab = 0 then 0D
                 when var_a >= var_b then (var_a - var_b) / 2 + spread else abs(cov_ab) end as ax,
            case when cov_ab = 0 and var_a >= var_b then 0D when cov_ab = 0 then 1D
                 when var_a >= var_b then cov_ab else sign(cov_ab) * ((var_b - var_a) / 2 + spread) end as ay
          from roots
        )
        select {keys}, n, mean_a, mean_b, var_a, var_b, cov_ab, eig1, eig2,
          ax / sqrt(ax * ax + ay * ay) as pc1_a, ay / sqrt(ax * ax + ay * ay) as pc1_b,
          eig1 / nullif(eig1 + eig2, 0) as pve1
        from axes
        """,
        cov=cov,
    )


def confidence_ellipses(pca: DataFrame, by) -> DataFrame:
    """Centre, width, height and angle in degrees of the 1, 2 and 3 sigma ellipses."""
    return pca.selectExpr(
        *by, "mean_a", "mean_b", "explode(array(1, 2, 3)) as n_std", "eig1", "eig2", "pc1_a", "pc1_b"
    ).selectExpr(
        *by, "n_std", "mean_a as centre_a", "mean_b as centre_b",
        "2 * n_std * sqrt(eig1) as width", "2 * n_std * sqrt(greatest(eig2, 0)) as height",
        "degrees(atan2(pc1_b, pc1_a)) as angle",
    )


def pc1_scores(df: DataFrame, pca: DataFrame, by, a: str, b: str, identity) -> DataFrame:
    """Projection of every row onto the first axis."""
    placed = attach(df, pca, by, ["mean_a", "mean_b", "pc1_a", "pc1_b"], ", ".join(identity), rows="n")
    return placed.selectExpr(*by, *identity, f"({a} - mean_a) * pc1_a + ({b} - mean_b) * pc1_b as score")


# ------------------------------------------------------------ multivariate ----


def mahalanobis(df: DataFrame, cov: DataFrame, by, a: str, b: str, identity) -> DataFrame:
    """Distance of every row from the mean in units of the covariance."""
    placed = attach(df, cov, by, ["mean_a", "mean_b", "var_a", "var_b", "cov_ab"], ", ".join(identity), rows="n")
    return placed.selectExpr("*", f"{a} - mean_a as da", f"{b} - mean_b as db").selectExpr(
        *by,
        *identity,
        """sqrt((var_b * da * da - 2 * cov_ab * da * db + var_a * db * db)
             / nullif(var_a * var_b - cov_ab * cov_ab, 0)) as distance""",
    )


def portfolio_moments(cov: DataFrame, by, wa: float, wb: float) -> DataFrame:
    """Mean, variance and volatility of the weighted sum."""
    variance = f"({wa * wa}D * var_a + {2 * wa * wb}D * cov_ab + {wb * wb}D * var_b)"
    return cov.selectExpr(
        *by, f"{wa}D * mean_a + {wb}D * mean_b as mean", f"{variance} as variance", f"sqrt({variance}) as volatility"
    )


def linear_projection(df: DataFrame, by, x: str, z: str, identity) -> DataFrame:
    """Best linear prediction of ``x`` from ``z`` and what it leaves."""
    keys = ", ".join(by)
    line = sql(
        f"""select {keys}, count(*) as n, regr_slope({x}, {z}) as beta, regr_intercept({x}, {z}) as alpha
            from {{df}} group by {keys}""",
        df=df,
    )
    fitted = attach(df, line, by, ["alpha", "beta"], ", ".join(identity), rows="n")
    return fitted.selectExpr(
        *by, *identity, f"alpha + beta * {z} as projected", f"{x} - alpha - beta * {z} as residual"
    )


def residual_corr(df: DataFrame, by, x1: str, x2: str, z: str) -> DataFrame:
    """Correlation of two columns, and of what ``z`` leaves of them (from their mutual correlations)."""
    keys = ", ".join(by)
    return sql(
        f"""
        select {keys}, c12 as corr_raw,
          (c12 - c1 * c2) / nullif(sqrt(1 - c1 * c1) * sqrt(1 - c2 * c2), 0) as corr_residual
        from (select {keys}, {_corr(x1, x2)} as c12, {_corr(x1, z)} as c1, {_corr(x2, z)} as c2
              from {{df}} where {x1} is not null and {x2} is not null and {z} is not null group by {keys})
        """,
        df=df,
    )

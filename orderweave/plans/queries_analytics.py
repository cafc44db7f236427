"""Fill-probability, distribution, dependence and multivariate queries."""

from __future__ import annotations

from orderweave.functions.columns import kolmogorov_tail, normal_cdf, normal_quantile
from orderweave.operators import dependence as dep
from orderweave.operators import distribution as dist
from orderweave.operators import microstructure as micro
from orderweave.operators import smooth
from orderweave.operators import summary
from orderweave.plans import oracle as o
from orderweave.plans.catalog import query
from orderweave.plans.derived import (
    BY,
    events_q,
    filled_q,
    lineitem,
    log_pairs_q,
    orders_q,
    pairs_q,
    pca_q,
    ranks_q,
)

_TIES = ["ts", "order_id", "session_id", "price", "size"]
_LINE = ["l_orderkey", "l_linenumber"]


def _orders(select: str) -> str:
    return f"WITH RECURSIVE {o.EVENTS_Q}, {o.ORDERS} {select}"


def _pairs(select: str) -> str:
    return _orders(f", {o.PAIRS} {select}")


def _ranks(select: str) -> str:
    return _orders(f", {o.PAIRS}, {o.RANKS} {select}")


def _pca(select: str) -> str:
    return _orders(f", {o.PAIRS}, {o.PCA} {select}")


_ITEMS = """items AS (SELECT l_returnflag AS symbol, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount
  FROM lineitem)"""


def _items(select: str) -> str:
    return f"WITH {_ITEMS} {select}"


# ------------------------------------------------------ midprice and labels ----


@query(
    "midprice",
    _orders("SELECT symbol, ts, best_bid, best_ask, (best_bid + best_ask) / 2 AS midprice FROM mids"),
    "best_bid best_ask midprice",
)
def midprice(spark, sf):
    return micro.midprice_timeline(events_q(spark, sf), BY).select("symbol", "ts", "best_bid", "best_ask", "midprice")


@query("win_ffill", _orders("SELECT symbol, ts, best_bid, best_ask FROM mids"), "best_bid best_ask")
def win_ffill(spark, sf):
    return micro.midprice_timeline(events_q(spark, sf), BY).select("symbol", "ts", "best_bid", "best_ask")


@query(
    "abs_dist",
    _orders("SELECT symbol, order_id, session_id, ts, price, size, midprice, abs_dist FROM placed"),
    "price size midprice abs_dist",
)
def abs_dist(spark, sf):
    return orders_q(spark, sf).select("symbol", "order_id", "session_id", "ts", "price", "size", "midprice", "abs_dist")


@query(
    "abs_dist_bps", _orders("SELECT symbol, order_id, session_id, ts, price, abs_dist_bps FROM placed"),
    "price abs_dist_bps",
)
def abs_dist_bps(spark, sf):
    return orders_q(spark, sf).select("symbol", "order_id", "session_id", "ts", "price", "abs_dist_bps")


@query("filled_label", _orders("SELECT symbol, order_id, session_id, ts, price, filled FROM placed"), "price")
def filled_label(spark, sf):
    return orders_q(spark, sf).select("symbol", "order_id", "session_id", "ts", "price", "filled")


@query(
    "fill_rate_overall",
    _orders("""SELECT symbol, count(*) AS n_total, CAST(sum(filled) AS BIGINT) AS n_filled, avg(filled) AS fill_rate
               FROM placed GROUP BY symbol"""),
    "fill_rate",
)
def fill_rate_overall(spark, sf):
    return micro.fill_rate(orders_q(spark, sf), BY)


def _bins_twin(column: str, width: float) -> str:
    return f""", top AS (SELECT symbol, ceil(quantile_cont({column}, 0.995) / {width}) * {width} AS edge
        FROM placed GROUP BY symbol),
      bins AS (
        SELECT symbol, CAST(floor({column} / {width}) AS BIGINT) AS bin, avg(filled) AS fill_rate, count(*) AS n_total,
          CAST(sum(filled) AS BIGINT) AS n_filled, min({column}) AS dist_left, quantile_cont({column}, 0.5) AS dist_mid
        FROM placed JOIN top USING (symbol) WHERE {column} < edge
        GROUP BY symbol, CAST(floor({column} / {width}) AS BIGINT) HAVING count(*) >= 10),
      wilson AS (
        SELECT *, (fill_rate + 3.8416 / (2 * n_total)) / (1 + 3.8416 / n_total) AS centre,
          1.96 * sqrt(fill_rate * (1 - fill_rate) / n_total + 3.8416 / (4.0 * n_total * n_total))
            / (1 + 3.8416 / n_total) AS half
        FROM bins)"""


_BIN_COLUMNS = "symbol, bin, fill_rate, n_total, n_filled, dist_left, dist_mid"
_CI = "greatest(0, centre - half) AS ci_lo, least(1, greatest(0, centre + half)) AS ci_hi"
_USD = _bins_twin("abs_dist", 1.0)
# the given prices are far apart, so the basis-point bins are wide
_BPS = _bins_twin("abs_dist_bps", 250)


@query("fill_rate_bins_usd", _orders(f"{_USD} SELECT {_BIN_COLUMNS} FROM wilson"), "fill_rate dist_left dist_mid")
def fill_rate_bins_usd(spark, sf):
    return micro.fill_rate_bins(orders_q(spark, sf), 1.0, by=BY).drop("ci_lo", "ci_hi")


@query("fill_rate_bins_bps", _orders(f"{_BPS} SELECT {_BIN_COLUMNS} FROM wilson"), "fill_rate dist_left dist_mid")
def fill_rate_bins_bps(spark, sf):
    return micro.fill_rate_bins(orders_q(spark, sf), 250, "abs_dist_bps", BY).drop("ci_lo", "ci_hi")


@query("wilson_ci", _orders(f"{_USD} SELECT symbol, bin, fill_rate, n_total, {_CI} FROM wilson"), "fill_rate ci_lo ci_hi")
def wilson_ci(spark, sf):
    return micro.fill_rate_bins(orders_q(spark, sf), 1.0, by=BY).select(
        "symbol", "bin", "fill_rate", "n_total", "ci_lo", "ci_hi"
    )


@query(
    "half_fill_point",
    _orders(f"""{_BPS} SELECT symbol, arg_min(dist_mid, (abs(fill_rate - 0.5), bin)) AS half_fill_dist
                FROM wilson GROUP BY symbol"""),
    "half_fill_dist",
)
def half_fill_point(spark, sf):
    return micro.half_fill_point(micro.fill_rate_bins(orders_q(spark, sf), 250, "abs_dist_bps", BY), BY)


# ------------------------------------------------------------- distribution ----

_MOMENTS = """, powers AS (
    SELECT symbol, count(*) AS n, min(x) AS low, max(x) AS high, avg(x) AS mean, stddev_samp(x) AS sd
    FROM xs GROUP BY symbol),
  centred AS (
    SELECT symbol, avg((x - mean) ** 2) AS m2, avg((x - mean) ** 3) AS m3, avg((x - mean) ** 4) AS m4
    FROM xs JOIN powers USING (symbol) GROUP BY symbol),
  moments AS (SELECT p.*, m3 / m2 ** 1.5 AS skew, m4 / m2 ** 2 - 3 AS kurt FROM powers p JOIN centred USING (symbol))"""


@query(
    "dist_moments", _orders(f"{_MOMENTS} SELECT symbol, n, low, high, mean, sd, skew, kurt FROM moments"),
    "low high mean sd skew kurt",
)
def dist_moments(spark, sf):
    return dist.moments(filled_q(spark, sf), BY, "abs_dist").drop("heavy_tails", "right_skew")


@query(
    "dist_flags",
    _orders(f"{_MOMENTS} SELECT symbol, kurt > 1 AS heavy_tails, skew > 0.5 AS right_skew FROM moments"),
)
def dist_flags(spark, sf):
    return dist.moments(filled_q(spark, sf), BY, "abs_dist").select("symbol", "heavy_tails", "right_skew")


@query(
    "dist_moments_lineitem",
    _items(f""", xs AS (SELECT symbol, l_extendedprice AS x FROM items) {_MOMENTS}
               SELECT symbol, n, low, high, mean, sd, skew, kurt FROM moments"""),
    "low high mean sd skew kurt",
)
def dist_moments_lineitem(spark, sf):
    return dist.moments(lineitem(spark, sf), BY, "l_extendedprice").drop("heavy_tails", "right_skew")


def _hist_twin(bins: int) -> str:
    return f"""SELECT symbol, CAST(bin AS INTEGER) AS bin, count(*) AS n_rows, low + bin * width AS left_edge,
        count(*) / (n * width) AS density
      FROM (SELECT *, least(floor((x - low) / width), {bins - 1}) AS bin FROM xs JOIN (
          SELECT symbol, min(x) AS low, (max(x) - min(x)) / {bins} AS width, count(*) AS n FROM xs GROUP BY symbol) s
        USING (symbol)) b
      GROUP BY symbol, bin, low, width, n"""


@query("density_hist", _orders(_hist_twin(80)), "left_edge density")
def density_hist(spark, sf):
    return dist.density_hist(filled_q(spark, sf), BY, "abs_dist", 80)


_TAIL_XS = """, tail_xs AS (SELECT xs.* FROM xs JOIN (SELECT symbol, quantile_cont(x, 0.9) AS cut FROM xs GROUP BY symbol) c
  USING (symbol) WHERE x > cut)"""


@query("density_hist_tail", _orders(_TAIL_XS + _hist_twin(40).replace("xs", "tail_xs")), "left_edge density")
def density_hist_tail(spark, sf):
    return dist.density_hist(filled_q(spark, sf), BY, "abs_dist", 40, above=0.9)


@query(
    "density_hist_pc1",
    _pca(
        f""", xs2 AS (SELECT p.symbol, (ln(1 + x) - mean_a) * pc1_a + (y - mean_b) * pc1_b AS x
          FROM pairs p JOIN pca USING (symbol)) {_hist_twin(60).replace("xs", "xs2")}"""
    ),
    "left_edge density",
)
def density_hist_pc1(spark, sf):
    scores = dep.pc1_scores(log_pairs_q(spark, sf), pca_q(spark, sf), BY, "a", "b", ["row_no"])
    return dist.density_hist(scores, BY, "score", 60)


def _kde_twin(points: int, used: str, low: str, high: str) -> str:
    return f""", kde_ends AS (SELECT symbol, {low} AS low, {high} AS high, avg(x) AS mean_all, stddev_samp(x) AS sd_all
        FROM xs GROUP BY symbol),
      used AS (SELECT xs.* FROM xs JOIN kde_ends USING (symbol) WHERE {used}),
      width AS (SELECT symbol, count(*) AS n, stddev_samp(x) * count(*) ** -0.2 AS h FROM used GROUP BY symbol),
      grid AS (SELECT symbol, CAST(g AS INTEGER) AS point, low + g * (high - low) / {points - 1} AS grid_x, mean_all, sd_all, n, h
        FROM kde_ends JOIN width USING (symbol), range({points}) r(g) WHERE h > 0)
      SELECT symbol, point, grid_x, sum(exp(-0.5 * ((grid_x - x) / h) ** 2)) / (n * h * sqrt(2 * pi())) AS density,
        exp(-0.5 * ((grid_x - mean_all) / sd_all) ** 2) / (sd_all * sqrt(2 * pi())) AS normal_density
      FROM grid JOIN used USING (symbol) GROUP BY symbol, point, grid_x, n, h, mean_all, sd_all"""


_KDE = _kde_twin(500, "true", "min(x)", "quantile_cont(x, 0.995)")


@query("kde_grid", _orders(f"{_KDE}"), "grid_x density normal_density")
def kde_grid(spark, sf):
    return dist.kde(dist.rank_values(filled_q(spark, sf), BY, "abs_dist"), BY, 500, high_q=0.995)


@query(
    "kde_grid_tail",
    _orders(_kde_twin(400, "x > low", "quantile_cont(x, 0.9)", "max(x)")),
    "grid_x density normal_density",
)
def kde_grid_tail(spark, sf):
    return dist.kde(dist.rank_values(filled_q(spark, sf), BY, "abs_dist"), BY, 400, low_q=0.9)


@query(
    "kde_grid_pc1",
    _pca(
        f""", xs AS (SELECT p.symbol, (ln(1 + x) - mean_a) * pc1_a + (y - mean_b) * pc1_b AS x
          FROM pairs p JOIN pca USING (symbol)) {_kde_twin(400, "true", "min(x)", "max(x)")}"""
    ).replace(", xs AS (SELECT symbol, abs_dist", ", filled_xs AS (SELECT symbol, abs_dist", 1)
    .replace("\nxs AS (SELECT symbol, abs_dist", "\nfilled_xs AS (SELECT symbol, abs_dist", 1),
    "grid_x density normal_density",
)
def kde_grid_pc1(spark, sf):
    scores = dep.pc1_scores(log_pairs_q(spark, sf), pca_q(spark, sf), BY, "a", "b", ["row_no"])
    return dist.kde(dist.rank_values(scores, BY, "score"), BY, 400)


@query(
    "gaussian_ref_pdf",
    _orders(f", kde AS (WITH zero AS (SELECT 1) {_KDE}) SELECT symbol, point, grid_x, normal_density FROM kde"),
    "grid_x normal_density",
)
def gaussian_ref_pdf(spark, sf):
    return dist.normal_on_grid(dist.rank_values(filled_q(spark, sf), BY, "abs_dist"), BY, 500, high_q=0.995)


# prices are spread over 1e5, so densities are shown a million times larger
_MILLIONFOLD = "symbol, point, grid_x, 1e6 * density AS density, 1e6 * normal_density AS normal_density"


@query(
    "kde_grid_lineitem",
    _items(f", xs AS (SELECT symbol, l_extendedprice AS x FROM items), kde AS (WITH zero AS (SELECT 1) {_KDE}) SELECT {_MILLIONFOLD} FROM kde"),
    "grid_x density normal_density",
)
def kde_grid_lineitem(spark, sf):
    found = dist.kde(dist.rank_values(lineitem(spark, sf), BY, "l_extendedprice"), BY, 500, high_q=0.995)
    return found.selectExpr(*_MILLIONFOLD.split(", "))


def _ks_twin() -> str:
    return f""", stats AS (SELECT symbol, avg(x) AS mean, stddev_samp(x) AS sd, count(*) AS n FROM xs GROUP BY symbol),
      gaps AS (SELECT symbol, n, {normal_cdf("((x - mean) / sd)")} AS cdf,
          row_number() OVER (PARTITION BY symbol ORDER BY x) AS r FROM xs JOIN stats USING (symbol)),
      ks AS (SELECT symbol, n, greatest(max(r / n - cdf), max(cdf - (r - 1) / n)) AS ks_stat FROM gaps
        GROUP BY symbol, n)
      SELECT symbol, ks_stat, {kolmogorov_tail("(sqrt(n) * ks_stat)")} AS p_value FROM ks"""


@query("ks_normal", _orders(_ks_twin()), "ks_stat p_value")
def ks_normal(spark, sf):
    filled = filled_q(spark, sf)
    return dist.ks_normal(dist.rank_values(filled, BY, "abs_dist"), dist.moments(filled, BY, "abs_dist"), BY)


@query(
    "ks_normal_lineitem",
    _items(f", xs AS (SELECT symbol, l_extendedprice AS x FROM items) {_ks_twin()}"),
    "ks_stat p_value",
)
def ks_normal_lineitem(spark, sf):
    items = lineitem(spark, sf)
    moments = dist.moments(items, BY, "l_extendedprice")
    return dist.ks_normal(dist.rank_values(items, BY, "l_extendedprice"), moments, BY)


_HILL = """, sorted AS (SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY x DESC) AS r,
    count(*) OVER (PARTITION BY symbol) AS n FROM xs),
  ks AS (SELECT *, greatest(50, CAST(floor(0.05 * n) AS BIGINT)) AS k FROM sorted),
  hill AS (SELECT symbol, k, CASE WHEN max(n) > k AND min(x) FILTER (WHERE r <= k + 1) > 0
      THEN 1 / (avg(CASE WHEN x > 0 THEN ln(x) END) FILTER (WHERE r <= k)
        - ln(min(CASE WHEN x > 0 THEN x END) FILTER (WHERE r = k + 1))) END AS hill_alpha
    FROM ks GROUP BY symbol, k)"""


@query("hill_index", _orders(f"{_HILL} SELECT symbol, k, hill_alpha FROM hill"), "hill_alpha")
def hill_index(spark, sf):
    return dist.hill_index(dist.rank_values(filled_q(spark, sf), BY, "abs_dist"), BY)


@query(
    "hill_index_lineitem",
    _items(f", xs AS (SELECT symbol, l_extendedprice AS x FROM items) {_HILL} SELECT symbol, k, hill_alpha FROM hill"),
    "hill_alpha",
)
def hill_index_lineitem(spark, sf):
    return dist.hill_index(dist.rank_values(lineitem(spark, sf), BY, "l_extendedprice"), BY)


_CURVE = """, sorted AS (SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY x DESC) AS r,
    count(*) OVER (PARTITION BY symbol) AS n FROM xs),
  logs AS (SELECT *, avg(CASE WHEN x > 0 THEN ln(x) END) OVER (PARTITION BY symbol ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING) AS mean_log FROM sorted WHERE r <= 501)
  SELECT symbol, CAST(r - 1 AS INTEGER) AS k, 1 / nullif(mean_log - ln(CASE WHEN x > 0 THEN x END), 0) AS hill_alpha
  FROM logs WHERE r - 1 >= 20 AND r - 1 < least(floor(0.15 * n), 500) AND x > 0"""


@query("hill_curve", _orders(_CURVE), "hill_alpha")
def hill_curve(spark, sf):
    return dist.hill_curve(filled_q(spark, sf), BY, "abs_dist")


@query(
    "hill_curve_lineitem",
    _items(f", xs AS (SELECT symbol, l_extendedprice AS x FROM items) {_CURVE}"), "hill_alpha",
)
def hill_curve_lineitem(spark, sf):
    return dist.hill_curve(lineitem(spark, sf), BY, "l_extendedprice")


@query(
    "topk_desc",
    _items("""SELECT symbol, l_extendedprice AS x, r FROM (SELECT *, CAST(row_number()
      OVER (PARTITION BY symbol ORDER BY l_extendedprice DESC) AS INTEGER) AS r FROM items) t WHERE r <= 101"""),
    "x",
)
def topk_desc(spark, sf):
    return dist.top_values(lineitem(spark, sf), BY, "l_extendedprice", 101)


_CCDF = """, ranked AS (SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY x DESC) AS row_no,
    count(*) OVER (PARTITION BY symbol) AS total, max(x) OVER (PARTITION BY symbol) AS top_x FROM xs),
  cut AS (SELECT symbol, quantile_cont(x, 0.7) AS floor_value FROM xs GROUP BY symbol)
  SELECT symbol, row_no, x, row_no / total AS ccdf, 1 / total * pow(x / top_x, -hill_alpha) AS power_law
  FROM ranked JOIN cut USING (symbol) JOIN hill USING (symbol) WHERE x > floor_value"""


@query("ccdf_tail", _orders(_HILL + _CCDF), "x ccdf power_law")
def ccdf_tail(spark, sf):
    return dist.ccdf_tail(filled_q(spark, sf), BY, "abs_dist", _TIES)


_QQ = f""", placed_ranks AS (SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY x) AS r,
    count(*) OVER (PARTITION BY symbol) AS n FROM xs),
  medians AS (SELECT *, CASE WHEN r = n THEN pow(0.5, 1.0 / n) WHEN r = 1 THEN 1 - pow(0.5, 1.0 / n)
    ELSE (r - 0.3175) / (n + 0.365) END AS p FROM placed_ranks),
  qq AS (SELECT symbol, r AS row_no, x, {normal_quantile("CAST(p AS DOUBLE)")} AS q FROM medians)"""
_QQ_FIT = "SELECT symbol, regr_slope(x, q) AS slope, regr_intercept(x, q) AS intercept, corr(x, q) AS r FROM qq GROUP BY symbol"


@query("qq_normal", _orders(f"{_QQ} {_QQ_FIT}"), "slope intercept r")
def qq_normal(spark, sf):
    return dist.qq_normal(dist.qq_points(filled_q(spark, sf), BY, "abs_dist", _TIES), BY)


@query("qq_points", _orders(f"{_QQ} SELECT symbol, row_no, x, q FROM qq"), "x q")
def qq_points(spark, sf):
    return dist.qq_points(filled_q(spark, sf), BY, "abs_dist", _TIES)


@query(
    "qq_normal_lineitem",
    _items(f", xs AS (SELECT symbol, l_extendedprice AS x FROM items) {_QQ} {_QQ_FIT}"),
    "slope intercept r",
)
def qq_normal_lineitem(spark, sf):
    return dist.qq_normal(dist.qq_points(lineitem(spark, sf), BY, "l_extendedprice", _LINE), BY)


# --------------------------------------------------------------- dependence ----


@query(
    "win_rolling_center",
    _pairs("""SELECT symbol, row_no, abs_dist, filled, CASE WHEN n_fill >= 50 THEN avg_fill END AS fill_prob
              FROM rolled"""),
    "abs_dist fill_prob",
)
def win_rolling_center(spark, sf):
    return dep.rolling_fill_rate(orders_q(spark, sf), BY).select("symbol", "row_no", "abs_dist", "filled", "fill_prob")


@query("pair_frame", _pairs("SELECT symbol, row_no, x, y FROM pairs"), "x y")
def pair_frame(spark, sf):
    return pairs_q(spark, sf)


@query("rank_avg", _ranks("SELECT symbol, row_no, rx, ry FROM ranks"), "rx ry")
def rank_avg(spark, sf):
    return ranks_q(spark, sf).select("symbol", "row_no", "rx", "ry")


_CORR = """CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END"""


@query("spearman", _ranks(f"SELECT symbol, {_CORR} AS spearman FROM ranks GROUP BY symbol"), "spearman")
def spearman(spark, sf):
    return dep.spearman(ranks_q(spark, sf), BY)


_LINE_PAIRS = """, pairs AS (SELECT symbol, l_orderkey * 10 + l_linenumber AS row_no, l_extendedprice AS x,
  l_quantity AS y FROM items)"""


def _line_pairs(spark, sf):
    return lineitem(spark, sf).selectExpr(
        "symbol", "l_orderkey * 10 + l_linenumber as row_no", "l_extendedprice as x", "l_quantity as y"
    )


@query(
    "spearman_lineitem",
    _items(f"{_LINE_PAIRS}, {o.RANKS} SELECT symbol, {_CORR} AS spearman FROM ranks GROUP BY symbol"),
    "spearman",
)
def spearman_lineitem(spark, sf):
    return dep.spearman(dep.average_ranks(_line_pairs(spark, sf), BY), BY)


_TAU = """, signs AS (
  SELECT symbol, CAST(sum(sign(a.x - b.x) * sign(a.y - b.y)) AS DOUBLE) AS net,
    sqrt(CAST(sum(CASE WHEN a.x <> b.x THEN 1 ELSE 0 END) AS DOUBLE))
     * sqrt(CAST(sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END) AS DOUBLE)) AS scale
  FROM pairs a JOIN pairs b USING (symbol) WHERE a.row_no < b.row_no GROUP BY symbol),
tau AS (SELECT symbol, CASE WHEN scale > 0 THEN net / scale END AS kendall FROM signs)"""


@query("kendall_tau", _pairs(f"{_TAU} SELECT symbol, kendall FROM tau"), "kendall")
def kendall_tau(spark, sf):
    return dep.kendall(pairs_q(spark, sf), BY)


# cells of (x, y) with counts instead of rows keep the twin's self-join small
_CELL_TAU = """, cells AS (SELECT symbol, l_quantity AS x, l_discount AS y, CAST(count(*) AS DOUBLE) AS n
    FROM items GROUP BY ALL),
  sums AS (SELECT symbol, sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) AS net,
      sqrt(sum(CASE WHEN a.x <> b.x THEN a.n * b.n ELSE 0 END)) * sqrt(sum(CASE WHEN a.y <> b.y THEN a.n * b.n ELSE 0 END))
        AS scale FROM cells a JOIN cells b USING (symbol) GROUP BY symbol)
  SELECT symbol, CASE WHEN scale > 0 THEN net / scale END AS kendall FROM sums"""


@query("kendall_tau_lineitem", _items(_CELL_TAU), "kendall")
def kendall_tau_lineitem(spark, sf):
    pairs = lineitem(spark, sf).selectExpr("symbol", "l_quantity as x", "l_discount as y")
    return dep.kendall(pairs, BY)


@query("pseudo_obs", _ranks("SELECT symbol, row_no, rx / (total + 1) AS u, ry / (total + 1) AS v FROM ranks"), "u v")
def pseudo_obs(spark, sf):
    return dep.pseudo_obs(ranks_q(spark, sf), BY)


_COPULA = f"""{_TAU}, rho AS (SELECT symbol, {_CORR} AS spearman FROM ranks GROUP BY symbol),
  copula AS (SELECT symbol, spearman, kendall, 2 * sin(pi() * spearman / 6) AS gauss_theta,
    CASE WHEN kendall IS NOT NULL THEN 1 / greatest(1e-6, 1 - kendall) END AS gumbel_theta,
    CASE WHEN spearman < -0.3 THEN 'strong negative' WHEN spearman < 0 THEN 'weak negative'
      ELSE 'positive or none' END AS dependence FROM rho JOIN tau USING (symbol))"""


def _copula(spark, sf):
    return dep.copula_parameters(
        dep.spearman(ranks_q(spark, sf), BY), dep.kendall(pairs_q(spark, sf), BY), BY
    )


@query("copula_gauss_theta", _ranks(f"{_COPULA} SELECT symbol, spearman, gauss_theta FROM copula"), "spearman gauss_theta")
def copula_gauss_theta(spark, sf):
    return _copula(spark, sf).select("symbol", "spearman", "gauss_theta")


@query("copula_gumbel_theta", _ranks(f"{_COPULA} SELECT symbol, kendall, gumbel_theta FROM copula"), "kendall gumbel_theta")
def copula_gumbel_theta(spark, sf):
    return _copula(spark, sf).select("symbol", "kendall", "gumbel_theta")


@query("dependence_label", _ranks(f"{_COPULA} SELECT symbol, dependence FROM copula"))
def dependence_label(spark, sf):
    return _copula(spark, sf).select("symbol", "dependence")


_UV_HIST = """, uv AS (SELECT symbol, rx / (total + 1) AS u, ry / (total + 1) AS v FROM ranks),
  span AS (SELECT symbol, count(*) AS n, min(u) AS u0, (max(u) - min(u)) / 40 AS du, min(v) AS v0,
    (max(v) - min(v)) / 40 AS dv FROM uv GROUP BY symbol),
  cells AS (SELECT symbol, n, du * dv AS area, CAST(least(floor((u - u0) / du), 39) AS INTEGER) AS u_bin,
    CAST(least(floor((v - v0) / dv), 39) AS INTEGER) AS v_bin FROM uv JOIN span USING (symbol) WHERE du > 0 AND dv > 0)
  SELECT symbol, u_bin, v_bin, count(*) AS n_rows, count(*) / (n * area) AS density FROM cells
  GROUP BY symbol, u_bin, v_bin, n, area"""


@query("copula_density", _ranks(_UV_HIST), "density")
def copula_density(spark, sf):
    return dep.copula_density(dep.pseudo_obs(ranks_q(spark, sf), BY), BY)


@query("copula_density_lineitem", _items(f"{_LINE_PAIRS}, {o.RANKS} {_UV_HIST}"), "density")
def copula_density_lineitem(spark, sf):
    ranks = dep.average_ranks(_line_pairs(spark, sf), BY)
    return dep.copula_density(dep.pseudo_obs(ranks, BY), BY)


@query(
    "sample_n",
    """SELECT l_returnflag AS symbol, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount FROM lineitem
      ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber)), l_orderkey, l_linenumber LIMIT 5000""",
    "l_extendedprice l_quantity l_discount",
)
def sample_n(spark, sf):
    return dep.sample_rows(lineitem(spark, sf), 5000, _LINE)


def _smooth_twin(passes: int = 3) -> str:
    """Every row at every grid point: the nearest 30 % by sorting distances, refitted by residuals."""
    ctes = ["""base AS (SELECT symbol, row_number() OVER () AS id, x, y FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL),
      span AS (SELECT symbol, min(x) AS low, (max(x) - min(x)) / 99 AS step, greatest(2, floor(0.3 * count(*) + 1e-10)) AS k
        FROM base GROUP BY symbol HAVING max(x) > min(x)),
      nodes AS (SELECT symbol, CAST(g AS INTEGER) AS point, low + g * step AS g, low, step, k FROM span, range(100) r(g)),
      near AS (SELECT symbol, point, n.g, k, step, row_number() OVER (PARTITION BY symbol, point ORDER BY abs(x - n.g)) AS place, abs(x - n.g) AS d
        FROM nodes n JOIN base USING (symbol)),
      reach AS (SELECT symbol, point, g, greatest(1e-9 * step, d) AS h FROM near WHERE place = k),
      weights_0 AS (SELECT id, 1.0 AS weight FROM base)"""]  # fmt: skip
    for i in range(passes + 1):
        ctes.append(f"""met_{i} AS (SELECT symbol, point, g, x - g AS dx, y, weight * (1 - (abs(x - g) / h) ** 3) ** 3 AS w
          FROM reach JOIN base USING (symbol) JOIN weights_{i} USING (id) WHERE abs(x - g) < h),
        sums_{i} AS (SELECT symbol, point, sum(w) AS sw, sum(w * dx) AS sx, sum(w * dx * dx) AS sxx, sum(w * y) AS sy, sum(w * dx * y) AS sxy
          FROM met_{i} GROUP BY symbol, point),
        curve_{i} AS (SELECT symbol, point, g AS grid_x, low, step, CASE WHEN sw > 1e-12 THEN CASE WHEN sw * sxx - sx * sx > 1e-9 * sw * sxx
          THEN (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) ELSE sy / sw END END AS smooth FROM nodes LEFT JOIN sums_{i} USING (symbol, point)),
        residuals_{i} AS (SELECT id, symbol, abs(y - (a.smooth + (b.smooth - a.smooth) * ((x - a.low) / a.step - a.point))) AS residual
          FROM base JOIN span s USING (symbol) JOIN curve_{i} a USING (symbol) JOIN curve_{i} b USING (symbol)
          WHERE a.point = least(98, floor((x - s.low) / s.step)) AND b.point = a.point + 1),
        scale_{i} AS (SELECT symbol, quantile_cont(residual, 0.5) AS middle FROM residuals_{i} GROUP BY symbol),
        weights_{i + 1} AS (SELECT id, CASE WHEN residual IS NULL OR middle <= 1e-12 THEN 1 WHEN residual < 6 * middle
          THEN (1 - (residual / (6 * middle)) ** 2) ** 2 ELSE 0 END AS weight FROM residuals_{i} JOIN scale_{i} USING (symbol))""")  # fmt: skip
    return f", {', '.join(ctes)} SELECT symbol, point, grid_x, smooth FROM curve_{passes} WHERE smooth IS NOT NULL"


@query("local_smooth", _pairs(_smooth_twin()), "grid_x smooth")
def local_smooth(spark, sf):
    return smooth.local_smooth(pairs_q(spark, sf), BY)


# ------------------------------------------------------------ principal axes ----

_COV = "mean_a mean_b var_a var_b cov_ab"


@query("mean_cov", _pca("SELECT symbol, n, mean_a, mean_b, var_a, var_b, cov_ab FROM cov"), _COV)
def mean_cov(spark, sf):
    return dep.mean_cov(log_pairs_q(spark, sf), BY, "a", "b")


_TRIM = """, logs AS (SELECT symbol, ln(1 + x) AS a, y AS b FROM pairs),
  places AS (SELECT symbol, a, b, row_number() OVER (PARTITION BY symbol ORDER BY a) AS ra,
    row_number() OVER (PARTITION BY symbol ORDER BY b) AS rb, count(*) OVER (PARTITION BY symbol) AS n FROM logs),
  trims AS (SELECT symbol, n, avg(a) FILTER (WHERE ra > floor(0.05 * n) AND ra <= n - floor(0.05 * n)) AS ta,
    avg(b) FILTER (WHERE rb > floor(0.05 * n) AND rb <= n - floor(0.05 * n)) AS tb FROM places GROUP BY symbol, n)
  SELECT symbol, n, ta AS mean_a, tb AS mean_b, sum((a - ta) ** 2) / (n - 1) AS var_a,
    sum((b - tb) ** 2) / (n - 1) AS var_b, sum((a - ta) * (b - tb)) / (n - 1) AS cov_ab
  FROM logs JOIN trims USING (symbol) GROUP BY symbol, n, ta, tb"""


@query("trimmed_mean_cov", _pairs(_TRIM), _COV)
def trimmed_mean_cov(spark, sf):
    return dep.trimmed_mean_cov(log_pairs_q(spark, sf), BY, "a", "b")


@query(
    "pca_2d", _pca("SELECT symbol, eig1, eig2, pc1_a, pc1_b, pve1 FROM pca"), "eig1 eig2 pc1_a pc1_b pve1"
)
def pca_2d(spark, sf):
    return pca_q(spark, sf).select("symbol", "eig1", "eig2", "pc1_a", "pc1_b", "pve1")


@query(
    "confidence_ellipse",
    _pca("""SELECT symbol, CAST(k AS INTEGER) AS n_std, mean_a AS centre_a, mean_b AS centre_b,
        2 * k * sqrt(eig1) AS width, 2 * k * sqrt(greatest(eig2, 0)) AS height, degrees(theta) AS angle
      FROM (SELECT p.*, e.theta FROM pca p JOIN eig e USING (symbol)) a, range(1, 4) r(k)"""),
    "centre_a centre_b width height angle",
)
def confidence_ellipse(spark, sf):
    return dep.confidence_ellipses(pca_q(spark, sf), BY)


@query(
    "pc1_projection",
    _pca("""SELECT symbol, row_no, (ln(1 + x) - mean_a) * pc1_a + (y - mean_b) * pc1_b AS score
            FROM pairs JOIN pca USING (symbol)"""),
    "score",
)
def pc1_projection(spark, sf):
    return dep.pc1_scores(log_pairs_q(spark, sf), pca_q(spark, sf), BY, "a", "b", ["row_no"])


@query(
    "pc1_projection_robust",
    _pairs(
        f""", robust AS (SELECT * FROM (WITH z AS (SELECT 1) {_TRIM}) t),
        axes AS (SELECT *, 0.5 * atan2(2 * cov_ab, var_a - var_b) AS theta FROM robust)
        SELECT symbol, row_no, (ln(1 + x) - mean_a) * cos(theta) + (y - mean_b) * sin(theta) AS score
        FROM pairs JOIN axes USING (symbol)"""
    ),
    "score",
)
def pc1_projection_robust(spark, sf):
    pairs = log_pairs_q(spark, sf)
    robust = dep.pca_2d(dep.trimmed_mean_cov(pairs, BY, "a", "b"), BY)
    return dep.pc1_scores(pairs, robust, BY, "a", "b", ["row_no"])


_METRICS = ["n_filled", "mean_dist", "sd_dist", "skewness", "excess_kurtosis", "hill_alpha", "ks_p_value",
            "spearman", "kendall", "gauss_theta", "gumbel_theta", "pve_pc1"]


@query(
    "analysis_summary",
    _orders(
        f""", {o.PAIRS}, {o.RANKS}, {o.PCA} {_MOMENTS} {_HILL.replace('ks AS', 'hk AS').replace('FROM ks', 'FROM hk')}
        {_COPULA}, ksr AS (SELECT * FROM (WITH z AS (SELECT 1) {_ks_twin()}) t),
        one AS (SELECT symbol, CAST(m.n AS DOUBLE) AS n_filled, m.mean AS mean_dist, m.sd AS sd_dist, skew AS skewness,
            kurt AS excess_kurtosis, hill_alpha, p_value AS ks_p_value, spearman, kendall, gauss_theta,
            gumbel_theta, pve1 AS pve_pc1
          FROM moments m JOIN hill USING (symbol) JOIN ksr USING (symbol) JOIN copula USING (symbol)
            JOIN pca USING (symbol))
        {" UNION ALL ".join(f"SELECT symbol, '{m}' AS metric, {m} AS value FROM one" for m in _METRICS)}"""
    ),
    "value",
)
def analysis_summary(spark, sf):
    return summary.analysis_summary(orders_q(spark, sf), pairs_q(spark, sf), BY)


# -------------------------------------------------------------- multivariate ----

_ITEM_COV = """, cov AS (SELECT symbol, count(*) AS n, avg(l_extendedprice) AS mean_a, avg(l_quantity) AS mean_b,
  var_samp(l_extendedprice) AS var_a, var_samp(l_quantity) AS var_b, covar_samp(l_extendedprice, l_quantity) AS cov_ab
  FROM items GROUP BY symbol)"""


def _item_cov(spark, sf):
    return dep.mean_cov(lineitem(spark, sf), BY, "l_extendedprice", "l_quantity")


@query(
    "mahalanobis",
    _items(f"""{_ITEM_COV} SELECT symbol, l_orderkey, l_linenumber, sqrt((var_b * da * da - 2 * cov_ab * da * db
      + var_a * db * db) / (var_a * var_b - cov_ab * cov_ab)) AS distance
      FROM (SELECT *, l_extendedprice - mean_a AS da, l_quantity - mean_b AS db FROM items JOIN cov USING (symbol)) d"""),
    "distance",
)
def mahalanobis(spark, sf):
    items = lineitem(spark, sf)
    return dep.mahalanobis(items, _item_cov(spark, sf), BY, "l_extendedprice", "l_quantity", _LINE)


@query(
    "cov_spectrum",
    _items(f"""{_ITEM_COV}, eig AS (SELECT *, (var_a + var_b) / 2 AS half,
        sqrt(((var_a - var_b) / 2) ** 2 + cov_ab ** 2) AS spread, 0.5 * atan2(2 * cov_ab, var_a - var_b) AS theta FROM cov)
      SELECT symbol, half + spread AS eig1, cos(theta) AS pc1_a, sin(theta) AS pc1_b,
        2 * sqrt(half + spread) AS width, degrees(theta) AS angle FROM eig"""),
    "eig1 pc1_a pc1_b width angle",
)
def cov_spectrum(spark, sf):
    return dep.pca_2d(_item_cov(spark, sf), BY).selectExpr(
        "symbol", "eig1", "pc1_a", "pc1_b", "2 * sqrt(eig1) as width", "degrees(atan2(pc1_b, pc1_a)) as angle"
    )


@query(
    "portfolio_moments",
    _items(f"""{_ITEM_COV} SELECT symbol, 0.2 * mean_a + 0.8 * mean_b AS mean,
      0.04 * var_a + 0.32 * cov_ab + 0.64 * var_b AS variance,
      sqrt(0.04 * var_a + 0.32 * cov_ab + 0.64 * var_b) AS volatility FROM cov"""),
    "mean variance volatility",
)
def portfolio_moments(spark, sf):
    return dep.portfolio_moments(_item_cov(spark, sf), BY, 0.2, 0.8)


@query(
    "linear_projection",
    _items("""SELECT symbol, l_orderkey, l_linenumber, alpha + beta * l_quantity AS projected,
        l_extendedprice - alpha - beta * l_quantity AS residual
      FROM items JOIN (SELECT symbol, regr_slope(l_extendedprice, l_quantity) AS beta,
        regr_intercept(l_extendedprice, l_quantity) AS alpha FROM items GROUP BY symbol) l USING (symbol)"""),
    "projected residual",
)
def linear_projection(spark, sf):
    return dep.linear_projection(lineitem(spark, sf), BY, "l_extendedprice", "l_quantity", _LINE)


@query(
    "residual_corr",
    _items("""SELECT symbol, corr(l_extendedprice, l_discount) AS corr_raw, corr(r1, r2) AS corr_residual FROM (
        SELECT *, l_extendedprice - b1 * l_quantity AS r1, l_discount - b2 * l_quantity AS r2 FROM items JOIN (
          SELECT symbol, regr_slope(l_extendedprice, l_quantity) AS b1, regr_slope(l_discount, l_quantity) AS b2
          FROM items GROUP BY symbol) l USING (symbol)) r GROUP BY symbol"""),
    "corr_raw corr_residual",
)
def residual_corr(spark, sf):
    return dep.residual_corr(lineitem(spark, sf), BY, "l_extendedprice", "l_discount", "l_quantity")

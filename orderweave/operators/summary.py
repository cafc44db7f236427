"""The twelve headline metrics of a fill-probability study, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderweave.operators import dependence as dep
from orderweave.operators import distribution as dist
from orderweave.session import pin, sql

METRICS = [
    "n_filled", "mean_dist", "sd_dist", "skewness", "excess_kurtosis", "hill_alpha",
    "ks_p_value", "spearman", "kendall", "gauss_theta", "gumbel_theta", "pve_pc1",
]


def analysis_summary(orders: DataFrame, pairs: DataFrame, by) -> DataFrame:
    """(group, metric, value) from placed orders and their pair frame."""
    keys = ", ".join(by)
    filled = orders.where("filled = 1")
    moments = pin(dist.moments(filled, by, "abs_dist"), "moments")
    ranked = pin(dist.rank_values(filled, by, "abs_dist"), "ranks")
    ranks = dep.average_ranks(pairs, by)
    copula = dep.copula_parameters(dep.spearman(ranks, by), dep.kendall(pairs, by), by)
    logs = pairs.selectExpr(*by, "ln(1 + x) as a", "y as b")
    pca = dep.pca_2d(dep.mean_cov(logs, by, "a", "b"), by)
    named = ", ".join(f"'{m}', {m}" for m in METRICS)
    return sql(
        f"""
        with wide as (
          select {keys}, cast(m.n as double) as n_filled, mean as mean_dist, sd as sd_dist, skew as skewness,
            kurt as excess_kurtosis, hill_alpha, p_value as ks_p_value, spearman, kendall, gauss_theta, gumbel_theta,
            pve1 as pve_pc1
          from {{moments}} m join {{hill}} using ({keys}) join {{ks}} using ({keys})
            left join {{copula}} using ({keys}) left join (select {keys}, pve1 from {{pca}}) using ({keys})
        )
        select {keys}, stack({len(METRICS)}, {named}) as (metric, value) from wide
        """,
        moments=moments,
        hill=dist.hill_index(ranked, by),
        ks=dist.ks_normal(ranked, moments, by),
        copula=copula,
        pca=pca,
    )

"""Tables derived from the given ones and shared by queries."""

from __future__ import annotations

from orderweave.operators.dependence import average_ranks, mean_cov, pair_frame, pca_2d
from orderweave.operators.microstructure import placed_orders
from orderweave.operators.replay import (
    effective_rows_q,
    effective_rows_s,
    replay_q,
    replay_s,
    sessionize_q,
    sessionize_s,
)
from orderweave.plans.catalog import once
from orderweave.session import pin
from orderweave.sources.tables import feed_q, feed_s, read

BY = ["symbol"]


@once
def replayed_s(spark, sf_dir):
    events, open_orders = replay_s(feed_s(spark, sf_dir))
    return pin(events, "events-s"), open_orders


@once
def replayed_q(spark, sf_dir):
    events, open_orders = replay_q(feed_q(spark, sf_dir))
    return pin(events, "events-q"), open_orders


def events_s(spark, sf_dir):
    return replayed_s(spark, sf_dir)[0]


def events_q(spark, sf_dir):
    return replayed_q(spark, sf_dir)[0]


@once
def sessions_s(spark, sf_dir):
    return sessionize_s(effective_rows_s(feed_s(spark, sf_dir)))


@once
def sessions_q(spark, sf_dir):
    return sessionize_q(effective_rows_q(feed_q(spark, sf_dir)))


@once
def orders_q(spark, sf_dir):
    return pin(placed_orders(events_q(spark, sf_dir), BY), "orders-q")


def filled_q(spark, sf_dir):
    return orders_q(spark, sf_dir).where("filled = 1")


@once
def pairs_q(spark, sf_dir):
    return pin(pair_frame(orders_q(spark, sf_dir), BY), "pairs-q")


@once
def ranks_q(spark, sf_dir):
    return pin(average_ranks(pairs_q(spark, sf_dir), BY), "ranks-q")


def log_pairs_q(spark, sf_dir):
    return pairs_q(spark, sf_dir).selectExpr("symbol", "row_no", "ln(1 + x) as a", "y as b")


@once
def pca_q(spark, sf_dir):
    return pin(pca_2d(mean_cov(log_pairs_q(spark, sf_dir), BY, "a", "b"), BY), "pca-q")


def lineitem(spark, sf_dir):
    """``lineitem`` as a larger sample for the statistics: group, identity and numeric columns."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag as symbol", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount"
    )

"""Midprice, distance of new orders to it, and fill rates by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderweave.functions.columns import local_time, wilson
from orderweave.operators.distribution import quantiles, rank_values
from orderweave.operators.scan import Chunks, attach
from orderweave.session import sql

GRAIN = ("source", "symbol", "date")


def midprice_timeline(events: DataFrame, by=GRAIN) -> DataFrame:
    """Per timestamp: highest bid and lowest ask among ADD/MODIFY, each carried forward, and their mean.

    It is the last quoted price, not the best resting one: cancelled quotes stay until replaced."""
    keys = ", ".join(by)
    ticks = sql(
        f"""
        select {keys}, ts, count(*) as n_rows,
          max(price) filter (where side = 'BID' and event_type in ('ADD', 'MODIFY')) as bid,
          min(price) filter (where side = 'ASK' and event_type in ('ADD', 'MODIFY')) as ask
        from {{events}} group by {keys}, ts
        """,
        events=events,
    )
    filled = Chunks(ticks, by, ["ts"], "ticks").scan(lasts={"best_bid": "bid", "best_ask": "ask"})
    return filled.selectExpr(*by, "ts", "n_rows", "best_bid", "best_ask", "(best_bid + best_ask) / 2 as midprice")


def with_midprice(events: DataFrame, by=GRAIN) -> DataFrame:
    """Every event with the midprice at its timestamp."""
    spread = "order_id, session_id, event_seq, event_type, price, size"
    return attach(events, midprice_timeline(events, by), [*by, "ts"], ["midprice"], spread)


def placed_orders(events: DataFrame, by=GRAIN) -> DataFrame:
    """ADD rows with a midprice: distance to it in price and basis points, and whether the order id,
    in any session, has a FILL."""
    keys = ", ".join(by)
    adds = with_midprice(events, by).where(
        "event_type = 'ADD' and midprice is not null and price is not null"
    )
    fills = sql(
        f"""select {keys}, order_id, count(*) as n_rows, max(event_type = 'FILL') as has_fill
            from {{events}} group by {keys}, order_id""",
        events=events,
    )
    labelled = attach(adds, fills, [*by, "order_id"], ["has_fill"], "ts, session_id, price, size")
    return labelled.selectExpr(
        *by, "order_id", "session_id", "ts", "side", "price", "size", "midprice",
        "abs(price - midprice) as abs_dist",
        "abs(price - midprice) / midprice * 10000 as abs_dist_bps",
        "cast(has_fill as int) as filled",
    )


def fill_rate(orders: DataFrame, by=GRAIN) -> DataFrame:
    """Orders, filled orders and their share."""
    keys = ", ".join(by)
    return sql(
        f"""select {keys}, count(*) as n_total, sum(filled) as n_filled, avg(filled) as fill_rate
            from {{orders}} group by {keys}""",
        orders=orders,
    )


def fill_rate_bins(
    orders: DataFrame, width: float, column: str = "abs_dist", by=GRAIN, cut: float = 0.995, min_orders: int = 10
) -> DataFrame:
    """Fill rate per ``[left, right)`` interval of ``column`` up to its ``cut`` quantile, with 95 % Wilson
    bounds. ``dist_left`` is the smallest distance observed, ``dist_mid`` the exact median."""
    keys = ", ".join(by)
    limit = quantiles(rank_values(orders, by, column), by, {"top": cut})
    identity = "ts, order_id, session_id, price, size"
    binned = attach(orders, limit, by, ["top"], identity, rows="total").where(
        f"{column} < ceil(top / {width}) * {width}"
    ).selectExpr(*by, f"cast(floor({column} / {width}) as bigint) as bin", f"{column} as dist", "filled")
    middle = quantiles(rank_values(binned, [*by, "bin"], "dist"), [*by, "bin"], {"dist_mid": 0.5})
    return sql(
        f"""
        with bins as (
          select {keys}, bin, avg(filled) as fill_rate, count(*) as n_total, sum(filled) as n_filled,
            min(dist) as dist_left
          from {{binned}} group by {keys}, bin having count(*) >= {min_orders}
        )
        select {keys}, bin, fill_rate, n_total, n_filled, dist_left, dist_mid,
          {wilson("fill_rate", "n_total", "-")} as ci_lo, {wilson("fill_rate", "n_total", "+")} as ci_hi
        from bins join {{middle}} using ({keys}, bin)
        """,
        binned=binned,
        middle=middle,
    )


def half_fill_point(bins: DataFrame, by=GRAIN) -> DataFrame:
    """Median distance of the bin whose fill rate is closest to one half (the nearest such bin)."""
    keys = ", ".join(by)
    return sql(
        f"""select {keys}, min_by(dist_mid, struct(abs(fill_rate - 0.5), bin)) as half_fill_dist
            from {{bins}} group by {keys}""",
        bins=bins,
    )


# ------------------------------------------------------- fills over time ----


def fill_count_by_ts(events: DataFrame) -> DataFrame:
    """FILLs at each exact timestamp, in time order."""
    return sql(
        "select ts, count(*) as n_fills from {events} where event_type = 'FILL' group by ts order by ts",
        events=events,
    )


def in_session_hours(events: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Events between 09:30 and 16:00 local time, both ends included."""
    clock = f"date_format({local_time('ts', zone)}, 'HH:mm:ss.SSSSSS')"
    return events.where(f"{clock} between '09:30:00.000000' and '16:00:00.000000'")


def with_local_time(events: DataFrame, zone: str = "America/New_York") -> DataFrame:
    return events.selectExpr("*", f"cast({local_time('ts', zone)} as timestamp_ntz) as ts_local")


def fill_count_bins(events: DataFrame, minutes: int, zone: str = "America/New_York") -> DataFrame:
    """FILLs per ``[left, right)`` interval of the trading day with most FILLs (the earliest such day)."""
    return sql(
        f"""
        with fills as (
          select cast({local_time("ts", zone)} as timestamp_ntz) as at from {{events}} where event_type = 'FILL'
        ), days as (select cast(at as date) as day, count(*) as n from fills group by 1),
        busiest as (select min_by(day, struct(-n, day)) as day from days),
        slots as (
          select cast((hour(at) * 60 + minute(at)) div {minutes} * {minutes} as int) as minute_of_day, cast(at as date) as day
          from fills where cast(at as date) = (select day from busiest)
            and hour(at) * 60 + minute(at) >= 570 and hour(at) < 16
        )
        select day, minute_of_day, count(*) as n_fills from slots group by day, minute_of_day order by minute_of_day
        """,
        events=events,
    )


def quietest_slot(counts: DataFrame) -> DataFrame:
    """Smallest interval count."""
    return counts.selectExpr("min(n_fills) as min_fills")


def fill_gaps(events: DataFrame) -> DataFrame:
    """Seconds between successive distinct FILL times."""
    times = sql("select 0 as one, ts from {events} where event_type = 'FILL' group by ts", events=events)
    gaps = Chunks(times, ["one"], ["ts"], "fill-times").scan(lags={"before": "ts"})
    return gaps.where("before is not null").selectExpr("ts", "(ts - before) / 1e9D as gap_sec")


def interarrival_hist(events: DataFrame, points: int = 1000) -> DataFrame:
    """Gap counts between neighbours of ``points`` even grid values from 0 to the longest gap rounded to
    hundreds. Intervals are open at both ends, the last counts what lies beyond the grid.
    No rows if the longest gap rounds to 0 and the grid collapses."""
    gaps = fill_gaps(events)
    return sql(
        f"""
        with scale as (select nullif(bround(max(gap_sec), -2), 0) / {points - 1} as step from {{gaps}}),
        placed as (
          select *, least(cast(floor(gap_sec / step) as int), {points - 1}) as i
          from (select gap_sec, (select step from scale) as step from {{gaps}})
        ), counts as (
          select i, count(*) as n from placed
          where gap_sec > i * step and (i = {points - 1} or gap_sec < (i + 1) * step) group by i
        )
        select i as bin, i * step as left_sec, coalesce(n, 0) as n_gaps
        from (select explode(sequence(0, {points - 1})) as i, step from scale where step is not null)
          left join counts using (i)
        """,
        gaps=gaps,
    )

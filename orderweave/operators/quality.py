"""Quality checks on a unified event table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderweave.operators.lifetime import order_key
from orderweave.session import sql

VALUE_CHECKS = ("CHECK_UNKNOWN_EVENT", "CHECK_UNKNOWN_SIDE")
ORDER_CHECKS = (
    "CHECK_NEG_REMAINING", "CHECK_DUP_SEQ", "CHECK_MULTI_ADD", "CHECK_NO_ADD",
    "CHECK_OVERFILL", "CHECK_TS_ORDER", "CHECK_MIXED_SYMBOL",
)

# Events of one order that are compared in one window partition.
_SEQ_BLOCK = 100_000


def order_checks(events: DataFrame) -> DataFrame:
    """One row per order with a flag per check.

    Events are first combined per (order, event_seq), which removes copies before the shuffle;
    the order of timestamps is then checked in blocks of event_seq and between blocks."""
    key = ", ".join(order_key(events))
    return sql(
        f"""
        with steps as (
          select {key}, event_seq, event_seq div {_SEQ_BLOCK} as block,
            count(*) as n, min(ts) as first_ts, max(ts) as last_ts,
            count_if(event_type = 'ADD') as adds,
            min_by(size, ts) filter (where event_type = 'ADD' and size is not null) as add_size,
            count_if(event_type = 'FILL') as fills,
            sum(size) filter (where event_type = 'FILL') as filled,
            max(coalesce(remaining_size < -1e-9D, false)) as negative,
            min(symbol) as low_symbol, max(symbol) as high_symbol
          from {{events}} group by {key}, event_seq
        ), compared as (
          select *, first_ts < lag(last_ts) over (partition by {key}, block order by event_seq) as backwards
          from steps
        ), blocks as (
          select {key}, block, max(n) as n, sum(adds) as adds, sum(fills) as fills, sum(filled) as filled,
            min_by(add_size, event_seq) filter (where add_size is not null) as add_size,
            max(negative) as negative, min(low_symbol) as low_symbol, max(high_symbol) as high_symbol,
            max(coalesce(backwards, false)) as backwards,
            min_by(first_ts, event_seq) as first_ts, max_by(last_ts, event_seq) as last_ts
          from compared group by {key}, block
        ), linked as (
          select *, first_ts < lag(last_ts) over (partition by {key} order by block) as broken from blocks
        )
        select {key},
          max(negative) as CHECK_NEG_REMAINING,
          max(n) > 1 as CHECK_DUP_SEQ,
          sum(adds) > 1 as CHECK_MULTI_ADD,
          sum(adds) = 0 as CHECK_NO_ADD,
          coalesce(sum(fills) > 0 and coalesce(sum(filled), 0)
            > (min_by(add_size, block) filter (where add_size is not null)) + 1e-9D, false) as CHECK_OVERFILL,
          max(backwards or coalesce(broken, false)) as CHECK_TS_ORDER,
          coalesce(min(low_symbol) <> max(high_symbol), false) as CHECK_MIXED_SYMBOL
        from linked group by {key}
        """,
        events=events,
    )


def unknown_values(events: DataFrame) -> DataFrame:
    """Distinct event types outside the catalogue (a missing one counts) and sides outside BID/ASK."""
    return sql(
        """
        select distinct check, value from (
          select stack(2,
            'CHECK_UNKNOWN_EVENT', event_type, not coalesce(event_type in ('ADD', 'MODIFY', 'FILL', 'CANCEL'), false),
            'CHECK_UNKNOWN_SIDE', side, coalesce(side not in ('BID', 'ASK'), false)) as (check, value, bad)
          from {events})
        where bad
        """,
        events=events,
    )


def violations(events: DataFrame) -> DataFrame:
    """Every finding as (check, key columns, value)."""
    key = order_key(events)
    pairs = ", ".join(f"'{c}', {c}" for c in ORDER_CHECKS)
    flagged = sql(
        f"""
        select check, {", ".join(key)}, cast(null as string) as value
        from (select {", ".join(key)}, stack({len(ORDER_CHECKS)}, {pairs}) as (check, bad) from {{orders}})
        where bad
        """,
        orders=order_checks(events),
    )
    return flagged.unionByName(unknown_values(events), allowMissingColumns=True)


def validation_report(events: DataFrame) -> DataFrame:
    """One row per check: violations found, and the totals of the table it was run on."""
    counts = ", ".join(f"count_if({c}) as {c}" for c in ORDER_CHECKS)
    pairs = ", ".join(f"'{c}', {c}" for c in ORDER_CHECKS)
    names = ", ".join(f"'{c}'" for c in VALUE_CHECKS)
    return sql(
        f"""
        with orders as (select count(*) as total_orders, {counts} from {{orders}}),
        rows as (select count(*) as total_rows from {{events}}),
        order_counts as (select stack({len(ORDER_CHECKS)}, {pairs}) as (check, n_violations) from orders),
        value_counts as (
          select check, count(v.check_found) as n_violations
          from (select explode(array({names})) as check) c
          left join (select check as check_found, value from {{unknown}}) v on c.check = v.check_found
          group by check
        )
        select check, n_violations, n_violations = 0 as passed,
          (select total_rows from rows) as total_rows, (select total_orders from orders) as total_orders
        from (select * from order_counts union all select * from value_counts)
        """,
        orders=order_checks(events),
        events=events,
        unknown=unknown_values(events),
    )


def duplicate_events(events: DataFrame, limit: int = 20) -> DataFrame:
    """Rows whose (order, session, event_seq) occurs more than once, first ones in key order."""
    from orderweave.operators.scan import attach

    key = [*order_key(events), "event_seq"]
    copies = sql(
        f"select {', '.join(key)}, count(*) as n_rows, count(*) > 1 as repeated from {{events}} group by {', '.join(key)}",
        events=events,
    )
    rows = attach(events, copies, key, ["repeated"], "ts, price, size, remaining_size, reason", "repeated")
    return rows.where("repeated").drop("repeated").orderBy(
        "order_id", "session_id", "event_seq", "ts", "event_type", "price", "size", "remaining_size", "reason"
    ).limit(limit)

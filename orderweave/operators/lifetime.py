"""One row per order and session: birth, outcome, counts and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderweave.session import sql

LIFETIME_COLUMNS = [
    "order_id", "session_id", "symbol", "source", "born_ts", "born_price", "born_size", "died_ts",
    "died_price", "outcome", "duration_ns", "fill_count", "partial_fill_count", "modify_count",
    "total_filled_size", "cancel_size", "anomalies",
]


#: Event numbers that fit the bitmap of an order.
SEQ_BITS = 512


def order_key(events: DataFrame) -> list[str]:
    """Sessions are numbered per file, so source and file belong to the key where they are known."""
    return [c for c in ("source", "file_id") if c in events.columns] + ["order_id", "session_id"]


def lifetimes(events: DataFrame) -> DataFrame:
    """Lifetime table; orders without an ADD are left out. Events with equal event_seq and time are ordered by
    their values.

    Repeated numbers are found in one exchange by a bitmap of the numbers of each order, if all are below SEQ_BITS. Else
    (a scan of that one column tells) they are counted apart, which groups rows by (order, event_seq) first."""
    key = order_key(events)
    if events.where(f"event_seq not between 0 and {SEQ_BITS - 1}").isEmpty():
        words = [f"bit_count(bit_or(if(event_seq div 64 = {k}, shiftleft(1L, event_seq % 64), 0L)))" for k in range(SEQ_BITS // 64)]
        distinct = " + ".join(words)
    else:
        distinct = "count(distinct event_seq)"
    source = "" if "source" in key else "min_by(source, at) as source,"
    return sql(
        f"""
        with placed as (select *, struct(event_seq, ts, price, size) as at from {{events}}),
        orders as (
          select {", ".join(key)}, {source}
            min_by(symbol, at) as symbol,
            count_if(event_type = 'ADD') as adds,
            min_by(struct(ts, price, size), at) filter (where event_type = 'ADD') as born,
            max_by(struct(ts, price, size, event_type), struct(event_seq, ts, event_type, price, size))
              filter (where event_type in ('FILL', 'CANCEL')) as died,
            count_if(event_type = 'FILL') as fill_count,
            count_if(event_type = 'FILL' and reason in ('PARTIAL_FILL', 'PARTIAL_FILL_TRADE')) as partial_fill_count,
            count_if(event_type = 'MODIFY') as modify_count,
            coalesce(sum(size) filter (where event_type = 'FILL'), 0) as total_filled_size,
            coalesce(min(remaining_size) < -1e-9D, false) as negative,
            {distinct} <> count(*)
              or max(event_seq) - min(event_seq) + 1 <> count(*) as bad_seq
          from placed group by {", ".join(key)}
        )
        select order_id, session_id, symbol, source,
          born.ts as born_ts, born.price as born_price, born.size as born_size,
          died.ts as died_ts, died.price as died_price,
          case died.event_type when 'FILL' then 'FILLED' when 'CANCEL' then 'CANCELLED' else 'OPEN_AT_EOD' end
            as outcome,
          died.ts - born.ts as duration_ns,
          fill_count, partial_fill_count, modify_count, total_filled_size,
          if(died.event_type = 'CANCEL', died.size, 0D) as cancel_size,
          concat_ws('|',
            if(adds > 1, 'MULTI_ADD', null),
            if(total_filled_size > born.size + 1e-9D, 'OVERFILL', null),
            if(negative, 'NEG_REMAINING', null),
            if(bad_seq, 'BAD_SEQ', null)) as anomalies
          {", file_id" if "file_id" in key else ""}
        from orders where adds > 0
        """,
        events=events,
    )


def lifetime_summary(lifetime: DataFrame) -> DataFrame:
    """Counts per outcome and per anomaly combination (clean orders have none)."""
    return sql(
        """
        select field, value, count(*) as n
        from (select stack(2, 'outcome', outcome, 'anomalies', nullif(anomalies, '')) as (field, value)
              from {lifetime})
        where value is not null group by field, value
        """,
        lifetime=lifetime,
    )


def outcomes_by_symbol(lifetime: DataFrame) -> DataFrame:
    """Orders, filled volume and median-free lifetime totals per symbol and outcome."""
    return sql(
        """
        select symbol, outcome, count(*) as n_orders, sum(total_filled_size) as filled_size,
          sum(fill_count) as n_fills
        from {lifetime} group by symbol, outcome
        """,
        lifetime=lifetime,
    )

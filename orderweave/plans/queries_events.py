"""Replay, lifetime and validation queries."""

from __future__ import annotations

from orderweave.operators import lifetime as life
from orderweave.operators import microstructure as micro
from orderweave.operators import quality, replay
from orderweave.plans import oracle as o
from orderweave.plans.catalog import query
from orderweave.plans.derived import events_q, events_s, replayed_q, replayed_s, sessions_q, sessions_s
from orderweave.sources.tables import feed_q, feed_s

_EV = ", ".join(replay.EVENT_COLUMNS) + ", file_id"
_NUM = "price size remaining_size"
_KEY = "source, file_id, order_id, session_id"


def _s(select: str) -> str:
    return f"WITH RECURSIVE {o.EVENTS_S} {select}"


def _q(select: str) -> str:
    return f"WITH RECURSIVE {o.EVENTS_Q} {select}"


# ------------------------------------------------------------------ replay ----


@query("stage_b_s", _s(f"SELECT {_EV} FROM ev"), _NUM)
def stage_b_s(spark, sf):
    return events_s(spark, sf)


@query("stage_b_q", _q(f"SELECT {_EV} FROM ev"), _NUM)
def stage_b_q(spark, sf):
    return events_q(spark, sf)


def _slice(name: str, style: str, where: str) -> None:
    """One event kind of the replay as its own query."""
    events, twin = (events_s, _s) if style == "s" else (events_q, _q)
    query(name, twin(f"SELECT {_EV} FROM ev WHERE {where}"), _NUM)(lambda spark, sf: events(spark, sf).where(where))


_slice("s_add", "s", "event_type = 'ADD'")
_slice("s_sub", "s", "reason IN ('FULL_FILL', 'PARTIAL_FILL')")
_slice("s_match", "s", "reason IN ('FULL_FILL_TRADE', 'PARTIAL_FILL_TRADE')")
_slice("s_set", "s", "reason IN ('SIZE_CHANGE', 'PRICE_CHANGE')")
_slice("s_delete", "s", "reason IN ('CANCELLED', 'PARTIAL_DELETE')")
_slice("s_snapshot", "s", "event_type = 'ADD' AND session_id > 0 AND event_seq = 0")
_slice("snapshot_reset", "s", "reason = 'SNAPSHOT_RESET'")
_slice("q_clear", "q", "reason = 'SNAPSHOT_RESET'")
_slice("q_add", "q", "event_type = 'ADD'")
_slice("q_modify", "q", "reason IN ('SIZE_CHANGE', 'PRICE_CHANGE')")
_slice("q_cancel_fill", "q", "event_type = 'FILL' OR reason IN ('CANCELLED', 'PARTIAL_DELETE')")


@query("s_noop_pairs", f"WITH {o.PAIRS_S} SELECT file_id, order_id, ts FROM noop_keys")
def s_noop_pairs(spark, sf):
    return replay.same_instant_pairs(feed_s(spark, sf)).where("noop").select("file_id", "order_id", "ts")


@query("s_reprice_pairs", f"WITH {o.PAIRS_S} SELECT file_id, order_id, ts FROM reprice_keys")
def s_reprice_pairs(spark, sf):
    return replay.same_instant_pairs(feed_s(spark, sf)).where("reprice").select("file_id", "order_id", "ts")


@query("unknown_type_drop", f"WITH {o.SESSIONS_S} SELECT raw_type, count(*) AS n FROM effective GROUP BY raw_type")
def unknown_type_drop(spark, sf):
    return replay.effective_rows_s(feed_s(spark, sf)).groupBy("raw_type").count().withColumnRenamed("count", "n")


@query("s_sessionize", f"WITH {o.SESSIONS_S} SELECT file_id, line_no, session_id, opens FROM sessions")
def s_sessionize(spark, sf):
    return sessions_s(spark, sf).select("file_id", "line_no", "session_id", "opens")


@query(
    "q_sequence_groups",
    f"""WITH {o.GROUPS_Q} SELECT file_id, seq_no, min(ts) AS g_ts, count(*) AS n_rows
        FROM (SELECT file_id, coalesce(sequence, 0) AS seq_no, ts FROM feed_q) f GROUP BY ALL""",
)
def q_sequence_groups(spark, sf):
    return replay.sequence_groups(feed_q(spark, sf)).select("file_id", "seq_no", "g_ts", "n_rows")


@query("q_fill_flags", f"WITH {o.GROUPS_Q} SELECT file_id, seq_no, is_fill, is_trade FROM seq_groups")
def q_fill_flags(spark, sf):
    return replay.sequence_groups(feed_q(spark, sf)).select("file_id", "seq_no", "is_fill", "is_trade")


@query("q_sessionize", f"WITH {o.SESSIONS_Q} SELECT file_id, line_no, session_id, opens FROM sessions")
def q_sessionize(spark, sf):
    return sessions_q(spark, sf).select("file_id", "line_no", "session_id", "opens")


@query("q_skip", f"WITH {o.SESSIONS_Q} SELECT raw_type, count(*) AS n FROM sessions GROUP BY raw_type")
def q_skip(spark, sf):
    return sessions_q(spark, sf).groupBy("raw_type").count().withColumnRenamed("count", "n")


_BREAKDOWN = """SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM ev GROUP BY event_type
  UNION ALL SELECT 'reason', reason, count(*) FROM ev WHERE reason IS NOT NULL GROUP BY reason"""


@query("event_breakdown", _s(_BREAKDOWN))
def event_breakdown(spark, sf):
    return replay.event_breakdown(events_s(spark, sf))


@query("event_breakdown_q", _q(_BREAKDOWN))
def event_breakdown_q(spark, sf):
    return replay.event_breakdown(events_q(spark, sf))


_OPEN = """SELECT l.file_id, count(*) AS n_open FROM last_states l LEFT JOIN ends e USING (file_id, session_id)
  WHERE l.live AND e.ts IS NULL GROUP BY l.file_id"""


@query("open_at_end", _s(_OPEN))
def open_at_end(spark, sf):
    return replayed_s(spark, sf)[1].groupBy("file_id").count().withColumnRenamed("count", "n_open")


@query("open_at_end_q", _q(_OPEN))
def open_at_end_q(spark, sf):
    return replayed_q(spark, sf)[1].groupBy("file_id").count().withColumnRenamed("count", "n_open")


@query(
    "dup_key_inspect",
    _s(f"""SELECT {_EV} FROM (SELECT *, count(*) OVER (PARTITION BY {_KEY}, event_seq) AS copies FROM ev) c
           WHERE copies > 1 ORDER BY order_id, session_id, event_seq, ts, event_type, price, size, remaining_size,
           reason NULLS FIRST LIMIT 20"""),
    _NUM,
)
def dup_key_inspect(spark, sf):
    return quality.duplicate_events(events_s(spark, sf)).select(*replay.EVENT_COLUMNS, "file_id")


# ---------------------------------------------------------------- lifetime ----

_LT_NUM = "born_price born_size died_price total_filled_size cancel_size"


def _lifetime(name: str, columns: str, doubles: str = "") -> None:
    """Lifetime columns of both feeds, told apart by ``source``."""
    twin_s = _s(f", {o.LIFETIME} SELECT {columns} FROM lt")
    query(name, twin_s, doubles)(
        lambda spark, sf: life.lifetimes(events_s(spark, sf)).selectExpr(*[c.strip() for c in columns.split(",")])
    )


_lifetime("lifetime_build", ", ".join(life.LIFETIME_COLUMNS) + ", file_id", _LT_NUM)
_lifetime("lt_born", f"{_KEY}, born_ts, born_price, born_size", "born_price born_size")
_lifetime("lt_outcome", f"{_KEY}, outcome, died_ts, died_price", "died_price")
_lifetime("lt_duration", f"{_KEY}, duration_ns")
_lifetime(
    "lt_counts",
    f"{_KEY}, fill_count, partial_fill_count, modify_count, total_filled_size, cancel_size",
    "total_filled_size cancel_size",
)
_lifetime("an_concat", f"{_KEY}, anomalies")


@query(
    "lifetime_build_q",
    _q(f", {o.LIFETIME} SELECT {', '.join(life.LIFETIME_COLUMNS)}, file_id FROM lt"),
    _LT_NUM,
)
def lifetime_build_q(spark, sf):
    return life.lifetimes(events_q(spark, sf))


# A table with every kind of fault: some fields of the replayed events are spoiled by rule.

_SPOIL = {
    "event_type": "CASE WHEN event_seq = 0 AND price > 120 THEN 'TRADE' ELSE event_type END",
    "side": "CASE WHEN event_seq = 3 THEN 'MID' ELSE side END",
    "symbol": "CASE WHEN event_seq = 4 THEN 'OTHER' ELSE symbol END",
    "remaining_size": "CASE WHEN event_seq = 2 AND price > 130 THEN CAST(-1 AS DOUBLE) ELSE remaining_size END",
    "ts": "CASE WHEN event_seq = 5 THEN ts - 864000000000000 ELSE ts END",
}
_SPOILED_COLUMNS = [f"{_SPOIL.get(c, c)} AS {c}" for c in [*replay.EVENT_COLUMNS, "file_id"]]
_SPOILED = f", bad AS (SELECT {', '.join(_SPOILED_COLUMNS)} FROM ev)"


def spoiled(spark, sf):
    return events_q(spark, sf).selectExpr(*_SPOILED_COLUMNS)



def _anomaly(name: str, code: str) -> None:
    twin = o.LIFETIME.replace("FROM ev GROUP BY", "FROM bad GROUP BY")
    query(name, _q(f"{_SPOILED}, {twin} SELECT {_KEY} FROM lt WHERE anomalies LIKE '%{code}%'"))(
        lambda spark, sf: life.lifetimes(spoiled(spark, sf)).where(f"anomalies like '%{code}%'").select(
            "source", "file_id", "order_id", "session_id"
        )
    )


_anomaly("an_multi_add", "MULTI_ADD")
_anomaly("an_overfill", "OVERFILL")
_anomaly("an_neg_remaining", "NEG_REMAINING")
_anomaly("an_bad_seq", "BAD_SEQ")


@query(
    "lt_summary",
    _s(
        f""", {o.LIFETIME} SELECT 'outcome' AS field, outcome AS value, count(*) AS n FROM lt GROUP BY outcome
        UNION ALL SELECT 'anomalies', anomalies, count(*) FROM lt WHERE anomalies <> '' GROUP BY anomalies"""
    ),
)
def lt_summary(spark, sf):
    return life.lifetime_summary(life.lifetimes(events_s(spark, sf)))


@query(
    "outcomes_by_symbol",
    _s(
        f""", {o.LIFETIME} SELECT symbol, outcome, count(*) AS n_orders, sum(total_filled_size) AS filled_size,
        CAST(sum(fill_count) AS BIGINT) AS n_fills FROM lt GROUP BY symbol, outcome"""
    ),
    "filled_size",
)
def outcomes_by_symbol(spark, sf):
    return life.outcomes_by_symbol(life.lifetimes(events_s(spark, sf)))


# -------------------------------------------------------------- validation ----

_CHECKS = {
    "CHECK_UNKNOWN_EVENT": f"""SELECT DISTINCT NULL::VARCHAR AS order_id, NULL::INTEGER AS session_id,
        event_type AS value FROM bad WHERE event_type IS NULL
          OR event_type NOT IN ('ADD', 'MODIFY', 'FILL', 'CANCEL')""",
    "CHECK_UNKNOWN_SIDE": """SELECT DISTINCT NULL::VARCHAR AS order_id, NULL::INTEGER AS session_id, side AS value
        FROM bad WHERE side NOT IN ('BID', 'ASK')""",
    "CHECK_NEG_REMAINING": """SELECT DISTINCT order_id, session_id, NULL::VARCHAR AS value FROM bad
        WHERE remaining_size < -1e-9""",
    "CHECK_DUP_SEQ": f"""SELECT DISTINCT order_id, session_id, NULL::VARCHAR AS value FROM
        (SELECT {_KEY}, event_seq FROM bad GROUP BY ALL HAVING count(*) > 1) d""",
    "CHECK_MULTI_ADD": f"""SELECT order_id, session_id, NULL::VARCHAR AS value FROM bad
        WHERE event_type = 'ADD' GROUP BY {_KEY} HAVING count(*) > 1""",
    "CHECK_NO_ADD": f"""SELECT order_id, session_id, NULL::VARCHAR AS value FROM bad GROUP BY {_KEY}
        HAVING count(*) FILTER (WHERE event_type = 'ADD') = 0""",
    "CHECK_OVERFILL": f"""SELECT f.order_id, f.session_id, NULL::VARCHAR AS value FROM
        (SELECT {_KEY}, sum(size) AS filled FROM bad WHERE event_type = 'FILL' GROUP BY ALL) f
        JOIN (SELECT {_KEY}, arg_min(size, (event_seq, ts)) AS born FROM bad WHERE event_type = 'ADD'
              AND size IS NOT NULL GROUP BY ALL) a USING (source, file_id, order_id, session_id)
        WHERE filled > born + 1e-9""",
    "CHECK_TS_ORDER": f"""SELECT DISTINCT order_id, session_id, NULL::VARCHAR AS value FROM
        (SELECT *, ts < lag(ts) OVER (PARTITION BY {_KEY} ORDER BY event_seq, ts) AS back FROM bad) b WHERE back""",
    "CHECK_MIXED_SYMBOL": f"""SELECT order_id, session_id, NULL::VARCHAR AS value FROM bad GROUP BY {_KEY}
        HAVING count(DISTINCT symbol) > 1""",
}
_CHECK_QUERY = {
    "chk_unknown_event": "CHECK_UNKNOWN_EVENT",
    "chk_unknown_side": "CHECK_UNKNOWN_SIDE",
    "chk_neg_remaining": "CHECK_NEG_REMAINING",
    "chk_dup_seq": "CHECK_DUP_SEQ",
    "chk_multi_add": "CHECK_MULTI_ADD",
    "chk_no_add": "CHECK_NO_ADD",
    "chk_overfill": "CHECK_OVERFILL",
    "chk_ts_order": "CHECK_TS_ORDER",
    "chk_mixed_symbol": "CHECK_MIXED_SYMBOL",
}


def _check(name: str, check: str) -> None:
    query(name, _q(f"{_SPOILED} {_CHECKS[check]}"))(
        lambda spark, sf: quality.violations(spoiled(spark, sf))
        .where(f"check = '{check}'")
        .select("order_id", "session_id", "value")
    )


for _name, _code in _CHECK_QUERY.items():
    _check(_name, _code)

_REPORT = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) AS n_violations FROM ({t}) t" for c, t in _CHECKS.items())


@query(
    "validate_report",
    _q(
        f"""{_SPOILED} SELECT "check", n_violations, n_violations = 0 AS passed,
        (SELECT count(*) FROM bad) AS total_rows,
        (SELECT count(*) FROM (SELECT DISTINCT {_KEY} FROM bad) d) AS total_orders FROM ({_REPORT}) r"""
    ),
)
def validate_report(spark, sf):
    return quality.validation_report(spoiled(spark, sf))


# --------------------------------------------------------- fills over time ----


@query("fill_count_by_ts", _q("SELECT ts, count(*) AS n_fills FROM ev WHERE event_type = 'FILL' GROUP BY ts"))
def fill_count_by_ts(spark, sf):
    return micro.fill_count_by_ts(events_q(spark, sf))


_LOCAL = "timezone('America/New_York', timezone('UTC', make_timestamp(ts // 1000)))"


def _bins_twin(minutes: int, tail: str) -> str:
    return _q(
        f""", fills AS (SELECT {_LOCAL} AS t FROM ev WHERE event_type = 'FILL'),
        busiest AS (SELECT CAST(t AS DATE) AS day FROM fills GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        counts AS (SELECT CAST(t AS DATE) AS day,
            CAST((hour(t) * 60 + minute(t)) // {minutes} * {minutes} AS INTEGER) AS minute_of_day, count(*) AS n_fills
          FROM fills WHERE CAST(t AS DATE) = (SELECT day FROM busiest)
            AND CAST(t AS TIME) >= TIME '09:30:00' AND CAST(t AS TIME) < TIME '16:00:00' GROUP BY ALL)
        {tail}"""
    )


@query("fill_count_5m", _bins_twin(5, "SELECT * FROM counts"))
def fill_count_5m(spark, sf):
    return micro.fill_count_bins(events_q(spark, sf), 5)


@query("fill_count_1m", _bins_twin(1, "SELECT * FROM counts"))
def fill_count_1m(spark, sf):
    return micro.fill_count_bins(events_q(spark, sf), 1)


@query("fill_count_min", _bins_twin(5, "SELECT min(n_fills) AS min_fills FROM counts"))
def fill_count_min(spark, sf):
    return micro.quietest_slot(micro.fill_count_bins(events_q(spark, sf), 5))


@query(
    "session_hours_filter",
    _q(f"SELECT {_EV} FROM ev WHERE CAST({_LOCAL} AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00'"),
    _NUM,
)
def session_hours_filter(spark, sf):
    return micro.in_session_hours(events_q(spark, sf))


@query("tz_convert", _q(f"SELECT order_id, session_id, event_seq, ts, {_LOCAL} AS ts_local FROM ev"))
def tz_convert(spark, sf):
    return micro.with_local_time(events_q(spark, sf)).select("order_id", "session_id", "event_seq", "ts", "ts_local")


_GAPS = """, gaps AS (SELECT ts, (ts - lag(ts) OVER (ORDER BY ts)) / 1e9 AS gap_sec
  FROM (SELECT DISTINCT ts FROM ev WHERE event_type = 'FILL') f)"""


@query("win_diff", _q(f"{_GAPS} SELECT ts, gap_sec FROM gaps WHERE gap_sec IS NOT NULL"), "gap_sec")
def win_diff(spark, sf):
    return micro.fill_gaps(events_q(spark, sf))


@query(
    "interarrival_hist",
    _q(
        f"""{_GAPS}, scale AS (SELECT round_even(max(gap_sec), -2) / 999 AS step FROM gaps),
        grid AS (SELECT CAST(i AS INTEGER) AS i, i * step AS left_sec, (i + 1) * step AS right_sec
          FROM range(1000) r(i), scale WHERE step > 0)
        SELECT i AS bin, left_sec, (SELECT count(*) FROM gaps
            WHERE gap_sec > left_sec AND (i = 999 OR gap_sec < right_sec)) AS n_gaps FROM grid"""
    ),
    "left_sec",
)
def interarrival_hist(spark, sf):
    return micro.interarrival_hist(events_q(spark, sf))

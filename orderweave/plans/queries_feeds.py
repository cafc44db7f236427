"""Feed reading, normalisation, store and pipeline queries."""

from __future__ import annotations

from orderweave.operators.replay import EVENT_COLUMNS
from orderweave.plans import oracle as o
from orderweave.plans.catalog import once, query
from orderweave.plans.derived import events_q
from orderweave.plans.pipeline import run_files
from orderweave.session import fresh_path, pin
from orderweave.sources import feeds, store
from orderweave.sources.tables import raw_q, raw_s, write_raw, write_raw_s

_EV = ", ".join(EVENT_COLUMNS)
_NUM = "price size remaining_size"


@once
def files_s(spark, sf):
    return write_raw_s(raw_s(spark, sf), fresh_path(spark, "files-s"))


@once
def files_q(spark, sf):
    return write_raw(raw_q(spark, sf), ",", fresh_path(spark, "files-q"))


@once
def feed_s(spark, sf):
    return feeds.Feed(spark, files_s(spark, sf), feeds.STYLE_S, "*.csv")


@once
def rows_s(spark, sf):
    return pin(feed_s(spark, sf).rows(), "rows-s")


@once
def rows_q(spark, sf):
    return pin(feeds.read_feed(spark, files_q(spark, sf), feeds.STYLE_Q), "rows-q")


_TICK = "100 + floor(value * 4) / 4"
_TEXT = f"""concat(CAST(CAST(({_TICK}) * 100 AS BIGINT) // 100 AS VARCHAR), '.',
  lpad(CAST(CAST(({_TICK}) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0'))"""

# the raw rows, said once more from the events table; those of the file without a required column are not read
_RAW_S = f"""raw_files AS (SELECT *, hour(ts) >= 20 AND event_id % 7 = 0 AS late,
    CASE WHEN user_id % 3 = 2 AND dayofmonth(ts) = 5 THEN 'nosymbol.csv' ELSE concat(strftime(CAST(ts AS DATE)
      + CASE WHEN hour(ts) >= 20 AND event_id % 7 = 0 THEN 1 ELSE 0 END, '%Y%m%d'),
      '_SYM', CAST(user_id % 3 AS VARCHAR), '.csv') END AS file_id,
    CASE WHEN event_id % 997 < 3 THEN 'SNAPSHOT' WHEN event_id % 211 = 0 THEN 'PING' WHEN event_type = 'signup' THEN 'ADD'
      WHEN event_type = 'view' THEN 'SUB' WHEN event_type = 'purchase' THEN 'MATCH'
      WHEN event_type = 'click' THEN 'SET' ELSE 'DELETE' END AS raw_type FROM events),
  raw_s AS (SELECT * FROM raw_files WHERE file_id NOT LIKE '______07_SYM2.csv')"""
_BAD_CLOCK = "(user_id % 3 = 2 AND dayofmonth(ts) = 6 AND hour(ts) < 20 AND event_id % 41 = 40)"
_NS_S = f"CASE WHEN NOT {_BAD_CLOCK} AND file_id <> 'nosymbol.csv' THEN epoch_us(ts) * 1000 + 700 END"
# the seventh digit of the clock is a 7: 700 ns
_STAGE_S = f"""{_RAW_S}, rows_s AS (SELECT file_id, event_id AS line_no, {_NS_S} AS ts,
    CASE WHEN file_id <> 'nosymbol.csv' THEN concat('SYM', CAST(user_id % 3 AS VARCHAR)) END AS symbol,
    CAST(user_id AS VARCHAR) AS order_id,
    CASE WHEN event_id % 113 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'BID' ELSE 'ASK' END AS side,
    CASE WHEN event_id % 59 <> 0 THEN {_TICK} END AS price, CAST((event_id * 7) % 5 AS DOUBLE) AS size, raw_type,
    CASE WHEN event_type = 'click' AND event_id % 4 <> 0 THEN CAST(event_id % 6 AS DOUBLE) END AS new_size,
    CASE WHEN event_type = 'click' AND event_id % 3 <> 0 AND user_id % 3 <> 2 THEN {_TICK} END AS new_price FROM raw_s)"""
_STAGE_Q = f"""rows_q AS (SELECT concat('20240101_SYM', CAST(user_id % 3 AS VARCHAR), '.csv') AS file_id,
    epoch_us(ts) * 1000 + 7 AS ts, concat('SYM', CAST(user_id % 3 AS VARCHAR)) AS symbol,
    CAST(user_id AS VARCHAR) AS order_id,
    CASE WHEN event_id % 997 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'BID' ELSE 'ASK' END AS side,
    CASE WHEN event_id % 59 <> 0 THEN {_TICK} END AS price, CAST(event_id % 5 AS DOUBLE) AS size,
    CASE WHEN event_id % 997 = 0 THEN 'R' WHEN event_id % 991 = 0 THEN 'N' WHEN event_type = 'signup' THEN 'A'
      WHEN event_type = 'click' THEN 'M' WHEN event_type = 'view' THEN 'C' WHEN event_type = 'purchase' THEN 'F'
      ELSE 'T' END AS raw_type,
    CASE WHEN event_id % 101 <> 0 THEN CAST(event_id // 8 AS DOUBLE) END AS sequence,
    CAST(event_id % 256 AS DOUBLE) AS flags FROM events)"""


# --------------------------------------------------------------------- scans ----


@query(
    "scan_csv",
    f"""WITH {_RAW_S} SELECT file_id,
      CASE WHEN {_BAD_CLOCK} THEN 'noon' ELSE strftime(ts, '%H:%M:%S.%f') || '7' END AS time_exchange,
      CASE WHEN late THEN '00:00:01.000000' ELSE strftime(ts, '%H:%M:%S.%f') END AS time_coinapi,
      CAST(user_id AS VARCHAR) AS order_id,
      CASE WHEN event_id % 113 = 0 THEN '9' ELSE CAST((user_id + 1) % 2 AS VARCHAR) END AS is_buy,
      CASE WHEN event_id % 59 = 0 THEN 'n/a' ELSE {_TEXT} END AS entry_px,
      CAST((event_id * 7) % 5 AS VARCHAR) AS entry_sx, raw_type AS update_type,
      CASE WHEN event_type = 'click' AND event_id % 4 <> 0 THEN CAST(event_id % 6 AS VARCHAR) END AS new_size,
      CASE WHEN event_type = 'click' AND event_id % 3 <> 0 AND user_id % 3 <> 2 THEN {_TEXT} END AS new_price FROM raw_s""",
)
def scan_csv(spark, sf):
    return feeds.scan_csv(spark, files_s(spark, sf), feeds.STYLE_S).drop("line_no")


@query(
    "scan_filename_meta",
    f"""WITH {_RAW_S} SELECT file_id, CASE WHEN file_id <> 'nosymbol.csv' THEN
        CAST(strptime(file_id[1:8], '%Y%m%d') AS DATE) END AS file_date,
      CASE WHEN file_id <> 'nosymbol.csv' THEN file_id[10:13] END AS file_symbol, count(*) AS n_rows
      FROM raw_s GROUP BY file_id""",
)
def scan_filename_meta(spark, sf):
    rows = feeds.with_file_meta(feeds.scan_csv(spark, files_s(spark, sf), feeds.STYLE_S), feeds.STYLE_S)
    return rows.groupBy("file_id", "file_date", "file_symbol").count().withColumnRenamed("count", "n_rows")


_MISSING = "update_type; available: time_exchange, time_coinapi, order_id, is_buy, entry_px, entry_sx, new_size, new_price"


@query(
    "scan_directory",
    f"""WITH {_STAGE_S}, bad AS (SELECT file_id, line_no, CASE WHEN file_id = 'nosymbol.csv' THEN 'file name is not DATE_SYMBOL.csv'
        ELSE concat('unreadable time ', chr(39), strftime(e.ts, '%Y-%m-%d'), ' noon', chr(39)) END AS reason
      FROM rows_s JOIN events e ON e.event_id = line_no WHERE rows_s.ts IS NULL OR symbol IS NULL),
    read_files AS (SELECT r.file_id, count(*) AS n_rows, count(b.reason) AS n_bad, arg_min(b.reason, r.line_no) FILTER (WHERE b.reason IS NOT NULL) AS reason
      FROM rows_s r LEFT JOIN bad b USING (file_id, line_no) GROUP BY r.file_id)
    SELECT *, n_bad = 0 AS succeeded FROM read_files
    UNION ALL SELECT DISTINCT file_id, 0, 0, 'missing column(s): {_MISSING}', FALSE FROM raw_files WHERE file_id LIKE '______07_SYM2.csv'
    UNION ALL SELECT '20240229_SYM0.csv', 0, 0, NULL, TRUE""",
)
def scan_directory(spark, sf):
    return feeds.file_status(rows_s(spark, sf), feed_s(spark, sf).files)


# ------------------------------------------------------------------- stage A ----


def _columns(name: str, style: str, columns: str, doubles: str = "") -> None:
    """Some Stage A columns as their own query."""
    rows, twin = (rows_s, _STAGE_S) if style == "s" else (rows_q, _STAGE_Q)
    query(name, f"WITH {twin} SELECT {columns} FROM rows_{style}", doubles)(
        lambda spark, sf: rows(spark, sf).selectExpr(*[c.strip() for c in columns.split(",")])
    )


_columns(
    "stage_a", "s", "file_id, ts, symbol, order_id, side, price, size, raw_type, new_size, new_price",
    "price size new_size new_price",
)
_columns(
    "stage_a_q", "q", "file_id, ts, symbol, order_id, side, price, size, raw_type, sequence, flags",
    "price size sequence flags",
)
_columns("ts_parse_unix_ns", "q", "file_id, order_id, ts")
_columns("ts_parse_iso_ns", "s", "file_id, order_id, ts")
_columns("symbol_resolve", "q", "symbol, order_id, ts")
_columns("order_id_cast", "q", "order_id, ts")
_columns("side_map", "s", "order_id, ts, side")
_columns("price_scale", "q", "order_id, ts, price", "price")
_columns("size_coalesce", "s", "order_id, ts, size", "size")
_columns("aux_passthrough", "s", "order_id, ts, new_size, new_price", "new_size new_price")


@query(
    "date_injection",
    f"""WITH {_RAW_S} SELECT file_id, order_id, CASE WHEN file_id <> 'nosymbol.csv' THEN
        strftime(CAST(ts AS DATE), '%Y-%m-%d') || ' ' || CASE WHEN {_BAD_CLOCK}
          THEN 'noon' ELSE strftime(ts, '%H:%M:%S.%f') || '7' END END AS stamped
      FROM (SELECT *, CAST(user_id AS VARCHAR) AS order_id FROM raw_s) r""",
)
def date_injection(spark, sf):
    raw = feeds.with_file_meta(feeds.scan_csv(spark, files_s(spark, sf), feeds.STYLE_S), feeds.STYLE_S)
    return feeds.with_injected_date(raw, feeds.STYLE_S).selectExpr("file_id", "order_id", "time_exchange as stamped")


@query(
    "midnight_correction",
    f"""WITH {_RAW_S} SELECT file_id, CAST(count(*) AS BIGINT) AS n_corrected FROM raw_s
      WHERE late AND file_id <> 'nosymbol.csv' GROUP BY file_id""",
)
def midnight_correction(spark, sf):
    raw = feeds.with_file_meta(feeds.scan_csv(spark, files_s(spark, sf), feeds.STYLE_S), feeds.STYLE_S)
    return (
        feeds.with_injected_date(raw, feeds.STYLE_S)
        .where("left(time_exchange, 10) < date_format(file_date, 'yyyy-MM-dd')")
        .groupBy("file_id")
        .count()
        .withColumnRenamed("count", "n_corrected")
    )


@query(
    "require_columns",
    f"""WITH {_RAW_S} SELECT DISTINCT file_id, CASE WHEN file_id LIKE '______07_SYM2.csv' THEN 'update_type' END AS missing FROM raw_files
      UNION ALL SELECT '20240229_SYM0.csv', NULL""",
)
def require_columns(spark, sf):
    return feed_s(spark, sf).files.select("file_id", "missing")


@query(
    "sort_stable",
    f"""WITH {_STAGE_Q.replace("AS flags FROM events", "AS flags, event_id FROM events")}
      SELECT row_number() OVER (ORDER BY ts, file_id, event_id) AS place, ts, file_id, order_id, raw_type FROM rows_q""",
)
def sort_stable(spark, sf):
    return feeds.numbered(rows_q(spark, sf), "place").select("place", "ts", "file_id", "order_id", "raw_type")


# --------------------------------------------------------------------- store ----

_DATED = f""", stored AS (SELECT {_EV}, strftime(make_timestamp(ts // 1000), '%Y-%m-%d') AS date FROM ev)"""


def _q(select: str) -> str:
    return f"WITH RECURSIVE {o.EVENTS_Q}{_DATED} {select}"


def _all_columns(spark, root):
    return spark.read.parquet(root).selectExpr(*EVENT_COLUMNS, "date")


def _public(spark, sf):
    return events_q(spark, sf).select(*EVENT_COLUMNS)


@once
def stored_q(spark, sf):
    root = fresh_path(spark, "store")
    store.write_events(_public(spark, sf), root)
    return root


@query("sink_events", _q(f"SELECT {_EV}, date FROM stored"), _NUM)
def sink_events(spark, sf):
    return _all_columns(spark, stored_q(spark, sf))


_LAST = "ts DESC NULLS LAST, side DESC NULLS LAST, event_type DESC NULLS LAST, price DESC NULLS LAST, size DESC NULLS LAST, remaining_size DESC NULLS LAST, reason DESC NULLS LAST"  # noqa: E501


@query(
    "sink_merge",
    _q(
        f""", old AS (SELECT *, 0 AS batch FROM stored WHERE event_seq % 3 <> 1),
        new AS (SELECT * REPLACE (size + 100 AS size), 1 AS batch FROM stored WHERE event_seq % 3 <> 0 OR event_seq % 2 = 0),
        shared AS (SELECT symbol, date FROM old INTERSECT SELECT symbol, date FROM new),
        both_batches AS (SELECT * FROM old UNION ALL SELECT * FROM new),
        kept AS (SELECT b.* FROM both_batches b JOIN shared USING (symbol, date) QUALIFY row_number() OVER (
          PARTITION BY symbol, date, order_id, session_id, event_seq ORDER BY batch DESC, {_LAST}) = 1)
        SELECT {_EV}, date FROM kept UNION ALL SELECT {_EV}, date FROM both_batches b
        WHERE NOT EXISTS (SELECT 1 FROM shared s WHERE s.symbol = b.symbol AND s.date = b.date)"""
    ),
    _NUM,
)
def sink_merge(spark, sf):
    root = fresh_path(spark, "store")
    events = _public(spark, sf)
    store.write_events(events.where("event_seq % 3 <> 1"), root)
    late = events.where("event_seq % 3 <> 0 or event_seq % 2 = 0").selectExpr(
        *[f"{c} + 100 as {c}" if c == "size" else c for c in EVENT_COLUMNS]
    )
    store.write_events(late, root, "merge")
    return _all_columns(spark, root)


@query(
    "sink_overwrite",
    _q(
        f""", new AS (SELECT * REPLACE (size + 100 AS size) FROM stored WHERE symbol = 'SYM1' AND event_seq = 0)
        SELECT {_EV}, date FROM stored s
        WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.symbol = s.symbol AND n.date = s.date)
        UNION ALL SELECT {_EV}, date FROM new"""
    ),
    _NUM,
)
def sink_overwrite(spark, sf):
    root = fresh_path(spark, "store")
    events = _public(spark, sf)
    store.write_events(events, root)
    new = events.where("symbol = 'SYM1' and event_seq = 0").selectExpr(
        *[f"{c} + 100 as {c}" if c == "size" else c for c in EVENT_COLUMNS]
    )
    store.write_events(new, root, "overwrite")
    return _all_columns(spark, root)


@query("sink_error_if_exists", _q("SELECT symbol, date, count(*) AS n FROM stored GROUP BY symbol, date"))
def sink_error_if_exists(spark, sf):
    root = stored_q(spark, sf)
    try:
        store.write_events(_public(spark, sf).where("symbol = 'SYM1'"), root, "error")
    except FileExistsError:
        return spark.read.parquet(root).groupBy("symbol", "date").count().withColumnRenamed("count", "n")
    raise AssertionError("an existing partition was written in error mode")


@query(
    "load_events",
    _q(f"SELECT {_EV} FROM stored WHERE symbol = 'SYM1' AND date BETWEEN '2024-01-02' AND '2024-01-06'"),
    _NUM,
)
def load_events(spark, sf):
    loaded = store.load_events(spark, stored_q(spark, sf), "databento", "SYM1", ("2024-01-02", "2024-01-06"))
    return loaded.select(*EVENT_COLUMNS)


@query(
    "list_available",
    _q("SELECT source, symbol, date, count(*) AS rows FROM stored GROUP BY source, symbol, date"),
)
def list_available(spark, sf):
    return store.list_available(spark, stored_q(spark, sf)).drop("path")


# files with an unreadable row are left out; days fed by several files keep the last file's copy
_PIPELINE = f"""WITH RECURSIVE {_STAGE_S},
  good AS (SELECT file_id FROM rows_s GROUP BY file_id HAVING count(*) FILTER (WHERE ts IS NULL OR symbol IS NULL) = 0),
  feed_s AS (SELECT r.* FROM rows_s r JOIN good USING (file_id)
    WHERE raw_type <> 'PING'),
  {o.EVENTS_S[len(o.FEED_S) + 1:]}
  {_DATED.replace('AS date FROM', 'AS date, file_id FROM')},
  shared AS (SELECT symbol, date FROM stored GROUP BY symbol, date HAVING count(DISTINCT file_id) > 1),
  kept AS (SELECT s.* FROM stored s JOIN shared USING (symbol, date) QUALIFY row_number() OVER (
    PARTITION BY symbol, date, order_id, session_id, event_seq ORDER BY file_id DESC, {_LAST}) = 1)
  SELECT {_EV}, date FROM kept UNION ALL SELECT {_EV}, date FROM stored s
  WHERE NOT EXISTS (SELECT 1 FROM shared h WHERE h.symbol = s.symbol AND h.date = s.date)"""


@query("pipeline_run", _PIPELINE, _NUM)
def pipeline_run(spark, sf):
    root = fresh_path(spark, "store")
    run_files(spark, files_s(spark, sf), "coinbase", root)
    return _all_columns(spark, root)

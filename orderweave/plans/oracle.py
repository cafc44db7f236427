"""DuckDB twins of the registered queries: plain SQL over the given tables.

Replay is written as a recursive query that walks each order row by row, so it shares
no logic with the array fold of the engine.
"""

from __future__ import annotations

_SYMBOL = "concat('SYM', CAST(user_id % 3 AS VARCHAR))"
_FEED = f"""{_SYMBOL} AS file_id, event_id AS line_no, {{ts}} AS ts, {_SYMBOL} AS symbol,
  CAST(user_id AS VARCHAR) AS order_id, CASE WHEN user_id % 2 = 0 THEN 'BID' ELSE 'ASK' END AS side,
  100 + floor(value * 4) / 4 AS price"""

FEED_S = f"""feed_s AS (SELECT {_FEED.format(ts="epoch_us(date_trunc('day', ts)) * 1000")},
  CAST((event_id * 7) % 5 AS DOUBLE) AS size,
  CASE WHEN event_id % 997 < 3 THEN 'SNAPSHOT' WHEN event_type = 'signup' THEN 'ADD'
    WHEN event_type = 'view' THEN 'SUB' WHEN event_type = 'purchase' THEN 'MATCH'
    WHEN event_type = 'click' THEN 'SET' WHEN event_type = 'error' THEN 'DELETE' END AS raw_type,
  CASE WHEN event_type = 'click' AND event_id % 4 <> 0 THEN CAST(event_id % 6 AS DOUBLE) END AS new_size,
  CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN 100 + floor(value * 2) / 4 END AS new_price
  FROM events)"""

FEED_Q = f"""feed_q AS (SELECT {_FEED.format(ts="epoch_us(ts) * 1000")},
  CAST(event_id % 5 AS DOUBLE) AS size,
  CASE WHEN event_id % 997 = 0 THEN 'R' WHEN event_id % 991 = 0 THEN 'N' WHEN event_type = 'signup' THEN 'A'
    WHEN event_type = 'click' THEN 'M' WHEN event_type = 'view' THEN 'C' WHEN event_type = 'purchase' THEN 'F'
    WHEN event_type = 'error' THEN 'T' END AS raw_type,
  CASE WHEN event_id % 101 = 0 THEN NULL ELSE event_id // 8 END AS sequence
  FROM events)"""

PAIRS_S = f"""{FEED_S},
noop_keys AS (SELECT DISTINCT d.file_id, d.order_id, d.ts FROM feed_s d JOIN feed_s a
  ON a.file_id = d.file_id AND a.order_id = d.order_id AND a.ts = d.ts
  WHERE d.raw_type = 'DELETE' AND d.size = 0 AND a.raw_type = 'ADD'),
reprice_keys AS (SELECT DISTINCT s.file_id, s.order_id, s.ts FROM feed_s s JOIN feed_s a
  ON a.file_id = s.file_id AND a.order_id = s.order_id AND a.ts = s.ts
  WHERE s.raw_type = 'SUB' AND a.raw_type = 'ADD' AND abs(s.size - a.size) <= 1e-9)"""

SESSIONS_S = f"""{PAIRS_S},
effective AS (SELECT f.*, r.ts IS NOT NULL AS reprice FROM feed_s f
  LEFT JOIN noop_keys n ON n.file_id = f.file_id AND n.order_id = f.order_id AND n.ts = f.ts
  LEFT JOIN reprice_keys r ON r.file_id = f.file_id AND r.order_id = f.order_id AND r.ts = f.ts
  WHERE NOT (n.ts IS NOT NULL AND f.raw_type IN ('DELETE', 'ADD'))),
opened AS (SELECT *, raw_type = 'SNAPSHOT' AND coalesce(lag(raw_type)
    OVER (PARTITION BY file_id ORDER BY ts, line_no), '') <> 'SNAPSHOT' AS opens FROM effective),
sessions AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END)
    OVER (PARTITION BY file_id ORDER BY ts, line_no) AS INTEGER) AS session_id FROM opened)"""

GROUPS_Q = f"""{FEED_Q},
seq_groups AS (SELECT file_id, coalesce(sequence, 0) AS seq_no, min((ts, line_no)) AS first_pos,
  bool_or(raw_type = 'F') AS is_fill, bool_or(raw_type = 'F') AND bool_or(raw_type = 'T') AS is_trade
  FROM feed_q GROUP BY ALL)"""

SESSIONS_Q = f"""{GROUPS_Q},
opened AS (SELECT f.*, g.first_pos, g.is_fill, g.is_trade, f.raw_type = 'R' AS opens,
  NULL::DOUBLE AS new_size, NULL::DOUBLE AS new_price, false AS reprice
  FROM feed_q f JOIN seq_groups g ON g.file_id = f.file_id AND g.seq_no = coalesce(f.sequence, 0)
  WHERE f.raw_type IN ('A', 'M', 'C', 'R')),
sessions AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END)
    OVER (PARTITION BY file_id ORDER BY first_pos, ts, line_no) AS INTEGER) AS session_id FROM opened)"""

_ACT_S = """CASE WHEN o.raw_type IN ('SNAPSHOT') OR (o.raw_type = 'ADD' AND NOT (o.reprice AND s.live)) THEN 'NEW'
  WHEN NOT s.live THEN 'NONE' WHEN o.raw_type = 'ADD' THEN 'REPRICE' WHEN o.raw_type IN ('SUB', 'MATCH') THEN 'FILL'
  WHEN o.raw_type = 'SET' THEN 'CHANGE' WHEN o.raw_type = 'DELETE' AND o.size = 0 THEN 'NONE'
  WHEN coalesce(s.rem - o.size > 0, false) THEN 'PART' ELSE 'CANCEL' END"""
_ACT_Q = """CASE WHEN o.raw_type = 'A' OR (o.raw_type = 'M' AND NOT s.live) THEN 'NEW' WHEN NOT s.live THEN 'NONE'
  WHEN o.raw_type = 'M' THEN 'CHANGE' WHEN o.is_fill THEN 'FILL'
  WHEN coalesce(s.rem - o.size <= 0, false) THEN 'CANCEL' ELSE 'PART' END"""


def _walk(style: str) -> str:
    s = style == "S"
    act = _ACT_S if s else _ACT_Q
    order = "ts, line_no" if s else "first_pos, ts, line_no"
    keep = "NOT (raw_type = 'SUB' AND reprice)" if s else "raw_type <> 'R'"
    size, price = ("o.new_size", "o.new_price") if s else ("o.size", "o.price")
    sized = f"{size} IS NOT NULL" if s else f"{size} IS NOT NULL AND {size} IS DISTINCT FROM s.rem"
    priced = f"{price} IS NOT NULL" if s else f"{price} IS NOT NULL AND {price} IS DISTINCT FROM s.prc"
    trade = "o.raw_type = 'MATCH'" if s else "o.is_trade"
    survives_fill = "true" if s else "coalesce(rem_left > 0, true)"
    source = "COINBASE" if s else "DATABENTO"
    return f"""
ops AS (SELECT *, row_number() OVER (PARTITION BY file_id, session_id, order_id ORDER BY {order}) AS rn
  FROM sessions WHERE {keep}),
walk AS (
  SELECT file_id, session_id, order_id, CAST(0 AS BIGINT) AS rn, false AS live, NULL::DOUBLE AS rem,
    NULL::DOUBLE AS prc, NULL::VARCHAR AS sd, 0 AS seq, 'NONE' AS act, false AS sized, false AS priced
  FROM ops WHERE rn = 1
  UNION ALL
  SELECT file_id, session_id, order_id, rn,
    CASE act WHEN 'NEW' THEN true WHEN 'CANCEL' THEN false WHEN 'FILL' THEN {survives_fill} ELSE live END,
    CASE WHEN act IN ('NEW', 'REPRICE') THEN o_size WHEN act IN ('FILL', 'PART') THEN rem_left
      WHEN act = 'CANCEL' THEN 0 WHEN act = 'CHANGE' AND sized THEN new_size ELSE rem END,
    CASE WHEN act IN ('NEW', 'REPRICE') THEN o_price WHEN act = 'CHANGE' AND priced THEN new_price ELSE prc END,
    CASE WHEN act = 'NEW' THEN o_side ELSE sd END,
    CASE act WHEN 'NEW' THEN 0 WHEN 'NONE' THEN seq
      WHEN 'CHANGE' THEN seq + CAST(sized AS INTEGER) + CAST(priced AS INTEGER) ELSE seq + 1 END,
    act, sized, priced
  FROM (
    SELECT s.file_id, s.session_id, s.order_id, o.rn, s.live, s.rem, s.prc, s.sd, s.seq, {act} AS act,
      {sized} AS sized, {priced} AS priced, {size} AS new_size, {price} AS new_price,
      o.size AS o_size, o.price AS o_price, o.side AS o_side,
      CASE WHEN s.rem - o.size IS NULL THEN NULL ELSE greatest(s.rem - o.size, 0) END AS rem_left
    FROM walk s JOIN ops o ON o.file_id = s.file_id AND o.session_id = s.session_id
      AND o.order_id = s.order_id AND o.rn = s.rn + 1) step),
first_events AS (
  SELECT w.order_id, w.session_id, o.symbol, o.side,
    CASE act WHEN 'NEW' THEN 'ADD' WHEN 'FILL' THEN 'FILL' WHEN 'CANCEL' THEN 'CANCEL' ELSE 'MODIFY' END AS event_type,
    CASE WHEN act = 'CHANGE' THEN seq - CAST(priced AS INTEGER) ELSE seq END AS event_seq, o.ts, o.price,
    CASE WHEN act = 'CHANGE' THEN rem ELSE o.size END AS size, w.rem AS remaining_size,
    CASE act WHEN 'REPRICE' THEN 'PRICE_CHANGE' WHEN 'CHANGE' THEN 'SIZE_CHANGE' WHEN 'PART' THEN 'PARTIAL_DELETE'
      WHEN 'CANCEL' THEN 'CANCELLED' WHEN 'FILL' THEN (CASE WHEN w.rem <= 0 THEN 'FULL_FILL' ELSE 'PARTIAL_FILL' END)
        || (CASE WHEN {trade} THEN '_TRADE' ELSE '' END) END AS reason, w.file_id
  FROM walk w JOIN ops o USING (file_id, session_id, order_id, rn)
  WHERE act <> 'NONE' AND (act <> 'CHANGE' OR sized)),
second_events AS (
  SELECT w.order_id, w.session_id, o.symbol, o.side, 'MODIFY' AS event_type, seq AS event_seq, o.ts, prc AS price,
    rem AS size, rem AS remaining_size, 'PRICE_CHANGE' AS reason, w.file_id
  FROM walk w JOIN ops o USING (file_id, session_id, order_id, rn) WHERE act = 'CHANGE' AND priced),
last_states AS (SELECT * FROM walk QUALIFY row_number()
  OVER (PARTITION BY file_id, session_id, order_id ORDER BY rn DESC) = 1),
ends AS (SELECT file_id, session_id - 1 AS session_id, ts, symbol FROM sessions WHERE opens),
resets AS (
  SELECT l.order_id, l.session_id, e.symbol, l.sd AS side, 'CANCEL' AS event_type, l.seq + 1 AS event_seq, e.ts,
    l.prc AS price, l.rem AS size, CAST(0 AS DOUBLE) AS remaining_size, 'SNAPSHOT_RESET' AS reason, l.file_id
  FROM last_states l JOIN ends e USING (file_id, session_id) WHERE l.live),
ev AS (
  SELECT order_id, session_id, symbol, '{source}' AS source, side, event_type, event_seq, ts, price, size,
    remaining_size, reason, file_id
  FROM (SELECT * FROM first_events UNION ALL SELECT * FROM second_events UNION ALL SELECT * FROM resets) all_events)"""


EVENTS_S = f"{SESSIONS_S}, {_walk('S')}"
EVENTS_Q = f"{SESSIONS_Q}, {_walk('Q')}"
PUBLIC = "order_id, session_id, symbol, source, side, event_type, event_seq, ts, price, size, remaining_size, reason"

LIFETIME = """lt AS (
  SELECT order_id, session_id, symbol, source, file_id, born.ts AS born_ts, born.price AS born_price,
    born.size AS born_size, died.ts AS died_ts, died.price AS died_price,
    CASE died.event_type WHEN 'FILL' THEN 'FILLED' WHEN 'CANCEL' THEN 'CANCELLED' ELSE 'OPEN_AT_EOD' END AS outcome,
    died.ts - born.ts AS duration_ns, fill_count, partial_fill_count, modify_count, total_filled_size,
    CASE WHEN died.event_type = 'CANCEL' THEN died.size ELSE 0 END AS cancel_size,
    concat_ws('|', CASE WHEN adds > 1 THEN 'MULTI_ADD' END,
      CASE WHEN total_filled_size > born.size + 1e-9 THEN 'OVERFILL' END,
      CASE WHEN low < -1e-9 THEN 'NEG_REMAINING' END, CASE WHEN bad_seq THEN 'BAD_SEQ' END) AS anomalies
  FROM (
    SELECT order_id, session_id, source, file_id, arg_min(symbol, (event_seq, ts)) AS symbol,
      count(*) FILTER (WHERE event_type = 'ADD') AS adds,
      arg_min({'ts': ts, 'price': price, 'size': size}, (event_seq, ts, price, size))
        FILTER (WHERE event_type = 'ADD') AS born,
      arg_max({'ts': ts, 'price': price, 'size': size, 'event_type': event_type},
          (event_seq, ts, event_type, price, size))
        FILTER (WHERE event_type IN ('FILL', 'CANCEL')) AS died,
      count(*) FILTER (WHERE event_type = 'FILL') AS fill_count,
      count(*) FILTER (WHERE reason IN ('PARTIAL_FILL', 'PARTIAL_FILL_TRADE')) AS partial_fill_count,
      count(*) FILTER (WHERE event_type = 'MODIFY') AS modify_count,
      coalesce(sum(size) FILTER (WHERE event_type = 'FILL'), 0) AS total_filled_size, min(remaining_size) AS low,
      count(DISTINCT event_seq) <> count(*) OR max(event_seq) - min(event_seq) + 1 <> count(*) AS bad_seq
    FROM ev GROUP BY order_id, session_id, source, file_id) g
  WHERE adds > 0)"""

ORDERS = """ticks AS (
  SELECT symbol, ts, max(price) FILTER (WHERE side = 'BID' AND event_type IN ('ADD', 'MODIFY')) AS bid,
    min(price) FILTER (WHERE side = 'ASK' AND event_type IN ('ADD', 'MODIFY')) AS ask FROM ev GROUP BY symbol, ts),
mids AS (
  SELECT symbol, ts, last_value(bid IGNORE NULLS) OVER w AS best_bid, last_value(ask IGNORE NULLS) OVER w AS best_ask
  FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
placed AS (
  SELECT e.symbol, e.order_id, e.session_id, e.ts, e.side, e.price, e.size, (best_bid + best_ask) / 2 AS midprice,
    abs(e.price - (best_bid + best_ask) / 2) AS abs_dist,
    abs(e.price - (best_bid + best_ask) / 2) / ((best_bid + best_ask) / 2) * 10000 AS abs_dist_bps,
    CASE WHEN EXISTS (SELECT 1 FROM ev f WHERE f.symbol = e.symbol AND f.order_id = e.order_id
      AND f.event_type = 'FILL') THEN 1 ELSE 0 END AS filled
  FROM ev e JOIN mids m ON m.symbol = e.symbol AND m.ts = e.ts
  WHERE e.event_type = 'ADD' AND best_bid IS NOT NULL AND best_ask IS NOT NULL),
xs AS (SELECT symbol, abs_dist AS x, order_id, session_id, ts, price, size FROM placed WHERE filled = 1)"""

PAIRS = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, order_id, session_id, price, size) AS row_no FROM placed),
rolled AS (
  SELECT *, avg(filled) OVER w AS avg_fill, count(filled) OVER w AS n_fill FROM numbered
  WINDOW w AS (PARTITION BY symbol ORDER BY row_no ROWS BETWEEN 250 PRECEDING AND 249 FOLLOWING)),
known AS (SELECT symbol, row_no, abs_dist AS x, avg_fill AS y FROM rolled WHERE n_fill >= 50),
pairs AS (SELECT k.* FROM known k
  JOIN (SELECT symbol, quantile_cont(x, 0.995) AS top FROM known GROUP BY symbol) t USING (symbol) WHERE x <= top)"""

RANKS = """ranks AS (
  SELECT *, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0 AS ry,
    count(*) OVER (PARTITION BY symbol) AS total FROM pairs)"""

PCA = """cov AS (
  SELECT symbol, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, var_samp(a) AS var_a, var_samp(b) AS var_b,
    covar_samp(a, b) AS cov_ab FROM (SELECT symbol, ln(1 + x) AS a, y AS b FROM pairs) l GROUP BY symbol),
eig AS (
  SELECT *, (var_a + var_b) / 2 + sqrt(((var_a - var_b) / 2) ** 2 + cov_ab ** 2) AS eig1,
    (var_a + var_b) / 2 - sqrt(((var_a - var_b) / 2) ** 2 + cov_ab ** 2) AS eig2,
    0.5 * atan2(2 * cov_ab, var_a - var_b) AS theta FROM cov),
pca AS (SELECT symbol, n, mean_a, mean_b, var_a, var_b, cov_ab, eig1, eig2, cos(theta) AS pc1_a, sin(theta) AS pc1_b,
    eig1 / (eig1 + eig2) AS pve1 FROM eig)"""


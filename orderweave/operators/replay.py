"""Replay of each order's history into the unified event table.

Stage A rows of both feed styles become fold operations, get a session number in
file order, and are folded per (file, session, order) with plain double arithmetic.
Books are cleared at a session boundary, so those groups are independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderweave.operators import scan
from orderweave.operators.scan import Chunks, attach, marks_so_far, run_numbers
from orderweave.session import configure, pin, sql

EVENT_COLUMNS = [
    "order_id", "session_id", "symbol", "source", "side", "event_type",
    "event_seq", "ts", "price", "size", "remaining_size", "reason",
]

# Longest history folded inside one row; longer ones are cut into slices, whose effects are chained.
FOLD_ROWS = 5_000
# Rows of a history folded at a time; near the square root of FOLD_ROWS, so that neither level copies much.
RUN_ROWS = 64

_ORDER_KEY = ["file_id", "session_id", "order_id"]


# ---------------------------------------------------------------- style-S ----


def same_instant_pairs(rows: DataFrame) -> DataFrame:
    """Per (file, order, ts): ``noop`` (zero DELETE with an ADD) and ``reprice`` (SUB and ADD of equal size).

    Sizes are equal within 1e-9. Distinct sizes share a cell of one of two shifted grids if they
    are that close, so only neighbours inside a cell need comparing."""
    key = "file_id, order_id, ts"
    groups = sql(
        f"""
        select {key}, count(*) as n_rows,
          coalesce(max(raw_type = 'DELETE' and size = 0), false) as zero_delete, max(raw_type = 'ADD') as has_add,
          max(raw_type = 'ADD') and max(raw_type = 'SUB') as both_kinds
        from {{rows}} group by {key}
        """,
        rows=rows,
    )
    sizes = sql(
        f"""
        select {key}, size, max(raw_type = 'ADD') as is_add, max(raw_type = 'SUB') as is_sub
        from {{rows}} where raw_type in ('ADD', 'SUB') and size is not null group by {key}, size
        """,
        rows=rows,
    )
    # only instants that can matter, and the large ones, which need care in the joins
    groups = pin(groups.where(f"both_kinds or (zero_delete and has_add) or n_rows > {scan.HOT_ROWS}"), "instants")
    sizes = attach(sizes, groups, ["file_id", "order_id", "ts"], ["both_kinds"], "size", pinned=True)
    return sql(
        f"""
        with celled as (
          select {key}, size, is_add, is_sub, shift,
            if(abs(size) < 1e12, floor(size * 1e6 + shift), null) as cell
          from {{sizes}} lateral view explode(array(0D, 0.5D)) as shift
          where both_kinds
        ), neighbours as (
          select *, lag(struct(size, is_add, is_sub))
            over (partition by {key}, shift, cell order by size) as prev
          from celled
        ), repriced as (
          select {key}, true as reprice from neighbours
          where (is_add and is_sub)
            or (size - prev.size <= 1e-9D and ((is_add and prev.is_sub) or (is_sub and prev.is_add)))
          group by {key}
        )
        select g.file_id, g.order_id, g.ts, n_rows, zero_delete and has_add as noop, coalesce(reprice, false) as reprice
        from {{groups}} g left join repriced p on g.file_id <=> p.file_id and g.order_id <=> p.order_id and g.ts <=> p.ts
        """,
        sizes=sizes,
        groups=groups,
    )


def effective_rows_s(rows: DataFrame) -> DataFrame:
    """Known types only, pairs flagged, no-op pairs removed."""
    rows = rows.where("raw_type in ('ADD', 'SUB', 'MATCH', 'SET', 'DELETE', 'SNAPSHOT')")
    pairs = same_instant_pairs(rows)
    flagged = attach(
        rows, pairs, ["file_id", "order_id", "ts"], ["noop", "reprice"], "line_no", "noop or reprice"
    )
    return flagged.where("not (coalesce(noop, false) and raw_type in ('DELETE', 'ADD'))").drop("noop")


def sessionize_s(rows: DataFrame) -> DataFrame:
    """Number the book sessions: each run of SNAPSHOT rows in file order opens one. Rows are pinned."""
    rows, flag, order = pin(rows, "effective"), "raw_type = 'SNAPSHOT'", ["ts", "line_no"]
    numbered = run_numbers(rows, flag, ["file_id"], order, "opens", "session_id")
    if numbered is None:
        numbered = Chunks(rows, ["file_id"], order, "sessions").runs(flag, "opens", "session_id")
    return pin(numbered, "sessioned")


def _operations_s(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "*",
        """case when raw_type = 'SNAPSHOT' then 'ADD'
                when raw_type = 'ADD' and reprice then 'REPRICE'
                when raw_type = 'SUB' and reprice then null
                else raw_type end as op""",
    ).where("op is not null")


# ---------------------------------------------------------------- style-Q ----

_SEQUENCE = "coalesce(cast(sequence as bigint), 0) as seq_no"
_Q_ORDER = ["g_ts", "g_line", "ts", "line_no"]


def sequence_groups(rows: DataFrame) -> DataFrame:
    """Per (file, sequence): first position and whether F / T records are present. No sequence counts as 0."""
    return sql(
        """
        select file_id, seq_no, count(*) as n_rows,
          min(struct(ts, line_no)).ts as g_ts, min(struct(ts, line_no)).line_no as g_line,
          max(raw_type = 'F') as is_fill, max(raw_type = 'F') and max(raw_type = 'T') as is_trade
        from {rows} group by file_id, seq_no
        """,
        rows=rows.selectExpr("*", _SEQUENCE),
    )


def effective_rows_q(rows: DataFrame) -> DataFrame:
    """Rows that act on the book, with the position and fill flags of their sequence group."""
    acting = rows.selectExpr("*", _SEQUENCE).where("raw_type in ('A', 'M', 'C', 'R')")
    values = ["g_ts", "g_line", "is_fill", "is_trade"]
    return attach(acting, sequence_groups(rows), ["file_id", "seq_no"], values, "line_no")


def sessionize_q(rows: DataFrame) -> DataFrame:
    """Number the book sessions: every R row opens one. Rows are pinned."""
    rows = pin(rows.selectExpr("*", "raw_type = 'R' as opens"), "effective")
    numbered = marks_so_far(rows, "opens", ["file_id"], _Q_ORDER, "session_id")
    if numbered is None:
        chunks = Chunks(rows, ["file_id"], _Q_ORDER, "sessions")
        numbered = chunks.scan(sums={"_opened": "cast(opens as int)"}).selectExpr("*", "cast(_opened as int) as session_id")
    return pin(numbered, "sessioned")


def _operations_q(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "*",
        """case raw_type when 'A' then 'ADD' when 'M' then 'REPLACE'
             when 'C' then case when is_trade then 'TAKE_TRADE' when is_fill then 'TAKE' else 'CUT' end
           end as op""",
    ).where("op is not null")


# ------------------------------------------------------------------- fold ----
# SQL text of one fold step: ``a`` is the accumulator, ``r`` the row. A missing operand
# makes the remainder missing, as NaN does in floating point.

_LEFT = "if(a.remaining <= r.size, 0D, a.remaining - r.size)"
_EMPTY = "coalesce(a.remaining <= r.size, false)"
_NO_EVENT = """cast(array() as array<struct<symbol string, side string, event_type string, event_seq int,
  ts bigint, price double, size double, remaining_size double, reason string>>)"""
_DEAD = """named_struct('live', false, 'remaining', cast(null as double), 'price', cast(null as double),
  'side', cast(null as string), 'seq', 0)"""


def _event(kind: str, seq: str, size: str, remaining: str, reason: str, price: str = "r.price") -> str:
    return f"""named_struct('symbol', r.symbol, 'side', r.side, 'event_type', '{kind}', 'event_seq', {seq},
      'ts', r.ts, 'price', {price}, 'size', {size}, 'remaining_size', {remaining}, 'reason', {reason})"""


def _next(live: str, remaining: str, price: str, side: str, seq: str, *events: str) -> str:
    out = f"concat(a.out, array({', '.join(events)}))" if events else "a.out"
    return f"""named_struct('live', {live}, 'remaining', {remaining}, 'price', {price}, 'side', {side},
      'seq', {seq}, 'out', {out})"""


def _add() -> str:
    event = _event("ADD", "0", "r.size", "r.size", "cast(null as string)")
    return _next("true", "r.size", "r.price", "r.side", "0", event)


def _reprice() -> str:
    event = _event("MODIFY", "a.seq + 1", "r.size", "r.size", "'PRICE_CHANGE'")
    return _next("true", "r.size", "r.price", "a.side", "a.seq + 1", event)


def _fill(suffix: str, forget_empty: bool) -> str:
    reason = f"if({_EMPTY}, 'FULL_FILL{suffix}', 'PARTIAL_FILL{suffix}')"
    live = f"not {_EMPTY}" if forget_empty else "true"
    return _next(
        live, _LEFT, "a.price", "a.side", "a.seq + 1", _event("FILL", "a.seq + 1", "r.size", _LEFT, reason)
    )


def _change(size: str, price: str, sized: str, priced: str) -> str:
    """SIZE_CHANGE then PRICE_CHANGE, each only under its condition."""

    def sized_event(remaining):
        return _event("MODIFY", "a.seq + 1", remaining, remaining, "'SIZE_CHANGE'")

    def priced_event(seq, remaining):
        return _event("MODIFY", seq, remaining, remaining, "'PRICE_CHANGE'", price)

    both = _next("true", size, price, "a.side", "a.seq + 2", sized_event(size), priced_event("a.seq + 2", size))
    only_size = _next("true", size, "a.price", "a.side", "a.seq + 1", sized_event(size))
    only_price = _next("true", "a.remaining", price, "a.side", "a.seq + 1", priced_event("a.seq + 1", "a.remaining"))
    return f"""case when {sized} and {priced} then {both} when {sized} then {only_size}
      when {priced} then {only_price} else a end"""


def _remove(survives: str) -> str:
    """What is left survives as a partial delete, otherwise the order is cancelled and forgotten."""
    partial = _event("MODIFY", "a.seq + 1", "r.size", _LEFT, "'PARTIAL_DELETE'")
    cancel = _event("CANCEL", "a.seq + 1", "r.size", "0D", "'CANCELLED'")
    return f"""if({survives}, {_next("true", _LEFT, "a.price", "a.side", "a.seq + 1", partial)},
      {_next("false", "0D", "a.price", "a.side", "a.seq + 1", cancel)})"""


def _step_s() -> str:
    change = _change("r.new_size", "r.new_price", "r.new_size is not null", "r.new_price is not null")
    return f"""case
      when r.op = 'ADD' or (r.op = 'REPRICE' and not a.live) then {_add()}
      when not a.live then a
      when r.op = 'REPRICE' then {_reprice()}
      when r.op = 'SUB' then {_fill("", False)}
      when r.op = 'MATCH' then {_fill("_TRADE", False)}
      when r.op = 'SET' then {change}
      when r.op = 'DELETE' and coalesce(r.size = 0, false) then a
      when r.op = 'DELETE' then {_remove("coalesce(a.remaining > r.size, false)")}
      else a end"""


def _step_q() -> str:
    change = _change(
        "r.size", "r.price",
        "(r.size is not null and not (r.size <=> a.remaining))",
        "(r.price is not null and not (r.price <=> a.price))",
    )
    return f"""case
      when r.op = 'ADD' or (r.op = 'REPLACE' and not a.live) then {_add()}
      when not a.live then a
      when r.op = 'REPLACE' then {change}
      when r.op = 'TAKE' then {_fill("", True)}
      when r.op = 'TAKE_TRADE' then {_fill("_TRADE", True)}
      when r.op = 'CUT' then {_remove(f"not {_EMPTY}")}
      else a end"""


def _fold(style: str, state: str = _DEAD, history: str = "history") -> str:
    """Fold of the array ``history`` from ``state``: last state fields and the emitted events.

    Every step copies the events emitted so far, so the history is folded RUN_ROWS rows at a time: a run copies
    its own events only, and the list of runs, which grows by one per run, is flattened once at the end."""

    def fields(of: str, out: str) -> str:
        return f"""named_struct('live', {of}.live, 'remaining', {of}.remaining, 'price', {of}.price,
          'side', {of}.side, 'seq', {of}.seq, 'out', {out})"""

    step = _step_s() if style == "S" else _step_q()
    run = f"""aggregate(slice({history}, k * {RUN_ROWS} + 1, {RUN_ROWS}), {fields("runs", _NO_EVENT)}, (a, r) -> {step},
      a -> {fields("a", "concat(runs.out, array(a.out))")})"""
    return f"""aggregate(sequence(0, (size({history}) - 1) div {RUN_ROWS}), {fields(state, f"slice(array({_NO_EVENT}), 1, 0)")},
      (runs, k) -> {run}, runs -> {fields("runs", "flatten(runs.out)")})"""


def _packed(order: list[str]) -> str:
    """A row as it is collected into its order's history; the position sorts first."""
    columns = [*order, *[c for c in ("op", "symbol", "side", "price", "size", "new_size", "new_price")]]
    return f"array_sort(collect_list(struct({', '.join(columns)}))) as history"


def _state(f: str) -> str:
    return f"named_struct('live', {f}.live, 'remaining', {f}.remaining, 'price', {f}.price, 'side', {f}.side, 'seq', {f}.seq)"


_FOLDED_STATE = f"{_state('f')} as state"


def _fold_short(ops: DataFrame, order: list[str], style: str) -> DataFrame:
    key = ", ".join(_ORDER_KEY)
    return sql(
        f"""
        with histories as (select {key}, {_packed(order)} from {{ops}} group by {key}),
        folded as (select {key}, {_fold(style)} as f from histories)
        select {key}, {_FOLDED_STATE}, f.out as out from folded
        """,
        ops=ops,
    )


# ---------------------------------------------------- effects of a slice ----
# What a slice of a history does to whatever state comes in, as a small value. Up to the end of its *head* the outcome depends
# on the incoming state, so the head's rows are part of the value. The head ends with the first row that fixes what later
# rows ask for: the remaining size (and in style Q, which compares prices, the price). From there on the slice leads to
# one of two states, for an order that is live then and for one that is gone; whatever is not set in between is marked, and taken
# from the state after the head. A slice without such a row mostly takes sizes away: max(x - a, b) if x > t, else the
# order is gone.

# marks, outside all values that occur: a price, a side and a sequence number carried over from before
_CARRIED_PRICE, _CARRIED_SIDE, _CARRIED_SEQ = "-1.25e300D", "'<carried>'", 1 << 30
# the state of a live order after the row ``r`` that fixes it
_FIXED = {
    style: f"named_struct('live', true, 'remaining', {size}, 'price', {price}, 'side', {_CARRIED_SIDE}, 'seq', {_CARRIED_SEQ})"
    for style, size, price in (("S", "if(r.op = 'SET', r.new_size, r.size)", _CARRIED_PRICE), ("Q", "r.size", "r.price"))
}

# sizes that are multiples of 2**-20 and add up to less than 2**32 are added and subtracted without rounding
_INEXACT = """if(coalesce((op in ('SET', 'REPLACE') or size * 1048576D = floor(size * 1048576D))
  and coalesce(new_size * 1048576D = floor(new_size * 1048576D), true)
  and (op <> 'REPLACE' or coalesce(size * 1048576D = floor(size * 1048576D), true)), false), 0L, 1L)"""

_FIXES = {
    "S": "r.op in ('ADD', 'REPRICE') or (r.op = 'SET' and r.new_size is not null)",
    "Q": "r.op = 'ADD' or (r.op = 'REPLACE' and r.size is not null and r.price is not null)",
}
_TAKES = {"S": "r.op in ('SUB', 'MATCH', 'DELETE', 'SET')", "Q": "r.op in ('TAKE', 'TAKE_TRADE', 'CUT')"}


def _taken(style: str) -> str:
    """The effect of rows that only take away."""
    mortal = {"S": "r.op = 'DELETE'", "Q": "true"}[style]
    idle = {"S": "(r.op = 'DELETE' and r.size = 0) or (r.op = 'SET' and r.new_price is null)", "Q": "false"}[style]
    return f"""aggregate(history, named_struct('a', 0D, 'b', double('-Infinity'), 't', double('-Infinity'), 'seq', 0,
        'price', cast(null as double)), (c, r) -> case when {idle} then c
      when r.op = 'SET' then named_struct('a', c.a, 'b', c.b, 't', c.t, 'seq', c.seq + 1, 'price', r.new_price)
      else named_struct('a', c.a + r.size, 'b', greatest(c.b - r.size, 0D),
        't', if({mortal} and not c.b > r.size, greatest(c.t, c.a + r.size), c.t), 'seq', c.seq + 1, 'price', c.price) end)"""


def _bound(expression: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for the value of ``expression``."""
    return f"element_at(transform(array({expression}), {name} -> {body}), 1)"


def _effect(style: str) -> str:
    """The effect of the array ``history``; ``n_head`` is the length of its head, 0 if nothing is fixed."""
    tail = "slice(history, n_head + 1, size(history))"
    after = _bound("history[n_head - 1]", "r", _bound(_FIXED[style], "mid", _bound(_fold(style, "mid", tail), "f", _state("f"))))
    gone = _bound(_fold(style, _DEAD, tail), "f", _state("f"))
    takes = f"n_head = 0 and exact and forall(history, r -> {_TAKES[style]})"
    return f"""named_struct('takes', if({takes}, {_taken(style)}, null), 'head', case when n_head > 0 then slice(history, 1, n_head)
        when {takes} then slice(history, 1, 0) else history end,
      'live', if(n_head > 0, {after}, null), 'gone', if(n_head > 0, {gone}, null))"""


def _applied(style: str) -> str:
    """The state that the effect ``m`` makes of the state ``s``."""
    left = f"""named_struct('live', true, 'remaining', greatest(s.remaining - m.takes.a, m.takes.b),
      'price', coalesce(m.takes.price, s.price), 'side', s.side, 'seq', s.seq + m.takes.seq)"""
    chained = f"""named_struct('live', m.live.live, 'remaining', m.live.remaining,
      'price', if(m.live.price <=> {_CARRIED_PRICE}, mid.price, m.live.price),
      'side', if(m.live.side <=> {_CARRIED_SIDE}, mid.side, m.live.side),
      'seq', if(m.live.seq >= {_CARRIED_SEQ}, mid.seq + m.live.seq - {_CARRIED_SEQ}, m.live.seq))"""
    slow = _bound(_fold(style, "s", "m.head"), "mid", f"case when m.live is null then {_state('mid')} when mid.live then {chained} else m.gone end")
    return f"""case when m.takes is null then {slow} when not s.live then s when s.remaining <= m.takes.t then {_DEAD} else {left} end"""


def _fold_long(ops: DataFrame, order: list[str], style: str) -> tuple[DataFrame, DataFrame]:
    """Histories longer than FOLD_ROWS, in slices of that length counted from each fresh ADD, which resets the state.

    All slices are first summed up by their effects, at the same time; the effects of one life are chained, which gives
    the state that each slice starts from; then all slices are folded, at the same time. Nothing waits for a slice but
    the chain, which sees a few rows of each. The events and the double arithmetic are those of a row-by-row replay: only
    where sizes add up without rounding does a slice that takes sizes away stand for all its rows in the chain.

    Returns the emitted events per piece and the last state of each order."""
    chunks = Chunks(ops, _ORDER_KEY, order, "long-orders")
    numbered = chunks.scan(
        sums={"life": "if(op = 'ADD', 1L, 0L)", "row_no": "1L"},
        totals={"inexact": _INEXACT, "volume": "abs(coalesce(size, 0D)) + abs(coalesce(new_size, 0D))"},
    )
    numbered = chunks.scan(numbered, lasts={"born_row": "if(op = 'ADD', row_no, null)"})
    cut = numbered.selectExpr(
        "*", f"(row_no - coalesce(born_row, 1)) div {FOLD_ROWS} as slice", "inexact = 0 and volume < 4294967296D as exact"
    )
    key = [*_ORDER_KEY, "life"]
    keys = ", ".join(key)
    head = f"array_position(transform(history, r -> coalesce({_FIXES[style]}, false)), true)"
    slices = sql(
        f"select {keys}, slice, bool_and(exact) as exact, {_packed(order)} from {{cut}} group by {keys}, slice", cut=cut
    ).selectExpr("*", f"cast({head} as int) as n_head")
    slices = pin(slices.selectExpr(*key, "slice", "history", f"{_effect(style)} as effect"), "slices")

    # the states before each slice of a life, in runs as in _fold
    step = f"""aggregate(slice(effects.effect, k * {RUN_ROWS} + 1, {RUN_ROWS}), named_struct('s', runs.s, 'before', slice(array(runs.s), 1, 0)),
      (x, m) -> named_struct('s', {_bound("x.s", "s", _applied(style))}, 'before', concat(x.before, array(x.s))),
      x -> named_struct('s', x.s, 'before', concat(runs.before, array(x.before))))"""
    chain = f"""aggregate(sequence(0, (size(effects) - 1) div {RUN_ROWS}), named_struct('s', {_DEAD}, 'before', slice(array(array({_DEAD})), 1, 0)),
      (runs, k) -> {step}, runs -> flatten(runs.before))"""
    before = sql(
        f"""
        with lives as (
          select {keys}, array_sort(collect_list(struct(slice, effect))) as effects from {{slices}} group by {keys}
        )
        select {keys}, posexplode({chain}) as (slice, state) from lives
        """,
        slices=slices,
    )
    before = pin(before, "before")
    same = " and ".join(f"h.{c} <=> b.{c}" for c in key)
    started = sql(
        f"select h.{', h.'.join(key)}, h.slice, h.history, b.state from {{slices}} h join {{before}} b on {same} and h.slice = b.slice",
        slices=slices,
        before=before,
    )
    folded = started.selectExpr(*key, "slice", f"{_fold(style, 'state')} as f").selectExpr(*key, "slice", _FOLDED_STATE, "f.out as out")
    folded = pin(folded, "long-order-folds")
    final = sql(
        f"""select {", ".join(_ORDER_KEY)}, max_by(state, struct(life, slice)) as state
            from {{folded}} group by {", ".join(_ORDER_KEY)}""",
        folded=folded,
    )
    return folded.select(*_ORDER_KEY, "out"), final


_RESET = """array(named_struct('symbol', boundary.symbol, 'side', state.side, 'event_type', 'CANCEL',
  'event_seq', state.seq + 1, 'ts', boundary.ts, 'price', state.price, 'size', state.remaining,
  'remaining_size', 0D, 'reason', 'SNAPSHOT_RESET'))"""


def _replay(sessioned: DataFrame, ops: DataFrame, order: list[str], style: str, source: str, drop_filled: bool):
    """(events, open orders) from sessionised rows and the fold operations among them."""
    sizes = pin(sql("select file_id, session_id, count(*) as n_rows from {rows} group by file_id, session_id", rows=sessioned), "session-sizes")
    # the boundary that ends session n opens session n + 1
    ends = sql(
        """
        with opened as (select file_id, session_id - 1 as session_id, struct(ts, symbol) as boundary from {rows} where opens)
        select file_id, session_id, n_rows, boundary from {sizes} join opened using (file_id, session_id)
        """,
        rows=sessioned,
        sizes=sizes,
    )
    extra = [c if c in ops.columns else f"cast(null as double) as {c}" for c in ("new_size", "new_price")]
    narrow = ops.selectExpr(*_ORDER_KEY, *order, "op", "symbol", "side", "price", "size", *extra)

    # a long history is one in a long session
    lengths = sql(
        f"""select {", ".join(f"o.{c}" for c in _ORDER_KEY)}, count(*) as n_rows, true as long
            from {{ops}} o left semi join (select * from {{sizes}} where n_rows > {FOLD_ROWS}) s on o.file_id <=> s.file_id and o.session_id <=> s.session_id
            group by {", ".join(f"o.{c}" for c in _ORDER_KEY)} having count(*) > {FOLD_ROWS}""",
        ops=narrow,
        sizes=sizes,
    )
    lengths = pin(lengths, "long-order-keys")
    any_long = not lengths.isEmpty()
    if any_long:
        marked = attach(narrow, lengths, _ORDER_KEY, ["long"], ", ".join(order))
        long_out, long_final = _fold_long(marked.where("long"), order, style)
        narrow = marked.where("long is null")

    def with_ends(orders: DataFrame) -> DataFrame:
        return attach(orders, ends, ["file_id", "session_id"], ["boundary"], "order_id")

    live = "state.live" + (" and not coalesce(state.remaining <= 0, false)" if drop_filled else "")
    reset, still_open = f"{live} and boundary is not null", f"{live} and boundary is null"
    # events and open orders come from one fold
    closed = pin(with_ends(_fold_short(narrow, order, style)), "folded")
    events = closed.selectExpr(*_ORDER_KEY, f"inline(if({reset}, concat(out, {_RESET}), out))")
    open_orders = closed.where(still_open).select(*_ORDER_KEY, "state")
    if any_long:
        long_closed = with_ends(long_final)
        resets = long_closed.where(reset).selectExpr(*_ORDER_KEY, f"inline({_RESET})")
        events = events.unionByName(long_out.selectExpr(*_ORDER_KEY, "inline(out)")).unionByName(resets)
        open_orders = open_orders.unionByName(long_closed.where(still_open).select(*_ORDER_KEY, "state"))
    events = events.selectExpr(*[c if c != "source" else f"'{source}' as source" for c in EVENT_COLUMNS], "file_id")
    return events, open_orders


def replay_s(rows: DataFrame, source: str = "COINBASE", drop_filled: bool = False):
    """Style-S Stage A rows to (events, orders still open at the end of their file).

    Fully filled orders stay on the book until deleted or reset; ``drop_filled`` spares them the reset."""
    configure(rows.sparkSession)
    sessioned = sessionize_s(effective_rows_s(rows))
    return _replay(sessioned, _operations_s(sessioned), ["ts", "line_no"], "S", source, drop_filled)


def replay_q(rows: DataFrame, source: str = "DATABENTO"):
    """Style-Q Stage A rows to (events, orders still open at the end of their file)."""
    configure(rows.sparkSession)
    sessioned = sessionize_q(effective_rows_q(rows))
    return _replay(sessioned, _operations_q(sessioned), _Q_ORDER, "Q", source, False)


def stage_b_s(rows: DataFrame, source: str = "COINBASE", drop_filled: bool = False) -> DataFrame:
    return replay_s(rows, source, drop_filled)[0]


def stage_b_q(rows: DataFrame, source: str = "DATABENTO") -> DataFrame:
    return replay_q(rows, source)[0]


def event_breakdown(events: DataFrame) -> DataFrame:
    """Counts by event type and by reason, nulls not counted."""
    return sql(
        """
        select field, value, count(*) as n
        from (select stack(2, 'event_type', event_type, 'reason', reason) as (field, value) from {events})
        where value is not null group by field, value
        """,
        events=events,
    )

"""Ordered scans and look-ups that stay balanced when one key holds most rows.

A window over one huge key is one task. Here the rows are range-partitioned on
``keys + order``, so a hot key spreads over many chunks; each chunk is scanned on
its own and picks up what it needs from earlier chunks through a small table of
chunk totals (one row per key and chunk).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame

from orderweave.session import CHUNKS_CONF, configure, pin, sql

CHUNK = "_chunk"

# At most this many groups are broadcast; any other group holds less than 1/HOT_GROUPS of the rows.
HOT_GROUPS = 2000
HOT_ROWS = 10_000
#: Rows, one after another in the order of a scan, whose marks are looked up together.
BLOCK_ROWS = 1024
#: So many marked rows are sent to every task and looked up there; more are counted by a scan in ranges. Every row that is
#: looked up carries the marks of its key along, so their number must be a small constant.
MOST_MARKS = 500


class Chunks:
    """``df`` pinned in key/order ranges. A null key is a key; ``order`` must be unique per key."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], tag: str = "chunks"):
        configure(df.sparkSession)
        self.keys, self.order = list(keys), list(order)
        chunks = df.sparkSession.conf.get(CHUNKS_CONF, None)
        self._columns, self._tag = [*self.keys, *self.order], tag
        self._ranged = df.repartitionByRange(int(chunks), *self._columns) if chunks else df.repartitionByRange(*self._columns)

    @cached_property
    def frame(self) -> DataFrame:
        """The rows with their chunk, whose number is only stable once the ranges are written down."""
        return pin(self._ranged.selectExpr("*", f"spark_partition_id() as {CHUNK}"), self._tag)

    @cached_property
    def single(self) -> bool:
        """Everything fits one chunk: plain windows do."""
        return not self.frame.selectExpr(f"max({CHUNK}) as last").first()["last"]

    def _windows(self) -> str:
        """``in_order`` and ``so_far``: the rows of a key inside one chunk."""
        keys, order = ", ".join(self.keys), ", ".join(self.order)
        return f"""in_order as (partition by {keys}, {CHUNK} order by {order}),
                so_far as (partition by {keys}, {CHUNK} order by {order}
                           rows between unbounded preceding and current row)"""

    def _same(self, a: str, b: str) -> str:
        """Rows of ``a`` and ``b`` have one key, which may be null, and one chunk."""
        return " and ".join([*[f"{a}.{k} <=> {b}.{k}" for k in self.keys], f"{a}.{CHUNK} = {b}.{CHUNK}"])

    def scan(
        self,
        df: DataFrame | None = None,
        sums: dict[str, str] | None = None,
        lasts: dict[str, str] | None = None,
        lags: dict[str, str] | None = None,
        totals: dict[str, str] | None = None,
    ) -> DataFrame:
        """Add running sums, last non-null values (both including the row), previous-row values, and
        sums over the whole key.

        ``df`` defaults to the pinned frame and may be any row-wise extension of it."""
        sums, lasts, lags, wholes = sums or {}, lasts or {}, lags or {}, totals or {}
        df = self.frame if df is None else df
        inputs = {name: f"_in_{name}" for name in [*sums, *lasts, *lags, *wholes]}
        rows = df.selectExpr("*", *[f"{e} as {inputs[n]}" for n, e in {**sums, **lasts, **lags, **wholes}.items()])

        keys, order = ", ".join(self.keys), ", ".join(self.order)
        tails, carries, local, result = [], [], [], []
        for n in wholes:
            tails.append(f"sum({inputs[n]}) as _t_{n}")
            carries.append(f"sum(_t_{n}) over (partition by {keys}) as _c_{n}")
            result.append(f"_c_{n} as {n}")
        for n in sums:
            tails.append(f"sum({inputs[n]}) as _t_{n}")
            carries.append(f"sum(_t_{n}) over before as _c_{n}")
            local.append(f"sum({inputs[n]}) over so_far as _l_{n}")
            result.append(f"coalesce(_l_{n}, 0) + coalesce(_c_{n}, 0) as {n}")
        for n in lasts:
            seen = f"filter (where {inputs[n]} is not null)"
            tails.append(f"max_by({inputs[n]}, struct({order})) {seen} as _t_{n}")
            carries.append(f"last(_t_{n}, true) over before as _c_{n}")
            local.append(f"last({inputs[n]}, true) over so_far as _l_{n}")
            result.append(f"coalesce(_l_{n}, _c_{n}) as {n}")
        for n in lags:
            tails.append(f"max_by({inputs[n]}, struct({order})) as _t_{n}")
            carries.append(f"lag(_t_{n}) over by_chunk as _c_{n}")
            local.append(f"lag({inputs[n]}) over in_order as _l_{n}")
            result.append(f"if(_first, _c_{n}, _l_{n}) as {n}")
        if lags:
            local.append("row_number() over in_order = 1 as _first")
        kept = ", ".join(f"s.`{c}`" for c in df.columns)
        if self.single:
            plain = [f"sum({inputs[n]}) over (partition by {keys}) as {n}" for n in wholes]
            plain += [f"coalesce(sum({inputs[n]}) over so_far, 0) as {n}" for n in sums]
            plain += [f"last({inputs[n]}, true) over so_far as {n}" for n in lasts]
            plain += [f"lag({inputs[n]}) over in_order as {n}" for n in lags]
            return sql(f"select {kept}, {', '.join(plain)} from {{rows}} s window {self._windows()}", rows=rows)
        return sql(
            f"""
            with tails as (
              select {keys}, {CHUNK}, {", ".join(tails)} from {{rows}} group by {keys}, {CHUNK}
            ), carry as (
              select {keys}, {CHUNK}, {", ".join(carries)} from tails
              window by_chunk as (partition by {keys} order by {CHUNK}),
                before as (partition by {keys} order by {CHUNK} rows between unbounded preceding and 1 preceding)
            ), scanned as (
              select {", ".join(["*", *local])} from {{rows}}
              window {self._windows()}
            )
            select {kept}, {", ".join(result)}
            from scanned s left join carry c on {self._same("s", "c")}
            """,
            rows=rows,
        )

    def runs(self, flag: str, opens: str, number: str) -> DataFrame:
        """Mark the first row of every maximal run of ``flag`` rows (``opens``) and number the runs so far
        (``number``).

        The rows are written down in order and numbered, so that a row's number tells what stands next to it: only the flagged
        rows and one row per block of BLOCK_ROWS numbers are sorted again, and a row finds its run among the few of its block."""
        keys = ", ".join(self.keys)
        placed = pin(self._ranged.sortWithinPartitions(*self._columns).selectExpr("*", "monotonically_increasing_id() as _at"), self._tag)
        block = f"_at div {BLOCK_ROWS}"

        def same(a: str, b: str, b_block: str = "_block") -> str:
            return " and ".join([*[f"{a}.{k} <=> {b}.{k}" for k in self.keys], f"{a}.{b_block} = {b}._block"])

        blocks = sql(
            f"""
            with counted as (
              select {keys}, {block} as _block, min(_at) as _first, max(_at) as _last, max(if({flag}, _at, null)) as _mark
              from {{rows}} group by {keys}, {block}
            )
            select {keys}, _block, _first, _mark is not null as _marked,
              coalesce(lag(_mark = _last) over (partition by {keys} order by _block), false) as _follows from counted
            """,
            rows=placed,
        )
        blocks = pin(blocks, "blocks")
        found = sql(
            f"""
            with marks as (select {keys}, {block} as _block, _at from {{rows}} where {flag}),
            stepped as (select *, lag(_at) over (partition by {keys}, _block order by _at) as _before from marks),
            opened as (
              select {", ".join(f"s.{k}" for k in self.keys)}, s._block, array_sort(collect_list(s._at)) as _opened
              from stepped s join {{blocks}} b on {same("s", "b")} and b._marked
              where coalesce(s._before < s._at - 1, s._at > b._first or not b._follows) group by {", ".join(f"s.{k}" for k in self.keys)}, s._block
            )
            select {", ".join(f"b.{k}" for k in self.keys)}, b._block, _opened, coalesce(sum(size(_opened)) over (partition by {", ".join(f"b.{k}" for k in self.keys)}
              order by b._block rows between unbounded preceding and 1 preceding), 0) as _runs
            from {{blocks}} b left join opened o on {same("b", "o")}
            """,
            rows=placed,
            blocks=blocks,
        )
        found = pin(found, "runs")
        kept = ", ".join(f"d.`{c}`" for c in placed.columns if c not in ("_at", "_in"))
        return sql(
            f"""select {kept}, coalesce(array_contains(f._opened, d._at), false) as {opens},
                  cast(f._runs + if(f._opened is null, 0, size(filter(f._opened, x -> x <= d._at))) as int) as {number}
                from (select *, {block} as _in from {{rows}}) d join {{found}} f on {same("d", "f", "_in")}""",
            rows=placed,
            found=found,
        )


def attach(
    df: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    spread_by: str,
    useful: str = "true",
    rows: str = "n_rows",
    pinned: bool = False,
) -> DataFrame:
    """Left join per-group ``values`` back onto the rows of ``df``.

    ``groups`` has one row per key and its row count in ``rows``; ``useful`` tells which groups carry
    information; the rows of all other groups get null. A null key is a key. Useful and large groups are written down first, so Spark knows their size when it
    picks the join. The largest groups (never more than HOT_GROUPS) are broadcast and their rows spread
    by ``spread_by`` over the shuffle that serves all others, so no task receives a whole hot group.
    ``pinned`` tells that ``groups`` is already such a table."""
    if not pinned:
        columns = list(dict.fromkeys([*keys, *values, rows]))
        groups = pin(groups.where(f"({useful}) or {rows} > {HOT_ROWS}").select(*columns), "groups")
    key_list = ", ".join(keys)
    kept = ", ".join(f"r.`{c}`" for c in df.columns)
    on_cool = " and ".join(f"r.{k} <=> c.{k}" for k in keys)
    if groups.where(f"{rows} > {HOT_ROWS}").isEmpty():
        found = ", ".join(f"c.{v}" for v in values)
        return sql(f"select {kept}, {found} from {{df}} r left join {{groups}} c on {on_cool}", df=df, groups=groups)

    on_hot = " and ".join(f"d.{k} <=> h.{k}" for k in keys)
    hot_values = "".join(f", h.{v} as _h_{v}" for v in values)
    picked = ", ".join(f"if(r._spread > 0, r._h_{v}, c.{v}) as {v}" for v in values)
    return sql(
        f"""
        with hot as (
          select {key_list}, {", ".join(values)}, true as _hot from {{groups}}
          where {rows} > {HOT_ROWS} order by {rows} desc, {key_list} limit {HOT_GROUPS}
        ), rows as (
          select /*+ broadcast(h) */ d.*{hot_values},
            if(h._hot, 1 + pmod(xxhash64({spread_by}), 1048576), 0) as _spread
          from {{df}} d left join hot h on {on_hot}
        ), cool as (
          select {key_list}, {", ".join(values)}, 0L as _spread from {{groups}}
        )
        select {kept}, {picked} from rows r left join cool c on {on_cool} and r._spread = c._spread
        """,
        df=df,
        groups=groups,
    )


def _counted(sorted_array: str, position: str) -> str:
    """How many elements of a sorted array are not beyond ``position``: a search by halves."""
    steps = [1 << k for k in range(MOST_MARKS.bit_length() - 1, -1, -1)]
    return f"""aggregate(array({", ".join(map(str, steps))}), 0, (c, p) ->
      if(coalesce(c + p <= size({sorted_array}) and get({sorted_array}, c + p - 1) <= {position}, false), c + p, c))"""


def marks_so_far(df: DataFrame, flag: str, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame | None:
    """Count, for each row, the rows of its key with ``flag`` up to and including itself, or None if MOST_MARKS is exceeded.

    Where marks are rare, their sorted positions go to every task (MOST_MARKS of them at most), and the other rows need not
    be moved or sorted. A null key is a key."""
    key_list = ", ".join(keys)
    position = f"struct({', '.join(order)})"
    marks = pin(df.where(flag).selectExpr(*keys, f"{position} as position"), "marks")
    if marks.count() > MOST_MARKS:
        return None
    lists = sql(f"select {key_list}, array_sort(collect_list(position)) as _marks from {{m}} group by {key_list}", m=marks)
    same = " and ".join(f"d.{k} <=> l.{k}" for k in keys)
    kept = ", ".join(f"d.`{c}`" for c in df.columns)
    return sql(
        f"""select /*+ broadcast(l) */ {kept}, {_counted("l._marks", f"struct({', '.join(f'd.{c}' for c in order)})")} as {name}
            from {{df}} d left join {{lists}} l on {same}""",
        df=df,
        lists=lists,
    )


def run_numbers(df: DataFrame, flag: str, keys: Sequence[str], order: Sequence[str], opens: str, number: str) -> DataFrame | None:
    """``Chunks.runs`` for rare flags, by ``marks_so_far``: a flagged row opens a run if it is the first of its key or a
    row without the flag stands between it and the flagged row before. None if MOST_MARKS is exceeded."""
    placed = marks_so_far(df, flag, keys, order, "_mark")
    if placed is None:
        return None
    key_list = ", ".join(keys)
    firsts = sql(
        f"""
        with seen as (
          select {key_list}, _mark, max(coalesce({flag}, false)) as marked, max(not coalesce({flag}, false)) as other
          from {{placed}} group by {key_list}, _mark
        ), totals as (select *, max(if(marked, _mark, 0)) over (partition by {key_list}) as n from seen)
        select {key_list}, array_sort(array_distinct(concat(array(1), collect_list(if(other and _mark < n, _mark + 1, null))))) as _firsts
        from totals where n > 0 group by {key_list}
        """,
        placed=placed,
    )
    firsts = pin(firsts, "runs")  # no more entries than marks
    same = " and ".join(f"d.{k} <=> f.{k}" for k in keys)
    kept = ", ".join(f"d.`{c}`" for c in df.columns)
    return sql(
        f"""select /*+ broadcast(f) */ {kept}, coalesce({flag}, false) and coalesce(array_contains(f._firsts, d._mark), false) as {opens},
              {_counted("f._firsts", "d._mark")} as {number}
            from {{placed}} d left join {{firsts}} f on {same}""",
        placed=placed,
        firsts=firsts,
    )

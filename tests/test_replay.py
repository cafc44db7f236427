"""Replay: written scenarios, and random feeds against a row-by-row replay under forced skew handling."""

import random

import pytest
from pyspark.sql import functions as F

from orderweave.operators import replay, scan
from orderweave.session import CHUNKS_CONF
from tests import replay_by_hand as by_hand

T0 = 1_711_152_000_000_000_000
MS = 1_000_000
S_SCHEMA = (
    "file_id string, line_no bigint, ts bigint, symbol string, order_id string, side string, price double,"
    " size double, raw_type string, new_size double, new_price double"
)
Q_SCHEMA = (
    "file_id string, line_no bigint, ts bigint, symbol string, order_id string, side string, price double,"
    " size double, raw_type string, sequence double"
)
OUT = [c for c in replay.EVENT_COLUMNS if c != "source"]


def s_row(i, kind, size=1.0, ts=None, price=100.0, oid="100", new_size=None, new_price=None, side="BID", file="f"):
    return (file, i, T0 + (i if ts is None else ts) * MS, "BTC-USDT", oid, side, price, size, kind, new_size, new_price)


def q_row(i, kind, size=100.0, ts=None, price=150.0, oid="1", sequence=1.0, side="BID", file="f"):
    return (file, i, T0 + (i if ts is None else ts) * MS, "AAPL", oid, side, price, size, kind, sequence)


def run(spark, rows, style="S"):
    schema, fn = (S_SCHEMA, replay.stage_b_s) if style == "S" else (Q_SCHEMA, replay.stage_b_q)
    events = fn(spark.createDataFrame(rows, schema))
    return [
        (r.event_type, r.reason, r.size, r.remaining_size, r.event_seq, r.session_id)
        for r in events.orderBy("order_id", "session_id", "ts", "event_seq").collect()
    ]


S_CASES = {
    "partial fill": (
        [s_row(0, "ADD", 5.0), s_row(1, "SUB", 2.0)],
        [("ADD", None, 5, 5, 0, 0), ("FILL", "PARTIAL_FILL", 2, 3, 1, 0)],
    ),
    "full trade": (
        [s_row(0, "ADD", 5.0), s_row(1, "MATCH", 5.0)],
        [("ADD", None, 5, 5, 0, 0), ("FILL", "FULL_FILL_TRADE", 5, 0, 1, 0)],
    ),
    "set both": (
        [s_row(0, "ADD", 5.0), s_row(1, "SET", None, new_size=4.0, new_price=102.0)],
        [("ADD", None, 5, 5, 0, 0), ("MODIFY", "SIZE_CHANGE", 4, 4, 1, 0), ("MODIFY", "PRICE_CHANGE", 4, 4, 2, 0)],
    ),
    "partial delete": (
        [s_row(0, "ADD", 5.0), s_row(1, "DELETE", 2.0)],
        [("ADD", None, 5, 5, 0, 0), ("MODIFY", "PARTIAL_DELETE", 2, 3, 1, 0)],
    ),
    "full delete forgets": (
        [s_row(0, "ADD", 5.0), s_row(1, "DELETE", 5.0), s_row(2, "SUB", 1.0)],
        [("ADD", None, 5, 5, 0, 0), ("CANCEL", "CANCELLED", 5, 0, 1, 0)],
    ),
    "zero delete ignored": (
        [s_row(0, "ADD", 5.0), s_row(1, "DELETE", 0.0)],
        [("ADD", None, 5, 5, 0, 0)],
    ),
    "missing delete size cancels": (
        [s_row(0, "ADD", 5.0), s_row(1, "DELETE", None)],
        [("ADD", None, 5, 5, 0, 0), ("CANCEL", "CANCELLED", None, 0, 1, 0)],
    ),
    "missing fill size stays partial": (
        [s_row(0, "ADD", 5.0), s_row(1, "SUB", None)],
        [("ADD", None, 5, 5, 0, 0), ("FILL", "PARTIAL_FILL", None, None, 1, 0)],
    ),
    "no-op pair": (
        [s_row(0, "ADD", 5.0), s_row(1, "DELETE", 0.0, ts=1), s_row(2, "ADD", 5.0, ts=1), s_row(3, "SUB", 1.0)],
        [("ADD", None, 5, 5, 0, 0), ("FILL", "PARTIAL_FILL", 1, 4, 1, 0)],
    ),
    "reprice pair": (
        [s_row(0, "ADD", 5.0), s_row(1, "SUB", 5.0, ts=1), s_row(2, "ADD", 5.0, ts=1, price=105.0)],
        [("ADD", None, 5, 5, 0, 0), ("MODIFY", "PRICE_CHANGE", 5, 5, 1, 0)],
    ),
    "unequal sizes are a fill": (
        [s_row(0, "ADD", 5.0), s_row(1, "SUB", 3.0, ts=1), s_row(2, "SUB", 1.0, ts=2)],
        [("ADD", None, 5, 5, 0, 0), ("FILL", "PARTIAL_FILL", 3, 2, 1, 0), ("FILL", "PARTIAL_FILL", 1, 1, 2, 0)],
    ),
    "untracked": ([s_row(0, "SUB", 1.0), s_row(1, "SET", None, new_size=1.0), s_row(2, "DELETE", 1.0)], []),
    "snapshot resets": (
        [s_row(0, "ADD", 5.0, oid="1"), s_row(1, "ADD", 6.0, oid="2"), s_row(2, "SNAPSHOT", 7.0, oid="3")],
        [
            ("ADD", None, 5, 5, 0, 0), ("CANCEL", "SNAPSHOT_RESET", 5, 0, 1, 0),
            ("ADD", None, 6, 6, 0, 0), ("CANCEL", "SNAPSHOT_RESET", 6, 0, 1, 0),
            ("ADD", None, 7, 7, 0, 1),
        ],
    ),
    "one snapshot run is one session": (
        [s_row(0, "SNAPSHOT", 1.0, oid="1"), s_row(1, "PING", 1.0, oid="9"), s_row(2, "SNAPSHOT", 2.0, oid="2")],
        [("ADD", None, 1, 1, 0, 1), ("ADD", None, 2, 2, 0, 1)],
    ),
}

Q_CASES = {
    "partial cancel": (
        [q_row(0, "A"), q_row(1, "C", 40.0, sequence=2.0)],
        [("ADD", None, 100, 100, 0, 0), ("MODIFY", "PARTIAL_DELETE", 40, 60, 1, 0)],
    ),
    "full cancel": (
        [q_row(0, "A"), q_row(1, "C", 100.0, sequence=2.0)],
        [("ADD", None, 100, 100, 0, 0), ("CANCEL", "CANCELLED", 100, 0, 1, 0)],
    ),
    "fill": (
        [q_row(0, "A"), q_row(1, "F", 100.0, sequence=2.0), q_row(2, "C", 100.0, sequence=2.0)],
        [("ADD", None, 100, 100, 0, 0), ("FILL", "FULL_FILL", 100, 0, 1, 0)],
    ),
    "trade fill": (
        [q_row(0, "A"), q_row(1, "T", 30.0, oid="0", sequence=2.0), q_row(2, "F", 30.0, sequence=2.0),
         q_row(3, "C", 30.0, sequence=2.0)],
        [("ADD", None, 100, 100, 0, 0), ("FILL", "PARTIAL_FILL_TRADE", 30, 70, 1, 0)],
    ),
    "unknown modify adds": ([q_row(0, "M", 5.0)], [("ADD", None, 5, 5, 0, 0)]),
    "modify only what changed": (
        [q_row(0, "A"), q_row(1, "M", 100.0, sequence=2.0), q_row(2, "M", 100.0, price=151.0, sequence=3.0)],
        [("ADD", None, 100, 100, 0, 0), ("MODIFY", "PRICE_CHANGE", 100, 100, 1, 0)],
    ),
    "clear without sequence": (
        [q_row(0, "A", sequence=None), q_row(1, "R", sequence=None)],
        [("ADD", None, 100, 100, 0, 0), ("CANCEL", "SNAPSHOT_RESET", 100, 0, 1, 0)],
    ),
}


@pytest.mark.parametrize("case", S_CASES)
def test_style_s(spark, case):
    rows, expected = S_CASES[case]
    assert run(spark, rows) == expected


@pytest.mark.parametrize("case", Q_CASES)
def test_style_q(spark, case):
    rows, expected = Q_CASES[case]
    assert run(spark, rows, "Q") == expected


def test_near_equal_sizes_are_a_reprice(spark):
    rows = [s_row(0, "ADD", 0.3), s_row(1, "SUB", 0.1 + 0.2, ts=1), s_row(2, "ADD", 0.3, ts=1, price=101.0)]
    assert [r[1] for r in run(spark, rows)] == [None, "PRICE_CHANGE"]
    apart = [s_row(0, "ADD", 0.3), s_row(1, "SUB", 0.3 + 5e-9, ts=1), s_row(2, "ADD", 0.3, ts=1)]
    assert [r[0] for r in run(spark, apart)] == ["ADD", "ADD", "FILL"]


def random_rows(style, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of all rows belong to one order of one file
        hot = rng.random() < 0.34
        file, oid = ("a", "1") if hot else (rng.choice("abc"), str(rng.randrange(1, 9)))
        ts = rng.randrange(0, n // 4)
        size = rng.choice([None, 0.0, 0.1, 0.2, 0.3, 0.7, 1.1])
        price = rng.choice([100.0, 100.5, 101.25])
        side = rng.choice(["BID", "ASK"])
        if style == "S":
            kind = rng.choices(["ADD", "SUB", "MATCH", "SET", "DELETE", "SNAPSHOT", "PING"], [3, 4, 4, 3, 3, 0.1, 0.3])[0]
            new_size, new_price = rng.choice([None, 0.5, 2.0]), rng.choice([None, 99.5])
            rows.append(s_row(i, kind, size, ts, price, oid, new_size, new_price, side, file))
        else:
            kind = rng.choices("AMCFTRN", [2, 3, 5, 1, 1, 0.05, 0.3])[0]
            sequence = rng.choice([None, float(ts // 2)])
            rows.append(q_row(i, kind, size, ts, price, oid, sequence, side, file))
    return rows


@pytest.mark.parametrize("style,seed", [("S", 1), ("S", 2), ("Q", 3), ("Q", 4)])
def test_random_feed(spark, monkeypatch, style, seed):
    """Small limits force long-history slices, hot groups and several chunks."""
    monkeypatch.setattr(replay, "FOLD_ROWS", 7)
    monkeypatch.setattr(scan, "HOT_ROWS", 3)
    spark.conf.set(CHUNKS_CONF, "5")
    try:
        rows = random_rows(style, 1500, seed)
        schema, fn = (S_SCHEMA, replay.replay_s) if style == "S" else (Q_SCHEMA, replay.replay_q)
        df = spark.createDataFrame(rows, schema).repartition(6)
        events, open_orders = fn(df)
        got = sorted((tuple(r) for r in events.select("file_id", *OUT).collect()), key=repr)
        names = [c.split()[0] for c in schema.split(", ")]
        want, live = [], 0
        for file in "abc":
            hand = by_hand.run_s if style == "S" else by_hand.run_q
            out, n = hand([dict(zip(names, r)) for r in rows if r[0] == file])
            want += [(file, *e) for e in out]
            live += n
        assert got == sorted(want, key=repr)
        assert open_orders.count() == live
    finally:
        spark.conf.unset(CHUNKS_CONF)


def test_input_order_does_not_matter(spark):
    rows = random_rows("S", 300, 7)
    df = spark.createDataFrame(rows, S_SCHEMA)
    one = sorted(map(tuple, replay.stage_b_s(df.coalesce(1)).collect()), key=repr)
    many = sorted(map(tuple, replay.stage_b_s(df.repartition(9, "price")).collect()), key=repr)
    assert one == many


def test_drop_filled_spares_the_reset(spark):
    rows = [s_row(0, "ADD", 5.0), s_row(1, "SUB", 5.0), s_row(2, "SNAPSHOT", 1.0, oid="2")]
    df = spark.createDataFrame(rows, S_SCHEMA)
    assert replay.stage_b_s(df).where("reason = 'SNAPSHOT_RESET'").count() == 1
    assert replay.stage_b_s(df, drop_filled=True).where("reason = 'SNAPSHOT_RESET'").count() == 0


@pytest.mark.parametrize("fold_rows,hot_rows", [(5000, 10_000), (7, 3)])
def test_an_order_without_id_is_an_order(spark, monkeypatch, fold_rows, hot_rows):
    """Null keys give the same events as any other id, in one piece or in slices."""
    monkeypatch.setattr(replay, "FOLD_ROWS", fold_rows)
    monkeypatch.setattr(scan, "HOT_ROWS", hot_rows)
    spark.conf.set(CHUNKS_CONF, "4")
    try:
        df = spark.createDataFrame(random_rows("S", 400, 9), S_SCHEMA).withColumn("order_id", F.lit("x"))
        named = replay.stage_b_s(df)
        none = replay.stage_b_s(df.withColumn("order_id", F.lit(None).cast("string")))
        columns = [c for c in named.columns if c != "order_id"]
        assert sorted(map(repr, none.select(*columns).collect())) == sorted(map(repr, named.select(*columns).collect()))
    finally:
        spark.conf.unset(CHUNKS_CONF)


def test_running_numbers_of_a_null_key(spark):
    spark.conf.set(CHUNKS_CONF, "8")
    try:
        df = spark.range(5000).selectExpr("cast(null as string) as k", "id")
        rows = scan.Chunks(df, ["k"], ["id"]).scan(sums={"n": "1L"}, totals={"total": "1L"}, lags={"was": "id"})
        assert rows.where("n <> id + 1 or total <> 5000 or not (was <=> if(id = 0, null, id - 1))").count() == 0
        marked = scan.Chunks(df, ["k"], ["id"]).runs("id % 10 < 3", "opens", "number")
        assert marked.count() == 5000 and marked.where("number is null").count() == 0
    finally:
        spark.conf.unset(CHUNKS_CONF)


def long_life(style, n, seed, sizes, absolute):
    """One order with a third of all rows, added once; ``absolute`` is how often a row sets its size anew."""
    rng = random.Random(seed)
    first = "ADD" if style == "S" else "A"
    row = s_row if style == "S" else q_row
    rows = [row(0, first, 40.0, oid="hot", file="a")]
    for i in range(1, n):
        if rng.random() < 0.34:
            size, price = rng.choice(sizes), rng.choice([100.0, 100.5, None])
            change = rng.random() < absolute
            if style == "S":
                # a repricing ADD and its SUB keep the life going
                if change and rng.random() < 0.3:
                    rows += [row(i, "SUB", 7.0, ts=i, oid="hot", file="a"), row(i + 0.5, "ADD", 7.0, ts=i, price=99.0, oid="hot", file="a")]
                    continue
                kind = "SET" if change or rng.random() < 0.1 else rng.choices(["SUB", "MATCH", "DELETE"], [3, 3, 0.2])[0]
                rows.append(row(i, kind, size, price=price or 1.0, oid="hot", new_size=rng.choice([8.0, 3.0]) if change else None, new_price=price, file="a"))
            else:
                kind = "M" if change else rng.choices("CFT", [6, 0.1, 0.1])[0]
                rows.append(row(i, kind, rng.choice([8.0, 3.0]) if change else size, price=price, oid="hot", sequence=float(i // 3), side=rng.choice(["BID", "ASK"]), file="a"))
        else:
            rows.append(row(i, rng.choice(["ADD", "SUB"] if style == "S" else "AC"), 1.0, oid=str(rng.randrange(200)), file=rng.choice("ab")))
    return [(r[0], int(2 * r[1]), *r[2:]) for r in rows]


@pytest.mark.parametrize("style", ["S", "Q"])
@pytest.mark.parametrize("sizes,absolute", [((0.0, 0.25, 0.5), 0.0), ((0.1, 0.3, None), 0.05), ((0.25, -0.5, 0.0), 0.02)])
def test_a_life_of_many_slices(spark, monkeypatch, style, sizes, absolute):
    """A third of the rows on one order without a fresh ADD: the chain of effects gives what a row-by-row replay gives."""
    monkeypatch.setattr(replay, "FOLD_ROWS", 5)
    monkeypatch.setattr(replay, "RUN_ROWS", 3)
    spark.conf.set(CHUNKS_CONF, "3")
    try:
        rows = long_life(style, 400, 3, sizes, absolute)
        schema, fn = (S_SCHEMA, replay.replay_s) if style == "S" else (Q_SCHEMA, replay.replay_q)
        events, open_orders = fn(spark.createDataFrame(rows, schema).repartition(4))
        got = sorted((tuple(r) for r in events.select("file_id", *OUT).collect()), key=repr)
        names = [c.split()[0] for c in schema.split(", ")]
        want, live = [], 0
        for file in "ab":
            out, n = (by_hand.run_s if style == "S" else by_hand.run_q)([dict(zip(names, r)) for r in rows if r[0] == file])
            want += [(file, *e) for e in out]
            live += n
        assert got == sorted(want, key=repr)
        assert open_orders.count() == live
    finally:
        spark.conf.unset(CHUNKS_CONF)


def test_the_number_of_jobs_does_not_follow_the_longest_history(spark, monkeypatch):
    monkeypatch.setattr(replay, "FOLD_ROWS", 50)

    def jobs(n):
        rows = spark.range(n).selectExpr(
            "'f' as file_id", "id as line_no", f"{T0} + id as ts", "'X' as symbol", "'1' as order_id", "'BID' as side", "100D as price",
            "if(id = 0, 1e6D, 1D) as size", "if(id = 0, 'ADD', 'SUB') as raw_type", "cast(null as double) as new_size", "cast(null as double) as new_price",
        )
        group = f"jobs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert replay.stage_b_s(rows).agg({"remaining_size": "min"}).first()[0] == 1e6 - (n - 1)
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setJobGroup("", "")

    assert jobs(4000) <= jobs(400) + 12


def test_sessions_of_many_marks_carry_no_lists_of_marks(spark):
    rows = [("f", i, "SNAPSHOT" if i % 4 == 0 else "ADD") for i in range(4000)]
    df = spark.createDataFrame(rows, "file_id string, line_no long, raw_type string").selectExpr("*", "line_no div 7 as ts")
    assert scan.run_numbers(df, "raw_type = 'SNAPSHOT'", ["file_id"], ["ts", "line_no"], "opens", "session_id") is None
    assert {(r.line_no, r.session_id, r.opens) for r in replay.sessionize_s(df).collect()} == {(i, i // 4 + 1, i % 4 == 0) for i in range(4000)}


def test_sessions_and_folds_are_worked_out_once(spark):
    rows = [("f", i, i, "S", f"o{i % 9}", "BID", 10.0, 2.0, "SNAPSHOT" if i % 50 == 0 else "ADD", None, None) for i in range(1, 200)]
    df = spark.createDataFrame(
        rows, "file_id string, line_no long, ts long, symbol string, order_id string, side string, price double, size double, raw_type string, new_size double, new_price double"
    )
    events, still_open = replay.replay_s(df)
    for part in (events, still_open, replay.sessionize_s(replay.effective_rows_s(df))):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan
    assert events.count() and still_open.count()


def test_runs_are_numbered_without_sorting_the_rows_again(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_ROWS", 8, raising=False)
    rng = random.Random(5)
    rows = [(k, i, rng.random() < share, None) for k, share in ((None, 0.5), (1, 0.95), (2, 0.02), (3, 1.0), (4, 0.0)) for i in range(150)]
    rows += [(1, 1000 + i, None if i % 3 else True, None) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, at int, f boolean, x string")
    spark.conf.set(CHUNKS_CONF, "5")
    try:
        got = scan.Chunks(df, ["k"], ["at"]).runs("f", "opens", "number")
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {(r.k, r.at): (r.opens, r.number) for r in got.collect()}
    finally:
        spark.conf.unset(CHUNKS_CONF)
    assert "Window" not in plan and "Sort [" not in plan
    want, last = {}, {}
    for k, at, f, _ in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        before, n = last.get(k, (False, 0))
        opens = bool(f) and not before
        last[k] = (bool(f), n + opens)
        want[k, at] = (opens, n + opens)
    assert found == want

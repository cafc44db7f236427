"""Feed files, Stage A, the event store, the directory pipeline and the stream."""

import datetime
import time

import pytest

from orderweave.plans.pipeline import run_files
from orderweave.sources import feeds, store
from orderweave.streaming.ingest import ingest

HEAD_S = "time_exchange;time_coinapi;order_id;is_buy;entry_px;entry_sx;update_type;new_size;new_price"
DAY = 86_400_000_000_000


def ns(text):
    seconds, _, fraction = text.partition(".")
    moment = datetime.datetime.fromisoformat(seconds).replace(tzinfo=datetime.timezone.utc)
    return int(moment.timestamp()) * 10**9 + int(fraction.ljust(9, "0") or 0)


def write_s(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join([HEAD_S, *lines]) + "\n")
    return str(path)


def test_style_s_file(spark, tmp_path):
    path = write_s(
        tmp_path, "20240116_BTC-USDT.csv",
        "23:59:59.1234567;00:00:01.000000;1;1;100.5;2;ADD;;",
        "09:30:00.000000;09:30:00.100000;2;0;oops;3;SET;1.5;",
        "09:30:00.000000;09:30:00.100000;3;7;99;;MATCH;;98.5",
    )
    rows = {r.order_id: r for r in feeds.read_feed(spark, path, feeds.STYLE_S).collect()}
    assert rows["1"].ts == ns("2024-01-15T23:59:59.1234567")
    assert rows["2"].ts == ns("2024-01-16T09:30:00")
    assert {r.symbol for r in rows.values()} == {"BTC-USDT"}
    assert [rows[k].side for k in "123"] == ["BID", "ASK", None]
    assert [rows[k].price for k in "123"] == [100.5, None, 99.0]
    assert [rows[k].size for k in "123"] == [2.0, 3.0, None]
    assert (rows["2"].new_size, rows["3"].new_price) == (1.5, 98.5)


def test_line_order_in_split_files(spark, tmp_path):
    lines = [f"09:30:00.000000;09:30:00.000000;{i};1;1;1;ADD;;" for i in range(4000)]
    path = write_s(tmp_path, "20240116_X.csv", *lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = feeds.scan_csv(spark, path, feeds.STYLE_S)
        assert rows.rdd.getNumPartitions() > 3
        assert [int(r.order_id) for r in rows.orderBy("line_no").collect()] == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_iso_times(spark):
    texts = {
        "2024-01-15 09:30:00.123456789": ns("2024-01-15T09:30:00.123456789"),
        "2024-01-15T09:30:00Z": ns("2024-01-15T09:30:00"),
        "2024-01-15T09:30:00.5+02:00": ns("2024-01-15T07:30:00.5"),
        "2024-01-15T09:30:00-0530": ns("2024-01-15T15:00:00"),
        "2024-02-30 09:30:00": None,
        "yesterday": None,
    }
    raw = spark.createDataFrame([(t, "ADD") for t in texts], "time_exchange string, update_type string")
    rows = feeds.stage_a(raw.selectExpr("*", "time_exchange as file_id"), feeds.STYLE_S, "X").collect()
    got = {r.file_id: r.ts for r in rows}
    assert got == texts


def test_style_q_rows(spark):
    raw = spark.createDataFrame(
        [("1711152000000000007", 1, "B", 150000000000, 100, "A", 1, 0, "AAPL"),
         ("x", 2, "N", None, None, "R", None, 0, "AAPL")],
        "ts_event string, order_id int, side string, price bigint, size int, action string, sequence int,"
        " flags int, symbol string",
    )
    first, second = feeds.stage_a(raw, feeds.STYLE_Q).orderBy("order_id").collect()
    assert (first.ts, first.order_id, first.side, first.price) == (1711152000000000007, "1", "BID", 150.0)
    assert (second.ts, second.side, second.price, second.sequence) == (None, None, None, None)
    assert feeds.stage_a(raw, feeds.STYLE_Q, "O'X").first().symbol == "O'X"


def test_missing_columns_and_sources(spark):
    raw = spark.createDataFrame([("1",)], "ts_event string")
    with pytest.raises(KeyError, match="action"):
        feeds.stage_a(raw, feeds.STYLE_Q)
    with pytest.raises(KeyError, match="symbol"):
        feeds.stage_a(raw.selectExpr("*", "'A' as action"), feeds.STYLE_Q)
    with pytest.raises(ValueError, match="unknown source"):
        feeds.style_of("nasdaq")


EVENT = (
    "order_id string, session_id int, symbol string, source string, side string, event_type string, event_seq int,"
    " ts bigint, price double, size double, remaining_size double, reason string"
)
T0 = ns("2024-03-23T00:00:00")


def events(spark, n, size=1.0, day=0, first=0, symbol="20260101"):
    return spark.createDataFrame(
        [
            (str(i), 0, symbol, "COINBASE", "BID", "ADD", 0, T0 + day * DAY + i * 10**6, 100.0, size, size, None)
            for i in range(first, first + n)
        ],
        EVENT,
    )


def test_store_modes(spark, tmp_path):
    root = str(tmp_path / "events")
    assert store.write_events(events(spark, 0), root) is None
    store.write_events(events(spark, 5).union(events(spark, 3, day=1)), root)
    assert [(r.symbol, r.date, r.rows) for r in store.list_available(spark, root).collect()] == [
        ("20260101", "2024-03-23", 5), ("20260101", "2024-03-24", 3),
    ]
    with pytest.raises(FileExistsError):
        store.write_events(events(spark, 1, day=1).union(events(spark, 1, day=9)), root, "error")
    assert store.list_available(spark, root).count() == 2

    store.write_events(events(spark, 4, size=9.0, first=3), root, "merge")
    day = store.load_events(spark, root, "coinbase", "20260101", "2024-03-23").collect()
    assert [(r.order_id, r.size) for r in day] == [("0", 1), ("1", 1), ("2", 1), ("3", 9), ("4", 9), ("5", 9), ("6", 9)]

    store.write_events(events(spark, 2, size=7.0), root, "overwrite")
    both = store.load_events(spark, root, "coinbase", "20260101", ("2024-03-23", "2024-03-24")).collect()
    assert [r.size for r in both] == [7.0, 7.0, 1.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        store.write_events(events(spark, 1), root, "append")


def test_load_errors(spark, tmp_path):
    root = str(tmp_path / "events")
    with pytest.raises(FileNotFoundError):
        store.load_events(spark, root, "coinbase", "X", "2024-03-23")
    assert store.list_available(spark, root).count() == 0
    store.write_events(events(spark, 2), root)
    with pytest.raises(FileNotFoundError, match="2024-03-25"):
        store.load_events(spark, root, "coinbase", "20260101", ["2024-03-23", "2024-03-25"])
    assert store.resolve_dates(["2024-01-02", "2024-01-01", "2024-01-02"]) == ["2024-01-01", "2024-01-02"]
    assert store.resolve_dates(("2024-02-28", "2024-03-01")) == ["2024-02-28", "2024-02-29", "2024-03-01"]
    with pytest.raises(TypeError):
        store.resolve_dates(7)
    assert store.list_available(spark, root, "CoinBase", "20260101").count() == 1
    assert store.list_available(spark, root, "databento").count() == 0


def pipeline_files(folder):
    write_s(
        folder, "20240115_X.csv",
        "10:00:00.000000;10:00:00.000000;1;1;100;5;ADD;;",
        "10:00:01.000000;10:00:01.000000;1;1;100;2;MATCH;;",
    )
    write_s(
        folder, "20240116_X.csv",
        "23:59:00.000000;00:00:00.500000;1;1;101;7;ADD;;",
        "11:00:00.000000;11:00:00.000000;2;0;102;4;ADD;;",
    )
    write_s(folder, "20240117_X.csv", "soon;11:00:00.000000;3;0;102;4;ADD;;")
    write_s(folder, "stray.csv", "10:00:00.000000;10:00:00.000000;1;1;100;5;ADD;;")


EXPECTED = [
    # the late row of the second file replaces (order 1, session 0, seq 0) of the first
    ("1", "2024-01-15", "ADD", 7.0), ("1", "2024-01-15", "FILL", 2.0), ("2", "2024-01-16", "ADD", 4.0),
]


def stored(spark, root):
    rows = spark.read.parquet(root).collect()
    return sorted((r.order_id, r.date, r.event_type, r.size) for r in rows)


def test_directory_pipeline(spark, tmp_path):
    folder, root = tmp_path / "raw", str(tmp_path / "events")
    folder.mkdir()
    pipeline_files(folder)
    result = run_files(spark, str(folder), "coinbase", root)
    status = {r.file_id: r.succeeded for r in result.files.collect()}
    assert status == {
        "20240115_X.csv": True, "20240116_X.csv": True, "20240117_X.csv": False, "stray.csv": False,
    }
    assert stored(spark, root) == EXPECTED
    assert result.report.where("not passed").count() == 0
    # a second run changes nothing
    run_files(spark, str(folder), "coinbase", root)
    assert stored(spark, root) == EXPECTED


def test_stream_of_files(spark, tmp_path):
    folder, root = tmp_path / "raw", str(tmp_path / "events")
    folder.mkdir()
    pipeline_files(folder)
    for _ in range(2):
        ingest(spark, str(folder), "coinbase", root, str(tmp_path / "offsets")).awaitTermination()
    assert stored(spark, root) == EXPECTED
    write_s(folder, "20240118_X.csv", "10:00:00.000000;10:00:00.000000;9;1;100;5;ADD;;")
    ingest(spark, str(folder), "coinbase", root, str(tmp_path / "offsets")).awaitTermination()
    assert stored(spark, root) == [*EXPECTED, ("9", "2024-01-18", "ADD", 5.0)]


# ------------------------------------------------------------------ headers ----

LINES = [
    dict(time_exchange="23:59:59.1234567", time_coinapi="00:00:01.000000", order_id="1", is_buy="1", entry_px="100.5", entry_sx="2", update_type="ADD"),
    dict(time_exchange="09:30:00.000000", time_coinapi="09:30:00.100000", order_id="2", is_buy="0", entry_px="99", entry_sx="3", update_type="SET", new_size="1.5", new_price="98.5"),
]


def write_columns(folder, name, columns, lines=LINES):
    folder.mkdir(exist_ok=True)
    rows = [";".join(line.get(c, "") for c in columns) for line in lines]
    (folder / name).write_text("\n".join([";".join(columns), *rows]) + "\n")


def test_columns_are_found_by_name(spark, tmp_path):
    named = HEAD_S.split(";")
    orders = {
        "a": named,
        "b": named[::-1],
        "c": ["venue", *named[3:], *named[:3]],
        "d": [c for c in named if c != "new_price"],
        "e": ['"update_type"', *[c for c in named if c != "update_type"]],
    }
    lines = [dict(line, **{'"update_type"': line["update_type"]}) for line in LINES]
    for name, columns in orders.items():
        write_columns(tmp_path / name, "20240116_X.csv", columns, lines)
    columns = ["ts", "symbol", "order_id", "side", "price", "size", "raw_type", "new_size", "new_price"]
    got = {n: feeds.read_feed(spark, str(tmp_path / n), feeds.STYLE_S).orderBy("line_no").select(*columns).collect() for n in orders}
    assert got["a"] == got["b"] == got["c"] == got["e"]
    assert [r.asDict() | {"new_price": None} for r in got["a"]] == [r.asDict() for r in got["d"]]
    assert got["a"][1].new_price == 98.5 and got["a"][0].ts == ns("2024-01-15T23:59:59.1234567")
    # all at once: rows of every layout, absent columns null
    whole = feeds.scan_csv(spark, str(tmp_path), feeds.STYLE_S)
    assert whole.columns == [*named, "file_id", "line_no"] and whole.count() == 10
    assert whole.where("new_price is null and order_id = '2'").count() == 1


def test_names_in_a_header():
    assert feeds._names("﻿a; b;a;a;", ";") == ("a", "b", "a.1", "a.2", "")
    assert feeds._names('"x;y";z', ";") == ("x;y", "z")


def test_files_that_cannot_be_read_say_why(spark, tmp_path):
    folder, root = tmp_path / "raw", str(tmp_path / "events")
    folder.mkdir()
    pipeline_files(folder)
    write_columns(folder, "20240118_X.csv", ["time_exchange", "order_id", "entry_sx"])
    write_columns(folder, "20240119_X.csv", HEAD_S.split(";"), [])
    (folder / "20240120_X.csv").write_text("")
    write_columns(folder, "20240121_[X]{1}.csv", HEAD_S.split(";")[::-1])
    result = run_files(spark, str(folder), "coinbase", root)
    assert {r.file_id: (r.n_rows, r.n_bad, r.reason, r.succeeded) for r in result.files.collect()} == {
        "20240115_X.csv": (2, 0, None, True),
        "20240116_X.csv": (2, 0, None, True),
        "20240117_X.csv": (1, 1, "unreadable time '2024-01-17 soon'", False),
        "stray.csv": (1, 1, "file name is not DATE_SYMBOL.csv", False),
        "20240118_X.csv": (0, 0, "missing column(s): update_type; available: time_exchange, order_id, entry_sx", False),
        "20240119_X.csv": (0, 0, None, True),
        "20240120_X.csv": (0, 0, "empty file", False),
        "20240121_%5BX%5D%7B1%7D.csv": (2, 0, None, True),
    }
    assert [r for r in stored(spark, root) if r[1] < "2024-01-18"] == EXPECTED
    only = str(folder / "20240118_X.csv")
    with pytest.raises(KeyError, match="update_type"):
        feeds.read_feed(spark, only, feeds.STYLE_S)
    assert feeds.scan_csv(spark, only, feeds.STYLE_S).count() == 0
    assert run_files(spark, only, "coinbase", root).touched is None


def test_too_many_headers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "MOST_LAYOUTS", 2)
    for i in range(3):
        write_columns(tmp_path / "raw", f"2024011{i}_X.csv", [*HEAD_S.split(";"), f"extra{i}"])
    with pytest.raises(ValueError, match="more than 2"):
        feeds.Feed(spark, str(tmp_path / "raw"), feeds.STYLE_S)


def test_a_source_from_configuration(spark, tmp_path):
    config = {
        "csv_divider": "|",
        "column_map": {"ts": "at", "order_id": "id", "side": "way", "price": "px"},
        "size_col_priority": ["rest", "qty"],
        "event_type_col": "kind",
        "aux_cols": ["new_size", "new_price"],
        "side_map": {1: "BID", 2: "ASK", 3: None},
        "price_scale": 0.01,
        "filename_parsing": {"date_injection": True, "date_format": "%d-%m-%Y", "filename_sep": "~"},
    }
    style = feeds.register_style(feeds.style_from_config("thirdparty", config))
    try:
        assert feeds.style_of("ThirdParty") is style
        (tmp_path / "15-01-2024~ABC.csv").write_text("px|kind|id|way|qty|at\n10050|ADD|7|1|3|10:00:00.5\n10050|MATCH|7|3|3|10:00:01.5\n")
        root = str(tmp_path / "events")
        result = run_files(spark, str(tmp_path / "15-01-2024~ABC.csv"), "thirdparty", root)
        assert result.files.first().succeeded
        got = store.load_events(spark, root, "thirdparty", "ABC", "2024-01-15").collect()
        assert [(r.event_type, r.price, r.size, r.side, r.ts) for r in got] == [
            ("ADD", 100.5, 3.0, "BID", ns("2024-01-15T10:00:00.5")),
            ("FILL", 100.5, 3.0, None, ns("2024-01-15T10:00:01.5")),
        ]
    finally:
        del feeds.STYLES["thirdparty"]
    with pytest.raises(ValueError, match="date_format"):
        feeds.style_from_config("x", config | {"filename_parsing": {"date_format": "%B"}})


# ------------------------------------------------------------ staged writes ----


def input_files(df):
    return [f for f in df.inputFiles()]


def test_a_merge_reads_the_touched_partition_only(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "events")
    first = events(spark, 3)
    for day in range(1, 20):
        first = first.union(events(spark, 2, day=day))
    store.write_events(first, root)
    seen = []
    plain = store.merged
    monkeypatch.setattr(store, "merged", lambda old, new, key=None: seen.append(input_files(old)) or plain(old, new, key))
    store.write_events(events(spark, 2, size=5.0, day=7).union(events(spark, 1, day=30)), root)
    assert len(seen) == 1 and seen[0] and all("date=2024-03-30" in f for f in seen[0])
    assert store.list_available(spark, root).count() == 21
    loaded = store.load_events(spark, root, "coinbase", "20260101", "2024-03-30")
    assert all("date=2024-03-30" in f for f in input_files(loaded)) and [r.size for r in loaded.collect()] == [5.0, 5.0]


def sizes(spark, root, day=("2024-03-23", "2024-03-25")):
    return [r.size for r in store.load_events(spark, root, "coinbase", "20260101", day).collect()]


def three_days(spark, size):
    return events(spark, 1, size=size).union(events(spark, 1, size=size, day=1)).union(events(spark, 1, size=size, day=2))


@pytest.mark.parametrize("swapped", [None, 0, 1, 2])
def test_a_write_lost_half_way_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch, swapped):
    """Lost before the manifest (None), or after some partitions were swapped."""
    root = str(tmp_path / "events")
    store.write_events(three_days(spark, 1.0), root)
    with monkeypatch.context() as m:
        if swapped is None:
            m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        else:
            swap = store._swap

            def some(spark, root, write, folders):
                real = store.file_system

                def last(spark_, path):
                    if path.endswith(f"/new/{folders[swapped]}"):
                        raise RuntimeError("lost")
                    return real(spark_, path)

                m.setattr(store, "file_system", last)
                swap(spark, root, write, folders)

            m.setattr(store, "_swap", some)
        with pytest.raises(RuntimeError, match="lost"):
            store.write_events(three_days(spark, 2.0), root, "overwrite")
    want = 1.0 if swapped is None else 2.0
    # readers
    assert sizes(spark, root) == [want] * 3
    assert [r.size for r in store.read_store(spark, root).collect()] == [want] * 3
    listed = store.list_available(spark, root).collect()
    assert [(r.date, r.rows) for r in listed] == [("2024-03-23", 1), ("2024-03-24", 1), ("2024-03-25", 1)]
    # the next writer clears up, and its own write is not disturbed
    store.write_events(events(spark, 1, size=9.0, day=1), root, "overwrite")
    assert sizes(spark, root) == [want, 9.0, want]
    assert store._folders(spark, f"{root}/{store.STAGED}") == set()


def test_partition_names_with_signs(spark, tmp_path):
    root = str(tmp_path / "events")
    for _ in range(2):
        store.write_events(events(spark, 2, symbol="BTC/USD=%é [x]"), root)
    assert store.load_events(spark, root, "coinbase", "BTC/USD=%é [x]", "2024-03-23").count() == 2
    assert store.list_available(spark, root, symbol="BTC/USD=%é [x]").first().rows == 2
    with pytest.raises(FileExistsError, match="1 of 1"):
        store.write_events(events(spark, 1, symbol="BTC/USD=%é [x]"), root, "error")


def test_runs_leave_no_scratch_behind(spark, tmp_path):
    import glob

    from orderweave.session import _own_dir, keep, pin, run_folder

    with run_folder(spark) as outer:
        with run_folder(spark):
            inner, kept = pin(spark.range(3), "a"), keep(spark.range(4), "b")
        assert kept.count() == 4 and inner.inputFiles()[0].startswith("file:") and not glob.glob(f"{outer}/run-*")
    assert not glob.glob(outer)
    folder, root = tmp_path / "raw", str(tmp_path / "events")
    folder.mkdir()
    before = set(glob.glob(f"{_own_dir(spark)}/*"))
    for i in range(5):
        write_s(folder, f"2024011{i}_X.csv", "10:00:00.000000;10:00:00.000000;1;1;100;5;ADD;;")
    ingest(spark, str(folder), "coinbase", root, str(tmp_path / "offsets"), files_per_batch=1).awaitTermination()
    assert len(stored(spark, root)) == 5
    assert set(glob.glob(f"{_own_dir(spark)}/*")) == before


def test_the_folders_above_a_file_cost_nothing(spark):
    """The name of a file is looked for in the end of its path, not at every sign of it."""
    ends = {
        "x.csv": "x.csv", "x.csv/part-0.csv": "x.csv", "file=x.csv/part-0-c000.csv": "x.csv", "x.csv/y.csv": "y.csv",
        "a=x.csv": "x.csv", "x.csv/part-0/y.csv": "y.csv", "x.csv/part-0": "x.csv", "x.csv/y": "", ".csv": "", "x.csv/part-": "x.csv",
    }
    df = spark.createDataFrame([(end,) for end in ends], "end string").crossJoin(spark.range(0, 3000, 1, 8))
    df = df.selectExpr("end", "concat('file:/', repeat(concat(repeat('d', 240), '/'), 40), id, '/', end) as path").repartition(8).localCheckpoint()
    began = time.monotonic()
    got = df.selectExpr("end", f"{feeds._FILE_ID.format('path')} as id").distinct().collect()
    assert time.monotonic() - began < 6
    assert {r.end: r.id for r in got} == ends

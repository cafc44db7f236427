"""The given tables, and the ``events`` table seen as either feed style (Stage A rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderweave.session import configure, pin


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _common(instant: str) -> list[str]:
    return [
        "concat('SYM', cast(user_id % 3 as string)) as file_id",
        "event_id as line_no",
        f"unix_micros(cast({instant} as timestamp)) * 1000 as ts",
        "concat('SYM', cast(user_id % 3 as string)) as symbol",
        "cast(user_id as string) as order_id",
        "if(user_id % 2 = 0, 'BID', 'ASK') as side",
        "100 + floor(value * 4) / 4 as price",
    ]


def feed_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as style-S Stage A rows; days as timestamps force same-instant pairs."""
    return read(spark, sf_dir, "events").selectExpr(
        *_common("date_trunc('day', ts)"),
        "cast((event_id * 7) % 5 as double) as size",
        """case when event_id % 997 < 3 then 'SNAPSHOT' else case event_type when 'signup' then 'ADD'
             when 'view' then 'SUB' when 'purchase' then 'MATCH' when 'click' then 'SET'
             when 'error' then 'DELETE' end end as raw_type""",
        "if(event_type = 'click' and event_id % 4 <> 0, cast(event_id % 6 as double), null) as new_size",
        "if(event_type = 'click' and event_id % 3 <> 0, 100 + floor(value * 2) / 4, null) as new_price",
    )


def feed_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as style-Q Stage A rows."""
    return read(spark, sf_dir, "events").selectExpr(
        *_common("ts"),
        "cast(event_id % 5 as double) as size",
        """case when event_id % 997 = 0 then 'R' when event_id % 991 = 0 then 'N'
             else case event_type when 'signup' then 'A' when 'click' then 'M' when 'view' then 'C'
             when 'purchase' then 'F' when 'error' then 'T' end end as raw_type""",
        "if(event_id % 101 = 0, null, event_id div 8) as sequence",
    )


# -------------------------------------------- events as raw vendor files ----
# Text columns as the vendors write them, with the faults real files have: late rows filed
# under the next day, a file name without a symbol, unreadable prices, codes and one bad clock.

_CENTS = "cast(cast((100 + floor(value * 4) / 4) * 100 as bigint) as string)"
_DECIMAL = f"concat(left({_CENTS}, length({_CENTS}) - 2), '.', right({_CENTS}, 2))"
# all in the file of one day and symbol, so the share of rows in unreadable files does not grow with the table
_BAD_CLOCK = "user_id % 3 = 2 and dayofmonth(ts) = 6 and hour(ts) < 20 and event_id % 41 = 40"
_LATE = "hour(ts) >= 20 and event_id % 7 = 0"


def raw_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of style-S files; ``file`` is the name of the file a row belongs to."""
    return read(spark, sf_dir, "events").selectExpr("*", "date_format(ts, 'HH:mm:ss.SSSSSS') as clock").selectExpr(
        f"""case when user_id % 3 = 2 and dayofmonth(ts) = 5 then 'nosymbol.csv' else
            concat(date_format(date_add(cast(ts as date), if({_LATE}, 1, 0)), 'yyyyMMdd'),
                   '_SYM', cast(user_id % 3 as string), '.csv') end as file""",
        "event_id",
        f"if({_BAD_CLOCK}, 'noon', concat(clock, '7')) as time_exchange",
        f"if({_LATE}, '00:00:01.000000', clock) as time_coinapi",
        "cast(user_id as string) as order_id",
        "if(event_id % 113 = 0, '9', cast((user_id + 1) % 2 as string)) as is_buy",
        f"if(event_id % 59 = 0, 'n/a', {_DECIMAL}) as entry_px",
        "cast((event_id * 7) % 5 as string) as entry_sx",
        """case when event_id % 997 < 3 then 'SNAPSHOT' when event_id % 211 = 0 then 'PING'
             else case event_type when 'signup' then 'ADD' when 'view' then 'SUB' when 'purchase' then 'MATCH'
             when 'click' then 'SET' when 'error' then 'DELETE' end end as update_type""",
        "if(event_type = 'click' and event_id % 4 <> 0, cast(event_id % 6 as string), null) as new_size",
        f"if(event_type = 'click' and event_id % 3 <> 0, {_DECIMAL}, null) as new_price",
    )


def raw_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of style-Q files, one file per symbol."""
    return read(spark, sf_dir, "events").selectExpr(
        "concat('20240101_SYM', cast(user_id % 3 as string), '.csv') as file",
        "event_id",
        "cast(unix_micros(cast(ts as timestamp)) * 1000 + 11 as string) as ts_recv",
        "cast(unix_micros(cast(ts as timestamp)) * 1000 + 7 as string) as ts_event",
        "'160' as rtype",
        "'2' as publisher_id",
        "cast(user_id % 3 as string) as instrument_id",
        """case when event_id % 997 = 0 then 'R' when event_id % 991 = 0 then 'N'
             else case event_type when 'signup' then 'A' when 'click' then 'M' when 'view' then 'C'
             when 'purchase' then 'F' when 'error' then 'T' end end as action""",
        "case when event_id % 997 = 0 then 'N' when user_id % 2 = 0 then 'B' else 'A' end as side",
        "if(event_id % 59 = 0, null, cast(cast((100 + floor(value * 4) / 4) * 1000000000 as bigint) as string)) as price",
        "cast(event_id % 5 as string) as size",
        "'0' as channel_id",
        "cast(user_id as string) as order_id",
        "cast(event_id % 256 as string) as flags",
        "cast(event_id % 1000 as string) as ts_in_delta",
        "if(event_id % 101 = 0, null, cast(event_id div 8 as string)) as sequence",
        "concat('SYM', cast(user_id % 3 as string)) as symbol",
    )


def write_raw(rows: DataFrame, separator: str, path: str) -> str:
    """Write raw rows as delimited files with headers, each below a directory that carries its name."""
    (
        rows.repartitionByRange("file", "event_id")
        .sortWithinPartitions("file", "event_id")
        .drop("event_id")
        .write.option("header", True)
        .option("sep", separator)
        .partitionBy("file")
        .csv(path)
    )
    return path


#: One day's file of the last symbol lacks a column that is required.
BROKEN = "file like '______07_SYM2.csv'"


def write_raw_s(rows: DataFrame, path: str) -> str:
    """Style-S rows as files whose columns stand in three orders, some with one more, some with one less, a file without
    a column that is required, and one with a header only."""
    named = [c for c in rows.columns if c not in ("file", "event_id")]
    rows = pin(rows, "raw")  # each layout is ranged, that is read twice
    layouts = [
        ("file like '%SYM0.csv'", named),
        ("file like '%SYM1.csv'", ["'X' as venue", *named[::-1]]),
        (f"not ({BROKEN}) and file not like '%SYM0.csv' and file not like '%SYM1.csv'", [*named[4:-1], *named[:4]]),
        (BROKEN, [c for c in named if c != "update_type"]),
    ]
    for i, (files, columns) in enumerate(layouts):
        write_raw(rows.where(files).selectExpr(*columns, "file", "event_id"), ";", f"{path}/layout={i}")
    rows.select(*named).limit(0).coalesce(1).write.option("header", True).option("sep", ";").csv(f"{path}/layout=none/file=20240229_SYM0.csv")
    return path

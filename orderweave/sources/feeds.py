"""Raw feed files and their normalisation (Stage A).

A feed style is configuration; one ``select`` built from it turns raw rows into
``ts, symbol, order_id, side, price, size, raw_type`` plus the style's extra columns. Files are read by the names in
their headers: those with the same header are scanned together, so columns may stand in any order.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.functions.columns import clock_hour, iso_to_ns
from orderweave.session import configure, pin, sql


@dataclass(frozen=True)
class FeedStyle:
    """Names of a vendor's columns and how they are read. ``replay`` names the rules of its record types: ``S`` (changes
    set or subtract) or ``Q`` (records grouped by sequence)."""

    name: str
    source: str
    columns: tuple[str, ...]
    ts: str
    raw_type: str
    side: str
    price: str
    sizes: tuple[str, ...]
    side_map: dict[str, str] = field(hash=False)
    extras: tuple[str, ...] = ()
    order_id: str = "order_id"
    symbol: str | None = None
    separator: str = ","
    ts_format: str = "iso8601"
    price_scale: str = "1.0D"
    replay: str = "S"
    symbol_from_name: bool = False
    date_from_name: bool = False
    name_separator: str = "_"
    name_date: str = "yyyyMMdd"
    receive_clock: str | None = None
    late_hour: int = 20
    early_hour: int = 2


# Column names, codes and scales of the two vendors' files.
STYLE_S = FeedStyle(
    name="coinbase",
    source="COINBASE",
    separator=";",
    columns=(
        "time_exchange", "time_coinapi", "order_id", "is_buy", "entry_px", "entry_sx",
        "update_type", "new_size", "new_price",
    ),
    ts="time_exchange",
    raw_type="update_type",
    side="is_buy",
    price="entry_px",
    sizes=("entry_sx",),
    side_map={"1": "BID", "0": "ASK"},
    extras=("new_size", "new_price"),
    symbol_from_name=True,
    date_from_name=True,
    receive_clock="time_coinapi",
)
STYLE_Q = FeedStyle(
    name="databento",
    source="DATABENTO",
    columns=(
        "ts_recv", "ts_event", "rtype", "publisher_id", "instrument_id", "action", "side", "price",
        "size", "channel_id", "order_id", "flags", "ts_in_delta", "sequence", "symbol",
    ),
    ts="ts_event",
    raw_type="action",
    side="side",
    price="price",
    sizes=("size",),
    side_map={"B": "BID", "A": "ASK"},
    extras=("sequence", "flags"),
    symbol="symbol",
    ts_format="unix_ns",
    price_scale="1e-9D",
    replay="Q",
)
#: Text of an order id that a file leaves out (fixed value): a missing id is an order of its own, never null.
NO_ID = "nan"

STYLES = {style.name: style for style in (STYLE_S, STYLE_Q)}


def style_of(source: str | FeedStyle) -> FeedStyle:
    if isinstance(source, FeedStyle):
        return source
    try:
        return STYLES[source.lower()]
    except KeyError:
        raise ValueError(f"unknown source '{source}', expected one of {sorted(STYLES)}") from None


def register_style(style: FeedStyle) -> FeedStyle:
    """Make a style known by its name, in place of any other of that name."""
    STYLES[style.name.lower()] = style
    return style


def style_from_config(name: str, config: Mapping, replay: str = "S") -> FeedStyle:
    """A style from a source's section of a configuration file, as read from YAML or JSON.

    Known keys (fixed values): csv_divider, column_map (ts, symbol, order_id, side, price), size_col_priority, event_type_col,
    aux_cols, side_map, timestamp_format, price_scale, and filename_parsing with date_injection, date_format, filename_sep and
    midnight_correction (enabled, reference_col, late_hour_threshold, early_hour_threshold). Others are not read."""
    names, naming = config["column_map"], config.get("filename_parsing") or {}
    crossing = naming.get("midnight_correction") or {}
    ts, raw_type = names["ts"], config.get("event_type_col", "type")
    order_id, side, price = (names.get(k, k) for k in ("order_id", "side", "price"))
    sizes, extras = tuple(config.get("size_col_priority") or ["size"]), tuple(config.get("aux_cols") or ())
    receive = crossing.get("reference_col") if crossing.get("enabled") else None
    date = naming.get("date_format", "%Y%m%d")
    for directive, pattern in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%y", "yy"), ("%j", "DDD")):
        date = date.replace(directive, pattern)
    if "%" in date:
        raise ValueError(f"date_format {naming['date_format']!r}: only %Y, %y, %m, %d and %j are known")
    named = [ts, names.get("symbol"), order_id, side, price, *sizes, raw_type, *extras, receive]
    return FeedStyle(
        name=name.lower(),
        source=name.upper(),
        columns=tuple(dict.fromkeys(c for c in named if c)),
        ts=ts,
        raw_type=raw_type,
        side=side,
        price=price,
        sizes=sizes,
        side_map={str(k): v for k, v in (config.get("side_map") or {}).items() if v is not None},
        extras=extras,
        order_id=order_id,
        symbol=names.get("symbol"),
        separator=config.get("csv_divider", ","),
        ts_format=config.get("timestamp_format", "iso8601"),
        price_scale=f"{float(config.get('price_scale', 1.0))!r}D",
        replay=replay,
        symbol_from_name=bool(naming),
        date_from_name=bool(naming.get("date_injection")),
        name_separator=naming.get("filename_sep", "_"),
        name_date=date,
        receive_clock=receive,
        late_hour=int(crossing.get("late_hour_threshold", 20)),
        early_hour=int(crossing.get("early_hour_threshold", 2)),
    )


def require_columns(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing column(s) {missing}; available: {df.columns}")


# ------------------------------------------------------------------- files ----

#: Different headers among the files of one feed.
MOST_LAYOUTS = 500


@dataclass(frozen=True)
class Layout:
    """Files with one header: all given paths if there is no other header, else the files' own."""

    columns: tuple[str, ...]
    paths: str | list[str]


def literal_path(path: str) -> str:
    """A path in which signs with a meaning in path patterns stand for themselves."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _matching(reader, glob: str | None):
    reader = reader.option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", glob) if glob else reader


# a file may be written in parts below a directory that carries its name; the folders above would be searched at every sign
_FILE_ID = "regexp_extract(substring_index({}, '/', -2), '([^/=]+[.]csv)(?:/part-[^/]*)?$', 1)"


def _names(header: str, separator: str) -> tuple[str, ...]:
    """The columns of a header line; a name that comes again gets a number."""
    found: list[str] = []
    for name in next(csv.reader([header.removeprefix("\ufeff")], delimiter=separator), []):
        name = base = name.strip()
        n = 0
        while name in found:
            n += 1
            name = f"{base}.{n}"
        found.append(name)
    return tuple(found)


class Feed:
    """The files of a feed: ``files`` (file_id, missing, problem) and the ``layouts`` that can be read.

    A listing gives the files, without opening them; a scan of the lines as text gives the first line of each. Files
    are grouped by that line. A file without a column that Stage A requires, and one without a header, is not
    read; ``problem`` says so. The driver holds one line for each different header and, if there are several, the paths
    of the files, as Spark's own listing does."""

    def __init__(self, spark: SparkSession, paths: str | list[str], style: FeedStyle, glob: str | None = None):
        self.spark, self.style = configure(spark), style
        listed = _matching(spark.read.format("binaryFile"), glob).load(paths)
        listing = listed.selectExpr("path", "_metadata.file_path as uri")
        lines = _matching(spark.read, glob).text(paths).where("_metadata.file_block_start = 0")
        first = lines.selectExpr("_metadata.file_path as uri", "value", "monotonically_increasing_id() as row")
        headers = sql(
            """select l.path, l.uri, f.header from {l} l left join (select uri, min_by(value, row) as header from {f} group by uri) f on l.uri = f.uri""",
            l=listing,
            f=first,
        )
        self._headers = pin(headers, "headers")
        # a scan passes over files without a byte
        every = listed.inputFiles()
        if len(every) > self._headers.count():
            plain = "regexp_replace({}, '^([^:/]+):/+', '$1:/')"  # slashes after the scheme are written in two ways
            empty = sql(
                f"""select cast(null as string) as path, e.uri, cast(null as string) as header
                    from {{e}} e left anti join {{h}} h on {plain.format("e.uri")} = {plain.format("h.uri")}""",
                e=spark.createDataFrame([(uri,) for uri in every], "uri string"),
                h=self._headers,
            )
            self._headers = pin(self._headers.unionByName(empty), "headers")
        kinds = self._headers.groupBy("header").count().orderBy(F.desc("count"), "header").limit(MOST_LAYOUTS + 1).collect()
        if len(kinds) > MOST_LAYOUTS:
            raise ValueError(f"more than {MOST_LAYOUTS} different headers in {paths}")
        self.layouts: list[Layout] = []
        problems: list[tuple] = []
        for header in [r["header"] for r in kinds]:
            columns = _names(header, style.separator) if header is not None else ()
            missing = [c for c in dict.fromkeys((style.ts, style.raw_type)) if c not in columns]
            if header is None:
                problems.append((header, None, "empty file"))
            elif missing:
                problems.append((header, ", ".join(missing), f"missing column(s): {', '.join(missing)}; available: {', '.join(columns)}"))
            else:
                self.layouts.append(Layout(columns, paths if len(kinds) == 1 else self._paths(header)))
        self._glob = glob if len(kinds) == 1 else None
        known = spark.createDataFrame(problems, "header string, missing string, problem string")
        self.files = sql(
            f"""select {_FILE_ID.format("h.uri")} as file_id, min(k.missing) as missing, min(k.problem) as problem
                from {{h}} h left join {{k}} k on h.header <=> k.header group by 1""",
            h=self._headers,
            k=F.broadcast(known),
        )

    def _paths(self, header: str) -> list[str]:
        return [literal_path(r["path"]) for r in self._headers.where(F.col("header") == header).select("path").toLocalIterator()]

    def raw(self) -> list[DataFrame]:
        """The rows of each layout as text, under their own names, with ``file_id`` and ``line_no``.

        ``line_no`` orders lines inside a file however Spark splits it: block offset, then row in the block."""
        return [self._scan(layout) for layout in self.layouts]

    def _scan(self, layout: Layout) -> DataFrame:
        reader = (
            _matching(self.spark.read, self._glob)
            .schema(", ".join(f"`{c.replace('`', '``')}` string" for c in layout.columns))
            .option("sep", self.style.separator)
            .option("header", True)
        )
        rows = reader.csv(layout.paths).selectExpr("*", "_metadata as _file")
        return rows.selectExpr(
            *[f"`{c}`" for c in self.style.columns if c in layout.columns],
            f"{_FILE_ID.format('_file.file_path')} as file_id",
            "struct(_file.file_name as part, _file.file_block_start as block, monotonically_increasing_id() as row) as line_no",
        )

    def rows(self, symbol: str | None = None) -> DataFrame:
        """Stage A rows of all files that can be read, with ``problem`` for a row that cannot be placed."""
        if not self.layouts:
            known = self.files.where("problem is not null").orderBy("file_id").first()
            raise KeyError(f"no file can be read; {known['file_id']}: {known['problem']}")
        return reduce(DataFrame.unionByName, [normalise(raw, self.style, symbol) for raw in self.raw()])


def scan_csv(spark: SparkSession, paths: str | list[str], style: FeedStyle, glob: str | None = None) -> DataFrame:
    """All raw rows of one or many files as text, by the style's names, with ``file_id`` and the line position.

    A column that a file does not have is null in its rows; files without a required column are left out."""
    feed = Feed(spark, paths, style, glob)
    parts = feed.raw() or [feed._scan(Layout(style.columns, []))]
    empty = [F.lit(None).cast("string").alias(c) for c in style.columns]
    full = [p.select("*", *[e for e, c in zip(empty, style.columns) if c not in p.columns]) for p in parts]
    return reduce(DataFrame.unionByName, full).select(*style.columns, "file_id", "line_no")


def with_file_meta(df: DataFrame, style: FeedStyle) -> DataFrame:
    """``file_date`` and ``file_symbol`` from a ``DATE_SYMBOL.csv`` name, null if the name does not fit."""
    sep = style.name_separator
    pattern = rf"^([^{sep}]+){sep}(.+)[.]csv$"
    return df.selectExpr(
        "*",
        f"try_to_date(regexp_extract(file_id, '{pattern}', 1), '{style.name_date}') as file_date",
        f"nullif(regexp_extract(file_id, '{pattern}', 2), '') as file_symbol",
    )


def with_injected_date(df: DataFrame, style: FeedStyle) -> DataFrame:
    """Prefix the file's date to the time of day. Late exchange times received early belong to the day before."""
    day = "file_date"
    if style.receive_clock and style.receive_clock in df.columns:
        crossed = (
            f"coalesce({clock_hour(style.ts)} >= {style.late_hour}"
            f" and {clock_hour(style.receive_clock)} <= {style.early_hour}, false)"
        )
        day = f"if({crossed}, date_sub(file_date, 1), file_date)"
    stamped = f"concat(date_format({day}, 'yyyy-MM-dd'), ' ', {style.ts})"
    return df.selectExpr(*[f"{stamped} as {c}" if c == style.ts else f"`{c}`" for c in df.columns])


def stage_a(
    raw: DataFrame, style: FeedStyle, symbol: str | None = None, seen: str | None = None, also: list[str] | None = None
) -> DataFrame:
    """Normalise raw rows by configuration. Rows with an unreadable time keep a null ``ts``.

    ``seen`` is an expression to be kept under that name, ``also`` columns to be kept."""
    require_columns(raw, style.ts, style.raw_type)
    have = set(raw.columns)
    if symbol is not None:
        symbol_expr = "'" + symbol.replace("\\", "\\\\").replace("'", "\\'") + "'"
    elif "file_symbol" in have:
        symbol_expr = "file_symbol"
    elif style.symbol in have:
        symbol_expr = f"cast({style.symbol} as string)"
    else:
        raise KeyError(f"no symbol: pass one or provide the column '{style.symbol or 'file_symbol'}'")

    ts = f"try_cast({style.ts} as bigint)" if style.ts_format == "unix_ns" else iso_to_ns(f"cast({style.ts} as string)")
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in style.side_map.items())
    side = f"try_element_at(map({pairs}), cast({style.side} as string))" if style.side in have else "cast(null as string)"
    price = f"try_cast({style.price} as double) * {style.price_scale}" if style.price in have else "cast(null as double)"
    sizes = [f"nullif(try_cast({c} as double), double('NaN'))" for c in style.sizes if c in have]
    extras = [
        f"nullif(try_cast({c} as double), double('NaN')) as {c}" if c in have else f"cast(null as double) as {c}"
        for c in style.extras
    ]
    position = [c for c in ("file_id", "line_no") if c in have]
    return raw.selectExpr(
        f"{ts} as ts",
        f"{symbol_expr} as symbol",
        f"coalesce(cast({style.order_id} as string), '{NO_ID}') as order_id" if style.order_id in have else "'' as order_id",
        f"{side} as side",
        f"{price} as price",
        f"coalesce({', '.join(sizes)}) as size" if sizes else "cast(null as double) as size",
        f"cast({style.raw_type} as string) as raw_type",
        *extras,
        *position,
        *([f"{seen} as seen"] if seen else []),
        *(also or []),
    )


def normalise(raw: DataFrame, style: FeedStyle, symbol: str | None = None) -> DataFrame:
    """Raw file rows to Stage A rows, with ``problem``: why a row cannot be placed in time or under a symbol, else null."""
    named = style.symbol_from_name or style.date_from_name
    if named:
        raw = with_file_meta(raw, style)
    if style.date_from_name:
        raw = with_injected_date(raw, style)
    badly_named = ["file_symbol is null" if symbol is None else "false", "file_date is null" if style.date_from_name else "false"]
    problem = f"""case when {" or ".join(badly_named) if named else "false"} then 'file name is not DATE{style.name_separator}SYMBOL.csv'
        when ts is null then concat("unreadable time '", coalesce(seen, ''), "'") when symbol is null then 'no symbol' end as problem"""
    kept = ["file_symbol"] * named + ["file_date"] * named
    rows = stage_a(raw, style, symbol, seen=f"cast(`{style.ts}` as string)", also=kept)
    return rows.selectExpr("*", problem).drop("seen", *kept)


def read_feed(
    spark: SparkSession, paths: str | list[str], style: FeedStyle, symbol: str | None = None, glob: str | None = None
) -> DataFrame:
    """Stage A rows of files. Raises KeyError if none of them has the required columns."""
    return Feed(spark, paths, style, glob).rows(symbol).drop("problem")


def in_time_order(rows: DataFrame) -> DataFrame:
    """Stage A rows sorted by time; equal times keep line order."""
    return rows.orderBy("ts", "file_id", "line_no")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Stage A rows with their place in the order of time, from 1; equal times keep line order. Rows are ranged over
    chunks and counted there, so no task sorts them all."""
    from orderweave.operators.scan import CHUNK, Chunks

    chunks = Chunks(rows.selectExpr("*", "0 as _all"), ["_all"], ["ts", "file_id", "line_no"], "places")
    return chunks.scan(sums={name: "1L"}).drop("_all", CHUNK)


def file_status(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Per file of ``files`` (of ``Feed``): rows, rows that could not be placed, the first reason against the file,
    and whether it is usable. Files without rows are listed too: one with a header only is usable."""
    return sql(
        """
        with counted as (select file_id, count(*) as n_rows, count(problem) as n_bad from {rows} group by file_id),
        reasons as (select file_id, min_by(problem, line_no) as reason from {rows} where problem is not null group by file_id)
        select f.file_id, coalesce(c.n_rows, 0) as n_rows, coalesce(c.n_bad, 0) as n_bad,
          coalesce(f.problem, r.reason) as reason, f.problem is null and r.reason is null as succeeded
        from {files} f left join counted c on f.file_id = c.file_id left join reasons r on f.file_id = r.file_id
        """,
        rows=rows,
        files=files,
    )

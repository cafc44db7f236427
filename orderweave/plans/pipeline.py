"""Files to stored events: read, replay, validate, write."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from orderweave.operators.quality import validation_report
from orderweave.operators.replay import EVENT_COLUMNS, stage_b_q, stage_b_s
from orderweave.operators.scan import attach
from orderweave.session import configure, keep, pin, release, run_folder, sql
from orderweave.sources.feeds import Feed, FeedStyle, file_status, style_of
from orderweave.sources.store import PARTITION, touched_partitions, write_events

REPLAY = {"S": stage_b_s, "Q": stage_b_q}


@dataclass
class PipelineResult:
    """``files``: status per file; ``report``: validation; ``touched``: partitions written (None if no events)."""

    files: DataFrame
    report: DataFrame | None
    touched: DataFrame | None


def run_files(
    spark: SparkSession,
    paths: str | list[str],
    source: str | FeedStyle,
    root: str,
    symbol: str | None = None,
    glob: str | None = "*.csv",
    mode: str = "merge",
) -> PipelineResult:
    """Process one file, many files or a directory in one go.

    A file whose header, name or times cannot be read is reported with the reason and left out; the others go on.
    Findings of the validation do not stop the write. Intermediate tables are deleted at the end."""
    style = style_of(source)
    with run_folder(configure(spark), "pipeline"):
        feed = Feed(spark, paths, style, glob)
        if not feed.layouts:
            return PipelineResult(keep(_unread(feed.files), "files"), None, None)
        rows = pin(feed.rows(symbol), "stage-a")
        files = keep(file_status(rows, feed.files), "files")
        good = rows.join(files.where("succeeded"), "file_id", "left_semi")
        events = pin(REPLAY[style.replay](good, style.source), "events")
        touched = touched_partitions(events)
        if not touched:
            return PipelineResult(files, None, None)
        report = keep(validation_report(events), "report")
        return PipelineResult(files, report, write_events(last_file_wins(events), root, mode, touched=touched))


def _unread(files: DataFrame) -> DataFrame:
    return files.selectExpr("file_id", "0L as n_rows", "0L as n_bad", "problem as reason", "false as succeeded")


def last_file_wins(events: DataFrame) -> DataFrame:
    """The files of one run as if they had been merged into the store one after another, by name.

    In a partition fed by several files the copy of the last file survives per key; a partition fed
    by one file is left as it is. Copies are combined before the shuffle; ``file_id`` is dropped."""
    key = ["source", "symbol", "day", "order_id", "session_id", "event_seq"]
    rest = [c for c in EVENT_COLUMNS if c not in key and c != "ts"]
    dated = events.selectExpr("*", "ts - pmod(ts, 86400000000000) as day")
    days = sql(
        """select source, symbol, day, count(*) as n_rows, count(distinct file_id) > 1 as shared
           from {dated} group by source, symbol, day""",
        dated=dated,
    )
    marked = attach(dated, days, ["source", "symbol", "day"], ["shared"], "order_id, session_id, event_seq, ts", "shared")
    return sql(
        f"""
        with latest as (
          select {", ".join(key)}, max(struct(file_id, ts, {", ".join(rest)})) as kept
          from {{marked}} where shared group by {", ".join(key)}
        )
        select {", ".join(EVENT_COLUMNS)} from {{marked}} where not coalesce(shared, false)
        union all
        select {", ".join(c if c in key else f"kept.{c}" for c in EVENT_COLUMNS)} from latest
        """,
        marked=marked,
    )


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Read raw order files and store unified events")
    group = parser.add_mutually_exclusive_group(required=True)
    group.add_argument("--file", help="one raw file")
    group.add_argument("--dir", help="a directory of raw files")
    parser.add_argument("--source", required=True, choices=["coinbase", "databento"])
    parser.add_argument("--symbol", help="symbol for files without one")
    parser.add_argument("--root", required=True, help="event store")
    parser.add_argument("--mode", default="merge", choices=["merge", "overwrite", "error"])
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("orderweave").getOrCreate()
    result = run_files(spark, args.file or args.dir, args.source, args.root, args.symbol, mode=args.mode)
    result.files.orderBy("file_id").show(truncate=False)
    if result.touched is not None:
        result.report.show(truncate=False)
        result.touched.orderBy(*PARTITION).show(truncate=False)
    release(spark)


if __name__ == "__main__":
    main()

"""The directory pipeline for files that keep arriving: each micro-batch takes whole new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from orderweave.plans.pipeline import run_files
from orderweave.session import configure, run_folder
from orderweave.sources.feeds import FeedStyle, literal_path, style_of

# fixed values: the columns of Spark's file listing
_LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(
    spark: SparkSession,
    directory: str,
    source: str | FeedStyle,
    root: str,
    checkpoint: str,
    symbol: str | None = None,
    glob: str = "*.csv",
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process the files not seen before and stop. A batch that is repeated after a failure merges the
    same rows again, which leaves the store as it was.

    The stream is one of file names: contents are not read until a batch runs, when each file is read by its own header.
    What a batch writes in between is deleted once its events are stored."""
    style = style_of(source)
    stream = (
        configure(spark)
        .readStream.format("binaryFile")
        .schema(_LISTING)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(directory)
        .select("path")
    )

    def store(batch: DataFrame, _: int) -> None:
        with run_folder(spark, "batch"):
            paths = [literal_path(r["path"]) for r in batch.collect()]  # files_per_batch names at most
            if paths:
                run_files(spark, paths, style, root, symbol, glob=None)

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

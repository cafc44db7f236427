"""Session settings, SQL over DataFrames, and pinned intermediate tables."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # a symbol such as 20260101 must read back from its directory name as text
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # a static overwrite would delete every partition of the store
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_SCRATCH: dict[str, str] = {}  # one folder for each application in local mode

CHUNKS_CONF = "spark.orderweave.chunks"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that the operators rely on."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def sql(query: str, **frames: DataFrame) -> DataFrame:
    """Run ``query`` over the given frames, each named in braces."""
    return next(iter(frames.values())).sparkSession.sql(query, **frames)


def work_dir(spark: SparkSession) -> str:
    """Folder for pinned tables: the cluster's shared one, or a scratch one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _SCRATCH:
        _SCRATCH[application] = tempfile.mkdtemp(prefix="orderweave-")
    return _SCRATCH[application]


def _own_dir(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/orderweave-{spark.sparkContext.applicationId}"


#: Folder of the innermost run that is under way in this thread.
_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{_RUN.get() or _own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path in its terms."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _delete(spark: SparkSession, folder: str) -> None:
    system, path = file_system(spark, folder)
    system.delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete this application's pinned tables once its results are stored elsewhere.

    Frames that read them, and remembered query inputs, must not be used afterwards."""
    _delete(spark, _own_dir(spark))


@contextlib.contextmanager
def run_folder(spark: SparkSession, tag: str = "run"):
    """Everything pinned inside is deleted at the end, also after a failure. Runs nest; ``keep`` saves a table of an inner
    run for the outer one."""
    folder = fresh_path(spark, tag)
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        _delete(spark, folder)


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Pin ``df`` outside the run that is under way."""
    folder = _RUN.get()
    token = _RUN.set(folder.rpartition("/")[0] if folder else None)
    try:
        return pin(df, tag)
    finally:
        _RUN.reset(token)


def pin(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back: lineage is cut, columns stay prunable,
    and every later pass sees the same rows even if executors are lost."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

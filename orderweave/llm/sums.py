"""Sums of numpy vectors over the rows of a table, bounded in memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key's rows are first summed in so many parts.
SALTS = 16


def _streamed(column: str, value: str, kind: pa.DataType):
    """Sum the vectors of each key of a partition as they come; what is held is one vector for each key."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            for key, raw in zip(batch.column(column).to_pylist(), batch.column(value)):
                vector = np.frombuffer(raw.as_buffer(), np.float64)
                if key in total:
                    total[key] += vector
                else:
                    total[key] = vector.copy()
        for key, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([vector.tobytes()], pa.binary())], [column, value])

    return run


def vector_sums(parts: DataFrame, column: str, kind: str, value: str = "vector") -> DataFrame:
    """(``column``, ``value``): the element-wise sum, per key, of ``value`` (doubles as bytes, one length per key).

    ``parts`` has a row per key and task. They are summed in two steps, so that many tasks do not meet in one."""
    arrow = {"int": pa.int32(), "string": pa.string()}[kind]
    schema = f"{column} {kind}, {value} binary"
    salted = parts.select(column, value).repartition(F.col(column), F.monotonically_increasing_id() % SALTS)
    once = salted.mapInArrow(_streamed(column, value, arrow), schema)
    return once.repartition(column).mapInArrow(_streamed(column, value, arrow), schema)

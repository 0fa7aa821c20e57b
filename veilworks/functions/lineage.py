"""Results that several later steps read are written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def written(df: DataFrame) -> DataFrame:
    """df as read back from the session's spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local session, as in tests; on a cluster it is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veilworks"))
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """df, for a join that deals both sides out by their key.

    The size of texts that functions make is unknown to the planner, which takes them for a few bytes a row and sends them through the driver to all executors."""
    return df.hint("merge")


def folded(rows: DataFrame, columns: list[str], schema: str, fold: Callable[..., Iterable[tuple]], at_once: int = 256) -> DataFrame:
    """The rows of `schema` that fold(*values of columns) gives for each row, without an exchange; workers hold `at_once` rows at a time."""
    kinds = to_arrow_schema(StructType.fromDDL(schema), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, at_once):
                part = b.slice(k, at_once)
                made = [row for values in zip(*[part.column(c).to_pylist() for c in columns], strict=True) for row in fold(*values)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kinds, strict=True)], schema=kinds)

    return rows.select(*columns).mapInArrow(run, schema)

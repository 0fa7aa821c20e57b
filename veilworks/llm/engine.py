"""Spark helpers of the corpus operators: tables, checkpoints, chunk counts and global prefix sums."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local session, as in tests; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint")
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: written once to the cluster's shared checkpoint folder and read from there.

    The shuffle files of the step go once its result is written, as nothing reads them any more."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint()  # a plan of its own, made under this setting
    finally:
        spark.conf.set(_CLEAN_UP, before)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def parts_for(total: int, each: int) -> int:
    """How many parts of about `each` units hold `total`; it grows with the input without an upper limit."""
    return max(1, math.ceil(total / each))


def prefix_sums(df: DataFrame, order: list[str], values: dict[str, Column], rows: int, rows_per_part: int = 200_000) -> DataFrame:
    """df with, for each name in values, the sum of that column over all rows before this one in `order`.

    Two passes, no global window: rows are dealt by range, each part is summed, the totals (one row
    a part) get their running sum, and each part adds its own. Rows that are equal in all columns of
    `order` are put in the order in which they were read, so a hot value is split over parts as well;
    df is a scan or settled, so that a task that runs again reads them in the same order.
    """
    known = df.select("*", *[v.cast("long").alias(f"_{k}") for k, v in values.items()], F.monotonically_increasing_id().alias("_tie"))
    order = [*order, "_tie"]
    ranged = settle(known.repartitionByRange(parts_for(rows, rows_per_part), *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_all_{k}") for k in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in values])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)).alias(f"_own_{k}") for k in values])
    joined = own.join(offsets, "_part")
    return joined.select(*[c for c in df.columns], *[(F.col(f"_own_{k}") + F.col(f"_base_{k}")).alias(k) for k in values])


def numbered(docs: DataFrame) -> DataFrame | None:
    """docs with _row, a number of its own for each row, in order of id (null last), then of a hash of the text;
    None where no id is null or repeated, so that the ids serve as they are."""
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return None
    known = docs.withColumns({"_last": F.col("doc_id").isNull(), "_text": F.xxhash64("text")})
    order = ["_last", "doc_id", "_text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    return settle(prefix_sums(known, order, {"_row": F.lit(1)}, docs.count()).drop("_last", "_text"))

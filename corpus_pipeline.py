"""From raw documents to shards of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
to the shared folder and reads it again for the next stage. Every row is a document of its own and
has its own verdict, whether its id is null, repeated or neither; an empty table goes through all stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.decontamination import decontaminate
from veilworks.llm.engine import numbered, shared_folder, table
from veilworks.llm.mixing import mix_sources
from veilworks.llm.neardup import near_duplicates
from veilworks.llm.quality import accepted, fit_quality
from veilworks.llm.sharding import shard_by_bytes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_row(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(docs), which decides by doc_id, so that each row is decided for itself.

    Where ids are null or repeated, step sees row numbers in their place, in order of id (null last),
    then of the row's other columns; the rows that it gives back have their own ids again."""
    docs = docs.select(COLUMNS)
    rows = numbered(docs)
    if rows is None:
        return step(docs).select(COLUMNS)
    known = rows.withColumn("_id", F.col("doc_id")).withColumn("doc_id", F.col("_row")).select(*COLUMNS, "_id")
    return step(known).withColumn("doc_id", F.col("_id")).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, each row by its own text; rows with a null or repeated id too."""
    return accepted(docs.select(COLUMNS), fit_quality(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of smallest id, of each group of near copies: five-word shingles, similarity 0.8.

    Rows with a null id are compared as all others and come last; of rows that repeat an id and text one stays."""
    return by_row(docs, lambda rows: rows.join(near_duplicates(rows, k=5, percent=80).filter("kept").select("doc_id"), "doc_id", "left_semi"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks, each row by its own text; rows with a null or repeated id too."""
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, up to three of a document, in the order of its schedule; each row counts for itself, with a null or repeated id too."""

    def step(rows: DataFrame) -> DataFrame:
        taken = mix_sources(rows).select("doc_id", "slot", "epoch")
        return rows.join(taken, "doc_id").repartitionByRange("slot", F.xxhash64("doc_id"), "doc_id").sortWithinPartitions("slot", F.xxhash64("doc_id"), "doc_id", "epoch")

    return by_row(docs, step)


def as_written(docs: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """docs with the place at which the stage before wrote each row, and these columns; None for docs that come from no files."""
    try:
        rows = docs.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return docs, None
    return rows, ["_file", "_place"]


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of the mix, rows with a null or repeated id too.

    Shards are cut from the mix in the order of its schedule, as the files hold it, so that each holds all
    sources in their shares; rows that come from no files are taken in order of id."""
    rows, order = as_written(docs)
    return shard_by_bytes(rows, 8, order=order)


STAGES = [("quality", quality), ("near_dedup", dedup), ("decontamination", benchmark), ("mixing", mix), ("sharding", shard)]

#: No SQL: two stages are learned or approximate by method; tests hold run() against brute force.
ORACLE_SQL = None


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. A stage's files go once the next one has read them; the last one's stay, as the result reads them."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            forget(spark, f"{base}/{before}")
        before = name
    return docs

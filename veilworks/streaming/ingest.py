"""Continuous detection over a landing folder, and the progress of one upload as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilworks.operators.detect import detect

STEPS = [("loading", "Loading document"), ("scanning", "Scanning for threats"), ("extracting", "Extracting text"), ("parties", "Detecting parties")]


def watch(spark: SparkSession, landing: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Detect entities in each batch of Parquet files (doc_id, text) that arrives, and append them to out.

    Each batch is written under its number, so a batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        detect(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema("doc_id long, text string").parquet(landing)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(docs: DataFrame) -> DataFrame:
    """(doc_id, step, line): the progress events of each document, then its completion, as JSON lines.

    A document that could not be loaded (its column `error`, if there is one, is not null) has one event that says so."""
    events = F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(i).alias("step"), F.lit(5).alias("total"), F.lit(m).alias("message")) for i, (k, m) in enumerate([*STEPS, ("complete", "Done")], 1)])
    if "error" in docs.columns:
        failed = F.struct(F.lit("error").alias("stage"), F.lit(None).cast("int").alias("step"), F.lit(None).cast("int").alias("total"), F.concat(F.lit("Failed to load document: "), "error").alias("message"))
        events = F.when(F.col("error").isNull(), events).otherwise(F.array(failed))
    return docs.select("doc_id", F.explode(events).alias("e")).select("doc_id", F.col("e.step").alias("step"), F.to_json("e").alias("line"))

"""Mapping files: the placeholders of each document with their originals, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "version string, created string, original_file string, mappings map<string,string>, party_labels map<string,string>, comment_authors map<string,string>"


def build(mapping: DataFrame, original_file: Column, created: Column, labels: DataFrame | None = None, authors: DataFrame | None = None) -> DataFrame:
    """(doc_id, m): one mapping structure for each document from (doc_id, ord, placeholder, original).

    labels (doc_id, party, label) and authors (doc_id, author, label) add the parties' labels and the comments' authors."""
    none = F.create_map().cast("map<string,string>")

    def gathered(rows: DataFrame | None, key: str, value: str, name: str) -> DataFrame | None:
        return rows and rows.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), F.col(value))))).alias(name))

    entries = F.transform(F.sort_array(F.collect_list(F.struct("ord", "placeholder", "original"))), lambda e: F.struct(e["placeholder"], e["original"]))
    out = mapping.groupBy("doc_id").agg(F.map_from_entries(entries).alias("_m"))
    for more, name in ((gathered(labels, "party", "label", "_labels"), "_labels"), (gathered(authors, "label", "author", "_authors"), "_authors")):
        out = out.withColumn(name, none) if more is None else out.join(more, "doc_id", "left").withColumn(name, F.coalesce(name, none))
    return out.select(
        "doc_id", F.struct(F.lit("1.0").alias("version"), created.alias("created"), original_file.alias("original_file"), F.col("_m").alias("mappings"), F.col("_labels").alias("party_labels"), F.col("_authors").alias("comment_authors")).alias("m")
    )


def first_entries(mapping: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, placeholder, original): the first n entries of each document's mapping, as a report shows them."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "placeholder"))
    return mapping.withColumn("_n", place).filter(F.col("_n") <= n).select("doc_id", "placeholder", "original")


def to_json(built: DataFrame) -> DataFrame:
    return built.select("doc_id", F.to_json("m").alias("json"))


def from_json(texts: DataFrame) -> DataFrame:
    """(doc_id, m) read back; a text that does not fit the schema ends the query."""
    return texts.select("doc_id", F.from_json("json", SCHEMA, {"mode": "FAILFAST"}).alias("m"))


def entries(built: DataFrame) -> DataFrame:
    return built.select("doc_id", F.explode("m.mappings").alias("placeholder", "original"))


def write(built: DataFrame, path: str) -> None:
    built.select("doc_id", "m.*").write.mode("errorifexists").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, " + SCHEMA).option("mode", "FAILFAST").json(path)

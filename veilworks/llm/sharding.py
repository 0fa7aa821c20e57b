"""Contiguous shards of near equal bytes, from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.llm.engine import prefix_sums


def byte_size(text: str = "text") -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): documents in id order, cut at equal byte targets.

    Law: a document goes to the shard in whose byte range its middle byte lies, so shards are
    contiguous in that order and each differs from total / n_shards by less than one document at
    either end. slot counts from 0 within a shard. A null text has size 1 and the CRC of the empty
    text; null ids come first; rows with an equal id keep together in order of size and CRC, and
    each gets a slot of its own. order: other columns of docs whose order takes the place of the id's.
    An empty table gives an empty result; other columns are ignored.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), byte_size(text_col).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        *(order or []),
    )
    counts = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(byte_size(text_col)).alias("bytes")).first()
    total = counts["bytes"] or 1
    placed = prefix_sums(sized, order or ["doc_id", "size", "text_crc32"], {"before": F.col("size"), "row": F.lit(1)}, counts["n"])
    # twice the middle byte, so that everything stays whole numbers
    middle = (F.col("before") * 2 + F.col("size")).cast("decimal(38,0)")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(2 * total).cast("decimal(38,0)"))).cast("int")
    cut = placed.withColumn("shard", shard)
    first = cut.groupBy("shard").agg(F.min("row").alias("_first"))  # one row a shard
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("_first")).cast("long").alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    from veilworks.llm.engine import table

    out = shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 is folded byte by byte over a table made by its rule; each different text is read once.
OP4_SQL = """WITH crc_table AS (
  SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
crcs AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM texts, crc_table),
sized AS (SELECT doc_id, strlen(coalesce(d.text, '')) + 1 AS size, text_crc32 FROM documents d JOIN crcs c ON c.text = coalesce(d.text, '')),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized),
cut AS (SELECT *, least(7, (2 * before + size) * 8 // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard FROM cut"""

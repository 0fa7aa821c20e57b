"""A training mix at target weights, drawn by a low-discrepancy schedule over blocks of equal token counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.llm.engine import prefix_sums, settle, table

#: The words of a text, as everywhere in this subpackage.
WORDS = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def fill_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), epochs: int = 3) -> list[tuple[str | None, int, float]]:
    """(source, size, target): all sizes shared by weight; targets stop at epochs * size, the excess is
    shared again by weight among the others until none is above. Sources by code point, null last."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {k: float(weights[i % len(weights)]) for i, (k, _) in enumerate(order)}
    size, target, left = dict(order), {}, float(sum(n for _, n in order))
    while open_ := [k for k, _ in order if k not in target]:
        share = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if weight[k] * share > epochs * size[k]]
        for k in over or open_:
            target[k] = float(epochs * size[k]) if over else weight[k] * share
        if over:
            left -= sum(target[k] for k in over)
    return [(k, size[k], target[k]) for k, _ in order]


def schedule(spark, targets: list[tuple[str | None, float]], n_slots: int, least: int = 8) -> tuple[DataFrame, dict[int, int]]:
    """(slot, source, block) and the number of slots of each source: golden-ratio points mapped through the
    cumulative targets; block ranks a source's slots. A source's share of any stretch of slots is within a
    few slots of its target. A source with a target that gets fewer than `least` slots that way has `least`
    evenly spread ones instead, which it may share with other sources. The points are looked up among the
    cumulative targets at once; the schedule has n_slots rows, a parameter, and `least` for each small source."""
    cuts = np.cumsum([t for _, t in targets])
    points = (np.arange(1, n_slots + 1) * GOLDEN) % 1.0
    source = np.minimum(np.searchsorted(cuts, points * (cuts[-1] or 1.0), side="right"), len(cuts) - 1)
    counts = np.bincount(source, minlength=len(targets))
    few = np.flatnonzero((np.array([t for _, t in targets]) > 0) & (counts < least))
    held = ~np.isin(source, few)
    own = ((np.arange(least)[None, :] + (few[:, None] + 1) * GOLDEN % 1.0) * n_slots / least).astype(np.int64)
    slot = np.concatenate([np.flatnonzero(held), own.ravel()])
    source = np.concatenate([source[held], np.repeat(few, least)])
    order = np.lexsort((slot, source))
    slot, source = slot[order], source[order]
    counts = np.bincount(source, minlength=len(targets))
    block = np.arange(len(slot)) - np.repeat(np.cumsum(counts) - counts, counts)
    table = spark.createDataFrame(pd.DataFrame({"slot": slot, "_source": source.astype(np.int32), "block": block}), "slot long, _source int, block long")
    return table, dict(enumerate(counts.tolist()))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), epochs: int = 3, n_slots: int = 1 << 16, source_col: str = "source") -> DataFrame:
    """(slot, doc_id, size, source, epoch, source_size, target) of each document copy that the mix takes, in slot order.

    A source's target is cut into as many equal blocks as the schedule has slots for it, of about
    total / n_slots words or less. Each source's documents are shuffled by a hash and laid end to end, once
    for each epoch; a copy belongs to the block in which its middle lies, and it is taken if that is one
    of the source's blocks. So taken words come to the target within a document, however small it is. Source statistics cover every row; sources are few
    (one row each on the driver). Null text: size 0, taken where it falls. Null source: a source of
    its own. An empty table gives an empty mix. The schedule is the same in each run.
    """
    copies = mix_copies(docs, weights, epochs, n_slots, source_col)
    return copies.filter("slot IS NOT NULL").select("slot", "doc_id", "size", "source", "epoch", "source_size", "target")


def mix_copies(docs: DataFrame, weights: tuple[float, ...], epochs: int, n_slots: int, source_col: str) -> DataFrame:
    """Every copy of every document with the slot of its block, null where the mix does not take it."""
    placed, slots = plan_mix(docs, weights, epochs, n_slots, source_col)
    if placed is None:
        return docs.sparkSession.createDataFrame([], "slot long, _row long, doc_id long, size long, start long, source string, epoch int, source_size long, target double")
    copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn(
        "block", F.floor((F.col("start") + F.col("size") / 2 + F.col("epoch") * F.col("source_size")) / F.col("_block")).cast("long")
    )
    return copies.join(F.broadcast(slots), ["_source", "block"], "left")  # n_slots rows, a parameter, and a few a source


def plan_mix(docs: DataFrame, weights, epochs: int, n_slots: int, source_col: str):
    """Documents with their word start within their source and the length of its blocks; the schedule. Both None for an empty table."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", F.col(source_col).alias("source"), word_count().alias("size"))
    sized = settle(sized)  # words are counted once
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    if not per:
        return None, None
    info = fill_targets([(r["source"], r["size"]) for r in per], weights, epochs)
    slots, counts = schedule(spark, [(k, t) for k, _, t in info], n_slots)
    at, bases = 0, []
    for i, (k, size, target) in enumerate(info):
        bases.append((k, i, size, target, at, max(target / max(1, counts.get(i, 0)), 1e-9)))
        at += size
    facts = F.broadcast(spark.createDataFrame(bases, "_k string, _source int, source_size long, target double, _base long, _block double"))
    known = sized.join(facts, F.col("source").eqNullSafe(F.col("_k"))).drop("_k").withColumn("_shuffle", F.coalesce(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), F.lit("")))
    placed = prefix_sums(known, ["_source", "_shuffle", "doc_id", "size"], {"_at": F.col("size"), "_row": F.lit(1)}, sum(r["n"] for r in per))
    return placed.withColumn("start", F.col("_at") - F.col("_base")), slots


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs, rows that are alike in all columns included."""
    copies = mix_copies(docs, (5, 2, 1), 3, 1 << 16, "source")
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("size"))), F.lit(0)).cast("long")
    facts = ["doc_id", "size", "source_size", "target"]
    return copies.groupBy("_row").agg(*[F.first(c).alias(c) for c in facts], taken.alias("taken")).drop("_row")


#: DuckDB SQL for op9_mixing. What a source's blocks cover is the stretch from 0 to its target; a copy is taken if its middle lies there.
OP9_SQL = r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS weight FROM sized GROUP BY source),
fill AS (
  SELECT 0 AS round, source, source_size, weight, CAST(NULL AS DOUBLE) AS target, CAST(sum(source_size) OVER () AS DOUBLE) AS left_, false AS done FROM per
  UNION ALL
  SELECT round + 1, source, source_size, weight, CASE WHEN target IS NOT NULL THEN target WHEN any_over THEN CASE WHEN is_over THEN 3.0 * source_size END ELSE weight * share END,
         left_ - coalesce(sum(CASE WHEN any_over AND is_over THEN 3.0 * source_size END) OVER (), 0), NOT any_over
  FROM (SELECT *, coalesce(bool_or(is_over) OVER (), false) AS any_over FROM (
    SELECT *, target IS NULL AND weight * share > 3.0 * source_size AS is_over FROM (
      SELECT *, left_ / sum(CASE WHEN target IS NULL THEN weight END) OVER () AS share FROM fill WHERE NOT done)))
  WHERE share IS NOT NULL),
targets AS (SELECT source, source_size, arg_max(target, round) AS target FROM fill GROUP BY source, source_size),
placed AS (
  SELECT doc_id, size, source_size, target,
         CAST(sum(size) OVER (PARTITION BY t.source ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * len(list_filter([0, 1, 2], lambda e: start + size / 2 + e * source_size < target)) AS BIGINT) AS taken
FROM placed
"""

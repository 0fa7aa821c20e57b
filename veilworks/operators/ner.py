"""Entities from a model: chunks, predictions, thresholds and filters, with any model that offers predict_entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilworks.functions import patterns as P
from veilworks.operators import spans
from veilworks.operators.chunks import pack

LABELS = list(P.NER_LABELS)


def label_prompt(labels: list[str], entity: str = "<<ENT>>", separator: str = "<<SEP>>") -> list[str]:
    """The tokens before a text: each label once, in order, after the entity token; the separator last."""
    return [*(x for label in dict.fromkeys(labels) for x in (entity, label)), separator]


@lru_cache(maxsize=4)
def loaded(load: Callable):
    """The model of this worker; a load that fails is not tried again in it."""
    try:
        return load()
    except (OSError, ImportError, RuntimeError):
        return None


MAX_CHARS = 200_000


def limited(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """What a model reads of a text: its first max_chars characters; 0 for all."""
    return F.left(text, F.lit(max_chars)) if max_chars else text


def predictions(docs: DataFrame, load: Callable, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, chunk_no, text, label, score) of load().predict_entities over the chunks of each text.

    load runs once a worker; without a model there are no rows. max_chars limits what the model reads of
    a text, as the engine's setting says; 0 reads all. Null and empty texts give no rows."""
    least = min(P.NER_THRESHOLDS.values())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(load)
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                for n, (chunk, _) in enumerate(pack(text or "") if model else ()):
                    rows += [(doc, n, p["text"], p["label"], float(p["score"])) for p in model.predict_entities(chunk, LABELS, threshold=least, flat_ner=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "text", "label", "score"])

    return docs.select("doc_id", limited(F.col("text"), max_chars).alias("text")).mapInPandas(run, "doc_id long, chunk_no int, text string, label string, score double")


def entities(docs: DataFrame, load: Callable, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, entity_type, text, confidence, count, ord) as the other detectors give them; stretches that
    chunks share count in each."""
    kept = spans.by_label_threshold(predictions(docs, load, max_chars)).withColumn("text", spans.accept(F.col("text"), F.col("entity_type"))).filter("text IS NOT NULL")
    return kept.groupBy("doc_id", "entity_type", "text").agg(F.max("score").alias("confidence"), F.count(F.lit(1)).alias("count"), F.lit(13).alias("ord"))

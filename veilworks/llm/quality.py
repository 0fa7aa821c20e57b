"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.llm.engine import table
from veilworks.llm.learning import labelled_sample, remainder
from veilworks.llm.textbytes import LOWER, flat, mix, slices, span_hashes, spans

#: Letters, digits and all bytes of other alphabets; what is left are punctuation bytes.
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
PUNCTUATION = ~LETTER
PUNCTUATION[[0x20, *range(0x09, 0x0E)]] = False


@dataclass
class FtrlModel:
    """Weights by bucket; a text's score is the logistic of bias + scale * mean weight of its n-grams."""

    weights: np.ndarray
    bias: float
    scale: float


def ngrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each text, text after text, and n + 1 offsets.

    Words are runs of letters and runs of punctuation, A-Z lower-cased. N-grams are words, word pairs, and
    pairs and triples that return to their first word; the latter share one bucket whatever the word,
    as do words by being all capitals.
    """
    n = len(offsets) - 1
    lower = LOWER[data]
    s1, e1, _ = spans(data, offsets, LETTER)
    s2, e2, _ = spans(data, offsets, PUNCTUATION)
    starts = np.concatenate([s1, s2])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([e1, e2])[order]
    h = span_hashes(lower, starts, ends)
    of = np.searchsorted(offsets, starts, side="right") - 1
    parts = [(of, h)]
    for gap in (1, 2):
        if len(h) <= gap:
            continue
        same_text = of[gap:] == of[:-gap]
        back = same_text & (h[gap:] == h[:-gap])
        if gap == 1:
            pair = np.where(back, np.uint64(1), mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(5)))
            parts.append((of[1:][same_text], pair[same_text]))
        else:
            parts.append((of[gap:][same_text], np.where(back, np.uint64(2), np.uint64(3))[same_text]))
    if len(starts):
        capital = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 65) & (data <= 90), out=capital[1:])
        loud = (capital[ends] - capital[starts]) * 2 > ends - starts
        parts.append((of, np.where(loud, np.uint64(4), np.uint64(5))))
    text = np.concatenate([p[0] for p in parts])
    bucket = (mix(np.concatenate([p[1] for p in parts])) >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(text, kind="stable")
    return bucket[order], np.searchsorted(text[order], np.arange(n + 1))


def train_ftrl(rows: list[tuple[np.ndarray, int]], bits: int = 18, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.001, epochs: int = 3, scale: float = 20.0, seed: int = 5) -> FtrlModel:
    """FTRL-proximal, one update a text. rows: (buckets of the text's n-grams, label)."""
    size = 1 << bits
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    prepared = []
    for buckets, label in rows:
        ids, counts = np.unique(buckets, return_counts=True)
        prepared.append((np.append(ids, size), np.append(counts * (scale / max(1, len(buckets))), 1.0), label))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(prepared)):
            ids, x, label = prepared[i]
            zi, ni = z[ids], n[ids]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[ids] += g - sigma * wi
            n[ids] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return FtrlModel(w[:size].astype(np.float32), float(w[size]), scale)


def collect_rows(sample: DataFrame, bits: int) -> list[tuple[np.ndarray, int]]:
    """The sample's n-grams on the driver: texts are reduced to buckets where they lie."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 19):
            got, at = ngrams(*flat(b.column("text")), bits)
            packed = [got[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed, pa.binary()), b.column("label").cast(pa.int32())], ["doc_id", "grams", "label"])

    got = sample.select("doc_id", "text", "label").mapInArrow(reduce, "doc_id long, grams binary, label int").collect()
    return [(np.frombuffer(r["grams"], np.int32), r["label"]) for r in sorted(got, key=lambda r: (r["doc_id"], bytes(r["grams"])))]


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = 1500, bits: int = 18, modulus: int = 3, held_out: int = 1) -> FtrlModel:
    """A model from at most `bound` labelled rows of each class; held-out rows never enter."""
    rows = collect_rows(labelled_sample(docs, labels, "quality", modulus, held_out, bound), bits)
    if not rows:
        return FtrlModel(np.zeros(1 << bits, np.float32), 0.0, 20.0)
    return train_ftrl(rows, bits)


def score_texts(model: FtrlModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    buckets, at = ngrams(data, offsets, int(np.log2(len(model.weights))))
    sums = np.concatenate([[0.0], np.cumsum(model.weights[buckets], dtype=np.float64)])
    mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, np.diff(at))
    return 1 / (1 + np.exp(-np.clip(model.bias + model.scale * mean, -35, 35)))


def score_quality(docs: DataFrame, model: FtrlModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs, from its whole text alone.

    A null or empty text has no n-grams and gets the score of the bias. Without labelled rows every
    score is 0.5. Rows with equal texts score alike; other columns are ignored; an empty table gives
    an empty result. The model is of fixed size (2**bits weights) and travels with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 19):
            s = score_texts(shared.value, *flat(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: FtrlModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least `threshold`; scored and decided where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 19):
            yield b.filter(pa.array(score_texts(shared.value, *flat(b.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")

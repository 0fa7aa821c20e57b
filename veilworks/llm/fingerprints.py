"""Document fingerprints from content-defined chunks, and how much of a document they find in another."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.llm.engine import prefix_sums, table
from veilworks.llm.textbytes import flat, mix, slices, span_hashes

#: One random 32-bit value for each byte value, from a rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + GEAR[byte] at each byte; 32 bits, so bit k depends on the last k + 1 bytes."""
    h = GEAR[data]
    span = 1
    while span < 32:
        h[span:] += h[:-span].copy() << np.uint32(span)
        span *= 2
    return h


@dataclass(frozen=True)
class Scale:
    """Chunk lengths: `normal` is a power of two; a boundary looks at the hash's bits below `reach`, so at that many bytes."""

    least: int
    normal: int
    most: int
    reach: int

    def masks(self) -> tuple[np.uint32, np.uint32]:
        """Normalised: up to `normal` bytes a boundary needs two bits more than the mean asks for, beyond it two bits fewer."""
        bits = self.normal.bit_length() - 1
        top = lambda n: np.uint32(((1 << n) - 1) << (self.reach - n))
        return top(bits + 2), top(bits - 2)


#: A text's first bytes are cut finely, so that short texts have several chunks too.
FINE, COARSE, FINE_BYTES = Scale(8, 16, 64, 16), Scale(24, 64, 256, 32), 128


def _candidates(h: np.ndarray, mask: np.uint32) -> list[int]:
    return [*np.flatnonzero((h & mask) == 0).tolist(), 1 << 62]


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends of each text and n + 1 chunk offsets.

    A chunk that starts within the text's first FINE_BYTES bytes has the fine scale, others the coarse
    one. A text's chunks depend on its bytes alone: no boundary looks at bytes before its first."""
    h = np.empty(len(data), np.uint32)
    for i in range(0, len(data), 1 << 20):  # in pieces that overlap by the hash's reach
        j = max(0, i - 31)
        h[i : i + (1 << 20)] = gear_hash(data[j : i + (1 << 20)])[i - j :]
    heads = np.zeros(len(data), bool)  # the fine scale is only looked up where it can count
    for k in range(min(FINE_BYTES + FINE.most, int(np.diff(offsets).max(initial=0)))):
        at = offsets[:-1] + k
        heads[at[at < offsets[1:]]] = True
    fine = np.where(heads, h, np.uint32(0xFFFFFFFF)) if len(h) else h
    tables = [(s, _candidates(x, s.masks()[0]), _candidates(x, s.masks()[1])) for s, x in ((FINE, fine), (COARSE, h))]
    ends, counts = [], [0]
    places = [[0, 0], [0, 0]]
    bounds = offsets.tolist()
    for first, stop in zip(bounds, bounds[1:], strict=False):
        start = first
        while start < stop:
            which = start - first >= FINE_BYTES
            scale, hard_at, easy_at = tables[which]
            i, j = places[which]
            reach = first + scale.reach - 1
            low, mid, high = max(start + scale.least - 1, reach), start + scale.normal - 1, min(start + scale.most - 1, stop - 1)
            while hard_at[i] < low:
                i += 1
            if hard_at[i] < mid and hard_at[i] <= high:
                end = hard_at[i]
            else:
                low = max(mid, reach)
                while easy_at[j] < low:
                    j += 1
                end = easy_at[j] if easy_at[j] <= high else high
            places[which] = [i, j]
            start = end + 1
            ends.append(start)
        counts.append(len(ends))
    return np.array(ends, np.int64), np.array(counts, np.int64)


def chunk_sets(data: np.ndarray, offsets: np.ndarray) -> list[dict[int, int]]:
    """For each text its distinct chunk digests of 64 bits and their total lengths in bytes."""
    ends, at = cut_points(data, offsets)
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    first = at[:-1][np.diff(at) > 0]
    starts[first] = offsets[:-1][np.diff(at) > 0]
    digests = span_hashes(data, starts, ends).tolist() if len(ends) else []
    lengths = (ends - starts).tolist()
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        got: dict[int, int] = {}
        for d, n in zip(digests[a:b], lengths[a:b], strict=True):
            got[d] = got.get(d, 0) + n
        out.append(got)
    return out


def write(chunks: dict[int, int]) -> str:
    """The fingerprint as text: "digest:bytes" of each distinct chunk, ascending."""
    return ",".join([f"{d:x}:{n}" for d, n in sorted(chunks.items())])


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's bytes that lie in chunks of b too; 1 for two empty ones."""
    total = sum(a.values())
    if not total:
        return 0.0 if b else 1.0
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / total


def parse(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(n) for d, n in (x.split(":") for x in fingerprint.split(",") if x)}


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_bytes) for each row, over whole texts; null counts as empty and gives ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offsets = flat(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([write(c) for c in chunk_sets(data, offsets)], pa.string()), pa.array(np.diff(offsets))], ["doc_id", "fingerprint", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string, n_bytes long")


def segment_bounds(keys: DataFrame, segment_bytes: int, most: int) -> list[tuple[int, int]]:
    """The least (doc_id, key) of each segment of about equal bytes, from rows (doc_id, key, size).

    Global prefix sums of the sizes give each row its segment; of each segment one row comes here, of
    all at most `most`, as segments grow with the input."""
    facts = keys.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    each = max(segment_bytes, -(-(facts["bytes"] or 0) // most))
    if (facts["bytes"] or 0) <= each:
        return []
    placed = prefix_sums(keys, ["doc_id", "key"], {"before": F.col("size")}, facts["n"])
    firsts = placed.groupBy(F.floor(F.col("before") / each).alias("segment")).agg(F.min(F.struct("doc_id", "key")).alias("least")).select("least.*").collect()
    return sorted({(r["doc_id"], r["key"]) for r in firsts})


def place(ids: np.ndarray, keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (id, key) its segment, the last whose bound is not above it, and whether it is that bound."""
    if not len(bounds):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    left = np.searchsorted(bounds[:, 0], ids, side="left")
    right = np.searchsorted(bounds[:, 0], ids, side="right")
    segment = right - 1
    for i in np.flatnonzero(right > left):  # ids at which a segment starts: their keys decide
        segment[i] = left[i] + np.searchsorted(bounds[left[i] : right[i], 1], keys[i], side="right") - 1
    segment = np.maximum(segment, 0)
    return segment, (bounds[segment, 0] == ids) & (bounds[segment, 1] == keys)


def compare_with_edits(docs: DataFrame, segment_bytes: int = 6 << 20, most_segments: int = 1 << 16) -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text replaces the last floor(n_chars / 4) code points by the first as many (or all) of
    the next document in id order; after the last comes the first. near_*: the share of the document's
    bytes in chunks that the other has too. A null text is empty; a lone document is its own next;
    rows of equal id follow each other in order of a hash of their text; a null id comes first and
    stays null. Extra columns are ignored; an empty table gives an empty result.

    One shuffle of the texts, into segments of consecutive ids of about equal bytes. The first row of a
    segment also goes, as head, to the one before it (of the first: to the last), so that each row finds
    its successor where it is. A segment is read in order and only two of its rows are held at a time,
    so its size bounds no memory: beyond `most_segments` segments of `segment_bytes` they grow instead.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    bounds = segment_bounds(base.select("doc_id", "key", F.octet_length("text").alias("size")), segment_bytes, most_segments)
    shared = spark.sparkContext.broadcast(np.array(bounds, np.int64).reshape(-1, 2))
    n = max(1, len(bounds))

    def spots(ids: pd.Series, keys: pd.Series) -> pd.Series:
        segment, is_bound = place(ids.to_numpy(), keys.to_numpy(), shared.value)
        if not len(shared.value):  # one segment: its first row follows its last, so every row may be the head
            return pd.Series([[0]] * len(ids))
        return pd.Series([[s, (s - 1) % n] if b else [s] for s, b in zip(segment.tolist(), is_bound.tolist(), strict=True)])

    at = F.posexplode(F.pandas_udf(spots, "array<long>")("doc_id", "key")).alias("head", "segment")
    dealt = base.select("doc_id", "key", "text", at).repartition(n, "segment").sortWithinPartitions("segment", "head", "doc_id", "key")
    out = dealt.select("segment", "head", "doc_id", "text").mapInArrow(_follow, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (segment, head, doc_id, text) in order -> each document with its edited text and both fingerprints.

    The first head after a segment's own rows follows its last; without one, as of a lone segment, the segment's first does."""
    last = None  # (segment, doc_id, text, chunks) of the document whose successor is still to come
    first = None  # (text, chunks) of the segment's first document

    def rows(pairs: list[tuple]) -> pa.RecordBatch:
        texts, after = [p[1] for p in pairs], [p[3] for p in pairs]
        edited = [t[: len(t) - len(t) // 4] + a[: len(t) // 4] for t, a in zip(texts, after, strict=True)]
        edited_sets = _sets(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(edited, pa.string()),
                pa.array([write(p[2]) for p in pairs], pa.string()), pa.array([write(s) for s in edited_sets], pa.string()),
                pa.array([containment(p[2], s) for p, s in zip(pairs, edited_sets, strict=True)], pa.float64()), pa.array([containment(p[2], p[4]) for p in pairs], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for b in slices(batches, limit=1 << 20):
        segment, head, ids, texts = (b.column(c).to_pylist() for c in ("segment", "head", "doc_id", "text"))
        pairs = []
        for s, h, i, text, chunks in zip(segment, head, ids, texts, _sets(texts), strict=True):
            if last and last[0] == s:
                pairs.append((*last[1:], text, chunks))
                last = None if h else (s, i, text, chunks)
            elif not h:
                if last:
                    pairs.append((*last[1:], *first))
                last, first = (s, i, text, chunks), (text, chunks)
        if pairs:
            yield rows(pairs)
    if last:
        yield rows([(*last[1:], *first)])


def _sets(texts: list[str], limit: int = 1 << 20) -> list[dict[int, int]]:
    out, part, size = [], [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            out += chunk_sets(*flat(pa.array(part, pa.large_string())))
            part, size = [], 0
    return out + (chunk_sets(*flat(pa.array(part, pa.large_string()))) if part else [])


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = compare_with_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")

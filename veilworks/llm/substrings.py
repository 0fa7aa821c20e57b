"""Exact substring deduplication by fixed-block anchors.

Each document, as reference, is cut into non-overlapping blocks of b words; as query, it is read in
every rolling window of b words. A repeat of w >= 2b - 1 words holds a whole block of the earlier
document, so each repeat shows as a hit: a rolling window that meets a block. A hit is extended word
by word to both sides: every window of w words that holds it is looked up by a 128-bit digest, and
the smallest document in which it starts is found. Windows that start in a smaller document join into
maximal repeats, and these are removed. Nothing else is looked at: without hits nothing goes.

Documents are dealt into chunks by a hash. What a chunk sends is made distinct first, so a passage
that a third of all documents share is sent once a chunk, never once a document, and no pairs of
documents are formed at any point. The texts are shuffled once; Spark reuses that exchange in all
three passes over them. A chunk sends one cell to each bucket that it has values for; chunks and
buckets grow with the square root of the input, so that the number of cells grows in proportion to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.llm.engine import parts_for, table, text_bytes
from veilworks.llm.textbytes import BYTE_VALUES, flat, owners, rolling, span_hashes, spans, window_starts

#: Bits of an anchor's hash within its bucket, and bytes of a packed anchor with its two flags.
_ANCHOR_BITS, _ANCHOR_BYTES = 38, 5
_NULL_ID = (1 << 63) - 1
#: Bytes of text for which a chunk sends one cell to one bucket, once chunks and buckets outgrow their least sizes.
_TEXT_PER_CELL = 640


def _words(t: pa.Table):
    """The texts on end, their offsets, two independent hashes of each word, and the word offsets."""
    data, offsets = flat(t.column("text"))
    starts, ends, at = spans(data, offsets)
    return data, offsets, span_hashes(data, starts, ends), span_hashes(data, starts, ends, BYTE_VALUES[1]), at


def _known(hits: pa.Table) -> np.ndarray:
    """The anchors of a chunk's hits, ascending."""
    rows = [(k, b) for k, b in zip(hits.column("bucket").to_pylist(), hits.column("hits").to_pylist(), strict=True) if b is not None]
    return np.sort(np.concatenate([_unpack(b) | np.uint64(k << _ANCHOR_BITS) for k, b in rows])) if rows else np.zeros(0, np.uint64)


def _pack(values: np.ndarray) -> bytes:
    """Five bytes a value, like bytes together, so that sorted values compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_ANCHOR_BYTES].T).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(_ANCHOR_BYTES, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :_ANCHOR_BYTES] = planes.T
    return out.view("<u8").ravel()


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _cells(values: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted values by their bits from `shift` on."""
    bucket = values >> np.uint64(shift)
    at = _runs(bucket)
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(values)], strict=True))


def _ids(t: pa.Table) -> np.ndarray:
    return t.column("doc_id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) if t.num_rows else np.zeros(0, np.int64)


def _sort_digests(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that groups equal (k1, k2), and where each group starts in it."""
    order = np.argsort(k1, kind="stable")
    same = k1[order][1:] == k1[order][:-1]
    if (same & (k2[order][1:] != k2[order][:-1])).any():  # two digests agree in their first half only
        order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return order, np.flatnonzero(new)


def anchors_of(window: int, block: int, buckets_log2: int):
    """chunk -> cells of distinct anchors: hash within the bucket, flag 1 = is a reference block, flag 2 = in several documents."""
    total = buckets_log2 + _ANCHOR_BITS

    def run(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk")[0].as_py()
        data, offsets = flat(t.column("text"))
        starts, ends, at = spans(data, offsets)
        h = span_hashes(data, starts, ends)
        valid = window_starts(at, block)
        of = owners(at)[valid]
        ref = ((valid - at[of]) % block) == 0
        key = rolling(h, block)[valid] >> np.uint64(64 - total) if len(valid) else np.zeros(0, np.uint64)
        # one sort brings equal anchors together; the low bits carry what the runs need
        order = np.argsort(key, kind="stable")
        key, of, ref = key[order], of[order], ref[order]
        first = _runs(key)
        if not len(first):
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int32()), "anchors": pa.array([], pa.binary())})
        any_ref = np.logical_or.reduceat(ref, first)
        several = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
        key = key[first]
        flagged = ((key & np.uint64((1 << _ANCHOR_BITS) - 1)) << np.uint64(2)) | any_ref.astype(np.uint64) | (several.astype(np.uint64) << np.uint64(1))
        cells = _cells(key, _ANCHOR_BITS)
        return pa.table(
            {
                "bucket": pa.array([c[0] for c in cells], pa.int64()),
                "chunk": pa.array([chunk] * len(cells), pa.int32()),
                "anchors": pa.array([_pack(flagged[a:b]) for _, a, b in cells], pa.binary()),
            }
        )

    return run


def match_anchors(t: pa.Table) -> pa.Table:
    """bucket -> for each chunk its anchors that are a reference block somewhere and occur in more than one document."""
    bucket = t.column("bucket")[0].as_py()
    chunks, blobs = t.column("chunk").to_pylist(), t.column("anchors").to_pylist()
    parts = [_unpack(b) for b in blobs]
    every = np.sort(np.concatenate(parts))
    at = _runs(every >> np.uint64(2))
    flags = np.bitwise_or.reduceat(every & np.uint64(3), at)
    count = np.diff(np.append(at, len(every)))
    hit = (every[at] >> np.uint64(2))[((flags & np.uint64(1)) > 0) & ((count > 1) | (flags == 3))]
    out = []
    for chunk, part in zip(chunks, parts, strict=True):
        own = part >> np.uint64(2)
        i = np.minimum(np.searchsorted(hit, own), max(0, len(hit) - 1))
        own = own[hit[i] == own] if len(hit) else own[:0]
        if len(own):
            out.append((chunk, _pack(own)))
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int64()), "hits": pa.array([x[1] for x in out], pa.binary())})


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    i = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[i] == values


def windows_of(window: int, block: int, buckets_log2: int):
    """Texts and hits of a chunk -> cells of distinct window digests about the hits, each with its smallest document."""
    total = buckets_log2 + _ANCHOR_BITS

    def run(t: pa.Table, hits: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int32()), "k1": pa.array([], pa.binary()), "k2": pa.array([], pa.binary()), "docs": pa.array([], pa.binary())})
        if not t.num_rows or not hits.num_rows:
            return empty
        chunk = t.column("chunk")[0].as_py()
        _, _, h, g, at = _words(t)
        k1, k2, of, _ = extended(h, g, at, _known(hits), window, block, total)
        if not len(k1):
            return empty
        doc = _ids(t)[of]
        order, first = _sort_digests(k1, k2)
        least = np.minimum.reduceat(doc[order], first)
        k1, k2 = k1[order][first], k2[order][first]
        cells = _cells(k1, 64 - buckets_log2) if buckets_log2 else [(0, 0, len(k1))]
        return pa.table(
            {
                "bucket": pa.array([c[0] for c in cells], pa.int64()),
                "chunk": pa.array([chunk] * len(cells), pa.int32()),
                "k1": pa.array([k1[a:b].tobytes() for _, a, b in cells], pa.binary()),
                "k2": pa.array([k2[a:b].tobytes() for _, a, b in cells], pa.binary()),
                "docs": pa.array([least[a:b].tobytes() for _, a, b in cells], pa.binary()),
            }
        )

    return run


def extended(h: np.ndarray, g: np.ndarray, at: np.ndarray, known: np.ndarray, window: int, block: int, total: int):
    """Digests, owners and positions of the windows that hold a hit: all ways to extend it to `window` words within its text.

    h and g are two independent hashes of the words, so that a digest rests on 128 bits of each."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(h) < window or not len(known):
        return none
    hit = _member(rolling(h, block) >> np.uint64(64 - total), known)
    sums = np.concatenate([[0], np.cumsum(hit)])
    s = window_starts(at, window)
    s = s[sums[s + window - block + 1] > sums[s]]
    if not len(s):
        return none
    return rolling(h, window)[s], rolling(g, window, 1)[s], owners(at)[s], s


def match_windows(t: pa.Table) -> pa.Table:
    """bucket -> for each chunk the windows that start in a smaller document of another chunk."""
    chunks = t.column("chunk").to_pylist()
    parts = [[np.frombuffer(x, np.uint64) for x in t.column(k).to_pylist()] for k in ("k1", "k2")]
    docs = [np.frombuffer(x, np.int64) for x in t.column("docs").to_pylist()]
    k1, k2, doc = np.concatenate(parts[0]), np.concatenate(parts[1]), np.concatenate(docs)
    source = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    order, first = _sort_digests(k1, k2)
    least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
    gone = order[least < doc[order]]
    by = np.argsort(source[gone], kind="stable")
    gone, of = gone[by], source[gone][by]
    at = [*_runs(of).tolist(), len(of)]
    out = [(chunks[of[a]], k1[gone[a:b]].tobytes(), k2[gone[a:b]].tobytes()) for a, b in zip(at, at[1:], strict=False)]
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int32()), "k1": pa.array([x[1] for x in out], pa.binary()), "k2": pa.array([x[2] for x in out], pa.binary())})


def repeated(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, gone1: np.ndarray, gone2: np.ndarray) -> np.ndarray:
    """Whether each extended window starts in a smaller document: of this chunk, or of another one (gone*)."""
    order, first = _sort_digests(k1, k2)
    least = np.empty(len(k1), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order)))) if len(first) else 0
    out = least < doc
    if len(gone1):
        i = np.argsort(gone1, kind="stable")
        gone1, gone2 = gone1[i], gone2[i]
        maybe = np.flatnonzero(_member(k1, gone1) & ~out)
        left, right = np.searchsorted(gone1, k1[maybe]), np.searchsorted(gone1, k1[maybe], side="right")
        out[maybe] = gone2[left] == k2[maybe]
        for m in np.flatnonzero((right - left > 1) & ~out[maybe]):
            out[maybe[m]] = (gone2[left[m] : right[m]] == k2[maybe[m]]).any()
    return out


def finish(window: int, block: int, buckets_log2: int):
    """Texts of a chunk, its hits and its windows that start in smaller documents of other chunks ->
    one row a document with its maximal repeats, which are removed, and what is kept."""
    total = buckets_log2 + _ANCHOR_BITS

    def run(t: pa.Table, marks: pa.Table) -> pa.Table:
        data, offsets, h, g, at = _words(t)
        gone1, gone2 = (np.frombuffer(b"".join(x for x in marks.column(k).to_pylist() if x), np.uint64) for k in ("k1", "k2"))
        ids = _ids(t)
        k1, k2, of, s = extended(h, g, at, _known(marks), window, block, total)
        starts = s[repeated(k1, k2, ids[of], gone1, gone2)]
        mark = np.zeros(len(h) + 1, np.int64)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + window, -1)  # a window ends within its document
        covered = np.cumsum(mark[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(covered)])
        removed = sums[at[1:]] - sums[at[:-1]]
        raw, kept, cut = data.tobytes(), [], []
        for i, n in enumerate(removed.tolist()):
            words = raw[offsets[i] : offsets[i + 1]].split()
            if n:
                gone_here = covered[at[i] : at[i + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone_here.astype(np.int8), [0]]))).reshape(-1, 2)
                cut.append([{"start": int(a), "end": int(b)} for a, b in edge])
                words = [w for w, g in zip(words, gone_here.tolist(), strict=True) if not g]
            else:
                cut.append([])
            kept.append(b" ".join(words))
        return pa.table(
            {
                "doc_id": pa.array(ids),
                "n_words": pa.array(np.diff(at)),
                "n_removed": pa.array(removed),
                "removed": pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return run


def remove_repeats(docs: DataFrame, window: int = 50, chunk_bytes: int = 8 << 20, bucket_bytes: int = 24 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, removed spans of words, kept_text) of each row of docs.

    A word goes if a window of `window` consecutive words that covers it also starts in a document of
    smaller id; all windows are judged on the input. Words are runs of bytes other than 0x20 and 0x09
    to 0x0D, compared as they are. A null or empty text has no words and keeps ''. Rows of one id are
    one document to each other: none removes the other. A null id counts as the largest. Extra columns
    are ignored; an empty table gives an empty result. A chunk is worked on in memory, at about 25 bytes
    for each byte of text: at 100 TB chunks are of 250 MB; on large executors give larger chunk_bytes.
    """
    block = (window + 1) // 2
    size = text_bytes(docs)
    even = math.isqrt(size * _TEXT_PER_CELL)
    n_chunks = parts_for(size, max(chunk_bytes, even))
    log2 = max(0, (parts_for(size, max(bucket_bytes, even)) - 1).bit_length())
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rows of one id are dealt by their text too, so that no id fills a chunk
    base = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int")).repartition(n_chunks, "chunk")
    cells = base.groupBy("chunk").applyInArrow(anchors_of(window, block, log2), "bucket long, chunk int, anchors binary")
    hits = cells.groupBy("bucket").applyInArrow(match_anchors, "chunk int, bucket long, hits binary").repartition(n_chunks, "chunk")
    digests = base.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(windows_of(window, block, log2), "bucket long, chunk int, k1 binary, k2 binary, docs binary")
    gone = digests.groupBy("bucket").applyInArrow(match_windows, "chunk int, k1 binary, k2 binary")
    marks = hits.unionByName(gone, allowMissingColumns=True).repartition(n_chunks, "chunk")
    out = base.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(finish(window, block, log2), "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(_NULL_ID), F.col("doc_id")))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for op1_substring_dedup.
OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50),
win AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS k FROM starts),
least AS (SELECT k, min(doc_id) AS first_doc FROM win GROUP BY k),
bad AS (SELECT win.doc_id, s FROM win JOIN least USING (k) WHERE first_doc < win.doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 50)))) AS g FROM bad GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(g), 0) AS n_removed,
         CASE WHEN g IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(g, i)) END AS kept
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM kept
"""

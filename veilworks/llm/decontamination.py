"""Benchmark decontamination: each passage of the corpus queries a BM25 index of the test items.

The index holds impacts divided by the item's own score, so one threshold serves all items. Passages
are pruned as in block-max WAND, a batch of passages at a time: first by the terms' greatest impacts
anywhere, then by their greatest impacts within each block of items; what is left is scored in full.
Each bound is at least the score, so every item above the threshold is retrieved. A retrieved item
counts as leaked if enough of its question and of its answer stands about the passage.

Items are grouped by length, an index for each group, and passages are as long as the group's items
ask for: a whole copy of an item of any length lies in one passage and has its full score there.
Terms that many items hold are bounded together, by what they give at most to any item. Items that
such terms alone bring near the threshold would make that bound useless; they have an index of their
own, in which every term is bounded by its postings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.llm.engine import parts_for, settle, table
from veilworks.llm.quality import LETTER
from veilworks.llm.textbytes import flat, owners, slices, span_hashes, spans
from veilworks.llm.toxicity import fold

SCHEMA = "doc_id long, item_id long, score double, start_word int, end_word int, question_overlap double, answer_overlap double"


@dataclass
class ItemIndex:
    """Postings of test items by term; terms ascend by hash. common: terms in many items, bounded together."""

    terms: np.ndarray
    maybe: np.ndarray
    top: np.ndarray
    common: np.ndarray
    common_bound: float
    common_block: np.ndarray
    at: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_top: np.ndarray
    n_blocks: int
    block_size: int
    ids: list[int]
    questions: list[list[int]]
    answers: list[list[int]]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentence; of one sentence, its last third of words."""
    parts = re.findall(r"[^.!?\n]*[^\s.!?][^.!?\n]*[.!?\n]*", text.strip())
    words = lambda s: len(re.findall(r"\w+", s))
    k = len(parts) - 1
    while k > 0 and words("".join(parts[k:])) < 3:
        k -= 1
    if k > 0:
        return "".join(parts[:k]), "".join(parts[k:])
    all_words = text.split()
    cut = max(1, len(all_words) - max(1, len(all_words) // 3))
    return " ".join(all_words[:cut]), " ".join(all_words[cut:])


def term_hashes(text: str) -> np.ndarray:
    data, offsets = flat(pa.array([text], pa.large_string()))
    data = fold(data)
    return span_hashes(data, *spans(data, offsets, LETTER)[:2])


#: A term in this share of the items is common.
COMMON_SHARE = 0.1


def is_common(df: int, n: int) -> bool:
    return df >= COMMON_SHARE * n and n > 20


def weights(bag: Counter, stats: tuple[int, float, dict[int, int]], k1: float = 1.2, b: float = 0.75) -> dict[int, float]:
    """BM25 impacts of an item's terms, as shares of the item's own score."""
    n, mean, df = stats
    length = sum(bag.values())
    w = {t: float(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5))) * f * (k1 + 1) / (f + k1 * (1 - b + b * length / max(mean, 1e-9))) for t, f in bag.items()}
    own = sum(w.values()) or 1.0
    return {t: x / own for t, x in w.items()}


def build_index(items: list[tuple[int, str]], stats: tuple[int, float, dict[int, int]] | None = None, block_size: int = 8, together: bool = False) -> ItemIndex:
    """stats: number of items, mean length and document frequencies, where these items are a part of all.

    together: bound the common terms together, which asks for a threshold above common_bound; else each by its postings."""
    split = [split_item(t or "") for _, t in items]
    q, a = [term_hashes(x[0]).tolist() for x in split], [term_hashes(x[1]).tolist() for x in split]
    bags = [Counter(x + y) for x, y in zip(q, a, strict=True)]
    if stats is None:
        stats = (len(bags), sum(sum(x.values()) for x in bags) / max(1, len(bags)), dict(Counter(t for x in bags for t in x)))
    n, _, df = stats
    terms = np.array(sorted({t for x in bags for t in x}), np.uint64)
    where = {t: i for i, t in enumerate(terms.tolist())}
    postings: list[list[tuple[int, float]]] = [[] for _ in terms]
    for i, bag in enumerate(bags):
        for t, x in weights(bag, stats).items():
            postings[where[t]].append((i, x))
    n_blocks = max(1, -(-len(items) // block_size))
    common = np.array([together and is_common(df[t], n) for t in terms.tolist()], bool)
    per_item = np.zeros(max(1, len(items)))
    for t in np.flatnonzero(common):
        for i, x in postings[t]:
            per_item[i] += x
    common_block = np.zeros(n_blocks)
    np.maximum.at(common_block, np.arange(len(per_item)) // block_size, per_item)
    block_at, blocks, tops = [0], [], []
    for p in postings:
        best: dict[int, float] = {}
        for i, x in p:
            best[i // block_size] = max(best.get(i // block_size, 0.0), x)
        blocks += list(best)
        tops += list(best.values())
        block_at.append(len(blocks))
    maybe = np.zeros(1 << 20, bool)
    maybe[(terms >> np.uint64(44)).astype(np.int64)] = True
    flat_postings = [x for p in postings for x in p]
    return ItemIndex(
        terms, maybe, np.array([max(x for _, x in p) for p in postings]), common, float(per_item.max()), common_block,
        np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype(np.int64), np.array([x[0] for x in flat_postings], np.int64), np.array([x[1] for x in flat_postings]),
        np.array(block_at), np.array(blocks, np.int64), np.array(tops), n_blocks, block_size, [i for i, _ in items], q, a,
    )


def _expand(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For list keys: which key each entry belongs to, and the entries' places."""
    n = at[keys + 1] - at[keys]
    of = np.repeat(np.arange(len(keys)), n)
    return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[keys], n)


def overlap(part: list[int], near: list[int], gram: int = 3) -> float:
    """The share of the part's n-grams that stand in the stretch; of fewer words, of the sequence itself."""
    n = min(gram, len(part))
    if not n:
        return 1.0
    have = {tuple(near[i : i + n]) for i in range(len(near) - n + 1)}
    mine = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    return sum(g in have for g in mine) / len(mine)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and n + 1 word offsets."""
    data = fold(data)
    starts, ends, at = spans(data, offsets, LETTER)
    return span_hashes(data, starts, ends), at


def search(index: ItemIndex, data: np.ndarray, offsets: np.ndarray, threshold: float, half: int) -> Iterator[tuple[int, int, float, int, int, list[int]]]:
    """(text, item, score, first and last word of the passage, the words about it) of every hit."""
    return search_words(index, *hashed_words(data, offsets), threshold, half)


def search_words(index: ItemIndex, h: np.ndarray, at: np.ndarray, threshold: float, half: int) -> Iterator[tuple[int, int, float, int, int, list[int]]]:
    """search() on the texts' hashed words.

    Passages are two neighbouring halves of `half` words, so each stretch of `half` + 1 words lies in one."""
    if not len(h):
        return
    seen = np.flatnonzero(index.maybe[(h >> np.uint64(44)).astype(np.int64)])
    term = np.minimum(np.searchsorted(index.terms, h[seen]), len(index.terms) - 1)
    good = index.terms[term] == h[seen]
    seen, term = seen[good], term[good]
    of = owners(at)
    halves = -(-np.diff(at) // half)
    first_half = np.concatenate([[0], np.cumsum(halves)])
    n = int(first_half[-1])
    mine = first_half[of[seen]] + (seen - at[of[seen]]) // half
    follows = np.zeros(n + 1, bool)  # whether a half has the one after it in its text
    follows[:n] = True
    follows[first_half[1:][halves > 0] - 1] = False
    rare = ~index.common[term]
    # bound 1: the greatest impact of each rare term, all common terms of the best item (less than the threshold, see index_by_length)
    single = np.bincount(mine[rare], index.top[term[rare]], n)
    pair = single + np.where(follows[:n], np.append(single[1:], 0.0), 0.0)
    alive = pair + index.common_bound >= threshold
    if not alive.any():
        return
    # each alive passage's distinct terms
    first = alive[mine]
    behind = np.maximum(mine - 1, 0)
    second = (mine > 0) & follows[behind] & alive[behind]
    n_terms = len(index.terms)
    key = np.unique(np.concatenate([mine[first] * n_terms + term[first], behind[second] * n_terms + term[second]]))
    passage, t = key // n_terms, key % n_terms
    # bound 2: by block of items
    some = np.flatnonzero(~index.common[t])
    k, entry = _expand(index.block_at, t[some])
    cell, inverse = np.unique(passage[some[k]] * index.n_blocks + index.block[entry], return_inverse=True)
    bound = np.bincount(inverse, index.block_top[entry], len(cell)) + index.common_block[cell % index.n_blocks]
    cell = cell[bound >= threshold - 1e-9]
    if not len(cell):
        return
    # what is left is scored in full
    left = np.isin(passage, cell // index.n_blocks)
    passage, t = passage[left], t[left]
    k, entry = _expand(index.at, t)
    item, whose = index.item[entry], passage[k]
    inside = np.isin(whose * index.n_blocks + item // index.block_size, cell)
    hit, inverse = np.unique(whose[inside] * len(index.ids) + item[inside], return_inverse=True)
    score = np.bincount(inverse, index.impact[entry[inside]], len(hit))
    for x, s in zip(hit[score >= threshold].tolist(), score[score >= threshold].tolist(), strict=True):
        p, i = divmod(x, len(index.ids))
        text = int(np.searchsorted(first_half, p, side="right")) - 1
        a = int(at[text] + (p - first_half[text]) * half)
        z = min(int(at[text + 1]), a + 2 * half)
        near = h[max(int(at[text]), a - half) : min(int(at[text + 1]), z + half)].tolist()
        yield text, i, s, a - int(at[text]), z - int(at[text]), near


def statistics(words: list[np.ndarray]) -> tuple[int, float, dict[int, int]]:
    """Number of items, mean length and document frequencies, of all items' hashed words."""
    return len(words), sum(map(len, words)) / max(1, len(words)), dict(Counter(t for w in words for t in set(w.tolist())))


def index_by_length(items: list[tuple[int, str]], stats: tuple[int, float, dict[int, int]] | None, half: int, threshold: float = 0.5) -> list[tuple[int, ItemIndex]]:
    """(half, index) of each group of items: lengths up to `half` + 1, then up to the double and so on.

    A group's half is its longest item, so that any whole copy lies in one passage. Items whose common
    terms make up more than half of the threshold are a group apart, without common terms."""
    words = [term_hashes(t) for _, t in items]
    items, words = [i for i, w in zip(items, words, strict=True) if len(w)], [w for w in words if len(w)]
    stats = stats or statistics(words)
    groups: dict[tuple[int, bool], list[int]] = {}
    for i, w in enumerate(words):
        common = sum(x for t, x in weights(Counter(w.tolist()), stats).items() if is_common(stats[2][t], stats[0]))
        groups.setdefault((max(0, -(-(len(w) - 1) // half) - 1).bit_length(), common <= threshold / 2), []).append(i)
    return [(max(half, max(len(words[i]) for i in g)) if k else half, build_index([items[i] for i in g], stats, together=together)) for (k, together), g in sorted(groups.items())]


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5, half: int = 48, index_bytes: int = 32 << 20) -> DataFrame:
    """One row for each document and test item that leaks into it, at its best passage: SCHEMA.

    items: (item_id, text). threshold is a share of the item's own BM25 score; question and answer are
    shares of three-word sequences. Words are runs of letters and digits, folded to lower case. half is
    the least passage half in words; longer items have longer passages. The index is broadcast; items
    beyond index_bytes of text are indexed in parts of that size, one pass over the corpus each, with
    statistics of all items: of these the driver gets what one part's terms need. Null and empty texts and items match nothing.
    Of repeated item ids each row is an item. Repeated documents give a row each. Extra columns are
    ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for groups in indexes(items, threshold, half, index_bytes):
        got = base.mapInArrow(_probe(spark.sparkContext.broadcast(groups), threshold, question, answer), SCHEMA)
        found = got if found is None else found.unionByName(got)
    return found if found is not None else spark.createDataFrame([], SCHEMA)


def indexes(items: DataFrame, threshold: float, half: int, index_bytes: int) -> Iterator[list[tuple[int, ItemIndex]]]:
    """The index of each part of the items, as index_by_length() gives it; parts hold about index_bytes of text."""
    usable = items.filter("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    n_parts = parts_for(usable.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0, index_bytes)
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts))
    frequencies = size = None
    if n_parts > 1:
        terms = settle(usable.select(part_of.alias("part"), "text").mapInArrow(_item_terms, "part long, t long, size long"))
        size = terms.filter("t IS NULL").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
        frequencies = settle(terms.filter("t IS NOT NULL").groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.collect_set("part").alias("parts")))
    for part in range(n_parts):
        rows = sorted((r["item_id"], r["text"]) for r in usable.filter(part_of == part).collect())
        stats = None
        if frequencies is not None:
            df = {r["t"] & ((1 << 64) - 1): r["n"] for r in frequencies.filter(F.array_contains("parts", F.lit(part).cast("long"))).select("t", "n").collect()}
            stats = size["n"], size["mean"], df
        if groups := index_by_length(rows, stats, half, threshold):
            yield groups


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term) of each item's distinct terms, and (part, null, number of words) of the item."""
    for b in batches:
        for part, text in zip(b.column("part").to_pylist(), b.column("text").to_pylist(), strict=True):
            h = term_hashes(text)
            if len(h):
                u = np.unique(h).view(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([part] * (len(u) + 1)), pa.array([None, *u], pa.int64()), pa.array([len(h), *[None] * len(u)], pa.int64())], ["part", "t", "size"])


def leaks_of(groups: list[tuple[int, ItemIndex]], data: np.ndarray, offsets: np.ndarray, threshold: float, question: float, answer: float) -> list[tuple]:
    """(text, item_id, score, first and last word, question and answer overlap) of each text's leaked items, at their best passages."""
    words, at = hashed_words(data, offsets)
    rows = []
    for half, ix in groups:
        best: dict[tuple[int, int], tuple] = {}
        for text, i, score, start, end, near in search_words(ix, words, at, threshold, half):
            q, a = overlap(ix.questions[i], near), overlap(ix.answers[i], near)
            if q >= question and a >= answer and (score, -start) > best.get((text, i), (0.0, 1))[:2]:
                best[text, i] = (score, -start, end, q, a)
        rows += [(t, ix.ids[i], s, -m, e, q, a) for (t, i), (s, m, e, q, a) in sorted(best.items())]
    return rows


def _probe(groups, threshold: float, question: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 21):
            ids = b.column("doc_id").to_pylist()
            rows = [(ids[r[0]], *r[1:]) for r in leaks_of(groups.value, *flat(b.column("text")), threshold, question, answer)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            names = ["doc_id", "item_id", "score", "start_word", "end_word", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5, half: int = 48, index_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs, all columns, in which no test item leaks, as find_leaks() tells.

    Each row is decided where it is read, by its own text: nothing is shuffled, and null and repeated ids
    are no matter. A null or empty text stays."""

    def without(groups):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, limit=1 << 21):
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in leaks_of(groups.value, *flat(b.column("text")), threshold, question, answer)]] = False
                yield b.filter(pa.array(keep))

        return run

    left = docs
    for groups in indexes(items, threshold, half, index_bytes):
        left = left.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(groups)), docs.schema)
    return left


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

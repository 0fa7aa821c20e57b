"""Token counts by greedy longest match, from a linear automaton that never builds the pieces.

The vocabulary's entries form a trie. Each node knows its failure link (the state after the longest
piece that starts its string is popped, and so on as far as needed) and how many pieces that pops.
Reading a word byte by byte, a missing edge adds the popped count and follows the link, so the work
is linear in the word, whatever the vocabulary.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.engine import table
from veilworks.llm.textbytes import flat, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = -1


class LongestMatch:
    """Greedy longest-match piece counts over bytes.

    Pieces that begin with a blank match only at the start of a word, as the blank is put before each
    word; a byte that no piece starts with counts as one piece of its own.
    """

    def __init__(self, pieces: list[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        final, depth, parent = [False], [0], [(0, 0)]
        # every byte is a piece, so that a match never fails at its first byte
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            at = 0
            for b in piece:
                to = self.edges[at].get(b)
                if to is None:
                    to = self.edges[at][b] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                    depth.append(depth[at] + 1)
                    parent.append((at, b))
                at = to
            final[at] = bool(at)
        n = len(self.edges)
        self.link, self.popped = [NONE] * n, [0] * n
        queue = deque(self.edges[0].values())
        while queue:  # breadth first: links lead to shorter strings
            v = queue.popleft()
            queue.extend(self.edges[v].values())
            if final[v]:
                self.link[v], self.popped[v] = 0, 1
                continue
            u, b = parent[v]
            z, count = self.link[u], self.popped[u]
            while z != NONE and b not in self.edges[z]:
                count += self.popped[z]
                z = self.link[z]
            if z != NONE:
                self.link[v], self.popped[v] = self.edges[z][b], count

    def count(self, word: bytes) -> int:
        """Pieces of one word; the word's leading blank is the caller's."""
        edges, link, popped = self.edges, self.link, self.popped
        at = total = 0
        for b in word:
            to = edges[at].get(b)
            while to is None:
                total += popped[at]
                at = link[at]
                to = edges[at].get(b)
            at = to
        while at:
            total += popped[at]
            at = link[at]
        return total


def parse_ranks(content: bytes) -> list[bytes]:
    """The pieces of a rank file: a base64 piece and its rank in each line."""
    import base64

    return [base64.b64decode(line.split()[0]) for line in content.splitlines() if line.strip()]


@lru_cache(2)
def _automaton(content: bytes) -> LongestMatch:
    return LongestMatch(parse_ranks(content))


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The vocabulary file's bytes, read by Spark so that any store will do."""
    return bytes(spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").first()["content"])


def count_tokens(docs: DataFrame, vocabulary: bytes, memo: int = 200_000, longest: int = 48) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_bytes) for each row, over whole texts.

    n_tokens adds up the greedy longest-match pieces of each word, a blank before it. Words are runs
    of bytes other than 0x20 and 0x09 to 0x0D. Null and empty texts have 0 of each. Counts of up to
    `memo` short words are kept in a worker; that changes no result. Extra columns are ignored, equal
    rows are counted each, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = _automaton(shared.value), {}
        one, get = machine.count, known.get
        for b in slices(batches):
            data, offsets = flat(b.column("text"))
            raw = data.tobytes()
            words_of, tokens_of = [], []
            for i in range(b.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                total = 0
                for w in words:
                    c = get(w)
                    if c is None:
                        c = one(b" " + w)
                        if len(w) <= longest:
                            if len(known) >= memo:
                                known.clear()
                            known[w] = c
                    total += c
                words_of.append(len(words))
                tokens_of.append(total)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64()), pa.array(np.diff(offsets), pa.int64())], ["doc_id", "n_words", "n_tokens", "n_bytes"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_bytes long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """The vocabulary is the file that spark.veilworks.vocabulary names, or the default."""
    return count_tokens(table(spark, sf_dir, "documents"), read_vocabulary(spark, spark.conf.get("spark.veilworks.vocabulary", VOCABULARY)))

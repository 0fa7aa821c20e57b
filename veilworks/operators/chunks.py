"""Sentence packing into overlapping chunks for a model's window."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def pack(text: str, longest: int = 350, overlap: int = 50) -> list[tuple[str, int]]:
    """(chunk, offset): whole sentences up to `longest` words; a new chunk begins with the last
    sentences of the one before that fit into `overlap` words; a longer sentence is sliced."""
    done: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []  # sentences of the open chunk with their word counts
    at = 0

    def close() -> str:
        body = " ".join(s for s, _ in held)
        done.append((body, at))
        return body

    for sentence in SENTENCE_END.split(text) if text.strip() else []:
        tokens = sentence.split()
        if len(tokens) > longest:
            if held:
                at += len(close()) + 1
                held = []
            step = longest - overlap
            for i in range(0, len(tokens), step):
                done.append((" ".join(tokens[i : i + longest]), at))
                at += len(" ".join(tokens[i : i + step])) + 1
            continue
        if held and sum(n for _, n in held) + len(tokens) > longest:
            body, tail, room = close(), [], overlap
            while held and held[-1][1] <= room:
                tail.insert(0, held.pop())
                room -= tail[0][1]
            at += len(body) - len(" ".join(s for s, _ in tail)) if tail else len(body) + 1
            held = tail
        held.append((sentence, len(tokens)))
    if held:
        close()
    return done


def chunk(docs: DataFrame, longest: int = 350, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_no, offset, chunk) of each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n, at, c) for i, t in zip(f["doc_id"], f["text"], strict=True) for n, (c, at) in enumerate(pack(t or "", longest, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "offset", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_no int, offset int, chunk string")

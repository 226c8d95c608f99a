"""Token counts: Arrow batches in, lengths out.

Texts are split at safe boundaries, where a single space stands between two characters that are not white
space: the byte-level pattern always ends a match before such a space and begins the next one with it.
Pieces not counted before go to the library in batches of equal bytes; only lengths are kept.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planeframe.llm import textkernel as K
from planeframe.llm.common import narrow

#: Bytes of new pieces handed to the library at once, entries of the dictionary, longest piece kept in it.
BATCH_BYTES, MOST_PIECES, LONGEST = 1 << 20, 900_000, 128

_SAFE = re.compile(r"(?<=\S)(?= \S)")
_UNEVEN = re.compile(r" \s|\s |^ | $")


def pieces(text: str) -> list[str]:
    """The text cut at every safe boundary, without the space that begins all pieces but the first."""
    if "  " in text or _UNEVEN.search(text):
        cut = _SAFE.split(text)
        return [cut[0], *[c[1:] for c in cut[1:]]]
    return text.split(" ")


class HfCounter:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return list(map(len, self.t.encode_batch_fast(texts, add_special_tokens=False)))


class SentencePieceCounter:
    """Whole texts: the model has no boundary that is safe for every text."""

    def __init__(self, path: str):
        import sentencepiece

        self.t = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: list[str]) -> list[int]:
        return list(map(len, self.t.encode(texts, num_threads=1)))


class Counter:
    def __init__(self, path: str):
        self.split = path.endswith(".json")
        self.count = HfCounter(path) if self.split else SentencePieceCounter(path)
        self.known: dict[str, int] = {}  # of pieces that begin with a space

    def _fill(self, new: list[str], into: dict[str, int], space: str) -> None:
        batch, size = [], 0
        for i, p in enumerate(new):
            batch.append(p)
            size += len(p) + 1
            if size >= BATCH_BYTES or i == len(new) - 1:
                into.update(zip(batch, self.count([space + x for x in batch])))
                batch, size = [], 0

    def __call__(self, texts: list[str | None]) -> list[int]:
        if not self.split:
            out: list[int] = []
            for t in texts:  # one at a time: a batch is as large as its texts
                out += self.count([t or ""])
            return out
        cut = [pieces(t) if t else [""] for t in texts]
        seen: set[str] = set()
        for c in cut:
            seen.update(c[1:])
        new = [p for p in seen if p not in self.known]
        if len(self.known) + len(new) > MOST_PIECES:
            self.known.clear()
            new = list(seen)
        now: dict[str, int] = {}
        self._fill([c[0] for c in cut], now, "")
        firsts = [now[c[0]] for c in cut]
        self._fill(new, self.known, " ")
        get = self.known.__getitem__
        out = [f + sum(map(get, c[1:])) for f, c in zip(firsts, cut)]
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        return out


@functools.cache
def worker_counter(path: str) -> Counter:
    """One for each Python worker, which serves many tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each row of docs(doc_id, text).

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows give repeated
    rows; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        for batch in batches:
            _, off = K.utf8(batch.column(1))
            for a, b in K.runs(off):
                part = batch.slice(a, b - a)
                n = np.array(counter(part.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(off[a : b + 1])), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return narrow(docs, "doc_id", "text").selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(
        work, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )

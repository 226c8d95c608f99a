"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text into chunks whose places depend on content alone, so that a
passage shared by documents gives the same chunks in each of them. A chunk is encoded once, as a text of its
own, and its ids are looked up by a 128-bit digest wherever it stands again. Chunk joins are then repaired: a
word that a cut parts is encoded again together with whole words on both sides, in a wider and wider stretch
until the ids of those words agree exactly with what their chunks have for them.

Beside the chunks stand the words met in new ones, in flat arrays. Both stores are bounded in bytes, belong to
one task and go when it ends, so that a Python worker keeps the tokenizer alone between tasks.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from planeframe.llm import textkernel as K
from planeframe.llm.common import narrow, released

#: Bytes under the rolling hash, and the mean distance of its cuts (a power of two).
WINDOW, MEAN_CHUNK = 16, 1024
#: Bytes of the ids of each of two generations of chunks.
CHUNK_BYTES = 4 << 20
#: Words kept (about 36 bytes each with their slots), and the longest of them in bytes.
SLOT_BITS, MOST_WORDS, LONGEST = 20, 600_000, 64

_TABLES = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def cuts(body: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places before which a chunk begins: where the hash of the WINDOW bytes before has its high bits zero."""
    n = len(body)
    if n <= WINDOW:
        return np.zeros(0, np.int64)
    p, inv = K.powers(n)
    total = np.cumsum((body.astype(np.uint64) + np.uint64(1)) * p, dtype=np.uint64)
    window = total[WINDOW - 1 : -1].copy()
    window[1:] -= total[: -WINDOW - 1]
    window *= inv[: len(window)]
    window *= np.uint64(0xFF51AFD7ED558CCD)
    at = np.flatnonzero(window >> np.uint64(64 - MEAN_CHUNK.bit_length() + 1) == 0) + WINDOW
    return at[(body[at] & 0xC0) != 0x80]  # never inside a character


class Words:
    """Two hashes of a word -> its ids: open addressing over flat arrays, emptied when it is full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.hashes = np.zeros((0, 2), np.uint64)
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each pair of hashes; -1 without one."""
        out = np.full(len(h), -1, np.int64)
        left, at = np.arange(len(h)), (h[:, 0] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(left):
            e = self.slots[at]
            same = (e >= 0) & (self.hashes[e] == h[left]).all(1) if len(self.hashes) else np.zeros(len(e), bool)
            out[left[same]] = e[same]
            on = (e >= 0) & ~same
            left, at = left[on], (at[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Entries that find() does not know; ids are those of all, n how many each has."""
        if len(self.hashes) + len(h) > MOST_WORDS:
            self.clear()
            if len(h) > MOST_WORDS:
                return
        first = len(self.hashes)
        self.hashes = np.concatenate([self.hashes, h])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
        self.ids = np.concatenate([self.ids, ids])
        left, at = np.arange(len(h)), (h[:, 0] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = first + left[free]  # of two that want a slot one gets it
            on = self.slots[at] != first + left
            left, at = left[on], (at[on] + 1) & ((1 << SLOT_BITS) - 1)

    def take(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _slices(self.ids, self.start[entries], self.start[entries + 1] - self.start[entries])


def _slices(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of n values from each start, one after another, and n."""
    ends = np.cumsum(n)
    at = np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    return values[at], n


@functools.cache
def library(path: str):
    """The tokenizer; a worker keeps it for its later tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, t.decoder is None, [t.id_to_token(i) or "" for i in range(t.get_vocab_size(True))]


class Codec:
    """Encodes and decodes whole texts, chunk by chunk. `made` counts the chunks met and those encoded."""

    def __init__(self, path: str):
        self.tokenizer, self.plain, self.names = library(path)
        self.words = Words()
        #: digest -> the chunk's ids and how many each of its words has
        self.chunks: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.old: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.held, self.met, self.made = 0, 0, 0

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and how many each has."""
        ids, n = [], []
        for at in range(0, len(texts), 4096):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
            n += map(len, got)
            ids.append(np.fromiter(chain.from_iterable(got), np.int32))
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(n, np.int64)

    def decoded(self, ids: np.ndarray) -> str:
        """What decode() makes of the ids; without a decoder, tokens are joined by one space."""
        if self.plain:
            return " ".join(map(self.names.__getitem__, ids.tolist()))
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def _texts(self, body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all words of the texts (stretches without ASCII white space), ids a word, first word of each text."""
        starts, ends, first = K.word_bounds(body, off)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), first
        h = np.stack([K.span_hashes(body, starts, ends, t) for t in _TABLES], 1)
        _, one, of = np.unique(h[:, 0], return_index=True, return_inverse=True)
        raw = body.tobytes()
        if (h[one[of]] != h).any():  # two words with one hash: each word by itself
            return *self.encoded([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]), first
        entry = self.words.find(h[one])
        new = one[entry < 0]
        ids, n = self.encoded([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        # known words' ids, then the new ones'
        known, m = self.words.take(entry[entry >= 0])
        count = np.empty(len(one), np.int64)
        count[entry >= 0], count[entry < 0] = m, n
        at = np.empty(len(one), np.int64)
        at[entry >= 0], at[entry < 0] = np.cumsum(m) - m, len(known) + np.cumsum(n) - n
        short = ends[new] - starts[new] <= LONGEST
        self.words.add(h[new[short]], ids[np.repeat(short, n)], n[short])
        return *_slices(np.concatenate([known, ids]), at[of], count[of]), first

    def _remember(self, digest: bytes, chunk: tuple[np.ndarray, np.ndarray]) -> None:
        size = chunk[0].nbytes + chunk[1].nbytes + 400
        if self.held + size > CHUNK_BYTES:  # of two generations the older one goes
            self.old, self.chunks, self.held = self.chunks, {}, 0
        self.chunks[digest] = chunk
        self.held += size

    def _chunks(self, body: np.ndarray, where: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of every chunk; those that are not known are encoded, each of them once."""
        raw, bounds = body.tobytes(), where.tolist()
        digests = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        run = {d: self.chunks.get(d) or self.old.get(d) for d in digests}
        new = {d: i for i, d in enumerate(digests) if run[d] is None}
        for d, c in run.items():
            if c is not None and d not in self.chunks:
                self._remember(d, c)
        at = np.fromiter(new.values(), np.int64, len(new))
        size = where[at + 1] - where[at]
        part, _ = _slices(body, where[at], size)
        ids, n, first = self._texts(part, np.concatenate([[0], np.cumsum(size)]))
        total = np.concatenate([[0], np.cumsum(n)])
        for d, a, b in zip(new, first[:-1].tolist(), first[1:].tolist()):
            run[d] = ids[total[a] : total[b]].copy(), n[a:b].astype(np.int32)
            self._remember(d, run[d])
        self.met += len(digests)
        self.made += len(new)
        return [run[d] for d in digests]

    def run(self, body: np.ndarray, off: np.ndarray) -> Iterator[tuple[bytes, str]]:
        """The ids (little-endian 32 bits each) and the decoded text of every text."""
        where = np.unique(np.concatenate([cuts(body, off), off]))
        chunks = self._chunks(body, where)
        ids = np.concatenate([c[0] for c in chunks]) if chunks else np.zeros(0, np.int32)
        n = np.concatenate([c[1] for c in chunks]).astype(np.int64) if chunks else np.zeros(0, np.int64)
        # cuts inside a word of a text, the words of texts that they part, and the parts in the chunks
        inner = np.setdiff1d(where, off)
        inner = inner[~K.WHITE[body[inner - 1]] & ~K.WHITE[body[inner]]]
        starts, ends, first = K.word_bounds(body, off)
        if len(inner):
            part_starts, part_ends, _ = K.word_bounds(body, where)
            same = ~np.isin(part_starts, inner) & ~np.isin(part_ends, inner)
            ids, n = self._mended(body, starts, ends, first, np.unique(np.searchsorted(starts, inner, "right") - 1), ids[np.repeat(same, n)], n[same])
        total = np.concatenate([[0], np.cumsum(n)])[first]
        for a, b in zip(total[:-1].tolist(), total[1:].tolist()):
            yield ids[a:b].astype("<u4").tobytes(), self.decoded(ids[a:b])

    def _mended(self, body, starts, ends, first, broken, ids, n) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids and how many each has, from those of the words that no cut parts.

        Broken words are encoded again with whole words on both sides, until these get the ids that their chunks
        have for them; a stretch that reaches from end to end of its text needs no such neighbour."""
        whole = np.ones(len(starts), bool)
        whole[broken] = False
        count = np.zeros(len(starts), np.int64)
        count[whole] = n
        at = np.cumsum(count) - count
        raw, mended = body.tobytes(), {}
        margin, text = 1, np.searchsorted(first, broken, "right") - 1
        while len(broken):
            # broken words with fewer than `margin` whole ones between them are mended together
            new = np.flatnonzero(np.concatenate([[True], (np.diff(broken) > margin) | (np.diff(text) > 0)]))
            a, b, of = broken[new], broken[np.append(new[1:], len(broken)) - 1] + 1, text[new]
            left, right = np.maximum(a - margin, first[of]), np.minimum(b + margin, first[of + 1])
            got, m = self.encoded([raw[x:y].decode() for x, y in zip(starts[left].tolist(), ends[right - 1].tolist())])
            wrong = set()
            for a, b, left, right, t, ids_end, m in zip(*(x.tolist() for x in (a, b, left, right, of, np.cumsum(m), m))):
                one = got[ids_end - m : ids_end]
                before, after = ids[at[left] : at[a]], ids[at[b - 1] : at[b - 1] + int(count[b:right].sum())]
                if len(before) + len(after) <= m and (one[: len(before)] == before).all() and (one[m - len(after) :] == after).all():
                    mended[a] = b, one[len(before) : m - len(after)]
                elif (left, right) == (first[t], first[t + 1]):
                    mended[left] = right, one
                else:
                    wrong.add(t)
            again = np.isin(text, list(wrong))
            for w in broken[again].tolist():
                mended.pop(w, None)
            broken, text, margin = broken[again], text[again], margin * 4
        keep = np.ones(len(starts), bool)
        was = count.copy()
        for a, (b, one) in mended.items():
            keep[a:b] = False
            count[a:b] = 0
            count[a] = len(one)
        every = np.empty(int(count.sum()), np.int32)
        inside = np.repeat(keep, count)
        every[inside] = ids[np.repeat(keep, was)]
        every[~inside] = np.concatenate([mended[a][1] for a in sorted(mended)])
        return every, count


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes `text` of docs(doc_id, text) with the tokenizer file at `path`, one row for each row.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids (array of int) and decoded.
    The tokenizer must drop ASCII white space and let no token reach over it. A null text counts as empty: 0
    tokens, hashes of nothing. A null doc_id stays null; repeated rows give repeated rows; other columns are
    ignored, also those whose names differ in case only. No row order is implied.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            body, off = K.utf8(batch.column(1))
            for a, b in K.runs(off):
                n, i, d, ids, texts = [], [], [], [], []
                for raw, text in codec.run(body[off[a] : off[b]], off[a : b + 1] - off[a]):
                    n.append(len(raw) // 4)
                    i.append(hashlib.sha256(raw).hexdigest())
                    d.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                        texts.append(text)
                cols = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return narrow(docs, "doc_id", "text").selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(
        released(work), SCHEMA + (", ids array<int>, decoded string" if keep_ids else "")
    )

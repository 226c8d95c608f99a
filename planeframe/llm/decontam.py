"""Benchmark decontamination by spaced-seed hashing.

Each mask looks at SPAN tokens in a row and ignores some of them, so that a substituted token spoils only the
masks that look at it. Hashes of the test items' masked windows meet those of the documents; around each hit,
both texts are laid side by side on the diagonal that the hit names, and an overlap is confirmed if enough
tokens agree over a long enough stretch. Items of fewer than SPAN tokens must stand there whole, token for token.

Windows of a document that stand in equal surroundings (as far as the longest item reaches) lead to equal
overlaps, so the first of them speaks for all; and diagonals that lay an item beside equal stretches are walked
once. The work on texts that repeat themselves thus grows with what is different in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planeframe.llm import textkernel as K
from planeframe.llm.common import flat, materialize, maybe_broadcast, narrow, place, released

#: Fixed masks: 1 looks at a token, 0 ignores it. Of any way to substitute a fifth of 8 to 21 tokens (rounded
#: down), a window of at least one of them sees nothing.
MASKS = ("11111000", "11011010", "10110110", "10101101", "00011111", "11110010", "10101011")
SPAN = 8
#: An overlap: at least so many tokens (or the whole item), of which so many percent agree.
MIN_TOKENS, PERCENT = 13, 80
#: Items, and bytes of them, that are kept in every task at once; beyond, documents and items are joined by their hashes.
ITEMS_AT_ONCE, ITEM_BYTES = 50_000, 64 << 20
#: Hits that are expanded at once.
HITS_AT_ONCE = 1 << 20


def windows(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask: its number, the hashes at every token, and whether a whole window of one text begins there."""
    n = max(0, len(hashes) - SPAN + 1)
    end = np.repeat(first[1:], np.diff(first))[:n]
    ok = np.arange(n) + SPAN <= end
    for m, mask in enumerate(MASKS):
        acc = np.full(n, m + 1, np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                acc *= np.uint64(0x9E3779B97F4A7C15)
                acc += hashes[i : i + n]
                acc ^= acc >> np.uint64(29)
        yield m, acc, ok


class Stretches:
    """Hashes of any stretch of tokens."""

    def __init__(self, hashes: np.ndarray):
        p, self.inv = K.powers(len(hashes) + 1)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(hashes) * p[: len(hashes)], dtype=np.uint64)])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return K.mix((self.total[b] - self.total[a]) * self.inv[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def first_of_each(*columns: np.ndarray) -> np.ndarray:
    """The first place of each combination of values, in order."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], 0)
    return np.sort(order[new])


def best_overlap(same: np.ndarray, whole: int) -> tuple[int, int] | None:
    """The longest stretch of a diagonal (True where tokens agree) that begins and ends in agreement, has
    PERCENT agreement and MIN_TOKENS tokens (`whole` if the item has fewer, but SPAN)."""
    least = max(SPAN, min(MIN_TOKENS, whole))
    if len(same) < least:
        return None
    total = np.concatenate([[0], np.cumsum(same.astype(np.int64) * 100 - PERCENT)])
    # the longest i < j with total[j] >= total[i]: candidates for i fall, candidates for j rise
    low = np.minimum.accumulate(total)
    best = None
    i = 0
    high = np.maximum.accumulate(total[::-1])[::-1]
    j = 0
    while i < len(total) and j < len(total):
        if high[j] >= low[i]:
            if best is None or j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
    if best is None:
        return None
    a, b = best
    while a < b and not same[a]:
        a += 1
    while b > a and not same[b - 1]:
        b -= 1
    if b - a < least or 100 * int(same[a:b].sum()) < PERCENT * (b - a):
        return None
    return a, b


class Items:
    """The test items' tokens and masked windows; items of fewer than SPAN tokens are windows of their own length."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        body, off = K.utf8(pa.array(texts, pa.large_string()))
        self.hashes, self.first = K.words(body, off)
        size = np.diff(self.first)
        self.longest = int(size.max()) if len(size) else 0
        self.item = np.repeat(np.arange(len(ids)), size)
        self.keys, self.at, self.filters = [], [], []
        for _, h, ok in windows(self.hashes, self.first):
            at = np.flatnonzero(ok)
            order = np.argsort(h[at], kind="stable")
            self.keys.append(h[at][order])
            self.at.append(at[order])
            bits = np.zeros(1 << 20, bool)
            bits[(h[at] >> np.uint64(44)).astype(np.int64)] = True
            self.filters.append(bits)
        whole, self.short = Stretches(self.hashes), {}
        for n in range(1, SPAN):
            which = np.flatnonzero(size == n)
            key = whole(self.first[which], self.first[which] + n)
            order = np.argsort(key, kind="stable")
            if len(which):
                self.short[n] = key[order], which[order]

    def hits(self, hashes: np.ndarray, first: np.ndarray, doc: np.ndarray, of: Stretches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the documents and in the items whose masked windows are equal."""
        for m, h, ok in windows(hashes, first):
            at = np.flatnonzero(ok & self.filters[m][(h >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(self.keys[m], h[at], "left"), np.searchsorted(self.keys[m], h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            left, right = np.maximum(first[doc[at]], at - self.longest), np.minimum(first[doc[at] + 1], at + SPAN + self.longest)
            keep = first_of_each(doc[at], at - left, of(left, right))
            at, lo, n = at[keep], lo[keep], n[keep]
            total = np.cumsum(n)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS_AT_ONCE, "right")))
                part = n[a:b]
                which = np.repeat(lo[a:b] - (np.cumsum(part) - part), part) + np.arange(part.sum())
                yield np.repeat(at[a:b], part), self.at[m][which]
                a = b

    def whole(self, first: np.ndarray, doc: np.ndarray, of: Stretches) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Places where short items stand whole, the items, and their length."""
        for n, (keys, which) in self.short.items():
            at = np.flatnonzero(np.arange(len(doc)) + n <= first[doc + 1])
            key = of(at, at + n)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            many = hi - lo
            if many.any():
                yield np.repeat(at, many), which[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())], n


def best_overlaps(items: Items, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(document, item) -> start, end and equal tokens of the longest overlap; ties go to more equal tokens, then
    to the earlier place."""
    doc, of = np.repeat(np.arange(len(first) - 1), np.diff(first)), Stretches(hashes)
    best: dict[tuple[int, int], tuple] = {}

    def offer(d: int, q: int, start: int, end: int, equal: int) -> None:
        now = (end - start, equal, -start, end)
        if now > best.get((d, q), (0,)):
            best[d, q] = now

    found = []
    for x, y in items.hits(hashes, first, doc, of):
        # a diagonal: the document, the item, and the distance of their tokens
        d, q, shift = doc[x], items.item[y], (x - first[doc[x]]) - (y - items.first[items.item[y]])
        keep = first_of_each(d, q, shift)
        found.append(np.stack([d[keep], q[keep], shift[keep]]))
    if found:
        d, q, shift = np.concatenate(found, axis=1)
        order = np.lexsort((shift, q, d))
        d, q, shift = d[order], q[order], shift[order]
        size, length = (first[d + 1] - first[d]), (items.first[q + 1] - items.first[q])
        lo, hi = np.maximum(0, shift), np.minimum(size, shift + length)
        keep = first_of_each(d, q, lo - shift, of(first[d] + lo, first[d] + hi))
        for d, q, shift, lo, hi, length in zip(*(x[keep].tolist() for x in (d, q, shift, lo, hi, length))):
            d0, i0 = first[d], items.first[q]
            same = hashes[d0 + lo : d0 + hi] == items.hashes[i0 + lo - shift : i0 + hi - shift]
            if stretch := best_overlap(same, length):
                s, e = stretch
                offer(d, q, lo + s, lo + e, int(same[s:e].sum()))
    for x, q, n in items.whole(first, doc, of):
        keep = first_of_each(doc[x], q)
        for x, q in zip(x[keep].tolist(), q[keep].tolist()):
            start = x - int(first[doc[x]])
            offer(int(doc[x]), q, start, start + n, n)
    return {k: (-v[2], v[3], v[1]) for k, v in best.items()}


_FOUND = "doc_id bigint, tk bigint, item_id bigint, start bigint, end bigint, n_equal bigint"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "tk", "item_id", "start", "end", "n_equal"])


def _scan(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            body, off = K.utf8(batch.column(2))
            rows: list[tuple] = []
            for a, b in K.runs(off):
                hashes, first = K.words(body[off[a] : off[b]], off[a : b + 1] - off[a])
                rows += [(ids[a + d], keys[a + d], items.ids[q], *v) for (d, q), v in best_overlaps(items, hashes, first).items()]
            yield _found(rows)

    return work


def _window_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) in; (key, id) of each text's different masked windows out."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        body, off = K.utf8(batch.column(1))
        for a, b in K.runs(off):
            hashes, first = K.words(body[off[a] : off[b]], off[a : b + 1] - off[a])
            doc = np.repeat(np.arange(a, b), np.diff(first))
            for _, h, ok in windows(hashes, first):
                at = np.flatnonzero(ok)
                at = at[first_of_each(doc[at], h[at])]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[doc[at]])], ["key", "id"])


def _short_keys(every: bool):
    """(id, text) in; (key, id) out of stretches of fewer than SPAN tokens: of `every` one, or of whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            body, off = K.utf8(batch.column(1))
            for a, b in K.runs(off):
                hashes, first = K.words(body[off[a] : off[b]], off[a : b + 1] - off[a])
                doc, of = np.repeat(np.arange(b - a), np.diff(first)), Stretches(hashes)
                for n in range(1, SPAN):
                    at = np.flatnonzero(np.arange(len(doc)) + n <= first[doc + 1]) if every else first[:-1][np.diff(first) == n]
                    keep = first_of_each(doc[at], of(at, at + n))
                    at = at[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(of(at, at + n).view(np.int64)), pa.array(ids[a + doc[at]])], ["key", "id"])

    return work


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, tk, text, item_id, item in zip(*(batch.column(i).to_pylist() for i in range(5))):
            body, off = K.utf8(pa.array([text], pa.large_string()))
            got = best_overlaps(Items([item_id], [item]), *K.words(body, off))
            rows += [(doc_id, tk, item_id, *v) for v in got.values()]
        yield _found(rows)


def _joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Overlaps by a join of window hashes, for any number of items: only hashes and places move, until the pairs
    of documents and items that share one are known."""
    docs = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "documents")
    tests = materialize(items.withColumn("id", F.monotonically_increasing_id()), "items")
    keys = "key bigint, id bigint"
    sides = [[x.select("id", "text").mapInArrow(_window_keys, keys) for x in (docs, tests)]]
    whole = tests.select("id", "text").mapInArrow(_short_keys(False), keys)
    if not whole.isEmpty():
        sides.append([docs.select("id", "text").mapInArrow(_short_keys(True), keys), whole])
    pairs = None
    for held, asked in sides:
        met = held.join(asked.select("key", F.col("id").alias("item")), "key").select("id", "item")
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = pairs.distinct()
    pairs = materialize(pairs, "pairs")
    return (
        pairs.join(docs, "id")
        .join(tests.select(F.col("id").alias("item"), "item_id", F.col("text").alias("asked")), "item")
        .select("doc_id", "tk", "text", "item_id", "asked")
        .mapInArrow(released(_verify), _FOUND)
    )


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As overlaps(), with tk, the xxhash64 of the document's text in lower case."""
    low = F.lower("text")
    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(low).alias("tk"), low.alias("text"))
    items = narrow(benchmark, "item_id", "text").filter("text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), low.alias("text")).distinct()
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if n > ITEMS_AT_ONCE or (size or 0) > ITEM_BYTES:
        return _joined(rows, items)
    got = items.orderBy("item_id", "text").collect()  # few and short, as counted
    shared = docs.sparkSession.sparkContext.broadcast(Items([r[0] for r in got], [r[1] for r in got]))
    return rows.mapInArrow(released(_scan(shared)), _FOUND)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, n_equal): each document's best overlap with each test item it holds a part of.

    start and end count the document's words (end exclusive); n_equal words of them agree in place. Words are
    stretches without ASCII white space, in lower case. Items of fewer than SPAN words are found where they stand
    whole, also those of one word. Null and blank texts on either side overlap with nothing; null ids are kept as
    they are; repeated rows give repeated rows, repeated items one; ties go to the earlier place; other columns
    are ignored; an empty table on either side gives no rows. Test items are counted first: up to ITEMS_AT_ONCE of
    ITEM_BYTES bytes go to every task, more of them are joined by their hashes.
    """
    return found(docs, benchmark).drop("tk")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that overlap with no test item; rows are told apart by doc_id (null
    or not) and text."""
    leaked = materialize(found(docs, benchmark).select(F.col("doc_id").alias("leaked"), "tk").distinct(), "leaks")
    d, t = F.col(f"c{place(docs, 'doc_id')}").cast("bigint"), F.col(f"c{place(docs, 'text')}")
    return flat(docs).join(maybe_broadcast(leaked), d.eqNullSafe(F.col("leaked")) & (F.xxhash64(F.lower(t)) == F.col("tk")), "left_anti").toDF(*docs.columns)

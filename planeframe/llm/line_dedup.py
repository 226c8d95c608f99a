"""Line dedup by pairwise alignment.

Documents that overlap are found through shared rare line hashes. A seed is the hash of a shortest stretch of
lines with MIN_WORDS words: it is rare because it is long, and there is no cap on how often it occurs. Holders are
counted over the whole corpus, and every later document is paired with the earliest holder of each of its seeds,
so that each block has its seeds' holders to be compared with, and so that a group of m copies makes m - 1 pairs.
The lines of a first document with many pairs are sent in one copy for each HOLDERS pairs, so that no task gets
them all.

Each pair is aligned by patience diff over line hashes, and aligned common blocks of at least MIN_WORDS words are
deleted from the later document. Blocks that no alignment in order reaches (repeated or swapped passages) are
found by their windows: the shortest stretches of MIN_WORDS words from each line on and up to each line, which
together cover any block of MIN_WORDS words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planeframe.llm import textkernel as K
from planeframe.llm.common import flat, materialize, maybe_broadcast, narrow, place, released

#: Words of the shortest block that is deleted.
MIN_WORDS = 25
#: Pairs with one first document that are aligned with one copy of its lines.
HOLDERS = 64
#: Line numbers (4 bytes each) up to which the deletions are broadcast.
BROADCAST_LINES = 4_000_000


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal items, increasing in both: items unique in both sequences form the
    longest increasing chain; equal ends of the stretches between are taken, and the stretches aligned anew."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(a[a0:a1], a0) if times_a[x] == 1 and times_b.get(x) == 1}
        ends: list[int] = []  # of the best chain of each length, its last place in a
        last: list[int] = []  # the item there
        items: list[tuple[int, int, int]] = []  # place in a, place in b, the item before
        for j in range(b0, b1):
            i = where.get(b[j])
            if i is None:
                continue
            at = bisect_left(ends, i)
            items.append((i, j, last[at - 1] if at else -1))
            ends[at : at + 1] = [i]
            last[at : at + 1] = [len(items) - 1]
        chain = []
        k = last[-1] if last else -1
        while k >= 0:
            i, j, k = items[k]
            chain.append((i, j))
        if not chain:
            continue
        ia, ib = a0, b0
        for i, j in reversed(chain):
            todo.append((ia, i, ib, j))
            out.append((i, j))
            ia, ib = i + 1, j + 1
        todo.append((ia, a1, ib, b1))
    return sorted(out)


def windows(hashes: np.ndarray, words: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, end (exclusive) and hash of the shortest stretches of lines with `least` words that begin or
    end at a line with words. The lines of text i are those from off[i] to off[i + 1]."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    at = np.flatnonzero(np.asarray(words) > 0)
    text = np.searchsorted(off, at, "right") - 1
    end = np.searchsorted(total, total[at] + least, "left")
    start = np.searchsorted(total, total[at + 1] - least, "right") - 1
    on, upto = end <= off[text + 1], start >= off[text]
    text, start, end = np.concatenate([text[on], text[upto]]), np.concatenate([at[on], start[upto]]), np.concatenate([end[on], at[upto] + 1])
    p, inv = K.powers(len(total))
    rolled = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(np.asarray(hashes, np.int64).view(np.uint64)) * p[: len(hashes)], dtype=np.uint64)])
    return text, start, end, K.mix((rolled[end] - rolled[start]) * inv[start] + (end - start).astype(np.uint64))


def common_blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Lines of b inside common blocks (consecutive in both) of at least `least` words: first the aligned ones,
    then all others. Blank lines (0 words) align like others, but do not count."""
    out = aligned_blocks(a, b, words, least)
    gone, held = set(out), set(a)
    if not any(w and h in held and j not in gone for j, (h, w) in enumerate(zip(b, words))):
        return out
    count = dict(zip(b, words))  # a line that b has not is in no common window
    _, _, _, first = windows(np.array(a), np.array([count.get(h, 0) for h in a]), np.array([0, len(a)]), least)
    _, start, end, own = windows(np.array(b), np.array(words), np.array([0, len(b)]), least)
    for s, e in zip(start[np.isin(own, first)].tolist(), end[np.isin(own, first)].tolist()):
        gone.update(range(s, e))
    return sorted(gone)


def aligned_blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Lines of b inside blocks of the patience diff."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(words[x] for x in block) >= least:
                out += block
            block = []
        block.append(j)
        before = (i, j)
    return out


def _align(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, gone = [], [], []
            for d, t, x, y, w in zip(*(batch.column(i).to_pylist() for i in range(5))):
                lines = common_blocks(x, y, w, least)
                if lines:
                    ids.append(d)
                    keys.append(t)
                    gone.append(lines)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "tk", "gone"])

    return work


def _seeds(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = batch.column(2)
            off = lines.offsets.to_numpy().astype(np.int64)
            text, _, _, seed = windows(lines.flatten().to_numpy(), batch.column(3).flatten().to_numpy(), off - off[0], least)
            order = np.lexsort((seed, text))
            text, seed = text[order], seed[order]
            new = np.ones(len(seed), bool)
            new[1:] = (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])
            at = pa.array(text[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(seed[new].view(np.int64))], ["doc_id", "tk", "seed"])

    return work


def deletions(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tk, gone): the lines (from 0) to delete, for the documents that lose any. tk is xxhash64(text)."""
    rows = narrow(docs, "doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    line = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x09-\x0D\x20]+", " ")))
    table = materialize(
        rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tk"), line.alias("lines")).select(
            "doc_id",
            "tk",
            F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
            F.transform("lines", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))).alias("words"),
        ),
        "lines",
    )
    seeds = table.mapInArrow(released(_seeds(least)), "doc_id bigint, tk bigint, seed bigint")
    # the earliest holder of each seed that several documents hold: partial aggregates before any shuffle
    first = seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "tk")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("seed", "f")
    pairs = materialize(
        seeds.join(first, "seed")
        .select("doc_id", "tk", F.col("f.doc_id").alias("fd"), F.col("f.tk").alias("ft"))
        .filter("fd < doc_id OR (fd = doc_id AND ft < tk)")
        .distinct(),
        "pairs",
    )
    # a first document with many pairs is sent once for each HOLDERS of them
    copies = materialize(pairs.groupBy("fd", "ft").agg(F.expr(f"(count(*) - 1) div {HOLDERS} + 1").alias("copies")), "holders")
    hot = maybe_broadcast(copies.filter("copies > 1"))
    dealt = pairs.join(hot, ["fd", "ft"], "left").withColumn("copy", F.expr("IF(copies IS NULL, 0L, pmod(xxhash64(doc_id, tk), copies))"))
    one = table.dropDuplicates(["doc_id", "tk"])  # repeated rows
    front = (
        one.join(copies, (one["doc_id"] == copies["fd"]) & (one["tk"] == copies["ft"]))
        .select("fd", "ft", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"), F.col("hashes").alias("first"))
    )
    return (
        dealt.select("fd", "ft", "copy", "doc_id", "tk")
        .join(front, ["fd", "ft", "copy"])
        .join(one, ["doc_id", "tk"])
        .select("doc_id", "tk", "first", "hashes", "words")
        .mapInArrow(released(_align(least)), "doc_id bigint, tk bigint, gone array<int>")
        .groupBy("doc_id", "tk")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    )


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs, with blocks of lines that an earlier document holds removed from `text`,
    and three more columns at the end: _n_lines, _n_removed, _removed (array of line numbers from 0). Where docs
    has columns of these names, take the new ones by their place.

    Lines end at a line feed and compare with white space runs as one space, trimmed. Earlier means a smaller
    doc_id. A document keeps what stands nowhere before; one whose lines all go keeps an empty text. Null and
    empty texts and rows with a null doc_id stay as they are; rows that repeat a doc_id and text lose the same
    lines, of rows with one doc_id and several texts the smaller text hash counts as earlier. doc_id and text may
    differ in case; of columns that repeat a name the first counts. An empty table gives an empty table.
    """
    gone = materialize(deletions(docs, least).select(F.col("doc_id").alias("gd"), F.col("tk").alias("gt"), "gone"), "deletions")
    lines_gone = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    rows, text = flat(docs), f"c{place(docs, 'text')}"
    d, t = F.col(f"c{place(docs, 'doc_id')}"), F.col(text)
    side = maybe_broadcast(gone, 100_000) if lines_gone <= BROADCAST_LINES else gone
    joined = rows.join(side, (d.cast("bigint") == F.col("gd")) & (F.xxhash64(t) == F.col("gt")), "left")
    every = F.split(t, "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("gone")), lambda i: F.get(every, i))
    cols = [F.when(F.col("gone").isNull(), t).otherwise(F.array_join(left, "\n")).alias(c) if c == text else F.col(c) for c in rows.columns]
    lines = F.when(t.isNull(), 0).otherwise(F.size(every)).cast("bigint")
    removed = F.coalesce(F.col("gone"), F.expr("CAST(array() AS array<int>)"))
    return joined.select(*cols, lines.alias("n1"), F.size(removed).cast("bigint").alias("n2"), removed.alias("n3")).toDF(
        *docs.columns, "_n_lines", "_n_removed", "_removed"
    )

"""Exact top-k inner products with KD-trees per shard.

Shards are the leaves of the top of a KD-tree whose median splits are fitted on a bounded sample; every row goes
down these splits, and every shard has the tight box of its own rows. Inside, each shard builds its KD-tree (median
splits of the widest dimension, tight bounding boxes), and a query walks it best first: by the largest inner product
that a node's box allows. A walk ends when no box can reach the k-th best score. That score is propagated: a query
is first sent to the shard whose box allows the most, and then only to those shards whose boxes reach the k-th score
found there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from planeframe.llm.common import materialize, narrow, released

#: Vectors in a shard and in a leaf, queries in a block.
SHARD_ROWS, LEAF, BLOCK_QUERIES = 8192, 64, 16384
#: Vectors on which the shards' splits are fitted, and the most shards: larger ones are cut by a hash of the row.
SAMPLE_ROWS, MOST_SHARDS = 65536, 4096


class KDTree:
    """Median splits down to LEAF rows; boxes are tight."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.x = rows.copy(), ids.copy(), x.copy()
        self.lo, self.hi, self.span, self.kids = [], [], [], []
        if len(ids):
            self._build(0, len(ids))
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _build(self, a: int, b: int) -> int:
        todo = [(a, b, -1, 0)]
        while todo:
            a, b, up, side = todo.pop()
            me = len(self.span)
            if up >= 0:
                self.kids[up][side] = me
            part = self.x[a:b]
            lo, hi = part.min(0), part.max(0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.span.append((a, b))
            self.kids.append([-1, -1])
            if b - a > LEAF and (hi > lo).any():
                d = int((hi - lo).argmax())
                mid = (b - a) // 2
                order = np.argpartition(part[:, d], mid)
                self.rows[a:b], self.ids[a:b], self.x[a:b] = self.rows[a:b][order], self.ids[a:b][order], part[order]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        return 0

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's box allows."""
        return self.hi @ np.maximum(q, 0) + self.lo @ np.minimum(q, 0)

    def search(self, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """Up to k (score, -id) of rows but `own`, in no order: scores below floor may be missing."""
        if not len(self.span):
            return []
        bound = self.bounds(q)
        heap = [(-bound[0], 0)]
        best: list[tuple[int, int]] = []  # a heap, worst first
        while heap:
            b, node = heapq.heappop(heap)
            limit = max(floor, best[0][0] if len(best) == k else -np.inf)
            if -b < limit:
                break
            left, right = self.kids[node]
            if left >= 0:
                for c in (left, right):
                    if bound[c] >= limit:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            s, e = self.span[node]
            score = self.x[s:e] @ q
            for i in np.flatnonzero(score >= limit).tolist():
                if self.rows[s + i] == own:
                    continue
                row = (int(score[i]), -int(self.ids[s + i]))
                if len(best) < k:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)
        return best


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component, x as double; null if the vector or a component is null or not finite."""
    ok = embedding.isNotNull() & F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(embedding, lambda v: F.floor(v.cast("double") * 256)))


class Splits:
    """The top of a KD-tree: every vector goes down to one of `leaves` leaves."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.at, self.kids, self.leaf = [], [], [], []
        todo = [(np.arange(len(sample)), leaves, -1, 0)]
        self.leaves = 0
        while todo:
            rows, want, up, side = todo.pop()
            me = len(self.dim)
            if up >= 0:
                self.kids[up][side] = me
            self.kids.append([me, me])
            part = sample[rows]
            spread = part.max(0) - part.min(0) if len(rows) else np.zeros(1)
            if want < 2 or len(rows) < 2 or not spread.any():
                self.dim.append(0)
                self.at.append(0.0)
                self.leaf.append(self.leaves)
                self.leaves += 1
                continue
            d = int(spread.argmax())
            column = part[:, d]
            at = np.partition(column, len(rows) // 2)[len(rows) // 2]
            if at == column.min():  # as many as that have the least value: the next one splits
                at = column[column > at].min()
            self.dim.append(d)
            self.at.append(float(at))
            self.leaf.append(-1)
            todo += [(rows[column < at], want // 2, me, 0), (rows[column >= at], want - want // 2, me, 1)]
        self.dim, self.at, self.kids, self.leaf = np.array(self.dim), np.array(self.at), np.array(self.kids), np.array(self.leaf)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (self.leaf[node] < 0).any():
            right = x[np.arange(len(x)), self.dim[node]] >= self.at[node]
            node = self.kids[node, right.astype(np.int64)]
        return self.leaf[node]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), n)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows (row, id, n, x) of one length after another."""
    n = batch.column(2).to_numpy()
    for size in np.unique(n).tolist():
        yield size, batch if (n == size).all() else batch.filter(pa.array(n == size))


def _placed(splits: dict[int, tuple[int, Splits]]):
    """(row, id, n, x) in; the same with the shard in front out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, part in _by_length(batch):
                first, split = splits[n]
                shard = first + split(_matrix(part.column(3), n))
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), *part.columns], ["shard", "row", "id", "n", "x"])

    return work


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, row, id, n, x) in; each batch's (shard, lo, hi) out."""
    for batch in batches:
        shards = batch.column(0).to_numpy()
        for s in np.unique(shards).tolist():
            part = batch.filter(pa.array(shards == s))
            x = _matrix(part.column(4), part.column(3)[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([x.min(0)], pa.list_(pa.float64())), pa.array([x.max(0)], pa.list_(pa.float64()))], ["shard", "lo", "hi"])


def _routed(shared, again: bool):
    """(row, id, n, x, floor, seen) in; (shard, row, id, x, floor) out: the shard whose box allows each query the
    most, or, again, all others whose boxes reach its floor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = shared.value  # length -> shards, lo, hi
        for batch in batches:
            for n, part in _by_length(batch):
                shards, lo, hi = boxes[n]
                step = max(1, (1 << 21) // len(shards))
                for at in range(0, part.num_rows, step):
                    some = part.slice(at, step)
                    q = _matrix(some.column(3), n)
                    bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
                    if again:
                        floor, seen = some.column(4).to_numpy(zero_copy_only=False), some.column(5).to_numpy()
                        i, j = np.nonzero((bound >= floor[:, None]) & (shards[None, :] != seen[:, None]))
                    else:
                        i, j = np.arange(len(q)), bound.argmax(1)
                    take = some.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(shards[j]), *(take.column(c) for c in (0, 1, 3, 4))], ["shard", "row", "id", "x", "floor"])

    return work


def _walk(k: int):
    """Rows of one cell (a part of a shard and a block of queries) after another: vectors first (kind 0), then
    queries (kind 1)."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        kind, row, ids = (t.column(c).to_numpy() for c in ("kind", "row", "id"))
        floor = t.column("floor").to_numpy(zero_copy_only=False)
        x = t.column("x").combine_chunks()
        x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        x = _matrix(x, len(x[0]))
        held = kind == 0
        tree = KDTree(row[held], ids[held], x[held])
        out: list[tuple[int, int, int, int]] = []
        for i in np.flatnonzero(~held).tolist():
            out += [(int(row[i]), int(ids[i]), -v, s) for s, v in tree.search(x[i], int(row[i]), k, float(floor[i]))]
        cols = list(zip(*out)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "query_id", "vec_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(edges[:-1], edges[1:]):
                if of[a] != cell and rows:
                    yield flush(rows)
                    rows = []
                cell = int(of[a])
                rows.append(batch.slice(a, b - a))
        if rows:
            yield flush(rows)

    return work


def _fitted(rows: DataFrame) -> tuple[dict[int, tuple[int, Splits]], int]:
    """Each length's first shard and splits, and the number of shards."""
    counts = {r["n"]: r["count"] for r in rows.groupBy("n").count().collect()}  # one row for each length
    large = [n for n, c in counts.items() if c > SHARD_ROWS]
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, sum(counts[n] for n in large)))
    taken = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))
    got = rows.filter(F.col("n").isin(large) & taken).select("n", "x").limit(SAMPLE_ROWS).collect() if large else []
    splits, first = {}, 0
    for n, c in sorted(counts.items()):
        sample = np.array([r["x"] for r in got if r["n"] == n], float).reshape(-1, n)
        splits[n] = first, Splits(sample, min(MOST_SHARDS, -(-c // SHARD_ROWS)))
        first += splits[n][1].leaves
    return splits, first


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every`, its k highest
    integer inner products with the other rows of vectors(vec_id, embedding), ties to the smaller vec_id.

    Components count as floor(256 * x). Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows with a null vec_id. A vector is compared with those of its own length. Rows that repeat a vec_id
    are rows of their own: each is a query and a candidate for all others. Fewer than k other rows give fewer ranks.
    Other columns are ignored; an empty table gives no rows. Scores are exact below 2^53.
    """
    rows = (
        narrow(vectors, "vec_id", "embedding")
        .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("id"), quantised(F.col("embedding")).alias("x"))
        .filter("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
        .select("row", "id", F.size("x").alias("n"), "x")
    )
    rows = materialize(rows, "vectors")
    splits, shards = _fitted(rows)
    placed = rows.mapInArrow(released(_placed(splits)), "shard bigint, row bigint, id bigint, n int, x array<bigint>")
    placed = materialize(placed, "shards")
    corners = placed.mapInArrow(released(_corners), "shard bigint, lo array<double>, hi array<double>")
    corners = corners.select("shard", F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "x")).groupBy("shard", "d").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    corners = corners.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("d", "lo", "hi"))).alias("box"))
    # at most MOST_SHARDS boxes a length come to the driver and go to every task
    got = {r["shard"]: r["box"] for r in corners.collect()}
    boxes = {}
    for n, (first, split) in splits.items():
        mine = [s for s in range(first, first + split.leaves) if s in got]
        boxes[n] = np.array(mine, np.int64), np.array([[c["lo"] for c in got[s]] for s in mine]), np.array([[c["hi"] for c in got[s]] for s in mine])
    shared = vectors.sparkSession.sparkContext.broadcast(boxes)
    # rows that the splits can't part (equal ones, or more than MOST_SHARDS shards' worth) are cut by a hash
    parts = placed.groupBy("shard").agg(F.expr(f"(count(*) - 1) div {4 * SHARD_ROWS} + 1").alias("parts"))
    parts = F.broadcast(materialize(parts, "parts"))  # one row a shard
    schema = "shard bigint, row bigint, id bigint, x array<bigint>, floor double"

    def ask(queries: DataFrame, again: bool) -> DataFrame:
        sent = materialize(queries.mapInArrow(released(_routed(shared, again)), schema), "queries")
        blocks = F.broadcast(sent.groupBy("shard").agg(F.expr(f"(count(*) - 1) div {BLOCK_QUERIES} + 1").alias("blocks")))
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
        cell = F.xxhash64("shard", "part", "block").alias("cell")
        # vectors are copied for each block of queries that their shard gets, queries for each part of the shard
        held = placed.join(parts, "shard").join(blocks, "shard").withColumn("part", F.expr("pmod(xxhash64(row), parts)")).withColumn("block", upto("blocks"))
        q = sent.join(parts, "shard").join(blocks, "shard").withColumn("block", F.expr("pmod(xxhash64(row, 1), blocks)")).withColumn("part", upto("parts"))
        both = held.select(cell, F.lit(0).alias("kind"), "row", "id", "x", F.lit(0.0).alias("floor")).unionByName(q.select(cell, F.lit(1).alias("kind"), "row", "id", "x", "floor"))
        dealt = both.repartition("cell").sortWithinPartitions("cell", "kind", "id", "row")
        return dealt.mapInArrow(released(_walk(k)), "row bigint, query_id bigint, vec_id bigint, score bigint")

    queries = placed.filter(F.col("id") % every == 0).select("row", "id", "n", "x", F.lit(float("-inf")).alias("floor"), F.lit(-1).cast("bigint").alias("seen"))
    best = first = materialize(ask(queries, False), "first")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    if shards > 1:
        kth = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("row", F.col("score").cast("double").alias("kth"))
        seen = queries.mapInArrow(released(_routed(shared, False)), schema).select("row", F.col("shard").alias("at"))
        asked = queries.drop("seen", "floor").join(seen, "row").join(kth, "row", "left")
        best = first.unionByName(ask(asked.select("row", "id", "n", "x", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"), F.col("at").alias("seen")), True))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Near-duplicate groups by a chosen-path set similarity join.

Every distinct shingle set gets a sketch of COORDS minwise tokens. In each of TREES independent trees a set
walks down paths: a node names the next coordinate (now and then two, which offsets what a level loses), and
the set goes on to the child that its own token there selects. Nodes of at most SMALL members are compared
exhaustively; larger ones are branched again, in rounds, and only their members move. A node that stays large
after DEPTH tokens is cut into blocks, each with the node's leaders in it, and the blocks are compared; that
links the mass of a family. What is then still apart in such a node is compared block against block.

Comparing a node yields a spanning forest of its likely pairs, most similar first, so that every way to part
the node keeps its best link, and the pairs grow with the members and not with their square. Each of those
pairs is then confirmed on the full sets. At last, likely pairs between what are still different components are
confirmed too, after a second look at them with LONG tokens more. Such a pair lies in one tree of its node's
forest, and on the way from one end to the other some pair of the forest leads from one component into another;
so only the members of components at the ends of such pairs (suspects) are compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from planeframe.llm import textkernel as K
from planeframe.llm.common import materialize, maybe_broadcast, narrow, released
from planeframe.llm.graph import components, joined

COORDS, TREES, SMALL, FIRST_DEPTH, DEPTH, LEADERS, LONG = 128, 14, 2048, 2, 14, 4, 896
#: Share of tokens that two sketches must have in common to be confirmed on the full sets: 3 standard
#: deviations below 0.8. With it, the trees miss a pair of similarity 0.8 about once in 1,000.
LIKELY = 0.695
#: The same for LONG tokens more: 3.5 standard deviations below 0.8.
LIKELY_LONG = 0.753

_rng = np.random.default_rng(20240521)
_XOR = _rng.integers(1, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(1, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR_LONG = _rng.integers(1, 1 << 32, LONG, dtype=np.uint64).astype(np.uint32)
_MUL_LONG = _rng.integers(1, 1 << 32, LONG, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def sketch(sets: list[np.ndarray], xor: np.ndarray = _XOR, mul: np.ndarray = _MUL) -> np.ndarray:
    """Sets x len(xor) minwise tokens of 16 bits; zeros for an empty set."""
    out = np.zeros((len(sets), len(xor)), np.uint16)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if not filled:
        return out
    sizes = np.array([len(sets[i]) for i in filled])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    low = (np.concatenate([sets[i] for i in filled]) >> np.uint64(16)).astype(np.uint32)
    for c in range(len(xor)):
        least = np.minimum.reduceat((low ^ xor[c]) * mul[c], at)
        out[filled, c] = ((least * np.uint32(0x9E3779B1)) ^ (least >> np.uint32(7))) >> np.uint32(16)
    return out


def sets_of(batch: pa.RecordBatch, at: int, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Ranges of rows and their shingle sets."""
    body, off = K.utf8(batch.column(at))
    for a, b in K.runs(off):
        hashes, first = K.words(body[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, b, K.shingle_sets(hashes, first, k)


def set_key(s: np.ndarray) -> bytes | None:
    """128 bits that stand for the set; None for the empty set, which is linked with nothing."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), key, sk (sketch) of each row of docs(doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in sets_of(batch, 1, k):
                sk = sketch(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in sk], pa.binary()),
                    ],
                    ["doc_id", "n", "key", "sk"],
                )

    return docs.mapInArrow(released(work), "doc_id bigint, n bigint, key binary, sk binary")


def _child(node: np.ndarray, coord: np.ndarray, token: np.ndarray) -> np.ndarray:
    return K.mix(node ^ (coord.astype(np.uint64) << np.uint64(32)) ^ (token.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def _descend(node: np.ndarray, rows: np.ndarray, sk: np.ndarray, twice: bool) -> tuple[np.ndarray, np.ndarray]:
    """One level down: the children and the rows that go there. Half of the nodes branch on two coordinates:
    a pair of similarity 0.8 then has 0.8 * 1.5 common children of a node, more than one, and isn't lost with depth."""
    pick = K.mix(node + np.uint64(0x51ED270B))
    c1 = (pick % np.uint64(COORDS)).astype(np.int64)
    one = _child(node, c1, sk[rows, c1])
    if not twice:
        return one, rows
    two = (pick >> np.uint64(40)) % np.uint64(2) == 0
    c2 = (c1[two] + 1 + ((pick[two] >> np.uint64(20)) % np.uint64(COORDS - 1)).astype(np.int64)) % COORDS
    other = _child(node[two], c2, sk[rows[two], c2])
    return np.concatenate([one, other]), np.concatenate([rows, rows[two]])


_NODE = "node bigint, rep bigint"


def _rows(node: np.ndarray, rows: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *[c.take(at) for c in columns.values()]], ["node", *columns])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, sk) in; every tree's node at FIRST_DEPTH out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sk = _matrix(batch.column(1))
        rows = np.arange(batch.num_rows)
        for tree in range(TREES):
            node, at = np.full(len(rows), (tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64), rows
            for _ in range(FIRST_DEPTH):
                node, at = _descend(node, at, sk, False)
            yield _rows(node, at, rep=batch.column(0))


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, rep, sk) of nodes that are still large in; the same of the nodes two levels below out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy().view(np.uint64)
        sk = _matrix(batch.column(2))
        at = np.arange(batch.num_rows)
        for _ in range(2):
            node, at = _descend(node, at, sk, True)
        yield _rows(node, at, rep=batch.column(1), sk=batch.column(2))


def _matrix(column: pa.Array, kind: type = np.uint16, width: int = COORDS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, n, sk) in; also tokens of 8 bits out, which are enough to compare."""
    for batch in batches:
        if batch.num_rows:
            short = _matrix(batch.column(3)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in short], pa.binary())], ["key", "rep", "n", "sk", "short"])


def likely_pairs(sk: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j whose sketches and sizes allow the similarity, and the share of equal tokens."""
    m = len(sk)
    if m == 2:
        i, j = np.array([0]), np.array([1])
        same = np.array([(sk[0] == sk[1]).sum()])
    else:
        found = []
        for x in range(0, m, 256):  # the triangle in strips
            equal = np.zeros((min(256, m - x), m - x), np.uint8)
            for c in range(COORDS):
                equal += sk[x : x + 256, c][:, None] == sk[x:, c][None, :]
            i, j = np.nonzero(np.triu(equal >= LIKELY * COORDS, 1))
            found.append((i + x, j + x, equal[i, j]))
        i, j, same = (np.concatenate(column) for column in zip(*found))
    ok = (same >= LIKELY * COORDS) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    return i[ok], j[ok], same[ok]


def forest(m: int, i: np.ndarray, j: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a spanning forest of the pairs (i, j) of m members, most similar first."""
    if len(i) > 16 * m:  # dense: grow trees, one member at a time
        weight = np.zeros((m, m), np.int16)
        weight[i, j] = weight[j, i] = same
        best, via = np.zeros(m, np.int16), np.zeros(m, np.int64)
        out = []
        for _ in range(m):
            v = int(best.argmax())
            if best[v]:
                out.append((int(via[v]), v))
            best[v] = -1
            nearer = (weight[v] > best) & (best >= 0)
            best[nearer] = weight[v, nearer]
            via[nearer] = v
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return np.minimum(a, b), np.maximum(a, b)
    root = list(range(m))
    keep = []
    for e in np.lexsort((j, i, -same.astype(np.int64))).tolist():
        a, b = int(i[e]), int(j[e])
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[a] = b
            keep.append(e)
    return i[keep], j[keep]


def _compare(percent: int, across: bool):
    """Batches sorted by node in. Out: the pairs (a < b) of each node's forest; or, across labels, all likely
    pairs, as rows (u, partners) where u is the end whose label has fewer members in the node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        out: set | list = [] if across else set()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            node = table.column(0).to_numpy()
            if not len(node):
                continue
            edge = np.flatnonzero(node[1:] != node[:-1]) + 1
            last = int(edge[-1]) if len(edge) else 0
            kept = table.slice(last)
            if last:
                _groups(table.slice(0, last), np.concatenate([[0], edge]), percent, across, out)
            if len(out) > 100_000:
                yield _pairs(out, across)
                out.clear()
        if kept is not None and kept.num_rows:
            _groups(kept, np.array([0, kept.num_rows]), percent, across, out)
        yield _pairs(out, across)

    return work


def _groups(table: pa.Table, edges: np.ndarray, percent: int, across: bool, out: set) -> None:
    size = np.diff(edges)
    rep, n, label = (table.column(c).to_numpy() for c in (1, 2, 4))
    sk = _matrix(table.column(3), np.uint8)
    more = _matrix(table.column(5), np.uint8, LONG) if across else None
    twos = edges[:-1][size == 2]
    same = (sk[twos] == sk[twos + 1]).sum(1)  # most nodes: all at once
    for g in np.concatenate([np.flatnonzero(size > 2), np.flatnonzero(size == 2)[same >= LIKELY * COORDS]]).tolist():
        a, b = int(edges[g]), int(edges[g + 1])
        i, j, same = likely_pairs(sk[a:b], n[a:b], percent)
        i, j = i + a, j + a
        ok = (label[i] != label[j]) & (rep[i] != rep[j])
        i, j, same = i[ok], j[ok], same[ok]
        if across and len(i):
            ok = np.concatenate([(more[i[x : x + 4096]] == more[j[x : x + 4096]]).sum(1) >= LIKELY_LONG * LONG for x in range(0, len(i), 4096)])
            i, j = i[ok], j[ok]
        if not len(i):
            continue
        if across:
            _, at, times = np.unique(label[a:b], return_inverse=True, return_counts=True)
            few = times[at]
            swap = few[i - a] > few[j - a]
            u, p = rep[np.where(swap, j, i)], rep[np.where(swap, i, j)]
            order = np.argsort(u, kind="stable")
            edge = np.flatnonzero(np.diff(u[order])) + 1
            out += [(int(u[x[0]]), p[x]) for x in np.split(order, edge)]
            continue
        if len(i) > 1:
            i, j = forest(b - a, i - a, j - a, same)
            i, j = i + a, j + a
        x, y = rep[i], rep[j]
        out.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))


def _pairs(out: set | list, across: bool) -> pa.RecordBatch:
    a, b = zip(*out) if out else ((), ())
    if across:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.list_(pa.int64()))], ["u", "partners"])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def small_nodes(vertices: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, rep) of vertices(rep, n, sk): the members of the small nodes of all trees, and those of the nodes
    that stay large, if there are any."""
    level = materialize(vertices.select("rep", "sk").mapInArrow(released(_roots), _NODE), "nodes")
    depth, small, large = FIRST_DEPTH, [], None
    while True:
        sizes = materialize(level.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
        small.append(level.join(sizes.filter(F.col("m") <= SMALL).select("node"), "node", "left_semi").select("node", "rep"))
        big = sizes.filter(F.col("m") > SMALL)
        if big.isEmpty():
            break
        rest = level.join(maybe_broadcast(big, 100_000), "node")
        if depth >= DEPTH:
            large = materialize(rest.select("node", "rep", "m").distinct(), "large")
            small.append(_blocks(large))
            break
        if depth == FIRST_DEPTH:  # from here on, the members of large nodes bring their sketches along
            rest = rest.join(vertices.select("rep", "sk"), "rep")
        level = materialize(rest.select("node", "rep", "sk").mapInArrow(released(_deeper), _NODE + ", sk binary"), "nodes")
        depth += 2
    nodes = small[0]
    for s in small[1:]:
        nodes = nodes.unionByName(s)
    return materialize(nodes, "nodes"), large


def candidates(nodes: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs (a < b) of the spanning forests of nodes(node, rep); sketches come from vertices(rep, n, short)."""
    members = nodes.join(vertices.select("rep", "n", "short"), "rep").select("node", "rep", "n", "short", F.col("rep").alias("label"))
    # nodes are small: a task holds one at a time, and hashing them spreads the rows evenly
    dealt = members.repartition("node").sortWithinPartitions("node", "rep")
    return dealt.mapInArrow(released(_compare(percent, False)), "a bigint, b bigint").distinct()


def suspects(vertices: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, n, short, label) of the vertices in the components between which pairs(a, b) lead; labels(v, label)
    names the components, and a vertex without a label is one of its own."""
    ends = pairs.join(labels.select(F.col("v").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b", "left")
    apart = ends.select(F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).filter("la <> lb")
    named = materialize(apart.select(F.col("la").alias("label")).union(apart.select("lb")).distinct(), "apart")
    return materialize(labelled(vertices, labels).join(maybe_broadcast(named), "label", "left_semi").select("rep", "n", "short", "label"), "suspects")


def across(nodes: DataFrame, docs: DataFrame, suspected: DataFrame, k: int, percent: int) -> DataFrame:
    """Likely pairs (a < b) in nodes(node, rep) of suspected(rep, n, short, label) whose labels differ."""
    few = maybe_broadcast(suspected.select("rep"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in sets_of(batch, 1, k):
                tokens = sketch(sets, _XOR_LONG, _MUL_LONG).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in tokens], pa.binary())], ["rep", "more"])

    rows = docs.join(few, docs["doc_id"] == few["rep"]).select("rep", "text")
    # a doc_id that repeats with other texts meets the sketches of all of them, which can only add pairs
    sketches = rows.mapInArrow(released(work), "rep bigint, more binary").distinct()
    known = materialize(suspected.join(sketches, "rep"), "sketches")
    mine = nodes.join(few, "rep", "left_semi")
    mixed = mine.join(suspected.select("rep", "label"), "rep").groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("node")
    members = mine.join(mixed, "node", "left_semi").join(known, "rep").select("node", "rep", "n", "short", "label", "more")
    dealt = members.repartition("node").sortWithinPartitions("node", "rep")
    # each partner once for each tree until here
    partners = dealt.mapInArrow(released(_compare(percent, True)), "u bigint, partners array<bigint>")
    each = partners.groupBy("u").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))
    return each.select("u", F.explode("partners").alias("p")).select(F.least("u", "p").alias("a"), F.greatest("u", "p").alias("b")).distinct()


def _blocks(rest: DataFrame) -> DataFrame:
    """Nodes that stay large: blocks of about half of SMALL members, each with the node's leaders."""
    cut = (F.col("m") / (SMALL // 2)).cast("int") + 1
    member = rest.withColumn("block", F.pmod(F.xxhash64("rep", "node"), cut))
    leaders = (
        rest.groupBy("node", F.pmod(F.xxhash64("rep"), F.lit(LEADERS)).alias("r"))
        .agg(F.min("rep").alias("rep"), F.max("m").alias("m"))
        .select("node", "rep", F.explode(F.sequence(F.lit(0).cast("bigint"), (cut - 1).cast("bigint"))).alias("block"))
    )
    both = member.select("node", "rep", "block").unionByName(leaders)
    return both.select(F.xxhash64("node", "block").alias("node"), "rep").distinct()


def labelled(vertices: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, n, short, label) of all vertices; one without a label stands for itself."""
    return vertices.join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").select("rep", "n", "short", F.coalesce("label", "rep").alias("label"))


def opposed(large: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, rep): blocks of large(node, rep) two by two, so that any two members with different labels(rep, label)
    meet. The members of a node's most frequent label need not meet each other: if few others are left, the
    rows grow with the members, and with their square only where a large node is not linked."""
    half = SMALL // 2
    members = large.select("node", "rep").join(labels.select("rep", "label"), "rep")
    counts = members.groupBy("node", "label").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"))
    plan = materialize(
        counts.filter("top.c < m").select("node", F.col("top.label").alias("mass"), F.expr(f"(m - top.c - 1) div {half} + 1").alias("q"), F.expr(f"(top.c - 1) div {half} + 1").alias("p")), "plan"
    )
    # blocks 0 to q - 1 hold the others and meet all blocks, the p blocks after them hold the most frequent label
    member = members.join(maybe_broadcast(plan, 100_000), "node").withColumn("h", F.xxhash64("rep", "node"))
    placed = member.select("node", "rep", "q", "p", F.when(F.col("label") == F.col("mass"), F.col("q") + F.expr("pmod(h, p)")).otherwise(F.expr("pmod(h, q)")).alias("x"))
    meets = placed.select("node", "rep", "x", F.explode(F.expr("sequence(0L, q - 1 + IF(x < q, p, 0L))")).alias("y")).filter("x <> y")
    return meets.select(F.xxhash64("node", F.least("x", "y"), F.greatest("x", "y")).alias("node"), "rep")


def _confirm(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, out = batch.column(0), batch.column(1), []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(out, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return work


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose full shingle sets are similar enough. docs(doc_id, text, key), reps only are used."""
    need = materialize(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "need")
    rows = docs.join(maybe_broadcast(need), docs["doc_id"] == need["rep"]).select("rep", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in sets_of(batch, 1, k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "words"])

    sets = materialize(rows.mapInArrow(released(work), "rep bigint, words binary"), "sets")
    left = sets.select(F.col("rep").alias("a"), F.col("words").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("words").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(released(_confirm(percent)), "a bigint, b bigint")


def shared_ids(full: DataFrame, vertices: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of one doc_id: full has (doc_id, key) of each row, vertices (key, rep)."""
    several = full.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").select("doc_id")
    several = materialize(several, "several")
    rows = full.select("doc_id", "key").join(maybe_broadcast(several), "doc_id").distinct()
    reps = rows.join(vertices.select("key", "rep"), "key").select("doc_id", "rep").distinct()
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return reps.join(least, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text).

    Words are stretches without ASCII white space, A-Z in lower case. Sets of distinct k-word shingles are
    linked if 100 * intersection >= percent * union; component_id is the smallest doc_id reachable. Null,
    empty and blank texts have an empty set and are linked with nothing; fewer than k words make one shingle.
    Rows with the same set share a component, and so do rows that repeat a doc_id; each row is returned. A null doc_id is linked with nothing and not kept. Other columns are ignored.
    """
    docs = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    prints = materialize(fingerprints(docs, k), "prints")
    full = prints.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    # one row for each distinct set: copies meet here, summed up before the shuffle
    least = full.groupBy("key").agg(F.min(F.struct("doc_id", "n", "sk")).alias("x")).select("key", F.col("x.doc_id").alias("rep"), "x.n", "x.sk")
    vertices = materialize(least.mapInArrow(released(_shortened), "key binary, rep bigint, n bigint, sk binary, short binary"), "vertices")
    nodes, large = small_nodes(vertices)
    pairs = materialize(candidates(nodes, vertices, percent), "pairs")
    links = confirmed(docs, pairs, k, percent).unionByName(shared_ids(full, vertices))
    found = components(materialize(links, "links"))
    # likely pairs that would still join two components, beyond those that were looked at
    suspected = suspects(vertices, pairs, found)
    if not suspected.isEmpty():
        more = materialize(across(nodes, docs, suspected, k, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            found = joined(vertices.select(F.col("rep").alias("v")), found, confirmed(docs, more, k, percent))
    if large is not None:
        every = labelled(vertices, found)
        blocks = materialize(opposed(large, every), "blocks")
        if not blocks.isEmpty():
            met = materialize(every.join(blocks.select("rep").distinct(), "rep", "left_semi"), "suspects")
            more = materialize(across(blocks, docs, met, k, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
            if not more.isEmpty():
                found = joined(vertices.select(F.col("rep").alias("v")), found, confirmed(docs, more, k, percent))
    labels = vertices.join(found, vertices["rep"] == found["v"], "left").select("key", F.coalesce("label", "rep").alias("component_id"))
    out = prints.select("doc_id", F.col("n").alias("n_shingles"), "key").join(labels, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )

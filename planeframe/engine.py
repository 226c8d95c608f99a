"""Whole frames: planes to packets and back.

A plane's rows move once, in order, and are coded slice by slice as they pass; every frame's slices meet once, when the
packet is put together. Back, slices are spread over tasks by their payloads, and each turns into rows by itself, since it
is as wide as its plane. So all planes are read, coded and decoded in one pass, whatever is asked of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from planeframe import tables as T
from planeframe.functions import binary as B
from planeframe.operators import block, coder, plane, sample
from planeframe.sources import packet


@dataclass(frozen=True)
class Config:
    """A frame's geometry and coding: 4:2:2 (0) or 4:4:4 (1) of `depth` bits; `rows` block rows a slice; with alpha, a
    fourth plane of 16 bits that is coded without loss."""

    width: int
    height: int
    qp: int = 40
    depth: int = 10
    pixel_format: int = 0
    matrix: int = 0
    rows: int = 2
    alpha: bool = False

    def size(self, chroma: bool) -> tuple[int, int]:
        return ((self.width + 1) // 2 if chroma and self.pixel_format == 0 else self.width), self.height

    def coded(self, chroma: bool) -> tuple[int, int]:
        w, h = self.size(chroma)
        return -(-w // 8) * 8, -(-h // 8) * 8

    def header(self) -> dict[str, int]:
        w, h = self.coded(False)
        minor = {(0, 10): 0, (0, 12): 1, (1, 10): 2, (1, 12): 2}[self.pixel_format, self.depth]
        return {
            "version_major": 1, "version_minor": max(minor, 4 if self.qp >= 64 else 0), "profile": 3, "pixel_format": self.pixel_format, "bit_depth": self.depth, "coded_width": w, "coded_height": h,
            "visible_width": self.width, "visible_height": self.height, "plane_count": 3 + self.alpha, "alpha_mode": int(self.alpha), "alpha_bit_depth": 16 * self.alpha, "qmatrix_id": self.matrix, "qp_base": self.qp, "color_range": 1, "color_primaries": 1, "color_transfer": 1, "color_matrix": 1,
        }


def blocks_of(planes: DataFrame, w: int, h: int) -> DataFrame:
    """(f, plane, by, bx, s) of planes(f, plane, y, s), grown to w x h."""
    rows = plane.padded(planes, ["f", "plane"], w, h).withColumn("by", F.floor(F.col("y") / 8).cast("bigint"))
    bands = rows.groupBy("f", "plane", "by").agg(F.array_sort(F.collect_list(F.struct("y", "s"))).alias("r"))  # eight rows each
    cut = lambda bx: F.struct(bx.cast("bigint").alias("bx"), F.flatten(F.transform("r", lambda r: F.slice(r["s"], bx * 8 + 1, 8))).alias("s"))
    return bands.select("f", "plane", "by", F.explode(F.transform(F.sequence(F.lit(0), F.lit(w // 8 - 1)), cut)).alias("x")).select("f", "plane", "by", "x.*")


@dataclass(frozen=True)
class Coding:
    """One slice of a colour plane, both ways, in numpy: samples (rows x columns) and blocks (n x 64, scan order)."""

    c: Config
    chroma: bool

    def steps(self) -> np.ndarray:
        return np.array([T.step(self.c.matrix, self.chroma, i, self.c.qp) for i in range(64)], np.int64)

    def levels(self, s: np.ndarray) -> np.ndarray:
        """As level_shift, forward, quantise and scan."""
        x = s.reshape(s.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 64) - (1 << self.c.depth - 1)
        x, q = block.transformed(x), self.steps()
        dead = np.where(np.arange(64) == 0, 0, q >> 2)
        size = np.maximum(np.minimum(np.abs(x), T.MAX_COEFFICIENT) + (q >> 1) - dead, 0) // q
        return np.where(x < 0, -size, size)[:, T.zigzag()]

    def samples(self, levels: np.ndarray, width: int) -> np.ndarray:
        """As unscan, dequantise and inverse, of blocks `width` of them side by side."""
        x = np.empty_like(levels)
        x[:, T.zigzag()] = levels
        x = block.restored(np.clip(x * self.steps(), -T.MAX_COEFFICIENT, T.MAX_COEFFICIENT))
        x = np.clip(x + (1 << self.c.depth - 1), 0, (1 << self.c.depth) - 1)
        return x.reshape(-1, width, 8, 8).swapaxes(1, 2).reshape(-1, width * 8)


def wide(values: pa.ListArray, w: int, fill: int) -> np.ndarray:
    """The rows as a matrix of w columns, the last sample of shorter ones repeated; fill where there is none."""
    flat = values.flatten()
    flat = (flat.fill_null(fill) if flat.null_count else flat).to_numpy()
    size = values.value_lengths().fill_null(0).to_numpy()
    if len(size) and (size == size[0]).all() and size[0] >= w:
        return flat.reshape(len(size), -1)[:, :w]
    at = (np.cumsum(size) - size)[:, None] + np.minimum(np.arange(w), np.maximum(size, 1)[:, None] - 1)
    return np.where(size[:, None] > 0, np.append(flat, fill)[np.minimum(at, len(flat))], fill)


def bands(batches: Iterator[pa.RecordBatch], c: Config) -> Iterator[tuple[object, int, int, np.ndarray]]:
    """f, plane, slice and samples (its coded rows and columns) of (f, plane, y, s) in that order, a slice at a time. The
    last row of a plane is repeated down to its end; a row that is missing before it is grey."""
    grey, tall = 1 << c.depth - 1, 8 * c.rows
    size = {p: c.coded(p > 0) for p in (0, 1, 2)}
    key, held, last = None, None, -1  # the slice at work, its samples, its last row so far

    def done(whole_plane: bool) -> Iterator[tuple[object, int, int, np.ndarray]]:
        f, p, n = key
        if not whole_plane:
            yield f, p, n, held
            return
        row, h = held[last - n * tall], size[p][1]
        held[last - n * tall :] = row
        yield f, p, n, held
        for more in range(n + 1, -(-h // tall)):
            yield f, p, more, np.tile(row, (min(tall, h - more * tall), 1))

    for batch in batches:
        f = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        plane, y = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        n = y // tall
        cut = np.flatnonzero((f[1:] != f[:-1]) | (plane[1:] != plane[:-1]) | (n[1:] != n[:-1])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(y)]):
            if lo == hi:
                continue
            now = batch.column(0)[lo].as_py(), int(plane[lo]), int(n[lo])
            w, h = size[now[1]]
            if now != key:
                if key is not None:
                    yield from done(now[:2] != key[:2])
                key, held = now, np.full((min(tall, h - now[2] * tall), w), grey, np.int64)
            held[y[lo:hi] - now[2] * tall] = wide(batch.column(3).slice(lo, hi - lo), w, grey)
            last = int(y[hi - 1])
    if key is not None:
        yield from done(True)


def encode(planes: DataFrame, c: Config) -> DataFrame:
    """(f, content): one packet for each frame of planes(f, plane, y, s), planes 0 to 2, and 3 with alpha."""
    rows = planes.filter(F.col("plane").isin(0, 1, 2) & (F.col("y") >= 0) & (F.col("y") < c.coded(False)[1]))
    rows = rows.select("f", F.col("plane").cast("bigint").alias("plane"), F.col("y").cast("bigint").alias("y"), F.col("s").cast("array<bigint>").alias("s"))
    names = ["plane", "slice", "end", "k1", "k2", "k3"]
    schema = StructType([rows.schema["f"], *[StructField(n, LongType()) for n in names], StructField("payload", BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, made, held = None, [], 0

        def batch() -> pa.RecordBatch:
            f, *numbers, payload = zip(*made)
            return pa.RecordBatch.from_arrays([pa.array(f, kind), *[pa.array(x, pa.int64()) for x in numbers], pa.array(payload, pa.binary())], ["f", *names, "payload"])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.column(0).type
                yield b

        for f, p, n, s in bands(seen(), c):
            made.append((f, p, n, n * c.rows + len(s) // 8, *coder.rice_payload(Coding(c, p > 0).levels(s), s.shape[1] // 8)))
            held += len(made[-1][-1])
            if len(made) == 1024 or held > 1 << 22:
                yield batch()
                made, held = [], 0
        if made:
            yield batch()

    s = rows.repartition("f", "plane").sortWithinPartitions("f", "plane", "y").mapInArrow(work, schema)
    if c.alpha:
        a = coder.residual_slice(alpha_bands(planes, c))
        s = s.unionByName(a.select("f", F.lit(3).cast("bigint").alias("plane"), "slice", "end", F.col("k_level").alias("k1"), F.col("k_run").alias("k2"), F.lit(0).cast("bigint").alias("k3"), "payload"))
    one = F.struct("plane", (F.col("slice") * c.rows).alias("block_y0"), (F.col("end") - F.col("slice") * c.rows).alias("block_h"), F.lit(64).alias("qp_delta_biased"), "k1", "k2", "k3", "payload")
    frames = s.groupBy("f").agg(F.array_sort(F.collect_list(one)).alias("slices"))
    return packet.built(frames, c.header(), F.col("slices")).select("f", "content")


def alpha_bands(planes: DataFrame, c: Config) -> DataFrame:
    """(f, slice, end, residuals) of plane 3: a slice's samples in raster order, less their predictions."""
    w, h = c.coded(False)
    rows = plane.padded(planes.filter("plane = 3").select("f", "y", "s"), ["f"], w, h).withColumn("slice", F.floor(F.col("y") / (8 * c.rows)).cast("bigint"))
    bands = rows.groupBy("f", "slice").agg(F.array_sort(F.collect_list(F.struct("y", "s"))).alias("r"))
    bands = bands.select("f", "slice", (F.col("slice") * c.rows + F.floor(F.size("r") / 8)).alias("end"), F.flatten(F.transform("r", lambda r: r["s"])).alias("s"))
    bands = block.held(bands, "s", F.col("s"))
    return bands.withColumn("residuals", F.transform(sample.med_residuals(F.col("s"), w), lambda x: x["resid"])).drop("s")


def slice_samples(c: Config, plane: int, block_h: int, ks: tuple[int, int, int], payload: bytes) -> tuple[bool, np.ndarray]:
    """Whether a slice's bytes are damaged, and its samples: then the middle of the range, opaque for alpha."""
    if plane == 3:
        w = c.coded(False)[0]
        bad, r = coder.safely(coder.band_residuals, block_h * 8 * w, *ks[:2], payload)
        return bad != 0, np.full((1, c.width), 65535) if bad else np.array(coder.med_samples(w, r), np.int64).reshape(-1, w)[:, : c.width]
    width, w = c.coded(plane > 0)[0] // 8, c.size(plane > 0)[0]
    bad, blocks = coder.safely(coder.rice_blocks, block_h * width, width, ks, payload)
    return bad != 0, np.full((1, w), 1 << c.depth - 1) if bad else Coding(c, plane > 0).samples(np.array(blocks, np.int64).reshape(-1, 64), width)[:, :w]


def slices_of(packets: DataFrame, c: Config) -> DataFrame:
    """(f, status, plane, block_y0, block_h, k1, k2, k3, payload: empty where its checksum fails) of the slices to decode;
    one row without a plane for a frame that has none."""
    p = packet.parsed(packets)
    own = F.filter("slices", lambda x: (F.col("status") >= 0) & (x["plane"] < 3 + c.alpha))
    cut = lambda x: F.struct(*[x[n].alias(n) for n in ("plane", "block_y0", "block_h", "k1", "k2", "k3")], F.when(x["ok"], B.piece(F.col("content"), x["off"], x["size"])).otherwise(F.unhex(F.lit(""))).alias("payload"))
    return p.select("f", "status", F.explode_outer(F.transform(own, cut)).alias("x")).select("f", "status", "x.*")


def decoded(packets: DataFrame, c: Config) -> DataFrame:
    """(f, plane, y, s, bad) of packets(f, content) of one configuration: all planes in one pass. bad is 1 in the rows of a
    slice whose bytes are damaged, which are filled with the middle of the range."""
    s = slices_of(packets, c).filter("plane IS NOT NULL AND f IS NOT NULL").drop("status")
    # what a slice decodes to is far larger than its bytes: as many tasks as any shuffle, not as few as the bytes would fill
    s = s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "f", "plane", "block_y0")
    schema = StructType([s.schema["f"], StructField("plane", LongType()), StructField("y", LongType()), StructField("s", ArrayType(LongType())), StructField("bad", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in coder.few(batches):
            made, held = [], 0
            for i, (plane, y0, block_h, *ks, payload) in enumerate(zip(*(x.to_pylist() for x in part.columns[1:]))):
                n = max(0, min(c.height - y0 * 8, block_h * 8))  # rows in the picture
                bad, x = slice_samples(c, plane, block_h, ks, payload)
                made.append((i, plane, y0 * 8, np.repeat(x, n, 0) if bad else x[:n], bad))
                held += made[-1][3].size
                if held > 1 << 20:
                    yield rows(part, made)
                    made, held = [], 0
            if made:
                yield rows(part, made)

    def rows(part: pa.RecordBatch, made: list[tuple[int, int, int, np.ndarray, bool]]) -> pa.RecordBatch:
        n = [len(x) for *_, x, _ in made]
        each = lambda values: np.repeat(np.array(values, np.int64), n)
        width = each([x.shape[1] for *_, x, _ in made])
        s = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)).astype(np.int32)), pa.array(np.concatenate([x.reshape(-1) for *_, x, _ in made])))
        y = np.concatenate([m[2] + np.arange(k) for m, k in zip(made, n)]).astype(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(each([m[0] for m in made]))), pa.array(each([m[1] for m in made])), pa.array(y), s, pa.array(each([m[4] for m in made]))], schema.names)

    return s.mapInArrow(work, schema)


def decode(packets: DataFrame, c: Config) -> tuple[DataFrame, DataFrame]:
    """(f, plane, y, s) and (f, status) of packets(f, content) of one configuration. A slice whose bytes are damaged is
    filled with the middle of the range and its frame has status 1; a frame whose structure is broken has no planes."""
    s = slices_of(packets, c)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in coder.few(batches):
            columns = zip(*(part.column(i).to_pylist() for i in (1, 2, 4, 5, 6, 7, 8)))
            out = [min(status, 0) if plane is None else int(slice_samples(c, plane, block_h, ks, payload)[0]) for status, plane, block_h, *ks, payload in columns]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.int32())], ["f", "status"])

    status = s.mapInArrow(work, StructType([s.schema["f"], StructField("status", IntegerType())])).groupBy("f").agg(F.max("status").alias("status"))
    return decoded(packets, c).drop("bad"), status


def sized_qp(scanned: DataFrame, by: list[str], target: Column, books: tuple[list[int], list[int], list[int]], qps: range = range(T.QP_MAX + 1)) -> DataFrame:
    """(by, qp, bits): of scanned(by, coef: unquantised, in scan order) the smallest qp whose bits fit the target (an
    aggregate of the group), else the largest. Bits are summed up by qp before they move."""
    each = coder.coded_bits(scanned, by, [(q, T.flat_step(q)) for q in qps], *books)
    costs = each.groupBy(*by, "qp").agg(F.sum("bits").alias("bits"), F.count("*").alias("blocks"))
    fits = F.min(F.when(F.col("bits") <= target, F.struct("qp", "bits")))
    last = F.max(F.struct("qp", "bits"))
    return costs.groupBy(*by).agg(F.coalesce(fits, last).alias("x")).select(*by, "x.qp", "x.bits")


def encode_tier(planes: DataFrame, c: Config, bpp: float, books: tuple[list[int], list[int], list[int]]) -> DataFrame:
    """(f, content) with a qp for the whole sequence: the smallest whose mean frame stays within bpp bits a pixel."""
    from dataclasses import replace

    luma = planes.filter("plane = 0")
    b = block.scan(block.forward(block.level_shift(blocks_of(luma, *c.coded(False)), F.col("s"), c.depth).drop("s")))
    frames = luma.select("f").distinct().count()
    budget = bpp * c.width * c.height * frames
    row = sized_qp(b.withColumn("all", F.lit(1)), ["all"], F.lit(budget), books).first()
    return encode(planes, replace(c, qp=int(row["qp"]) if row else c.qp))


def in_order(rows: DataFrame) -> DataFrame:
    """Frames put back in order after parallel work."""
    return rows.orderBy("f", "plane", "y")

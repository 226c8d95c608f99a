"""What the second review found."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planeframe import engine
from planeframe import plans as core
from planeframe.functions import binary as B
from planeframe.functions import scalar
from planeframe.operators import block, coder
from planeframe.sources import movie, packet


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_joined_by_shuffles(spark):
    """What a row explodes into is far larger than Spark takes it to be: no such side may go to every task."""
    runs = spark.createDataFrame([(1, 1, 2), (1, 3, 1)], "movie bigint, first bigint, per bigint")
    chunks = spark.range(1, 1001).select(F.lit(1).cast("bigint").alias("movie"), F.col("id").alias("chunk"), (F.col("id") * 100).alias("off"))
    sizes = spark.sql("SELECT bigint(1) AS movie, explode(sequence(bigint(0), bigint(1001))) AS idx").withColumn("size", F.col("idx") % 7 + 1)
    out = movie.chunk_samples(runs, chunks, sizes, ["movie"])
    assert "BroadcastHashJoin" not in final_plan(out)
    got = {r.idx: (r.chunk, r.off) for r in out.collect()}
    assert len(got) == 1002 and got[0] == (1, 100) and got[1] == (1, 101) and got[3] == (2, 203) and got[4] == (3, 300) and got[1001] == (1000, 100000)


def test_a_run_behind_the_last_chunk_holds_nothing(spark):
    runs = spark.createDataFrame([(1, 1, 2), (1, 9, 3)], "movie bigint, first bigint, per bigint")
    chunks = spark.createDataFrame([(1, 1, 100), (1, 2, 200)], "movie bigint, chunk bigint, off bigint")
    sizes = spark.createDataFrame([(1, i, 10) for i in range(12)], "movie bigint, idx bigint, size bigint")
    got = sorted(tuple(r) for r in movie.chunk_samples(runs, chunks, sizes, ["movie"]).collect())
    assert got == [(1, 0, 1, 100, 10), (1, 1, 1, 110, 10), (1, 2, 2, 200, 10), (1, 3, 2, 210, 10)]


@pytest.mark.parametrize("hours", [99, 100, 308, 1234])
def test_timecodes_beyond_a_hundred_hours(spark, hours):
    frame = hours * 6 * 17982 + 1800
    r = spark.range(1).select(scalar.timecode(F.lit(frame)).alias("t")).select("t", scalar.timecode_frames(F.col("t")).alias("back"), scalar.two_hour_digits(F.col("t")).alias("short")).first()
    assert (r.t, r.back, r.short) == (f"{hours}:01:00;02", frame, f"{str(hours)[:2]}:01:00;02")


def test_a_frame_with_fewer_rows_is_a_whole_picture(spark, tmp_path):
    """23 vectors: a frame of 20 rows and one of three, which is coded and counted with its last row repeated."""
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 23").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.f: (r.samples, r.close) for r in core.QUERIES["image_decode"](spark, str(tmp_path)).collect()}
    assert got == {0: (640, True), 1: (640, True)}


class Given:
    """Stands for a DataFrame: hands out the function that would work on its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):
        return work


def peak_of(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_workers_hold_one_movie_not_a_batch(spark):
    """Forty movies of 2,500 samples in one batch: what Python holds does not grow with the movies in it."""
    sample = [{"data": b"x" * 20, "dur": i % 2 + 1, "sync": i == 0} for i in range(2500)]
    kinds = pa.list_(pa.struct([("data", pa.binary()), ("dur", pa.int64()), ("sync", pa.bool_())]))
    same = {"timescale": 25, "width": 60, "height": 20, "config": [("profile", 3), ("bit_depth", 10)], "meta": {"tier": 1, "tc_start": 7, "tc_fps": 30, "tc_drop": 1}}
    config = pa.map_(pa.string(), pa.int64())
    n = 40
    columns = {"movie": pa.array(range(n)), "samples": pa.array([sample] * n, kinds), "config": pa.array([same["config"]] * n, config), **{k: pa.array([same[k]] * n) for k in ("timescale", "width", "height", "meta")}}
    batch = pa.RecordBatch.from_pydict(columns)
    files, peak = peak_of(lambda: [b for b in movie.written(Given())(iter([batch]))])
    assert peak < 6 << 20
    want = movie.write({"samples": sample, "timescale": 25, "width": 60, "height": 20, "config": dict(same["config"]), "tier": 1, "timecode": {"start": 7, "fps": 30, "drop": 1}})
    assert {c for b in files for c in b.column("content").to_pylist()} == {want} and sum(map(len, files)) == n
    rows, peak = peak_of(lambda: [len(b) for b in movie.index_of(Given())(iter(files))])
    assert sum(rows) == n and peak < 2 << 20


def test_a_run_of_durations_is_not_expanded_unchecked():
    """A damaged count of four million durations for five samples: refused without a list of that length."""
    data = bytearray(movie.write({"samples": [{"data": b"x", "dur": 1, "sync": True}] * 5, "timescale": 25, "width": 8, "height": 8, "config": {"profile": 3, "bit_depth": 10}}))
    at = data.index(b"stts") + 12
    assert data[at : at + 4] == b"\0\0\0\5"
    data[at : at + 4] = (1 << 22).to_bytes(4, "big")

    def refused():
        with pytest.raises(movie.Malformed):
            movie.read(bytes(data))

    assert peak_of(refused)[1] < 1 << 20


def test_bytes_of_samples_without_a_join(spark):
    m = {"samples": [{"data": bytes([65 + i]) * (i % 3), "dur": 1, "sync": True} for i in range(8)], "timescale": 25, "width": 8, "height": 8, "config": {"profile": 3, "bit_depth": 10}}
    df = spark.createDataFrame([(1, bytearray(movie.write(m))), (2, bytearray(b"broken")), (3, None)], "movie bigint, content binary")
    got = movie.packets(df, 2, 5)
    assert [(r.movie, r.idx, bytes(r.data)) for r in got.orderBy("idx").collect()] == [(1, 2, b"CC"), (1, 3, b""), (1, 4, b"E")]
    assert "Join" not in final_plan(got)
    assert movie.packets(df).count() == 8


def test_fields_are_read_a_few_at_a_time(spark):
    """Fields of 1 to 4 bytes one after another, whole and cut off anywhere: the same as each by itself."""
    layout = [("a", 2), ("b", 1), ("c", 4), ("d", 1), ("e", 4), ("f", 4), ("g", 2)]
    raw = bytes(range(240, 256)) + b"\0\1\xff\x80"
    df = spark.createDataFrame([(n, bytearray(raw[:n])) for n in range(len(raw) + 1)] + [(99, None)], "n int, content binary")
    each, at = [], 2
    for name, n in layout:
        each.append(B.be(F.col("content"), at, n).alias(name))
        at += n
    rows = df.select("n", B.be_struct(F.col("content"), layout, 2).alias("got"), F.struct(*each).alias("want")).collect()
    assert len(rows) == 22 and all(r.got == r.want for r in rows)
    values = [(F.lit(v), n) for v, n in ((258, 2), (255, 1), (-1, 4), (300, 1), (1 << 31, 4))]
    both = spark.range(1).select(B.to_be_all(values).alias("a"), F.concat(*[B.to_be(v, n) for v, n in values]).alias("b")).first()
    assert both.a == both.b and len(both.a) == 12
    # a header's 29 fields are not 29 numbers made from text
    text = df.select(packet.header(F.col("content")).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("conv(") < 12


def test_slices_are_decoded_a_few_at_a_time(spark):
    """2,000 slices of 16 zero blocks in one batch: they are not all held as lists."""
    n = 2000
    one = {"id": pa.int64(), "n": pa.int32(), "width": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "k3": pa.int64(), "payload": pa.binary()}
    values = {"n": 16, "width": 8, "k1": 0, "k2": 0, "k3": 6, "payload": b"\x3f" * 16}
    batch = pa.RecordBatch.from_pydict({k: pa.array(range(n) if k == "id" else [values[k]] * n, t) for k, t in one.items()})
    work = coder.rice_decode(Given())
    rows, peak = peak_of(lambda: sum(len(b) for b in work(iter([batch])) if not any(b.column("status").to_pylist())))
    assert rows == n and peak < 4 << 20


def test_damaged_frames_are_coded_and_read_once(spark):
    """Luma, chroma and status come from one pass: the table was read 14 times, and cut and joined by 47 shuffles."""
    text = core.QUERIES["codec_damage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1 and text.count("MapInArrow") == 2 and text.count("Exchange") <= 6 and "Join" not in text


def test_a_slice_is_coded_as_its_tokens(spark):
    """Levels of all sizes, long codes among them, zero blocks and full ones: the payload of all symbols at once is that
    of the bit text, and reads back."""
    rng, cases = np.random.default_rng(11), []
    for i, (rows, width, most) in enumerate([(1, 1, 1), (2, 3, 3), (1, 5, 300), (2, 2, 1 << 24)]):
        x = np.where(rng.random((rows * width, 64)) < (0.2, 0.9)[i % 2], rng.integers(-most, most, (rows * width, 64)), 0)
        x[0, 1:] = 0
        cases.append((i, width, x))
    cases.append((4, 2, np.zeros((4, 64), np.int64)))
    cases.append((5, 8, np.pad([[0, 50000]], ((0, 15), (0, 62)))))  # an outlier among zeros: its code is the long one
    flat = []
    for i, width, x in cases:
        dc = x[:, 0].tolist()
        flat += [(i, n, v.tolist(), coder.dc_pred(dc[n - 1] if n % width else None, dc[n - width] if n >= width else None)) for n, v in enumerate(x)]
    df = coder.tokens(block.run_level(spark.createDataFrame(flat, "id bigint, n bigint, coef array<bigint>, pred bigint")))
    each = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("x")).select("id", F.transform("x", lambda x: x["token"]).alias("tokens"))
    want = {r.id: (r.k1, r.k2, r.k3, bytes(r.payload)) for r in coder.rice_slice(each).collect()}
    for i, width, x in cases:
        got = coder.rice_payload(x, width)
        assert got == want[i]
        assert coder.rice_blocks(len(x), width, got[:3], got[3]) == x.tolist()


def test_rows_in_any_batches_and_rows_that_lack(spark):
    """Rows of three frames: whole, cut short (its last row goes on to the end) and with a gap (grey). The size of the
    batches and the order of the rows do not matter."""
    c = engine.Config(20, 40, 0, rows=2)
    line = lambda f, p, y, n: [(f * 31 + p * 300 + y * 11 + x * 37) % 1024 for x in range(n)]
    rows = [(f, p, y, line(f, p, y, 10 if p else 20)) for f in range(3) for p in range(3) for y in range(40) if not (f == 1 and y > 12 or f == 2 and y == 3)]
    df = spark.createDataFrame(rows[::-1], "f bigint, plane bigint, y bigint, s array<bigint>")
    got = []
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got.append({r.f: bytes(r.content) for r in engine.encode(df, c).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and len(got[0]) == 3
    out, status = engine.decode(spark.createDataFrame([(f, bytearray(x)) for f, x in got[0].items()], "f bigint, content binary"), c)
    back = {(r.f, r.plane, r.y): r.s for r in out.collect()}
    assert len(back) == 3 * 3 * 40 and all(back[f, p, y] == s for f, p, y, s in rows)
    assert all(back[1, p, y] == line(1, p, 12, 10 if p else 20) for p in range(3) for y in range(13, 40)) and back[2, 0, 3] == [512] * 20
    assert {r.f: r.status for r in status.collect()} == {0: 0, 1: 0, 2: 0}


def test_status_of_broken_frames(spark):
    """A broken header, a payload with a wrong checksum and a whole frame."""
    c = engine.Config(16, 16, 20, rows=1)
    rows = [(f, p, y, [(f + p + y * 40 + x * 9) % 1024 for x in range(8 if p else 16)]) for f in range(3) for p in range(3) for y in range(16)]
    made = engine.encode(spark.createDataFrame(rows, "f bigint, plane bigint, y bigint, s array<bigint>"), c)
    at = packet.HEADER_SIZE + packet.SLICE_SIZE
    bad = F.when(F.col("f") == 0, F.expr("substring(content, 1, 20)")).when(F.col("f") == 1, F.expr(f"concat(substring(content, 1, {at}), X'5A', substring(content, {at + 2}, octet_length(content)))")).otherwise(F.col("content"))
    out, status = engine.decode(made.withColumn("content", bad), c)
    back = {(r.f, r.plane, r.y): r.s for r in out.collect()}
    assert {r.f: r.status for r in status.collect()} == {0: packet.TRUNCATED, 1: 1, 2: 0}
    assert {f for f, _, _ in back} == {1, 2} and len(back) == 2 * 3 * 16
    assert all(back[1, 0, y] == [512] * 16 for y in range(8)) and all(back[1, 0, y] != [512] * 16 for y in range(8, 16))

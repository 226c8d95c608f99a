"""The core queries against their SQL, and properties that do not come from that SQL."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from planeframe import plans as core
from planeframe import tables as T
from planeframe.functions import scalar
from planeframe.operators import block, control, index, sample
from planeframe.streaming import gop

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: Whole frames through several decodes take half a minute each; the smaller frames of test_files.py always run.
SLOW = {"codec_roundtrip", "codec_damage", "image_decode"}


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_oracle(spark, duck, name):
    if name in SLOW and not os.environ.get("PLANEFRAME_SLOW"):
        pytest.skip("slow")
    got = core.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(core.ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-6, rtol=0)


def test_tables():
    rows = T.M
    for a in range(8):
        for b in range(8):
            assert sum(x * y for x, y in zip(rows[a], rows[b])) == (T.E[a] if a == b else 0)
    assert sorted(T.zigzag()) == list(range(64)) and T.zigzag()[:6] == [0, 1, 8, 16, 9, 2]
    assert [T.qp_scale(q) for q in (0, 7, 8, 63, 64, 95)] == [1, 2, 2, 27555, 32768, 7053950]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partition_count_does_not_matter(spark, parts):
    want = core.QUERIES["gop_state"](spark, SF).toPandas().sort_values(["user_id", "event_id"]).reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = core.QUERIES["gop_state"](spark, SF).toPandas().sort_values(["user_id", "event_id"]).reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(got, want)


def test_zero_block_and_last_coefficient(spark):
    df = spark.createDataFrame([(0, [0] * 64), (1, [0] * 63 + [5])], "blk bigint, coef array<bigint>")
    got = {r.blk: [tuple(p) for p in r.pairs] for r in block.run_level(df).collect()}
    assert got == {0: [], 1: [(62, 5)]}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8])
def test_lifting_of_any_length(spark, n):
    df = spark.createDataFrame([([(i * 37) % 101 - 50 for i in range(n)],)], "s array<bigint>")
    low, d = sample.lift2(F.col("s"))
    df = df.withColumn("low", low).withColumn("d", d)
    df = df.withColumn("even", sample.unlift2_even(F.col("low"), F.col("d")))
    assert df.select(sample.unlift2(F.col("even"), F.col("d")).alias("b"), "s").collect()[0].b == df.collect()[0].s


def test_timecode_at_the_minute(spark):
    df = spark.createDataFrame([(1799,), (1800,), (17981,), (17982,)], "f bigint").select("f", scalar.timecode(F.col("f")).alias("t"))
    assert [r.t for r in df.orderBy("f").collect()] == ["00:00:59;29", "00:01:00;02", "00:09:59;29", "00:10:00;00"]


def test_tiling_gap_and_overlap(spark):
    rows = [(1, 0, 2, 4), (1, 2, 2, 4), (2, 0, 2, 4), (3, 0, 3, 4), (3, 2, 2, 4), (4, 1, 3, 4)]
    df = spark.createDataFrame(rows, "k int, lo int, h int, total int")
    assert {r.k: r.ok for r in index.tiling(df, ["k"], "lo", "h", "total").collect()} == {1: True, 2: False, 3: False, 4: False}


def test_containment_beyond_32_bits(spark):
    s = spark.createDataFrame([(1, 2**32 - 1, 4), (1, 2**32 + 5, 4)], "m int, off bigint, size bigint")
    r = spark.createDataFrame([(1, 2**32 - 4, 2**32 + 4)], "m int, lo bigint, hi bigint")
    assert [x.off for x in index.uncontained(s, r, ["m"]).collect()] == [2**32 + 5]


def test_debt_is_lent_and_paid_back(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([10, 100, 0, 0, 10])], "k int, i int, size bigint")
    got = control.debt_ledger(df, ["k"], ["i"], 10).orderBy("i").collect()
    assert [r.debt for r in got] == [0, 30, 20, 10, 10]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, (i * 7 + k) % 5 == 0, -11 if (i * 3 + k) % 11 == 0 else 0, i // 9) for k in range(3) for i in range(40)]
    schema = "key bigint, idx bigint, is_i boolean, status int, gop_id bigint"
    sizes = [(k, i, (i * 37 + k * 11) % 140 + (400 if i % 13 == 7 else 0)) for k in range(3) for i in range(40)]
    for part in range(2):  # two files, taken in turn
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        spark.createDataFrame([r for r in sizes if r[1] // 20 == part], "key bigint, idx bigint, size bigint").coalesce(1).write.parquet(str(tmp_path / "sizes"), mode="append")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def streamed(made, name):
        q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    try:
        frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = {(r.key, r.idx): (r.state, r.code) for r in streamed(gop.stream_states(frames), "states")}
        packets = spark.readStream.schema("key bigint, idx bigint, size bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "sizes"))
        qps = {(r.key, r.idx): r.qp for r in streamed(gop.stream_qp(packets, 50), "qps")}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    batch = gop.with_state(spark.createDataFrame(rows, schema), F.col("is_i"), F.col("status"), F.col("gop_id"), ["key"], ["idx"])
    assert got == {(r.key, r.idx): (r.state, r.code) for r in batch.collect()}
    walked = control.qp_feedback(spark.createDataFrame(sizes, "key bigint, idx bigint, size bigint"), ["key"], ["idx"], 50.0)
    assert qps == {(r.key, r.idx): r.qp for r in walked.collect()}


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_walks_in_parts(spark, part):
    rows = [(k, i, (i * i * 7 + k * 3) % 19 - 9) for k in range(2) for i in range(30)]
    got = control.clamped_walk(spark.createDataFrame(rows, "k int, i int, s int"), ["k"], ["i"], "s", 5, 0, 20, "at", part).collect()
    want, now = {}, {}
    for k, i, s in rows:
        now[k] = want[k, i] = max(0, min(20, now.get(k, 5) + s))
    assert {(r.k, r.i): r["at"] for r in got} == want


@pytest.mark.parametrize("width", [1, 16, 4096])
def test_containment_in_buckets(spark, width):
    import random

    rng = random.Random(width)
    s = [(rng.randrange(3), rng.randrange(200), rng.randrange(30)) for _ in range(120)]
    r = [(rng.randrange(3), lo, lo + rng.randrange(60)) for lo in (rng.randrange(200) for _ in range(40))]
    want = sorted(x for x in set(s) if not any(m == x[0] and lo <= x[1] < hi and x[2] <= hi - x[1] for m, lo, hi in r))
    sd, rd = spark.createDataFrame(list(set(s)), "m int, off bigint, size bigint"), spark.createDataFrame(r, "m int, lo bigint, hi bigint")
    assert sorted(map(tuple, index.uncontained(sd, rd, ["m"], width).collect())) == want


def test_a_frame_is_taken_back():
    at = gop.Reference()
    assert (at.observe(False, 0, 1), at.state) == (gop.MALFORMED, gop.NO_REF)
    assert (at.observe(True, 0, 1), at.state) == (gop.ACCEPTED, gop.READY)
    assert (at.observe(True, 0, 2), at.group) == (gop.ACCEPTED, 2)
    at.abort()
    assert (at.state, at.group) == (gop.READY, 1) and at.observe(False, 0, 2) == gop.MALFORMED and at.observe(False, 0, 1) == 0
    assert (at.observe(False, -11, 1), at.state) == (-11, gop.INVALID) and at.observe(False, 0, 1) == gop.REFERENCE

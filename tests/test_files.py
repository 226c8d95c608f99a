"""Coders, packets, movies, images, planes and sinks beyond what their SQL says."""

import heapq
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from planeframe import engine
from planeframe.functions import binary as B
from planeframe.functions import tables
from planeframe.operators import coder, metric, plane, sample
from planeframe.sources import files, movie, packet, synthetic


def movie_of(n, **more):
    rng = random.Random(n)
    samples = [{"data": bytes(rng.randrange(256) for _ in range(rng.randrange(1, 40))), "dur": rng.choice([1, 1, 2]), "sync": i % 5 == 0} for i in range(n)]
    return {"samples": samples, "timescale": 25, "width": 64, "height": 20, "config": {"profile": 3, "bit_depth": 10}, **more}


def test_crc_vector(spark):
    assert zlib.crc32(b"123456789") == 0xCBF43926
    assert spark.range(1).select(F.crc32(F.lit("123456789").cast("binary")).alias("c")).first().c == 0xCBF43926


@pytest.mark.parametrize("bits", ["", "1", "10110011", "1" * 33, "0" * 31 + "1" + "01" * 40])
def test_bits_are_packed(spark, bits):
    want = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert bytes(spark.createDataFrame([(bits,)], "b string").select(B.packed(F.col("b")).alias("p")).first().p) == want


def test_integers_go_both_ways(spark):
    rows = [(0, 1), (255, 1), (65535, 2), (4294967295, 4), (1 << 40, 8)]
    for v, n in rows:
        raw = spark.createDataFrame([(v,)], "v bigint").select(B.to_be(F.col("v"), n).alias("b")).first().b
        assert bytes(raw) == v.to_bytes(n, "big")
    cut = spark.createDataFrame([(bytearray(b"\1\2"),)], "b binary").select(B.be(F.col("b"), 1, 2).alias("v")).first().v
    assert cut is None


def test_lengths_are_the_cheapest():
    """Without a limit that binds they cost what a Huffman code costs; with one they still fill the code."""
    rng = random.Random(4)
    for _ in range(40):
        weights = [rng.randrange(1, 200) for _ in range(rng.randrange(2, 30))]
        heap, cost = list(weights), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        free = coder.limited_lengths(weights, 24)
        assert sum(w * n for w, n in zip(weights, free)) == cost
        tight = coder.limited_lengths(weights, 5)
        assert max(tight) <= 5 and sum(2 ** (5 - n) for n in tight) == 32
    with pytest.raises(ValueError):
        coder.limited_lengths([1] * 33, 5)


def test_models_keep_every_symbol():
    rng = random.Random(5)
    for _ in range(200):
        counts = [rng.choice([0, 1, 2, 900, 10**6]) for _ in range(rng.randrange(1, 64))]
        if any(counts):
            f = coder.normalised(counts)
            assert sum(f) == 4096 and all((c > 0) == (n > 0) for c, n in zip(counts, f))
    seq = [rng.randrange(7) for _ in range(3000)]
    freq = coder.normalised([seq.count(i) for i in range(7)])
    data = coder.rans_encode(seq, freq)
    assert coder.rans_decode(data, len(seq), freq) == seq
    with pytest.raises(EOFError):
        coder.rans_decode(data[: len(data) // 2], len(seq), freq)


def test_escapes_and_damage(spark):
    """Values beyond the longest prefix, cut payloads and values out of their domain."""
    blocks = [[40000, 0, -3000000] + [0] * 60 + [7], [0] * 64]
    tokens = [{"dc": 80000, "pairs": [{"run": 1, "level": 5999999}, {"run": 60, "level": 14}]}, {"dc": 79999, "pairs": []}]
    df = spark.createDataFrame([(1, tokens)], "id bigint, tokens array<struct<dc:bigint,pairs:array<struct<run:bigint,level:bigint>>>>")
    s = coder.rice_slice(df).select("id", F.lit(2).alias("n"), F.lit(1).alias("width"), F.lit(0).cast("bigint").alias("k1"), "k2", "k3", "payload")
    # k1 as 0 makes the DC an escape: code it again by hand
    k = coder.rice_slice(df).first()
    whole = coder.rice_slice(df).select("id", F.lit(2).alias("n"), F.lit(1).alias("width"), "k1", "k2", "k3", "payload")
    assert coder.rice_decode(whole).first().blocks == blocks
    cut = whole.withColumn("payload", F.expr("substring(payload, 1, octet_length(payload) - 4)"))
    assert (coder.rice_decode(cut).first().status, coder.rice_decode(cut).first().blocks) == (-10, None)
    assert coder.rice_decode(s).first().status in (-9, -10) and k.k1 > 0
    code = spark.createDataFrame([(31 << 3, 3), (30 << 3, 3)], "m bigint, k bigint").select(coder.rice_code(F.col("m"), F.col("k")).alias("c")).collect()
    assert code[0].c == "1" * 31 + format(31 << 3, "032b") and code[1].c == "1" * 30 + "0" + "000"


def test_refinement_never_costs_more(spark):
    rng = random.Random(6)
    level, run = [1 + i for i in range(28)], [2 + i // 4 for i in range(64)]
    step = 16
    coef = [[rng.randrange(-60, 60) for _ in range(64)] for _ in range(20)]
    levels = [[round(c / step) for c in b] for b in coef]
    df = spark.createDataFrame([(i, c, v, [step] * 64) for i, (c, v) in enumerate(zip(coef, levels))], "id bigint, coef array<bigint>, levels array<bigint>, steps array<bigint>")
    price = 0.080 * 2.0 ** ((60 - 52) / 4) * step**2

    def cost(c, v):
        bits, at = run[63], 0
        for i in range(1, 64):
            if v[i]:
                cat = (2 * v[i] if v[i] > 0 else -2 * v[i] - 1).bit_length()
                bits, at = bits + run[i - at - 1] + level[cat] + max(cat - 1, 0), i
        return sum((a - b * step) ** 2 for a, b in zip(c, v)) + price * bits

    got = {r.id: r.levels for r in coder.refined(df, 60, level, run).collect()}
    assert all(cost(coef[i], got[i]) <= cost(coef[i], levels[i]) + 1e-6 and got[i][0] == levels[i][0] for i in got)
    assert any(got[i] != levels[i] for i in got)


def test_movies_both_layouts():
    m = movie_of(12, tier=4, vendor="v", label="hq", timecode={"start": 77, "fps": 30, "drop": 1}, audio=[{"codec": "lpcm", "rate": 96000, "channels": 2, "bits": 24, "priming": 0, "chunks": [{"data": b"abcd", "dur": 1024}]}])
    plain, fast = movie.write(m), movie.write(m, faststart=True)
    assert movie.rewritten(plain) == fast and movie.rewritten(fast) == b""
    for data in (plain, fast):
        got = movie.read(data)
        assert [data[o : o + n] for o, n, *_ in got["samples"]] == [s["data"] for s in m["samples"]]
        assert (got["tier"], got["label"], got["timecode"], got["audio"][0]["rate"]) == (4, "hq", {"start": 77, "fps": 30, "drop": 1}, 96000)
        assert [data[c[0] : c[0] + c[1]] for c in got["audio"][0]["chunks"]] == [b"abcd"]
    assert movie.write(m) == plain  # the same bytes again


def test_foreign_atoms_are_skipped_and_broken_files_refused():
    data = movie.write(movie_of(5))
    extra = movie.atom("free", b"x" * 9)
    assert movie.read(data + extra)["samples"] == movie.read(data)["samples"]
    broken = [data[:30], data[: len(data) - 3], data + data[data.index(b"moov") - 4 :], data.replace(b"TPIC", b"AVC1"), data.replace(b"stts", b"sttz"), data.replace(b"TPCC\0\1\3", b"TPCC\0\1\5")]
    for bad in broken:
        with pytest.raises(ValueError):
            movie.read(bad)


def test_wide_offsets():
    assert movie._offsets([1, movie.UINT32])[4:8] == b"stco" and movie._offsets([1, movie.UINT32 + 1])[4:8] == b"co64"


def test_tables_in_sql(spark):
    tables.register(spark)
    spark.createDataFrame([(1, bytearray(movie.write(movie_of(7))))], "id bigint, content binary").createOrReplaceTempView("movies")
    assert spark.sql("SELECT s.* FROM movies, LATERAL movie_samples(content) s").count() == 7
    assert {r.path for r in spark.sql("SELECT a.path FROM movies, LATERAL movie_atoms(content) a").collect()} >= {"ftyp", "mdat", "moov/trak/mdia/minf/stbl/stsz"}
    assert [r.value for r in spark.sql("SELECT r.value FROM VALUES (unhex('A4')) t(p), LATERAL rice_symbols(p, 1, 3) r ORDER BY r.at").collect()] == [3, 0, 2]


def test_files_are_committed_as_a_whole(spark, tmp_path):
    files.register(spark)
    folder = str(tmp_path / "out")
    df = spark.createDataFrame([(f"m{i}.mov", bytearray(movie.write(movie_of(i + 1)))) for i in range(4)], files.SCHEMA)
    df.repartition(3).write.format("planefiles").option("path", folder).mode("append").save()
    assert sorted(os.listdir(folder)) == [f"m{i}.mov" for i in range(4)]
    back = spark.read.format("planefiles").option("path", folder).load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    found = files.movies(spark, folder)
    assert sorted(r.n for r in found.select(F.size("samples").alias("n")).collect()) == [1, 2, 3, 4]
    # a writer that died after its journal, and one that died before
    os.makedirs(f"{folder}/_staging")
    with open(f"{folder}/_staging/a", "wb") as f:
        f.write(b"new")
    with open(f"{folder}/_journal.json", "w") as f:
        f.write('[["a", "m0.mov"]]')
    assert files.recover(folder) == "finished"
    with open(f"{folder}/m0.mov", "rb") as f:
        assert f.read() == b"new"
    os.makedirs(f"{folder}/_staging")
    open(f"{folder}/_staging/b", "wb").close()
    assert (files.recover(folder), files.recover(folder)) == ("dropped", "clean")
    with pytest.raises(Exception, match="not a file's name"):
        spark.createDataFrame([("../x", bytearray(b""))], files.SCHEMA).write.format("planefiles").option("path", folder).mode("append").save()
    assert not os.path.exists(f"{folder}/_staging")


def test_base_layers_read_no_residual(spark, tmp_path):
    rows = [(0, y, [(x * 7 + y * 31) % 1024 for x in range(32)]) for y in range(16)]
    p = spark.createDataFrame(rows, "f bigint, y bigint, s array<bigint>")
    base = plane.area_down(p, ["f"], (32, 16), (8, 4))
    both = plane.base_residual(p, base, ["f"], (32, 16), (8, 4), 1)
    assert plane.with_residual(both, 1, 10).filter("s <> transform(s, x -> x)").count() == 0
    back = {r.y: r.s for r in plane.with_residual(both.drop("s"), 1, 10).collect()}
    assert back == {y: s for _, y, s in rows}
    both.select("f", "y", "pred", "r").write.parquet(str(tmp_path / "layers"))
    plan = spark.read.parquet(str(tmp_path / "layers")).select("f", "y", "pred")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<f:bigint,y:bigint,pred:array<bigint>>" in plan


@pytest.mark.parametrize("w, h", [(33, 17)])
def test_frames_of_odd_sizes(spark, w, h):
    """At the finest step nothing is lost, and chroma of an odd width is as wide as its half rounded up."""
    c = engine.Config(w, h, 0)
    sizes = [(w, h), ((w + 1) // 2, h), ((w + 1) // 2, h)]
    rows = [(f, p, y, [(x * 37 + y * 11 + f * 5 + p * 300) % 1024 for x in range(a)]) for f in range(2) for p, (a, b) in enumerate(sizes) for y in range(b)]
    made = engine.encode(spark.createDataFrame(rows, "f bigint, plane bigint, y bigint, s array<bigint>"), c)
    out, status = engine.decode(made, c)
    assert {(r.f, r.plane, r.y): r.s for r in out.collect()} == {(f, p, y): s for f, p, y, s in rows}
    assert {r.status for r in status.collect()} == {0}


def test_grain_draws_in_raster_order(spark):
    got = synthetic.grain(spark.createDataFrame([(0, 5), (1, 5), (2, 6)], "f bigint, seed bigint"), 50, 4).orderBy("f", "y").collect()
    by = {(r.f, r.y): r.s for r in got}
    assert all(by[0, y] == by[1, y] for y in range(4)) and any(by[0, y] != by[2, y] for y in range(4))
    first = int(synthetic.draws(5 ^ synthetic.LUMA, 1)[0])
    assert by[0, 0][0] == 350 + first % 13 - 6 and all(344 <= v <= 396 for v in by[0, 0])


def test_halves_go_to_even(spark):
    df = spark.createDataFrame([([1, 2, 2, 3, 7],)], "s array<bigint>")
    assert df.select(sample.halved_even(F.col("s")).alias("a"), sample.pairs_422(F.col("s")).alias("b")).first() == ([2, 2, 7], [2, 3, 7])


def test_fingerprints_tell_order_apart():
    assert metric.fingerprint([1, 2, 3]) != metric.fingerprint([1, 3, 2]) and metric.fingerprint([]) == 0
    assert metric.fingerprint([1, 2, 3]) == metric.fingerprint([2, 3], metric.fingerprint([1]))


def test_headers_read_no_payload(spark):
    """A header costs the same whatever the packet holds; empty and short contents are refused."""
    df = spark.createDataFrame([(bytearray(b""),), (bytearray(b"TPIC" + bytes(49)),), (None,)], "content binary")
    assert [r.status for r in packet.parsed(df).collect()] == [-10, -11, -10]


def test_streams_take_few_files_at_once(spark, tmp_path):
    for i in range(5):
        with open(tmp_path / f"m{i}.mov", "wb") as f:
            f.write(movie.write(movie_of(i + 1)))
    batches = []
    q = files.stream(spark, str(tmp_path / "*.mov"), 2).writeStream.foreachBatch(lambda df, n: batches.append(df.count())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(batches) == 5 and max(batches) <= 2


def test_damaged_alpha_bands(spark):
    rows = [(1, [0, 0, 5, -3, 0, 0]), (2, [0] * 6), (3, [70000, 1, 0, 0, 0, 2])]
    s = coder.residual_slice(spark.createDataFrame(rows, "id bigint, residuals array<bigint>")).withColumn("count", F.lit(6))
    assert {r.id: r.residuals for r in coder.residual_decode(s).collect() if r.status == 0} == {1: rows[0][1], 2: rows[1][1]}
    assert {r.id: r.status for r in coder.residual_decode(s).collect()}[3] == -9  # beyond the levels' domain
    cut = s.withColumn("payload", F.expr("substring(payload, 1, octet_length(payload) - 1)")).filter("id = 1")
    assert coder.residual_decode(cut).first().status == -10


def test_alpha_is_lossless_and_damage_is_opaque(spark):
    c = engine.Config(20, 19, 30, alpha=True, rows=1)
    sizes = [(20, 19), (10, 19), (10, 19), (20, 19)]
    rows = [(f, p, y, [((x * 37 + y * 11 + f * 5) % 1024 if p < 3 else (x * 4000 + y * 900 if x > 4 else 65535) % 65536) for x in range(a)]) for f in range(2) for p, (a, b) in enumerate(sizes) for y in range(b)]
    made = engine.encode(spark.createDataFrame(rows, "f bigint, plane bigint, y bigint, s array<bigint>"), c).cache()
    out, status = engine.decode(made, c)
    got = {(r.f, r.plane, r.y): r.s for r in out.collect()}
    assert len(got) == len(rows) and all(got[f, p, y] == s for f, p, y, s in rows if p == 3) and {r.status for r in status.collect()} == {0}
    slices = packet.parsed(made).select("f", F.filter("slices", lambda x: x["plane"] == 3).alias("a")).select("f", F.element_at("a", 2)["off"].alias("at"))
    broken = made.join(slices, "f").withColumn("content", F.expr("concat(substring(content, 1, int(at)), X'00', substring(content, int(at + 2), octet_length(content)))"))
    out, status = engine.decode(broken.select("f", "content"), c)
    got = {(r.f, r.plane, r.y): r.s for r in out.collect()}
    assert {r.status for r in status.collect()} == {1} and got[0, 3, 8] == [65535] * 20 == got[1, 3, 15]
    assert all(got[f, p, y] == s for f, p, y, s in rows if p == 3 and not 8 <= y < 16)

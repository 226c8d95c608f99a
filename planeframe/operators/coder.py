"""Entropy coders. Encoding is a projection over tokens (bit text, then bytes); decoding walks the bits of one
slice, in Arrow batches. Slices are independent of each other, so any partitioning will do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from planeframe.functions import binary as B
from planeframe.operators import block

EOB = 63
#: Ones of the longest prefix: after them come 32 bits of the value itself.
ESCAPE = 31
#: Largest mapped values: DC residuals, AC levels, runs, alpha levels.
MOST_DC, MOST_LEVEL, MOST_RUN, MOST_ALPHA = 1 << 27, 1 << 26, 63, 1 << 17


def in_domain(m: Column, family: str) -> Column:
    """Whether a mapped value may occur in the family (dc, level, run or alpha)."""
    most = {"dc": MOST_DC, "level": MOST_LEVEL, "run": MOST_RUN, "alpha": MOST_ALPHA}[family]
    return (m >= 0) & (m <= F.lit(most))


# ---- Rice ---------------------------------------------------------------------------------------------------


def rice_code(m: Column, k: Column) -> Column:
    """Bit text of the bounded Rice code: q ones, a zero, k bits; or ESCAPE ones and 32 bits."""
    q = F.floor(m / F.pow(F.lit(2.0), k)).cast("bigint")
    short = F.concat(F.repeat(F.lit("1"), q.cast("int")), F.lit("0"), B.bits_of(m, k))
    return F.when(q < ESCAPE, short).otherwise(F.concat(F.lit("1" * ESCAPE), B.bits_of(m, 32)))


def _all(array: Column, f: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(array, f), "")


def rice_slice(df: DataFrame) -> DataFrame:
    """k1, k2, k3, payload of each row's `tokens`: blocks of (dc, pairs), dc mapped, pairs (run, mapped level).

    The parameters come from the sums of each family; runs count without the end marks, which are coded all the same."""
    total = lambda of: F.aggregate(of, F.lit(0).cast("bigint"), lambda a, b: a + b)
    dcs = F.transform("tokens", lambda t: t["dc"])
    pairs = F.flatten(F.transform("tokens", lambda t: t["pairs"]))
    df = block.held(df, "_p", pairs)
    n = F.size("_p").cast("bigint")
    # sums, then parameters, each computed once a slice and not once a symbol
    sums = F.struct(total(dcs).alias("dc"), total(F.transform("_p", lambda p: p["level"])).alias("level"), total(F.transform("_p", lambda p: p["run"])).alias("run"))
    df = block.held(df, "_s", sums)
    ks = F.struct(block.rice_k(F.col("_s.dc"), F.size("tokens").cast("bigint")).alias("k1"), block.rice_k(F.col("_s.level"), n).alias("k2"), block.rice_k(F.col("_s.run"), n).alias("k3"))
    df = block.held(df, "_k", ks).withColumns({k: F.col(f"_k.{k}") for k in ("k1", "k2", "k3")})
    one = lambda t: F.concat(
        rice_code(t["dc"], F.col("k1")),
        _all(t["pairs"], lambda p: F.concat(rice_code(p["run"], F.col("k3")), rice_code(p["level"], F.col("k2")))),
        rice_code(F.lit(EOB).cast("bigint"), F.col("k3")),
    )
    df = block.held(df, "_bits", _all(F.col("tokens"), one))
    return df.withColumn("payload", B.packed(F.col("_bits"))).drop("_p", "_s", "_k", "_bits")


class Bits:
    """Reads the bits of a payload, most significant first, from their text: a symbol costs the same wherever it stands."""

    def __init__(self, payload: bytes):
        self.size = len(payload) * 8
        self.text = f"{int.from_bytes(payload, 'big'):0{self.size}b}" if payload else ""
        self.at = 0

    def take(self, n: int) -> int:
        lo = self.at
        if lo + n > self.size:
            raise EOFError
        self.at = lo + n
        return int(self.text[lo : lo + n], 2) if n else 0

    def ones(self, most: int) -> int:
        """How many ones stand next, up to `most`; the zero after fewer is read too."""
        end = min(self.at + most, self.size)
        zero = self.text.find("0", self.at, end)
        n = (end if zero < 0 else zero) - self.at
        if n < most and self.at + n >= self.size:
            raise EOFError
        self.at += n + (n < most)
        return n


def rice_symbol(bits: Bits, k: int, most: int) -> int:
    q = bits.ones(ESCAPE)
    m = bits.take(32) if q == ESCAPE else q << k | bits.take(k)
    if m > most:
        raise ValueError(f"{m} beyond {most}")
    return m


def unfold(m: int) -> int:
    return m // 2 if m % 2 == 0 else -(m + 1) // 2


def dc_pred(left: int | None, top: int | None) -> int:
    if left is None or top is None:
        return left if left is not None else top if top is not None else 0
    return (left + top + 1) // 2


def decoded_blocks(n: int, width: int, symbol: Callable[[str], int]) -> list[list[int]]:
    """n blocks (scan order) of a band `width` blocks wide; symbol(family) reads the next one."""
    out: list[list[int]] = []
    for i in range(n):
        coef = [0] * 64
        coef[0] = dc_pred(out[i - 1][0] if i % width else None, out[i - width][0] if i >= width else None) + unfold(symbol("dc"))
        at = 1
        while (run := symbol("run")) != EOB:
            at += run
            if at > 63:
                raise ValueError("a run beyond the block")
            coef[at] = unfold(symbol("level"))
            at += 1
        out.append(coef)
    return out


def few(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few slices: what a slice decodes to is far larger than its payload, and a whole batch of
    10,000 of them took hundreds of MB as lists."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def rice_blocks(n: int, width: int, ks: tuple[int, int, int], payload: bytes) -> list[list[int]]:
    """The n blocks (scan order) of one slice, `width` of them side by side."""
    bits, most = Bits(payload), {"dc": MOST_DC, "level": MOST_LEVEL, "run": MOST_RUN}
    k = dict(zip(("dc", "level", "run"), ks))
    return decoded_blocks(n, width, lambda family: rice_symbol(bits, k[family], most[family]))


def rice_payload(coef: np.ndarray, width: int) -> tuple[int, int, int, bytes]:
    """k1, k2, k3 and payload of one slice's blocks (n x 64, scan order), `width` of them side by side: what rice_slice
    makes of their tokens, with all symbols of the slice turned into bits at once."""
    fold = lambda v: np.where(v >= 0, 2 * v, -2 * v - 1)
    dc = coef[:, 0].reshape(-1, width)
    pred = np.zeros_like(dc)
    pred[0, 1:], pred[1:, 0] = dc[0, :-1], dc[:-1, 0]
    pred[1:, 1:] = dc[1:, :-1] + dc[:-1, 1:] + 1 >> 1
    dcs = fold(dc - pred).reshape(-1)
    at, place = np.nonzero(coef[:, 1:])
    before = np.full(len(at), -1)
    before[1:] = np.where(at[1:] == at[:-1], place[:-1], -1)
    runs, levels = place - before - 1, fold(coef[at, place + 1])
    # the parameters: floor(log2(mean)), 0 to 14
    k1, k2, k3 = (min(14, max(0, (int(m.sum()) // len(m)).bit_length() - 1)) if len(m) else 0 for m in (dcs, levels, runs))
    # a block is its DC, run and level of each pair, an end mark
    pairs = np.bincount(at, minlength=len(coef))
    start = np.cumsum(2 * pairs + 2) - 2 * pairs - 2
    symbols, k = np.empty(2 * len(at) + 2 * len(coef), np.int64), np.full(2 * len(at) + 2 * len(coef), k3)
    symbols[start], k[start] = dcs, k1
    symbols[start + 2 * pairs + 1] = EOB
    spot = 2 * np.arange(len(at)) + 2 * at + 1
    symbols[spot], symbols[spot + 1], k[spot + 1] = runs, levels, k2
    q = symbols >> k
    long = q >= ESCAPE
    size = np.where(long, ESCAPE + 32, q + 1 + k)
    q = np.minimum(q, ESCAPE)
    code = np.where(long, ((1 << ESCAPE) - 1 << 32) | symbols & (1 << 32) - 1, ((1 << q) - 1 << k + 1) | symbols & (1 << k) - 1)
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum()) - 1  # bits of the symbol after this one
    return k1, k2, k3, np.packbits((np.repeat(code, size) >> left & 1).astype(np.uint8)).tobytes()


def rice_decode(df: DataFrame) -> DataFrame:
    """(id, status, blocks) of df(id, n, width, k1, k2, k3, payload): blocks in scan order; status -10 where the
    payload ends too early, -9 where a value is out of its domain, with no blocks then."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few(batches):
            rows = [safely(rice_blocks, n, w, (a, b, c), p) for _, n, w, a, b, c, p in zip(*(x.to_pylist() for x in part.columns))]
            yield _decoded(part.column(0), rows)

    return df.select("id", "n", "width", "k1", "k2", "k3", "payload").mapInArrow(work, DECODED)


DECODED = "id bigint, status int, blocks array<array<bigint>>"


def safely(f: Callable, *args) -> tuple[int, list | None]:
    """Status and result of f, which reads a payload."""
    try:
        return 0, f(*args)
    except EOFError:
        return -10, None
    except ValueError:
        return -9, None


def _decoded(ids: pa.Array, rows: list[tuple[int, list | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.list_(pa.list_(pa.int64())))], ["id", "status", "blocks"]
    )


# ---- canonical codes ----------------------------------------------------------------------------------------


def category(m: Column) -> Column:
    """Bits of a mapped value: the symbol whose code goes before the value's bits below the highest."""
    return F.when(m > 0, F.length(F.bin(m))).otherwise(F.lit(0)).cast("bigint")


def canonical(lengths: Column) -> Column:
    """The codes (bit text, '' without one) of an array of code lengths: by length, then symbol, counting up."""
    order = F.array_sort(F.filter(F.transform(lengths, lambda n, i: F.struct(n.cast("bigint").alias("n"), i.cast("bigint").alias("s"))), lambda x: x["n"] > 0))
    start = F.struct(F.lit(0).cast("bigint").alias("code"), F.lit(0).cast("bigint").alias("n"), F.expr("CAST(array() AS array<struct<s:bigint,code:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        code = (acc["code"] * F.pow(F.lit(2.0), x["n"] - acc["n"])).cast("bigint")
        return F.struct((code + 1).alias("code"), x["n"].alias("n"), F.array_append(acc["out"], F.struct(x["s"].alias("s"), B.bits_of(code, x["n"]).alias("code"))).alias("out"))

    made = F.aggregate(order, start, step, lambda acc: acc["out"])
    return F.transform(lengths, lambda _, i: F.coalesce(F.try_element_at(F.map_from_entries(made), i.cast("bigint")), F.lit("")))


def kraft(lengths: Column, most: int) -> Column:
    """Whether the lengths fill the code exactly: the sum of 2^(most - n) over all codes is 2^most."""
    share = F.transform(F.filter(lengths, lambda n: n > 0), lambda n: F.pow(F.lit(2.0), F.lit(most) - n).cast("bigint"))
    return (F.aggregate(share, F.lit(0).cast("bigint"), lambda a, b: a + b) == F.lit(1 << most)) & F.forall(lengths, lambda n: (n >= 0) & (n <= most))


def limited_lengths(weights: list[int], most: int) -> list[int]:
    """Code lengths of the cheapest prefix code with no code over `most` bits (package-merge over coins).

    Symbols of weight 0 have a code too. Of equal weights single symbols go first, then smaller symbols."""
    n = len(weights)
    if n < 2 or n > 1 << most:
        raise ValueError("no such code")
    coins = sorted((w, (i,)) for i, w in enumerate(weights))
    row: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(most - 1):
        row = sorted([*coins, *row], key=lambda x: (x[0], len(x[1]) > 1))
        row = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
    row = sorted([*coins, *row], key=lambda x: (x[0], len(x[1]) > 1))
    out = [0] * n
    for _, symbols in row[: 2 * n - 2]:
        for s in symbols:
            out[s] += 1
    return out


def symbol_bits(lengths: Column, symbol: Column, categorical: bool) -> Column:
    """Bits of one symbol: its code, and for a category the value's bits below the highest."""
    return F.get(lengths, symbol.cast("int")) + (F.greatest(symbol - 1, F.lit(0)) if categorical else F.lit(0))


def best_book(histogram: DataFrame, books: DataFrame, by: list[str], categorical: bool) -> DataFrame:
    """(by, book, bits): of books(book, sym, len) the one that codes histogram(by, sym, c) in the fewest bits, ties
    to the lower number. books is small (books x symbols) and goes to every task."""
    size = F.col("len") + (F.greatest(F.col("sym") - 1, F.lit(0)) if categorical else F.lit(0))
    costs = histogram.join(F.broadcast(books), "sym").groupBy(*by, "book").agg(F.sum(F.col("c") * size).alias("bits"))
    return costs.groupBy(*by).agg(F.min(F.struct("bits", "book")).alias("x")).select(*by, "x.book", "x.bits")


def vlc_slice(df: DataFrame, dc: Column, level: Column, run: Column) -> DataFrame:
    """payload of each row's `tokens` (as in rice_slice) under canonical codes: dc, level and run are arrays of codes."""
    value = lambda codes, m: F.concat(F.get(codes, category(m).cast("int")), B.bits_of(m, F.greatest(category(m) - 1, F.lit(0))))
    one = lambda t: F.concat(
        value(dc, t["dc"]), _all(t["pairs"], lambda p: F.concat(F.get(run, p["run"].cast("int")), value(level, p["level"]))), F.get(run, F.lit(EOB))
    )
    df = block.held(df, "_bits", _all(F.col("tokens"), one))
    return df.withColumn("payload", B.packed(F.col("_bits"))).drop("_bits")


class Book:
    """Decodes canonical codes: of each length the first code and the symbols in order."""

    def __init__(self, lengths: list[int]):
        order = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.first, code, before = {}, 0, 0
        for n, s in order:
            code <<= n - before
            before = n
            self.first.setdefault(n, (code, []))[1].append(s)
            code += 1

    def symbol(self, bits: Bits) -> int:
        code = n = 0
        while n < 32:
            code, n = code << 1 | bits.take(1), n + 1
            if n in self.first and code - self.first[n][0] < len(self.first[n][1]):
                return self.first[n][1][code - self.first[n][0]]
        raise ValueError("no such code")

    def value(self, bits: Bits) -> int:
        c = self.symbol(bits)
        return c if c < 2 else 1 << (c - 1) | bits.take(c - 1)


def vlc_decode(df: DataFrame, dc: list[int], level: list[int], run: list[int]) -> DataFrame:
    """As rice_decode, of df(id, n, width, payload) under the books' code lengths."""

    def one(n: int, width: int, payload: bytes) -> list[list[int]]:
        bits, books = Bits(payload), (Book(dc), Book(level), Book(run))
        read = {"dc": lambda: books[0].value(bits), "level": lambda: books[1].value(bits), "run": lambda: books[2].symbol(bits)}
        return decoded_blocks(n, width, lambda family: read[family]())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few(batches):
            yield _decoded(part.column(0), [safely(one, n, w, p) for _, n, w, p in zip(*(x.to_pylist() for x in part.columns))])

    return df.select("id", "n", "width", "payload").mapInArrow(work, DECODED)


# ---- asymmetric numeral systems -----------------------------------------------------------------------------

SCALE_BITS, STATE_LOW = 12, 1 << 23


def normalised(counts: list[int], total: int = 1 << SCALE_BITS) -> list[int]:
    """Frequencies that sum up to `total`, at least 1 for every symbol that occurs: what rounding down leaves goes to
    the largest remainders, what the ones take too much comes from the largest frequencies (ties: lower symbol)."""
    n = sum(counts)
    if n <= 0:
        raise ValueError("nothing to model")
    freq = [max(1, c * total // n) if c else 0 for c in counts]
    rest = [c * total % n for c in counts]
    while sum(freq) > total:
        s = max((i for i in range(len(freq)) if freq[i] > 1), key=lambda i: (freq[i], -i))
        freq[s], rest[s] = freq[s] - 1, 0
    while sum(freq) < total:
        s = max((i for i in range(len(freq)) if counts[i]), key=lambda i: (rest[i], -i))
        freq[s], rest[s] = freq[s] + 1, 0
    return freq


def rans_encode(symbols: list[int], freq: Callable[[int], list[int]] | list[int]) -> bytes:
    """The state (4 bytes), then the bytes in the order in which decoding takes them. freq: one model, or one for
    each place."""
    model = freq if callable(freq) else lambda _: freq
    x, out = STATE_LOW, bytearray()
    starts: dict[int, list[int]] = {}
    for i in range(len(symbols) - 1, -1, -1):
        f = model(i)
        if id(f) not in starts:
            starts[id(f)] = np.concatenate([[0], np.cumsum(f)]).tolist()
        n, low = f[symbols[i]], starts[id(f)][symbols[i]]
        if not n:
            raise ValueError("a symbol that the model lacks")
        while x >= ((STATE_LOW >> SCALE_BITS) << 8) * n:
            out.append(x & 255)
            x >>= 8
        x = (x // n << SCALE_BITS) + x % n + low
    return x.to_bytes(4, "big") + bytes(reversed(out))


def rans_decode(payload: bytes, n: int, freq: Callable[[int, list[int]], list[int]] | list[int]) -> list[int]:
    """n symbols; freq: one model, or one for each place and the symbols before it."""
    model = freq if callable(freq) else lambda *_: freq
    if len(payload) < 4:
        raise EOFError
    x, at, out = int.from_bytes(payload[:4], "big"), 4, []
    lookup: dict[int, tuple[np.ndarray, list[int]]] = {}
    for i in range(n):
        f = model(i, out)
        if id(f) not in lookup:
            lookup[id(f)] = np.repeat(np.arange(len(f)), f), np.concatenate([[0], np.cumsum(f)]).tolist()
        table, starts = lookup[id(f)]
        slot = x & ((1 << SCALE_BITS) - 1)
        s = int(table[slot])
        out.append(s)
        x = f[s] * (x >> SCALE_BITS) + slot - starts[s]
        while x < STATE_LOW:
            if at >= len(payload):
                raise EOFError
            x, at = x << 8 | payload[at], at + 1
    return out


def rans_slices(df: DataFrame, symbols: int, contexts: int = 1) -> DataFrame:
    """(id, n, freq, payload) of df(id, seq): each row's symbols (below `symbols`) under models of its own, one for
    each context; the context of a symbol is the one before it, up to contexts - 1 (0 for the first)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, payloads = [], []
            for seq in batch.column(1).to_pylist():
                ctx = [0, *(min(s, contexts - 1) for s in seq[:-1])] if contexts > 1 else [0] * len(seq)
                counts = [[0] * symbols for _ in range(contexts)]
                for c, s in zip(ctx, seq):
                    counts[c][s] += 1
                freq = [normalised(c) if any(c) else [1 << SCALE_BITS] + [0] * (symbols - 1) for c in counts]
                payloads.append(rans_encode(seq, lambda i: freq[ctx[i]]) if seq else b"")
                models.append(freq)
            size = [len(s) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(models, pa.list_(pa.list_(pa.int64()))), pa.array(payloads, pa.binary())], ["id", "n", "freq", "payload"]
            )

    return df.select("id", "seq").mapInArrow(work, "id bigint, n bigint, freq array<array<bigint>>, payload binary")


def rans_symbols(df: DataFrame) -> DataFrame:
    """(id, status, seq) of rans_slices' rows."""

    def one(n: int, freq: list[list[int]], payload: bytes) -> list[int]:
        return rans_decode(payload, n, lambda i, out: freq[min(out[-1], len(freq) - 1) if i and len(freq) > 1 else 0]) if n else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [safely(one, *x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(pa.int64()))], ["id", "status", "seq"])

    return df.select("id", "n", "freq", "payload").mapInArrow(work, "id bigint, status int, seq array<bigint>")


def coded_bits(df: DataFrame, by: list[str], steps: list[tuple[int, int]], dc: list[int], level: list[int], run: list[int]) -> DataFrame:
    """(by, qp, bits): what each block of df(by, coef: unquantised, in scan order) takes under every (qp, flat step) and
    the books' code lengths, end mark included; DC counts as predicted from nothing. A batch of blocks at a time."""
    dcs, levels, runs = (np.array(x, np.int64) for x in (dc, level, run))
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*by).schema}

    def value(lens: np.ndarray, m: np.ndarray) -> np.ndarray:
        c = np.frexp(m.astype(np.float64))[1]  # bits of an integer
        return lens[c] + np.maximum(c - 1, 0)

    def one(x: np.ndarray, q: int) -> np.ndarray:
        dead = np.full(64, q >> 2)
        dead[0] = 0
        size = np.maximum((np.abs(x) + (q >> 1) - dead) // q, 0)
        m = np.where((x < 0) & (size > 0), 2 * size - 1, 2 * size)
        bits = value(dcs, m[:, 0]) + runs[EOB]
        at, place = np.nonzero(size[:, 1:])
        before = np.concatenate([[-1], np.where(at[1:] == at[:-1], place[:-1], -1)])[: len(at)]
        more = value(levels, m[at, place + 1]) + runs[place - before - 1]
        return bits + np.bincount(at, more, len(x)).astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(len(by)).flatten(), np.int64).reshape(-1, 64)
            for qp, q in steps:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(np.full(len(x), qp, np.int64)), pa.array(one(x, q))], [*by, "qp", "bits"])

    return df.select(*by, "coef").mapInArrow(work, ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", qp bigint, bits bigint")


def refined(df: DataFrame, qp: int, level: list[int], run: list[int], chroma: bool = False) -> DataFrame:
    """(id, levels) of df(id, coef, levels, steps), all three in scan order: AC levels moved by one or set to zero where
    that saves more bits, at the rate's price, than it adds error; one walk along each block, its own changes included."""
    price = 0.080 * 2.0 ** ((qp - 52) / 4) * (0.5 if chroma else 1.0)

    def bits(v: int) -> int:
        c = (2 * v if v >= 0 else -2 * v - 1).bit_length()
        return level[c] + max(c - 1, 0)

    def one(coef: list[int], levels: list[int], steps: list[int]) -> list[int]:
        out = list(levels)
        spots = [i for i in range(1, 64) if out[i]]
        before = 0  # the last place whose level stays, DC first
        for n, i in enumerate(spots):
            after = spots[n + 1] if n + 1 < len(spots) else None
            error = lambda v: (coef[i] - v * steps[i]) ** 2  # noqa: E731, B023
            old, cost = out[i], price * steps[i] ** 2
            gains = [(error(old) - error(v) + cost * (bits(old) - bits(v)), v) for v in (old - 1, old + 1) if v]
            saved = bits(old) + run[i - before - 1]
            if after is not None:
                saved += run[after - i - 1] - run[after - before - 1]
            gains.append((error(old) - error(0) + cost * saved, 0))
            best = max(gains, key=lambda g: g[0])
            if best[0] > 0:
                out[i] = best[1]
            if out[i]:
                before = i
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["id", "levels"])

    return df.select("id", "coef", "levels", "steps").mapInArrow(work, "id bigint, levels array<bigint>")


# ---- run/level streams --------------------------------------------------------------------------------------


def residual_pairs(residuals: Column) -> Column:
    """(run, level) of a residual stream: zeros before each non-zero value; zeros at the end make (run, 0)."""
    spots = F.filter(F.transform(residuals, lambda r, i: F.struct(i.alias("at"), r.alias("level"))), lambda x: x["level"] != 0)
    ends = F.concat(spots, F.when(F.coalesce(F.element_at(residuals, -1), F.lit(1)) == 0, F.array(F.struct(F.size(residuals).alias("at"), F.lit(0).cast("bigint").alias("level")))).otherwise(F.slice(spots, 1, 0)))
    return F.transform(ends, lambda x, i: F.struct((x["at"] - F.when(i == 0, -1).otherwise(F.get(ends, i - 1)["at"]) - 1).cast("bigint").alias("run"), x["level"].alias("level")))


def pair_residuals(pairs: Column) -> Column:
    """The residual stream of its pairs."""
    return F.flatten(F.transform(pairs, lambda p: F.concat(F.array_repeat(F.lit(0).cast("bigint"), p["run"].cast("int")), F.when(p["level"] != 0, F.array(p["level"])).otherwise(F.expr("CAST(array() AS array<bigint>)")))))


def residual_slice(df: DataFrame) -> DataFrame:
    """k_level, k_run, payload of each row's `residuals`: runs as they are, levels mapped, the pair of zeros at the end
    with level 0 where there are any. Alpha bands and layers of a base are coded so."""
    total = lambda of: F.aggregate(of, F.lit(0).cast("bigint"), lambda a, b: a + b)
    df = block.held(df, "_p", F.transform(residual_pairs(F.col("residuals")), lambda p: F.struct(p["run"].alias("run"), block.fold(p["level"]).alias("level"))))
    # levels without the end mark, runs with it
    levels = F.filter(F.transform("_p", lambda p: p["level"]), lambda m: m > 0)
    sums = F.struct(total(levels).alias("level"), F.size(levels).cast("bigint").alias("n"), total(F.transform("_p", lambda p: p["run"])).alias("run"), F.size("_p").cast("bigint").alias("pairs"))
    df = block.held(df, "_s", sums)
    df = block.held(df, "_k", F.struct(block.rice_k(F.col("_s.level"), F.col("_s.n")).alias("level"), block.rice_k(F.col("_s.run"), F.col("_s.pairs")).alias("run")))
    df = block.held(df, "_bits", _all(F.col("_p"), lambda p: F.concat(rice_code(p["run"], F.col("_k.run")), rice_code(p["level"], F.col("_k.level")))))
    return df.select("*", F.col("_k.level").alias("k_level"), F.col("_k.run").alias("k_run"), B.packed(F.col("_bits")).alias("payload")).drop("_p", "_s", "_k", "_bits")


def band_residuals(count: int, k_level: int, k_run: int, payload: bytes, most: int = MOST_ALPHA) -> list[int]:
    """The `count` residuals of one band."""
    bits, out = Bits(payload), []
    while len(out) < count:
        left = count - len(out)
        run, m = rice_symbol(bits, k_run, left), rice_symbol(bits, k_level, most)
        if (m == 0) != (run == left):  # zeros up to the end, and only they, have no level
            raise ValueError("a run beyond the band")
        out += [0] * run + ([unfold(m)] if m else [])
    return out


def residual_decode(df: DataFrame, most: int = MOST_ALPHA) -> DataFrame:
    """(id, status, residuals) of df(id, count, k_level, k_run, payload)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [safely(band_residuals, *x, most) for x in zip(*(batch.column(i).to_pylist() for i in range(1, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.list_(pa.int64()))], ["id", "status", "residuals"])

    return df.select("id", "count", "k_level", "k_run", "payload").mapInArrow(work, "id bigint, status int, residuals array<bigint>")


def med_samples(width: int, r: list[int]) -> list[int]:
    """The samples of one band from its residuals."""
    s: list[int] = []
    for i, v in enumerate(r):
        left, top = (s[i - 1] if i % width else None), (s[i - width] if i >= width else None)
        if left is None or top is None:
            pred = left if left is not None else top if top is not None else 0
        else:
            corner, lo, hi = s[i - width - 1], min(left, top), max(left, top)
            pred = lo if corner >= hi else hi if corner <= lo else left + top - corner
        s.append(pred + v)
    return s


def med_decode(df: DataFrame) -> DataFrame:
    """(id, samples) of df(id, width, residuals): the samples of a band under the median edge detector, whose
    neighbours are the samples decoded before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [med_samples(w, r) for w, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "samples"])

    return df.select("id", "width", "residuals").mapInArrow(work, "id bigint, samples array<bigint>")


# ---- contexts and bands -------------------------------------------------------------------------------------


def place_context(at: Column) -> Column:
    """Bucket of a scan position from 1 on: below 8, 16, 32, and the rest."""
    return F.when(at < 8, 0).when(at < 16, 1).when(at < 32, 2).otherwise(3).cast("bigint")


def previous_context(cat: Column) -> Column:
    """Bucket of the category before: 0, 1, 2 to 3, more; 4 without one."""
    return F.when(cat.isNull(), 4).when(cat == 0, 0).when(cat == 1, 1).when(cat <= 3, 2).otherwise(3).cast("bigint")


def dc_context(cat: Column) -> Column:
    """Bucket of the DC category of the block before: 0 without one, else 1 more than that of a level."""
    return F.when(cat.isNull(), 0).otherwise(previous_context(cat) + 1).cast("bigint")


#: First scan positions of the five bands of AC; fixed values.
BANDS = (1, 5, 11, 17, 25)


def band(at: Column) -> Column:
    out = F.lit(0)
    for i, first in enumerate(BANDS):
        out = F.when(at >= first, F.lit(i)).otherwise(out)
    return out.cast("bigint")


def tokens(df: DataFrame, pred: str = "pred") -> DataFrame:
    """tokens of each block: df has (…, coef in scan order, pairs, pred); dc mapped, levels mapped."""
    pairs = F.transform("pairs", lambda p: F.struct(p["run"].alias("run"), block.fold(p["level"]).alias("level")))
    return df.withColumn("token", F.struct(block.fold(F.get("coef", F.lit(0)) - F.col(pred)).alias("dc"), pairs.alias("pairs")))

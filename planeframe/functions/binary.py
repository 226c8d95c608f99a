"""Bytes and bits as column expressions: big-endian integers, bit text, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _at(offset: Column | int, more: int = 1) -> Column:
    return (offset + more if isinstance(offset, Column) else F.lit(offset + more)).cast("int")


def be(content: Column, offset: Column | int, n: int) -> Column:
    """The unsigned big-endian integer in n (up to 7) bytes from offset on; null where they are not all there."""
    raw = F.substring(content, _at(offset), F.lit(n))
    return F.when(F.octet_length(raw) == n, F.conv(F.hex(raw), 16, 10).cast("bigint"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once. Spark interprets lambdas; a long rule as generated code becomes one method
    that is too long for Java to compile and takes several times as long."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _words(layout: list[tuple[str, int]]) -> list[list[tuple[str, int]]]:
    """Neighbouring fields in groups of up to 7 bytes."""
    out: list[list[tuple[str, int]]] = []
    for name, n in layout:
        if out and sum(w for _, w in out[-1]) + n <= 7:
            out[-1].append((name, n))
        else:
            out.append([(name, n)])
    return out


def be_struct(content: Column, layout: list[tuple[str, int]], at: Column | int) -> Column:
    """Fields (name, bytes up to 7) one after another as a struct of what be() gives for each. Up to 7 bytes are turned
    into a number at a time, which costs far more than to take it apart."""
    words, fields, pos = [], [], 0
    for k, group in enumerate(_words(layout)):
        width = sum(n for _, n in group)
        raw = F.substring(content, _at(at + pos), F.lit(width))
        words.append(F.conv(F.rpad(F.hex(raw), 2 * width, "0"), 16, 10).cast("bigint"))
        left, pos = width, pos + width
        for name, n in group:
            left -= n
            fields.append((name, n, k, left * 8, pos - left))
    there = F.octet_length(content) - (at if isinstance(at, Column) else F.lit(at))
    cut = lambda x, n, k, shift: F.shiftright(F.get(x["w"], F.lit(k)), shift).bitwiseAND(F.lit((1 << 8 * n) - 1).cast("bigint"))
    return once(F.struct(F.array(*words).alias("w"), there.alias("n")), lambda x: F.struct(*[F.when(x["n"] >= end, cut(x, n, k, shift)).alias(name) for name, n, k, shift, end in fields]))


def to_be_all(values: list[tuple[Column, int]]) -> Column:
    """to_be() of all values (bytes up to 7), one after another; also up to 7 bytes at a time."""
    texts, at = [], 0
    for group in _words([("", n) for _, n in values]):
        word, width = None, 0
        for v, n in values[at : at + len(group)]:
            v = v.cast("bigint").bitwiseAND(F.lit((1 << 8 * n) - 1).cast("bigint"))
            word, width = v if word is None else F.shiftleft(word, 8 * n).bitwiseOR(v), width + n
        texts.append(F.right(F.lpad(F.hex(word), 16, "0"), F.lit(2 * width)))
        at += len(group)
    return F.unhex(F.concat(*texts))


def piece(content: Column, offset: Column | int, n: Column | int) -> Column:
    """n bytes from offset on (fewer at the end)."""
    return F.substring(content, _at(offset), n.cast("int") if isinstance(n, Column) else F.lit(n))


def to_be(value: Column, n: int) -> Column:
    """n big-endian bytes of an integer of that width."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * n)))


def joined(parts: Column) -> Column:
    """One binary of an array of binaries."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def bits_of(value: Column, width: Column | int) -> Column:
    """The low `width` bits as text, most significant first."""
    width = width if isinstance(width, Column) else F.lit(width)
    return F.when(width > 0, F.right(F.lpad(F.bin(value), 64, "0"), width.cast("int"))).otherwise(F.lit(""))


def packed(bits: Column) -> Column:
    """Bit text as bytes, filled up with zeros: 32 bits at a time, in one pass."""
    full = F.rpad(bits, (F.ceil(F.length(bits) / 32) * 32).cast("int"), F.lit("0"))
    each = F.transform(F.regexp_extract_all(full, F.lit(".{32}"), F.lit(0)), lambda x: F.lpad(F.conv(x, 2, 16), 8, "0"))
    return F.unhex(F.left(F.array_join(each, ""), (F.ceil(F.length(bits) / 8) * 2).cast("int")))


def trailing_zeros(v: Column) -> Column:
    """How many zero bits a positive integer ends with; 64 for 0."""
    return F.when(v == 0, F.lit(64)).otherwise(F.length(F.bin(v)) - F.length(F.rtrim(F.bin(v), F.lit("0")))).cast("bigint")

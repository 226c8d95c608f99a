"""Integer projections: timecode, quantiser parameters, sizes, canonical codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def frame_label(frame: Column, fps: int, drop: int) -> Column:
    """The frame number with the dropped labels counted in: drop labels a minute, but for each tenth."""
    tens, minute = fps * 600 - 9 * drop, fps * 60 - drop
    if not drop:
        return frame
    d, m = div(frame, tens), frame % tens
    return (frame + d * (9 * drop) + F.when(m >= fps * 60, (div(m - fps * 60, minute) + 1) * drop).otherwise(F.lit(0))).cast("bigint")


def seconds(ticks: Column, timescale: Column) -> Column:
    """Time of a place in ticks."""
    return ticks / timescale


def timecode(frame: Column, fps: int = 30, drop: int = 2) -> Column:
    """HH:MM:SS:FF, with ';' before the frames if labels are dropped. Hours are not wrapped: from 100 on they have more digits."""
    n = frame_label(frame, fps, drop)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = div(n, fps)
    hours = div(s, 3600)
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(div(s, 60) % 60), F.lit(":"), two(s % 60), F.lit(";" if drop else ":"), two(n % fps))


def two_hour_digits(text: Column) -> Column:
    """A timecode whose hours show their first two digits alone, as a field of that width has them (SQL's lpad): to look
    at, not to read back."""
    return F.regexp_replace(text, r"^(\d\d)\d+", "$1")


def timecode_frames(text: Column, fps: int = 30, drop: int = 2) -> Column:
    """The frame number of a timecode."""
    part = F.transform(F.split(text, "[:;]"), lambda x: x.cast("bigint"))
    h, m, s, f = (F.get(part, F.lit(i)) for i in range(4))
    minutes = h * 60 + m
    return ((h * 3600 + m * 60 + s) * fps + f - F.lit(drop) * (minutes - div(minutes, 10))).cast("bigint")


def effective_qp(base: Column, delta: Column, depth: int) -> Column:
    """base + delta, two more for each bit beyond 10, from 0 to 63 (95 if the base is 64 or more)."""
    more = 2 * (depth - 10) if depth >= 12 else 0
    return F.greatest(F.lit(0), F.least(base + delta + more, F.when(base >= 64, F.lit(95)).otherwise(F.lit(63)))).cast("bigint")


def bytes_for(bpp: Column, w: Column, h: Column) -> Column:
    """At least 1; halves to even."""
    return F.greatest(F.lit(1.0), F.rint(bpp * w * h / 8)).cast("bigint")


def bit_length(v: Column) -> Column:
    return F.when(v > 0, F.length(F.bin(v))).otherwise(F.lit(0)).cast("bigint")

"""Places of regular-expression matches as DataFrame expressions.

split() and regexp_extract_all() walk the same leftmost non-overlapping matches, so that the lengths of the
pieces between them, and of the matches, add up to the places (in code points, end exclusive).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

EMPTY = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"


def matches(text: Column, pattern: str, group: int = 0, where: Column | None = None) -> Column:
    """Structs (gap, hit, value): the code points before each match since the last one, the match's own
    code points, and the value of the group. `where` is a cheap test that holds wherever there is a match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("g"), hits.alias("h"), values.alias("v")),
        lambda x: F.struct(F.length(x["g"]).cast("bigint").alias("gap"), F.length(x["h"]).cast("bigint").alias("hit"), x["h"].alias("text"), x["v"].alias("value")),
    )
    none = F.expr("CAST(array() AS array<struct<gap:bigint,hit:bigint,text:string,value:string>>)")
    return found if where is None else F.when(where, found).otherwise(none)


#: Matches that are walked as one block.
BLOCK = 512


def placed(found: Column, kind: int, keep: Callable[[Column], Column]) -> Column:
    """Spans (kind, start, end, value) of the matches that pass `keep`, which sees (text, value).

    Blocks of matches are walked one by one, as a walk copies what it has found at every step; then each block's
    places are moved by what stands before it."""
    empty = F.expr(f"CAST(array() AS {EMPTY})")

    def walked(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["hit"]).alias("at"),
                F.when(
                    keep(x),
                    F.array_append(
                        acc["out"],
                        F.struct(F.lit(kind).alias("kind"), (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["hit"]).alias("end"), x["value"].alias("value")),
                    ),
                ).otherwise(acc["out"]).alias("out"),
            ),
        )

    def moved(blocks: Column) -> Column:
        nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"CAST(array() AS array<{EMPTY}>)").alias("out"))
        return F.aggregate(
            blocks,
            nothing,
            lambda acc, b: F.struct(
                (acc["at"] + b["at"]).alias("at"),
                F.array_append(
                    acc["out"], F.transform(b["out"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
                ).alias("out"),
            ),
            lambda acc: F.flatten(acc["out"]),
        )

    starts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(BLOCK))
    return F.when(F.size(found) <= BLOCK, walked(found)["out"]).otherwise(moved(F.transform(starts, lambda a: walked(F.slice(found, a, F.lit(BLOCK))))))


def ordered(*spans: Column) -> Column:
    """All spans by start, then kind, then end."""
    every = F.concat(*spans)
    return F.transform(
        F.array_sort(F.transform(every, lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))),
        lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"]),
    )


def listed(spans: Column, names: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def number(spans: Column) -> Column:
    return F.size(spans).cast("bigint")

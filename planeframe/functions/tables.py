"""Parsers as table functions for SQL: register(spark), then SELECT * FROM movie_atoms(content)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from planeframe.operators import coder
from planeframe.sources import movie


@udtf(returnType="path string, off bigint, size bigint")
class MovieAtoms:
    """The atoms of a file."""

    def eval(self, content: bytes) -> Iterator[tuple[str, int, int]]:
        for path, at, _, size in movie.atoms(bytes(content)):
            yield path, at, size


@udtf(returnType="idx bigint, off bigint, size bigint, pts bigint, dur bigint, sync boolean")
class MovieSamples:
    """The video samples of a file; none if it breaks the format."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            samples = movie.read(bytes(content))["samples"]
        except (ValueError, KeyError):
            return
        for i, s in enumerate(samples):
            yield (i, *s)


@udtf(returnType="at bigint, value bigint")
class RiceSymbols:
    """The mapped values of a Rice payload under one parameter, up to its end or the first that is cut off."""

    def eval(self, payload: bytes, k: int, n: int) -> Iterator[tuple[int, int]]:
        bits = coder.Bits(bytes(payload))
        for i in range(n):
            try:
                yield i, coder.rice_symbol(bits, k, (1 << 32) - 1)
            except EOFError:
                return


def register(spark: SparkSession) -> None:
    for name, f in (("movie_atoms", MovieAtoms), ("movie_samples", MovieSamples), ("rice_symbols", RiceSymbols)):
        spark.udtf.register(name, f)

"""Connected components as joins and partial aggregates; nothing is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planeframe.llm.common import materialize


def _roots(edges: DataFrame) -> DataFrame:
    """(v, label): each vertex of edges(a, b) with the local minimum that it reaches by going to its smallest
    neighbour again and again; the paths are halved in each step."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "roots")
    while True:
        over = up.select(F.col("v").alias("label"), F.col("label").alias("next"))
        nexts = materialize(up.join(over, "label").select("v", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "roots")
        up = nexts.select("v", "label")
        if nexts.filter("moved").isEmpty():
            return up


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every end of edges(a, b): label is the smallest id that v reaches.

    Each round hangs the vertices under local minima and keeps the edges between different ones, at most half
    as many vertices as before. A hot vertex costs a partial minimum for each task; the joins are plain
    shuffles that adaptive execution can split.
    """
    labels, rest = None, edges.select("a", "b").filter("a <> b").distinct()
    while True:
        rest = materialize(rest, "edges")
        if labels is not None and rest.isEmpty():
            return labels
        up = _roots(rest)
        labels = up if labels is None else _composed(labels, up)
        ends = rest.join(up.select(F.col("v").alias("a"), F.col("label").alias("ra")), "a").join(up.select(F.col("v").alias("b"), F.col("label").alias("rb")), "b")
        rest = ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def _composed(labels: DataFrame, up: DataFrame) -> DataFrame:
    over = up.select(F.col("v").alias("label"), F.col("label").alias("next"))
    return materialize(labels.join(over, "label", "left").select("v", F.coalesce("next", "label").alias("label")), "labels")


def joined(vertices: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels(v, label) of vertices(v) after links(a, b) more; vertices without a label stand for themselves."""
    every = materialize(vertices.distinct().join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label")), "labels")
    ends = links.join(every.select(F.col("v").alias("a"), F.col("label").alias("la")), "a").join(every.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b")
    return _composed(every, components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))))

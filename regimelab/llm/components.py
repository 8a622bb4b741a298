"""Connected components of a graph as DataFrames, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replaced, with_totals, written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Least neighbours come back to edges by a salted join, so that a hub's edges stay dealt out."""
    least = [F.min("b").alias("m")], [F.min("m").alias("m")]
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = with_totals(both, "a", "b", *least).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
    return with_totals(large, "a", "b", *least).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node that it reaches, for every node of edges (a, b): longs, in either direction, repeated or not."""
    held = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    alone = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    mark = None
    while True:
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark, held = now, replaced(held, _stars(held), "stars")
    found = held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    lone = alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionAll(lone)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least item that each of n items reaches over edges a-b, which all stay in this task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verdicts(classes: DataFrame, linked: DataFrame) -> DataFrame:
    """node, class_id, component_id, n_links of each class.

    classes: node, class_id (its least member) and docs (how many members). linked: rows (a, links, null), parts of the
    number of members of other classes that a links to, and rows (a, null, b), edges that span what links reach.
    """
    counts = linked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    reach = components(linked.where("b is not null").select("a", "b"))
    tied = classes.select("node", "class_id", "docs").join(counts, "node", "left").join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = tied.groupBy("component").agg(F.min("class_id").alias("component_id"))
    return tied.join(least, "component").select("node", "class_id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))

"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binroute.sources.scratch import materialize

FEW = 20_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point each node's greater (large) or lesser (small) neighbours to the least one around it."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = around.join(least, "a")
    if large:
        pointed = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        pointed = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return pointed.where("a <> b").distinct()


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node either points to one other or is pointed to."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _by_union_find(links: DataFrame) -> DataFrame:
    """``(node, class)`` of a table of links that one task holds with ease."""
    import pyarrow as pa

    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(node):
            while parent.setdefault(node, node) != node:
                parent[node] = node = parent[parent[node]]
            return node

        batch = None
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        if batch is not None:
            nodes = list(parent)
            columns = [pa.array(nodes, batch.column(0).type), pa.array([find(n) for n in nodes], batch.column(0).type)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "class"])

    return links.repartition(1).mapInArrow(run, f"node {kind}, class {kind}")


def components(links: DataFrame) -> DataFrame:
    """``(node, class)`` for every node of the links ``(a, b)``; the class is its least node.

    Steps are grouped minima and joins, so a node with very many links is summed
    up before it is shuffled, and its join can be split. Each step is written to
    the shared folder. Ends when every node points straight to its class. Up to
    ``FEW`` links are not worth these steps: one task joins them, with the same result.
    """
    now = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    if now.count() <= FEW:
        return materialize(_by_union_find(now), "classes")
    while not _is_forest_of_stars(now):
        now = materialize(_star(_star(now, large=True), large=False), "links")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("class"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(roots)

"""Which members of shared buckets must be compared to find connected classes.

All members of a bucket meet, but those of a crowded one first meet its two ends
only, in rounds with other ends each. Classes that are joined so are not laid over
themselves again: at the end all pairs of *different* classes left in crowded
buckets meet, in salted blocks, and a pair that shares many buckets is told in few.

Members go by 64-bit names and have a size ``n``. ``nodes`` has a row per member with
``name``, ``digest`` and facts. ``alike`` is a condition on the sizes of members a and
b (``n_a``, ``n_b``), ``fit`` one on their facts; every link fulfils both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binroute.operators.bloom import only_possible
from binroute.sources.scratch import materialize

#: A bucket of more is crowded; crowded buckets are paired in blocks of so many.
CROWD, BLOCK = 32, 4096
#: So many of a member's least crowded buckets tell whether a pair has met before.
LEAST = 6


def shared(seats: DataFrame) -> DataFrame:
    """``(key, name, n, crowd)`` of the buckets ``(key, name, n)`` that hold several rows; a repeated row stands once."""
    several = materialize(seats.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1"), "buckets")
    met = only_possible(seats, "key", several.select("key")).join(several, "key")
    return materialize(met.groupBy("key", "name").agg(F.first("n").alias("n"), F.first("crowd").alias("crowd")), "shared")


def _end(rows: DataFrame, end: str, *names: str) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(f"{c}_{end}") for c in names])


def near_pairs(seats: DataFrame, alike: Column, crowd: int = CROWD, nodes: DataFrame | None = None, facts: Sequence[str] = (), fit: Column | None = None) -> DataFrame:
    """``(name_a, name_b)`` of all pairs in the smaller buckets, and of members of crowded ones with the ends of their bucket.

    The latter are told only if they fulfil ``fit`` on the facts of ``nodes``, where given.
    """
    small, crowded = seats.where(F.col("crowd") <= crowd), seats.where(F.col("crowd") > crowd)
    facts = [c for c in facts if c != "n"]
    if nodes is not None:
        crowded = materialize(crowded.join(nodes.select("name", *facts), "name"), "crowded-facts")
    met = _end(small, "a", "name", "n").join(_end(small, "b", "name", "n"), "key").where((F.col("name_a") > F.col("name_b")) & alike)
    order = F.struct("name", "n", *facts)
    ends = crowded.groupBy("key").agg(F.min(order).alias("low"), F.max(order).alias("high"))
    each = ends.select("key", F.explode(F.array("low", "high")).alias("end")).select("key", *[F.col(f"end.{c}").alias(f"{c}_b") for c in ("name", "n", *facts)])
    far = _end(crowded, "a", "name", "n", *facts).join(each, "key").where((F.col("name_a") != F.col("name_b")) & (alike if fit is None else fit))
    return met.select("name_a", "name_b").unionByName(far.select("name_a", "name_b")).distinct()


def classed(seats: DataFrame, nodes: DataFrame, classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(key, name, n, class)`` of crowded buckets, with the classes of digests ``(node, class)``; a class goes by the name of its root."""
    known = classes.join(nodes.select(F.col("digest").alias("node"), "name"), "node").select("name", F.xxhash64("class").alias("class"))
    rows = seats.where(F.col("crowd") > crowd).select("key", "name", "n").join(materialize(known, "named-classes"), "name", "left")
    return materialize(rows.select("key", "name", "n", F.coalesce("class", "name").alias("class")), "crowded")


def end_pairs(crowded: DataFrame, alike: Column, salt: int) -> DataFrame:
    """Names of members of crowded buckets with two members of other classes, others for each salt."""
    order = F.struct(F.xxhash64("name", F.lit(salt)), "name", "n", "class")
    ends = crowded.groupBy("key").agg(F.min(order).alias("low"), F.max(order).alias("high"))
    each = ends.select("key", F.explode(F.array("low", "high")).alias("end"))
    each = each.select("key", *[F.col(f"end.{c}").alias(f"{c}_b") for c in ("name", "n", "class")])
    met = _end(crowded, "a", "name", "n", "class").join(each, "key").where((F.col("class_a") != F.col("class_b")) & alike)
    return met.select(F.greatest("name_a", "name_b").alias("name_a"), F.least("name_a", "name_b").alias("name_b")).distinct()


def mixed(crowded: DataFrame) -> DataFrame:
    """``(name)`` of the members of crowded buckets that hold several classes."""
    several = crowded.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("key")
    return crowded.join(several, "key", "left_semi").select("name").distinct()


def every_pair(crowded: DataFrame, nodes: DataFrame, facts: Sequence[str], fit: Column, block: int = BLOCK) -> DataFrame:
    """Names of all pairs of different classes in crowded buckets that fulfil ``fit``, which may name the ``key`` too."""
    several = crowded.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count(F.lit(1)).alias("crowd")).where("x <> y")
    blocks = materialize(several.select("key", F.ceil(F.col("crowd") / block).cast("int").alias("blocks")), "blocks")
    mixed = crowded.join(blocks, "key", "left_semi")
    least = mixed.groupBy("name").agg(F.first("class").alias("class"), F.sort_array(F.collect_set("key")).alias("keys"))
    known = least.join(nodes.select("name", *facts), "name").withColumn("least", F.slice("keys", 1, LEAST))
    rows = known.select("name", "class", "least", *facts, F.explode("keys").alias("key")).join(blocks, "key")
    rows = materialize(rows.withColumn("block", F.pmod(F.col("name"), F.col("blocks")).cast("int")), "members")
    spread = rows.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = (side.select("key", "block", *[F.col(c).alias(f"{c}_{end}") for c in ("name", "class", "least", *facts)]) for side, end in ((left, "a"), (right, "b")))
        other = (F.col("name_a") > F.col("name_b")) & (F.col("class_a") != F.col("class_b"))
        # A pair that shares a lesser one of these buckets meets there and need not be told again.
        first = F.coalesce(F.array_min(F.array_intersect("least_a", "least_b")), F.col("key")) >= F.col("key")
        return a.join(b, ["key", "block"]).where(other & fit & first).select("name_a", "name_b")

    small, great = rows.where("blocks = 1"), rows.where("blocks > 1")
    return pairs(small, small).unionByName(pairs(great, spread.where("blocks > 1"))).distinct()

"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node and one join; each round is written to the
shared folder, so a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; a component is its smallest node.

    ``edges`` has two columns of nodes in any order; loops and repeats are
    allowed, edges with a null are ignored.
    """
    first, second = edges.columns
    ends = edges.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
    stars, path = materialize(ends.filter(F.col(first).isNotNull() & F.col(second).isNotNull()
                                          & (F.col("a") > F.col("b"))).distinct(), "stars")
    told = _print(stars)
    while told[0]:
        following, next_path = materialize(_small_star(_large_star(stars)), "stars")
        delete_path(edges.sparkSession, path)
        stars, path, before, told = following, next_path, told, _print(following)
        if told == before:
            break
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(centres)


def _print(stars: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(stars: DataFrame) -> DataFrame:
    """Hang every larger neighbour on the smallest node around."""
    around = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    return stars.join(least, stars.b == least.u).select("a", F.col("m").alias("b")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Hang every smaller neighbour on the smallest of them."""
    least = stars.groupBy("a").agg(F.min("b").alias("m"))
    moved = stars.join(least, "a").filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), "m")
    return moved.unionByName(least).select("a", F.col("m").alias("b")).distinct()

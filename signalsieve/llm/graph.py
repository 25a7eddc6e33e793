"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b: long): root is the smallest vertex it reaches.

    Each turn points every vertex to its smallest neighbour, follows the pointer once more, and rewrites
    the edges between the vertices pointed to, until no edge is left. Vertices should be hashes: then each
    turn leaves a fraction of the vertices, while ascending ids along a path would shrink by two a turn.
    Minima are combined before they are shuffled and no group is gathered. Tables between turns are
    written, not checkpointed: a checkpoint keeps the constraints of its plan, and these multiply with
    every turn. The joins are merge joins whatever the size; otherwise every join of every turn would
    leave a broadcast table on the driver.
    """
    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    edges = written(edges.where("a <> b").select(*ordered("a", "b")).distinct(), "edges")
    roots = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        further = nearest.select(F.col("v").alias("at"), F.col("p").alias("to"))
        pointers = written(
            nearest.join(further.hint("merge"), F.col("p") == F.col("at")).select("v", F.col("to").alias("p")), "pointers")
        if roots is None:
            roots = pointers.withColumnRenamed("p", "root")
        else:
            moved = pointers.withColumnsRenamed({"v": "at", "p": "to"}).hint("merge")
            roots = written(
                roots.join(moved, F.col("root") == F.col("at"), "left").select("v", F.coalesce("to", "root").alias("root")),
                "roots")
        first = pointers.withColumnsRenamed({"v": "a", "p": "pa"}).hint("merge")
        second = pointers.withColumnsRenamed({"v": "b", "p": "pb"}).hint("merge")
        edges = written(
            edges.join(first, "a").join(second, "b").where("pa <> pb").select(*ordered("pa", "pb")).distinct(), "edges")
        if edges.isEmpty():
            return roots

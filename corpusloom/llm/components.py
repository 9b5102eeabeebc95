"""Connected components of an edge table by rounds of contraction.

In a round every vertex goes to the first of itself and its neighbours in the order of a hash (so that
no chain of vertices is in order), and edges are rewritten to
where their ends went. Edges shrink from round to round until none is left; the moves, composed
from the last round back, lead every vertex to its component's vertex. Each round is written
to the shared folder, so lineage stays short, and nothing of the graph comes to the driver
but the number of edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import drop, stash


def placed(vertex: str) -> Column:
    """A vertex behind its hash, for comparisons."""
    return F.struct(F.xxhash64(vertex).alias("hash"), F.col(vertex).alias("vertex"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (vertex, component) for each vertex that has an edge to another.

    Loops, repeated edges and edges with a null end are passed over.
    """
    edges = stash(edges.select("u", "v").where("u <> v").distinct(), "edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(placed("v")).alias("least"))
        first = stash(least.select(F.col("u").alias("vertex"), F.least(placed("u"), F.col("least"))["vertex"].alias("to")), "moves")
        # A second step at once: where the place gone to itself goes.
        onward = first.select(F.col("vertex").alias("to"), F.col("to").alias("further"))
        move = stash(first.join(onward, "to").select("vertex", F.col("further").alias("to")), "moves")
        moves.append(move)
        ends = [move.select(F.col("vertex").alias(c), F.col("to").alias(f"{c}_to")) for c in ("u", "v")]
        rest = edges.join(ends[0], "u").join(ends[1], "v").where("u_to <> v_to").select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v"))
        rest = stash(rest.distinct(), "edges")
        drop(first, edges)
        edges = rest
    if not moves:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    drop(edges)
    found, spent = moves[-1].select("vertex", F.col("to").alias("component")), moves[-1]
    for move in reversed(moves[:-1]):
        later = found.select(F.col("vertex").alias("to"), "component")
        found = stash(move.join(later, "to", "left").select("vertex", F.coalesce("component", "to").alias("component")), "components")
        drop(spent, move)
        spent = found
    return found

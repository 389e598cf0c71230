"""Connected components of an edge table, without collecting edges or nodes anywhere.

Each round every node moves to the neighbour (itself included) of least random priority, edges follow their ends, and
loops and repeats go. A constant share of the nodes disappears each round, so rounds grow with the logarithm of the
longest path, whatever the ids look like. Each round's moves are a table in the shared folder; composed backwards,
they give every node its root. A hub's neighbours meet in a minimum that combines on the map side; the joins that move
edges to their new ends meet a hub's edges by its id, and rely on Spark to split a skewed side. An edge with a null end
is no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges``: a, b long. Returns node, root for every node with an edge; one root a component. Loops don't matter."""
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        turn = F.lit(len(moves))
        ends = live.select("a", "b").union(live.select("b", "a"))
        best = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("p"), F.col("b").alias("to"))).alias("best"))
        own = F.struct(F.xxhash64("a", turn).alias("p"), F.col("a").alias("to"))
        move = cut(best.select(F.col("a").alias("node"), F.least("best", own)["to"].alias("to")), f"{name}-moves")
        moves.append(move)
        for end in ("a", "b"):
            live = live.join(move, live[end] == move["node"]).select(*[F.col("to").alias(c) if c == end else F.col(c) for c in ("a", "b")])
        live = live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        live = cut(live, f"{name}-edges")
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[-1].select("node", F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = move.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots

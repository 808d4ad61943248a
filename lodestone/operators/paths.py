"""Simple paths of bounded length between two sets of nodes.

The walk goes level by level, one join for each.  Nodes that can't reach a target in the
steps left are cut off first by a backward search, which changes no result.  Where only
some paths are asked for, at most MOST_VISITS unfinished ones go on from a level, the first
in order, as the number of simple paths has no bound in the size of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shared import cut

MOST_NODES, MOST_PATHS = 8, 5
#: Fixed value: the budget of a search for some paths.
MOST_VISITS = 200_000


def paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most_nodes: int = MOST_NODES, visits: int | None = None) -> DataFrame:
    """Every simple path (src, dst edges; node columns of sources and targets), as an
    array: it ends at the first target after its source and has at most most_nodes nodes.
    With `visits`, so many unfinished paths at most go on from each level."""
    edges = cut(edges.select("src", "dst").distinct())
    goals = targets.select(F.col("node").alias("goal")).distinct()
    near = [goals.select(F.col("goal").alias("node"))]
    known, grows = -1, True
    for _ in range(most_nodes - 1):
        if grows:
            back = edges.join(near[-1], F.col("dst") == F.col("node")).select(F.col("src").alias("node"))
            near.append(cut(near[-1].union(back).distinct()))
            known, grows = (n := near[-1].count()), n != known
        else:  # all that reach a target at all are known
            near.append(near[-1])
    walk = sources.select("node").distinct().select(F.array("node").alias("path"), F.col("node").alias("last"))
    found = None
    for depth in range(2, most_nodes + 1):
        reach = near[most_nodes - depth]
        step = edges.join(reach, F.col("dst") == F.col("node"), "left_semi")
        longer = walk.join(step, F.col("last") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        longer = longer.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
        flagged = cut(longer.join(goals, F.col("last") == F.col("goal"), "left"))
        done = flagged.filter("goal IS NOT NULL").select("path")
        walk = flagged.filter("goal IS NULL").select("path", "last")
        if visits is not None:
            walk = walk.orderBy("path").limit(visits)
        found = done if found is None else found.union(done)
        if walk.isEmpty():
            break
    return found.distinct()


def find_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most_nodes: int = MOST_NODES, most_paths: int = MOST_PATHS, shortest: bool = False) -> DataFrame:
    """At most most_paths of them, with their number of nodes, short ones first.

    By default those that a depth-first walk over ascending neighbours meets first are
    kept (the lexicographic order of paths); shortest=True keeps the shortest."""
    every = paths(edges, sources, targets, most_nodes, MOST_VISITS).withColumn("nodes", F.size("path"))
    kept = every.orderBy("nodes", "path") if shortest else every.orderBy("path")
    return kept.limit(most_paths).orderBy("nodes", "path")


def hops(found: DataFrame, symbols: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """The path as text, hop, and the symbol at each hop, with its block's text if blocks
    are given."""
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    each = found.select(text.alias("path_text"), F.posexplode("path").alias("hop", "sym_id"))
    out = each.join(symbols, "sym_id").select("path_text", "hop", "sym_id", "name", "file_id", "line", "block_id")
    return out if blocks is None else out.join(blocks.select("block_id", "text"), "block_id", "left")

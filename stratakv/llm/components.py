"""Connected components of a table of edges, by contraction.

Each round hooks every node to its smallest neighbour, follows the hooks to
their ends two steps at a time, and replaces nodes by the ends; edges inside one
component vanish.  The rounds needed grow with the logarithm of a component's
size.  Tables are stored after each round, so plans stay short and lost
executors cost one round at most.

Cases: edges with a null end join nothing; loops and repeated edges do no harm;
an empty table gives none; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); the component is its smallest node. Loops and repeated edges do no harm."""
    both = edges.where("a <> b").select("a", "b").unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = stored(both.distinct(), "edges")
    found = None
    while not current.isEmpty():
        hooks = current.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hooks = stored(hooks, "hooks")
        while True:
            second = hooks.select(F.col("a").alias("m"), F.col("m").alias("end"))
            longer = stored(hooks.join(second, "m", "left").select("a", F.coalesce("end", "m").alias("m"), (F.coalesce("end", "m") != F.col("m")).alias("moved")), "hooks")
            moved = longer.where("moved").isEmpty()
            hooks = longer.select("a", "m")
            if moved:
                break
        if found is None:
            found = hooks.select(F.col("a").alias("node"), F.col("m").alias("component"))
        else:
            onward = hooks.select(F.col("a").alias("component"), F.col("m").alias("end"))
            found = found.join(onward, "component", "left").select("node", F.coalesce("end", "component").alias("component"))
        found = stored(found, "components")
        ends = hooks.select("a", F.col("m").alias("a2"))
        contracted = current.join(ends, "a").select("a2", "b").join(hooks.select(F.col("a").alias("b"), F.col("m").alias("b2")), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        current = stored(contracted.where("a <> b").distinct(), "edges")
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)

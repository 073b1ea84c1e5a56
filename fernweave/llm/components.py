"""Connected components by contraction.

In each round every vertex points to its least neighbour (or itself), pointers are followed twice more, and edges are
relabelled by what their ends point to; those within one vertex go. Dense groups vanish in a round or two and chains shrink by a
factor of four. Edges stay distributed, each round is written to the shared folder, and hubs go through lookup().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import drop_stored, lookup, stored


def through(rows: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """rows with column replaced by what it points to (pointers: v, p for each value)."""
    counted = rows.groupBy(column).agg(F.count("*").alias("__n"))
    facts = pointers.select(F.col("v").alias(column), F.col("p").alias("__p")).join(counted, column)
    moved = lookup(rows, column, facts, F.col("__n"), rows.count())
    return moved.withColumn(column, F.col("__p")).select(*rows.columns)


def _pointers(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("p")), "pointers")
    for _ in range(2):
        second = stored(through(first, "p", first), "pointers")
        drop_stored(first)
        first = second
    return first


def components(edges: DataFrame) -> DataFrame:
    """vertex and root (the component's least vertex) of every vertex of edges (a, b), both long.

    Loops count as edges of no other vertex and give no row; repeated edges do no harm; an
    empty table gives no rows.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = stored(now.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("root", F.col("vertex")), "labels")
    while now.limit(1).count():
        pointers = _pointers(now)
        half = stored(through(now, "a", pointers), "half")
        moved = through(half, "b", pointers).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        following = stored(moved.filter("a <> b").distinct(), "edges")
        # labels that are in no edge any more are final
        spread = labels.groupBy("root").agg(F.count("*").alias("n"))
        facts = spread.join(pointers.select(F.col("v").alias("root"), "p"), "root", "left").select("root", "n", F.coalesce("p", "root").alias("p"))
        new = stored(lookup(labels, "root", facts, F.col("n"), labels.count()).select("vertex", F.col("p").alias("root")), "labels")
        for old in (now, half, pointers, labels):
            drop_stored(old)
        now, labels = following, new
    return labels

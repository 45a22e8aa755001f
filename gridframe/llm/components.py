"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the least node that each node of ``edges`` can reach, in a stored table.

    Nodes of any orderable type.  Each round takes the least label of a node's
    neighbours, then the label of that label, so long chains shorten
    geometrically.  Nothing but a count comes to the driver.
    """
    both = stored(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).where("node <> other").distinct(), "edges")
    label = stored(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("comp")), "label")
    while True:
        least = both.join(label.select(F.col("node").alias("other"), F.col("comp").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        near = label.join(least, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = stored(near.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp")), "label")
        changed = new.where("old <> comp").limit(1).count()
        discard(label)
        label = new.drop("old")
        if not changed:
            discard(both)
            return label

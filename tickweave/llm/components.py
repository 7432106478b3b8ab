"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.runtime import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns id, label (smallest id reachable) for every id that is in ``links`` (columns a, b: long).

    Each round takes the smallest label among the neighbours and then the label
    of that label, so long chains shrink by more than half a round. A hub's
    neighbours are pre-aggregated before the shuffle. Rounds are cut by tables in
    the shared folder. Null ends and loops are ignored; no links, no rows.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.write(both.distinct(), "links")
    labels = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("id").alias("label"), F.col("label").alias("root"))
        new = scratch.write(step.join(root, "label").select("id", F.least("label", "root").alias("label"), "old"), "labels")
        changed = new.where("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not changed:
            scratch.drop(both)
            return labels.select("id", "label")

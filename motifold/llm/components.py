"""Connected components by label propagation with pointer jumping, as joins and minima.

Every round takes, per node, the least label among its neighbours (a grouped minimum, so a hot node is combined before
the shuffle) and then replaces each label by its own label.  Rounds end when no label changes; each
round's table is written to the shared work folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.work import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b); the component is its least node."""
    both = stage(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = stage(
        both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("component")
        ),
        "labels",
    )
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        met = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.least("component", F.coalesce("m", "component")).alias("next"), F.col("component").alias("old")
        )
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = stage(
            met.join(jump, F.col("next") == F.col("_n"), "left").select(
                "node", F.least("next", F.coalesce("_c", "next")).alias("component"), "old"
            ),
            "labels",
        )
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")

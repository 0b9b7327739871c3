"""Connected components of a link table, distributed.

Every node takes the least label among its own and its neighbours', then the label of
that label (pointer jumping), until nothing changes. Each round stores its narrow
columns; the driver sees one count a round. Minima are combined before the shuffle, so
a hub with any number of links is no hot group; the joins are plain equi-joins that
Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for all linked nodes; component is the least node reachable."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = stored(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    # a node's first label is the least of itself and its neighbours
    labels = stored(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v")
            .groupBy(F.col("u").alias("node")).agg(F.min("l").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        step = stored(lower, "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        # a label is itself a node, whose own label is as low or lower
        new = stored(
            step.join(jump, "label").select("node", "before", F.least("label", "next").alias("label")), "labels"
        )
        changed = new.filter("label <> before").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))

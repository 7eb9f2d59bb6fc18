"""Connected components of links between nodes, as iterated joins on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, staged


def least_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The least ``value`` that each node reaches.

    ``nodes(node, value)`` has one row per node, ``links(a, b)`` any links
    between them.  A label is the least node known so far, by value and then by
    node.  Each round looks up the label of every label (pointer jumping); the
    least one among a node's neighbours goes to the node and to the node of its
    label, so that whole clusters hook onto each other.  Rounds go on until no
    label changes; then all nodes of a component agree.  Every round is a table
    in the shared folder: lineage stays short and lost executors cost one round;
    tables of earlier rounds are deleted.  Returns (node, value, root): ``root`` is
    the node of the least value, the same for all nodes of a component, and for
    no others even where values repeat.
    """
    own = F.struct(F.col("value"), F.col("node").alias("at"))
    labels = held = staged(nodes.select("node", own.alias("label")), "labels")
    both = staged(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links"
    )
    while True:
        target = labels.select(F.col("node").alias("to"), F.col("label").alias("jump"))
        jumped = staged(
            labels.join(target, F.col("label.at") == F.col("to")).select("node", "label", "jump"),
            "jumped",
        )
        near = (
            both.join(jumped.select(F.col("node").alias("b"), "jump"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("jump").alias("near"))
        )
        hooked = jumped.join(near, "node", "left").select(
            "node", "label", F.least("jump", F.coalesce("near", "jump")).alias("least")
        )
        offers = hooked.select("node", F.col("label").alias("old"), "least").unionByName(
            hooked.where(F.col("label.at") != F.col("node")).select(
                F.col("label.at").alias("node"),
                F.lit(None).cast(hooked.schema["label"].dataType).alias("old"), "least",
            )
        )
        moved = staged(
            offers.groupBy("node").agg(F.max("old").alias("old"), F.min("least").alias("label")),
            "labels",
        )
        dropped(jumped, held)
        labels, held = moved.select("node", "label"), moved
        if moved.where(F.col("label") != F.col("old")).isEmpty():
            break
    dropped(both)
    return labels.select("node", F.col("label.value").alias("value"), F.col("label.at").alias("root"))

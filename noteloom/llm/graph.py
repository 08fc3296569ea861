"""Connected components over edge tables, for classes of linked texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import checkpointed


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) for each node of ``edges`` (a, b: long); comp is the least node of its component.

    Each round takes the least label among neighbours and then the label of one's label, so the
    number of rounds grows with the logarithm of a component's diameter. Labels stay in tables; the
    driver sees one count a round. Inputs of each join are checkpointed, so a hub's rows can be split
    by Spark's skew-join handling.
    """
    both = checkpointed(
        edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .union(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        .where("src <> dst")
        .distinct()
    )
    labels = checkpointed(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("comp")).withColumnRenamed("src", "node"))
    for _ in range(rounds):
        heard = (
            both.join(labels, both.dst == labels.node)
            .groupBy("src")
            .agg(F.min("comp").alias("heard"))
        )
        lower = checkpointed(
            labels.join(heard, labels.node == heard.src).select("node", F.least("comp", "heard").alias("comp"), F.col("comp").alias("was"))
        )
        up = lower.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        jumped = checkpointed(lower.join(up, "comp").select("node", F.col("top").alias("comp"), "was"))
        changed = jumped.where("comp <> was").limit(1).count()
        labels = jumped.select("node", "comp")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")

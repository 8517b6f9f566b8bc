"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds after which something must be wrong: labels travel twice as far with every round.
MOST_ROUNDS = 100
#: Rows of a partition of labels or links; fewer make shuffles of many empty files.
PARTITION_ROWS = 100_000


def components(links: DataFrame, lasting: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, part) for every node of links(a, b); part is the least node of its component.

    Each round gives a node the least label among its neighbours, then the label of its label. Labels
    stay in the table; the driver sees only whether any changed. Nodes with many links are split by
    skew joins, and their messages are combined before the shuffle.
    """

    def kept(df: DataFrame) -> DataFrame:
        df = lasting(df)
        return df.coalesce(1 + df.count() // PARTITION_ROWS)

    both = kept(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("part")))
    for _ in range(MOST_ROUNDS):
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "part", F.lit(None).cast(labels.schema["part"].dataType).alias("was"))
        told = labels.select("node", "part", F.col("part").alias("was")).union(heard)
        nearer = told.groupBy("node").agg(F.min("part").alias("part"), F.max("was").alias("was"))
        jump = labels.select(F.col("node").alias("part"), F.col("part").alias("next"))
        labels = kept(nearer.join(jump, "part").select("node", "was", F.least("part", "next").alias("part")))
        if labels.where("was <> part").isEmpty():
            break
        labels = labels.select("node", "part")
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", "part")

"""Connected components of a link table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limber.llm.common import written


#: Rows of a task; few links make few tasks, whatever the number of shuffle partitions.
ROWS_A_TASK = 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, label), the label being the smallest node of the component.

    Each round every node takes the smallest label among its neighbours' and
    then its label's label, so chains shorten by half or better; the rounds end
    when no label changes. A round's table is written, which cuts the lineage.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    n_tasks = 1 + both.count() // ROWS_A_TASK
    put = lambda df, name: written(df.coalesce(n_tasks), name)
    labels = put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = put(lower, "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = put(lower.join(jump, "label", "left").select("node", "old", F.coalesce("beyond", "label").alias("label")), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")

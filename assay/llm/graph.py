"""Connected components by least labels and pointer jumping, as joins of tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, label) for every node of edges (a, b), label being the least node of its component.

    edges: table that is cheap to read again. Self-links and repeated links do no harm; no edges give no rows."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    both = written(both.distinct(), f"{path}/both")
    labels = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), f"{path}/labels0")
    for step in range(1, 10_000):
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jumped"))
        new = lower.join(jump, "low").select("node", F.least("low", "jumped").alias("label"), (F.least("low", "jumped") < F.col("label")).alias("moved"))
        new = written(new, f"{path}/labels{step}")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")

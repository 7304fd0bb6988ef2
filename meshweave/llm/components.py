"""Connected components of a graph given by its links, without collecting it.

Labels fall to the least label among the neighbours and then to their label's
label, so distances halve each round. Every round is cut by a checkpoint in the
shared folder. Joins read stored tables on both sides, so adaptive execution can
split a node of very many links, and the minimum is combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``links`` (``u, v``); label: the least node of its component."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = common.cut(both.where(F.col("u") != F.col("v")))
    labels = common.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = common.cut(
            labels.join(near.withColumnRenamed("u", "node"), "node", "left")
            .select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        )
        jumped = common.cut(
            hooked.join(hooked.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
            .select("node", F.col("next").alias("label"), (F.col("next") != F.col("before")).alias("moved"))
        )
        moved = not jumped.where("moved").isEmpty()
        labels = jumped.select("node", "label")
        if not moved:
            return labels

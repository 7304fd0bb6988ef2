"""Edges of triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..runtime import cut
from ..schema import AXES, SEGMENT


def triangle_edges(triangles: DataFrame) -> DataFrame:
    """``tri_idx, edge_no, object_id`` and the ends of all three edges of each triangle."""
    def edge(i: int, a: str, b: str):
        return F.struct(F.lit(i).alias("edge_no"), *[F.col(a + x).alias("s" + x) for x in AXES], *[F.col(b + x).alias("e" + x) for x in AXES])

    three = F.explode(F.array(edge(0, "p", "q"), edge(1, "q", "r"), edge(2, "r", "p")))
    return triangles.select("tri_idx", "object_id", three.alias("x")).select("tri_idx", "object_id", "x.*")


def unique_edges(triangles: DataFrame) -> DataFrame:
    """Undirected edges with equal ends (to 1e-5) once, with the objects that own them.

    The ends are those of the first triangle that has the edge; owners stand in the
    order of their first triangles.
    """
    ends = [F.struct(*[g.quantise(F.col(c + a)).alias(a) for a in AXES]) for c in "se"]
    rows = triangle_edges(triangles).select("tri_idx", "edge_no", "object_id", *SEGMENT, F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))
    spread = [F.col(f"{end}.{a}").alias(f"{end}_{a}") for end in ("low", "high") for a in AXES]
    rows = rows.select("tri_idx", "edge_no", "object_id", *SEGMENT, *spread)
    keys = [f"{end}_{a}" for end in ("low", "high") for a in AXES]
    # a hash leads the key: rows sort by one number, and the rest decides only where hashes are equal
    own = F.transform(F.array_sort(F.collect_list(F.struct("tri_idx", "edge_no", "object_id"))), lambda x: x["object_id"])
    found = rows.groupBy(F.xxhash64(*keys).alias("_hash"), *keys).agg(
        F.min(F.struct("tri_idx", "edge_no", *SEGMENT)).alias("x"),
        F.array_distinct(own).alias("source_objects"), F.count("*").alias("n_triangles"),
    )
    key = F.struct(*[F.struct(*[F.col(f"{end}_{a}").alias(a) for a in AXES]).alias(end) for end in ("low", "high")])
    return found.select(key.alias("key"), *[F.col(f"x.{c}") for c in SEGMENT], "source_objects", "n_triangles")


def numbered(rows: DataFrame, *order: str, name: str = "edge_idx", start: int = 0) -> DataFrame:
    """``rows`` with a dense number in the order of columns, without a single sorting task.

    Rows are dealt out by range; each range's first number is the count of those before it.
    """
    from pyspark.sql.window import Window

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt)  # the ranges must not be drawn anew
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = dealt.join(F.broadcast(offsets.select("_part", "_first", "_before")), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + start).drop("_part", "_at", "_first", "_before")

"""Sparse grid statistics of a dataset, and selectivity estimation from two of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import AXES
from .objects import dataset_bounds, features


@dataclass(frozen=True)
class Grid:
    """A frame of ``res`` cells along each axis."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    res: int = 128

    @classmethod
    def world(cls, size: float, res: int = 128) -> Grid:
        return cls((0.0,) * 3, (float(size),) * 3, res)

    @classmethod
    def around(cls, triangles: DataFrame, res: int = 128) -> Grid:
        row = dataset_bounds(triangles).first()
        return cls(tuple(row[f"min_{a}"] for a in AXES), tuple(row[f"max_{a}"] for a in AXES), res)

    @property
    def cell(self) -> tuple[float, float, float]:
        return tuple((h - low) / self.res for low, h in zip(self.low, self.high))

    @property
    def cell_volume(self) -> float:
        x, y, z = self.cell
        return x * y * z

    def index(self, axis: int, x: Column) -> Column:
        """The cell of a coordinate, towards zero."""
        t = (x - self.low[axis]) / self.cell[axis]
        return F.when(t < 0, F.ceil(t)).otherwise(F.floor(t)).cast("int")


def cell_statistics(triangles: DataFrame, grid: Grid) -> DataFrame:
    """``cell_idx, center_count, touch_count, avg_size_mean, vol_ratio`` of the cells that objects touch or centre in."""
    return cells_of(features(triangles), grid)


def cells_of(objects: DataFrame, grid: Grid) -> DataFrame:
    """The same from object features."""
    res = grid.res
    centre = [(F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in AXES]
    at = [grid.index(i, c) for i, c in enumerate(centre)]
    inside = (at[0] >= 0) & (at[0] < res) & (at[1] >= 0) & (at[1] < res) & (at[2] >= 0) & (at[2] < res)
    span = []
    for i, a in enumerate(AXES):
        low = F.greatest(F.lit(0), grid.index(i, F.col(f"min_{a}")))
        high = F.least(F.lit(res - 1), grid.index(i, F.col(f"max_{a}") - 1e-5))
        span.append(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))
    rows = objects.select("avg_size", "vol_ratio", F.when(inside, g.cell_index(*[x.cast("long") for x in at], res)).alias("own"), *[s.alias(f"s{a}") for s, a in zip(span, AXES)])
    centred = rows.where("own is not null").select(F.col("own").alias("cell_idx"), F.lit(1).alias("c"), F.lit(0).alias("t"), F.lit(0.0).alias("size"), F.lit(0.0).alias("ratio"))
    touched = rows.select("*", F.explode("sx").alias("ix")).select("*", F.explode("sy").alias("iy")).select("*", F.explode("sz").alias("iz"))
    touched = touched.select(g.cell_index(F.col("ix").cast("long"), F.col("iy").cast("long"), F.col("iz").cast("long"), res).alias("cell_idx"), F.lit(0).alias("c"), F.lit(1).alias("t"), F.col("avg_size").alias("size"), F.col("vol_ratio").alias("ratio"))
    n = F.sum("t")
    mean = lambda c: F.coalesce(F.sum(c) / F.nullif(n, F.lit(0)), F.lit(0.0))
    return touched.unionByName(centred).groupBy("cell_idx").agg(F.sum("c").alias("center_count"), n.alias("touch_count"), mean("size").alias("avg_size_mean"), mean("ratio").alias("vol_ratio"))


def global_means(cells: DataFrame) -> DataFrame:
    """One row: size and volume ratio over all cells, weighted by touch count; 0 and 1 without cells."""
    weighted = lambda c: F.sum(F.col(c) * F.col("touch_count")) / F.nullif(F.sum("touch_count"), F.lit(0))
    return cells.agg(F.coalesce(weighted("avg_size_mean"), F.lit(0.0)).alias("avg_size"), F.coalesce(weighted("vol_ratio"), F.lit(1.0)).alias("vol_ratio"))


def joined_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that both sides touch, by an equi-join on the cell."""
    side = lambda df, n: df.where("touch_count > 0").select("cell_idx", F.col("touch_count").alias(f"t{n}"), F.col("avg_size_mean").alias(f"s{n}"), F.col("vol_ratio").alias(f"r{n}"))
    return side(a, "a").join(side(b, "b"), "cell_idx")


def estimate(a: DataFrame, b: DataFrame, grid: Grid, other: Grid | None = None, gamma: float = 0.8, epsilon: float = 0.001, alpha: bool = True, load_factor: float = 0.5) -> DataFrame:
    """One row: raw and corrected number of pairs expected, and advisory table sizes.

    ``a`` and ``b`` are cell statistics; both must have the same frame.
    """
    if other is not None and other != grid:
        raise ValueError(f"the two sides have different grids: {grid} and {other}")
    volume = grid.cell_volume
    both = joined_cells(a, b)
    reach = F.col("sa") + F.col("sb") + epsilon
    chance = F.least(F.lit(1.0), reach * reach * reach / F.lit(volume) * F.pow(F.sqrt(F.col("ra") * F.col("rb")), F.lit(gamma)))
    raw = both.agg(F.coalesce(F.sum(F.col("ta") * F.col("tb") * chance), F.lit(0.0)).alias("raw"))
    means = global_means(a).select(F.col("avg_size").alias("sa"), F.col("vol_ratio").alias("ra")).crossJoin(global_means(b).select(F.col("avg_size").alias("sb"), F.col("vol_ratio").alias("rb")))  # one row each
    size = F.col("sa") * F.cbrt("ra") + F.col("sb") * F.cbrt("rb")
    factor = F.greatest(F.lit(1.0), size * size * size / F.lit(max(volume, 1e-9))) if alpha else F.lit(1.0)
    rows = raw.crossJoin(means).select("raw", factor.alias("alpha")).withColumn("expected", F.floor(F.col("raw") / F.col("alpha")).cast("long"))
    wanted = F.floor(F.col("expected") / load_factor).cast("long")
    clamp = lambda top: F.greatest(F.lit(1024).cast("long"), F.least(wanted, F.lit(top).cast("long")))
    odd = lambda n: n + F.when(n % 2 == 0, 1).otherwise(0)
    return rows.withColumns({
        "table_pow2": F.when(F.col("expected") == 0, F.lit(1 << 24).cast("long")).otherwise(g.next_power_of_two(clamp(1 << 30))),
        "table_odd": odd(clamp(1 << 30)),
        "table_odd_direct": odd(clamp(1 << 31)),
    })

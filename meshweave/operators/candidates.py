"""Box joins: the broad phase of all spatial joins, as an equi-join on grid cells.

Cells of level n have sides of ``2 ** n``. A box stands at the level whose cells are just as large as
it is, so it touches at most 8 cells of that level and of each coarser one. A pair meets at
the coarser of its two levels, in the one cell that holds the low corner of the
boxes' common part, so no pair is made twice and nothing needs a distinct. Which levels are in
use is one small aggregate over both sides, the only job that runs before the lazy plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import AXES, BOX

#: Levels of boxes without extent and of the largest ones.
LEAST, MOST = -24, 60


def usable(df: DataFrame, *columns: str) -> DataFrame:
    """The rows whose coordinates are all there and finite, in columns that cannot be null (which keeps generated code small)."""
    columns = columns or BOX
    fine = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in columns])
    return df.where(fine).withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def extent(axes: tuple[str, ...] = AXES) -> Column:
    return F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes])


def level_of(size: Column, finer: int = 0) -> Column:
    """The level of a box of a size; ``finer`` levels below it."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1e-300)))) - finer, F.lit(LEAST)), F.lit(MOST)).cast("int")


def levels_of(*sides: DataFrame, size: Column | None = None, finer: int = 0) -> list[int]:
    """The levels in use on any side, at most ``MOST - LEAST + 1`` numbers: one job."""
    found = reduce(DataFrame.unionByName, [df.select(level_of(extent() if size is None else size, finer).alias("level")) for df in sides])
    return sorted(r[0] for r in found.distinct().collect())


def _placed(df: DataFrame, prefix: str, levels: list[int]) -> DataFrame:
    """One row for each cell of each level that a box takes part in."""
    rows = df.select(*[F.col(c).alias(prefix + c) for c in df.columns], level_of(extent()).alias(prefix + "level"))
    rows = rows.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(prefix + "level"))))
    size = F.pow(F.lit(2.0), F.col("level"))
    for a in AXES:
        low, high = (F.floor(F.col(f"{prefix}{m}_{a}") / size) for m in ("min", "max"))
        rows = rows.withColumn(f"cell_{a}", F.explode(F.sequence(low, high)))
    return rows


def box_join(a: DataFrame, b: DataFrame, reach: float = 0.0, predicate: Column | None = None) -> DataFrame:
    """Pairs of rows whose boxes intersect; columns get the prefixes ``a_`` and ``b_``.

    Both sides have ``min_x`` to ``max_z``; rows with unusable boxes meet nothing. With ``reach``
    boxes up to that far apart meet; ``predicate`` replaces the strict intersection of boxes.
    """
    a, b = usable(a), usable(b)
    if reach:
        wide = {f"{m}_{x}": F.col(f"{m}_{x}") + (reach if m == "max" else -reach) for m in ("min", "max") for x in AXES}
        kept = {f"own_{c}": F.col(c) for c in BOX}
        a = a.withColumns(kept).withColumns(wide)
        b = b.withColumns({f"own_{c}": F.col(c) for c in BOX})
    levels = levels_of(a, b) or [0]
    left, right = _placed(a, "a_", levels), _placed(b, "b_", levels)
    size = F.pow(F.lit(2.0), F.col("level"))
    met = left.join(right, ["level", "cell_x", "cell_y", "cell_z"])
    once = F.col("level") == F.greatest("a_level", "b_level")
    for x in AXES:
        once = once & (F.col(f"cell_{x}") == F.floor(F.greatest(f"a_min_{x}", f"b_min_{x}") / size))
    closed = lambda x: (F.col(f"a_min_{x}") <= F.col(f"b_max_{x}")) & (F.col(f"b_min_{x}") <= F.col(f"a_max_{x}"))
    test = (closed("x") & closed("y") & closed("z")) if reach else g.boxes_intersect()
    met = met.where(once & (predicate if predicate is not None else test)).drop("level", "a_level", "b_level", "cell_x", "cell_y", "cell_z")
    if reach:
        names = {f"{s}_{c}" for s in "ab" for c in BOX}
        met = met.select(*[c for c in met.columns if c not in names and "_own_" not in c], *[F.col(f"{n[0]}_own_{n[2:]}").alias(n) for n in sorted(names)])
    return met


def candidate_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a_object_id, b_object_id`` of objects (with boxes) whose boxes strictly intersect."""
    keep = lambda df: df.select("object_id", *BOX)
    return box_join(keep(a), keep(b)).select("a_object_id", "b_object_id")

"""Distance joins on a grid, by equi-joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cell index at most, either way; coordinates beyond share the outermost cell and are told apart by the exact test.
_EDGE = float(1 << 31) - 2


def cell(c: Column, size: float) -> Column:
    return F.floor(F.greatest(F.least(c / F.lit(size), F.lit(_EDGE)), F.lit(-_EDGE))).cast("bigint")


def cell_key(cx: Column, cy: Column) -> Column:
    """One bigint for both indices."""
    return F.shiftleft(cx, 32).bitwiseXOR(cy.bitwiseAND(F.lit(0xFFFFFFFF)))


def finite(*cs: Column) -> Column:
    ok = F.lit(True)
    for c in cs:
        ok = ok & c.isNotNull() & (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c)
    return ok


def near_pairs(points: DataFrame, id_col: str, x: str, y: str, radius: float, cell_factor: int = 3) -> DataFrame:
    """(left_id, right_id), left_id < right_id, of points at most `radius` apart (straight line, inclusive).

    Points without x or y, or with NaN or infinite ones, have no pairs; rows that repeat an id never pair with
    each other, and each pair of rows comes out once. Other columns are ignored. Cells are `cell_factor` radii wide: a
    point stays in its cell and is copied only to those of the cells west, south-east, south and south-west whose
    points it could reach, so most points are copied less than once. Both sides are hashed on the cell; a crowded
    cell is split by AQE's skew join.
    """
    size = radius * cell_factor * 1.0000001 if radius > 0 else 1.0
    p = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(finite(F.col("x"), F.col("y")) & F.col("id").isNotNull())
    p = p.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
    home = p.select(cell_key(F.col("cx"), F.col("cy")).alias("cell"), F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    # reach, with room for rounding: what lies further from the cell's edge than this can't be near a point beyond it
    reach = radius * 1.000001 + 1e-6
    west = F.col("x") - F.col("cx") * F.lit(size) <= reach + F.abs(F.col("x")) * 1e-12
    south = F.col("y") - F.col("cy") * F.lit(size) <= reach + F.abs(F.col("y")) * 1e-12
    north = (F.col("cy") + 1) * F.lit(size) - F.col("y") <= reach + F.abs(F.col("y")) * 1e-12
    outer = (F.abs(F.col("cx")) >= _EDGE - 1) | (F.abs(F.col("cy")) >= _EDGE - 1)
    key = lambda dx, dy: cell_key(F.col("cx") - dx, F.col("cy") - dy)
    copies = F.array_compact(
        F.array(
            F.struct(key(0, 0).alias("cell"), F.lit(True).alias("own")),
            *[F.when(cond | outer, F.struct(key(dx, dy).alias("cell"), F.lit(False).alias("own"))) for dx, dy, cond in ((1, 0, west), (0, 1, south), (1, 1, west & south), (1, -1, west & north))],
        )
    )
    away = p.select(F.explode(copies).alias("c"), F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")).select("c.cell", "c.own", "b", "bx", "by")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    # within a cell each pair meets twice and is kept once; across cells it meets once
    hits = home.join(away, "cell").where(F.when(F.col("own"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")) & (F.abs(dx) <= radius) & (F.abs(dy) <= radius) & (F.sqrt(dx * dx + dy * dy) <= radius))
    return hits.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))

"""Fixed grid over an extent, with one more cell for everything outside."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """``cells_x`` by ``cells_y`` equal cells, numbered row by row from the bottom left, plus the overflow cell."""

    # fixed values: the default extent and cell counts
    left: float = -74.02
    top: float = 40.82
    right: float = -73.76
    bottom: float = 40.61
    cells_x: int = 2
    cells_y: int = 2

    def __post_init__(self):
        if self.cells_x < 1 or self.cells_y < 1 or not (self.left < self.right and self.bottom < self.top):
            raise ValueError("a grid needs a positive extent and at least one cell")

    @property
    def size_x(self) -> float:
        return (self.right - self.left) / self.cells_x

    @property
    def size_y(self) -> float:
        return (self.top - self.bottom) / self.cells_y

    @property
    def overflow(self) -> int:
        return self.cells_x * self.cells_y

    @property
    def count(self) -> int:
        """Number of cells, the overflow cell included."""
        return self.overflow + 1

    def _offsets(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (x - F.lit(float(self.left))) / F.lit(self.size_x), (y - F.lit(float(self.bottom))) / F.lit(self.size_y)

    def cell(self, x: Column, y: Column) -> Column:
        """Cell of a point; each axis is checked, so every point outside the extent is in the overflow cell."""
        dx, dy = self._offsets(x, y)
        inside = (dx >= 0) & (dx < self.cells_x) & (dy >= 0) & (dy < self.cells_y)
        number = F.floor(dx) + F.floor(dy) * F.lit(self.cells_x)
        return F.when(inside, number).otherwise(F.lit(self.overflow)).cast("int")

    def cell_compat(self, x: Column, y: Column) -> Column:
        """Cell of a point as integer truncation and one check of the flattened number give it.

        Points less than a cell left of or below the extent fall in the first column or row, and points right of it
        wrap into the next row. Missing, non-finite and very far coordinates go to the overflow cell.
        """
        dx, dy = self._offsets(x, y)
        number = dx.try_cast("int") + dy.try_cast("int").cast("long") * F.lit(self.cells_x)
        inside = (number >= 0) & (number < self.overflow)
        return F.when(inside, number).otherwise(F.lit(self.overflow)).cast("int")

    def centers(self, spark: SparkSession) -> DataFrame:
        """``(cell, lon, lat)`` of the centre of every cell inside the extent."""
        column, row = F.col("cell") % self.cells_x, F.floor(F.col("cell") / self.cells_x)
        return spark.range(self.overflow).select(F.col("id").cast("int").alias("cell")).select(
            "cell",
            (F.lit(float(self.left)) + (column + F.lit(0.5)) * F.lit(self.size_x)).alias("lon"),
            (F.lit(float(self.bottom)) + (row + F.lit(0.5)) * F.lit(self.size_y)).alias("lat"),
        )

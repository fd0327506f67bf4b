"""Rectangles and points: windows, nearest, and joins by grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECT = ("xmin", "ymin", "xmax", "ymax")


def rect(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """A point is a rectangle without area."""
    return df.withColumns({"xmin": F.col(x), "xmax": F.col(x), "ymin": F.col(y), "ymax": F.col(y)})


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def intersects(a: str = "", b: tuple[float, float, float, float] = (0, 0, 0, 0)) -> Column:
    """Whether a rectangle touches another; edges count."""
    x1, y1, x2, y2 = b
    return (_c(a, "xmin") <= x2) & (_c(a, "xmax") >= x1) & (_c(a, "ymin") <= y2) & (_c(a, "ymax") >= y1)


def window(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Four comparisons, which the scan's statistics can use when files are sorted by cell()."""
    return df.where(intersects("", (xmin, ymin, xmax, ymax)))


def area() -> Column:
    return (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))


def min_dist2(x: float, y: float) -> Column:
    dx = F.greatest(F.col("xmin") - x, F.lit(0.0), x - F.col("xmax"))
    dy = F.greatest(F.col("ymin") - y, F.lit(0.0), y - F.col("ymax"))
    return dx * dx + dy * dy


def nearest(df: DataFrame, x: float, y: float, k: int, id_col: str = "id") -> DataFrame:
    return df.withColumn("dist2", min_dist2(x, y)).orderBy("dist2", id_col).limit(k)


def cell(size: float, x: Column, y: Column) -> Column:
    return F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))


def cluster(df: DataFrame, size: float, partitions: int) -> DataFrame:
    """Rows sorted by grid cell, to be written: then windows skip files and row groups."""
    c = cell(size, F.col("xmin"), F.col("ymin"))
    return df.withColumn("_cell", c).repartitionByRange(partitions, "_cell").sortWithinPartitions("_cell").drop("_cell")


def join_windows(points: DataFrame, windows: DataFrame, size: float, point_id: str = "id", window_id: str = "wid") -> DataFrame:
    """(window id, point id) of points inside windows: both meet by grid cell, each pair once, as a point has one cell."""
    w = windows.withColumn("_cell", F.explode(F.flatten(F.transform(F.sequence(F.floor(F.col("xmin") / size), F.floor(F.col("xmax") / size)), lambda cx: F.transform(F.sequence(F.floor(F.col("ymin") / size), F.floor(F.col("ymax") / size)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))))
    w = w.select(F.col(window_id), "_cell", *[F.col(c).alias(f"w_{c}") for c in RECT])
    p = points.withColumn("_cell", cell(size, F.col("x"), F.col("y")))
    inside = F.col("x").between(F.col("w_xmin"), F.col("w_xmax")) & F.col("y").between(F.col("w_ymin"), F.col("w_ymax"))
    return p.join(w, "_cell").where(inside).select(window_id, point_id)

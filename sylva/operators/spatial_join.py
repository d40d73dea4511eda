"""Range joins of boxes on a grid.

Catalyst plans overlap conditions as a nested loop. Here each box is listed in the grid cells that it touches, the
join is an equi-join on cells, and a pair counts only in the cell of its reference point (the larger of the two
lower corners), so each pair comes out once without a distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.geometry import box, near_box, touches


def cell_of(value: Column, cell: float) -> Column:
    return F.floor(value / F.lit(float(cell)))


def in_cells(df: DataFrame, cell: float, prefix: str = "") -> DataFrame:
    """df with a row for each grid cell (_gx, _gy) that its box touches."""
    b = box(prefix)
    spread = lambda low, high: F.explode(F.sequence(cell_of(low, cell), cell_of(high, cell)))
    return df.withColumn("_gx", spread(b["x0"], b["x1"])).withColumn("_gy", spread(b["y0"], b["y1"]))


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def grid_join(left: DataFrame, right: DataFrame, cell: float, on: tuple[str, ...] = (), condition: Column | None = None) -> DataFrame:
    """Pairs of boxes that touch, with columns a_* and b_*, equal in the columns `on` and true under `condition`.

    cell: about twice the median side of the boxes. Rows without a box match nothing. Cells with very many boxes are
    split by adaptive skew handling, as the join is a plain equi-join.
    """
    whole = lambda df, p: in_cells(renamed(df.dropna(subset=["x0", "y0", "x1", "y1"]), p), cell, p)
    a, b = whole(left, "a_"), renamed(whole(right, "b_").withColumnsRenamed({"_gx": "gx", "_gy": "gy"}), "")
    match = (F.col("_gx") == F.col("gx")) & (F.col("_gy") == F.col("gy"))
    for key in on:
        match = match & (F.col("a_" + key) == F.col("b_" + key))
    x, y = box("a_"), box("b_")
    once = (F.col("_gx") == cell_of(F.greatest(x["x0"], y["x0"]), cell)) & (F.col("_gy") == cell_of(F.greatest(x["y0"], y["y0"]), cell))
    joined = a.join(b, match & touches(x, y) & once & (F.lit(True) if condition is None else condition))
    return joined.drop("_gx", "_gy", "gx", "gy")


def grid_semi(left: DataFrame, right: DataFrame, cell: float, on: tuple[str, ...], condition: Column) -> DataFrame:
    """Rows of left (a_*) that touch a row of right (b_*) under `condition`, once for each cell where they meet one.

    The join stops at the first row that meets, so no pairs are made.
    """
    whole = lambda df, p: in_cells(renamed(df.dropna(subset=["x0", "y0", "x1", "y1"]), p), cell, p)
    a, b = whole(left, "a_"), whole(right, "b_").withColumnsRenamed({"_gx": "gx", "_gy": "gy"})
    match = (F.col("_gx") == F.col("gx")) & (F.col("_gy") == F.col("gy"))
    for key in on:
        match = match & (F.col("a_" + key) == F.col("b_" + key))
    met = a.join(b, match & touches(box("a_"), box("b_")) & condition, "left_semi")
    return met.select(*[F.col(f"`a_{c}`").alias(c) for c in left.columns])


def near_join(left: DataFrame, right: DataFrame, on: tuple[str, ...], eps: float = 1e-3) -> DataFrame:
    """Pairs of boxes (a_*, b_*) whose edges differ by less than eps each, equal in the columns `on`.

    The four edges in cells of about 1000 eps are the key, so only boxes that are nearly the same meet. A left box is
    listed in each cell within eps of its edges, which mostly is one.
    """
    side = 1024 * eps
    a, b = (renamed(df.dropna(subset=["x0", "y0", "x1", "y1"]), p) for df, p in ((left, "a_"), (right, "b_")))
    match = F.lit(True)
    for k in box():
        low, high = (cell_of(F.col("a_" + k) + s * 1.001 * eps, side) for s in (-1, 1))
        a = a.withColumn("_c" + k, F.explode(F.sequence(low, high)))
        b = b.withColumn("c" + k, cell_of(F.col("b_" + k), side))
        match = match & (F.col("_c" + k) == F.col("c" + k))
    for key in on:
        match = match & (F.col("a_" + key) == F.col("b_" + key))
    return a.join(b, match & near_box(box("a_"), box("b_"), eps)).drop(*[p + k for k in box() for p in ("_c", "c")])


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float, on: tuple[tuple[str, str], ...] = (), condition: Column | None = None) -> DataFrame:
    """Points (x, y) with the boxes (a_*) that they lie in; on: pairs of equal columns (of points, of boxes)."""
    listed = in_cells(renamed(boxes.dropna(subset=["x0", "y0", "x1", "y1"]), "a_"), cell, "a_")
    spots = points.withColumn("gx", cell_of(F.col("x"), cell)).withColumn("gy", cell_of(F.col("y"), cell))
    match = (F.col("_gx") == F.col("gx")) & (F.col("_gy") == F.col("gy"))
    for p, b in on:
        match = match & (F.col(p) == F.col("a_" + b))
    b = box("a_")
    within = F.col("x").between(b["x0"], b["x1"]) & F.col("y").between(b["y0"], b["y1"])
    return spots.join(listed, match & within & (F.lit(True) if condition is None else condition)).drop("_gx", "_gy", "gx", "gy")

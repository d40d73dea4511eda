"""Statistics of pixels in circles around detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.geometry import box, dbl, in_circle, ndvi
from sylva.operators.raster import pixel_number
from sylva.operators.spatial_join import points_in_boxes


def circles(df: DataFrame, share: float = 1.0) -> DataFrame:
    """df with the circle (cx, cy, radius) around its box, and the box of that circle in x0 to y1; share: of the radius."""
    b = box()
    r = F.sqrt((b["x1"] - b["x0"]) * (b["x1"] - b["x0"]) + (b["y1"] - b["y0"]) * (b["y1"] - b["y0"])) / 2 * dbl(share)
    named = df.select("*", ((b["x0"] + b["x1"]) / 2).alias("cx"), ((b["y0"] + b["y1"]) / 2).alias("cy"), r.alias("radius"))
    return named.withColumns({"x0": F.col("cx") - F.col("radius"), "y0": F.col("cy") - F.col("radius"), "x1": F.col("cx") + F.col("radius"), "y1": F.col("cy") + F.col("radius")})


def zonal_stats(df: DataFrame, pixels: DataFrame, key: str, image: str, share: float = 0.5, cell: float = 16.0) -> DataFrame:
    """(key, n_pixels, height, height_pixel, index_min, index_max, index_mean, index_var) of each row; -1 without pixels.

    pixels: (image_id, r, c, red, nir, h); a pixel's place is its corner (c, r). height_pixel is the number of the
    first pixel, row by row, with the greatest height. The variance is that of the population. One join and one
    aggregation give all statistics; both combine before the shuffle.
    """
    places = circles(df.select(key, F.col(image).alias("image_id"), "x0", "y0", "x1", "y1"), share)
    spots = pixels.select("image_id", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), "r", "c", "h", ndvi(F.col("red"), F.col("nir")).alias("v"))
    inside = in_circle(F.col("x"), F.col("y"), F.col("a_cx"), F.col("a_cy"), F.col("a_radius"))
    found = points_in_boxes(spots, places, cell, (("image_id", "image_id"),), inside)
    order = -pixel_number(F.col("r"), F.col("c"))
    stats = found.groupBy(F.col(f"a_{key}").alias(key)).agg(
        F.count("*").alias("n_pixels"), F.max(F.struct("h", order.alias("k"))).alias("top"), F.min("v").alias("index_min"), F.max("v").alias("index_max"), F.avg("v").alias("index_mean"), F.var_pop("v").alias("index_var")
    )
    joined = df.select(key).join(stats, key, "left")
    or_none = lambda c: F.coalesce(c, dbl(-1))
    return joined.select(
        key,
        F.coalesce("n_pixels", F.lit(0).cast("long")).alias("n_pixels"),
        or_none(F.col("top.h")).alias("height"),
        F.coalesce(-F.col("top.k"), F.lit(-1).cast("long")).alias("height_pixel"),
        *[or_none(F.col(c)).alias(c) for c in ("index_min", "index_max", "index_mean", "index_var")],
    )

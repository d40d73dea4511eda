"""Tile grids with buffers, their flags against outlines, and the choice of tiles for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.geometry import box, box_area, box_ring, crosses, dbl, grown, stem, tile_id
from sylva.functions.overlay import SLACK, union_area, with_cover
from sylva.operators.spatial_join import grid_join


def extents(images: DataFrame) -> DataFrame:
    """images (c, f, a, e, width, height) with their bounds x0, y0, x1, y1."""
    right, bottom = F.col("c") + F.col("a") * F.col("width"), F.col("f") + F.col("e") * F.col("height")
    return images.withColumns({"x0": F.least("c", right), "x1": F.greatest("c", right), "y0": F.least("f", bottom), "y1": F.greatest("f", bottom)})


def tile_grid(images: DataFrame, width: int, height: int, buffer: int, crs: int, full_only: bool = False) -> DataFrame:
    """(image_id, tile_id, minx, miny, x0, y0, x1, y1) of every tile; the box is the tile with its buffer.

    Tiles begin at the lower left corner, one for each step that starts within the image; full_only leaves out the
    last, partial ones. Sequences run over whole steps, as they don't take doubles.
    """
    whole = F.floor if full_only else F.ceil
    steps = lambda low, high, size: F.explode(F.sequence(F.lit(0).cast("long"), whole((F.col(high) - F.col(low)) / dbl(size)).cast("long") - 1))
    grid = extents(images).withColumn("_i", steps("x0", "x1", width)).withColumn("_j", steps("y0", "y1", height))
    x, y = F.col("x0") + F.col("_i") * width, F.col("y0") + F.col("_j") * height
    named = tile_id(stem(F.col("file_name")), x, y, F.lit(width), F.lit(buffer), F.lit(crs))
    return grid.select(
        "image_id", named.alias("tile_id"), x.alias("minx"), y.alias("miny"), (x - buffer).alias("x0"), (y - buffer).alias("y0"), (x + width + buffer).alias("x1"), (y + height + buffer).alias("y1")
    )


def coverage_flags(tiles: DataFrame, outlines: DataFrame, buffer: float, cell: float) -> DataFrame:
    """tiles with only_forest (the outlines together cover the buffered tile) and only_urban (none meets it).

    Outlines count only if they cross the tile without its buffer. Outlines that overlap or abut are one area. Outlines with
    a column rings are polygons (shapes), others boxes.
    """
    a, b = box("a_"), box("b_")
    plain = {"x0": a["x0"] + dbl(buffer), "y0": a["y0"] + dbl(buffer), "x1": a["x1"] - dbl(buffer), "y1": a["y1"] - dbl(buffer)}
    shaped = "rings" in outlines.columns
    met = grid_join(tiles.select("tile_id", "x0", "y0", "x1", "y1"), outlines.select("x0", "y0", "x1", "y1", *(["rings"] if shaped else [])), cell, condition=crosses(plain, b))
    by = [F.col("a_tile_id").alias("tile_id"), *[F.col("a_" + k).alias(k) for k in a]]
    if shaped:  # a polygon may miss the tile that its box meets
        whole, inner = (met.groupBy(*by).agg(F.collect_list("b_rings").alias("covers")).withColumn("rings", F.array(box_ring(grown(box(), -m)))) for m in (0.0, buffer))
        covered = with_cover(whole.select("tile_id", "rings", "covers"), "rings", "covers").join(with_cover(inner.select(F.col("tile_id").alias("_id"), "rings", "covers"), "rings", "covers").filter("covered > 0").select("_id"), F.col("tile_id") == F.col("_id"))
        covered = covered.select("tile_id", F.col("covered").alias("_covered"))
    else:
        covered = met.groupBy(*by).agg(F.collect_list(F.struct(*[v.alias(k) for k, v in b.items()])).alias("covers")).select("tile_id", union_area(F.col("covers"), box()).alias("_covered"))
    known = tiles.join(covered, "tile_id", "left")
    return known.withColumn("only_forest", F.coalesce(F.col("_covered") >= box_area(box()) * (1 - SLACK), F.lit(False))).withColumn("only_urban", F.col("_covered").isNull()).drop("_covered")


def tiles_for(tiles: DataFrame, exclude: tuple[str, ...]) -> DataFrame:
    """Tiles without any of the flags set."""
    keep: Column = F.lit(True)
    for flag in exclude:
        keep = keep & ~F.col(flag)
    return tiles.filter(keep)


def dual_route(tiles: DataFrame) -> DataFrame:
    """Tiles with the model that runs on them: the urban one leaves out forest, the forest one urban; mixed tiles get both."""
    urban = tiles_for(tiles, ("only_forest",)).withColumn("model", F.lit("urban"))
    return urban.unionByName(tiles_for(tiles, ("only_urban",)).withColumn("model", F.lit("forest")))

"""Joins of images, heights, tiles and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.geometry import box, box_area, clipped, crosses, dbl, grown, inside, merged_name, pixel_to_geo, regex_identifier, stem, touches
from sylva.functions.overlay import SLACK, union_area, with_cover
from sylva.operators.spatial_join import grid_join


def height_match(images: DataFrame, heights: DataFrame, image_pattern: str, height_pattern: str, groups: int) -> DataFrame:
    """Every image with the height raster of the same identifier, or null."""
    a = images.withColumn("key", regex_identifier(F.col("file_name"), image_pattern, groups))
    b = heights.select(regex_identifier(F.col("file_name"), height_pattern, groups).alias("key"), F.col("file_name").alias("height_name"))
    return a.join(b.filter("key IS NOT NULL").groupBy("key").agg(F.max("height_name").alias("height_name")), "key", "left")


def layer_match(layers: DataFrame, heights: DataFrame, first: tuple[str, str, int], second: tuple[str, str, int]) -> DataFrame:
    """Layers with their height raster by the first pair of patterns, else by the second; layers without one go."""
    one = height_match(layers, heights, *first).withColumnRenamed("height_name", "_one").drop("key")
    two = height_match(one, heights, *second).drop("key")
    return two.withColumn("height_name", F.coalesce("_one", "height_name")).drop("_one").filter("height_name IS NOT NULL")


def adjacency(images: DataFrame, eps: float = 1e-3, batch: str | None = None) -> DataFrame:
    """(image_id, neighbour, side) of images whose origins differ by one image width or height, within eps.

    An equi-join on rounded corners: the tolerance is met by looking at the rounded value and the two beside it.
    batch: pairs of different batches only. Sides right and down name each pair of neighbours once.
    """
    step = 4 * eps
    at = lambda v: F.floor(v / dbl(step))
    here = images.select(F.col("image_id"), "c", "f", (F.col("a") * F.col("width")).alias("w"), (F.col("e") * F.col("height")).alias("h"), *([F.col(batch).alias("batch")] if batch else []))
    sides = {"right": (F.col("c") + F.col("w"), F.col("f")), "left": (F.col("c") - F.col("w"), F.col("f")), "down": (F.col("c"), F.col("f") + F.col("h")), "up": (F.col("c"), F.col("f") - F.col("h"))}
    wanted = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), x.alias("x"), y.alias("y")) for s, (x, y) in sides.items()]))
    a = here.withColumn("want", wanted).select("image_id", "want.*", *(["batch"] if batch else [])).withColumn("kx", at(F.col("x"))).withColumn("ky", at(F.col("y")))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    b = here.select(F.col("image_id").alias("neighbour"), "c", "f", *([F.col("batch").alias("other")] if batch else [])).withColumn("_i", near).withColumn("_j", near)
    b = b.withColumn("kx", at(F.col("c")) + F.col("_i")).withColumn("ky", at(F.col("f")) + F.col("_j"))
    found = a.join(b, ["kx", "ky"]).filter((F.abs(F.col("x") - F.col("c")) < dbl(eps)) & (F.abs(F.col("y") - F.col("f")) < dbl(eps)))
    found = found.filter("batch <> other") if batch else found
    return found.groupBy("image_id", "side").agg(F.max("neighbour").alias("neighbour"))


def merged_images(images: DataFrame, eps: float = 1e-3) -> DataFrame:
    """One row for each pair of neighbours, right and down, with the merged image's name."""
    pairs = adjacency(images, eps).filter(F.col("side").isin("right", "down"))
    own = images.select("image_id", F.col("file_name").alias("first"), "c", "f", "a", "e", "width", "height")
    other = images.select(F.col("image_id").alias("neighbour"), F.col("file_name").alias("last"), F.col("c").alias("nc"), F.col("f").alias("nf"))
    joined = pairs.join(own, "image_id").join(other, "neighbour")
    corners = [F.col("c"), F.col("f"), F.col("nc") + F.col("a") * F.col("width"), F.col("nf") + F.col("e") * F.col("height")]
    return joined.select("image_id", "neighbour", "side", merged_name(stem(F.col("first")), stem(F.col("last")), corners).alias("merged_name"))


def within_tile(crowns: DataFrame, tiles: DataFrame, key: str, shrink: float = 1.0) -> DataFrame:
    """Crowns that lie within their own tile's box, shrunk on all sides."""
    boxes = tiles.select(F.col(key), *[F.col(k).alias("t_" + k) for k in ("x0", "y0", "x1", "y1")])
    return crowns.join(boxes, key).filter(inside(box(), grown(box("t_"), -shrink))).select(*crowns.columns)


def outline_cover(crowns: DataFrame, outlines: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, within, meets) of the crowns whose box touches that of an outline: whether they lie within the union of all outlines, and meet it.

    Where both tables have a column rings, crowns and outlines are polygons (shapes), else boxes. The outlines that touch
    one crown are gathered, few as they are.
    """
    shaped = "rings" in crowns.columns and "rings" in outlines.columns
    more = ["rings"] if shaped else []
    met = grid_join(crowns.select(key, "x0", "y0", "x1", "y1", *more), outlines.select("x0", "y0", "x1", "y1", *more), cell)
    by = [F.col("a_" + k).alias(k) for k in (key, "x0", "y0", "x1", "y1")]
    if shaped:
        known = met.groupBy(*by).agg(F.first("a_rings").alias("rings"), F.collect_list("b_rings").alias("covers"))
        known = with_cover(known.select(key, "rings", "covers"), "rings", "covers")
        return known.select(key, (F.col("covered") >= F.col("area") * (1 - SLACK)).alias("within"), (F.col("covered") > 0).alias("meets"))
    known = met.groupBy(*by).agg(F.collect_list(F.struct(*[v.alias(k) for k, v in box("b_").items()])).alias("covers"))
    return known.select(key, (union_area(F.col("covers"), box()) >= box_area(box()) * (1 - SLACK)).alias("within"), F.lit(True).alias("meets"))


def exclude_within(crowns: DataFrame, outlines: DataFrame, key: str, cell: float) -> DataFrame:
    """Crowns that don't lie within the union of the outlines."""
    return crowns.join(outline_cover(crowns, outlines, key, cell).filter("within").select(key), key, "left_anti")


def fuse(forest: DataFrame, urban: DataFrame, outlines: DataFrame, key: str, cell: float) -> DataFrame:
    """Forest crowns that meet an outline, and urban crowns that don't lie within the union of the outlines."""
    inner = forest.join(outline_cover(forest, outlines, key, cell).filter("meets").select(key), key, "left_semi")
    return inner.withColumn("model", F.lit("forest")).unionByName(exclude_within(urban, outlines, key, cell).withColumn("model", F.lit("urban")), allowMissingColumns=True)


def layer_extent(df: DataFrame, buffer: float = 0.0) -> DataFrame:
    """Bounds of a whole layer, grown by a buffer; nulls for an empty one."""
    low = lambda c: (F.min(c) - dbl(buffer)).alias(c)
    high = lambda c: (F.max(c) + dbl(buffer)).alias(c)
    return df.agg(low("x0"), low("y0"), high("x1"), high("y1"))


def within_extent(df: DataFrame, layer: DataFrame, group: str) -> DataFrame:
    """Rows that cross the extent of the other layer's rows of the same group."""
    extent = layer.groupBy(group).agg(F.min("x0").alias("e_x0"), F.min("y0").alias("e_y0"), F.max("x1").alias("e_x1"), F.max("y1").alias("e_y1"))
    return df.join(extent, group).filter(touches(box(), box("e_"))).select(*df.columns)


def clip_to_bounds(df: DataFrame, bounds: dict, inset: float = 2.0) -> DataFrame:
    """Boxes cut to the bounds less an inset; what is empty then goes."""
    ordered = {"x0": F.least("x0", "x1"), "x1": F.greatest("x0", "x1"), "y0": F.least("y0", "y1"), "y1": F.greatest("y0", "y1")}
    cut = clipped(ordered, grown(bounds, -inset))
    out = df.select(*[c for c in df.columns if c not in cut], *[v.alias(k) for k, v in cut.items()])
    return out.filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))


def project(preds: DataFrame, tiles: DataFrame, key: str = "tile_id") -> DataFrame:
    """Predictions with their rings (pixel column and row) in world coordinates, and the tile's reference system.

    tiles: (key, crs, a, b, c, d, e, f). Predictions without a tile have a null ring and reference system. Points are the
    centres of pixels.
    """
    t = {k: F.col("_t." + k) for k in "abcdef"}
    known = tiles.select(key, F.struct(*"abcdef").alias("_t"), "crs")
    place = lambda p: [v.alias(n) for v, n in zip(pixel_to_geo(t, p["y"], p["x"], centre=True), "xy", strict=True)]
    return preds.join(known, key, "left").withColumn("ring", F.when(F.col("_t").isNotNull(), F.transform("ring", lambda p: F.struct(*place(p))))).drop("_t")


def by_stem(images: DataFrame, files: DataFrame, order: tuple[str, ...] = ("gpkg", "json"), name: str = "file_name") -> DataFrame:
    """images with the file (name) of the same stem, of the first kind of `order` that there is; null if there is none."""
    kind = F.regexp_extract("name", r"\.([^.]*)$", 1)
    rank = F.array_position(F.array(*map(F.lit, order)), kind)
    best = files.withColumn("_rank", rank).filter("_rank > 0").groupBy(stem(F.col("name")).alias("_stem")).agg(F.min(F.struct("_rank", "name"))["name"].alias("match"))
    return images.join(best, stem(F.col(name)) == F.col("_stem"), "left").drop("_stem")


def extent_overlap(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """(group, x0, y0, x1, y1) of what the extents of two layers have in common, group by group; groups without any go."""
    extent = lambda df, p: df.groupBy(group).agg(*[(F.min if k in ("x0", "y0") else F.max)(k).alias(p + k) for k in ("x0", "y0", "x1", "y1")])
    joined = extent(left, "l_").join(extent(right, "r_"), group)
    return joined.select(group, *[v.alias(k) for k, v in clipped(box("l_"), box("r_")).items()]).filter("x0 < x1 AND y0 < y1")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of the left table that the right one lacks, to be reported."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")

"""Operations on rasters in long form: a row for each pixel (image_id, r, c, values)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.geometry import dbl, ndvi, rescale, to_8_bit
from sylva.functions.polygons import RING, apply_kernel, as_structs, convex_hull, label
from sylva.functions.repair import voronoi_cells
from sylva.runtime import materialise


def ndvi_pixels(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("ndvi", ndvi(F.col("red"), F.col("nir")))


def minmax_rescale(pixels: DataFrame, band: str, top: float = 255.0) -> DataFrame:
    """The band of each image stretched to 0..top. The range is one small row for each image, joined back."""
    span = pixels.groupBy("image_id").agg(F.min(band).alias("_low"), F.max(band).alias("_high"))
    return pixels.join(span, "image_id").withColumn("scaled", rescale(F.col(band), F.col("_low"), F.col("_high"), top)).drop("_low", "_high")


def bit_rescale(pixels: DataFrame, bands: tuple[str, ...], probe: str) -> DataFrame:
    """Bands to 8 bits in the images whose probe band goes beyond 255."""
    most = pixels.groupBy("image_id").agg(F.max(probe).alias("_most"))
    return pixels.join(most, "image_id").withColumns({b: to_8_bit(F.col(b), F.col("_most")) for b in bands}).drop("_most")


def resample_box(pixels: DataFrame, scale: float, band: str) -> DataFrame:
    """Mean of the pixels that fall into one pixel of the smaller raster."""
    at = lambda c: F.floor(F.col(c) * dbl(scale)).alias(c)
    return pixels.groupBy("image_id", at("r"), at("c")).agg(F.avg(band).alias(band), F.count("*").alias("n"))


def resize_nearest(pixels: DataFrame, sizes: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize from sizes to target (rows, columns): each target pixel takes source floor(i * src / dst)."""
    rows, cols = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in target)
    grid = pixels.select("image_id").distinct().withColumn("tr", rows).withColumn("tc", cols)
    grid = grid.withColumns({"r": F.floor(F.col("tr") * dbl(sizes[0] / target[0])).cast("long"), "c": F.floor(F.col("tc") * dbl(sizes[1] / target[1])).cast("long")})
    return grid.join(pixels, ["image_id", "r", "c"]).drop("r", "c").withColumnsRenamed({"tr": "r", "tc": "c"})


def resample_bilinear(pixels: DataFrame, sizes: tuple[int, int], target: tuple[int, int], band: str) -> DataFrame:
    """Bilinear resize from sizes to target (rows, columns), pixel centres aligned; missing neighbours leave their weight to the others."""
    spans = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in target]
    grid = pixels.select("image_id").distinct().withColumn("tr", spans[0]).withColumn("tc", spans[1])
    for axis, size, out in (("r", sizes[0], target[0]), ("c", sizes[1], target[1])):
        at = (F.col(f"t{axis}") + dbl(0.5)) * dbl(size / out) - dbl(0.5)
        at = F.least(F.greatest(at, dbl(0)), dbl(size - 1))
        two = F.array(F.struct(F.floor(at).alias(axis), (1 - (at - F.floor(at))).alias(f"w{axis}")), F.struct((F.floor(at) + 1).alias(axis), (at - F.floor(at)).alias(f"w{axis}")))
        grid = grid.withColumn("_n", F.explode(two)).select("*", "_n.*").drop("_n").filter(F.col(f"w{axis}") > 0)
    met = grid.join(pixels.select("image_id", "r", "c", band), ["image_id", "r", "c"])
    weight = F.col("wr") * F.col("wc")
    return met.groupBy("image_id", "tr", "tc").agg((F.sum(F.col(band) * weight) / F.sum(weight)).alias(band)).withColumnsRenamed({"tr": "r", "tc": "c"})


def window_scan(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Pixels of a window [first, last), renumbered from its corner; the range reaches the parquet scan."""
    found = pixels.filter((F.col("r") >= rows[0]) & (F.col("r") < rows[1]) & (F.col("c") >= cols[0]) & (F.col("c") < cols[1]))
    return found.withColumns({"r": F.col("r") - rows[0], "c": F.col("c") - cols[0]})


def center_crop(pixels: DataFrame, images: DataFrame, rows: int, cols: int) -> DataFrame:
    """The window of that size at the centre of each image (image_id, height, width), its corner not below 0."""
    top = F.greatest(F.floor((F.col("height") - rows) / 2), F.lit(0)).alias("_top")
    left = F.greatest(F.floor((F.col("width") - cols) / 2), F.lit(0)).alias("_left")
    found = pixels.join(images.select("image_id", top, left), "image_id")
    found = found.filter((F.col("r") >= F.col("_top")) & (F.col("r") < F.col("_top") + rows) & (F.col("c") >= F.col("_left")) & (F.col("c") < F.col("_left") + cols))
    return found.withColumns({"r": F.col("r") - F.col("_top"), "c": F.col("c") - F.col("_left")}).drop("_top", "_left")


def mosaic(first: DataFrame, second: DataFrame, value: str, nodata_above: float = 1e10, keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Pixels (keys, value) of both; where both have one, the first wins unless it has no data. No data is 0 in the end."""
    known = lambda c: F.when(F.abs(c) <= dbl(nodata_above), c)
    a, b = (df.select(*keys, known(F.col(value)).alias(n)) for df, n in ((first, "_a"), (second, "_b")))
    return a.join(b, list(keys), "full").select(*keys, F.coalesce("_a", "_b", dbl(0)).alias(value))


def pixel_number(row: Column, col: Column) -> Column:
    """One number for a pixel of a raster of any width, in the order of rows, then columns."""
    return row * (1 << 32) + col


def masked(value: Column, above: float) -> Column:
    """Null where the value isn't above the limit: null, not NaN, which Spark orders above all numbers."""
    return F.when(value > dbl(above), value)


def local_maxima(pixels: DataFrame, size: int, above: float, band: str = "h") -> DataFrame:
    """Pixels that are the largest of the size x size pixels around them. Two window passes, rows then columns.

    The windows are spread by image and row or column, so one image isn't one task.
    """
    half = size // 2
    across = Window.partitionBy("image_id", "r").orderBy("c").rangeBetween(-half, half)
    down = Window.partitionBy("image_id", "c").orderBy("r").rangeBetween(-half, half)
    seen = pixels.withColumn("_row", F.max(masked(F.col(band), above)).over(across)).withColumn("_max", F.max("_row").over(down))
    return seen.filter((F.col(band) > dbl(above)) & (F.col(band) == F.col("_max"))).drop("_row", "_max")


def smooth(pixels: DataFrame, sigma: float, band: str = "h", reach: float = 4.0) -> DataFrame:
    """Gaussian mean along rows, then columns. Beyond its border an image is mirrored, border pixels twice; missing pixels have no weight.

    Each pixel gives its weighted value to the places around it, and around its mirror images that are near the border.
    """
    half = max(1, int(reach * sigma + 0.5))
    weights = F.array(*[F.struct(F.lit(k).alias("k"), dbl(math.exp(-0.5 * (k / sigma) ** 2)).alias("w")) for k in range(-half, half + 1)])
    size = pixels.groupBy("image_id").agg((F.max("r") + 1).alias("_r"), (F.max("c") + 1).alias("_c"))
    places = pixels.select("image_id", "r", "c")
    for axis in ("c", "r"):
        n, at = F.col(f"_{axis}"), F.col(axis)
        images = F.filter(F.array(at, -1 - at, 2 * n - 1 - at, 2 * n + at, at - 2 * n), lambda v: (v >= -half) & (v < n + half))  # noqa: B023
        targets = F.flatten(F.transform(images, lambda v: F.transform(weights, lambda x: F.struct((v + x["k"]).alias("t"), x["w"].alias("w")))))
        inside = F.filter(targets, lambda x: (x["t"] >= 0) & (x["t"] < n))  # noqa: B023
        spread = pixels.join(size, "image_id").select("image_id", "r", "c", band, F.explode(inside).alias("o")).withColumn(axis, F.col("o.t"))
        means = spread.groupBy("image_id", "r", "c").agg((F.sum(F.col(band) * F.col("o.w")) / F.sum("o.w")).alias(band))
        pixels = means.join(places, ["image_id", "r", "c"], "left_semi")
    return pixels


def nearest_seed(pixels: DataFrame, seeds: DataFrame, reach: float) -> DataFrame:
    """The nearest seed (seed_id, image_id, x, y) of each pixel: raster form of clipped Voronoi cells.

    Ties go to the smaller seed_id; an image without seeds has no cells. Seeds are listed in the grid cells around them,
    so a pixel meets only near ones. Pixels without a seed within reach are looked at again with twice the reach.
    """
    live = pixels.join(seeds.select("image_id").distinct(), "image_id", "left_semi").select("image_id", "r", "c")
    found = None
    while True:
        near = materialise(nearest_within(live, seeds, reach), "cells")
        found = near if found is None else found.unionByName(near)
        live = materialise(live.join(near, ["image_id", "r", "c"], "left_anti"), "far")
        if live.isEmpty():
            return found
        reach = 2 * reach


def nearest_within(pixels: DataFrame, seeds: DataFrame, reach: float) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / dbl(reach))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    listed = seeds.withColumn("_dx", around).withColumn("_dy", around).select("seed_id", "image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), (at("x") + F.col("_dx")).alias("_gx"), (at("y") + F.col("_dy")).alias("_gy"))
    spots = pixels.withColumns({"x": F.col("c").cast("double"), "y": F.col("r").cast("double")}).withColumn("_gx", at("x")).withColumn("_gy", at("y"))
    square = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    met = spots.join(listed, ["image_id", "_gx", "_gy"]).withColumn("d2", square).filter(F.col("d2") <= dbl(reach * reach))
    return met.groupBy("image_id", "r", "c").agg(F.min(F.struct("d2", "seed_id")).alias("n")).select("image_id", "r", "c", F.col("n.seed_id").alias("seed_id"), F.col("n.d2").alias("d2"))


def cell_share(cells: DataFrame, pixels: DataFrame, above: float, share: float) -> DataFrame:
    """For each seed's cell: how many pixels, which share is above the limit, and what becomes of it: whole, hull or drop."""
    joined = cells.join(pixels, ["image_id", "r", "c"])
    high = F.col("h") > dbl(above)
    out = joined.groupBy("image_id", "seed_id").agg(F.count("*").alias("n_pixels"), F.avg(high.cast("int")).alias("share"), F.bool_and(high).alias("_all"))
    verdict = F.when(F.col("_all"), "whole").when(F.col("share") >= dbl(share), "hull").otherwise("drop")
    return out.withColumn("verdict", verdict).drop("_all")


def patch_max(patches: DataFrame, width: int, size: int) -> DataFrame:
    """(vec_id, pos, value): local maxima of square patches kept as one array of float each."""
    half = size // 2
    flat = patches.select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    flat = flat.withColumns({"r": F.floor(F.col("pos") / width), "c": F.col("pos") % width})
    across = Window.partitionBy("vec_id", "r").orderBy("c").rangeBetween(-half, half)
    down = Window.partitionBy("vec_id", "c").orderBy("r").rangeBetween(-half, half)
    seen = flat.withColumn("_row", F.max("value").over(across)).withColumn("_max", F.max("_row").over(down))
    return seen.filter(F.col("value") == F.col("_max")).select("vec_id", "pos", "value")


def stacked(pixels: DataFrame, bands: list[str], order: list[int] | None = None, out: str = "bands") -> DataFrame:
    """The bands of each pixel as one array, in the order of their numbers if one is given."""
    chosen = bands if order is None else [bands[i] for i in order]
    return pixels.withColumn(out, F.array(*[F.col(b) for b in chosen])).drop(*bands)


def resize_mask(mask: Column, height: int, width: int, rows: int, cols: int) -> Column:
    """A mask (an array of height x width numbers of 0 to 1, row by row) resized bilinearly, then cut to whole numbers: what isn't 1 throughout is 0."""

    def source(i: Column, n: int, target: int) -> tuple[Column, Column, Column]:
        at = F.least(F.greatest((i + 0.5) * dbl(n / target) - 0.5, dbl(0)), dbl(n - 1))
        low = F.floor(at).cast("int")
        return low, F.least(low + 1, F.lit(n - 1)), at - low

    def value(p: Column) -> Column:
        (a, b, u), (x, y, v) = source(F.floor(p / cols), height, rows), source(p % cols, width, cols)
        at = lambda r, c: F.get(mask, r * width + c).cast("double")
        return ((at(a, x) * (1 - v) + at(a, y) * v) * (1 - u) + (at(b, x) * (1 - v) + at(b, y) * v) * u).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), value)


def components_of(cells: DataFrame, group: str, row: str = "r", col: str = "c") -> DataFrame:
    """(group, r, c, component) of pixels: 4-connected regions, numbered from 1 in the order of their first pixel. A group's pixels meet in one task."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}

    def run(table: pa.Table) -> pa.Table:
        r, c = table[row].to_numpy(), table[col].to_numpy()
        mask = np.zeros((int(r.max() - r.min()) + 1, int(c.max() - c.min()) + 1), bool)
        mask[r - r.min(), c - c.min()] = True
        found = label(mask, False)[r - r.min(), c - c.min()]
        return pa.table([table[group], table[row], table[col], pa.array(found, pa.int64())], names=[group, row, col, "component"])

    return cells.select(group, row, col).groupBy(group).applyInArrow(run, f"`{group}` {kinds[group]}, `{row}` {kinds[row]}, `{col}` {kinds[col]}, component long")


def cell_crowns(cells: DataFrame, pixels: DataFrame, above: float, share: float) -> DataFrame:
    """(image_id, seed_id, verdict, ring) of the cells that are kept: the hull of all pixels of a whole one, of those above the limit of another; null for fewer than three."""
    kept = cell_share(cells, pixels, above, share).filter("verdict <> 'drop'").select("image_id", "seed_id", "verdict")
    points = cells.join(pixels.select("image_id", "r", "c", "h"), ["image_id", "r", "c"]).filter(F.col("h") > dbl(above)).join(kept, ["image_id", "seed_id"])
    grouped = points.groupBy("image_id", "seed_id", "verdict").agg(F.collect_list(F.struct(F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))).alias("points"))
    return apply_kernel(grouped, "points", convex_hull).drop("points")


def vector_cells(seeds: DataFrame, group: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    """(group, seed_id, ring) of seeds (group, seed_id, x, y): Voronoi cells clipped to the bounds; unbounded ones have none and go. A group's seeds meet in one task."""
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def run(table: pa.Table) -> pa.Table:
        rings = voronoi_cells(np.stack([table[c].to_numpy() for c in "xy"], axis=1), bounds)
        return pa.table([table[group], table["seed_id"], pa.array([as_structs(r) for r in rings], kind)], names=[group, "seed_id", "ring"])

    types = {f.name: f.dataType.simpleString() for f in seeds.schema}
    return seeds.select(group, "seed_id", "x", "y").groupBy(group).applyInArrow(run, f"`{group}` {types[group]}, seed_id {types['seed_id']}, ring {RING}").filter("ring IS NOT NULL")

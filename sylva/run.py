"""The whole run: image files to cleaned crowns, with settings, manifests and plug-in detectors.

process_files() joins the parts that the operators give: headers and height files, tiles and their flags, detection,
stitching, fusion of two models, cleaning with statistics of pixels, and the final sink. A file that can't be read, or a
detector that fails on a tile, is reported and doesn't end the run; images that the manifest lists as done under the same
settings are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import geometry as g
from sylva.functions.geometry import box, dbl
from sylva.functions.polygons import RING, apply_kernel, simplify
from sylva.operators import clean, images, manifest, tiling
from sylva.operators.detect import Detector
from sylva.operators.zonal import zonal_stats
from sylva.runtime import materialise, release, ship
from sylva.sources import geotiff, rasters, shapes, vector
from sylva.sources.config import RunConfig

FOUND = f"file_name string, tile_id string, score double, ring {RING}, error string"


def headers_of(spark: SparkSession, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """(headers, failures) of the images that the settings name."""
    files = rasters.files_of(spark, config.image_directory, "*.tif").filter(F.col("file_name").rlike(config.image_regex))
    if config.exclude_files:
        files = files.filter(~F.col("file_name").isin(*config.exclude_files))
    good, bad = manifest.split_failures(materialise(rasters.read_headers(files), "headers"))
    return good, bad.select("file_name", "error")


def outlines_of(spark: SparkSession, path: str) -> DataFrame:
    """The outlines of a layer as shapes with their boxes; parts that can't be read or hold nothing go."""
    read = shapes.layers_of if path.endswith((".gpkg", ".shp")) else None
    rows = read(spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "content")) if read else vector.read_geojson(spark, path)
    rows = rows.filter(F.size("rings") > 0).withColumn("b", g.ring_box(F.flatten("rings")))
    return rows.select("rings", *[F.col("b")[k].alias(k) for k in ("x0", "y0", "x1", "y1")])


def detect_tiles(files: DataFrame, tiles: DataFrame, detector: Detector) -> DataFrame:
    """(file_name, tile_id, score, ring, error) of all that a detector finds in the tiles of image files, in world coordinates.

    An image is decoded once for all of its tiles, in one task; images are spread. A tile is the band stack of its pixels.
    """
    listed = tiles.groupBy("file_name").agg(F.collect_list(F.struct("tile_id", "x0", "y0", "x1", "y1")).alias("tiles"))
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def found_in(name: str, content: bytes, boxes: list[dict]) -> Iterator[tuple]:
        try:
            head, image = geotiff.header(content), geotiff.decode(content)
        except ValueError as error:
            yield name, None, None, None, str(error)
            return
        a, c, e, f = (head[k] for k in "acef")
        for t in boxes:
            cols, rows = sorted(((t["x0"] - c) / a, (t["x1"] - c) / a)), sorted(((t["y0"] - f) / e, (t["y1"] - f) / e))
            (left, right), (top, bottom) = ((max(0, int(np.floor(u))), min(n, int(np.ceil(v)))) for (u, v), n in ((cols, image.shape[2]), (rows, image.shape[1])))
            if left >= right or top >= bottom:
                continue
            try:
                for score, ring in detector(image[:, top:bottom, left:right]):
                    yield name, t["tile_id"], float(score), [{"x": c + a * (left + x + 0.5), "y": f + e * (top + y + 0.5)} for x, y in ring], None
            except Exception as error:  # whatever a detector that plugs in may raise
                yield name, t["tile_id"], None, None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.float64(), kind, pa.string()]
        for batch in batches:
            for name, content, boxes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                made = list(found_in(name, content.as_py(), boxes))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], names=["file_name", "tile_id", "score", "ring", "error"])

    return files.join(listed, "file_name").select("file_name", "content", "tiles").mapInArrow(run, FOUND)


def stitched(found: DataFrame, tiles: DataFrame, config: RunConfig) -> DataFrame:
    """Crowns of an image from those of its tiles: simplified, and within their tile's box less a unit."""
    thin = apply_kernel(found, "ring", lambda r: simplify(r, config.simplify_tolerance), "thin").drop("ring").withColumnRenamed("thin", "ring").filter(g.is_valid_ring(F.col("ring")))
    boxed = thin.withColumn("b", g.ring_box(F.col("ring"))).select("file_name", "tile_id", "score", "ring", *[F.col("b")[k].alias(k) for k in ("x0", "y0", "x1", "y1")])
    return images.within_tile(boxed, tiles, "tile_id").withColumn("rings", F.array("ring"))


def statistics(crowns: DataFrame, heads: DataFrame, files: DataFrame, heights: DataFrame) -> DataFrame:
    """(pid, height, index_mean, index_var) of each crown from the pixels of its image (first band red, last near infrared) and height file."""
    own = heads.select("file_name", "a", "c", "e", "f")
    placed = crowns.join(own, "file_name")
    at = {"x0": (F.col("x0") - F.col("c")) / F.col("a"), "x1": (F.col("x1") - F.col("c")) / F.col("a"), "y0": (F.col("y1") - F.col("f")) / F.col("e"), "y1": (F.col("y0") - F.col("f")) / F.col("e")}
    places = placed.select("pid", F.col("file_name").alias("image_id"), *[v.alias(k) for k, v in at.items()])
    colours = rasters.decode_rasters(files, ["red", "nir"], lambda data: geotiff.decode(data)[[0, -1]])
    tall = rasters.decode_rasters(heights.select("file_name", "content"), ["h"], rasters.tiff_decoder)
    pixels = colours.join(tall, ["file_name", "r", "c"], "left").select(F.col("file_name").alias("image_id"), "r", "c", "red", "nir", F.coalesce("h", dbl(-1)).alias("h"))
    return zonal_stats(places, pixels, "pid", "image_id").select("pid", "height", "index_mean", "index_var")


def cleaned(crowns: DataFrame, found: DataFrame, heads: DataFrame, config: RunConfig) -> DataFrame:
    """The crowns that the rules keep, in their output schema."""
    known = materialise(clean.containment_counts(crowns.join(found, "pid"), "file_name", threshold=config.containment_threshold), "counted")
    bounds = tiling.extents(heads).select("file_name", *[F.col(k).alias("e_" + k) for k in ("x0", "y0", "x1", "y1")])
    inside = known.join(bounds, "file_name")
    fits = clean.height_passes(F.col("height"), config.height_threshold) & clean.index_passes(F.col("index_mean"), F.col("index_var"), config.ndvi_mean_threshold, config.ndvi_var_threshold)
    chosen = clean.containment_rules(inside, fits & ~g.near_border(box(), box("e_"), 1.0), "file_name").distinct()
    kept = known.join(chosen, ["file_name", "pid"], "left_semi")
    named = kept.select(
        "file_name", "ring", F.col("conf").alias("Confidence_score"), "poly_id", F.col("area").alias("Area"), F.col("height").alias("TreeHeight"), g.point_json(g.round_ring(F.array(g.vertex_mean(F.col("ring"))))[0]).alias("Centroid"),
        g.diameter(F.col("area")).alias("Diameter"), F.col("is_contained").cast("string").alias("is_contained"), "num_contained",
    )
    return named


def process_files(spark: SparkSession, config: RunConfig, detectors: Mapping[str, Detector]) -> tuple[DataFrame, DataFrame]:
    """(crowns, failures) of a run; crowns are written below the output folder as Parquet by image and, by image, as GeoJSON.

    detectors: what the models' names in the settings stand for.
    """
    ship(spark)
    parameters = json.dumps({k: v for k, v in asdict(config).items() if k not in ("keep_intermediate", "timestamped_output_directory")}, sort_keys=True)
    listing = f"{config.output_directory}/manifest"
    heads, failed = headers_of(spark, config)
    heads = manifest.resume(heads, listing, "file_name", parameters)
    heads = materialise(heads.withColumn("image_id", F.col("file_name")), "work")
    files = rasters.files_of(spark, config.image_directory, "*.tif").join(heads.select("file_name"), "file_name", "left_semi")
    tiles = tiling.tile_grid(heads, config.tile_width, config.tile_height, config.buffer, config.crs).withColumnRenamed("image_id", "file_name")
    outlines = outlines_of(spark, config.forrest_outline) if config.dual else None
    if outlines is not None:
        tiles = tiling.coverage_flags(tiles, outlines, config.buffer, 4.0 * max(config.tile_width, config.tile_height))
    tiles = materialise(tiles, "tiles")
    models = {"urban": (config.urban_model, ("only_forest",)), "forest": (config.forrest_model, ("only_urban",))} if config.dual else {"combined": (config.combined_model, ())}
    made, scratch = {}, [heads, tiles]
    for model, (name, exclude) in models.items():
        found = materialise(detect_tiles(files, tiling.tiles_for(tiles, exclude), detectors[name]), f"predictions-{model}")
        good, bad = manifest.split_failures(found)
        failed = failed.unionByName(bad.select("file_name", "error"))
        made[model] = stitched(good, tiles, config).withColumn("key", F.xxhash64("file_name", "tile_id", "score", "ring"))
        scratch.append(found)
    crowns = images.fuse(made["forest"], made["urban"], outlines, "key", 4.0 * config.tile_width) if config.dual else made["combined"]
    rows = clean.confidence_filter(crowns.withColumn("conf", F.col("score")), config.confidence_threshold).dropDuplicates(["file_name", "key"])
    rows = clean.sequence_ids(rows, "file_name", "key").withColumn("pid", F.col("key"))
    rows = clean.area_filter(clean.simplified_area(rows), config.area_threshold, 1e9)
    rows = materialise(clean.greedy_suppress(rows, "file_name", iou=config.iou_threshold), "survivors")
    keyed = g.regex_identifier(F.col("file_name"), config.height_data_regex, 1)
    tall = rasters.files_of(spark, config.height_data_path, "*.tif").withColumn("key", keyed).groupBy("key").agg(F.max(F.struct("file_name", "content"))["content"].alias("content"))
    heights = heads.select("file_name", g.regex_identifier(F.col("file_name"), config.image_regex, 1).alias("key")).join(tall, "key").select("file_name", "content")
    out = cleaned(rows, statistics(rows, heads, files, heights), heads, config)
    out = materialise(out, "crowns")
    [stamp] = spark.range(1).select(vector.stamp_of(F.current_timestamp())).first()
    vector.write_final(out, config.output_directory, stamp if config.timestamped_output_directory else None, "file_name")
    vector.write_geojson(out, f"{config.output_directory}/geojson_predictions", ["Confidence_score", "poly_id", "Area", "TreeHeight", "Centroid", "Diameter"], "file_name", config.crs)
    failed = materialise(failed, "failures")
    ok = heads.select("file_name").distinct().join(failed.select("file_name").distinct().withColumn("bad", F.lit(True)), "file_name", "left")
    manifest.record(ok.select("file_name", F.col("bad").isNull().alias("ok")), listing, "file_name", parameters)
    if not config.keep_intermediate:
        for used in scratch:
            release(used)
    return out, failed

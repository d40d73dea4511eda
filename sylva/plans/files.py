"""Queries that write the forms of files that the engine knows, and read them back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import geometry as g
from sylva.functions.geometry import box, dbl
from sylva.operators import detect, manifest
from sylva.operators import images as im
from sylva.plans.fixtures import load, with_views
from sylva.plans.tiles import CRS, FLAGS, flagged
from sylva.runtime import scratch, ship
from sylva.sources import rasters, shapes, vector


def geojson_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of two parts, the first with a hole, from a layer as text."""
    path = scratch(spark, "parts")
    ring = lambda x0, y0, x1, y1: F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    b, two = box(), dbl(2)
    mx, my = (b["x0"] + b["x1"]) / two, (b["y0"] + b["y1"]) / two
    far = F.array(ring(b["x1"] + 10, b["y0"], b["x1"] + 20, b["y0"] + 10))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring(b["x0"], b["y0"], b["x1"], b["y1"]), ring(b["x0"] + 1, b["y0"] + 1, mx, my)), far).alias("coordinates"))
    whole = F.struct(F.lit("Feature").alias("type"), F.struct("outline_id", F.lit("x").alias("note")).alias("properties"), shape.alias("geometry"))
    layer = load(spark, sf_dir, "f_outlines").agg(F.collect_list(F.to_json(whole)).alias("f"))
    layer.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", "f"), F.lit("]}")).alias("value")).write.text(path)
    found = vector.read_geojson(spark, path, ["outline_id", "note"])
    return found.select(F.col("outline_id").cast("long").alias("outline_id"), "part", "note", g.polygon_area(F.col("rings")).alias("area"))


SQL_PARTS = with_views("f_outlines") + """
SELECT outline_id, 0 AS part, CAST(NULL AS DOUBLE) AS note, (x1-x0)*(y1-y0) - ((x1-x0)/2-1)*((y1-y0)/2-1) AS area FROM f_outlines UNION ALL SELECT outline_id, 1, NULL, 1e2 FROM f_outlines"""


def geojson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "geojson")
    vector.write_geojson(load(spark, sf_dir, "f_preds").withColumn("ring", g.box_ring(box())), path, ["pid", "conf"], "tile", CRS)
    found = vector.read_geojson(spark, path, ["pid", "conf"])
    return found.select(F.col("pid").cast("long").alias("pid"), "conf", g.ring_area(F.col("ring")).alias("area"), F.regexp_extract("crs", r"(\d+)$", 1).cast("int").alias("crs"))


SQL_GEOJSON = with_views("f_preds") + f"\nSELECT pid, conf, (x1-x0)*(y1-y0) AS area, {CRS} AS crs FROM f_preds"


def tile_metadata_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tiles")
    known = flagged(spark, sf_dir)
    vector.write_tiles(known.select("image_id", "tile_id", F.lit(CRS).alias("crs"), F.array(*[dbl(v) for v in (0.2, 0, 0, 0, -0.2, 0, 0, 0, 1)]).alias("transform"), F.array("x0", "y0", "x1", "y1").alias("bounds"), "only_forest", "only_urban"), path)
    found = vector.read_tiles(spark, path)
    return found.select("tile_id", "crs", F.col("bounds")[0].alias("x0"), F.col("bounds")[3].alias("y1"), F.size("transform").alias("n"), "only_forest", "only_urban")


SQL_METADATA = FLAGS + f"\nSELECT t.tile_id, {CRS} AS crs, x0, y1, 9 AS n, only_forest, only_urban FROM tiles t JOIN flag USING (tile_id)"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = load(spark, sf_dir, "f_preds")
    return preds.select(F.concat(F.lit("t_"), "tile").alias("tile_id"), F.col("pid").cast("string").alias("image_id"), F.lit(0).alias("category_id"), F.col("conf").alias("score"), g.box_ring(box()).alias("ring"))


def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "predictions")
    vector.write_predictions(predicted(spark, sf_dir), path)
    found = vector.read_predictions(spark, path)
    return found.select("tile_id", F.col("image_id").cast("long").alias("pid"), "score", g.ring_area(F.col("ring")).alias("area"))


SQL_PREDICTIONS = with_views("f_preds") + "\nSELECT concat('t_', CAST(tile AS VARCHAR)) AS tile_id, pid, conf AS score, (x1-x0)*(y1-y0) AS area FROM f_preds"


def prediction_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions in world coordinates by the transform of their tile; the last tiles have no metadata."""
    number = F.col("id").cast("double")
    tiles = spark.range(45).select(F.concat(F.lit("t_"), "id").alias("tile_id"), F.lit(CRS).alias("crs"), dbl(0.5).alias("a"), dbl(0).alias("b"), (number * 100).alias("c"), dbl(0).alias("d"), dbl(-0.25).alias("e"), (number * 10).alias("f"))
    found = im.project(predicted(spark, sf_dir), tiles)
    bounds = g.ring_box(F.col("ring"))
    return found.select(F.col("image_id").cast("long").alias("pid"), "crs", *[bounds[k].alias(k) for k in ("x0", "y0", "x1", "y1")])


SQL_PROJECT = with_views("f_preds") + f"""
SELECT pid, CASE WHEN tile < 45 THEN {CRS} END AS crs, CASE WHEN tile < 45 THEN (x0+5e-1)/2e0+tile*1e2 END AS x0, CASE WHEN tile < 45 THEN (y1+5e-1)*-2.5e-1+tile*1e1 END AS y0,
  CASE WHEN tile < 45 THEN (x1+5e-1)/2e0+tile*1e2 END AS x1, CASE WHEN tile < 45 THEN (y0+5e-1)*-2.5e-1+tile*1e1 END AS y1 FROM f_preds"""


def final_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowns in their output schema, written twice: to the final place and to that of the run's moment."""
    path = scratch(spark, "final")
    preds = load(spark, sf_dir, "f_preds")
    [stamp] = spark.range(1).select(vector.stamp_of(F.timestamp_seconds(F.lit(1700000000)))).first()
    rows = preds.select(F.col("conf").alias("Confidence_score"), F.col("pid").cast("string").alias("poly_id"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("Area"))
    made = vector.ordered(rows).withColumn("image_id", F.col("poly_id").cast("long") % 7)
    copies = [spark.read.parquet(p).withColumn("place", F.lit(p.rsplit("/", 1)[1])) for p in vector.write_final(made, path, stamp)]
    both = copies[0].unionByName(copies[1])
    return both.groupBy("place", F.col("image_id").cast("long").alias("image_id")).agg(F.count("*").alias("n"), F.sum("Area").alias("area"), F.count("TreeHeight").alias("heights"))


SQL_FINAL = with_views("f_preds") + """
SELECT place, pid % 7 AS image_id, count(*) AS n, sum((x1-x0)*(y1-y0)) AS area, CAST(0 AS BIGINT) AS heights FROM f_preds, (SELECT unnest(['final', '2023-11-14_22-13-20']) AS place) GROUP BY 1, 2"""


def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two models as JSON files, read back."""
    path = scratch(spark, "scores")
    row = F.array(dbl(0.5), (F.col("tile") % 7) / dbl(10), F.col("conf"), F.col("conf") / 2)
    for n, model in enumerate(("a", "b")):
        one = load(spark, sf_dir, "f_preds").filter(F.col("pid") % 2 == n).groupBy("tile").agg(F.sort_array(F.collect_list(row)).alias("r"))
        one.select(F.to_json(F.create_map(F.col("tile").cast("string"), "r")).alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(f"{path}/{model}")
    return vector.read_scores(spark, path, ["a", "b"])


SQL_SCORES = with_views("f_preds") + """
SELECT CASE WHEN pid % 2 = 0 THEN 'a' ELSE 'b' END AS model, CAST(tile AS VARCHAR) AS image_id, 5e-1 AS iou_t, (tile % 7)/1e1 AS conf_t, conf AS precision, conf/2 AS f1 FROM f_preds"""


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder by pattern and prefix, without reading them."""
    path = scratch(spark, "listing")
    load(spark, sf_dir, "f_preds").write.partitionBy("tile").json(path)
    files = vector.listing(spark, path, "*.json").withColumn("tile", F.regexp_extract("path", r"tile=(\d+)/", 1).cast("long"))
    return vector.named(files, r"^part-\d{5}", "part-", "processed_").filter("size > 0").select("tile").distinct()


SQL_LISTING = with_views("f_preds") + "\nSELECT DISTINCT tile FROM f_preds"


def name_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "f_images").select("image_id", F.concat(F.when(F.col("image_id") % 3 == 0, "processed_").otherwise(""), "file_name").alias("name"))
    return vector.named(names, r"FDOP20_10[1-5]_\d+", skip="processed_").withColumn("kept", F.lit("new")).unionByName(vector.named(names, prefix="processed_").withColumn("kept", F.lit("processed")))


SQL_NAMES = with_views("f_images") + """
SELECT image_id, file_name AS name, 'new' AS kept FROM f_images WHERE image_id % 3 <> 0 AND image_id % 10 BETWEEN 1 AND 5
UNION ALL SELECT image_id, concat('processed_', file_name), 'processed' FROM f_images WHERE image_id % 3 = 0"""


def annotation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("Area")
    return vector.annotations(load(spark, sf_dir, "f_annots").select("aid", area, (F.col("x1") - F.col("x0")).alias("side")), [("Area", 100.0, True), ("side", 40.0, False)])


SQL_ANNOTATIONS = with_views("f_annots") + "\nSELECT aid, (x1-x0)*(y1-y0) AS \"Area\", x1-x0 AS side FROM f_annots WHERE (x1-x0)*(y1-y0) > 100 AND x1-x0 < 40"


def raster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = scratch(spark, "rasters")
    rasters.write_rasters(load(spark, sf_dir, "f_pixels"), path, ["red", "nir", "h"], (0.5, 1000.0, -0.5, 2000.0), CRS)
    return spark.read.parquet(path)


def raster_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images written as GeoTIFF files, and read back pixel by pixel; pixels that aren't there are 0."""
    found = rasters.decode_rasters(raster_files(spark, sf_dir), ["red", "nir", "h"], rasters.tiff_decoder)
    return found.select(F.regexp_extract("file_name", r"(\d+)", 1).cast("long").alias("image_id"), "r", "c", "red", "nir", "h")


SQL_RASTER = with_views("f_pixels") + """,
s AS (SELECT image_id, max(r) AS nr, max(c) AS nc FROM f_pixels GROUP BY image_id),
t AS (SELECT image_id, CAST(i AS BIGINT) AS r, CAST(j AS BIGINT) AS c FROM s, (SELECT unnest(range(0, 128)) AS i), (SELECT unnest(range(0, 128)) AS j) WHERE i <= nr AND j <= nc)
SELECT image_id, r, c, CAST(coalesce(red, 0) AS DOUBLE) AS red, CAST(coalesce(nir, 0) AS DOUBLE) AS nir, coalesce(h, 0e0) AS h FROM t LEFT JOIN f_pixels USING (image_id, r, c)"""


def raster_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, transforms and reference systems of GeoTIFF files, and the error of what isn't one."""
    bad = spark.createDataFrame([("broken.tif", bytearray(b"nothing"))], "file_name string, content binary")
    found = rasters.read_headers(raster_files(spark, sf_dir).select("file_name", "content").unionByName(bad))
    return found.select("file_name", "width", "height", "bands", "a", "c", "e", "f", "crs", F.col("error").isNotNull().alias("failed"))


SQL_HEADERS = with_views("f_pixels") + f"""
SELECT concat(CAST(image_id AS VARCHAR), '.tif') AS file_name, max(c)+1 AS width, max(r)+1 AS height, CAST(3 AS BIGINT) AS bands, 5e-1 AS a, 1e3 AS c, -5e-1 AS e, 2e3 AS f, CAST({CRS} AS BIGINT) AS crs, false AS failed
FROM f_pixels GROUP BY image_id UNION ALL SELECT 'broken.tif', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true"""


def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GeoPackage for each tile, and one file that is broken."""
    ship(spark)

    def make(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pid").to_pylist()
        features = [({"pid": r["pid"], "conf": r["conf"]}, [[[(r["x0"], r["y0"]), (r["x1"], r["y0"]), (r["x1"], r["y1"]), (r["x0"], r["y1"]), (r["x0"], r["y0"])]]]) for r in rows]
        return pa.table({"file": [f"{rows[0]['tile']}.gpkg"], "content": pa.array([shapes.write_gpkg(features, CRS)], pa.binary())})

    made = load(spark, sf_dir, "f_preds").groupBy("tile").applyInArrow(make, "file string, content binary")
    return shapes.layers_of(made.unionByName(spark.createDataFrame([("broken.gpkg", bytearray(b"nothing"))], "file string, content binary")))


def geopackage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = manifest.split_failures(layer_files(spark, sf_dir))
    return good.select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("tile"), "crs", "part", F.col("properties")["pid"].cast("long").alias("pid"), F.col("properties")["conf"].cast("double").alias("conf"), g.polygon_area(F.col("rings")).alias("area"))


SQL_GPKG = with_views("f_preds") + f"\nSELECT tile, {CRS} AS crs, 0 AS part, pid, conf, (x1-x0)*(y1-y0) AS area FROM f_preds"


def failed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that can't be read are reported, and the others are read."""
    good, bad = manifest.split_failures(layer_files(spark, sf_dir))
    return good.groupBy("file").agg(F.count("*").alias("n")).withColumn("failed", F.lit(False)).unionByName(bad.select("file", F.lit(0).cast("long").alias("n"), F.col("error").isNotNull().alias("failed")))


SQL_FAILED = with_views("f_preds") + "\nSELECT concat(CAST(tile AS VARCHAR), '.gpkg') AS file, count(*) AS n, false AS failed FROM f_preds GROUP BY tile UNION ALL SELECT 'broken.gpkg', 0, true"


def same_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = load(spark, sf_dir, "f_images").select("image_id", "file_name")
    own = F.regexp_replace("file_name", r"\.tif$", "")
    files = images.filter("image_id % 2 = 0").select(F.concat(own, F.lit(".json")).alias("name")).unionByName(images.filter("image_id % 3 = 0").select(F.concat(F.lit("x/"), own, F.lit(".gpkg")).alias("name")))
    return im.by_stem(images, files).select("image_id", "match")


SQL_STEM = with_views("f_images") + """
SELECT image_id, CASE WHEN image_id % 3 = 0 THEN concat('x/', replace(file_name, '.tif', '.gpkg')) WHEN image_id % 2 = 0 THEN replace(file_name, '.tif', '.json') END AS match FROM f_images"""


def layer_tile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers with the tile of the same stem, by name and not by place; those without one are left out and told."""
    images = load(spark, sf_dir, "f_images")
    layers = images.filter("image_id % 4 <> 0").select("image_id", F.regexp_replace("file_name", "tif$", "geojson").alias("file_name"))
    tiles = images.filter("image_id % 5 <> 0").select(F.col("file_name").alias("name"))
    found = im.by_stem(layers, tiles, ("tif",))
    return found.select("image_id", "match", F.col("match").isNull().alias("alone"))


SQL_PAIRED = with_views("f_images") + "\nSELECT image_id, CASE WHEN image_id % 5 <> 0 THEN file_name END AS match, image_id % 5 = 0 AS alone FROM f_images WHERE image_id % 4 <> 0"


def incomplete_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose tiles aren't all predicted, stitched or fused: what each step has to do again."""
    tiles = load(spark, sf_dir, "f_preds").select(F.col("tile").alias("image_id"), F.col("pid").alias("tile_id"))
    steps = {"predict": tiles.filter("tile_id % 5 <> 0 OR image_id % 2 = 0"), "stitch": tiles.filter("image_id % 3 <> 0"), "fuse": tiles.filter("tile_id % 2 = 0")}
    parts = [manifest.incomplete(tiles, made, "image_id", "tile_id").withColumn("step", F.lit(step)) for step, made in steps.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("step", "image_id", "expected", "made")


SQL_INCOMPLETE = with_views("f_preds") + """,
s AS (SELECT step, tile AS image_id, count(*) AS expected, count(*) FILTER (CASE step WHEN 'predict' THEN pid % 5 <> 0 OR tile % 2 = 0 WHEN 'stitch' THEN tile % 3 <> 0 ELSE pid % 2 = 0 END) AS made
  FROM f_preds, (SELECT unnest(['predict', 'stitch', 'fuse']) AS step) GROUP BY 1, 2)
SELECT * FROM s WHERE made < expected"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = load(spark, sf_dir, "f_preds")
    return manifest.progress(preds, preds.filter("conf > 0.5"), "tile")


SQL_PROGRESS = with_views("f_preds") + "\nSELECT tile, count(*) AS total, count(*) FILTER (conf > 5e-1) AS finished, round(100 * count(*) FILTER (conf > 5e-1) / count(*), 2) AS percent FROM f_preds GROUP BY tile"


def work_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles in batches, in order, and in a shuffled order that a seed decides."""
    preds = load(spark, sf_dir, "f_preds").select("tile", "pid")
    return detect.shuffled(detect.batched(preds, "pid", detect.ModelConfig().max_batch_size, "tile"), "pid", 7, "tile").select("pid", "batch", F.col("place").cast("long").alias("place"))


SQL_BATCHES = with_views("f_preds") + """
SELECT pid, CAST(floor((row_number() OVER (PARTITION BY tile ORDER BY pid) - 1) / 1e1) AS BIGINT) AS batch,
  row_number() OVER (PARTITION BY tile ORDER BY ((pid + 7) * 2654435761) % 4294967296, pid) AS place FROM f_preds"""


def mask_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks resized bilinearly and cut to whole numbers."""
    from sylva.operators.raster import resize_mask

    masks = load(spark, sf_dir, "f_patches").select("vec_id", F.transform("embedding", lambda v: F.when(v > -0.05, 1).otherwise(0)).alias("mask"))
    return masks.select("vec_id", F.posexplode(resize_mask(F.col("mask"), 8, 8, 5, 12)).alias("pos", "value"))


SQL_MASK = with_views("f_patches") + """,
m AS (SELECT vec_id, p, CASE WHEN embedding[p+1] > CAST(-0.05 AS DOUBLE) THEN 1 ELSE 0 END AS v FROM f_patches, (SELECT unnest(range(0, 64)) AS p)),
t AS (SELECT q, least(greatest((q // 12 + 5e-1) * (8/5e0) - 5e-1, 0e0), 7e0) AS y, least(greatest((q % 12 + 5e-1) * (8/1.2e1) - 5e-1, 0e0), 7e0) AS x FROM (SELECT unnest(range(0, 60)) AS q)),
n AS (SELECT vec_id, q, v, greatest(1 - abs(y - p // 8), 0e0) * greatest(1 - abs(x - p % 8), 0e0) AS w FROM m JOIN t ON abs(y - p // 8) < 1 AND abs(x - p % 8) < 1)
SELECT vec_id, CAST(q AS INTEGER) AS pos, CAST(floor(sum(v * w) + 1e-12) AS INTEGER) AS value FROM n GROUP BY vec_id, q"""


def band_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylva.operators.raster import stacked

    found = stacked(load(spark, sf_dir, "f_pixels").withColumns({c: F.col(c).cast("double") for c in ("red", "nir")}), ["red", "nir", "h"], [2, 0, 1])
    return found.select("image_id", "r", "c", *[F.col("bands")[i].alias(f"b{i}") for i in range(3)])


SQL_STACK = with_views("f_pixels") + "\nSELECT image_id, r, c, h AS b0, CAST(red AS DOUBLE) AS b1, CAST(nir AS DOUBLE) AS b2 FROM f_pixels"


def model_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return detect.suppress_non_maxima(load(spark, sf_dir, "f_preds")).select("tile", "pid")


NMS_IOU = "greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0)"
SQL_NMS = with_views("f_preds", recursive=True) + f""",
p AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY conf DESC, pid) AS n FROM f_preds WHERE conf >= 3e-1),
near AS (SELECT a.tile, a.pid AS i, list(b.pid) AS js FROM p a JOIN p b ON a.tile = b.tile AND a.pid <> b.pid WHERE ({NMS_IOU}) / ((a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) - ({NMS_IOU})) > 5e-1 GROUP BY a.tile, a.pid),
fold AS (SELECT tile, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS gone FROM (SELECT DISTINCT tile FROM p)
  UNION ALL SELECT f.tile, p.n, CASE WHEN list_contains(f.gone, p.pid) THEN f.gone ELSE list_distinct(list_concat(f.gone, coalesce(x.js, []))) END
  FROM fold f JOIN p ON p.tile = f.tile AND p.n = f.n + 1 LEFT JOIN near x ON x.tile = p.tile AND x.i = p.pid),
done AS (SELECT tile, arg_max(gone, n) AS gone FROM fold GROUP BY tile)
SELECT p.tile, p.pid FROM p JOIN done USING (tile) WHERE NOT list_contains(gone, p.pid)"""

QUERIES = {
    "geojson_parts": geojson_parts, "geojson_roundtrip": geojson_roundtrip, "tile_metadata_roundtrip": tile_metadata_roundtrip, "prediction_files": prediction_files, "prediction_project": prediction_project,
    "final_sink": final_sink, "score_files": score_files, "file_listing": file_listing, "name_filters": name_filters, "annotation_filter": annotation_filter, "raster_scan": raster_scan, "raster_headers": raster_headers,
    "geopackage_scan": geopackage_scan, "failed_items": failed_items, "same_stem": same_stem, "layer_tile_pairs": layer_tile_pairs, "incomplete_outputs": incomplete_outputs, "progress": progress, "work_batches": work_batches,
    "mask_resize": mask_resize, "band_stack": band_stack, "model_nms": model_nms,
}
ORACLES = {
    "geojson_parts": SQL_PARTS, "geojson_roundtrip": SQL_GEOJSON, "tile_metadata_roundtrip": SQL_METADATA, "prediction_files": SQL_PREDICTIONS, "prediction_project": SQL_PROJECT,
    "final_sink": SQL_FINAL, "score_files": SQL_SCORES, "file_listing": SQL_LISTING, "name_filters": SQL_NAMES, "annotation_filter": SQL_ANNOTATIONS, "raster_scan": SQL_RASTER, "raster_headers": SQL_HEADERS,
    "geopackage_scan": SQL_GPKG, "failed_items": SQL_FAILED, "same_stem": SQL_STEM, "layer_tile_pairs": SQL_PAIRED, "incomplete_outputs": SQL_INCOMPLETE, "progress": SQL_PROGRESS, "work_batches": SQL_BATCHES,
    "mask_resize": SQL_MASK, "band_stack": SQL_STACK, "model_nms": SQL_NMS,
}

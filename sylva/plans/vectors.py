"""Queries over detections: pairs, suppression, containment, geometry, the cleaning pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import geometry as g
from sylva.functions.geometry import box, dbl
from sylva.operators import clean, images
from sylva.operators.clean import CleanConfig
from sylva.operators.zonal import zonal_stats
from sylva.plans.fixtures import load, with_views
from sylva.plans.tiles import as_shape, union_cells
from sylva.runtime import materialise, ship

CELL = 64.0
# About twice the side of a crown, and half of that of a prediction, where pairs are listed; cells for a kernel that cuts them up.
CROWN_CELL, FINE_CELL, WIDE_CELL = 8.0, 16.0, 128.0
CONFIG = CleanConfig()


def bbox_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    # Only what rounds to 0.1 or less is left to the filter.
    pairs = clean.close_pairs(load(spark, sf_dir, "f_crowns"), "image_id", "crown_id", 0.0999, WIDE_CELL, CROWN_CELL)
    return pairs.withColumn("iou", F.round("iou", 9)).filter(F.col("iou") > dbl(0.1))


IOU = "greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0)"
AREA = "({0}.x1-{0}.x0)*({0}.y1-{0}.y0)"
A, B = AREA.format("a"), AREA.format("b")
RATIO = f"({IOU})/({A}+{B}-({IOU}))"

SQL_IOU = with_views("f_crowns") + f"""
SELECT * FROM (SELECT a.crown_id AS i, b.crown_id AS j, round({RATIO}, 9) AS iou FROM f_crowns a JOIN f_crowns b
  ON a.image_id = b.image_id AND a.crown_id < b.crown_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1) WHERE iou > 1e-1"""


def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pairs = clean.containment_pairs(load(spark, sf_dir, "f_preds"), "tile", "pid", CONFIG.containment, FINE_CELL)
    return pairs.select("tile", F.col("outer").alias("outer_id"), F.col("inner").alias("inner_id"))


HELD = f"""held AS (SELECT a.tile, a.pid AS outer_id, b.pid AS inner_id FROM f_preds a JOIN f_preds b
  ON a.tile = b.tile AND a.pid <> b.pid AND ({IOU}) / ({B}) >= 9e-1)"""
SQL_CONTAINMENT_PAIRS = with_views("f_preds") + f",\n{HELD}\nSELECT * FROM held"


def containment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = clean.containment_counts(load(spark, sf_dir, "f_preds"), cell=CELL)
    return counted.select("tile", "pid", "num_contained", "is_contained", F.round("containment_ratio", 9).alias("containment_ratio"))


SQL_CONTAINMENT_COUNTS = with_views("f_preds") + f""",
{HELD},
ratio AS (SELECT b.pid, max(({IOU}) / ({B})) AS r FROM f_preds a JOIN f_preds b ON a.tile = b.tile GROUP BY b.pid)
SELECT tile, pid, coalesce((SELECT count(*) FROM held WHERE outer_id = pid), 0) AS num_contained,
  EXISTS (SELECT 1 FROM held WHERE inner_id = pid) AS is_contained, round(r, 9) AS containment_ratio FROM f_preds JOIN ratio USING (pid)"""


def suppressed(difference: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return clean.greedy_suppress(load(spark, sf_dir, "f_preds"), iou=0.4, area_difference=difference, cell=CELL).select("tile", "pid")

    return query


def sql_suppressed(difference: str, source: str = "f_preds", iou: str = "4e-1", views: str | None = None) -> str:
    return (views or with_views("f_preds", recursive=True)) + f""",
near AS (SELECT a.tile, a.pid AS i, b.pid AS j, b.conf FROM {source} a JOIN {source} b
  ON a.tile = b.tile AND (a.pid = b.pid OR ({RATIO} > {iou} AND abs(({A})-({B}))/greatest({A}, {B}) < {difference}))),
step AS (SELECT tile, i, list(j) AS grp, arg_max(j, (conf, -j)) AS best, row_number() OVER (PARTITION BY tile ORDER BY i) AS n FROM near GROUP BY tile, i),
fold AS (SELECT tile, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS gone FROM (SELECT DISTINCT tile FROM {source})
  UNION ALL SELECT f.tile, s.n, CASE WHEN list_contains(f.gone, s.i) THEN f.gone ELSE list_distinct(list_concat(f.gone, list_filter(s.grp, lambda x: x <> s.best))) END
  FROM fold f JOIN step s ON s.tile = f.tile AND s.n = f.n + 1),
done AS (SELECT tile, arg_max(gone, n) AS gone FROM fold GROUP BY tile)"""


def clean_crowns_nlargest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.best_of_overlapping(load(spark, sf_dir, "f_preds"), "tile", "pid", 0.3, CELL)
    return clean.confidence_filter(kept, 0.3, strict=True).select("tile", "pid", "conf")


SQL_NLARGEST = with_views("f_preds") + f"""
SELECT tile, pid, conf FROM f_preds b WHERE conf > 3e-1 AND NOT EXISTS (SELECT 1 FROM f_preds a WHERE a.tile = b.tile AND a.pid <> b.pid
  AND {RATIO} > 3e-1 AND (a.conf > b.conf OR (a.conf = b.conf AND a.pid < b.pid)))"""


def crown_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = load(spark, sf_dir, "f_crowns").withColumn("ring", g.box_ring(box()))
    area = g.ring_area(F.col("ring"))
    mean, circle, bounds = (g.round_ring(F.array(g.vertex_mean(F.col("ring"))))[0], g.circle_of(F.col("ring")), g.ring_box(F.col("ring")))
    return rings.select(
        "crown_id", area.alias("area"), F.round(g.diameter(area), 9).alias("diameter"), mean["x"].alias("cx"), mean["y"].alias("cy"), F.round(circle["r"], 9).alias("radius"),
        bounds["x0"].alias("bx0"), bounds["y1"].alias("by1"), g.is_valid_ring(F.col("ring")).alias("valid"), F.round(g.distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), 9).alias("diagonal"),
    )


SQL_GEOMETRY = with_views("f_crowns") + """
SELECT crown_id, (x1-x0)*(y1-y0) AS area, round(2*sqrt((x1-x0)*(y1-y0)/pi()), 9) AS diameter,
  round_even((3*x0+2*x1)/5e0*1e3, 0)/1e3 AS cx, round_even((3*y0+2*y1)/5e0*1e3, 0)/1e3 AS cy,
  round(sqrt(((x1-x0)/2)*((x1-x0)/2)+((y1-y0)/2)*((y1-y0)/2)), 9) AS radius, x0 AS bx0, y1 AS by1, true AS valid,
  round(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)), 9) AS diagonal FROM f_crowns"""


def clipped_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each crown's diamond inside a fixed box, by clipping its ring."""
    crowns = load(spark, sf_dir, "f_crowns")
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(point(F.col("x0"), my), point(mx, F.col("y0")), point(F.col("x1"), my), point(mx, F.col("y1")), point(F.col("x0"), my))
    window = {"x0": mx, "y0": F.col("y0"), "x1": F.col("x1"), "y1": my}
    return crowns.select("crown_id", F.round(g.ring_area(g.clip_ring(ring, window)), 6).alias("area"))


SQL_CLIPPED = with_views("f_crowns") + "\nSELECT crown_id, round((x1-x0)*(y1-y0)/8e0, 6) AS area FROM f_crowns"


def stats(spark: SparkSession, sf_dir: str, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    preds = load(spark, sf_dir, "f_preds").withColumn("image_id", F.col("tile") % 10)
    return preds, zonal_stats(preds, load(spark, sf_dir, "f_pixels"), "pid", "image_id", share)


def zonal_height_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir)[1].select("pid", "n_pixels", "height", "height_pixel")


def zonal_ndvi_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir)[1].select("pid", *[F.round(c, 9).alias(c) for c in ("index_min", "index_max", "index_mean", "index_var")])


def sql_zonal(share: str = "5e-1") -> str:
    return f"""circle AS (SELECT pid, tile % 10 AS image_id, (x0+x1)/2 AS cx, (y0+y1)/2 AS cy, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))/2*{share} AS r FROM f_preds),
spot AS (SELECT p.pid, x.h, x.r*4294967296+x.c AS k, (x.nir/2.55e2-x.red/2.55e2)/(x.nir/2.55e2+x.red/2.55e2+1e-10) AS v FROM circle p JOIN f_pixels x
  ON p.image_id = x.image_id AND (x.c-p.cx)*(x.c-p.cx)+(x.r-p.cy)*(x.r-p.cy) <= p.r*p.r),
zone AS (SELECT pid, count(*) AS n_pixels, max(h) AS height, arg_max(k, (h, -k)) AS height_pixel, min(v) AS index_min, max(v) AS index_max, avg(v) AS index_mean, var_pop(v) AS index_var FROM spot GROUP BY pid),
stat AS (SELECT p.pid, coalesce(n_pixels, 0) AS n_pixels, coalesce(height, -1e0) AS height, coalesce(height_pixel, -1) AS height_pixel, coalesce(index_min, -1e0) AS index_min,
  coalesce(index_max, -1e0) AS index_max, coalesce(index_mean, -1e0) AS index_mean, coalesce(index_var, -1e0) AS index_var FROM f_preds p LEFT JOIN zone z USING (pid))"""


ZONAL = with_views("f_preds", "f_pixels") + ",\n" + sql_zonal()
SQL_HEIGHT = ZONAL + "\nSELECT pid, n_pixels, height, height_pixel FROM stat"
SQL_NDVI = ZONAL + "\nSELECT pid, round(index_min, 9) AS index_min, round(index_max, 9) AS index_max, round(index_mean, 9) AS index_mean, round(index_var, 9) AS index_var FROM stat"


def height_ndvi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = clean.height_passes(F.col("height"), 48.0) & clean.index_passes(F.round("index_mean", 9), F.round("index_var", 9), 0.0, 0.3)
    return stats(spark, sf_dir)[1].filter(keep).select("pid", "height", F.round("index_mean", 9).alias("index_mean"))


SQL_FILTER = ZONAL + """
SELECT pid, height, round(index_mean, 9) AS index_mean FROM stat WHERE NOT (height < 48e0 AND height > -1)
  AND NOT ((round(index_mean, 9) < 0e0 OR round(index_var, 9) > 3e-1) AND index_mean > -1)"""


def border_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = {"x0": dbl(0), "y0": dbl(0), "x1": dbl(128), "y1": dbl(96)}
    return clean.border_filter(load(spark, sf_dir, "f_preds"), bounds, 1.0).select("pid")


SQL_BORDER = with_views("f_preds") + "\nSELECT pid FROM f_preds WHERE NOT (abs(x0) <= 1 OR abs(y0) <= 1 OR abs(x1-128) <= 1 OR abs(y1-96) <= 1)"


def overlap_owner_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = {"x0": dbl(0), "y0": dbl(0), "x1": dbl(128), "y1": dbl(96)}
    return clean.overlap_owner_filter(load(spark, sf_dir, "f_preds"), bounds, dbl(16), F.col("tile") % 7 == 0).select("pid", "tile")


SQL_OWNER = with_views("f_preds") + "\nSELECT pid, tile FROM f_preds WHERE tile % 7 = 0 OR NOT (x1 <= 16 OR x0 >= 112 OR y1 <= 16 OR y0 >= 80)"


def exclude_outlines_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.exclude_within(load(spark, sf_dir, "f_crowns"), load(spark, sf_dir, "f_outlines"), "crown_id", 128.0).select("crown_id", "image_id")


COVER = with_views("f_crowns", "f_outlines") + ",\n" + union_cells("f_crowns", "crown_id", "t.x0 <= o.x1 AND o.x0 <= t.x1 AND t.y0 <= o.y1 AND o.y0 <= t.y1")
OUTSIDE = "NOT EXISTS (SELECT 1 FROM cover WHERE cover.crown_id = c.crown_id AND whole)"
SQL_EXCLUDE = COVER + f"\nSELECT crown_id, image_id FROM f_crowns c WHERE {OUTSIDE}"


def exclude_polygons_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with crowns and outlines as polygons."""
    ship(spark)
    crowns, outlines = as_shape(load(spark, sf_dir, "f_crowns")), as_shape(load(spark, sf_dir, "f_outlines"))
    return images.exclude_within(crowns, outlines, "crown_id", 128.0).select("crown_id", "image_id")


def fuse_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    crowns = load(spark, sf_dir, "f_crowns")
    return images.fuse(crowns.filter("crown_id % 2 = 0"), crowns.filter("crown_id % 2 = 1"), load(spark, sf_dir, "f_outlines"), "crown_id", 128.0).select("crown_id", "model", "conf")


SQL_FUSE = COVER + f"""
SELECT crown_id, 'forest' AS model, conf FROM f_crowns c WHERE crown_id % 2 = 0 AND EXISTS (SELECT 1 FROM f_outlines o WHERE c.x0 <= o.x1 AND o.x0 <= c.x1 AND c.y0 <= o.y1 AND o.y0 <= c.y1)
UNION ALL SELECT crown_id, 'urban', conf FROM f_crowns c WHERE crown_id % 2 = 1 AND {OUTSIDE}"""


def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning of predictions: filters, suppression, zonal statistics, containment rules, output schema.

    The survivors of the suppression feed the statistics, the containment counts and the rules, so they are written
    once, as are the counted rows: otherwise each of their readers would plan and run all that stands before.
    """
    ship(spark)
    preds = load(spark, sf_dir, "f_preds").withColumn("image_id", F.col("tile") % 10)
    rows = clean.sequence_ids(clean.confidence_filter(preds, CONFIG.confidence), "tile", "pid").withColumn("ring", g.box_ring(box()))
    rows = clean.simplified_area(rows).drop("ring")
    rows = materialise(clean.greedy_suppress(clean.area_filter(rows, CONFIG.min_area, CONFIG.max_area), iou=CONFIG.iou, area_difference=0.5, cell=CELL), "survivors")
    found = zonal_stats(rows, load(spark, sf_dir, "f_pixels"), "pid", "image_id")
    found = found.select("pid", "height", F.round("index_mean", 9).alias("index_mean"), F.round("index_var", 9).alias("index_var"))
    known = materialise(clean.containment_counts(rows.join(found, "pid"), threshold=CONFIG.containment, cell=CELL), "counted")
    bounds = {"x0": dbl(0), "y0": dbl(0), "x1": dbl(160), "y1": dbl(140)}
    fits = clean.height_passes(F.col("height"), CONFIG.min_height) & clean.index_passes(F.col("index_mean"), F.col("index_var"), -0.5, 0.5) & ~g.near_border(box(), bounds, 1.0)
    chosen = clean.containment_rules(known, fits, index_difference=CONFIG.index_difference)
    out = chosen.join(known, ["tile", "pid"])
    mean = g.round_ring(F.array(g.vertex_mean(g.box_ring(box()))))[0]
    return out.select(
        "tile", "poly_id", F.col("conf").alias("Confidence_score"), F.col("area").alias("Area"), F.col("height").alias("TreeHeight"), g.point_json(mean).alias("Centroid"),
        F.round(g.diameter(F.col("area")), 9).alias("Diameter"), F.col("is_contained").cast("string").alias("is_contained"), F.col("num_contained"),
    )


SQL_CLEAN = sql_suppressed(
    "5e-1",
    "cand",
    "5e-1",
    with_views("f_preds", "f_pixels", recursive=True)
    + """,
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY tile ORDER BY pid) - 1 AS VARCHAR) AS poly_id, (x1-x0)*(y1-y0) AS area FROM f_preds WHERE conf >= 3e-1),
cand AS (SELECT * FROM numbered WHERE area BETWEEN 1 AND 1000)""",
) + ",\n" + sql_zonal() + f""",
live AS (SELECT c.*, s.height, round(s.index_mean, 9) AS m, round(s.index_var, 9) AS v FROM cand c JOIN done d ON c.tile = d.tile AND NOT list_contains(d.gone, c.pid) JOIN stat s ON s.pid = c.pid),
held AS (SELECT a.tile, a.pid AS outer_id, b.pid AS inner_id FROM live a JOIN live b ON a.tile = b.tile AND a.pid <> b.pid AND ({IOU}) / ({B}) >= 9e-1),
known AS (SELECT *, (SELECT count(*) FROM held WHERE outer_id = pid) AS num_contained, EXISTS (SELECT 1 FROM held WHERE inner_id = pid) AS is_contained FROM live),
other AS (SELECT tile, min(pid) AS o, arg_min(m, pid) AS om, arg_min(v, pid) AS ov FROM known WHERE is_contained GROUP BY tile),
fit AS (SELECT * FROM known WHERE NOT (height < 3 AND height > -1) AND NOT ((m < -5e-1 OR v > 5e-1) AND m > -1) AND NOT (abs(x0) <= 1 OR abs(y0) <= 1 OR abs(x1-160) <= 1 OR abs(y1-140) <= 1)),
named AS (SELECT f.tile, CASE WHEN num_contained = 0 THEN pid WHEN abs(m-om) > 5e-2 THEN CASE WHEN v < ov THEN pid ELSE o END WHEN area > 0 THEN pid END AS pid FROM fit f LEFT JOIN other USING (tile) WHERE num_contained < 2)
SELECT k.tile, poly_id, conf AS "Confidence_score", area AS "Area", height AS "TreeHeight",
  concat('{{"x": ', CAST(round_even((3*x0+2*x1)/5e0*1e3, 0)/1e3 AS VARCHAR), ', "y": ', CAST(round_even((3*y0+2*y1)/5e0*1e3, 0)/1e3 AS VARCHAR), '}}') AS "Centroid",
  round(2*sqrt(area/pi()), 9) AS "Diameter", CAST(is_contained AS VARCHAR) AS is_contained, num_contained FROM named n JOIN known k ON k.pid = n.pid"""


QUERIES = {
    "clean_pipeline": clean_pipeline,
    "bbox_iou_pairs": bbox_iou_pairs,
    "containment_pairs": containment_pairs,
    "containment_counts": containment_counts,
    "greedy_iou_suppress": suppressed(1.0),
    "greedy_iou_area_suppress": suppressed(0.5),
    "clean_crowns_nlargest": clean_crowns_nlargest,
    "crown_geometry": crown_geometry,
    "clipped_area": clipped_area,
    "zonal_height_max": zonal_height_max,
    "zonal_ndvi_stats": zonal_ndvi_stats,
    "height_ndvi_filter": height_ndvi_filter,
    "border_filter": border_filter,
    "overlap_owner_filter": overlap_owner_filter,
    "exclude_outlines_anti": exclude_outlines_anti,
    "exclude_polygons_anti": exclude_polygons_anti,
    "fuse_models": fuse_models,
}
LEFT = "\nSELECT p.tile, p.pid FROM f_preds p JOIN done d USING (tile) WHERE NOT list_contains(d.gone, p.pid)"
ORACLES = {
    "clean_pipeline": SQL_CLEAN,
    "bbox_iou_pairs": SQL_IOU,
    "containment_pairs": SQL_CONTAINMENT_PAIRS,
    "containment_counts": SQL_CONTAINMENT_COUNTS,
    "greedy_iou_suppress": sql_suppressed("1e0") + LEFT,
    "greedy_iou_area_suppress": sql_suppressed("5e-1") + LEFT,
    "clean_crowns_nlargest": SQL_NLARGEST,
    "crown_geometry": SQL_GEOMETRY,
    "clipped_area": SQL_CLIPPED,
    "zonal_height_max": SQL_HEIGHT,
    "zonal_ndvi_stats": SQL_NDVI,
    "height_ndvi_filter": SQL_FILTER,
    "border_filter": SQL_BORDER,
    "overlap_owner_filter": SQL_OWNER,
    "exclude_outlines_anti": SQL_EXCLUDE,
    "exclude_polygons_anti": SQL_EXCLUDE,
    "fuse_models": SQL_FUSE,
}

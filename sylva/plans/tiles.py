"""Queries over images and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import geometry as g
from sylva.functions.geometry import box, dbl
from sylva.operators import images as im
from sylva.operators import tiling
from sylva.operators.manifest import outstanding
from sylva.plans.fixtures import load, with_views
from sylva.runtime import ship

WIDTH, BUFFER, CRS = 250, 20, 25832


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile_grid(load(spark, sf_dir, "f_images"), WIDTH, WIDTH, BUFFER, CRS)


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).select("image_id", "tile_id", "x0", "y0", "x1", "y1")


TILES = with_views("f_images") + """,
bounds AS (SELECT *, least(c, c+a*width) AS bx0, greatest(c, c+a*width) AS bx1, least(f, f+e*height) AS by0, greatest(f, f+e*height) AS by1 FROM f_images),
grid AS (SELECT *, bx0+i*250 AS minx, by0+j*250 AS miny FROM bounds, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j)),
tiles AS (SELECT image_id, concat(replace(file_name, '.tif', ''), '_', CAST(CAST(minx AS BIGINT) AS VARCHAR), '_', CAST(CAST(miny AS BIGINT) AS VARCHAR), '_250_20_25832') AS tile_id,
  minx, miny, minx-20 AS x0, miny-20 AS y0, minx+270 AS x1, miny+270 AS y1 FROM grid)"""
SQL_TILES = TILES + "\nSELECT image_id, tile_id, x0, y0, x1, y1 FROM tiles"


def tile_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = tiles(spark, sf_dir).withColumn("tile_id", F.concat("tile_id", F.lit(".json")))
    return named.select("tile_id", *[v.alias(k) for k, v in g.tile_fields(F.col("tile_id")).items()])


SQL_PARSE = TILES + "\nSELECT concat(tile_id, '.json') AS tile_id, CAST(minx AS BIGINT) AS minx, CAST(miny AS BIGINT) AS miny, CAST(250 AS BIGINT) AS width, CAST(20 AS BIGINT) AS buffer, CAST(25832 AS BIGINT) AS crs FROM tiles"


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.coverage_flags(tiles(spark, sf_dir), load(spark, sf_dir, "f_outlines"), BUFFER, 300.0)


def tile_coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("tile_id", "only_forest", "only_urban")


def union_cells(subject: str, key: str, touch: str) -> str:
    """Views that cut each subject at the edges of the outlines that it meets, and add up the cells that any of these covers."""
    return f"""met AS (SELECT t.{key}, t.x0, t.y0, t.x1, t.y1, o.x0 AS a, o.y0 AS b, o.x1 AS c, o.y1 AS d FROM {subject} t JOIN f_outlines o ON {touch}),
cx AS (SELECT {key}, v AS u0, lead(v) OVER (PARTITION BY {key} ORDER BY v) AS u1 FROM (SELECT DISTINCT {key}, unnest([x0, x1, least(greatest(a, x0), x1), least(greatest(c, x0), x1)]) AS v FROM met)),
cy AS (SELECT {key}, v AS v0, lead(v) OVER (PARTITION BY {key} ORDER BY v) AS v1 FROM (SELECT DISTINCT {key}, unnest([y0, y1, least(greatest(b, y0), y1), least(greatest(d, y0), y1)]) AS v FROM met)),
bits AS (SELECT cx.{key}, (u1-u0)*(v1-v0) AS size, EXISTS (SELECT 1 FROM met m WHERE m.{key} = cx.{key} AND a <= u0 AND c >= u1 AND b <= v0 AND d >= v1) AS held
  FROM cx JOIN cy ON cy.{key} = cx.{key} WHERE u1 IS NOT NULL AND v1 IS NOT NULL),
cover AS (SELECT {key}, bool_and(held) AS whole FROM bits WHERE size > 0 GROUP BY {key})"""


FLAGS = TILES + ",\n" + with_views("f_outlines").removeprefix("WITH ") + ",\n" + union_cells("tiles", "tile_id", "t.minx < o.x1 AND o.x0 < t.minx+250 AND t.miny < o.y1 AND o.y0 < t.miny+250") + """,
flag AS (SELECT t.tile_id, coalesce(whole, false) AS only_forest, whole IS NULL AS only_urban FROM tiles t LEFT JOIN cover USING (tile_id))"""
SQL_FLAGS = FLAGS + "\nSELECT * FROM flag"


def as_shape(df: DataFrame) -> DataFrame:
    """Boxes as polygons: a ring with a vertex in the middle of each side, and as their second part a ring of no size."""
    b = box()
    mx, my = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = [at(b["x0"], b["y0"]), at(mx, b["y0"]), at(b["x1"], b["y0"]), at(b["x1"], my), at(b["x1"], b["y1"]), at(mx, b["y1"]), at(b["x0"], b["y1"]), at(b["x0"], my), at(b["x0"], b["y0"])]
    return df.withColumn("rings", F.array(F.array(*ring), F.array(*[at(mx, my)] * 4)))


def tile_coverage_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags with outlines as polygons."""
    ship(spark)
    found = tiling.coverage_flags(tiles(spark, sf_dir), as_shape(load(spark, sf_dir, "f_outlines")), BUFFER, 300.0)
    return found.select("tile_id", "only_forest", "only_urban")


def tile_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.dual_route(flagged(spark, sf_dir)).select("tile_id", "model")


SQL_EXCLUDE = FLAGS + "\nSELECT tile_id, 'urban' AS model FROM flag WHERE NOT only_forest UNION ALL SELECT tile_id, 'forest' FROM flag WHERE NOT only_urban"


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = load(spark, sf_dir, "f_images").filter("image_id % 3 <> 0")
    return named.select(F.regexp_replace("file_name", "_rgbi", "_ndsm").alias("file_name"))


PATTERN, HEIGHT_PATTERN = r"FDOP20_(\d+)_(\d+)_rgbi", r"FDOP20_(\d+)_(\d+)_ndsm"


def image_height_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = im.height_match(load(spark, sf_dir, "f_images"), heights(spark, sf_dir), PATTERN, HEIGHT_PATTERN, 2)
    return found.select("image_id", "key", "height_name")


SQL_HEIGHTS = with_views("f_images") + r"""
SELECT image_id, concat(regexp_extract(file_name, 'FDOP20_(\d+)_(\d+)_rgbi', 1), regexp_extract(file_name, 'FDOP20_(\d+)_(\d+)_rgbi', 2)) AS key,
  CASE WHEN image_id % 3 <> 0 THEN replace(file_name, '_rgbi', '_ndsm') END AS height_name FROM f_images"""


def layer_height_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = im.layer_match(load(spark, sf_dir, "f_images"), heights(spark, sf_dir), (r"FDOP20_(10[0-4])_(\d+)_rgbi", HEIGHT_PATTERN, 2), (PATTERN, HEIGHT_PATTERN, 2))
    return found.select("image_id", "height_name")


SQL_FALLBACK = with_views("f_images") + "\nSELECT image_id, replace(file_name, '_rgbi', '_ndsm') AS height_name FROM f_images WHERE image_id % 3 <> 0"


def image_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.adjacency(load(spark, sf_dir, "f_images"))


SIDES = """side AS (SELECT 'right' AS side, 1 AS dx, 0 AS dy UNION ALL SELECT 'left', -1, 0 UNION ALL SELECT 'down', 0, 1 UNION ALL SELECT 'up', 0, -1),
near AS (SELECT p.image_id, side, max(q.image_id) AS neighbour FROM f_images p, side, f_images q
  WHERE abs(p.c+dx*p.a*p.width-q.c) < 1e-3 AND abs(p.f+dy*p.e*p.height-q.f) < 1e-3{more} GROUP BY p.image_id, side)"""
SQL_ADJACENCY = with_views("f_images") + ",\n" + SIDES.format(more="") + "\nSELECT * FROM near"


def cross_batch_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.adjacency(load(spark, sf_dir, "f_images").withColumn("lot", F.floor(F.col("image_id") / 5)), batch="lot")


SQL_CROSS = with_views("f_images") + ",\n" + SIDES.format(more=" AND floor(p.image_id/5e0) <> floor(q.image_id/5e0)") + "\nSELECT * FROM near"


def merged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.merged_images(load(spark, sf_dir, "f_images"))


SQL_MERGED = with_views("f_images") + ",\n" + SIDES.format(more="") + """
SELECT n.image_id, neighbour, side, concat(replace(p.file_name, '.tif', ''), '_', CAST(CAST(round_even(p.c, 0) AS BIGINT) AS VARCHAR), '_', CAST(CAST(round_even(p.f, 0) AS BIGINT) AS VARCHAR), '_',
  CAST(CAST(round_even(q.c+p.a*p.width, 0) AS BIGINT) AS VARCHAR), '_', CAST(CAST(round_even(q.f+p.e*p.height, 0) AS BIGINT) AS VARCHAR), '_', replace(q.file_name, '.tif', ''), '.tif') AS merged_name
FROM near n JOIN f_images p ON p.image_id = n.image_id JOIN f_images q ON q.image_id = n.neighbour WHERE side IN ('right', 'down')"""


def within_tile_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.range(50).select(F.col("id").alias("tile"), dbl(0).alias("x0"), dbl(0).alias("y0"), (F.col("id") + 60).cast("double").alias("x1"), dbl(80).alias("y1"))
    return im.within_tile(load(spark, sf_dir, "f_preds"), boxes, "tile").select("pid", "tile")


SQL_WITHIN = with_views("f_preds") + "\nSELECT pid, tile FROM f_preds WHERE x0 >= 1 AND y0 >= 1 AND x1 <= tile+59 AND y1 <= 79"


def affine_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {k: F.col(k) for k in ("a", "c", "e", "f")} | {"b": dbl(0), "d": dbl(0)}
    rows = load(spark, sf_dir, "f_images").withColumns({"row": (F.col("image_id") * 7) % 5000, "col": (F.col("image_id") * 13) % 5000})
    x, y = g.pixel_to_geo(t, F.col("row"), F.col("col"))
    cx, cy = g.pixel_to_geo(t, F.col("row"), F.col("col"), centre=True)
    back_row, back_col = g.geo_to_pixel(t, cx, cy)
    low_row, low_col = g.geo_to_pixel(t, F.col("c") - dbl(0.06), F.col("f") + dbl(0.06), floor=True)
    cut_row, cut_col = g.geo_to_pixel(t, F.col("c") - dbl(0.06), F.col("f") + dbl(0.06))
    wc, wf = g.window_transform(t, F.lit(10), F.lit(20))
    rounded = {"x": x, "y": y, "cx": cx, "cy": cy, "wc": wc, "wf": wf}
    return rows.select("image_id", *[F.round(v, 6).alias(k) for k, v in rounded.items()], back_row.alias("row"), back_col.alias("col"), low_row.alias("low_row"), low_col.alias("low_col"), cut_row.alias("cut_row"), cut_col.alias("cut_col"))


SQL_AFFINE = with_views("f_images") + """,
p AS (SELECT *, (image_id*7)%5000 AS r, (image_id*13)%5000 AS k FROM f_images)
SELECT image_id, round(a*k+c, 6) AS x, round(e*r+f, 6) AS y, round(a*(k+5e-1)+c, 6) AS cx, round(e*(r+5e-1)+f, 6) AS cy, round(a*20+c, 6) AS wc, round(e*10+f, 6) AS wf,
  r AS row, k AS col, CAST(-1 AS BIGINT) AS low_row, CAST(-1 AS BIGINT) AS low_col, CAST(0 AS BIGINT) AS cut_row, CAST(0 AS BIGINT) AS cut_col FROM p"""


def clip_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = {"x0": dbl(10), "y0": dbl(5), "x1": dbl(90), "y1": dbl(70)}
    return im.clip_to_bounds(load(spark, sf_dir, "f_preds"), bounds).select("pid", "x0", "y0", "x1", "y1")


SQL_CLIP = with_views("f_preds") + """
SELECT * FROM (SELECT pid, greatest(x0, 12e0) AS x0, greatest(y0, 7e0) AS y0, least(x1, 88e0) AS x1, least(y1, 68e0) AS y1 FROM f_preds) WHERE x0 < x1 AND y0 < y1"""


def layer_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.layer_extent(load(spark, sf_dir, "f_crowns"), 5.0)


SQL_EXTENT = with_views("f_crowns") + "\nSELECT min(x0)-5 AS x0, min(y0)-5 AS y0, max(x1)+5 AS x1, max(y1)+5 AS y1 FROM f_crowns"


def predictions_in_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.within_extent(load(spark, sf_dir, "f_preds"), load(spark, sf_dir, "f_annots"), "tile").select("pid", "tile")


SQL_IN_EXTENT = with_views("f_preds", "f_annots") + """,
ext AS (SELECT tile, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM f_annots GROUP BY tile)
SELECT pid, p.tile FROM f_preds p JOIN ext USING (tile) WHERE x0 <= c AND a <= x1 AND y0 <= d AND b <= y1"""


def resume_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = load(spark, sf_dir, "f_images").select("image_id", "file_name")
    done = work.filter("image_id % 4 = 1").withColumn("parameters", F.lit("tile=250;buffer=20"))
    other = work.filter("image_id % 4 = 2").withColumn("parameters", F.lit("tile=50;buffer=20"))
    return outstanding(work, done.unionByName(other), "file_name", "tile=250;buffer=20")


SQL_RESUME = with_views("f_images") + "\nSELECT image_id, file_name FROM f_images WHERE image_id % 4 <> 1"


def union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two models' crowns with duplicates by box and confidence dropped, and what both have."""
    crowns = load(spark, sf_dir, "f_crowns").select("image_id", "x0", "y0", "x1", "y1", "conf")
    a, b = crowns.filter("image_id < 10"), crowns.filter("image_id > 5")
    return a.unionByName(b).dropDuplicates().withColumn("side", F.lit("union")).unionByName(a.intersect(b).withColumn("side", F.lit("both"))).groupBy("side", "image_id").agg(F.count("*").alias("n"))


SQL_UNION = with_views("f_crowns") + """,
k AS (SELECT image_id, x0, y0, x1, y1, conf FROM f_crowns)
SELECT 'union' AS side, image_id, count(*) AS n FROM (SELECT * FROM k WHERE image_id < 10 UNION SELECT * FROM k WHERE image_id > 5) GROUP BY image_id
UNION ALL SELECT 'both', image_id, count(*) FROM (SELECT * FROM k WHERE image_id < 10 INTERSECT SELECT * FROM k WHERE image_id > 5) GROUP BY image_id"""


QUERIES = {
    "tile_grid": tile_grid, "tile_id_parse": tile_id_parse, "tile_coverage_flags": tile_coverage_flags, "tile_coverage_polygons": tile_coverage_polygons, "tile_exclude": tile_exclude, "image_height_match": image_height_match,
    "layer_height_fallback": layer_height_fallback, "image_adjacency": image_adjacency, "cross_batch_adjacency": cross_batch_adjacency, "merged_names": merged_names, "within_tile_semi": within_tile_semi,
    "affine_roundtrip": affine_roundtrip, "clip_boxes": clip_boxes, "layer_extent": layer_extent, "predictions_in_extent": predictions_in_extent, "resume_manifest": resume_manifest, "union_dedup": union_dedup,
}
ORACLES = {
    "tile_grid": SQL_TILES, "tile_id_parse": SQL_PARSE, "tile_coverage_flags": SQL_FLAGS, "tile_coverage_polygons": SQL_FLAGS, "tile_exclude": SQL_EXCLUDE, "image_height_match": SQL_HEIGHTS,
    "layer_height_fallback": SQL_FALLBACK, "image_adjacency": SQL_ADJACENCY, "cross_batch_adjacency": SQL_CROSS, "merged_names": SQL_MERGED, "within_tile_semi": SQL_WITHIN,
    "affine_roundtrip": SQL_AFFINE, "clip_boxes": SQL_CLIP, "layer_extent": SQL_EXTENT, "predictions_in_extent": SQL_IN_EXTENT, "resume_manifest": SQL_RESUME, "union_dedup": SQL_UNION,
}

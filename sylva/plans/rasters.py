"""Queries over rasters in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators import raster
from sylva.plans.fixtures import load, with_views

PIXELS = with_views("f_pixels")


def ndvi_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.ndvi_pixels(load(spark, sf_dir, "f_pixels")).select("image_id", "r", "c", F.round("ndvi", 9).alias("ndvi"))


SQL_NDVI = PIXELS + "\nSELECT image_id, r, c, round((nir/2.55e2-red/2.55e2)/(nir/2.55e2+red/2.55e2+1e-10), 9) AS ndvi FROM f_pixels"


def minmax_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.minmax_rescale(load(spark, sf_dir, "f_pixels"), "h").select("image_id", "r", "c", F.round("scaled", 6).alias("scaled"))


SQL_MINMAX = PIXELS + """,
m AS (SELECT image_id, min(h) AS a, max(h) AS b FROM f_pixels GROUP BY image_id)
SELECT p.image_id, r, c, round(CASE WHEN b > a THEN (h-a)/(b-a)*2.55e2 ELSE 0e0 END, 6) AS scaled FROM f_pixels p JOIN m USING (image_id)"""


def bit_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = load(spark, sf_dir, "f_pixels").withColumns({"red": F.col("red") * 256, "nir": F.col("nir") * 256})
    return raster.bit_rescale(deep, ("red", "nir"), "red").select("image_id", "r", "c", "red", "nir")


SQL_BITS = PIXELS + "\nSELECT image_id, r, c, CAST(floor(2.55e2*(red*256)/6.5535e4) AS BIGINT) AS red, CAST(floor(2.55e2*(nir*256)/6.5535e4) AS BIGINT) AS nir FROM f_pixels"


def resample_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.resample_box(load(spark, sf_dir, "f_pixels"), 0.25, "h").select("image_id", "r", "c", F.round("h", 9).alias("h"), "n")


SQL_RESAMPLE = PIXELS + "\nSELECT image_id, CAST(floor(r*2.5e-1) AS BIGINT) AS r, CAST(floor(c*2.5e-1) AS BIGINT) AS c, round(avg(h), 9) AS h, count(*) AS n FROM f_pixels GROUP BY 1, 2, 3"


def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.resize_nearest(load(spark, sf_dir, "f_pixels"), (128, 128), (48, 40)).select("image_id", "r", "c", "h")


SQL_NEAREST = PIXELS + """,
t AS (SELECT image_id, i, j FROM (SELECT DISTINCT image_id FROM f_pixels), (SELECT unnest(range(0, 48)) AS i), (SELECT unnest(range(0, 40)) AS j))
SELECT t.image_id, CAST(i AS INTEGER) AS r, CAST(j AS INTEGER) AS c, h FROM t JOIN f_pixels p ON p.image_id = t.image_id AND p.r = CAST(floor(i*(128/4.8e1)) AS BIGINT) AND p.c = CAST(floor(j*(128/4e1)) AS BIGINT)"""


def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.resample_bilinear(load(spark, sf_dir, "f_pixels"), (128, 128), (40, 50), "h").withColumn("h", F.round("h", 6))


SQL_BILINEAR = PIXELS + """,
t AS (SELECT image_id, i, j, least(greatest((i+5e-1)*(128/4e1)-5e-1, 0e0), 127e0) AS y, least(greatest((j+5e-1)*(128/5e1)-5e-1, 0e0), 127e0) AS x
  FROM (SELECT DISTINCT image_id FROM f_pixels), (SELECT unnest(range(0, 40)) AS i), (SELECT unnest(range(0, 50)) AS j)),
n AS (SELECT t.*, p.h, (1-abs(y-p.r))*(1-abs(x-p.c)) AS w FROM t JOIN f_pixels p ON p.image_id = t.image_id AND p.r IN (CAST(floor(y) AS BIGINT), CAST(floor(y) AS BIGINT)+1) AND p.c IN (CAST(floor(x) AS BIGINT), CAST(floor(x) AS BIGINT)+1))
SELECT image_id, CAST(i AS INTEGER) AS r, CAST(j AS INTEGER) AS c, round(sum(h*w)/sum(w), 6) AS h FROM n WHERE w > 0 GROUP BY image_id, i, j"""


def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.window_scan(load(spark, sf_dir, "f_pixels"), (10, 40), (5, 90)).select("image_id", "r", "c", "h")


SQL_WINDOW = PIXELS + "\nSELECT image_id, r-10 AS r, c-5 AS c, h FROM f_pixels WHERE r >= 10 AND r < 40 AND c >= 5 AND c < 90"


def center_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = load(spark, sf_dir, "f_pixels")
    images = pixels.groupBy("image_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    return raster.center_crop(pixels, images, 30, 200).select("image_id", "r", "c", "h")


SQL_CROP = PIXELS + """,
s AS (SELECT image_id, greatest(CAST(floor((max(r)+1-30)/2e0) AS BIGINT), 0) AS t, greatest(CAST(floor((max(c)+1-200)/2e0) AS BIGINT), 0) AS l FROM f_pixels GROUP BY image_id)
SELECT p.image_id, r-t AS r, c-l AS c, h FROM f_pixels p JOIN s USING (image_id) WHERE r >= t AND r < t+30 AND c >= l AND c < l+200"""


def mosaic_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = load(spark, sf_dir, "f_pixels")
    a = pixels.select("image_id", F.col("c").alias("x"), F.col("r").alias("y"), F.when(F.col("red") % 5 == 0, F.lit(1e12)).otherwise(F.col("h")).alias("h"))
    b = pixels.select("image_id", (F.col("c") + 40).alias("x"), F.col("r").alias("y"), F.col("h").alias("h"))
    return raster.mosaic(a, b, "h", keys=("image_id", "x", "y"))


SQL_MOSAIC = PIXELS + """,
a AS (SELECT image_id, c AS x, r AS y, CASE WHEN red % 5 <> 0 THEN h END AS h FROM f_pixels),
b AS (SELECT image_id, c+40 AS x, r AS y, h FROM f_pixels)
SELECT image_id, x, y, coalesce(a.h, b.h, 0e0) AS h FROM a FULL JOIN b USING (image_id, x, y)"""


def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.local_maxima(load(spark, sf_dir, "f_pixels"), 7, 2.5).select("image_id", "r", "c", "h")


MAXIMA = """top AS (SELECT p.image_id, p.r, p.c, p.h FROM f_pixels p JOIN f_pixels q ON p.image_id = q.image_id AND q.r BETWEEN p.r-3 AND p.r+3 AND q.c BETWEEN p.c-3 AND p.c+3
  WHERE p.h > 2.5e0 AND q.h > 2.5e0 GROUP BY p.image_id, p.r, p.c, p.h HAVING max(q.h) = p.h)"""
SQL_MAXIMA = PIXELS + ",\n" + MAXIMA + "\nSELECT * FROM top"


def cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pixels = load(spark, sf_dir, "f_pixels")
    seeds = raster.local_maxima(pixels, 7, 2.5)
    seeds = seeds.select("image_id", (F.col("r") * 1000 + F.col("c")).alias("seed_id"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    return pixels, raster.nearest_seed(pixels, seeds, 8.0)


def nearest_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir)[1]


CELLS = PIXELS + ",\n" + MAXIMA + """,
met AS (SELECT p.image_id, p.r, p.c, t.r*1000+t.c AS seed_id, CAST((p.r-t.r)*(p.r-t.r)+(p.c-t.c)*(p.c-t.c) AS DOUBLE) AS d2 FROM f_pixels p JOIN top t
  ON p.image_id = t.image_id),
cell AS (SELECT image_id, r, c, arg_min(seed_id, (d2, seed_id)) AS seed_id, min(d2) AS d2 FROM met GROUP BY image_id, r, c)"""
SQL_SEED = CELLS + "\nSELECT * FROM cell"


def cell_threshold_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, found = cells(spark, sf_dir)
    return raster.cell_share(found, pixels, 2.5, 0.2).withColumn("share", F.round("share", 9))


SQL_SHARE = CELLS + """
SELECT c.image_id, seed_id, count(*) AS n_pixels, round(avg(CASE WHEN h > 2.5e0 THEN 1e0 ELSE 0e0 END), 9) AS share,
  CASE WHEN bool_and(h > 2.5e0) THEN 'whole' WHEN avg(CASE WHEN h > 2.5e0 THEN 1e0 ELSE 0e0 END) >= 2e-1 THEN 'hull' ELSE 'drop' END AS verdict
FROM cell c JOIN f_pixels p ON p.image_id = c.image_id AND p.r = c.r AND p.c = c.c GROUP BY c.image_id, seed_id"""


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.smooth(load(spark, sf_dir, "f_pixels"), 1.0).select("image_id", "r", "c", F.round("h", 6).alias("h"))


WEIGHTS = "w AS (SELECT CAST(k AS BIGINT) AS k, exp(-5e-1*k*k) AS w FROM (SELECT unnest(range(-4, 5)) AS k))"
SQL_SMOOTH = PIXELS + ",\n" + WEIGHTS + """,
n AS (SELECT image_id, max(r)+1 AS nr, max(c)+1 AS nc FROM f_pixels GROUP BY image_id),
mc AS (SELECT p.image_id, p.r, p.c, w, nc, (p.c+k+4*nc) % (2*nc) AS m FROM f_pixels p JOIN n USING (image_id), w),
one AS (SELECT mc.image_id, mc.r, mc.c, sum(q.h*w)/sum(w) AS h FROM mc JOIN f_pixels q ON q.image_id = mc.image_id AND q.r = mc.r AND q.c = CASE WHEN m < nc THEN m ELSE 2*nc-1-m END GROUP BY mc.image_id, mc.r, mc.c),
mr AS (SELECT p.image_id, p.r, p.c, w, nr, (p.r+k+4*nr) % (2*nr) AS m FROM one p JOIN n USING (image_id), w)
SELECT mr.image_id, mr.r, mr.c, round(sum(q.h*w)/sum(w), 6) AS h FROM mr JOIN one q ON q.image_id = mr.image_id AND q.c = mr.c AND q.r = CASE WHEN m < nr THEN m ELSE 2*nr-1-m END GROUP BY mr.image_id, mr.r, mr.c"""


def patch_local_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.patch_max(load(spark, sf_dir, "f_patches"), 8, 3).select("vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


FLAT = with_views("f_patches") + """,
flat AS (SELECT vec_id, pos, embedding[pos+1] AS value, pos // 8 AS r, pos % 8 AS c FROM f_patches, (SELECT unnest(range(0, 64)) AS pos))"""
SQL_PATCH_MAX = FLAT + """
SELECT p.vec_id, CAST(p.pos AS INTEGER) AS pos, round(CAST(p.value AS DOUBLE), 6) AS value FROM flat p JOIN flat q ON p.vec_id = q.vec_id AND q.r BETWEEN p.r-1 AND p.r+1 AND q.c BETWEEN p.c-1 AND p.c+1
GROUP BY p.vec_id, p.pos, p.value HAVING max(q.value) = p.value"""


def patch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each patch from its array, without exploding it."""
    values = F.transform("embedding", lambda v: v.cast("double"))
    patches = load(spark, sf_dir, "f_patches").select("vec_id", "label", values.alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    spread = patches.withColumn("mean", mean)
    square = F.aggregate(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda s, x: s + x) / F.size("v")
    return spread.select("vec_id", "label", F.round("mean", 6).alias("mean"), F.round(square, 6).alias("var"), F.round(F.array_max("v"), 6).alias("high"), (F.array_position("v", F.array_max("v")) - 1).alias("at"))


SQL_PATCH = FLAT.replace("SELECT vec_id, pos,", "SELECT vec_id, label, pos,") + """
SELECT vec_id, label, round(avg(CAST(value AS DOUBLE)), 6) AS mean, round(var_pop(CAST(value AS DOUBLE)), 6) AS var, round(max(CAST(value AS DOUBLE)), 6) AS high, CAST(arg_max(pos, (value, -pos)) AS BIGINT) AS at FROM flat GROUP BY vec_id, label"""


QUERIES = {
    "ndvi_pixels": ndvi_pixels, "minmax_rescale": minmax_rescale, "bit_rescale": bit_rescale, "resample_box": resample_box, "resize_nearest": resize_nearest, "resample_bilinear": resample_bilinear, "window_scan": window_scan,
    "center_crop": center_crop, "mosaic_first_wins": mosaic_first_wins, "local_maxima": local_maxima, "nearest_seed": nearest_seed, "cell_threshold_share": cell_threshold_share,
    "smoothed": smoothed, "patch_local_max": patch_local_max, "patch_stats": patch_stats,
}
ORACLES = {
    "ndvi_pixels": SQL_NDVI, "minmax_rescale": SQL_MINMAX, "bit_rescale": SQL_BITS, "resample_box": SQL_RESAMPLE, "resize_nearest": SQL_NEAREST, "resample_bilinear": SQL_BILINEAR, "window_scan": SQL_WINDOW,
    "center_crop": SQL_CROP, "mosaic_first_wins": SQL_MOSAIC, "local_maxima": SQL_MAXIMA, "nearest_seed": SQL_SEED, "cell_threshold_share": SQL_SHARE,
    "smoothed": SQL_SMOOTH, "patch_local_max": SQL_PATCH_MAX, "patch_stats": SQL_PATCH,
}

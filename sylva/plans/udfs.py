"""Queries that need kernels outside column expressions, and the streaming extension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import geometry as g
from sylva.functions.geometry import box
from sylva.functions.polygons import apply_kernel, contours, decode_rle, iou_batch, simplify
from sylva.operators import evaluate as ev
from sylva.operators.detect import detect_crowns, detect_patches, hulls, threshold_detector
from sylva.operators.spatial_join import grid_join
from sylva.plans.fixtures import load, with_views
from sylva.plans.rasters import MAXIMA, PIXELS
from sylva.plans.vectors import RATIO
from sylva.runtime import partitions, scratch, ship
from sylva.streaming.incremental import tumbling


def dented(b: dict) -> Column:
    """A box's ring with a vertex in the middle of each side, pushed out a little."""
    mx, my = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    d = F.lit(0.0625)
    points = [(b["x0"], b["y0"]), (mx, b["y0"] - d), (b["x1"], b["y0"]), (b["x1"] + d, my), (b["x1"], b["y1"]), (mx, b["y1"] + d), (b["x0"], b["y1"]), (b["x0"] - d, my), (b["x0"], b["y0"])]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])


def simplify_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    crowns = load(spark, sf_dir, "f_crowns").select("crown_id", dented(box()).alias("raw"))
    return apply_kernel(crowns, "raw", lambda r: simplify(r, 0.2)).select("crown_id", g.ring_area(F.col("ring")).alias("area"), (F.size("ring")).alias("vertices"))


#: The vertex farthest from the first always stays: the corner, or for thin boxes the middle of a side.
SQL_SIMPLIFY = with_views("f_crowns") + """,
b AS (SELECT crown_id, x1-x0 AS w, y1-y0 AS h FROM f_crowns),
d AS (SELECT *, w*w+h*h AS corner, (w+6.25e-2)*(w+6.25e-2)+h*h/4 AS side, w*w/4+(h+6.25e-2)*(h+6.25e-2) AS top FROM b)
SELECT crown_id, w*h + CASE WHEN side >= corner AND side >= top THEN h*6.25e-2/2 WHEN top > corner THEN w*6.25e-2/2 ELSE 0e0 END AS area,
  CASE WHEN (side >= corner AND side >= top) OR top > corner THEN 6 ELSE 5 END AS vertices FROM d"""


def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hull of each tile's box corners, and its area."""
    ship(spark)
    points = load(spark, sf_dir, "f_preds").withColumn("p", F.explode(g.box_ring(box()))).select("pid", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.lit(25.0).alias("v"))
    inner = load(spark, sf_dir, "f_preds").select("pid", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.lit(10.0).alias("v"))
    return hulls(points.unionByName(inner), ["pid"], "x", "y", "v").select("pid", g.ring_area(F.col("ring")).alias("area"), F.size("ring").alias("vertices"), "score")


SQL_HULL = with_views("f_preds") + "\nSELECT pid, (x1-x0)*(y1-y0) AS area, 5 AS vertices, 5e-1 AS score FROM f_preds"


def contour_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of boxes given as run lengths, decoded and traced: (pid, number, area, vertices)."""
    ship(spark)
    # The kernel costs far more than the few bytes of a row, by which a file is cut into tasks.
    preds = load(spark, sf_dir, "f_preds").select("pid", (F.col("pid") % 5 + 3).alias("w"), (F.col("pid") % 7 + 3).alias("h")).repartition(partitions(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list] = {}  # the borders of masks met before; equal masks are traced once
        for batch in batches:
            pids, numbers, sizes, points = [], [], [], []
            for pid, w, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = (20 + 1, *(h, 20 - h) * (w - 1), h, 400 - 21 - 20 * (w - 1) - h)  # columns of a 20 x 20 mask
                key = (counts, pid % 2)
                if key not in known:
                    mask = decode_rle(list(counts), 20, 20)
                    if pid % 2:
                        mask[2, 2] = False  # a hole in the middle of a corner of the box
                    if len(known) >= 4096:
                        known.clear()
                    known[key] = contours(mask)
                for n, ring in enumerate(known[key]):
                    pids.append(pid)
                    numbers.append(n)
                    sizes.append(len(ring))
                    points += ring
            xy = np.array(points, np.float64).reshape(-1, 2)
            rings = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays([pa.array(xy[:, k]) for k in (0, 1)], names=["x", "y"]))
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(numbers, pa.int32()), rings], names=["pid", "number", "ring"])

    traced = preds.mapInArrow(run, "pid long, number int, ring array<struct<x:double,y:double>>")
    return traced.select("pid", "number", g.ring_area(F.col("ring")).alias("area"))


SQL_CONTOUR = with_views("f_preds") + """
SELECT pid, 0 AS number, CAST((pid%5+2)*(pid%7+2) AS DOUBLE) AS area FROM f_preds UNION ALL SELECT pid, 1, 2e0 FROM f_preds WHERE pid % 2 = 1"""


def polygon_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of candidate pairs by the general polygon kernel."""
    ship(spark)
    preds, annots = load(spark, sf_dir, "f_preds"), load(spark, sf_dir, "f_annots")
    pairs = grid_join(preds, annots, 64.0, ("tile",), g.crosses(box("a_"), box("b_"))).select(F.col("a_pid").alias("pid"), F.col("b_aid").alias("aid"), g.box_ring(box("a_")).alias("p"), g.box_ring(box("b_")).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(iou_batch(batch.column(2), batch.column(3)), pa.float64())], names=["pid", "aid", "iou"])

    return pairs.mapInArrow(run, "pid long, aid long, iou double").withColumn("iou", F.round("iou", 6))


SQL_POLYGON_IOU = with_views("f_preds", "f_annots") + f"\nSELECT pid, aid, round({RATIO}, 6) AS iou FROM f_preds a JOIN f_annots b ON a.tile = b.tile AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


def detect_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default detector: a crown for each local maximum."""
    ship(spark)
    return detect_crowns(load(spark, sf_dir, "f_pixels")).select("image_id", "seed_id", "score")


SQL_DETECT = PIXELS + ",\n" + MAXIMA + "\nSELECT image_id, r*4294967296+c AS seed_id, least(h/50, 1e0) AS score FROM top"


def detect_on_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours of the patches' high regions, with their areas."""
    ship(spark)
    found = detect_patches(load(spark, sf_dir, "f_patches"), threshold_detector(0.05), 8)
    return found.select("vec_id", "number", F.round("score", 6).alias("score"), g.ring_area(F.col("ring")).alias("area"))


def match_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty bins of the best IoU of every annotation, those without a match in the first."""
    ship(spark)
    return ev.histogram(ev.best_iou(load(spark, sf_dir, "f_preds"), load(spark, sf_dir, "f_annots"), "tile", 64.0), "iou", 20)


SQL_MATCH_HISTOGRAM = with_views("f_preds", "f_annots") + f""",
best AS (SELECT b.aid, max(CASE WHEN a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 THEN {RATIO} ELSE 0e0 END) AS iou FROM f_annots b LEFT JOIN f_preds a ON a.tile = b.tile GROUP BY b.aid)
SELECT CAST(least(floor(iou*20), 19) AS BIGINT) AS bin, count(*) AS n FROM best GROUP BY 1"""


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows of an hour over the events as a stream of files, written by the file sink and read back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    out, checkpoint = scratch(spark, "windows"), scratch(spark, "offsets")
    closed = tumbling(stream, "1 hour", "10 minutes")
    closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(closed.schema).parquet(out)
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


SQL_TUMBLING = """
WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,6))) AS total FROM events GROUP BY 1, 2)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, n, round(CAST(total AS DOUBLE), 4) AS total FROM w
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""

QUERIES = {
    "simplify_area": simplify_area, "convex_hull": convex_hull, "contour_trace": contour_trace, "polygon_iou_pairs": polygon_iou_pairs, "detect_stub": detect_stub,
    "detect_on_patches": detect_on_patches, "match_histogram": match_histogram, "events_tumbling": events_tumbling,
}
ORACLES = {
    "simplify_area": SQL_SIMPLIFY, "convex_hull": SQL_HULL, "contour_trace": SQL_CONTOUR, "polygon_iou_pairs": SQL_POLYGON_IOU, "detect_stub": SQL_DETECT,
    "match_histogram": SQL_MATCH_HISTOGRAM, "events_tumbling": SQL_TUMBLING,
}

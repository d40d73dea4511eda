"""Queries over shapes: validity, unions, cells, outlines, and the full sweep of parameters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import geometry as g
from sylva.functions.boxes import box_union, edges
from sylva.functions.geometry import box, box_area, dbl
from sylva.functions.overlay import shape_area
from sylva.functions.repair import valid_parts
from sylva.operators import clean, raster
from sylva.operators import evaluate as ev
from sylva.operators import images as im
from sylva.operators.spatial_join import grid_join, near_join
from sylva.plans.fixtures import load, with_views
from sylva.plans.rasters import CELLS, cells
from sylva.plans.vectors import AREA, IOU, RATIO, sql_zonal, stats
from sylva.runtime import materialise, ship

B = AREA.format("b")


def annotation_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.extent_overlap(load(spark, sf_dir, "f_annots"), load(spark, sf_dir, "f_preds").filter("pid % 3 = 0"), "tile")


SQL_EXTENTS = with_views("f_preds", "f_annots") + """,
l AS (SELECT tile, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM f_annots GROUP BY tile),
r AS (SELECT tile, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM f_preds WHERE pid % 3 = 0 GROUP BY tile),
b AS (SELECT l.tile, greatest(l.x0, r.x0) AS x0, greatest(l.y0, r.y0) AS y0, least(l.x1, r.x1) AS x1, least(l.y1, r.y1) AS y1 FROM l JOIN r ON l.tile = r.tile)
SELECT * FROM b WHERE x0 < x1 AND y0 < y1"""


def unmatched_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.unmatched(load(spark, sf_dir, "f_preds"), load(spark, sf_dir, "f_annots").filter("tile % 4 <> 1"), "tile")


SQL_UNMATCHED = with_views("f_preds", "f_annots") + "\nSELECT DISTINCT tile FROM f_preds WHERE tile NOT IN (SELECT tile FROM f_annots WHERE tile % 4 <> 1)"


def ring_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that cross themselves fall into parts, rings on a line into none."""
    ship(spark)
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    bow, line = F.array(at("x0", "y0"), at("x1", "y1"), at("x1", "y0"), at("x0", "y1"), at("x0", "y0")), F.array(at("x0", "y0"), at("x1", "y1"), at("x0", "y0"), at("x0", "y0"))
    raw = F.when(F.col("pid") % 3 == 0, bow).when(F.col("pid") % 3 == 1, g.box_ring(box())).otherwise(line)
    rings = load(spark, sf_dir, "f_preds").select("pid", raw.alias("ring")).withColumn("valid", g.is_valid_ring(F.col("ring")))

    def run(batches):
        for batch in batches:
            parts = [valid_parts([(p["x"], p["y"]) for p in r]) for r in batch.column(1).to_pylist()]
            areas = [sum(shape_area([np.array(p)]) for p in found) for found in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(p) for p in parts], pa.int32()), pa.array(areas, pa.float64())], names=["pid", "valid", "parts", "area"])

    return rings.select("pid", "ring", "valid").mapInArrow(run, "pid long, valid boolean, parts int, area double").withColumn("area", F.round("area", 6))


SQL_REPAIR = with_views("f_preds") + """
SELECT pid, pid % 3 = 1 AS valid, CASE pid % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS parts, round(CASE pid % 3 WHEN 0 THEN (x1-x0)*(y1-y0)/2 WHEN 1 THEN (x1-x0)*(y1-y0) ELSE 0e0 END, 6) AS area FROM f_preds"""


def union_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all boxes of a tile, as geometry: its area and its bounds."""
    ship(spark)

    def run(table: pa.Table) -> pa.Table:
        x0, y0, x1, y1 = box_union(edges(table)).T
        if not len(x0):
            return pa.table({"tile": table["tile"][:0], "area": pa.array([], pa.float64()), "x0": pa.array([], pa.float64()), "y1": pa.array([], pa.float64())})
        return pa.table({"tile": table["tile"][:1], "area": [float(((x1 - x0) * (y1 - y0)).sum())], "x0": [float(x0.min())], "y1": [float(y1.max())]})

    return load(spark, sf_dir, "f_preds").select("tile", "x0", "y0", "x1", "y1").dropna().distinct().groupBy("tile").applyInArrow(run, "tile long, area double, x0 double, y1 double").withColumn("area", F.round("area", 6))


SQL_UNION = with_views("f_preds") + """,
cx AS (SELECT tile, v AS u0, lead(v) OVER (PARTITION BY tile ORDER BY v) AS u1 FROM (SELECT DISTINCT tile, unnest([x0, x1]) AS v FROM f_preds)),
cy AS (SELECT tile, v AS v0, lead(v) OVER (PARTITION BY tile ORDER BY v) AS v1 FROM (SELECT DISTINCT tile, unnest([y0, y1]) AS v FROM f_preds)),
held AS (SELECT DISTINCT cx.tile, u0, u1, v0, v1 FROM cx JOIN cy ON cx.tile = cy.tile JOIN f_preds p ON p.tile = cx.tile AND x0 <= u0 AND x1 >= u1 AND y0 <= v0 AND y1 >= v1)
SELECT h.tile, round(sum((u1-u0)*(v1-v0)), 6) AS area, min(u0) AS x0, max(v1) AS y1 FROM held h GROUP BY h.tile"""


def affine_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of arrays of pixels, corners and centres."""
    t = {k: F.col(k) for k in ("a", "c", "e", "f")} | {"b": dbl(0), "d": dbl(0)}
    rows = load(spark, sf_dir, "f_images").withColumns({"rows": F.sequence(F.lit(0), F.lit(4)), "cols": F.sequence(F.lit(10), F.lit(14))})
    x, y = g.pixels_to_geo(t, F.col("rows"), F.col("cols"))
    cx, cy = g.pixel_to_geo(t, F.lit(2), F.lit(3), centre=True)
    placed = rows.select("image_id", F.posexplode(F.arrays_zip(x.alias("x"), y.alias("y"))).alias("pos", "p"), cx.alias("cx"), cy.alias("cy"))
    return placed.select("image_id", "pos", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


SQL_ARRAYS = with_views("f_images") + """
SELECT image_id, CAST(i AS INTEGER) AS pos, round(c+a*(10+i), 6) AS x, round(f+e*i, 6) AS y, round(c+a*3.5e0, 6) AS cx, round(f+e*2.5e0, 6) AS cy FROM f_images, (SELECT unnest(range(0, 5)) AS i)"""


def raster_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {k: F.col(k) for k in ("a", "c", "e", "f")} | {"b": dbl(0), "d": dbl(0)}
    rings = load(spark, sf_dir, "f_images").withColumn("ring", g.raster_outline(t, F.col("height"), F.col("width")))
    bounds, crs = g.ring_box(F.col("ring")), g.same_crs(F.lit(25832), F.lit(25832))
    return rings.select("image_id", F.round(g.ring_area(F.col("ring")), 3).alias("area"), F.round(bounds["x1"], 6).alias("x1"), F.round(bounds["y0"], 6).alias("y0"), F.size("ring").alias("points"), crs.alias("crs"))


SQL_OUTLINES = with_views("f_images") + "\nSELECT image_id, round(abs(a*width*e*height), 3) AS area, round(c+a*width, 6) AS x1, round(f+e*height, 6) AS y0, 5 AS points, 25832 AS crs FROM f_images"


def near_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of two layers that are the same but for rounding."""
    preds = load(spark, sf_dir, "f_preds")
    moved = preds.withColumns({k: F.col(k) + F.when(F.col("pid") % 3 == 0, dbl(0.0005)).when(F.col("pid") % 3 == 1, dbl(0.5)).otherwise(dbl(0)) for k in ("x0", "y1")})
    pairs = near_join(preds, moved, ("tile",))
    return pairs.select(F.col("a_pid").alias("pid"), F.col("b_pid").alias("same"))


SQL_NEAR = with_views("f_preds") + """,
m AS (SELECT tile, pid, x0+d AS x0, y0, x1, y1+d AS y1 FROM (SELECT *, CASE pid % 3 WHEN 0 THEN 5e-4 WHEN 1 THEN 5e-1 ELSE 0e0 END AS d FROM f_preds))
SELECT a.pid, b.pid AS same FROM f_preds a JOIN m b ON a.tile = b.tile AND abs(a.x0-b.x0) < 1e-3 AND abs(a.y0-b.y0) < 1e-3 AND abs(a.x1-b.x1) < 1e-3 AND abs(a.y1-b.y1) < 1e-3"""


def patch_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions of each patch's high values."""
    ship(spark)
    flat = load(spark, sf_dir, "f_patches").select("vec_id", F.posexplode("embedding").alias("pos", "value")).filter("value > 0.05")
    found = raster.components_of(flat.select("vec_id", F.floor(F.col("pos") / 8).alias("r"), (F.col("pos") % 8).alias("c")), "vec_id")
    return found.groupBy("vec_id", "component").agg(F.count("*").alias("n")).groupBy("vec_id").agg(F.count("*").alias("regions"), F.max("n").alias("largest"))


SQL_COMPONENTS = with_views("f_patches", recursive=True) + """,
p AS (SELECT vec_id, pos, pos // 8 AS r, pos % 8 AS c FROM f_patches, (SELECT unnest(range(0, 64)) AS pos) WHERE embedding[pos+1] > CAST(0.05 AS DOUBLE)),
reach AS (SELECT vec_id, pos, pos AS root FROM p UNION SELECT q.vec_id, q.pos, reach.root FROM reach JOIN p ON p.vec_id = reach.vec_id AND p.pos = reach.pos JOIN p q ON q.vec_id = p.vec_id AND abs(q.r-p.r) + abs(q.c-p.c) = 1),
low AS (SELECT vec_id, pos, min(root) AS root FROM reach GROUP BY vec_id, pos),
size AS (SELECT vec_id, root, count(*) AS n FROM low GROUP BY vec_id, root)
SELECT vec_id, count(*) AS regions, max(n) AS largest FROM size GROUP BY vec_id"""


def cell_crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowns of the cells that are kept: the bounds of their hulls."""
    ship(spark)
    pixels, found = cells(spark, sf_dir)
    crowns = raster.cell_crowns(found, pixels, 2.5, 0.2)
    b = g.ring_box(F.col("ring"))
    return crowns.filter("ring IS NOT NULL").select("image_id", "seed_id", "verdict", *[b[k].alias(k) for k in ("x0", "y0", "x1", "y1")])


#: A hull needs three pixels that aren't on a line.
SQL_CROWNS = CELLS + """,
v AS (SELECT c.image_id, seed_id, c.r, c.c, h > 2.5e0 AS high, avg(CASE WHEN h > 2.5e0 THEN 1e0 ELSE 0e0 END) OVER w AS share FROM cell c JOIN f_pixels p ON p.image_id = c.image_id AND p.r = c.r AND p.c = c.c WINDOW w AS (PARTITION BY c.image_id, seed_id)),
k AS (SELECT image_id, seed_id, CASE WHEN share = 1 THEN 'whole' ELSE 'hull' END AS verdict, r, c, first(r) OVER w AS r0, first(c) OVER w AS c0 FROM v WHERE high AND share >= 2e-1 WINDOW w AS (PARTITION BY image_id, seed_id ORDER BY c, r)),
s AS (SELECT *, first(r) OVER w AS r1, first(c) OVER w AS c1 FROM k WINDOW w AS (PARTITION BY image_id, seed_id ORDER BY c DESC, r DESC))
SELECT image_id, seed_id, verdict, CAST(min(c) AS DOUBLE) AS x0, CAST(min(r) AS DOUBLE) AS y0, CAST(max(c) AS DOUBLE) AS x1, CAST(max(r) AS DOUBLE) AS y1 FROM s
GROUP BY image_id, seed_id, verdict HAVING bool_or((c1-c0)*(r-r0) <> (r1-r0)*(c-c0))"""


def voronoi_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a lattice in each tile: squares, but for those on its border, which are unbounded."""
    ship(spark)
    tiles = load(spark, sf_dir, "f_preds").select("tile").distinct()
    step = F.col("tile") + 1
    seeds = tiles.select("tile", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("k")).select("tile", F.col("k").cast("long").alias("seed_id"), (F.col("k") % 6 * step).cast("double").alias("x"), (F.floor(F.col("k") / 6) * step).cast("double").alias("y"))
    found = raster.vector_cells(seeds, "tile", (0.0, 0.0, 150.0, 150.0))
    b = g.ring_box(F.col("ring"))
    return found.select("tile", "seed_id", F.round(g.ring_area(F.col("ring")), 6).alias("area"), F.round(b["x0"], 6).alias("x0"), F.round(b["y1"], 6).alias("y1"))


SQL_LATTICE = with_views("f_preds") + """
SELECT tile, CAST(k AS BIGINT) AS seed_id, round(greatest(least((k%6+5e-1)*(tile+1), 150) - least((k%6-5e-1)*(tile+1), 150), 0) * greatest(least((k//6+5e-1)*(tile+1), 150) - least((k//6-5e-1)*(tile+1), 150), 0), 6) AS area,
  round((k%6-5e-1)*(tile+1), 6) AS x0, round(least((k//6+5e-1)*(tile+1), 150), 6) AS y1
FROM (SELECT DISTINCT tile FROM f_preds), (SELECT unnest(range(0, 36)) AS k) WHERE k%6 BETWEEN 1 AND 4 AND k//6 BETWEEN 1 AND 4 AND (k%6-5e-1)*(tile+1) < 150 AND (k//6-5e-1)*(tile+1) < 150"""


def simplified_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas after simplification: dents of one unit go, corners stay."""
    ship(spark)
    big = load(spark, sf_dir, "f_crowns").select("crown_id", *[(F.col(k) * 100).alias(k) for k in ("x0", "y0", "x1", "y1")])
    b = box()
    mx, my = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    points = [(b["x0"], b["y0"]), (mx, b["y0"] - 1), (b["x1"], b["y0"]), (b["x1"] + 1, my), (b["x1"], b["y1"]), (b["x0"], b["y1"]), (b["x0"], b["y0"])]
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])
    return clean.simplified_area(big.select("crown_id", ring.alias("ring"))).select("crown_id", F.round("area", 3).alias("area"), g.round_to(F.sqrt("area"), 1).alias("side"))


SQL_SIMPLIFIED = with_views("f_crowns") + "\nSELECT crown_id, round((x1-x0)*(y1-y0)*1e4, 3) AS area, round_even(sqrt((x1-x0)*(y1-y0)*1e4)*1e1, 0)/1e1 AS side FROM f_crowns"

# The parameters of the sweep.
SWEEP = {"conf_t": [0.3, 0.4, 0.5], "var_t": [0.1, 0.05, 0.15], "area_t": [1.0], "held_t": [0.6, 0.75, 0.9], "iou_t": [0.6, 0.4, 0.8], "mean_t": [0.05, 0.15, 0.1, 0.2]}


def param_sweep_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 324 runs of the cleaning: how many crowns each keeps, and their area.

    The suppression runs once for each of the nine pairs of confidence and IoU, as its rows carry the pair in their group;
    statistics of pixels are the same for all runs; containment is counted once for all three of its limits.
    """
    ship(spark)
    preds, found = stats(spark, sf_dir)
    known = preds.withColumn("area", box_area(box())).join(found.select("pid", F.round("index_mean", 9).alias("m"), F.round("index_var", 9).alias("v")), "pid")
    pairs = F.broadcast(ev.parameter_grid(spark, conf_t=SWEEP["conf_t"], iou_t=SWEEP["iou_t"]).withColumnRenamed("run", "pair"))
    runs = known.join(pairs, (F.col("conf") >= F.col("conf_t")) & (F.col("area") >= dbl(SWEEP["area_t"][0]))).withColumn("grp", F.col("tile") * 16 + F.col("pair"))
    live = materialise(clean.greedy_suppress(runs, "grp", iou="iou_t", area_difference=0.5), "survivors")
    both = grid_join(live.select("grp", "pid", "x0", "y0", "x1", "y1"), live.select("grp", "pid", "x0", "y0", "x1", "y1"), 64.0, ("grp",), F.col("a_pid") != F.col("b_pid"))
    share = g.overlap_area(box("a_"), box("b_")) / box_area(box("b_"))
    held = both.groupBy(F.col("a_grp").alias("grp"), F.col("a_pid").alias("pid")).agg(*[F.count_if(share >= dbl(t)).alias(f"n{i}") for i, t in enumerate(SWEEP["held_t"])])
    limits = F.explode(F.array(*[F.struct(dbl(t).alias("held_t"), F.coalesce(f"n{i}", F.lit(0)).alias("n")) for i, t in enumerate(SWEEP["held_t"])])).alias("h")
    counted = live.join(held, ["grp", "pid"], "left").select("conf_t", "iou_t", "area", "m", "v", limits).filter("h.n < 2")
    grid = ev.parameter_grid(spark, **SWEEP)
    passes = (F.col("g.conf_t") == F.col("k.conf_t")) & (F.col("g.iou_t") == F.col("k.iou_t")) & (F.col("g.held_t") == F.col("h.held_t")) & clean.index_passes(F.col("m"), F.col("v"), F.col("g.mean_t"), F.col("g.var_t"))
    kept = counted.alias("k").join(F.broadcast(grid.alias("g")), passes).groupBy("g.run").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    return grid.join(kept, "run", "left").fillna(0, ["n", "area"])


LISTED = {k: "[" + ", ".join(f"{v:.2e}" for v in values) + "]" for k, values in SWEEP.items()}
SQL_SWEEP = with_views("f_preds", "f_pixels", recursive=True) + ",\n" + sql_zonal() + f""",
pr AS (SELECT row_number() OVER (ORDER BY ci, ii) - 1 AS pair, conf_t, iou_t FROM (SELECT unnest({LISTED['conf_t']}) AS conf_t, unnest([0, 1, 2]) AS ci), (SELECT unnest({LISTED['iou_t']}) AS iou_t, unnest([0, 1, 2]) AS ii)),
cand AS (SELECT p.*, tile * 16 + pair AS grp, conf_t, iou_t, (x1-x0)*(y1-y0) AS area FROM f_preds p JOIN pr ON conf >= conf_t WHERE (x1-x0)*(y1-y0) >= 1),
near AS (SELECT a.grp, a.pid AS i, b.pid AS j, b.conf FROM cand a JOIN cand b ON a.grp = b.grp AND (a.pid = b.pid OR ({RATIO} > a.iou_t AND abs(a.area-b.area)/greatest(a.area, b.area) < 5e-1))),
step AS (SELECT grp, i, list(j) AS js, arg_max(j, (conf, -j)) AS best, row_number() OVER (PARTITION BY grp ORDER BY i) AS n FROM near GROUP BY grp, i),
fold AS (SELECT grp, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS gone FROM (SELECT DISTINCT grp FROM cand)
  UNION ALL SELECT f.grp, s.n, CASE WHEN list_contains(f.gone, s.i) THEN f.gone ELSE list_distinct(list_concat(f.gone, list_filter(s.js, lambda x: x <> s.best))) END FROM fold f JOIN step s ON s.grp = f.grp AND s.n = f.n + 1),
done AS (SELECT grp, arg_max(gone, n) AS gone FROM fold GROUP BY grp),
live AS (SELECT c.*, round(s.index_mean, 9) AS m, round(s.index_var, 9) AS v FROM cand c JOIN done d ON c.grp = d.grp AND NOT list_contains(d.gone, c.pid) JOIN stat s ON s.pid = c.pid),
lim AS (SELECT unnest({LISTED['held_t']}) AS held_t),
num AS (SELECT a.grp, a.pid, a.conf_t, a.iou_t, a.area, a.m, a.v, held_t, (SELECT count(*) FROM live b WHERE b.grp = a.grp AND b.pid <> a.pid AND ({IOU}) / ({B}) >= held_t) AS n FROM live a, lim),
g AS (SELECT row_number() OVER (ORDER BY i0, i1, i2, i3, i4) - 1 AS run, conf_t, var_t, 1e0 AS area_t, held_t, iou_t, mean_t FROM (SELECT unnest({LISTED['conf_t']}) AS conf_t, unnest([0, 1, 2]) AS i0), (SELECT unnest({LISTED['var_t']}) AS var_t, unnest([0, 1, 2]) AS i1),
  (SELECT unnest({LISTED['held_t']}) AS held_t, unnest([0, 1, 2]) AS i2), (SELECT unnest({LISTED['iou_t']}) AS iou_t, unnest([0, 1, 2]) AS i3), (SELECT unnest({LISTED['mean_t']}) AS mean_t, unnest([0, 1, 2, 3]) AS i4))
SELECT run, g.conf_t, g.var_t, g.area_t, g.held_t, g.iou_t, g.mean_t, count(k.pid) AS n, coalesce(sum(k.area), 0e0) AS area FROM g
LEFT JOIN num k ON k.n < 2 AND k.conf_t = g.conf_t AND k.iou_t = g.iou_t AND k.held_t = g.held_t AND NOT ((m < mean_t OR v > var_t) AND m > -1) GROUP BY ALL"""

QUERIES = {
    "annotation_extents": annotation_extents, "unmatched_layers": unmatched_layers, "ring_repair": ring_repair, "union_by_tile": union_by_tile, "affine_arrays": affine_arrays, "raster_outlines": raster_outlines,
    "near_boxes": near_boxes, "patch_components": patch_components, "cell_crowns": cell_crowns, "voronoi_lattice": voronoi_lattice, "simplified_areas": simplified_areas, "param_sweep_full": param_sweep_full,
}
ORACLES = {
    "annotation_extents": SQL_EXTENTS, "unmatched_layers": SQL_UNMATCHED, "ring_repair": SQL_REPAIR, "union_by_tile": SQL_UNION, "affine_arrays": SQL_ARRAYS, "raster_outlines": SQL_OUTLINES,
    "near_boxes": SQL_NEAR, "patch_components": SQL_COMPONENTS, "cell_crowns": SQL_CROWNS, "voronoi_lattice": SQL_LATTICE, "simplified_areas": SQL_SIMPLIFIED, "param_sweep_full": SQL_SWEEP,
}

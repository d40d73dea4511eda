"""Queries that score predictions against annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators import evaluate as ev
from sylva.plans.fixtures import load, with_views
from sylva.plans.vectors import RATIO
from sylva.runtime import ship

CELL = 64.0
# The thresholds of the evaluation.
IOUS = CONFS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
LIMITS = "[3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1]"
BOTH = with_views("f_preds", "f_annots")
CROSS = "a.tile = b.tile AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
PAIRS = f"pair AS (SELECT a.tile, a.pid, b.aid, {RATIO} AS iou, a.conf FROM f_preds a JOIN f_annots b ON {CROSS})"


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "f_preds"), load(spark, sf_dir, "f_annots")


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ev.greedy_match(*both(spark, sf_dir), "tile", [0.5]).select("tile", "pid", "aid", F.round("iou", 9).alias("iou"))


SQL_GREEDY = with_views("f_preds", "f_annots", recursive=True) + ",\n" + PAIRS + """,
step AS (SELECT tile, pid, list({'iou': iou, 'aid': aid} ORDER BY iou DESC, aid) AS options, row_number() OVER (PARTITION BY tile ORDER BY pid) AS n FROM pair GROUP BY tile, pid),
fold AS (SELECT tile, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pid, CAST(NULL AS BIGINT) AS aid, CAST(NULL AS DOUBLE) AS iou FROM (SELECT DISTINCT tile FROM pair)
  UNION ALL SELECT tile, n, CASE WHEN o.iou >= 5e-1 THEN list_append(used, o.aid) ELSE used END, pid, CASE WHEN o.iou >= 5e-1 THEN o.aid END, o.iou
  FROM (SELECT f.tile, s.n, f.used, s.pid, list_filter(s.options, lambda x: NOT list_contains(f.used, x.aid))[1] AS o FROM fold f JOIN step s ON s.tile = f.tile AND s.n = f.n + 1))"""
SQL_MATCH = SQL_GREEDY + "\nSELECT tile, pid, aid, round(iou, 9) AS iou FROM fold WHERE aid IS NOT NULL"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ev.threshold_grid(*both(spark, sf_dir), "tile", IOUS, CONFS)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1") if c in df.columns})


def pr_f1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid(spark, sf_dir))


GRID = with_views("f_preds", "f_annots", recursive=True) + ",\n" + PAIRS + f""",
lim AS (SELECT iou_t, conf_t FROM (SELECT unnest({LIMITS}) AS iou_t), (SELECT unnest({LIMITS}) AS conf_t)),""" + """
cut AS (SELECT pair.*, iou_t, conf_t FROM pair JOIN lim ON conf >= conf_t),
step AS (SELECT tile, iou_t, conf_t, pid, list({'iou': iou, 'aid': aid} ORDER BY iou DESC, aid) AS options, row_number() OVER (PARTITION BY tile, iou_t, conf_t ORDER BY pid) AS n FROM cut GROUP BY tile, iou_t, conf_t, pid),
fold AS (SELECT tile, iou_t, conf_t, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT tile, iou_t, conf_t FROM cut)
  UNION ALL SELECT tile, iou_t, conf_t, n, CASE WHEN o.iou >= iou_t THEN list_append(used, o.aid) ELSE used END
  FROM (SELECT f.tile, f.iou_t, f.conf_t, s.n, f.used, list_filter(s.options, lambda x: NOT list_contains(f.used, x.aid))[1] AS o FROM fold f JOIN step s ON s.tile = f.tile AND s.iou_t = f.iou_t AND s.conf_t = f.conf_t AND s.n = f.n + 1)),
hit AS (SELECT tile, iou_t, conf_t, CAST(arg_max(len(used), n) AS BIGINT) AS tp FROM fold GROUP BY tile, iou_t, conf_t),
num AS (SELECT a.tile, iou_t, conf_t, count(*) AS np, max(na) AS na FROM (SELECT tile, count(*) AS na FROM f_annots GROUP BY tile) a JOIN f_preds p ON p.tile = a.tile JOIN lim ON p.conf >= conf_t GROUP BY a.tile, iou_t, conf_t),
cnt AS (SELECT num.tile, num.iou_t, num.conf_t, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, na - coalesce(tp, 0) AS fn FROM num LEFT JOIN hit ON hit.tile = num.tile AND hit.iou_t = num.iou_t AND hit.conf_t = num.conf_t)"""
PR = """{0} AS (SELECT *, CASE WHEN p + r > 0 THEN 2*p*r/(p+r) ELSE 0e0 END AS f1 FROM (SELECT *, CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0e0 END AS p, CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0e0 END AS r FROM {1}))"""
SQL_GRID = GRID + ",\n" + PR.format("sc", "cnt") + "\nSELECT tile, iou_t, conf_t, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1 FROM sc"


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.best_threshold(grid(spark, sf_dir), ["iou_t"])


SQL_BEST = GRID + ",\n" + PR.format("sc", "cnt") + """
SELECT iou_t, arg_max(conf_t, (f1, -conf_t)) AS conf_t, max(f1) AS f1 FROM (SELECT iou_t, conf_t, round(avg(f1), 9) AS f1 FROM sc GROUP BY 1, 2) GROUP BY iou_t"""


def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.micro_f1(grid(spark, sf_dir), ["iou_t", "conf_t"]))


SQL_MICRO = GRID + """,
total AS (SELECT iou_t, conf_t, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM cnt GROUP BY iou_t, conf_t),
""" + PR.format("sc", "total") + "\nSELECT iou_t, conf_t, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1 FROM sc"


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.macro_f1(grid(spark, sf_dir), ["conf_t"]))


SQL_MACRO = GRID + ",\n" + PR.format("sc", "cnt") + "\nSELECT conf_t, round(avg(f1), 9) AS f1 FROM sc GROUP BY conf_t"


def iou_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.histogram(ev.candidates(*both(spark, sf_dir), "tile", CELL), "iou", 20)


SQL_HISTOGRAM = BOTH + ",\n" + PAIRS + "\nSELECT CAST(least(floor(iou*20), 19) AS BIGINT) AS bin, count(*) AS n FROM pair WHERE iou BETWEEN 0 AND 1 GROUP BY 1"


def match_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.match_intersects(*both(spark, sf_dir), "tile", CELL)


SQL_INTERSECTS = BOTH + ",\n" + PAIRS + """,
hit AS (SELECT tile, count(DISTINCT aid) AS tp, count(DISTINCT pid) AS used FROM pair GROUP BY tile),
num AS (SELECT coalesce(p.tile, q.tile) AS tile, coalesce(np, 0) AS np, coalesce(na, 0) AS na FROM (SELECT tile, count(*) AS np FROM f_preds GROUP BY tile) p FULL JOIN (SELECT tile, count(*) AS na FROM f_annots GROUP BY tile) q ON p.tile = q.tile)
SELECT num.tile, coalesce(tp, 0) AS tp, np - coalesce(used, 0) AS fp, na - coalesce(tp, 0) AS fn FROM num LEFT JOIN hit USING (tile)"""


def match_best_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ev.best_iou(*both(spark, sf_dir), "tile", CELL).withColumn("iou", F.round("iou", 9))


SQL_BEST_IOU = BOTH + ",\n" + PAIRS + """,
top AS (SELECT tile, aid, arg_max(pid, (iou, -pid)) AS pid, max(iou) AS iou FROM pair GROUP BY tile, aid)
SELECT a.tile, a.aid, pid, round(coalesce(iou, 0e0), 9) AS iou FROM f_annots a LEFT JOIN top ON top.tile = a.tile AND top.aid = a.aid"""


def prompt_box_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    preds, annots = both(spark, sf_dir)
    return ev.fit_prompt_boxes(annots, preds, "tile", 0.6, 0.5, CELL)


SQL_FIT = BOTH + f""",
opt AS (SELECT b.tile, b.aid, {RATIO} AS iou, a.pid, a.x0 AS cx0, a.y0 AS cy0, a.x1 AS cx1, a.y1 AS cy1 FROM f_preds a JOIN f_annots b ON {CROSS}),
top AS (SELECT *, row_number() OVER (PARTITION BY tile, aid ORDER BY iou DESC, pid) AS n FROM opt),
fit AS (SELECT b.*, t.cx0, t.cy0, t.cx1, t.cy1, CASE WHEN iou >= 6e-1 THEN 'keep' WHEN (least(b.x1,cx1)-greatest(b.x0,cx0))*(least(b.y1,cy1)-greatest(b.y0,cy0))/((b.x1-b.x0)*(b.y1-b.y0)) >= 5e-1 THEN 'cut' ELSE 'box' END AS action
  FROM f_annots b LEFT JOIN (SELECT * FROM top WHERE n = 1) t ON t.tile = b.tile AND t.aid = b.aid)
SELECT tile, aid, action, CASE action WHEN 'keep' THEN cx0 WHEN 'cut' THEN greatest(x0, cx0) ELSE x0 END AS x0, CASE action WHEN 'keep' THEN cy0 WHEN 'cut' THEN greatest(y0, cy0) ELSE y0 END AS y0,
  CASE action WHEN 'keep' THEN cx1 WHEN 'cut' THEN least(x1, cx1) ELSE x1 END AS x1, CASE action WHEN 'keep' THEN cy1 WHEN 'cut' THEN least(y1, cy1) ELSE y1 END AS y1 FROM fit"""


def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ev.parameter_grid(spark, confidence=[0.3, 0.5, 0.7], min_area=[1, 50], max_area=[200, 500, 1000])
    return ev.sweep(load(spark, sf_dir, "f_preds"), runs)


SQL_SWEEP = with_views("f_preds") + """,
g AS (SELECT CAST(row_number() OVER (ORDER BY confidence, min_area, max_area) - 1 AS BIGINT) AS run, * FROM (SELECT unnest([3e-1, 5e-1, 7e-1]) AS confidence), (SELECT unnest([1e0, 5e1]) AS min_area), (SELECT unnest([2e2, 5e2, 1e3]) AS max_area)),
p AS (SELECT conf, (x1-x0)*(y1-y0) AS area FROM f_preds)
SELECT run, confidence, min_area, max_area, count(conf) AS n, coalesce(sum(area), 0e0) AS area FROM g LEFT JOIN p ON conf >= confidence AND area BETWEEN min_area AND max_area GROUP BY ALL"""


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.holdout(load(spark, sf_dir, "f_preds"), "pid", 20).select("pid", "split")


SQL_HOLDOUT = with_views("f_preds") + "\nSELECT pid, CASE WHEN (pid*2654435761) % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM f_preds"

QUERIES = {
    "greedy_match": greedy_match, "pr_f1_grid": pr_f1_grid, "best_threshold": best_threshold, "micro_f1": micro_f1, "macro_f1": macro_f1, "iou_histogram": iou_histogram,
    "match_intersects": match_intersects, "match_best_iou": match_best_iou, "prompt_box_fit": prompt_box_fit, "param_sweep": param_sweep, "holdout_split": holdout_split,
}
ORACLES = {
    "greedy_match": SQL_MATCH, "pr_f1_grid": SQL_GRID, "best_threshold": SQL_BEST, "micro_f1": SQL_MICRO, "macro_f1": SQL_MACRO, "iou_histogram": SQL_HISTOGRAM,
    "match_intersects": SQL_INTERSECTS, "match_best_iou": SQL_BEST_IOU, "prompt_box_fit": SQL_FIT, "param_sweep": SQL_SWEEP, "holdout_split": SQL_HOLDOUT,
}

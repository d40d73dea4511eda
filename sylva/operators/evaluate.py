"""Matching of detections with annotations, and scores over grids of thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sylva.functions.boxes import BOX, best_boxes, edges, take_greedily
from sylva.functions.geometry import box, box_area, box_iou, clipped, crosses, dbl, touches
from sylva.operators.spatial_join import grid_join, grid_semi, in_cells
from sylva.runtime import partitions


def guarded(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(dbl(0))


def scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1; 0 where a denominator is 0."""
    p, r = guarded(tp, tp + fp), guarded(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(dbl(0))}


def candidates(preds: DataFrame, annots: DataFrame, group: str, cell: float) -> DataFrame:
    """(group, pid, aid, iou, conf) of predictions and annotations that cross."""
    pairs = grid_join(preds, annots, cell, (group,), crosses(box("a_"), box("b_")))
    return pairs.select(F.col("a_" + group).alias(group), F.col("a_pid").alias("pid"), F.col("b_aid").alias("aid"), box_iou(box("a_"), box("b_")).alias("iou"), F.col("a_conf").alias("conf"))


def greedy_match(preds: DataFrame, annots: DataFrame, group: str, ious: Sequence[float], confs: Sequence[float] = (0.0,)) -> DataFrame:
    """(group, iou_t, conf_t, pid, aid, iou) for all thresholds: each prediction of conf_t or more, in order, takes the annotation of greatest IoU that is left, if it reaches iou_t.

    Ties go to the smaller aid. Each group is walked once for all thresholds together, and each prediction is held against
    the annotations near it as it comes, so that pairs are never listed. The smallest IoU has to be above 0.
    """
    limits = [(float(i), float(c)) for i, c in product(ious, confs)]

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        number, pid, aid, iou = take_greedily(left["pid"].to_numpy(), edges(left), left["conf"].to_numpy().astype(np.float64), right["aid"].to_numpy(), edges(right), limits) if left.num_rows and right.num_rows else [()] * 4
        least, sure = (np.array([x[k] for x in limits])[np.array(number, np.int64)] for k in (0, 1))
        own = pa.array([left[group][0].as_py()] * len(pid) if len(pid) else [], left.schema.field(group).type)
        return pa.table([own, pa.array(least), pa.array(sure), pa.array(pid, pa.int64()), pa.array(aid, pa.int64()), pa.array(iou, pa.float64())], names=[group, "iou_t", "conf_t", "pid", "aid", "iou"])

    left = whole_boxes(preds, group, "pid").select(group, F.col("pid").cast("long").alias("pid"), *box(), "conf")
    right = whole_boxes(annots, group, "aid").select(group, F.col("aid").cast("long").alias("aid"), *box())
    kind = preds.schema[group].dataType.simpleString()
    # A count of partitions of its own keeps groups apart that adaptive execution would put together for their few bytes.
    left, right = (df.repartition(partitions(preds.sparkSession), group) for df in (left, right))
    return left.groupBy(group).cogroup(right.groupBy(group)).applyInArrow(walk, f"`{group}` {kind}, iou_t double, conf_t double, pid long, aid long, iou double")


def whole_boxes(df: DataFrame, *named: str) -> DataFrame:
    """Rows that can match: those with a box and with these columns."""
    return df.dropna(subset=[*box(), *named])


def threshold_grid(preds: DataFrame, annots: DataFrame, group: str, ious: Sequence[float], confs: Sequence[float]) -> DataFrame:
    """(group, iou_t, conf_t, tp, fp, fn, precision, recall, f1) for all thresholds in one pass.

    Groups without annotations, or without predictions of conf_t or more, have no row for that threshold.
    """
    spark = preds.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(i), float(c)) for i, c in product(ious, confs)], "iou_t double, conf_t double"))
    keys = [group, "iou_t", "conf_t"]
    hit = greedy_match(preds.filter("conf IS NOT NULL"), annots, group, ious, confs).groupBy(*keys).agg(F.count("*").alias("tp"))
    n_pred = preds.join(grid, F.col("conf") >= F.col("conf_t")).groupBy(*keys).agg(F.count("*").alias("n_pred"))
    n_ann = annots.groupBy(group).agg(F.count("*").alias("n_ann"))
    joined = n_pred.join(n_ann, group).join(hit, keys, "left").fillna(0, ["tp"])
    joined = joined.select(*keys, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_ann") - F.col("tp")).alias("fn"))
    return joined.withColumns(scores(F.col("tp"), F.col("fp"), F.col("fn")))


def best_threshold(grid: DataFrame, by: list[str]) -> DataFrame:
    """The confidence with the greatest mean f1; the smallest on ties."""
    mean = grid.groupBy(*by, "conf_t").agg(F.round(F.avg("f1"), 9).alias("f1"))
    return mean.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("conf_t")).alias("c"))).alias("b")).select(*by, (-F.col("b.c")).alias("conf_t"), F.col("b.f1").alias("f1"))


def micro_f1(grid: DataFrame, by: list[str]) -> DataFrame:
    summed = grid.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return summed.withColumns(scores(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f1(grid: DataFrame, by: list[str]) -> DataFrame:
    return grid.groupBy(*by).agg(F.avg("f1").alias("f1"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of values in equal bins of 0 to 1; the last bin is closed."""
    number = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("long")
    return df.filter(F.col(value).between(0.0, 1.0)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))


def match_intersects(preds: DataFrame, annots: DataFrame, group: str, cell: float) -> DataFrame:
    """(group, tp, fp, fn): annotations that any prediction crosses, predictions that cross none, annotations that none crosses."""
    rule = crosses(box("a_"), box("b_"))
    met = lambda left, right, key, name: grid_semi(left, right, cell, (group,), rule).groupBy(group).agg(F.countDistinct(key).alias(name))
    hit = met(annots, preds, "aid", "tp").join(met(preds, annots, "pid", "used"), group)
    n = preds.groupBy(group).agg(F.count("*").alias("n_pred")).join(annots.groupBy(group).agg(F.count("*").alias("n_ann")), group, "full")
    joined = n.join(hit, group, "left").fillna(0)
    return joined.select(group, "tp", (F.col("n_pred") - F.col("used")).alias("fp"), (F.col("n_ann") - F.col("tp")).alias("fn"))


def best_crossing(boxes: DataFrame, others: DataFrame, group: str, cell: float) -> DataFrame:
    """(group, aid, t): for each aid the greatest (iou, -pid, crown) of the others (pid, box) that cross one of its boxes.

    Boxes meet in the grid cells that they touch; in a cell each one looks for its best among those near it, so that pairs
    are never listed. A box that lies in several cells has its best in one of them.
    """
    named = StructType([StructField(group, boxes.schema[group].dataType), StructField("aid", boxes.schema["aid"].dataType), StructField("iou", DoubleType()), StructField("pid", others.schema["pid"].dataType), *[StructField(k, DoubleType()) for k in box()]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rank = np.empty(right.num_rows, np.int64)
        rank[pc.sort_indices(right, sort_keys=[("pid", "ascending"), *[(k, "descending") for k in BOX]]).to_numpy()] = np.arange(right.num_rows)
        row, value = best_boxes(edges(left), edges(right), rank) if left.num_rows and right.num_rows else (np.zeros(0, np.int64), np.zeros(0))
        met = np.flatnonzero(row >= 0)
        own, best = left.take(pa.array(met)), right.take(pa.array(row[met]))
        return pa.table([own[group], own["aid"], pa.array(value[met]), best["pid"], *[best[k] for k in BOX]], names=named.names)

    cells = [group, "_gx", "_gy"]
    listed = lambda df, key: in_cells(df.dropna(subset=[group, *box()]).select(group, key, *[F.col(k).cast("double").alias(k) for k in box()]), cell).repartition(partitions(df.sparkSession), *cells).groupBy(*cells)
    found = listed(boxes, "aid").cogroup(listed(others, "pid")).applyInArrow(run, named)
    return found.groupBy(group, "aid").agg(F.max(F.struct("iou", (-F.col("pid")).alias("k"), F.struct(*box()).alias("crown"))).alias("t"))


def best_iou(preds: DataFrame, annots: DataFrame, group: str, cell: float) -> DataFrame:
    """(group, aid, pid, iou): the best prediction of every annotation; none and 0 where nothing crosses."""
    joined = annots.select(group, "aid").join(best_crossing(annots, preds, group, cell), [group, "aid"], "left")
    return joined.select(group, "aid", (-F.col("t.k")).alias("pid"), F.coalesce("t.iou", dbl(0)).alias("iou"))


def fit_prompt_boxes(boxes: DataFrame, crowns: DataFrame, group: str, keep: float, cut: float, cell: float, drop_rest: bool = False) -> DataFrame:
    """(group, aid, action, x0..y1): for each prompt box its best crown: kept as it is, cut to the box, or replaced by the box.

    keep, cut: least IoU of the crown, whole and cut, with the box. drop_rest: boxes whose cut crown fails go.
    """
    joined = boxes.join(best_crossing(boxes, crowns, group, cell), [group, "aid"], "left")
    own, crown = box(), {k: F.col(f"t.crown.{k}") for k in ("x0", "y0", "x1", "y1")}
    part = clipped(crown, own)
    action = F.when(F.col("t.iou") >= dbl(keep), "keep").when(box_area(part) / box_area(own) >= dbl(cut), "cut").otherwise("box")
    chosen = {k: F.when(F.col("action") == "keep", crown[k]).when(F.col("action") == "cut", part[k]).otherwise(own[k]) for k in own}
    out = joined.withColumn("action", F.coalesce(action, F.lit("box"))).select(group, "aid", "action", *[v.alias(k) for k, v in chosen.items()])
    return out.filter("action <> 'box'") if drop_rest else out


def parameter_grid(spark: SparkSession, **values: list[float]) -> DataFrame:
    """Every combination of the parameters, numbered in order."""
    rows = [(i, *map(float, c)) for i, c in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, "run long, " + ", ".join(f"{k} double" for k in values))


def sweep(preds: DataFrame, grid: DataFrame) -> DataFrame:
    """How many predictions pass the confidence and area limits of each run, in one pass over all runs."""
    area = box_area(box())
    joined = preds.join(F.broadcast(grid), (F.col("conf") >= F.col("confidence")) & (area >= F.col("min_area")) & (area <= F.col("max_area")))
    return grid.join(joined.groupBy("run").agg(F.count("*").alias("n"), F.sum(area).alias("area")), "run", "left").fillna(0, ["n", "area"])


def holdout(df: DataFrame, key: str, percent: int) -> DataFrame:
    """df with split: test for about percent of the rows, the same for a key at every run."""
    return df.withColumn("split", F.when(F.pmod(F.col(key) * 2654435761, F.lit(100)) < percent, "test").otherwise("train"))


def touching(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    return grid_join(left, right, cell, condition=touches(box("a_"), box("b_")))

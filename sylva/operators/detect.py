"""Detectors: from rasters to scored polygons.

A detector is any function from an image's pixels (numpy arrays of rows, columns and values) to a list of
(score, ring). Trained networks plug in here; none is shipped. The default finds local maxima and gives each the hull
of the pixels around it that belong to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.polygons import RING, as_structs, contours, convex_hull
from sylva.operators import raster
from sylva.operators.clean import iou_pairs


@dataclass(frozen=True)
class ModelConfig:
    """What a trained network is set to, and what is done with its results."""

    base: str = "COCO-InstanceSegmentation/mask_rcnn_R_101_FPN_3x.yaml"
    classes: int = 1
    score: float = 0.3
    suppression: float = 0.5
    max_batch_size: int = 10


class Detector(Protocol):
    def __call__(self, image: np.ndarray) -> list[tuple[float, list[tuple[float, float]]]]: ...


def threshold_detector(above: float, min_points: int = 4) -> Detector:
    """Contours of the regions above a limit, scored by the share of the limit's excess."""

    def detect(image: np.ndarray) -> list[tuple[float, list[tuple[float, float]]]]:
        return [(float(np.clip(np.nanmax(image) / (2 * above), 0, 1)), ring) for ring in contours(image > above, min_points)]

    return detect


def detect_patches(patches: DataFrame, detector: Callable, width: int, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """(key, number, score, ring) of all that the detector finds in square patches held as arrays; one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        for batch in batches:
            keys, numbers, found_scores, rings = [], [], [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (score, ring) in enumerate(detector(np.asarray(v, float).reshape(-1, width))):
                    keys.append(k)
                    numbers.append(n)
                    found_scores.append(score)
                    rings.append(as_structs(ring))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(found_scores, pa.float64()), pa.array(rings, kind)], names=[key, "number", "score", "ring"])

    return patches.select(key, values).mapInArrow(run, f"`{key}` {patches.schema[key].dataType.simpleString()}, number int, score double, ring {RING}")


def detect_crowns(pixels: DataFrame, size: int = 7, above: float = 2.5, reach: float = 8.0) -> DataFrame:
    """(image_id, seed_id, score, ring) of each local maximum: the hull of its cell's pixels above the limit.

    The cells are found by joins, so images may be of any size; only one cell's pixels meet in a group.
    """
    seeds = raster.local_maxima(pixels, size, above)
    seeds = seeds.select("image_id", raster.pixel_number(F.col("r"), F.col("c")).alias("seed_id"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    cells = raster.nearest_seed(pixels, seeds, reach).join(pixels.select("image_id", "r", "c", "h"), ["image_id", "r", "c"]).filter(F.col("h") > above)
    return hulls(cells, ["image_id", "seed_id"], "c", "r", "h")


def hulls(points: DataFrame, keys: list[str], x: str, y: str, value: str) -> DataFrame:
    """(keys, score, ring): the convex hull of the points of each group, null for fewer than three; score: largest value over 50, at most 1."""
    grouped = points.groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("points"), F.least(F.max(value) / 50, F.lit(1.0)).cast("double").alias("score"))
    from sylva.functions.polygons import apply_kernel

    return apply_kernel(grouped, "points", convex_hull).drop("points")


def batched(work: DataFrame, key: str, size: int, group: str) -> DataFrame:
    """work with batch: numbers of runs of `size` rows of a group, in order of the key."""
    return work.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1) / size))


def shuffled(work: DataFrame, key: str, seed: int, group: str) -> DataFrame:
    """work with place: a number in each group, in an order that the seed alone decides."""
    mixed = F.pmod((F.col(key) + seed) * 2654435761, F.lit(1 << 32))
    return work.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(mixed, key)))


def suppress_non_maxima(found: DataFrame, config: ModelConfig = ModelConfig(), group: str = "tile", key: str = "pid", cell: float = 64.0) -> DataFrame:
    """What a network's own last step leaves: detections of the least score, without those that overlap a better one that stays.

    Pairs above the limit are found on the grid; one walk a group, in order of score, then key.
    """
    sure = found.filter(F.col("conf") >= config.score)
    pairs = iou_pairs(sure, group, key, config.suppression, cell)
    pairs = pairs.join(sure.select(group, F.col(key).alias("i"), F.col("conf").alias("own")), [group, "i"])

    def walk(table: pa.Table) -> pa.Table:
        i, j, own = (table[c].to_numpy() for c in ("i", "j", "own"))
        near: dict[int, list[int]] = {}
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            near.setdefault(a, []).append(b)
        gone: set[int] = set()
        for a in sorted(near, key=dict(zip(i.tolist(), zip((-own).tolist(), i.tolist(), strict=True), strict=True)).__getitem__):
            if a not in gone:
                gone.update(near[a])
        lost = sorted(gone)
        return pa.table([pa.array([table[group][0].as_py()] * len(lost), table.schema.field(group).type), pa.array(lost, pa.int64())], names=[group, key])

    lost = pairs.select(group, F.col("i").cast("long"), F.col("j").cast("long"), "own").groupBy(group).applyInArrow(walk, f"`{group}` {found.schema[group].dataType.simpleString()}, `{key}` long")
    return sure.join(lost, [group, key], "left_anti")

"""Filters, greedy suppression and containment rules on detections (boxes with a confidence)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from sylva.functions.boxes import edges, held_boxes, near_pairs, suppressed
from sylva.functions.geometry import box, box_area, box_iou, dbl, near_border, overlap_area, ring_area
from sylva.functions.polygons import apply_kernel, simplify
from sylva.operators.spatial_join import cell_of, grid_join, in_cells, renamed
from sylva.runtime import partitions

#: Pairs in one batch of a kernel's result, about.
PAIR_ROWS = 1 << 16


@dataclass(frozen=True)
class CleanConfig:
    """Thresholds of the post-processing; -1 stands for a crown without pixels and passes height and index filters."""

    confidence: float = 0.3
    min_area: float = 1.0
    max_area: float = 1000.0
    iou: float = 0.5
    area_difference: float = 1.0
    containment: float = 0.9
    min_height: float = 3.0
    min_index: float = 0.1
    max_index_variance: float = 0.1
    index_difference: float = 0.05


def confidence_filter(df: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    c = F.col("conf")
    return df.filter(c.isNotNull() & ((c > dbl(threshold)) if strict else (c >= dbl(threshold))))


def area_filter(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.filter(F.col("area").between(dbl(low), dbl(high)))


def simplified_area(df: DataFrame, ring: str = "ring", tolerance: float = 2.0) -> DataFrame:
    """df with area: that of each ring simplified, which all later steps take for its area. Rings of five points or fewer keep theirs."""
    plain = df.withColumn("_long", F.when(F.size(ring) > 5, F.col(ring)))
    return apply_kernel(plain, "_long", lambda r: simplify(r, tolerance) if r else None, "_simple").withColumn("area", ring_area(F.coalesce("_simple", ring))).drop("_long", "_simple")


def sequence_ids(df: DataFrame, group: str, order: str) -> DataFrame:
    """poly_id: the row's number within its group, from 0, as text."""
    return df.withColumn("poly_id", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("string"))


def height_passes(height: Column, low: float) -> Column:
    return ~((height < dbl(low)) & (height > -1))


def index_passes(mean: Column, variance: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else dbl(v) for v in (low, high))
    return ~(((mean < low) | (variance > high)) & (mean > -1))


def border_filter(df: DataFrame, bounds: dict[str, Column], eps: float) -> DataFrame:
    return df.filter(~near_border(box(), bounds, eps))


def owner_strip(tile: float, buffer: float, tiles: int, pixel: float) -> Column:
    """Half the width of the strip along a border that the merged image owns."""
    return dbl((tile + 2 * buffer) * tiles * abs(pixel) / 2)


def overlap_owner_filter(df: DataFrame, bounds: dict[str, Column], strip: Column, merged: Column) -> DataFrame:
    """Crowns of an image that isn't merged itself, but for those that lie wholly in a strip that a merged image owns."""
    b = box()
    owned = (b["x1"] <= bounds["x0"] + strip) | (b["x0"] >= bounds["x1"] - strip) | (b["y1"] <= bounds["y0"] + strip) | (b["y0"] >= bounds["y1"] - strip)
    return df.filter(merged | ~owned)


def iou_pairs(df: DataFrame, group: str, key: str, iou: float | str, cell: float, area_difference: float | None = None) -> DataFrame:
    """Ordered pairs (group, i, j) of different boxes of a group with an IoU above the limit (a number, or a column) and areas that are near."""
    a, b = box("a_"), box("b_")
    rule = (F.col(f"a_{key}") != F.col(f"b_{key}")) & (box_iou(a, b) > (F.col("a_" + iou) if isinstance(iou, str) else dbl(iou)))
    if area_difference is not None:
        rule = rule & (F.abs(box_area(a) - box_area(b)) / F.greatest(box_area(a), box_area(b)) < dbl(area_difference))
    pairs = grid_join(df, df, cell, (group,), rule)
    return pairs.select(F.col(f"a_{group}").alias(group), F.col(f"a_{key}").alias("i"), F.col(f"b_{key}").alias("j"), F.col("b_conf").alias("conf"))


def greedy_suppress(df: DataFrame, group: str = "tile", key: str = "pid", iou: float | str = 0.5, area_difference: float = 1.0, cell: float = 64.0) -> DataFrame:
    """Rows that survive a fold in key order: a row that isn't removed yet keeps the most confident of its group.

    A row's group is itself and all rows that overlap it, those that were removed before included; the best is the
    first of the most confident. So a group can vanish when its best was removed earlier. The fold walks once over the
    rows of a group; a row that is still there is held against the boxes near it, so that pairs are never listed.
    """
    kind = df.schema[group].dataType.simpleString()
    limit = F.col(iou) if isinstance(iou, str) else dbl(iou)

    def walk(table: pa.Table) -> pa.Table:
        conf, limits = (table[c].to_numpy().astype(np.float64) for c in ("conf", "limit"))
        removed = suppressed(table[key].to_numpy(), edges(table), conf, limits, area_difference)
        return pa.table([pa.array([table[group][0].as_py()] * len(removed), table.schema.field(group).type), pa.array(removed, pa.int64())], names=[group, key])

    rows = df.dropna(subset=[*box(), group, key]).select(group, F.col(key).cast("long").alias(key), *box(), F.col("conf").cast("double").alias("conf"), limit.cast("double").alias("limit"))
    gone = rows.repartition(partitions(df.sparkSession), group).groupBy(group).applyInArrow(walk, f"`{group}` {kind}, `{key}` long")
    return df.join(gone, [group, key], "left_anti")


def close_pairs(df: DataFrame, group: str, key: str, iou: float, cell: float, strip: float) -> DataFrame:
    """(i, j, iou) of boxes of a group, i before j, with an IoU of at least `iou`, which is above 0.

    Boxes are listed in the cells that they touch; a kernel holds those of a cell against each other, so that they are
    shuffled once and only pairs of the result leave it. A pair counts in the cell of its reference point. strip: about
    twice the median side of the boxes; the cells hold many of them.
    """
    named = StructType([StructField("i", df.schema[key].dataType), StructField("j", df.schema[key].dataType), StructField("iou", DoubleType())])
    kinds = to_arrow_schema(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        x, y = (cell * table[c][0].as_py() for c in ("_gx", "_gy"))
        held, size = [], 0
        for found in near_pairs(table[key].to_numpy(), edges(table), iou, (x, y, x + cell, y + cell), strip):
            held.append(found)
            size += len(found[0])
            if size >= PAIR_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    cells = [group, "_gx", "_gy"]
    listed = in_cells(df.dropna(subset=[*box(), group, key]).select(group, key, *[F.col(k).cast("double").alias(k) for k in box()]), cell)
    return listed.groupBy(*cells).applyInArrow(run, named)


def containment_pairs(df: DataFrame, group: str, key: str, threshold: float, cell: float) -> DataFrame:
    """(group, outer, inner): the common area is at least `threshold` of the inner box."""
    if threshold <= 0.51:
        a, b = box("a_"), box("b_")
        rule = (F.col(f"a_{key}") != F.col(f"b_{key}")) & (box_area(b) > 0) & (overlap_area(a, b) / F.when(box_area(b) > 0, box_area(b)).otherwise(dbl(1)) >= dbl(threshold))
        return grid_join(df, df, cell, (group,), rule).select(F.col(f"a_{group}").alias(group), F.col(f"a_{key}").alias("outer"), F.col(f"b_{key}").alias("inner"))
    # An outer box that holds more than half of an inner one holds its middle: inner boxes stand in the one cell of it.
    named = StructType([StructField(n, df.schema[c].dataType) for n, c in ((group, group), ("outer", key), ("inner", key))])
    none = to_arrow_schema(named).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        outer, inner = held_boxes(edges(left), edges(right, "b_"), threshold) if left.num_rows and right.num_rows else (np.zeros(0, np.int64),) * 2
        if not len(outer):
            return none
        i, j = left[key].take(pa.array(outer)), right["b_" + key].take(pa.array(inner))
        other = pc.not_equal(i, j)
        i, j = i.filter(other), j.filter(other)
        return pa.table([pa.repeat(left[group][0], len(i)), i, j], names=none.column_names)

    whole = df.dropna(subset=[*box(), group, key]).select(group, key, *[v.cast("double").alias(k) for k, v in box().items()])
    inner = renamed(whole, "b_")  # columns of its own: Spark takes equal ones on both sides for one
    b = box("b_")
    placed = inner.withColumn("gx", cell_of((b["x0"] + b["x1"]) / 2, cell)).withColumn("gy", cell_of((b["y0"] + b["y1"]) / 2, cell))
    dealt = lambda rows, *by: rows.repartition(partitions(df.sparkSession), *by).groupBy(*by)
    return dealt(in_cells(whole, cell), group, "_gx", "_gy").cogroup(dealt(placed, "b_" + group, "gx", "gy")).applyInArrow(run, named)


def containment_counts(df: DataFrame, group: str = "tile", key: str = "pid", threshold: float = 0.9, cell: float = 64.0) -> DataFrame:
    """df with num_contained (how many it contains), is_contained, and containment_ratio (itself counts, so 1 at least)."""
    a, b = box("a_"), box("b_")
    share = F.when(box_area(b) > 0, overlap_area(a, b) / box_area(b)).otherwise(dbl(0))
    pairs = grid_join(df, df, cell, (group,)).select(F.col(f"a_{group}").alias(group), F.col(f"a_{key}").alias("outer"), F.col(f"b_{key}").alias("inner"), share.alias("share"))
    held = (F.col("outer") != F.col("inner")) & (F.col("share") >= dbl(threshold))
    # One join: each pair counts for both of its rows, with a partial aggregate before the shuffle.
    sides = F.explode(F.array(F.struct(F.col("outer").alias("k"), held.cast("int").alias("n"), F.lit(False).alias("is"), dbl(0).alias("r")), F.struct(F.col("inner").alias("k"), F.lit(0).alias("n"), held.alias("is"), F.col("share").alias("r")))).alias("s")
    counted = pairs.select(group, sides).groupBy(group, F.col("s.k").alias(key)).agg(F.sum("s.n").alias("num_contained"), F.max("s.is").alias("is_contained"), F.max("s.r").alias("containment_ratio"))
    joined = df.join(counted, [group, key], "left")
    return joined.withColumns({
        "num_contained": F.coalesce("num_contained", F.lit(0).cast("long")),
        "is_contained": F.coalesce("is_contained", F.lit(False)),
        "containment_ratio": F.coalesce("containment_ratio", dbl(1)),
    })


def containment_rules(counted: DataFrame, selected: Column, group: str = "tile", key: str = "pid", index_difference: float = 0.05) -> DataFrame:
    """(group, key) of the rows to keep, one for each time that a rule names it.

    counted: containment_counts() of all survivors with index_mean and index_var; selected: which of them the rules
    run over. A row that contains two or more goes. One that contains one is compared with the first contained row of
    its whole group: with index means far apart the one of smaller variance is kept (which may name the other row
    again), else the row itself. One that contains none is kept.
    """
    facts = lambda x: F.struct(F.col(key).alias("k"), F.col("index_mean").alias("mean"), F.col("index_var").alias("var"))  # noqa: E731,ARG005
    first = counted.filter("is_contained").groupBy(group).agg(F.min(facts(0)).alias("other"))
    rows = counted.filter(selected & (F.col("num_contained") < 2)).join(first, group, "left")
    far = F.abs(F.col("index_mean") - F.col("other.mean")) > dbl(index_difference)
    mine = F.when(F.col("num_contained") == 0, F.col(key)).when(far, F.when(F.col("index_var") < F.col("other.var"), F.col(key)).otherwise(F.col("other.k"))).when(box_area(box()) > 0, F.col(key))
    return rows.select(group, mine.alias(key)).filter(F.col(key).isNotNull())


def best_of_overlapping(df: DataFrame, group: str, key: str, iou: float, cell: float) -> DataFrame:
    """Rows that are the most confident (first by key) of all rows that overlap them above the limit; lone rows stay."""
    pairs = iou_pairs(df, group, key, iou, cell)
    top = pairs.groupBy(group, F.col("i").alias(key)).agg(F.max(F.struct("conf", (-F.col("j")).alias("k"))).alias("top"))
    joined = df.join(top, [group, key], "left")
    return joined.filter(F.col("top").isNull() | (F.struct("conf", (-F.col(key)).alias("k")) > F.col("top"))).drop("top")

import random

import numpy as np
from pyspark.sql import functions as F

from sylva.functions import overlay as ov
from sylva.functions.geometry import dbl
from sylva.operators import images, tiling
from sylva.runtime import ship


def inside(shape, x, y):
    """Even-odd rule for a grid of points."""
    out = np.zeros(x.shape, bool)
    for ring in shape:
        for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            if y0 != y1:
                out ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return out


def star(r, n):
    angles = np.sort(np.array([r.uniform(0, 6.283) for _ in range(n)]))
    size = np.array([r.uniform(0.5, 4) for _ in range(n)])
    x, y = r.uniform(4.1, 7.9), r.uniform(4.1, 7.9)
    return np.stack((x + size * np.cos(angles), y + size * np.sin(angles)), axis=1)


def test_covered_area_against_a_raster():
    r = random.Random(1)
    x, y = np.meshgrid((np.arange(600) + 0.5) / 50, (np.arange(600) + 0.5) / 50)
    for _ in range(25):
        subject = [star(r, r.randrange(3, 9)) for _ in range(r.randrange(1, 3))]  # overlapping rings: holes by the even-odd rule
        covers = [[star(r, r.randrange(3, 9))] for _ in range(r.randrange(1, 4))]
        held = inside(subject, x, y)
        any_ = np.any([inside(c, x, y) for c in covers], axis=0)
        assert abs(ov.covered_area(subject, covers) - (held & any_).sum() / 2500) < 0.25
        assert abs(ov.shape_area(subject) - held.sum() / 2500) < 0.25


def test_union_of_boxes(spark):
    r = random.Random(2)
    rows = []
    for n in range(60):
        boxes = [(a, b, a + r.randrange(0, 6), b + r.randrange(0, 6)) for a, b in ((r.randrange(-3, 12), r.randrange(-3, 12)) for _ in range(r.randrange(0, 6)))]
        rows.append((n, [tuple(map(float, b)) for b in boxes]))
    df = spark.createDataFrame(rows, "n int, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = {x["n"]: x["a"] for x in df.select("n", ov.union_area(F.col("boxes"), {"x0": dbl(1), "y0": dbl(2), "x1": dbl(9), "y1": dbl(8)}).alias("a")).collect()}
    for n, boxes in rows:
        assert got[n] == sum(any(b[0] <= i < b[2] and b[1] <= j < b[3] for b in boxes) for i in range(1, 9) for j in range(2, 8))


RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_polygons_with_holes_and_gaps(spark):
    """A crown over two abutting outlines goes, one in the hole of an outline stays, one that only an outline's box meets stays."""
    ship(spark)
    square = lambda a, b, n: ring((a, b), (a + n, b), (a + n, b + n), (a, b + n), (a, b))
    outlines = [([square(0, 0, 10)], 0, 0, 10, 10), ([square(10, 0, 10), square(13, 3, 4)], 10, 0, 20, 10), ([ring((30, 0), (40, 0), (30, 10), (30, 0))], 30, 0, 40, 10)]
    crowns = [(1, [square(9, 4, 2)]), (2, [square(14, 4, 2)]), (3, [square(37, 7, 2)]), (4, [square(31, 1, 2)]), (5, [square(100, 100, 2)])]
    rows = [(k, s, *(f(p[c] for p in s[0]) for f, c in ((min, "x"), (min, "y"), (max, "x"), (max, "y")))) for k, s in crowns]
    out = spark.createDataFrame([(s, *map(float, b)) for s, *b in outlines], f"rings {RINGS}, x0 double, y0 double, x1 double, y1 double")
    df = spark.createDataFrame(rows, f"crown_id int, rings {RINGS}, x0 double, y0 double, x1 double, y1 double")
    assert {r["crown_id"] for r in images.exclude_within(df, out, "crown_id", 8.0).collect()} == {2, 3, 5}
    fused = images.fuse(df, df, out, "crown_id", 8.0).collect()
    assert {r["crown_id"] for r in fused if r["model"] == "forest"} == {1, 4}
    tiles = spark.createDataFrame([("a", -1.0, -1.0, 5.0, 5.0), ("b", 1.0, 1.0, 12.0, 9.0), ("c", 36.0, 6.0, 40.0, 10.0)], "tile_id string, x0 double, y0 double, x1 double, y1 double")
    flags = {r["tile_id"]: (r["only_forest"], r["only_urban"]) for r in tiling.coverage_flags(tiles, out, 0.5, 8.0).collect()}
    assert flags == {"a": (False, False), "b": (True, False), "c": (False, True)}


def test_polygon_iou_of_convex_and_other_rings():
    from sylva.functions.polygons import polygon_iou

    r = random.Random(3)
    x, y = np.meshgrid((np.arange(480) + 0.5) / 40, (np.arange(480) + 0.5) / 40)
    for k in range(40):
        rings = []
        for _ in range(2):
            points = star(r, r.randrange(3, 8))
            if k % 2:
                from sylva.functions.polygons import convex_hull

                hull = convex_hull([tuple(p) for p in points])[:-1]
                points = np.array(hull if k % 4 == 1 else hull[::-1])
            rings.append([tuple(map(float, p)) for p in points])
        a, b = (inside([np.array(p)], x, y) for p in rings)
        got = polygon_iou(*[p + p[:1] for p in rings])
        if k % 2:
            assert abs(got - (a & b).sum() / max((a | b).sum(), 1)) < 0.02
        else:  # rings may cross themselves nowhere, as their angles are in order
            assert abs(got - (a & b).sum() / max((a | b).sum(), 1)) < 0.06
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    assert polygon_iou(square, square) == 1.0 and polygon_iou(square, [(x + 9, y) for x, y in square]) == 0.0

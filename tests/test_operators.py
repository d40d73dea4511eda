"""Literal cases for behaviour that differs from what one might expect, and properties."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sylva.functions import geometry as g
from sylva.functions import polygons as p
from sylva.functions.geometry import box, dbl
from sylva.operators import clean, detect, evaluate, images, manifest, raster
from sylva.operators.spatial_join import grid_join

PRED = "tile long, pid long, x0 double, y0 double, x1 double, y1 double, conf double"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_a_removed_box_still_removes_others(spark):
    rows = [(0, 0, 0.0, 0.0, 10.0, 1.0, 0.9), (0, 1, 4.0, 0.0, 14.0, 1.0, 0.8), (0, 2, 8.0, 0.0, 18.0, 1.0, 0.7)]
    kept = clean.greedy_suppress(spark.createDataFrame(rows, PRED), iou=0.4, cell=8.0)
    assert {r["pid"] for r in kept.collect()} <= {0, 2}


def fold(rows, iou, difference):
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])

    def ratio(a, b):
        both = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return both / (area(a) + area(b) - both)

    gone = set()
    for r in rows:
        if r[1] in gone:
            continue
        group = [q for q in rows if q is r or (ratio(r, q) > iou and abs(area(r) - area(q)) / max(area(r), area(q)) < difference)]
        best = max(group, key=lambda q: (q[6], -q[1]))
        gone |= {q[1] for q in group if q is not best}
    return {r[1] for r in rows} - gone


@pytest.mark.parametrize("seed", [1, 2])
def test_suppression_is_the_plain_loop(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(80):
        x, y = r.randrange(30), r.randrange(30)
        rows.append((0, i, float(x), float(y), float(x + r.randrange(3, 12)), float(y + r.randrange(3, 12)), r.randrange(8) / 8))
    for difference in (1.0, 0.4):
        kept = clean.greedy_suppress(spark.createDataFrame(rows, PRED), iou=0.3, area_difference=difference, cell=6.0)
        assert {x["pid"] for x in kept.collect()} == fold(rows, 0.3, difference)


def test_grid_join_is_the_nested_loop(spark):
    r = random.Random(3)
    boxes = [(i, x := r.uniform(-50, 50), y := r.uniform(-50, 50), x + r.uniform(0, 40), y + r.uniform(0, 40)) for i in range(70)] + [(99, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")
    for cell in (3.0, 20.0, 500.0):
        got = sorted((x["a_id"], x["b_id"]) for x in grid_join(df, df, cell).collect())
        want = sorted((a[0], b[0]) for a in boxes[:-1] for b in boxes[:-1] if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
        assert got == want


def test_containment(spark):
    rows = [(0, 0, 0.0, 0.0, 20.0, 20.0, 0.9), (0, 1, 1.0, 1.0, 5.0, 5.0, 0.8), (0, 2, 8.0, 8.0, 12.0, 12.0, 0.7), (0, 3, 100.0, 100.0, 104.0, 104.0, 0.5)]
    out = clean.containment_counts(spark.createDataFrame(rows, PRED)).withColumns({"index_mean": dbl(0.5), "index_var": dbl(0.1)})
    facts = {r["pid"]: (r["num_contained"], r["is_contained"], r["containment_ratio"]) for r in out.collect()}
    assert facts == {0: (2, False, 1.0), 1: (0, True, 1.0), 2: (0, True, 1.0), 3: (0, False, 1.0)}
    assert {r["pid"] for r in clean.containment_rules(out, F.lit(True)).collect()} == {1, 2, 3}  # what contains two goes


def test_no_pixels_pass(spark):
    r = one(spark, clean.height_passes(dbl(-1), 3.0), clean.height_passes(dbl(2), 3.0), clean.index_passes(dbl(-1), dbl(9), 0.1, 0.1), clean.index_passes(dbl(0.05), dbl(0), 0.1, 0.1))
    assert list(r) == [True, False, True, False]


def test_rounding_and_truncation(spark):
    t = {"a": dbl(1), "b": dbl(0), "c": dbl(0), "d": dbl(0), "e": dbl(1), "f": dbl(0)}
    cut, low = g.geo_to_pixel(t, dbl(-0.3), dbl(0))[1], g.geo_to_pixel(t, dbl(-0.3), dbl(0), floor=True)[1]
    assert list(one(spark, g.round_to(dbl(0.0005), 3), g.round_to(dbl(2.5), 0), cut, low)) == [0.0, 2.0, 0, -1]
    with pytest.raises(PySparkException):
        one(spark, g.geo_to_pixel(t | {"a": dbl(0)}, dbl(1), dbl(1))[1])


def test_names(spark):
    fields = g.tile_fields(F.lit("FDOP20_1_2_rgbi_500_600_50_20_25832"))
    key = g.regex_identifier(F.lit("FDOP20_100_200_rgbi.tif"), r"FDOP20_(\d+)_(\d+)_rgbi", 2)
    assert list(one(spark, *fields.values(), key, g.regex_identifier(F.lit("other"), r"(\d+)", 1), g.stem(F.lit("/a/b.c/x_1.tif")))) == [500, 600, 50, 20, 25832, "100200", None, "x_1"]


def test_vertex_mean_counts_the_closing_vertex(spark):
    b = {k: dbl(v) for k, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 1, 1))}
    m = one(spark, g.vertex_mean(g.box_ring(b)).alias("m"))["m"]
    assert (m["x"], m["y"]) == (0.4, 0.4)


def test_polygon_area_with_a_hole(spark):
    big = {k: dbl(v) for k, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 10, 10))}
    hole = {k: dbl(v) for k, v in zip(("x0", "y0", "x1", "y1"), (2, 2, 4, 5))}
    assert one(spark, g.polygon_area(F.array(g.box_ring(big), g.box_ring(hole))))[0] == 94.0


def test_scores_of_nothing(spark):
    assert list(one(spark, *evaluate.scores(F.lit(0), F.lit(0), F.lit(0)).values())) == [0.0, 0.0, 0.0]


def test_local_maxima_against_a_scan(spark):
    r = np.random.default_rng(1)
    h = r.integers(0, 30, (20, 25)).astype(float)
    df = spark.createDataFrame([(0, i, j, float(h[i, j])) for i in range(20) for j in range(25)], "image_id long, r long, c long, h double")
    got = {(x["r"], x["c"]) for x in raster.local_maxima(df, 5, 3.0).collect()}
    want = {(i, j) for i in range(20) for j in range(25) if h[i, j] > 3 and h[i, j] == h[max(0, i - 2) : i + 3, max(0, j - 2) : j + 3].max()}
    assert got == want


def test_adjacency_within_the_tolerance(spark):
    rows = [(0, "a.tif", 0.0, 0.0, 1.0, -1.0, 10, 10), (1, "b.tif", 10.0005, 0.0, 1.0, -1.0, 10, 10), (2, "c.tif", 0.0, -10.01, 1.0, -1.0, 10, 10)]
    df = spark.createDataFrame(rows, "image_id long, file_name string, c double, f double, a double, e double, width int, height int")
    assert {(x["image_id"], x["side"], x["neighbour"]) for x in images.adjacency(df).collect()} == {(0, "right", 1), (1, "left", 0)}


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "done")
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    assert manifest.resume(work, path, "file", "p1").count() == 3
    manifest.record(spark.createDataFrame([("a", True), ("b", False)], "file string, ok boolean"), path, "file", "p1")
    assert {r["file"] for r in manifest.resume(work, path, "file", "p1").collect()} == {"b", "c"}
    assert manifest.resume(work, path, "file", "p2").count() == 3
    tiles = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "image string, tile long")
    assert [tuple(r) for r in manifest.incomplete(tiles, tiles.filter("tile <> 2"), "image", "tile").collect()] == [("x", 2, 1)]
    good, bad = manifest.split_failures(spark.createDataFrame([(1, None), (2, "broken")], "id long, error string"))
    assert (good.count(), bad.count()) == (1, 1)
    assert manifest.progress(tiles, tiles.filter("tile = 1"), "image").filter("image = 'x'").first()["percent"] == 50.0


BOXES = st.tuples(st.integers(-20, 20), st.integers(-20, 20), st.integers(1, 20), st.integers(1, 20))


def ring(b):
    x, y, w, h = b
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


@settings(max_examples=80, deadline=None)
@given(BOXES, BOXES)
def test_polygon_iou_of_boxes(a, b):
    both = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    want = both / (a[2] * a[3] + b[2] * b[3] - both)
    assert abs(p.polygon_iou(ring(a), ring(b)) - want) < 1e-9
    assert abs(p.polygon_iou(ring(b), ring(a)) - want) < 1e-9


def test_polygon_iou_of_a_bent_polygon():
    bent = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]
    assert p.polygon_iou(bent + bent[:1] * (bent[0] != bent[-1]), ring((2, 2, 2, 2))) < 1e-9 and abs(p.polygon_iou(bent + bent[:1] * (bent[0] != bent[-1]), ring((0, 0, 4, 4))) - 7 / 16) < 1e-9


def test_contours_of_a_mask_with_a_hole():
    mask = np.zeros((9, 10), bool)
    mask[1:8, 1:8] = True
    mask[4, 4] = False
    mask[0, 9] = True
    found = p.contours(mask)
    assert len(found) == 2 and p.area(found[0][:-1]) == 36.0 and p.area(found[1][:-1]) == 2.0
    assert p.contours(np.zeros((3, 3), bool)) == []
    assert np.array_equal(p.decode_rle([1, 2, 3], 2, 3), np.array([[0, 1, 0], [1, 0, 0]], bool))


def test_simplify_and_hull():
    line = [(0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert p.simplify(line, 0.2) == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert p.convex_hull([(0, 0), (1, 1)]) is None and p.convex_hull([(0, 0), (1, 1), (2, 2)]) is None
    assert len(p.convex_hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)])) == 5


def test_threshold_detector():
    image = np.zeros((8, 8))
    image[2:6, 2:6] = 5
    [(score, found)] = detect.threshold_detector(2.5)(image)
    assert score == 1.0 and p.area(found[:-1]) == 9.0


def test_box_helpers(spark):
    df = spark.createDataFrame([(0.0, 0.0, 4.0, 4.0, 2.0, 2.0, 6.0, 6.0)], ", ".join(f"{q}{k} double" for q in "ab" for k in ("x0", "y0", "x1", "y1")))
    a, b = box("a"), box("b")
    r = df.select(g.overlap_area(a, b), g.box_iou(a, b), g.touches(a, b), g.inside(a, b), g.near_box(a, a), g.near_border(a, b, 2.0)).first()
    assert list(r) == [4.0, 4 / 28, True, False, True, True]


def test_outlines_parts_and_reference_systems(spark):
    t = {"a": dbl(2), "b": dbl(0), "c": dbl(10), "d": dbl(0), "e": dbl(-2), "f": dbl(20)}
    ring = g.raster_outline(t, F.lit(3), F.lit(4))
    assert one(spark, g.ring_area(ring), F.size(g.first_part(F.array(ring, ring))), g.same_crs(F.lit(25832), F.lit(25832)))[:3] == (48.0, 5, 25832)
    with pytest.raises(PySparkException):
        one(spark, g.same_crs(F.lit(1), F.lit(2)))

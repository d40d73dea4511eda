import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.functions import geometry as g
from sylva.functions.overlay import shape_area
from sylva.functions.repair import union_parts, valid_parts, voronoi_cells
from sylva.runtime import ship
from sylva.sources import geotiff, rasters, shapes, vector


@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "f4", "f8"])
@pytest.mark.parametrize("compress", [True, False])
def test_geotiff_round_trip(kind, compress):
    image = (np.arange(2 * 70 * 33) % 251).reshape(2, 70, 33).astype(kind)
    data = geotiff.encode(image, (0.2, 100.0, -0.2, 900.0), 25832, compress, 16)
    head = geotiff.header(data)
    assert (head["width"], head["height"], head["bands"], head["crs"]) == (33, 70, 2, 25832) and (head["a"], head["c"], head["e"], head["f"]) == (0.2, 100.0, -0.2, 900.0)
    assert (geotiff.decode(data) == image).all() and (geotiff.decode(data, (20, 41)) == image[:, 20:41]).all()


def test_big_endian_tiles_of_separate_bands_with_differences():
    image = np.random.default_rng(1).integers(0, 60000, (2, 20, 25)).astype(np.uint16)
    blocks = []
    for band in np.pad(image, ((0, 0), (0, 12), (0, 7))):
        for top, left in ((0, 0), (0, 16), (16, 0), (16, 16)):
            tile = band[top : top + 16, left : left + 16]
            blocks.append(zlib.compress(np.diff(tile, axis=1, prepend=np.zeros((16, 1), np.uint16)).astype(">u2").tobytes()))
    entries = [(256, 3, (25,)), (257, 3, (20,)), (258, 3, (16, 16)), (259, 3, (8,)), (277, 3, (2,)), (284, 3, (2,)), (317, 3, (2,)), (322, 3, (16,)), (323, 3, (16,)), (324, 4, tuple(range(8))), (325, 4, tuple(map(len, blocks))), (339, 3, (1, 1))]
    at = 8 + 2 + 12 * len(entries) + 4
    body, extra = b"", b""
    first = at + 64
    for tag, t, values in entries:
        values = tuple(first + sum(map(len, blocks[:k])) for k in range(8)) if tag == 324 else values
        raw = struct.pack(">" + {3: "H", 4: "I"}[t] * len(values), *values)
        body += struct.pack(">HHI", tag, t, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", at + len(extra)))
        extra += raw if len(raw) > 4 else b""
    data = b"MM" + struct.pack(">HIH", 42, 8, len(entries)) + body + b"\0" * 4 + extra.ljust(64, b"\0") + b"".join(blocks)
    assert (geotiff.decode(data) == image).all() and (geotiff.decode(data, (3, 18)) == image[:, 3:18]).all()
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.decode(b"nothing")


def test_files_that_fail_are_rows(spark, tmp_path):
    ship(spark)
    (tmp_path / "good.tif").write_bytes(geotiff.encode(np.ones((1, 2, 3)), (1.0, 0.0, -1.0, 0.0), 4326))
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    rows = rasters.read_rasters(spark, str(tmp_path), "*.tif", ["h"], rasters.tiff_decoder, errors=True).collect()
    assert sum(r["error"] is None for r in rows) == 6 and [r["file_name"] for r in rows if r["error"]] == ["bad.tif"]
    heads = {r["file_name"]: r for r in rasters.read_headers(rasters.files_of(spark, str(tmp_path), "*.tif")).collect()}
    assert heads["good.tif"]["width"] == 3 and heads["good.tif"]["crs"] == 4326 and "not a TIFF" in heads["bad.tif"]["error"]


SQUARE, HOLE = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0), (0.0, 0.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]
FAR = [[(20.0, 0.0), (20.0, 1.0), (21.0, 1.0), (20.0, 0.0)]]


def test_geopackage_and_shapefile(spark, tmp_path):
    ship(spark)
    parts = [[SQUARE, HOLE], FAR]
    (tmp_path / "a.gpkg").write_bytes(shapes.write_gpkg([({"name": "x", "n": 3}, parts), ({"name": None, "n": 4}, [FAR])], 25832))
    points = SQUARE + HOLE + FAR[0]
    body = struct.pack("<I4dII3I", 5, 0, 0, 21, 9, 3, len(points), 0, 5, 10) + b"".join(struct.pack("<dd", *p) for p in points)
    (tmp_path / "b.shp").write_bytes(b"\0" * 100 + struct.pack(">II", 1, len(body) // 2) + body)
    (tmp_path / "c.gpkg").write_bytes(b"nothing")
    rows = shapes.read_layers(spark, str(tmp_path)).withColumn("area", g.polygon_area(F.col("rings"))).collect()
    good = sorted((r["file"], r["feature"], r["part"], r["area"]) for r in rows if r["error"] is None)
    assert good == [("a.gpkg", 0, 0, 77.0), ("a.gpkg", 0, 1, 0.5), ("a.gpkg", 1, 0, 0.5), ("b.shp", 0, 0, 77.0), ("b.shp", 0, 1, 0.5)]
    assert {r["crs"] for r in rows if r["file"] == "a.gpkg"} == {25832} and [r["properties"] for r in rows if r["feature"] == 1] == [{"fid": "2", "n": "4"}]
    assert [r["file"] for r in rows if r["error"]] == ["c.gpkg"]


def test_wkb_of_both_orders_and_dimensions():
    assert shapes.parse_wkb(shapes.to_wkb([[SQUARE, HOLE]])) == [[SQUARE, HOLE]] and shapes.parse_wkb(shapes.to_wkb([[SQUARE], FAR])) == [[SQUARE], FAR]
    ring = [(*p, 7.0) for p in SQUARE]
    for code in (1003, 0x80000003):
        assert shapes.parse_wkb(struct.pack(">BIII", 0, code, 1, 5) + b"".join(struct.pack(">ddd", *p) for p in ring)) == [[SQUARE]]
    assert shapes.parse_wkb(struct.pack("<BIdd", 1, 1, 1.0, 2.0)) == [] and shapes.parse_wkb(b"") == []


def test_geojson_parts_and_holes(spark, tmp_path):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"5"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[9,0],[9,9],[0,9],[0,0]],[[2,2],[4,2],[4,4],[2,4],[2,2]]],[[[20,0],[21,0],[21,1],[20,0]]]]}},{"type":"Feature","properties":{"n":"x"},"geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","properties":null,"geometry":null}]}'
    (tmp_path / "l.geojson").write_text(text)
    rows = vector.read_geojson(spark, str(tmp_path), ["n"]).withColumn("area", g.polygon_area(F.col("rings"))).collect()
    assert sorted((r["part"], r["area"], r["n"]) for r in rows) == [(0, 77.0, 5.0), (1, 0.5, 5.0)]


def test_repair_and_union():
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    parts = valid_parts(bow)
    assert len(parts) == 2 and sum(shape_area([np.array(p)]) for p in parts) == 8.0
    assert valid_parts([(0.0, 0.0), (1.0, 0.0), (1.0, 0.0)]) == [] and len(valid_parts(SQUARE + SQUARE[-1:])) == 1
    r = random.Random(1)
    boxes = [(a, b, a + r.randrange(1, 5), b + r.randrange(1, 5)) for a, b in ((r.randrange(9), r.randrange(9)) for _ in range(12))]
    whole = union_parts([[np.array([(a, b), (c, b), (c, d), (a, d)], float)] for a, b, c, d in boxes])
    cells = sum(any(a <= i < c and b <= j < d for a, b, c, d in boxes) for i in range(15) for j in range(15))
    assert abs(sum(shape_area([np.array(p)]) for p in whole) - cells) < 1e-9


def test_voronoi_cells_against_nearest_seeds():
    r = np.random.default_rng(3)
    seeds = r.uniform(0, 10, (40, 2))
    cells = voronoi_cells(seeds, (0.0, 0.0, 10.0, 10.0))
    x, y = np.meshgrid((np.arange(200) + 0.5) / 20, (np.arange(200) + 0.5) / 20)
    nearest = ((x[..., None] - seeds[:, 0]) ** 2 + (y[..., None] - seeds[:, 1]) ** 2).argmin(axis=2)
    assert 3 <= sum(c is None for c in cells) < 20
    for k, c in enumerate(cells):
        if c is not None:
            assert abs(shape_area([np.array(c)]) - (nearest == k).sum() / 400) < 0.15
    assert voronoi_cells(seeds[:2], (0.0, 0.0, 1.0, 1.0)) == [None, None]

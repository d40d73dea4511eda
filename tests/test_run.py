import json

import numpy as np
from pyspark.sql import functions as F

from sylva import run
from sylva.functions.polygons import contours
from sylva.sources import config, geotiff, vector


def bright(image):
    """A detector: contours of the bright regions of the first band."""
    return [(0.9, [(x, y) for x, y in ring]) for ring in contours(image[0] > 100)]


def broken(image):
    if image[0].max() > 240:
        raise ValueError("too bright")
    return bright(image)


def scene(folder, blobs, name, nir=200):
    image = np.full((2, 100, 100), 10, np.uint8)
    image[1] = nir
    height = np.zeros((1, 100, 100), np.float32)
    for r, c, n in blobs:
        image[0, r : r + n, c : c + n] = 120
        height[0, r + n // 2, c + n // 2] = 7.5
    (folder / "rgb" / f"{name}.tif").write_bytes(geotiff.encode(image, (1.0, 1000.0, -1.0, 2000.0), 25832))
    (folder / "ndsm" / f"{name}.tif").write_bytes(geotiff.encode(height, (1.0, 1000.0, -1.0, 2000.0), 25832))


def settings(folder, **more):
    return config.RunConfig(str(folder / "rgb"), str(folder / "ndsm"), output_directory=str(folder / "out"), tile_width=50, tile_height=50, buffer=20, ndvi_mean_threshold=-1.0, ndvi_var_threshold=9.0, **more)


def test_a_run_from_files_to_crowns(spark, tmp_path):
    for d in ("rgb", "ndsm"):
        (tmp_path / d).mkdir()
    scene(tmp_path, [(20, 20, 9), (45, 45, 11), (70, 20, 8)], "1")
    scene(tmp_path, [(30, 60, 9)], "2")
    (tmp_path / "rgb" / "3.tif").write_bytes(b"nothing")
    one = settings(tmp_path, combined_model="bright", timestamped_output_directory=True)
    crowns, failed = run.process_files(spark, one, {"bright": bright})
    rows = crowns.collect()
    got = sorted((r["file_name"], r["Area"], r["TreeHeight"]) for r in rows)
    assert got == [("1.tif", 49.0, 7.5), ("1.tif", 64.0, 7.5), ("1.tif", 100.0, 7.5), ("2.tif", 64.0, 7.5)]
    centres = {tuple(json.loads(r["Centroid"]).values()) for r in rows if r["file_name"] == "2.tif"}
    assert len(centres) == 1 and [r["file_name"] for r in failed.collect()] == ["3.tif"]
    back = vector.read_geojson(spark, f"{tmp_path}/out/geojson_predictions", ["Area"])
    assert back.count() == 4 and {r["Area"] for r in back.collect()} == {49.0, 64.0, 100.0}
    assert spark.read.parquet(f"{tmp_path}/out/final").count() == 4 and len([p for p in (tmp_path / "out").iterdir() if p.name[:2] == "20"]) == 1
    # Done images aren't done again; under other settings they are.
    assert run.process_files(spark, one, {"bright": bright})[0].count() == 0
    assert run.process_files(spark, settings(tmp_path, combined_model="bright", height_threshold=8.0), {"bright": bright})[0].count() == 0


def test_two_models_and_a_detector_that_fails(spark, tmp_path):
    for d in ("rgb", "ndsm"):
        (tmp_path / d).mkdir()
    scene(tmp_path, [(20, 20, 9), (70, 70, 9)], "1")
    ring = [[1000, 1900], [1050, 1900], [1050, 2000], [1000, 2000], [1000, 1900]]
    layer = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    (tmp_path / "forest.geojson").write_text(json.dumps(layer))
    two = settings(tmp_path, urban_model="u", forrest_model="f", forrest_outline=str(tmp_path / "forest.geojson"))
    crowns, failed = run.process_files(spark, two, {"u": bright, "f": bright})
    assert sorted(round(json.loads(r["Centroid"])["x"]) for r in crowns.collect()) == [1024, 1074] and failed.count() == 0
    image = np.full((2, 60, 60), 250, np.uint8)
    (tmp_path / "rgb" / "9.tif").write_bytes(geotiff.encode(image, (1.0, 0.0, -1.0, 0.0), 25832))
    crowns, failed = run.process_files(spark, settings(tmp_path, combined_model="b"), {"b": broken})
    assert {r["file_name"] for r in failed.collect()} == {"9.tif"} and crowns.filter(F.col("file_name") == "1.tif").count() == 2

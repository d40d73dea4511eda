import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.functions import geometry as g
from sylva.functions.geometry import dbl
from sylva.runtime import ship
from sylva.sources import config, rasters, vector
from sylva.streaming.incremental import process_new_files


def crowns(spark):
    b = {k: dbl(v) for k, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 2, 3))}
    return spark.range(3).select((F.col("id") % 2).alias("image_id"), F.col("id").cast("string").alias("poly_id"), (F.col("id") / 2).alias("Confidence_score"), g.box_ring(b).alias("ring"))


def test_geojson_round_trip(spark, tmp_path):
    path = str(tmp_path / "layer")
    vector.write_geojson(crowns(spark), path, ["poly_id", "Confidence_score"], "image_id", 25832)
    back = vector.read_geojson(spark, path, ["Confidence_score", "poly_id"])
    rows = back.withColumn("area", g.ring_area(F.col("ring"))).collect()
    assert len(rows) == 3 and {r["area"] for r in rows} == {6.0} and {r["Confidence_score"] for r in rows} == {0.0, 0.5, 1.0} and rows[0]["crs"].endswith("25832")


def test_tiles_round_trip(spark, tmp_path):
    path = str(tmp_path / "tiles")
    rows = [(1, f"t{i}", 25832, [1.0] * 9, [0.0, 0.0, 1.0, 1.0], i == 0, i == 1) for i in range(3)]
    df = spark.createDataFrame(rows, "image_id long, tile_id string, crs int, transform array<double>, bounds array<double>, only_forest boolean, only_urban boolean")
    vector.write_tiles(df, path)
    back = vector.read_tiles(spark, path)
    assert {(r["tile_id"], r["only_forest"], r["only_urban"], len(r["transform"])) for r in back.collect()} == {("t0", True, False, 9), ("t1", False, True, 9), ("t2", False, False, 9)}


def test_predictions_below_folders(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    one = [{"image_id": "x", "category_id": 0, "score": 0.5, "polygon_coords": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}]
    (tmp_path / "a" / "b" / "Prediction_t_1.json").write_text(json.dumps(one))
    (tmp_path / "a" / "note.txt").write_text("no")
    [r] = vector.read_predictions(spark, str(tmp_path)).collect()
    assert r["tile_id"] == "t_1" and len(r["ring"]) == 4
    assert [x["name"] for x in vector.listing(spark, str(tmp_path), "*.json").collect()] == ["Prediction_t_1.json"]


def test_annotations_and_schema(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 2.0), (0.5, 9.0)], "Area double, TreeHeight double")
    assert vector.annotations(df, [("Area", 0.9, True), ("TreeHeight", 5.0, False)]).count() == 1
    assert vector.ordered(df).columns == [f.name for f in vector.CROWN] and vector.ordered(df).first()["poly_id"] is None
    assert df.select(vector.name_part(F.lit("anno_category_17.gpkg"), 2)).first()[0] == "17"


def test_scores(spark, tmp_path):
    df = spark.createDataFrame([("x", 0.5, 0.25)], "image_id string, iou_t double, f1 double")
    for form in ("tsv", "csv", "json"):
        vector.write_scores(df, str(tmp_path / form), form)
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv")).first()["f1"] == "0.25"
    (tmp_path / "eval" / "m1").mkdir(parents=True)
    (tmp_path / "eval" / "m1" / "results.json").write_text(json.dumps({"i1": [[0.5, 0.3, 0.9, 0.8], [0.6, 0.3, 0.8, 0.7]]}))
    assert [r["f1"] for r in vector.read_scores(spark, str(tmp_path / "eval"), ["m1"]).orderBy("iou_t").collect()] == [0.8, 0.7]


def test_rasters(spark, tmp_path):
    ship(spark)
    image = np.arange(2 * 5 * 7, dtype=np.uint16).reshape(2, 5, 7)
    np.save(tmp_path / "x.npy", image)
    pixels = rasters.read_rasters(spark, str(tmp_path), "*.npy", ["red", "nir"])
    assert pixels.count() == 35 and pixels.filter("r = 4 AND c = 6").first()["nir"] == 69.0
    assert tuple(rasters.headers(pixels).first()) == ("x.npy", 5, 7)


def test_config(tmp_path):
    base = {"image_directory": "rgb", "height_data_path": "h", "combined_model": "m.pth", "exclude_files": ["a"]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(base))
    assert config.load_config(str(path)).exclude_files == ("a",)
    with pytest.raises(ValueError, match="combined_model"):
        config.RunConfig("rgb", "h", urban_model="u")
    path.write_text(json.dumps(base | {"typo": 1}))
    with pytest.raises(ValueError, match="typo"):
        config.load_config(str(path))


def test_new_files_are_taken_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    run = lambda: process_new_files(spark, source, "id long", "parquet", lambda df: df.withColumn("twice", F.col("id") * 2), target, mark)
    spark.range(3).write.parquet(source)
    run()
    spark.range(10, 12).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(r["twice"] for r in spark.read.parquet(target).collect()) == [0, 2, 4, 20, 22]

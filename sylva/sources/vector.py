"""Vector layers, tile metadata, predictions and scores as files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "array<double>"
GEOJSON = "struct<type:string,name:string,crs:struct<type:string,properties:struct<name:string>>,features:array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
TILE = "struct<crs:int,transform:array<double>,bounds:array<double>,only_forest:boolean,only_urban:boolean>"
PREDICTION = "image_id string, category_id int, score double, polygon_coords array<array<array<double>>>"
#: Output schema of cleaned crowns, in this order.
CROWN = T.StructType([
    T.StructField("Confidence_score", T.DoubleType()), T.StructField("poly_id", T.StringType()), T.StructField("Area", T.DoubleType()), T.StructField("TreeHeight", T.DoubleType()), T.StructField("Centroid", T.StringType()),
    T.StructField("Diameter", T.DoubleType()), T.StructField("is_contained", T.StringType()), T.StructField("num_contained", T.LongType()),
])


def read_geojson(spark: SparkSession, path: str, numeric: Iterable[str] = ()) -> DataFrame:
    """(file, crs, properties, part, rings, ring) of every polygon, a row for each part of a feature of several.

    rings: the outer border and the holes; ring: the border alone. Properties named in numeric become doubles, null if they
    aren't. Features of other kinds have no polygons and give no rows.
    """
    layers = spark.read.schema(T.StructType.fromDDL(GEOJSON.removeprefix("struct<")[:-1])).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    rows = layers.select("file", F.col("crs.properties.name").alias("crs"), F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one, many = F.from_json(text, "array<array<array<double>>>"), F.from_json(text, "array<array<array<array<double>>>>")
    rows = rows.select("file", "crs", F.col("f.properties").alias("properties"), F.posexplode(F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)).alias("part", "p"))
    rings = F.transform("p", lambda r: F.transform(r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))
    return rows.select("file", "crs", "properties", "part", rings.alias("rings"), F.get(rings, 0).alias("ring"), *[F.expr(f"try_cast(properties['{n}'] AS double)").alias(n) for n in numeric])


def to_feature(ring: Column, properties: dict[str, Column]) -> Column:
    """A GeoJSON feature as text."""
    coordinates = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def write_geojson(df: DataFrame, path: str, properties: list[str], group: str, crs: int) -> None:
    """One feature collection for each value of group, in partitions of group; features of a layer are one row of text."""
    layers = df.groupBy(group).agg(F.concat_ws(",", F.collect_list(to_feature(F.col("ring"), {p: F.col(p) for p in properties}))).alias("features"))
    head = f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"urn:ogc:def:crs:EPSG::{crs}"}}}},"features":['
    layers.select(group, F.concat(F.lit(head), F.col("features"), F.lit("]}")).alias("value")).write.mode("overwrite").partitionBy(group).text(path)


def write_final(df: DataFrame, path: str, stamp: str | None = None, image: str = "image_id") -> list[str]:
    """The final crowns below path, by image; with a stamp (see stamp_of) a second copy in a folder of that name. Returns both places."""
    places = [f"{path}/final", *([f"{path}/{stamp}"] if stamp else [])]
    for place in places:
        write_crowns(df, place, image)
    return places


def stamp_of(moment: Column) -> Column:
    """The name of the folder of a run that began at a moment."""
    return F.date_format(moment, "yyyy-MM-dd_HH-mm-ss")


def write_predictions(df: DataFrame, path: str, tile: str = "tile_id") -> None:
    """Prediction files: one array of (image_id, category_id, score, polygon_coords) for each tile, in a folder of the tile.

    df: (tile, image_id, category_id, score, ring). The predictions of a tile are one row of text.
    """
    one = F.struct("image_id", "category_id", "score", F.array(F.transform("ring", lambda v: F.array(v["x"], v["y"]))).alias("polygon_coords"))
    made = df.groupBy(tile).agg(F.to_json(F.sort_array(F.collect_list(one))).alias("value"))
    made.write.mode("overwrite").partitionBy(tile).text(path)


def ordered(df: DataFrame, schema: T.StructType = CROWN) -> DataFrame:
    """The columns of the schema in its order; missing ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_crowns(df: DataFrame, path: str, image: str = "image_id") -> None:
    df.write.mode("overwrite").partitionBy(image).parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, tile_id, crs, transform, bounds, flags) of tile files: one object of tile names to metadata each."""
    text = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    parsed = text.select("file", F.explode(F.from_json("value", f"map<string,{TILE}>")).alias("tile_id", "t"))
    return parsed.select("file", "tile_id", "t.*")


def write_tiles(tiles: DataFrame, path: str, image: str = "image_id") -> None:
    """One object of tile names to metadata for each image."""
    entry = F.struct("tile_id", F.struct("crs", "transform", "bounds", "only_forest", "only_urban").alias("t"))
    made = tiles.groupBy(image).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    made.write.mode("overwrite").partitionBy(image).text(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, image_id, category_id, score, ring) of every polygon of prediction files below path, however deep.

    The tile is named by the file (Prediction_<tile>.json) or, for what write_predictions() wrote, by its folder.
    """
    rows = spark.read.schema(PREDICTION).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,txt}").json(path)
    name = F.input_file_name()
    tile = F.coalesce(F.nullif(F.regexp_extract(name, r"Prediction_(.*)\.json$", 1), F.lit("")), F.url_decode(F.regexp_extract(name, r"tile_id=([^/]*)/", 1)))
    ring = lambda p: F.transform(p, lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))
    return rows.select(tile.alias("tile_id"), "image_id", "category_id", "score", F.explode("polygon_coords").alias("p")).select("tile_id", "image_id", "category_id", "score", ring(F.col("p")).alias("ring"))


def annotations(df: DataFrame, limits: Iterable[tuple[str, float, bool]]) -> DataFrame:
    """Rows that pass every (property, threshold, above), strictly."""
    for name, threshold, above in limits:
        df = df.filter(F.col(name) > threshold if above else F.col(name) < threshold)
    return df


def name_part(name: Column, number: int) -> Column:
    """The part of a file name between underscores, from 0."""
    return F.element_at(F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_"), number + 1)


def named(files: DataFrame, pattern: str | None = None, prefix: str | None = None, skip: str | None = None) -> DataFrame:
    """Files (name) whose name matches a pattern, begins with a prefix, and doesn't begin with another."""
    if pattern is not None:
        files = files.filter(F.col("name").rlike(pattern))
    if prefix is not None:
        files = files.filter(F.col("name").startswith(prefix))
    return files if skip is None else files.filter(~F.col("name").startswith(skip))


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name, size) of files below path whose name matches the glob; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"))


def write_scores(df: DataFrame, path: str, form: str = "tsv") -> None:
    """Score tables as tab-separated text, csv or json lines."""
    writer = df.write.mode("overwrite")
    if form == "json":
        writer.json(path)
    else:
        writer.option("header", True).option("sep", "\t" if form == "tsv" else ",").csv(path)


def read_scores(spark: SparkSession, path: str, models: list[str]) -> DataFrame:
    """(model, image_id, iou_t, conf_t, precision, f1) of evaluation files, one folder for each model."""
    text = None
    for model in models:
        one = spark.read.option("wholetext", True).text(f"{path}/{model}").withColumn("model", F.lit(model))
        text = one if text is None else text.unionByName(one)
    rows = text.select("model", F.explode(F.from_json("value", "map<string,array<array<double>>>")).alias("image_id", "r")).select("model", "image_id", F.explode("r").alias("r"))
    return rows.select("model", "image_id", *[F.col("r")[i].alias(n) for i, n in enumerate(("iou_t", "conf_t", "precision", "f1"))])

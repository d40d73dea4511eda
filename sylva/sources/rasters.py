"""Rasters as rows of pixels. Decoders of file formats plug in; numpy's own format is built in."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.sources import geotiff

Decoder = Callable[[bytes], np.ndarray]


def numpy_decoder(data: bytes) -> np.ndarray:
    """(bands, rows, columns) of a .npy file; a single band may leave its axis out."""
    image = np.load(io.BytesIO(data), allow_pickle=False)
    return image[None] if image.ndim == 2 else image


def tiff_decoder(data: bytes) -> np.ndarray:
    """(bands, rows, columns) of a GeoTIFF file."""
    return geotiff.decode(data)


def files_of(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "content")


def read_rasters(spark: SparkSession, path: str, pattern: str, bands: list[str], decoder: Decoder = numpy_decoder, errors: bool = False) -> DataFrame:
    """decode_rasters() of the files below path."""
    return decode_rasters(files_of(spark, path, pattern), bands, decoder, errors)


def decode_rasters(files: DataFrame, bands: list[str], decoder: Decoder = numpy_decoder, errors: bool = False) -> DataFrame:
    """(file_name, r, c, bands...) of every pixel of files (file_name, content). One file is decoded at a time; rows come in strips.

    errors: a file that can't be decoded gives one row with its error in a further column, in place of an end of the job.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    image = decoder(content.as_py())
                except Exception as error:  # whatever a decoder that plugs in may raise
                    if not errors:
                        raise
                    row = [pa.array([name]), *[pa.nulls(1, pa.int64())] * 2, *[pa.nulls(1, pa.float64())] * len(bands), pa.array([f"{type(error).__name__}: {error}"])]
                    yield pa.RecordBatch.from_arrays(row, names=["file_name", "r", "c", *bands, "error"])
                    continue
                rows, cols = image.shape[1:]
                strip = max(1, 100_000 // max(cols, 1))
                for first in range(0, rows, strip):
                    part = image[: len(bands), first : first + strip].astype(float)
                    r, c = np.divmod(np.arange(part.shape[1] * cols), cols)
                    values = [pa.array(b.ravel()) for b in part]
                    row = [pa.array([name] * len(r)), pa.array(r + first, pa.int64()), pa.array(c, pa.int64()), *values]
                    yield pa.RecordBatch.from_arrays(row + [pa.nulls(len(r), pa.string())] * errors, names=["file_name", "r", "c", *bands] + ["error"] * errors)

    return files.select("file_name", "content").mapInArrow(decode, "file_name string, r long, c long, " + ", ".join(f"`{b}` double" for b in bands) + ", error string" * errors)


HEADER = "file_name string, width long, height long, bands long, dtype string, a double, b double, c double, d double, e double, f double, crs long, error string"


def read_headers(files: DataFrame) -> DataFrame:
    """Size, type, transform and reference system of GeoTIFF files (file_name, content), or the error; no pixel is decoded."""
    kinds = [pa.string(), *[pa.int64()] * 3, pa.string(), *[pa.float64()] * 6, pa.int64(), pa.string()]
    names = [f.split(" ")[0] for f in HEADER.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows.append({"file_name": name} | geotiff.header(content.as_py()))
                except (ValueError, KeyError, struct.error) as error:
                    rows.append({"file_name": name, "error": f"{type(error).__name__}: {error}"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return files.select("file_name", "content").mapInArrow(read, HEADER)


def write_rasters(pixels: DataFrame, path: str, bands: list[str], transform: tuple[float, float, float, float], crs: int, image: str = "image_id", dtype: str = "f8") -> None:
    """One GeoTIFF for each image of (image, r, c, bands...), as binary rows of a Parquet table (image, file_name, content) below path.

    An image is one file, so its pixels meet in one task; images are spread.
    """

    def make(table: pa.Table) -> pa.Table:
        r, c = table["r"].to_numpy(), table["c"].to_numpy()
        out = np.zeros((len(bands), int(r.max()) + 1, int(c.max()) + 1), dtype)
        for k, b in enumerate(bands):
            out[k, r, c] = table[b].to_numpy()
        own = table[image][0].as_py()
        return pa.table({image: pa.array([own], table.schema.field(image).type), "file_name": [f"{own}.tif"], "content": pa.array([geotiff.encode(out, transform, crs)], pa.binary())})

    kind = pixels.schema[image].dataType.simpleString()
    made = pixels.select(image, "r", "c", *bands).groupBy(image).applyInArrow(make, f"`{image}` {kind}, file_name string, content binary")
    made.write.mode("overwrite").parquet(path)


def headers(pixels: DataFrame, key: str = "file_name") -> DataFrame:
    """(key, height, width) of rasters in long form; only the places are read."""
    return pixels.groupBy(key).agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))

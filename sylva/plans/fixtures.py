"""Stand-ins for imagery and detections, derived from the plain tables by one SQL text that Spark and DuckDB share.

Coordinates and confidences are dyadic rationals, so areas and intersections are exact in double. The exponents in
the literals keep Spark from reading them as decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Table and text of each view.
VIEWS: dict[str, tuple[str, str]] = {
    "f_crowns": ("lineitem", """SELECT l_orderkey*8+l_linenumber AS crown_id, min(l_suppkey)%16 AS image_id,
  cast((min(l_partkey)*37)%9973 AS double)/4e0 AS x0, cast((l_orderkey*53)%9967 AS double)/4e0 AS y0,
  cast((min(l_partkey)*37)%9973 AS double)/4e0+1e0+min(l_quantity)/8e0 AS x1,
  cast((l_orderkey*53)%9967 AS double)/4e0+1e0+((l_linenumber*7+min(l_partkey))%23)/4e0 AS y1,
  2.5e-1+((l_orderkey*31+l_linenumber*17)%96)/1.28e2 AS conf
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""),
    "f_pixels": ("orders", """SELECT cast(floor(o_orderkey/1.6384e4) AS bigint) AS image_id, cast(floor((o_orderkey%16384)/1.28e2) AS bigint) AS r,
  o_orderkey%128 AS c, (o_orderkey*7)%256 AS red, (o_orderkey*11+3)%256 AS nir, ((o_orderkey*13)%400)/8e0 AS h
FROM {orders}"""),
    "f_preds": ("part", """SELECT p_partkey AS pid, p_partkey%50 AS tile,
  cast((p_partkey*37)%97 AS double) AS x0, cast((p_partkey*53)%89 AS double) AS y0,
  cast((p_partkey*37)%97+4+p_size AS double) AS x1, cast((p_partkey*53)%89+4+(p_size*7)%23 AS double) AS y1,
  2.5e-1+((p_partkey*31)%96)/1.28e2 AS conf
FROM {part}"""),
    "f_annots": ("part", """SELECT p_partkey AS aid, p_partkey%50 AS tile,
  cast((p_partkey*37)%97+(p_partkey%3) AS double) AS x0, cast((p_partkey*53)%89-(p_partkey%2) AS double) AS y0,
  cast((p_partkey*37)%97+5+p_size AS double) AS x1, cast((p_partkey*53)%89+3+(p_size*7)%23 AS double) AS y1
FROM {part} WHERE p_partkey%4<>0"""),
    "f_outlines": ("nation", """SELECT n_nationkey AS outline_id, cast(n_regionkey*500 AS double) AS x0, cast((n_nationkey*97)%2000 AS double) AS y0,
  cast(n_regionkey*500+150+n_nationkey*4 AS double) AS x1, cast((n_nationkey*97)%2000+300 AS double) AS y1
FROM {nation}
UNION ALL SELECT n_nationkey+100, cast(n_regionkey*500+150+n_nationkey*4 AS double), cast((n_nationkey*97)%2000 AS double),
  cast(n_regionkey*500+450 AS double), cast((n_nationkey*97)%2000+300 AS double) FROM {nation}"""),
    "f_images": ("supplier", """SELECT s_suppkey AS image_id, concat('FDOP20_', cast(100+s_suppkey%10 AS varchar(8)), '_', cast(200+cast(floor(s_suppkey/1e1) AS bigint) AS varchar(8)), '_rgbi.tif') AS file_name,
  cast((s_suppkey%10)*1000 AS double) AS c, cast(floor(s_suppkey/1e1)*1000 AS double) AS f, 2e-1 AS a, -2e-1 AS e, 5000 AS width, 5000 AS height
FROM {supplier}"""),
    "f_patches": ("embeddings", "SELECT vec_id, label, embedding FROM {embeddings}"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, text = VIEWS[name]
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def with_views(*names: str, recursive: bool = False) -> str:
    """The head of a DuckDB query that defines these views."""
    parts = [f"{n} AS ({VIEWS[n][1].format(**{VIEWS[n][0]: VIEWS[n][0]})})" for n in names]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)

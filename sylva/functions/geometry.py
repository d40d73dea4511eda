"""Geometry, affine and spectral functions as column expressions, so that they stay inside generated code.

A ring is an array of structs (x, y), closed (last vertex equal to the first) unless said otherwise. A box is four
columns x0, y0, x1, y1. An affine transform is six columns a, b, c, d, e, f: x = a*col + b*row + c, y = d*col + e*row + f.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def dbl(x: float) -> Column:
    return F.lit(float(x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Affine transforms


def pixel_to_geo(t: dict[str, Column], row: Column, col: Column, centre: bool = False) -> tuple[Column, Column]:
    """World coordinates of a pixel's corner, or of its centre."""
    half = dbl(0.5 if centre else 0.0)
    row, col = row + half, col + half
    return t["a"] * col + t["b"] * row + t["c"], t["d"] * col + t["e"] * row + t["f"]


def pixels_to_geo(t: dict[str, Column], rows: Column, cols: Column) -> tuple[Column, Column]:
    """World coordinates of arrays of pixels."""
    return F.zip_with(rows, cols, lambda r, c: pixel_to_geo(t, r, c)[0]), F.zip_with(rows, cols, lambda r, c: pixel_to_geo(t, r, c)[1])


def geo_to_pixel(t: dict[str, Column], x: Column, y: Column, floor: bool = False) -> tuple[Column, Column]:
    """(row, col) of a point without shear; truncated towards zero, or floored. A zero pixel size is an error."""
    whole = F.floor if floor else lambda v: v.cast("long")
    checked = lambda s: F.when(s == 0, F.raise_error(F.lit("a transform with a pixel size of zero can't be inverted")).cast("double")).otherwise(s)
    return whole((y - t["f"]) / checked(t["e"])), whole((x - t["c"]) / checked(t["a"]))


def window_transform(t: dict[str, Column], row_off: Column, col_off: Column) -> tuple[Column, Column]:
    """(c, f) of the transform of a window."""
    return pixel_to_geo(t, row_off, col_off)


# Boxes


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in BOX}


def box_area(b: dict[str, Column]) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, dbl(0)) * F.greatest(h, dbl(0))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    common = overlap_area(a, b)
    union = box_area(a) + box_area(b) - common
    return F.when(union > 0, common / union).otherwise(dbl(0))


def touches(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def crosses(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Common interior points."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def inside(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """a within b, borders included."""
    return (a["x0"] >= b["x0"]) & (a["y0"] >= b["y0"]) & (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"])


def grown(b: dict[str, Column], by: Column | float) -> dict[str, Column]:
    by = by if isinstance(by, Column) else dbl(by)
    return {"x0": b["x0"] - by, "y0": b["y0"] - by, "x1": b["x1"] + by, "y1": b["y1"] + by}


def clipped(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {k: (F.greatest if k in ("x0", "y0") else F.least)(a[k], b[k]) for k in BOX}


def near_box(a: dict[str, Column], b: dict[str, Column], eps: float = 1e-3) -> Column:
    out = F.lit(True)
    for k in BOX:
        out = out & (F.abs(a[k] - b[k]) < dbl(eps))
    return out


def near_border(b: dict[str, Column], bounds: dict[str, Column], eps: float) -> Column:
    """Any side within eps of the same side of the bounds."""
    out = F.lit(False)
    for k in BOX:
        out = out | (F.abs(b[k] - bounds[k]) <= dbl(eps))
    return out


def box_ring(b: dict[str, Column]) -> Column:
    at = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0"))


# Rings


def ring_area(ring: Column) -> Column:
    """Shoelace area, whatever the direction."""
    twice = lambda r: F.aggregate(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), dbl(0), lambda s, v: s + v)
    return F.when(F.size(ring) < 4, dbl(0)).otherwise(F.abs(let(ring, twice)) / 2)


def polygon_area(rings: Column) -> Column:
    """Area of the first ring less those of the others, its holes."""
    areas = F.transform(rings, ring_area)
    return F.aggregate(areas, dbl(0), lambda s, v: s - v) + 2 * F.element_at(areas, 1)


def ring_box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def vertex_mean(ring: Column) -> Column:
    """Mean of all vertices; the closing one counts as well."""
    mean = lambda k: F.aggregate(F.transform(ring, lambda p: p[k]), dbl(0), lambda s, v: s + v) / F.size(ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def circle_of(ring: Column) -> Column:
    """Centre of the bounding box and the distance of the farthest vertex from it."""

    def make(b: Column) -> Column:
        x, y = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
        far = F.array_max(F.transform(ring, lambda p: (p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)))
        return F.struct(x.alias("x"), y.alias("y"), F.sqrt(far).alias("r"))

    return let(ring_box(ring), make)


def in_circle(x: Column, y: Column, cx: Column, cy: Column, r: Column) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def diameter(area: Column) -> Column:
    return 2 * F.sqrt(area / F.pi())


def point_json(p: Column) -> Column:
    """A point as JSON text."""
    return F.concat(F.lit('{"x": '), p["x"].cast("string"), F.lit(', "y": '), p["y"].cast("string"), F.lit("}"))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def round_to(value: Column, digits: int) -> Column:
    """Half to even on the scaled value."""
    return F.bround(value * dbl(10**digits), 0) / dbl(10**digits)


def round_ring(ring: Column, digits: int = 3) -> Column:
    return F.transform(ring, lambda p: F.struct(round_to(p["x"], digits).alias("x"), round_to(p["y"], digits).alias("y")))


def is_valid_ring(ring: Column) -> Column:
    """At least four vertices, closed, with an area."""
    ends = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.when(ring.isNull() | (F.size(ring) < 4), F.lit(False)).otherwise(ends & (ring_area(ring) > 0))


def clip_ring(ring: Column, b: dict[str, Column]) -> Column:
    """Part of a convex ring inside a box: each of the four half planes keeps the vertices on its side and adds the crossings."""
    for axis, side, keep_above in (("x", "x0", True), ("x", "x1", False), ("y", "y0", True), ("y", "y1", False)):
        ring = let(ring, cutter(axis, b[side], keep_above))
    return ring


def cutter(axis: str, at: Column, above: bool) -> Callable[[Column], Column]:
    return lambda ring: half_plane(ring, axis, at, above)


def half_plane(ring: Column, axis: str, at: Column, above: bool) -> Column:
    def step(p: Column, q: Column) -> Column:
        within = lambda v: v[axis] >= at if above else v[axis] <= at
        other = "y" if axis == "x" else "x"
        share = (at - p[axis]) / F.when(q[axis] == p[axis], dbl(1)).otherwise(q[axis] - p[axis])
        cross = {axis: at, other: p[other] + share * (q[other] - p[other])}
        point = F.struct(cross["x"].alias("x"), cross["y"].alias("y"))
        empty = F.filter(F.array(q), lambda v: F.lit(False))
        return F.concat(F.when(within(p) != within(q), F.array(point)).otherwise(empty), F.when(within(q), F.array(q)).otherwise(empty))

    kept = F.flatten(F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), step))
    return let(kept, lambda k: F.when(F.size(k) > 0, F.concat(k, F.slice(k, 1, 1))).otherwise(k))


def first_part(parts: Column) -> Column:
    """The first polygon of several, or null."""
    return F.get(parts, F.lit(0))


def same_crs(a: Column, b: Column) -> Column:
    """a, where both reference systems are the same; otherwise an error, as nothing here reprojects."""
    return F.when(a.eqNullSafe(b), a).otherwise(F.raise_error(F.concat_ws(" ", F.lit("reference systems differ:"), a.cast("string"), b.cast("string"))).cast("int"))


def raster_outline(t: dict[str, Column], height: Column, width: Column) -> Column:
    """The closed ring of a raster's four corners."""
    corners = [pixel_to_geo(t, r, c) for r, c in ((F.lit(0), F.lit(0)), (F.lit(0), width), (height, width), (height, F.lit(0)), (F.lit(0), F.lit(0)))]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


# Spectral


def ndvi(red: Column, nir: Column) -> Column:
    """Of bands from 0 to 255; a value outside -1 to 1 is an error."""
    r, n = red / dbl(255), nir / dbl(255)
    value = (n - r) / (n + r + dbl(1e-10))
    return F.when((value < -1) | (value > 1), F.raise_error(F.lit("index outside -1 to 1")).cast("double")).otherwise(value)


def rescale(value: Column, low: Column, high: Column, top: float = 255.0) -> Column:
    """low to high mapped to 0 to top; a flat range gives 0."""
    return F.when(high > low, (value - low) / (high - low) * dbl(top)).otherwise(dbl(0))


def to_8_bit(value: Column, most: Column) -> Column:
    """16-bit values to 8 bits where the band's largest value needs it."""
    return F.when(most > 255, F.floor(dbl(255) * value / dbl(65535))).otherwise(value.cast("long"))


# Names


def regex_identifier(name: Column, pattern: str, groups: int, anchored: bool = False) -> Column:
    """All groups of the first match, joined without a separator; null if there is no match."""
    pattern = f"^(?:{pattern})" if anchored else pattern
    parts = [F.regexp_extract(name, pattern, g) for g in range(1, groups + 1)]
    return F.when(name.rlike(pattern), F.concat(*parts))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def tile_id(name: Column, x: Column, y: Column, width: Column, buffer: Column, crs: Column) -> Column:
    return F.concat_ws("_", name, *[v.cast("long").cast("string") for v in (x, y, width, buffer, crs)])


def tile_fields(identifier: Column) -> dict[str, Column]:
    """The five numbers at the end of a tile's name."""
    parts = F.split(F.regexp_replace(identifier, r"(\.[A-Za-z]+)+$", ""), "_")
    return {k: F.element_at(parts, i - 5).cast("long") for i, k in enumerate(("minx", "miny", "width", "buffer", "crs"))}


def merged_name(first: Column, last: Column, corners: list[Column], fused: bool = False) -> Column:
    """Name of the image merged of two: first, rounded corners, last; fused: the numbers without separators."""
    numbers = [F.bround(c, 0).cast("long").cast("string") for c in corners]
    return F.concat(first, F.lit("_"), F.concat(*numbers) if fused else F.concat_ws("_", *numbers), F.lit("_"), last, F.lit(".tif"))

"""GeoTIFF files by their public layout: header and transform, pixels of strips or tiles, and a writer.

Read: both byte orders, strips and tiles, interleaved or separate bands, no compression or deflate, horizontal
differences, whole numbers and floats. Other compressions are errors that name themselves.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Tag numbers, field types with their sizes, and geo keys of TIFF 6.0 and GeoTIFF 1.1.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, SCALE, TIEPOINT, MATRIX, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PROJECTED, GEOGRAPHIC = 3072, 2048
DEFLATE = (8, 32946)
KINDS = {1: "u", 2: "i", 3: "f"}


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, values of each tag) of the first image of a file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    found = {}
    for k in range(n):
        tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in TYPES:
            continue
        form = order + TYPES[kind] * count
        size = struct.calcsize(form)
        place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        found[tag] = struct.unpack(form, data[place : place + size])
    return order, found


def header(data: bytes) -> dict:
    """width, height, bands, dtype, the affine transform a to f, crs (an EPSG number or None) and nodata; no pixel is decoded."""
    _, t = tags(data)
    one = lambda tag, default=None: t.get(tag, (default,))[0]
    if MATRIX in t:
        a, b, _, c, d, e, _, f = t[MATRIX][:8]
    elif SCALE in t and TIEPOINT in t:
        col, row, _, x, y = t[TIEPOINT][:5]
        a, b, d, e = t[SCALE][0], 0.0, 0.0, -t[SCALE][1]
        c, f = x - col * a, y - row * e
    else:
        a, b, c, d, e, f = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    keys = t.get(GEO_KEYS, ())
    crs = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    nodata = b"".join(t[NODATA]).split(b"\0")[0].decode() if NODATA in t else None
    kind = KINDS.get(one(SAMPLE_FORMAT, 1), "u") + str(one(BITS, 8) // 8)
    return {"width": one(WIDTH), "height": one(HEIGHT), "bands": one(SAMPLES, 1), "dtype": kind, "a": a, "b": b, "c": c, "d": d, "e": e, "f": f, "crs": crs.get(PROJECTED, crs.get(GEOGRAPHIC)), "nodata": float(nodata) if nodata else None}


def decode(data: bytes, rows: tuple[int, int] | None = None) -> np.ndarray:
    """(bands, rows, columns) of a file, or of a range of its rows: only the strips or tiles that hold these are decompressed."""
    order, t = tags(data)
    info = header(data)
    height, width, bands = info["height"], info["width"], info["bands"]
    first, last = rows or (0, height)
    compression, planar, predictor = (t.get(k, (1,))[0] for k in (COMPRESSION, PLANAR, PREDICTOR))
    if compression != 1 and compression not in DEFLATE:
        raise ValueError(f"TIFF compression {compression} isn't supported")
    if predictor not in (1, 2) or (predictor == 2 and info["dtype"][0] == "f"):
        raise ValueError(f"TIFF predictor {predictor} isn't supported for {info['dtype']}")
    tiled = TILES in t
    tall = t[TILE_HEIGHT][0] if tiled else min(t.get(ROWS_PER_STRIP, (height,))[0], height)
    wide = t[TILE_WIDTH][0] if tiled else width
    places, sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
    across, down = -(-width // wide), -(-height // tall)
    depth = bands if planar == 1 else 1
    out = np.zeros((bands, last - first, width), np.dtype(info["dtype"]))
    for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
        plane, n = divmod(k, across * down)
        top, left = n // across * tall, n % across * wide
        if top >= last or top + tall <= first:
            continue
        raw = data[at : at + size]
        raw = zlib.decompress(raw) if compression != 1 else raw
        block = np.frombuffer(raw, np.dtype(order + info["dtype"]))
        block = block[: len(block) // (wide * depth) * wide * depth].reshape(-1, wide, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        a, b = max(top, first), min(top + len(block), last, height)
        part = block[a - top : b - top, : width - left]
        target = slice(0, bands) if planar == 1 else slice(plane, plane + 1)
        out[target, a - first : b - first, left : left + part.shape[1]] = part.transpose(2, 0, 1)
    return out


def encode(image: np.ndarray, transform: tuple[float, float, float, float], crs: int | None = None, compress: bool = True, rows_per_strip: int = 64) -> bytes:
    """A file of (bands, rows, columns), interleaved strips; transform: (a, c, e, f) without shear."""
    bands, height, width = image.shape
    a, c, e, f = transform
    strips = []
    for top in range(0, height, rows_per_strip):
        raw = np.ascontiguousarray(image[:, top : top + rows_per_strip].transpose(1, 2, 0)).astype(image.dtype.newbyteorder("<")).tobytes()
        strips.append(zlib.compress(raw) if compress else raw)
    size = image.dtype.itemsize
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    keys = (1, 1, 0, 2, 1024, 0, 1, 1, PROJECTED, 0, 1, crs) if crs else (1, 1, 0, 0)
    entries = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (8 * size,) * bands), (COMPRESSION, 3, (8 if compress else 1,)), (PHOTOMETRIC, 3, (1,)), (STRIPS, 4, (0,) * len(strips)), (SAMPLES, 3, (bands,)),
        (ROWS_PER_STRIP, 4, (rows_per_strip,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (PLANAR, 3, (1,)), (SAMPLE_FORMAT, 3, (kind,) * bands), (SCALE, 12, (a, -e, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, c, f, 0.0)), (GEO_KEYS, 3, keys),
    ]
    after = 8 + 2 + 12 * len(entries) + 4
    pack = lambda kind, values: struct.pack("<" + TYPES[kind] * len(values), *values)
    at = after + sum(len(pack(k, v)) for _, k, v in entries if len(pack(k, v)) > 4)
    starts = [at + sum(map(len, strips[:k])) for k in range(len(strips))]
    entries = [(t, k, tuple(starts) if t == STRIPS else v) for t, k, v in entries]
    directory, extra = b"", b""
    for tag, kind, values in entries:
        body = pack(kind, values)
        if len(body) > 4:
            directory += struct.pack("<HHII", tag, kind, len(values), after + len(extra))
            extra += body
        else:
            directory += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    return b"II" + struct.pack("<HIH", 42, 8, len(entries)) + directory + b"\0" * 4 + extra + b"".join(strips)

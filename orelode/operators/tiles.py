"""Raster tiles: colours of a grid as PNG images by zoom, column and row.

The coloured grid is the base image, one pixel a cell, north up. It is cut into
square blocks with a rim of one pixel, because a tile's pixel blends two by two
base pixels. Each block renders its own part of the pixels of every zoom's
tiles as one array per tile; a tile is then put together from its parts, whose
bytes are those of one tile however large the grid is.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour_ramp

BLOCK = 256


def png(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA image as PNG."""
    h, w, _ = rgba.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in rgba)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def zooms(min_zoom: int, max_zoom: int, tile_size: int, max_tiles: int, max_bytes: int) -> range:
    """The zooms from ``min_zoom`` on whose tiles stay within both bounds; the deepest go first."""
    count = lambda top: sum(4**z for z in range(min_zoom, top + 1))
    while max_zoom > min_zoom and (count(max_zoom) > max_tiles or count(max_zoom) * tile_size**2 * 4 > max_bytes):
        max_zoom -= 1
    return range(min_zoom, max_zoom + 1)


def base_pixels(grid: DataFrame, spec: dict, palette: str, opacity: float, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """px, py (0 at the north), r, g, b, a of every cell with a value; lo and hi are the values of the ramp's ends."""
    if lo is None or hi is None:
        a, b = grid.agg(F.min("v"), F.max("v")).first()
        lo, hi = a if lo is None else lo, b if hi is None else hi
    t = (F.col("v") - lo) / (hi - lo) if hi is not None and hi > lo else F.lit(0.5)
    alpha = int(255 * min(max(opacity, 0.0), 1.0) + 0.5)
    c = grid.where("v is not null").select(F.col("ix").alias("px"), (spec["ny"] - 1 - F.col("iy")).alias("py"), colour_ramp(t, palette).alias("c"))
    return c.select("px", "py", "c.r", "c.g", "c.b", F.lit(alpha).alias("a"))


def _places(n_tiles: int, tile_size: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Along one axis, for each pixel of a zoom's tiles: the two base pixels that it blends, and the second one's share."""
    tile, pixel = np.divmod(np.arange(n_tiles * tile_size, dtype=np.int64), tile_size)
    at = np.maximum((tile + (pixel + 0.5) / tile_size) / n_tiles * size - 0.5, 0.0)
    low = np.floor(at)
    first = np.minimum(low.astype(np.int64), size - 1)
    return first, np.minimum(first + 1, size - 1), (at - low).astype(np.float32)


def _mix(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    return a * (1 - share) + b * share


def _render(block: np.ndarray, x0: int, y0: int, spec: dict, levels: range, tile_size: int, side: int) -> Iterator[tuple]:
    """z, x, y, i, j, w, h, bytes: the parts of tiles whose first base pixel lies in the block at (x0, y0)."""
    for z in levels:
        axes = []
        for size, start in ((spec["nx"], x0), (spec["ny"], y0)):
            first, second, share = _places(1 << z, tile_size, size)
            a, b = np.searchsorted(first, (start, start + side))
            axes.append((a, first[a:b] - start, second[a:b] - start, share[a:b]))
        (i0, xa, xb, fx), (j0, ya, yb, fy) = axes
        if not len(xa) or not len(ya):
            continue
        f = block.astype(np.float32)
        fx, fy = fx[None, :, None], fy[:, None, None]
        top, bottom = _mix(f[ya][:, xa], f[ya][:, xb], fx), _mix(f[yb][:, xa], f[yb][:, xb], fx)
        out = np.clip(_mix(top, bottom, fy) + np.float32(0.5), 0, 255).astype(np.uint8)
        for ty in range(j0 // tile_size, (j0 + len(ya) - 1) // tile_size + 1):
            for tx in range(i0 // tile_size, (i0 + len(xa) - 1) // tile_size + 1):
                a, b = max(i0, tx * tile_size), min(i0 + len(xa), (tx + 1) * tile_size)
                c, d = max(j0, ty * tile_size), min(j0 + len(ya), (ty + 1) * tile_size)
                part = out[c - j0 : d - j0, a - i0 : b - i0]
                if part.any():
                    yield z, tx, ty, a - tx * tile_size, c - ty * tile_size, b - a, d - c, part.tobytes()


def tile_pyramid(grid: DataFrame, spec: dict, palette: str = "inferno", opacity: float = 0.72, tile_size: int = 256, max_zoom: int = 2, max_tiles: int = 200_000, min_zoom: int = 0, max_bytes: int = 2 << 30, lo: float | None = None, hi: float | None = None, block: int = BLOCK) -> DataFrame:
    """z, x, y, png of every tile over the extent of ``grid(ix, iy, v)``; row 0 is the north.

    Pixels are blends of the coloured cells around their centres, alpha too; a
    cell without a value is transparent, and so is a tile without cells. The
    deepest zooms are left out where tiles would pass ``max_tiles`` or, at four
    bytes a pixel, ``max_bytes``.
    """
    levels = zooms(min_zoom, max_zoom, tile_size, max_tiles, max_bytes)
    spark = grid.sparkSession
    px = base_pixels(grid, spec, palette, opacity, lo, hi)
    own = lambda c: F.when((F.col(c) % block == 0) & (F.col(c) > 0), F.array(F.floor(F.col(c) / block), F.floor(F.col(c) / block) - 1)).otherwise(F.array(F.floor(F.col(c) / block)))
    blocks = px.withColumn("bx", F.explode(own("px"))).withColumn("by", F.explode(own("py")))

    def render(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(key[0]) * block, int(key[1]) * block
        a = np.zeros((block + 1, block + 1, 4), np.uint8)
        a[p["py"] - y0, p["px"] - x0] = p[["r", "g", "b", "a"]].to_numpy()
        return pd.DataFrame(list(_render(a, x0, y0, spec, levels, tile_size, block)), columns=["z", "x", "y", "i", "j", "w", "h", "part"])

    parts = blocks.groupBy("bx", "by").applyInPandas(render, "z int, x int, y int, i int, j int, w int, h int, part binary")
    parts = parts.groupBy("z", "x", "y").agg(F.collect_list(F.struct("i", "j", "w", "h", "part")).alias("parts"))  # a tile's bytes at most
    every = spark.createDataFrame([(z,) for z in levels], "z int").withColumn("_n", F.expr("shiftleft(1, z)")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")

    def encode(batches):
        for p in batches:
            images = []
            for found in p["parts"]:
                a = np.zeros((tile_size, tile_size, 4), np.uint8)
                for f in found if found is not None else ():
                    a[f["j"] : f["j"] + f["h"], f["i"] : f["i"] + f["w"]] = np.frombuffer(f["part"], np.uint8).reshape(f["h"], f["w"], 4)
                images.append(png(a))
            yield pd.DataFrame({"z": p["z"], "x": p["x"], "y": p["y"], "png": images})

    return every.join(parts, ["z", "x", "y"], "left").mapInPandas(encode, "z int, x int, y int, png binary")

"""Web-map tiles: rendering, pyramids, compositing, routing indices, Hilbert order, PNG and archive bytes."""

from __future__ import annotations

import gzip
import json
import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netdensity.functions import geo

SIZE = 256
TILES = "z int, x long, y long, png binary"


def png(rgba: np.ndarray) -> bytes:
    """A PNG file of 8-bit red, green, blue, alpha."""
    h, w, _ = rgba.shape
    raw = np.zeros((h, 1 + 4 * w), np.uint8)
    raw[:, 1:] = rgba.reshape(h, 4 * w)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes(), 6)) + part(b"IEND", b"")


def pixels(data: bytes) -> np.ndarray:
    """The pixels of a PNG that ``png`` wrote."""
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h = struct.unpack_from(">II", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 4 * w)
    if raw[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return raw[:, 1:].reshape(h, w, 4)


def coloured(values: np.ndarray) -> np.ndarray:
    """Scores to pixels; NaN is transparent."""
    ok = np.isfinite(values)
    at = np.clip(np.log1p(np.where(ok, values, 0)) / math.log1p(30), 0, 1) * (len(geo.PALETTE) - 1)
    low = np.minimum(np.floor(at).astype(int), len(geo.PALETTE) - 2)
    stops, f = np.array(geo.PALETTE, float), (at - low)[..., None]
    rgb = (stops[low] * (1 - f) + stops[low + 1] * f).astype(np.uint8)
    return np.dstack([np.where(ok[..., None], rgb, 0), np.where(ok, geo.OPACITY, 0).astype(np.uint8)])


def lanczos_half(rgba: np.ndarray) -> np.ndarray:
    """Half the size by a Lanczos filter of three lobes, with colours weighted by their opacity."""
    n = rgba.shape[0] // 2
    centre = 2 * np.arange(n) + 1.0
    first = np.maximum(0, (centre - 6 + 0.5).astype(int))
    weights = np.zeros((n, 2 * n))
    for i in range(n):
        k = np.arange(first[i], min(2 * n, int(centre[i] + 6 + 0.5)))
        t = (k - centre[i] + 0.5) / 2
        w = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0)
        weights[i, k] = w / w.sum()
    a = rgba.astype(float)
    a[..., :3] *= a[..., 3:] / 255
    a = np.einsum("ij,jkc->ikc", weights, np.einsum("ij,kjc->kic", weights, a))
    alpha = np.clip(a[..., 3:], 0, 255)
    rgb = np.where(alpha > 0, a[..., :3] * 255 / np.maximum(alpha, 1e-9), 0)
    return np.clip(np.rint(np.concatenate([rgb, alpha], 2)), 0, 255).astype(np.uint8)


def render(samples: DataFrame, zoom: int) -> DataFrame:
    """(z, x, y, png) from (tx, ty, px, py, score); a tile without any value is left out."""
    with_values = samples.where("score is not null")

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.full((SIZE, SIZE), np.nan)
        v[pdf["py"], pdf["px"]] = pdf["score"]
        return pd.DataFrame([(zoom, key[0], key[1], png(coloured(v)))], columns=["z", "x", "y", "png"])

    return with_values.groupBy("tx", "ty").applyInPandas(draw, TILES)


def parents(tiles: DataFrame) -> DataFrame:
    """One zoom level up: four children on a canvas of twice the size, halved."""

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        canvas = np.zeros((2 * SIZE, 2 * SIZE, 4), np.uint8)
        for x, y, data in pdf[["x", "y", "png"]].itertuples(index=False):
            canvas[y % 2 * SIZE : (y % 2 + 1) * SIZE, x % 2 * SIZE : (x % 2 + 1) * SIZE] = pixels(data)
        return pd.DataFrame([(int(pdf["z"].iloc[0]) - 1, key[0], key[1], png(lanczos_half(canvas)))], columns=["z", "x", "y", "png"])

    return tiles.groupBy(F.floor(F.col("x") / 2).alias("x2"), F.floor(F.col("y") / 2).alias("y2")).applyInPandas(join, TILES)


def parent_keys(keys: DataFrame, levels: int) -> DataFrame:
    """(z, x, y) of all tiles up to ``levels`` above the given ones, those included."""
    up = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    at = keys.withColumn("__up", up)
    power = F.pow(F.lit(2.0), F.col("__up"))
    return at.select((F.col("z") - F.col("__up")).alias("z"), F.floor(F.col("x") / power).alias("x"), F.floor(F.col("y") / power).alias("y")).distinct()


def compact(keys: DataFrame) -> DataFrame:
    """(z, y, lo, hi): runs of x without gaps in each row of tiles."""
    place = Window.partitionBy("z", "y").orderBy("x")
    runs = keys.distinct().withColumn("__run", F.col("x") - F.row_number().over(place))
    return runs.groupBy("z", "y", "__run").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select("z", "y", "lo", "hi")


def expanded(runs: DataFrame) -> DataFrame:
    return runs.select("z", F.explode(F.sequence("lo", "hi")).alias("x"), "y")


def hilbert_id(z: Column, x: Column, y: Column, most: int = 15) -> Column:
    """A tile's number in an archive: all tiles of lower zooms, then the place on the Hilbert curve of its zoom."""
    start = F.floor((F.pow(F.lit(4.0), z) - 1) / 3).cast("long")
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        side = F.shiftleft(F.lit(1).cast("long"), k.cast("int")) if False else F.pow(F.lit(2.0), k).cast("long")
        rx = (s["x"].bitwiseAND(side) > 0).cast("long")
        ry = (s["y"].bitwiseAND(side) > 0).cast("long")
        d = s["d"] + side * side * (3 * rx).bitwiseXOR(ry)
        # Where the quadrant's curve is turned, swap the axes, mirrored for the last quadrant.
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, side - 1 - s["x"]).otherwise(s["x"]), F.when(flip, side - 1 - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(s["x"]).alias("x"), F.when(ry == 0, fx).otherwise(s["y"]).alias("y"), d.alias("d"))

    steps = F.when(z > 0, F.reverse(F.sequence(F.lit(0), z.cast("int") - 1))).otherwise(F.array().cast("array<int>"))
    return start + F.aggregate(steps, state, step)["d"]


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def archive(tiles: list[tuple[int, int, int, int, bytes]], metadata: dict) -> bytes:
    """A single-file tile archive (version 3 layout) of (id, z, x, y, bytes), with one root directory. Equal tiles are stored once."""
    tiles = sorted(tiles)
    place: dict[bytes, int] = {}
    body, entries = b"", []
    for i, _, _, _, data in tiles:
        if data not in place:
            place[data] = len(body)
            body += data
        entries.append((i, place[data], len(data)))
    directory = varint(len(entries))
    for k, (i, _, _) in enumerate(entries):
        directory += varint(i - (entries[k - 1][0] if k else 0))
    directory += b"\x01" * len(entries)
    for _, _, n in entries:
        directory += varint(n)
    for k, (_, at, _) in enumerate(entries):
        directory += varint(0 if k and at == entries[k - 1][1] + entries[k - 1][2] else at + 1)
    root, meta = gzip.compress(directory, mtime=0), gzip.compress(json.dumps(metadata, sort_keys=True).encode(), mtime=0)
    zooms = [t[1] for t in tiles] or [0]
    offsets = [127, len(root), 127 + len(root), len(meta), 127 + len(root) + len(meta), 0, 127 + len(root) + len(meta), len(body)]
    head = b"PMTiles\x03" + struct.pack("<11Q", *offsets, len(entries), len(entries), len(place))
    head += struct.pack("<BBBBBB", 1, 2, 1, 2, min(zooms), max(zooms)) + struct.pack("<4i", -1800000000, -850000000, 1800000000, 850000000) + struct.pack("<B2i", min(zooms), 0, 0)
    return head + root + meta + body


def archive_entries(data: bytes) -> list[tuple[int, bytes]]:
    """(id, bytes) of every tile of an archive that ``archive`` wrote."""
    if data[:8] != b"PMTiles\x03":
        raise ValueError("not a tile archive")
    root_at, root_n, _, _, _, _, body_at, _, count, _, _ = struct.unpack_from("<11Q", data, 8)
    raw, at = gzip.decompress(data[root_at : root_at + root_n]), 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    n = number()
    if n != count:
        raise ValueError("the directory does not fit the header")
    ids, out, last = [], [], 0
    for _ in range(n):
        last += number()
        ids.append(last)
    runs = [number() for _ in range(n)]
    sizes = [number() for _ in range(n)]
    end = 0
    for i, run, size in zip(ids, runs, sizes, strict=True):
        got = number()
        start = end if got == 0 else got - 1
        end = start + size
        out += [(i + k, data[body_at + start : body_at + end]) for k in range(run)]
    return out

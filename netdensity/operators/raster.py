"""Score rasters as (row, col, score) tables: lattices, jobs, windows and checksummed blocks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netdensity.functions import geo

BLOCK = 320
PACKED = "bx long, by long, cells int, sha256 string, payload binary"


def lattice(spark: SparkSession, west: float, south: float, east: float, north: float, spacing: float = geo.SPACING) -> DataFrame:
    """(row, col, x, y): the cell centres of the lattice that covers a box, on whole multiples of the spacing."""
    c0, r0 = math.floor(west / spacing), math.floor(south / spacing)
    cols, rows = math.ceil(east / spacing) - c0, math.ceil(north / spacing) - r0
    i = F.col("id")
    cells = spark.range(rows * cols).select(F.floor(i / cols).alias("row"), (i % cols).alias("col"))
    return cells.select("row", "col", ((c0 + F.col("col") + 0.5) * spacing).alias("x"), ((r0 + F.col("row") + 0.5) * spacing).alias("y"))


def corner_grid(spark: SparkSession, west: float, south: float, east: float, north: float, spacing: float) -> DataFrame:
    """(row, col, x, y): points from the corner in steps, rows outer; the far side is left out."""
    cols, rows = math.ceil((east - west) / spacing), math.ceil((north - south) / spacing)
    i = F.col("id")
    return spark.range(rows * cols).select(F.floor(i / cols).alias("row"), (i % cols).alias("col"), (west + (i % cols) * spacing).alias("x"), (south + F.floor(i / cols) * spacing).alias("y"))


def jobs(cells: DataFrame, chunk: float = geo.CHUNK) -> DataFrame:
    """(cx, cy, r0, r1, c0, c1, cells): the windows of the lattice that chunks own; every cell is in one."""
    return cells.groupBy(F.floor(F.col("x") / chunk).alias("cx"), F.floor(F.col("y") / chunk).alias("cy")).agg(
        F.min("row").alias("r0"), (F.max("row") + 1).alias("r1"), F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"), F.count("*").alias("cells"))


def sample(points: DataFrame, scores: DataFrame, x: Column, y: Column, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Points with the score of the cell that they lie in; null outside or without data."""
    row, col = geo.cell_of(x, y, x0, y0)
    at = points.withColumn("row", row).withColumn("col", col)
    return at.join(scores.select("row", "col", "score"), ["row", "col"], "left")


def blocks(scores: DataFrame, size: int = BLOCK) -> DataFrame:
    """(bx, by, cells, sha256, payload): little-endian float32 windows, NaN where nothing is; a window without any value is left out."""
    placed = scores.where("score is not null and not isnan(score)").select(F.floor(F.col("col") / size).alias("bx"), F.floor(F.col("row") / size).alias("by"), (F.col("row") % size).cast("int").alias("r"), (F.col("col") % size).cast("int").alias("c"), "score")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((size, size), np.nan, "<f4")
        out[pdf["r"], pdf["c"]] = pdf["score"]
        raw = out.tobytes()
        return pd.DataFrame([(key[0], key[1], len(pdf), hashlib.sha256(raw).hexdigest(), raw)], columns=["bx", "by", "cells", "sha256", "payload"])

    # A window holds size * size cells at most.
    return placed.groupBy("bx", "by").applyInPandas(pack, PACKED)


def unpacked(packed: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, col, score float) of packed blocks; a block whose length or checksum is wrong raises an error."""

    def read(it):
        for pdf in it:
            for bx, by, sha, raw in pdf[["bx", "by", "sha256", "payload"]].itertuples(index=False):
                if len(raw) != 4 * size * size or hashlib.sha256(raw).hexdigest() != sha:
                    raise ValueError(f"block {bx}/{by} is damaged")
                a = np.frombuffer(raw, "<f4").reshape(size, size)
                r, c = np.nonzero(np.isfinite(a))
                yield pd.DataFrame({"row": by * size + r, "col": bx * size + c, "score": a[r, c]})

    return packed.mapInPandas(read, "row long, col long, score float")


def assembled(parts: list[DataFrame]) -> DataFrame:
    """Windows put together; where several have a cell the one with a value counts, the first of them in order."""
    tagged = [p.select("row", "col", "score", F.lit(k).alias("k")) for k, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy("row", "col").agg(F.min_by("score", F.when(F.col("score").isNotNull(), F.col("k"))).alias("score"))

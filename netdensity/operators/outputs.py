"""Results as GeoJSON features, packed float records and manifests; and their readers."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netdensity.functions import geo

KINDS = ("amenity", "shop", "tourism", "leisure")
SEGMENT = ("x1", "y1", "x2", "y2", "score")


def feature(kind: str, coordinates: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")))


def cell_features(cells: DataFrame, half: float = geo.SPACING / 2) -> DataFrame:
    """Cells (x, y in metres, score, shown) as closed squares of five points in degrees."""
    corner = lambda dx, dy: F.array(*geo.unproject(F.col("x") + dx * half, F.col("y") + dy * half))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    return cells.withColumn("feature", feature("Polygon", F.array(ring), score=F.col("score"), score_display=F.col("shown")))


def poi_features(pois: DataFrame) -> DataFrame:
    """Destinations (lon, lat, tags) of a known kind as points, with name, kinds and the first kind as type."""
    tags = {k: F.try_element_at("tags", F.lit(k)) for k in ("name", *KINDS)}
    kind = F.coalesce(*[tags[k] for k in KINDS])
    return pois.where(kind.isNotNull()).withColumn("feature", feature("Point", F.array("lon", "lat"), **tags, type=kind))


def segment_features(segments: DataFrame) -> DataFrame:
    line = F.array(F.array("x1", "y1"), F.array("x2", "y2"))
    return segments.withColumn("feature", feature("LineString", line, score=F.col("score"), score_display=F.col("shown")))


def edge_features(edges: DataFrame) -> DataFrame:
    line = F.array(F.array("ax", "ay"), F.array("bx", "by"))
    return edges.withColumn("feature", feature("LineString", line, weight=F.round("weight", 1)))


def packed_rows(rows: DataFrame, part: Column, order: list[str], columns: tuple[str, ...]) -> DataFrame:
    """(part, n, sha256, payload): little-endian float32 records of ``columns`` in order, one binary value a part."""
    tagged = rows.withColumn("__part", part.cast("long"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.ascontiguousarray(pdf.sort_values(order)[list(columns)].to_numpy(), "<f4").tobytes()
        return pd.DataFrame([(key[0], len(pdf), hashlib.sha256(raw).hexdigest(), raw)], columns=["part", "n", "sha256", "payload"])

    return tagged.groupBy("__part").applyInPandas(pack, "part long, n long, sha256 string, payload binary")


def unpacked_rows(packed: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(part, i, columns..) of packed records; a wrong checksum is an error."""

    def read(it):
        for pdf in it:
            for part, sha, raw in pdf[["part", "sha256", "payload"]].itertuples(index=False):
                if hashlib.sha256(raw).hexdigest() != sha:
                    raise ValueError(f"part {part} is damaged")
                a = np.frombuffer(raw, "<f4").reshape(-1, len(columns))
                yield pd.DataFrame({"part": part, "i": np.arange(len(a)), **{c: a[:, k] for k, c in enumerate(columns)}})

    return packed.mapInPandas(read, "part long, i long, " + ", ".join(f"{c} float" for c in columns))


def grid_places(n: Column, cols: int, rows: int, west: float, south: float, east: float, north: float) -> tuple[Column, Column]:
    """Where a viewer puts the n-th score: evenly between the bounds, row 0 in the south."""
    return west + (n % cols + 0.5) * ((east - west) / cols), south + (F.floor(n / cols) + 0.5) * ((north - south) / rows)


def shown(score: Column, most: Column) -> Column:
    """A viewer's scale: log1p of the score over log1p of the greatest."""
    return F.when(most > 0, F.log1p(score) / F.log1p(most)).otherwise(0.0)


def signature(payload: dict) -> str:
    """SHA-256 over JSON with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def dataset_id(parts: DataFrame) -> str:
    """16 hex digits over the checksums of all parts in order; the driver holds one digest."""
    n = parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "part", "sha256"))), ","), 256).alias("h"))
    return n.first()["h"][:16]


def write_output(path: str, features: dict[str, DataFrame], packed: dict[str, DataFrame], metadata: dict) -> None:
    """A whole result under one folder: each collection of ``features`` as lines of GeoJSON, each table of ``packed`` records as Parquet,
    and last the metadata, a JSON document with the number of each, so that a folder without it is unfinished."""
    spark = next(iter((features | packed).values())).sparkSession
    for name, df in features.items():
        df.select("feature").write.text(f"{path}/{name}.geojsonl")
    for name, df in packed.items():
        df.write.parquet(f"{path}/{name}.bin")
    counts = {name: spark.read.text(f"{path}/{name}.geojsonl").count() for name in features}
    counts |= {name: int(spark.read.parquet(f"{path}/{name}.bin").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) for name in packed}
    spark.createDataFrame([(json.dumps(metadata | {"counts": counts}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/metadata.json")

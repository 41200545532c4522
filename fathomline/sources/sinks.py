"""Sinks: Parquet first, CSV and GeoJSON exports, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmptyResultError(ValueError):
    """A sink that refuses empty tables got one."""


def save(df: DataFrame, path: str, kind: str = "parquet", allow_empty: bool = False, partition_by: list[str] | None = None) -> None:
    if not allow_empty and df.isEmpty():
        raise EmptyResultError(path)
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.option("header", "true").csv(path) if kind == "csv" else writer.format(kind).save(path)


def feature(geometry: Column, properties: list[str]) -> Column:
    """A GeoJSON feature as text; geometry is a struct(type, coordinates)."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def save_features(df: DataFrame, geometry: Column, properties: list[str], path: str) -> None:
    """One feature per line (newline-delimited GeoJSON), so that writing stays parallel."""
    df.select(feature(geometry, properties).alias("value")).write.mode("overwrite").text(path)


def manifest(old: DataFrame, new: DataFrame, key: str = "artifact") -> DataFrame:
    from fathomline.operators.panel import upsert

    return upsert(old, new, [key])

"""Chunks with vectors as points of a vector table: deterministic ids, payloads with defaults, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The DNS name space of RFC 4122 (a fixed value).
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def point_id(name: Column) -> Column:
    """The version 5 UUID of a name, so that the same chunk always takes the same place."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def to_points(chunks: DataFrame, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """point_id, vector and a payload of all other columns."""
    rest = [c for c in chunks.columns if c != vector]
    return chunks.select(point_id(F.col(key).cast("string")).alias("point_id"), F.col(vector).alias("vector"), F.struct(*rest).alias("payload"))


def from_points(points: DataFrame) -> DataFrame:
    """The payload's columns, with a default for each known one that is missing or null."""
    given = {"doc_type": F.lit("unknown"), "chunk_index": F.lit(0).cast("long"), "char_count": F.lit(0).cast("long"), "tags": F.array().cast("array<string>")}
    have = points.select("payload.*").columns
    own = [F.coalesce(F.col(f"payload.{c}"), given[c]).alias(c) if c in given else F.col(f"payload.{c}").alias(c) for c in have]
    return points.select("point_id", "vector", *own, *[v.alias(c) for c, v in given.items() if c not in have])


def stats(points: DataFrame, vector: str = "vector") -> DataFrame:
    """points, least and most dimensions, and points without a vector."""
    n = F.size(vector)
    own = F.when(F.col(vector).isNotNull(), n)
    return points.agg(
        F.count(F.lit(1)).alias("points"),
        F.min(own).alias("least_dims"),
        F.max(own).alias("most_dims"),
        F.count_if(F.col(vector).isNull()).alias("without_vector"),
    )


def deleted(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    """One row: how many points have one of the ids, which may name points that are not there, and how many are left over."""
    asked = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    told = points.select(key).join(asked, key, "left")
    return told.agg(F.count("_gone").alias("deleted"), F.count_if(F.col("_gone").isNull()).alias("left_over"))

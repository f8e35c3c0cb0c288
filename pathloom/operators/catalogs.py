"""Combining catalogues: union, overlay, kind labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .joins import fits_broadcast, lookup_join


def union_catalogs(first: DataFrame, second: DataFrame, prefix: str = "") -> DataFrame:
    """Sorted distinct paths of both catalogues that start with ``prefix``."""
    keep = F.col("path").startswith(prefix)
    return (
        first.where(keep).select("path")
        .unionByName(second.where(keep).select("path"))
        .distinct()
        .orderBy("path")
    )


def overlay_catalogs(first: DataFrame, second: DataFrame, value: list[str]) -> DataFrame:
    """One row per path with the values of the first catalogue that has it.

    A union and one aggregate with map-side combine; copies of a path cannot multiply
    as they would in a full join.
    """
    tagged = first.select("path", F.struct(F.lit(0).alias("_layer"), *value).alias("v")).unionByName(
        second.select("path", F.struct(F.lit(1).alias("_layer"), *value).alias("v"))
    )
    best = tagged.groupBy("path").agg(F.min("v").alias("v"))
    return best.select("path", *[F.col(f"v.{c}").alias(c) for c in value], F.col("v._layer").alias("layer"))


def load_assets(wanted: DataFrame, first: DataFrame, second: DataFrame, value: list[str]) -> DataFrame:
    """Wanted paths with their overlaid values; ``found`` is false where neither has the path."""
    paths = wanted.select("path").distinct()
    small = fits_broadcast(paths)
    relevant = [lookup_join(c, paths, "path", "left_semi", small=small) for c in (first, second)]
    merged = overlay_catalogs(*relevant, value)
    return lookup_join(wanted, merged, "path", "left", small=small).withColumn("found", F.col("layer").isNotNull())


def kind_lookup(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Adds ``kind`` from the user's table ``(is_folder, key, kind)``.

    Folders look up their name, files their class; unknown keys get the default label.
    """
    is_folder = F.col("class") == "folder"
    keyed = rows.withColumn("is_folder", is_folder).withColumn(
        "key", F.when(is_folder, F.col("name")).otherwise(F.col("class"))
    )
    joined = lookup_join(keyed, kinds, ["is_folder", "key"], "left")
    fallback = F.when(F.col("is_folder"), F.lit("folder")).otherwise(F.lit("document"))
    return joined.withColumn("kind", F.coalesce("kind", fallback)).drop("is_folder", "key")

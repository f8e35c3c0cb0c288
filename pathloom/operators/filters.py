"""Path filters: crawl pruning, watch excludes, root planning, exact lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import parent
from .joins import fits_broadcast, lookup_join
from .numbering import _before, _in_order

# A prefix list up to this length becomes one predicate that reaches the scan.
INLINE_PREFIXES = 200
# A prefix frame with up to this many distinct lengths is matched length by length.
INLINE_LENGTHS = 32


def starts_with_any(path: Column | str, prefixes: list[str], component: bool = False) -> Column:
    """Raw string-prefix test (``/lib`` also hits ``/library``) against a short list.

    ``component=True`` matches whole path components only.
    """
    path = F.col(path) if isinstance(path, str) else path

    def hit(prefix: str) -> Column:
        if not component:
            return path.startswith(prefix)
        return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")

    return reduce(lambda a, b: a | b, (hit(p) for p in prefixes), F.lit(False))


def _without_prefixes(df: DataFrame, key: str, prefixes: DataFrame, component: bool) -> DataFrame:
    """Rows of ``df`` whose ``key`` starts with no row of ``prefixes(prefix)``; NULL keys stay.

    No row is compared with every prefix: a prefix of length n can only equal the first
    n characters of the key. Few prefixes of few lengths become one broadcast anti join
    per length, a single pass without a shuffle. Any other table becomes intervals.
    """
    prefixes = prefixes.select("prefix").where(F.col("prefix").isNotNull()).distinct()
    sized = prefixes.withColumn("n", F.char_length("prefix"))
    lengths = [r["n"] for r in sized.select("n").distinct().limit(INLINE_LENGTHS + 1).collect()]
    if len(lengths) > INLINE_LENGTHS or not fits_broadcast(prefixes):
        return _outside(df, key, prefixes, component)
    if component:
        df = lookup_join(df, prefixes.withColumnRenamed("prefix", key), key, "left_anti", small=True)
        sized = prefixes.select(_folder("prefix").alias("prefix")).withColumn("n", F.char_length("prefix"))
        lengths = [r["n"] for r in sized.select("n").distinct().collect()]
    for n in sorted(lengths):
        listed = sized.where(F.col("n") == n).select(F.col("prefix").alias("_cut"))
        cut = F.when(F.char_length(key) >= n, F.substring(F.col(key), 1, n))
        df = df.withColumn("_cut", cut).join(F.broadcast(listed), "_cut", "left_anti").drop("_cut")
    return df


def _folder(prefix: str) -> Column:
    """What every path below ``prefix`` starts with."""
    return F.concat(F.regexp_replace(prefix, r"/+\z", ""), F.lit("/"))


def _outside(df: DataFrame, key: str, prefixes: DataFrame, component: bool) -> DataFrame:
    """``_without_prefixes`` for any number of prefixes of any lengths.

    The keys that start with p are one interval of the byte order, from p up to p and the byte
    FF, which UTF-8 does not have (up to p and the byte 00: the key p alone). Ends of intervals
    and rows are sorted together, once, over all tasks; a row stays where as many
    intervals have ended as begun. Nested and repeated prefixes need no care, lengths do not matter, a prefix of most
    keys is two rows, and rows of one key are told apart by a hash.
    """
    at = lambda text, end: F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit(end)))
    spans = [F.struct(at("prefix", "").alias("low"), at("prefix", "00" if component else "FF").alias("high"))]
    if component:
        folder = _folder("prefix")
        spans.append(F.struct(at(folder, "").alias("low"), at(folder, "FF").alias("high")))
    ends = F.explode(
        F.flatten(F.transform(F.array(*spans), lambda s: F.array(
            F.struct(s["low"].alias("_pos"), F.lit(1).alias("_step")), F.struct(s["high"].alias("_pos"), F.lit(-1).alias("_step"))
        )))
    )
    marks = (
        prefixes.select(ends.alias("_end")).select("_end.*").groupBy("_pos")
        .agg(F.sum("_step").alias("_step")).withColumns({"_is_row": F.lit(False), "_tie": F.lit(0).cast("long")})
    )
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.encode(key, "UTF-8").alias("_pos"),
        F.lit(0).cast("long").alias("_step"), F.lit(True).alias("_is_row"),
        F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_tie"),
    )
    placed = _in_order(rows.unionByName(marks, allowMissingColumns=True), "_pos", "_is_row", "_tie")
    begun = _before(placed.groupBy("_part").agg(F.sum("_step").alias("_step")), "_step")
    so_far = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.col("_open") + F.col("_step_before")
    summed = placed.withColumn("_open", F.sum("_step").over(so_far)).join(F.broadcast(begun), "_part")
    return summed.where(F.col("_is_row") & (depth == 0)).select("_row.*")


def _drop_by_prefix(df: DataFrame, key: str, prefixes: list[str] | DataFrame, component: bool) -> DataFrame:
    if isinstance(prefixes, list):
        if len(prefixes) <= INLINE_PREFIXES:
            return df.where(~F.coalesce(starts_with_any(key, prefixes, component), F.lit(False)))
        prefixes = df.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    return _without_prefixes(df, key, prefixes, component)


def exclude_prefix(
    df: DataFrame, prefixes: list[str] | DataFrame, path: str = "path", component: bool = False
) -> DataFrame:
    """Drop rows whose path starts with an excluded string.

    A list (up to ``INLINE_PREFIXES``) is a plain predicate that reaches the scan; a
    frame with a ``prefix`` column may have any size. ``component=True`` drops the excluded
    paths and what is below them, but not names that only begin alike.
    """
    return _drop_by_prefix(df, path, prefixes, component)


def prune_subtrees(
    files: DataFrame,
    root: str | Column,
    prefixes: list[str] | DataFrame,
    path: str = "path",
    component: bool = False,
) -> DataFrame:
    """Entries a pruned crawl of ``root`` would report.

    An excluded entry itself stays, its descendants do not. Some ancestor strictly
    below the crawl root starts with an excluded string exactly when the parent does,
    so one look at the parent decides. (A root that is itself excluded is still
    reported together with its children.) ``component=True`` takes excludes as whole names.
    """
    root = F.lit(root) if isinstance(root, str) else root
    up = parent(path)
    inner = F.when(F.char_length(up) > F.char_length(root), up)
    return _drop_by_prefix(files.withColumn("_up", inner), "_up", prefixes, component).drop("_up")


def partition_roots(roots: DataFrame, excludes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(excluded roots, remaining roots), matched on the whole path."""
    listed = excludes.select(F.col("prefix").alias("path")).distinct()
    return roots.join(listed, "path", "left_semi"), roots.join(listed, "path", "left_anti")


def remaining_excludes(excludes: DataFrame, excluded_roots: DataFrame) -> DataFrame:
    """Excludes that did not remove a whole root."""
    used = excluded_roots.select(F.col("path").alias("prefix"))
    return excludes.join(used, "prefix", "left_anti")


def lookup_path(docs: DataFrame, paths: str | DataFrame) -> DataFrame:
    """Documents with exactly this path, or with a path of the given frame."""
    if isinstance(paths, str):
        return docs.where(F.col("path") == paths)
    return lookup_join(docs, paths, "path", "left_semi")

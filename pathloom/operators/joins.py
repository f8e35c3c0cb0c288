"""Joining a large frame to a lookup frame whose size is checked, not assumed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 32


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` is small, by rows and by bytes.

    Each task counts its own rows and sends one number pair. Arrays, maps and structs are sized
    by their text.
    """
    width = F.lit(0)
    for column, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{column}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.col(f"`{column}`").cast("string")), F.lit(0))
        else:
            width = width + F.lit(8)
    rows, size = df.agg(F.count("*"), F.sum(width.cast("long"))).first()
    return rows <= max_rows and (size or 0) <= BROADCAST_BYTES


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    spread: Column | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Join ``big`` to ``lookup`` (inner, left, left_semi or left_anti).

    A lookup of at most ``max_rows`` rows is broadcast, so ``big`` is not moved.
    Beyond that both sides are shuffled on the key plus a salt: rows of ``big`` are
    spread by ``spread`` (default: a hash of the whole row) and each lookup row is
    repeated once per salt. A key that holds a third of ``big`` is then shared by
    ``SALTS`` groups, and each ``big`` row still meets every lookup row of its key once.
    ``small`` passes on a size that is already known, which saves the check.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how in ("left_semi", "left_anti"):
        lookup = lookup.select(*keys).distinct()
    if fits_broadcast(lookup, max_rows) if small is None else small:
        return big.join(F.broadcast(lookup), keys, how)
    spread = spread if spread is not None else F.xxhash64(*big.columns)
    salted = big.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def restrict_scan(df: DataFrame, key: str, lookup: DataFrame, most: int = 128) -> DataFrame:
    """Keep rows of ``df`` whose ``key`` is in a short, already computed ``lookup``.

    Up to ``most`` rows become filters of the scan. These are single equalities, which skip
    every row group that cannot hold one of them by its range or bloom filter (a long IN
    list would reach the reader as one wide range). A longer lookup leaves ``df`` as it is, for
    a join to filter.
    """
    values = [r[0] for r in lookup.select(key).limit(most + 1).collect()]
    if len(values) > most:
        return df
    values = sorted({v for v in values if v is not None})
    if not values:
        return df.where(F.lit(False))
    return df.where(reduce(lambda a, b: a | b, [F.col(key) == v for v in values]))

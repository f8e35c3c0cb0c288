"""Parsing and formatting of the string values kept in settings and result pages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .paths import _col

KB, MB, GB = 1024.0, 1024.0**2, 1024.0**3


def format_size(size: Column | str) -> Column:
    """``1.2 KB`` style text; ties round to the even digit, as IEEE formatting does."""
    size = _col(size).cast("double")

    def scaled(unit: float, pattern: str) -> Column:
        # Rounding first: Java's formatter alone would round ties up.
        return F.format_string(pattern, F.bround(size / unit, 1))

    return (
        F.when(size >= GB, scaled(GB, "%.1f GB"))
        .when(size >= MB, scaled(MB, "%.1f MB"))
        .when(size >= KB, scaled(KB, "%.1f KB"))
        .otherwise(F.format_string("%.0f B", F.bround(size, 0)))
    )


def format_percent(percent: Column | str) -> Column:
    percent = _col(percent).cast("double")
    return F.when(percent == 100, F.lit("100")).otherwise(
        F.format_string("%.2f", F.bround(percent, 2))
    )


def parse_bool(value: Column | str) -> Column:
    """Only the exact texts ``true`` and ``false`` count; anything else is NULL."""
    value = _col(value)
    return F.when(value == "true", F.lit(True)).when(value == "false", F.lit(False))


def normalize_query(q: Column | str) -> Column:
    """Query text without surrounding Unicode white space."""
    return F.regexp_replace(_col(q), r"(?U)^\s+|\s+$", "")


def decode_path(raw: Column | str, strict: bool = True) -> Column:
    """Bytes to text. Strict decoding fails on bad UTF-8, lenient shows a placeholder."""
    text = _col(raw).cast("string")
    if strict:
        return F.validate_utf8(text)
    return F.coalesce(F.try_validate_utf8(text), F.lit("Invalid UTF-8"))


def parse_prefix_list(value: Column | str) -> Column:
    """JSON text array to ``array<string>``."""
    return F.from_json(_col(value), "array<string>")

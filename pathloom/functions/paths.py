"""Column expressions over slash-separated paths and file metadata."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def derive_name(path: Column | str) -> Column:
    """Last non-empty component; ``''`` for the root."""
    return F.regexp_extract(_col(path), r"([^/]+)/*\z", 1)


def parent(path: Column | str) -> Column:
    """Path of the containing directory; ``/`` for first-level entries, NULL for the root."""
    path = _col(path)
    cut = F.regexp_replace(path, r"/+[^/]*/*\z", "")
    return F.when(derive_name(path) == "", F.lit(None)).when(cut == "", F.lit("/")).otherwise(cut)


def root_of(path: Column | str, below: str = "/") -> Column:
    """Ancestor that is a child of ``below`` (``/a`` for ``/a/b/c`` below ``/``); ``''`` elsewhere."""
    top = re.escape(below.rstrip("/"))
    return F.regexp_extract(_col(path), f"^({top}/[^/]+)", 1)


def derive_class(name: Column | str, is_dir: Column | str) -> Column:
    """Extension if there is one, else folder / file, else unknown when metadata is absent.

    The extension wins over the directory flag, and a leading-dot name such as
    ``.bashrc`` counts as having the extension ``bashrc``.
    """
    name, is_dir = _col(name), _col(is_dir)
    extension = F.regexp_extract(name, r"\.([^.]+)\z", 1)
    return (
        F.when(extension != "", extension)
        .when(is_dir.isNull(), F.lit("unknown"))
        .when(is_dir, F.lit("folder"))
        .otherwise(F.lit("file"))
    )


def mtime_date(mtime: Column | str, as_of: dt.date | Column) -> Column:
    """UTC day of a modification time, whatever the session time zone.

    Times before 1970 and missing times give ``as_of``.
    """
    seconds = F.unix_seconds(_col(mtime))
    fallback = as_of if isinstance(as_of, Column) else F.lit(as_of)
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    return F.when(seconds >= 0, day).otherwise(fallback)


def size_double(size: Column | str) -> Column:
    return F.coalesce(_col(size).cast("double"), F.lit(0.0))

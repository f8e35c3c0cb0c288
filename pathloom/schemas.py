"""Explicit schemas of every table the engine reads or writes."""

from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

# One row per crawled entry. ``error`` is set where the entry could not be read.
FILES = _table(
    ("path", _S), ("is_dir", _B), ("size", _L), ("mtime", T.TimestampType()), ("error", _S)
)

# ``segment`` (and below it ``bucket``) are partition folders of the stored index.
DOCS = _table(("doc_id", _L), ("path", _S), ("name", _S), ("dl", _I), ("segment", _S))

# One row per term and block of 256 document ids. ``offsets`` are the ids within the block, in order; ``tfs``,
# ``dls`` and ``positions`` go with them. ``max_tf`` and ``min_dl`` bound the weight of any document of the row.
_LIST = T.ArrayType(_I)
BLOCKS = _table(
    ("term", _S), ("block", _L), ("n", _I), ("offsets", _LIST), ("tfs", _LIST), ("dls", _LIST),
    ("positions", T.ArrayType(_LIST)), ("max_tf", _I), ("min_dl", _I), ("segment", _S), ("bucket", _I),
)
TERMS = _table(("term", _S), ("df", _L), ("max_tf", _I), ("min_dl", _I), ("segment", _S), ("bucket", _I))
# The documents once more by hash of their path; ``slot`` is that hash modulo the slots of the segment. ``own`` tells
# that the name does not follow from the path; it is NULL in segments of before that column.
PATHS = _table(("doc_id", _L), ("path", _S), ("own", _B), ("dl", _I), ("segment", _S), ("slot", _I))
DEAD = DOCS

# ``exists_after[i]`` tells whether ``paths[i]`` was present after the event.
FS_EVENTS = _table(
    ("seq", _L), ("ts", T.TimestampType()), ("op", _S),
    ("paths", T.ArrayType(_S)), ("exists_after", T.ArrayType(_B)),
)

KV_LOG = _table(("key", _S), ("value", _S), ("version", _L), ("ord", _L))

QUERIES = _table(("query_id", _L), ("q", _S))

# Order in which the result page shows its columns.
RESULT_COLUMNS = ("class", "name", "path", "size", "last_modified_date")
SORTABLE_COLUMNS = ("size", "last_modified_date")

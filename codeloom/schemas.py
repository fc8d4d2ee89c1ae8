"""Kinds and column types of the code graph."""

from __future__ import annotations

from pyspark.sql import types as T

# Kinds of nodes, as stored.

#: Kinds that symbol search returns.
SYMBOL_KINDS = ["Function", "Method", "Class", "Type", "Test", "Endpoint"]
#: Kinds that a document's outline lists before its endpoints.
OUTLINE_KINDS = ["Function", "Method", "Class", "Type", "Test"]
#: Kinds with a row of their own in the text index.
INDEXED_KINDS = ["File", "Function", "Method", "Class", "Type", "Test", "Doc", "Endpoint"]

_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


NODES = _schema(
    ("id", _L), ("file_id", _L), ("kind", _S), ("name", _S), ("qualified_name", _S), ("path", _S),
    ("start_line", _L), ("end_line", _L), ("summary", _S), ("metadata", _S), ("seq", _L),
)

"""Declared types by affinity, and the kinds that lowering reasons about."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from tidemill.errors import SqlError

#: Substrings of a declared type, in the order in which they are tried.
_AFFINITY = (("INT", "int"), ("CHAR", "text"), ("TEXT", "text"), ("CLOB", "text"), ("STRING", "text"), ("VEC", "vector"), ("REAL", "real"), ("FLOA", "real"), ("DOUB", "real"), ("NUMERIC", "real"), ("DEC", "real"), ("BLOB", "blob"), ("BYTEA", "blob"))
SPARK = {"int": "bigint", "real": "double", "text": "string", "blob": "binary", "vector": "array<float>", "bool": "boolean", "ts": "timestamp_ntz", "null": "string"}


def kind_of_declared(declared: str) -> str:
    """The kind of a declared type; unknown and omitted ones are text."""
    upper = declared.upper()
    return next((kind for part, kind in _AFFINITY if part in upper), "text")


def vector_size(declared: str) -> int | None:
    if kind_of_declared(declared) != "vector":
        return None
    m = re.search(r"\((\d+)\)", declared)
    if not m or int(m[1]) < 1:
        raise SqlError("a vector column needs a size, such as VECTOR(3)")
    return int(m[1])


def kind_of_spark(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.BinaryType):
        return "blob"
    if isinstance(t, T.ArrayType):
        return "vector"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "ts"
    return "null" if isinstance(t, T.NullType) else "text"


def kind_of_cast(declared: str) -> str | None:
    """What a cast to this type makes, or None where it leaves the value as it is."""
    word = re.split(r"[ (]", declared.upper())[0]
    if word in ("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "INT2", "INT4", "INT8"):
        return "int"
    if word in ("REAL", "FLOAT", "DOUBLE", "NUMERIC", "DECIMAL", "FLOAT4", "FLOAT8"):
        return "real"
    if word in ("TEXT", "VARCHAR", "CHAR", "CHARACTER", "STRING", "JSON", "JSONB", "UUID", "BYTEA", "NAME"):
        return "text"
    if word in ("BOOL", "BOOLEAN"):
        return "bool"
    return "vector" if word.startswith("VEC") else None


def rendered(value: object) -> str | None:
    """A value as text: reals with a point, vectors in brackets, bytes in base64."""
    import base64

    if value is None:
        return None
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, float):
        return f"{value:.1f}" if value.is_integer() and abs(value) < 1e16 else repr(value)
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(bytes(value)).decode()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(f"{x:g}" if float(x).is_integer() else repr(round(float(x), 7)) for x in value) + "]"
    return str(value)

"""The column types of a stripe table, checked when a table is created."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import UnsupportedType

#: SQL name: Spark type. uuid is canonical text; numeric without precision has the widest decimal.
SQL_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "real": T.FloatType(),
    "double precision": T.DoubleType(),
    "text": T.StringType(),
    "varchar": T.StringType(),
    "bytea": T.BinaryType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
    "uuid": T.StringType(),
    "numeric": T.DecimalType(38, 10),
}
SHORT_NAMES = {"boolean": "bool", "int": "integer", "int2": "smallint", "int4": "integer", "int8": "bigint", "float4": "real", "float8": "double precision", "character varying": "varchar", "decimal": "numeric"}

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_STAMPS = (T.DateType, T.TimestampNTZType, T.TimestampType)
_PLAIN = (T.BooleanType, T.StringType, T.BinaryType, T.VarcharType)


def sql_type(name: str) -> T.DataType:
    """Spark type of an SQL type name such as ``bigint``, ``varchar(20)`` or ``numeric(12,2)``."""
    base, _, rest = name.strip().lower().partition("(")
    base = SHORT_NAMES.get(base.strip(), base.strip())
    args = [int(x) for x in rest.rstrip(") ").split(",")] if rest else []
    if base == "numeric" and args:
        return T.DecimalType(args[0], args[1] if len(args) > 1 else 0)
    if base == "varchar" and args:
        return T.VarcharType(args[0])
    if base not in SQL_TYPES:
        raise UnsupportedType(f"column type {name!r} is not supported")
    return SQL_TYPES[base]


def schema_of(columns: T.StructType | dict[str, str]) -> T.StructType:
    """A checked schema from a StructType or from {column: SQL type name}."""
    if not isinstance(columns, T.StructType):
        columns = T.StructType([T.StructField(c, sql_type(t)) for c, t in columns.items()])
    names = [f.name.lower() for f in columns]
    if len(set(names)) < len(names):
        raise UnsupportedType("column names must differ")
    for f in columns:
        if not isinstance(f.dataType, (*_INTEGERS, *_FLOATS, *_STAMPS, *_PLAIN, T.DecimalType)) or isinstance(f.dataType, T.ByteType):
            raise UnsupportedType(f"column {f.name}: type {f.dataType.simpleString()} is not supported")
    return columns


def stats_kind(t: T.DataType) -> str | None:
    """How a type takes part in min/max pruning: int, float, date, timestamp, timestamptz, decimal, string or not."""
    if isinstance(t, _INTEGERS):
        return "int"
    if isinstance(t, _FLOATS):
        return "float"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.TimestampNTZType):
        return "timestamp"
    if isinstance(t, T.TimestampType):
        return "timestamptz"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, (T.StringType, T.VarcharType)):
        return "string"
    return None

"""Spark types to the five logical column types."""

from __future__ import annotations

from pyspark.sql import types as T

_INT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT = (T.FloatType, T.DoubleType, T.DecimalType)
_DATE = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def logical_type(data_type: T.DataType) -> str:
    """int, float, date, bool, and ``str`` for everything else."""
    if isinstance(data_type, _INT):
        return "int"
    if isinstance(data_type, _FLOAT):
        return "float"
    if isinstance(data_type, _DATE):
        return "date"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    return "str"


def as_integer(name: str, data_type: T.DataType) -> str:
    """SQL for whole numbers as they are, dates as microseconds since the epoch."""
    if isinstance(data_type, (T.TimestampNTZType, T.DateType)):
        return f"unix_micros(cast({name} as timestamp))"
    if isinstance(data_type, T.TimestampType):
        return f"unix_micros({name})"
    return f"cast({name} as bigint)"


def as_float(name: str, data_type: T.DataType) -> str:
    """SQL for doubles with NaN counted as missing."""
    value = f"cast({name} as double)"
    if isinstance(data_type, T.DecimalType):
        return value
    return f"nullif({value}, double('NaN'))"


def as_text(name: str, data_type: T.DataType) -> str:
    """SQL for the text of a categorical value; nested values as JSON, bytes as base64."""
    if isinstance(data_type, _NESTED):
        return f"to_json({name})"
    if isinstance(data_type, T.BinaryType):
        return f"base64({name})"
    return f"cast({name} as string)"

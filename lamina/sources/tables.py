"""Reading of base tables and of delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..types import schema_of


def base_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Temporary views of base tables, for SQL."""
    for name in names:
        base_table(spark, folder, name).createOrReplaceTempView(name)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | dict[str, str], header: bool = False, sep: str = ",", null: str = "") -> DataFrame:
    """Text as COPY reads it: columns in order, a bad value is an error."""
    return spark.read.schema(schema_of(schema)).options(header=header, sep=sep, nullValue=null, mode="FAILFAST").csv(path)


def write_delimited(df: DataFrame, path: str, header: bool = False, sep: str = ",", null: str = "") -> None:
    df.write.options(header=header, sep=sep, nullValue=null).csv(path)

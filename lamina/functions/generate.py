"""Row generators: series and the benchmark's fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalar import add_days, add_seconds, array_get

# Fixed values of the fact table.
CATEGORIES = ["Electronics", "Clothing", "Books", "Food", "Sports", "Home", "Toys", "Automotive", "Health", "Garden"]
REGIONS = ["North", "South", "East", "West", "Central"]


def generate_series(spark: SparkSession, first: int, last: int, step: int = 1, name: str = "gs") -> DataFrame:
    """first, first + step, .. up to and with last."""
    return spark.range(first, last + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def fact_orders(spark: SparkSession, n: int) -> DataFrame:
    """n orders; amounts and discounts are arithmetic of the number, so that each run has the same."""
    gs = F.col("gs")
    day = add_days(F.lit("2020-01-01").cast("date"), (gs % 1461).cast("int"))
    return generate_series(spark, 1, n).select(
        gs.alias("order_id"),
        (gs % 50000 + 1).cast("int").alias("customer_id"),
        (gs % 5000 + 1).cast("int").alias("product_id"),
        array_get(CATEGORIES, gs % 10 + 1).alias("category"),
        array_get(REGIONS, gs % 5 + 1).alias("region"),
        (((gs * 7919) % 99900 + 100).cast("double") / 100).alias("amount"),
        (gs % 20 + 1).cast("int").alias("quantity"),
        (((gs * 104729) % 3001).cast("double") / 10000).alias("discount"),
        (gs % 10 == 0).alias("is_returned"),
        day.alias("order_date"),
        add_seconds(day.cast("timestamp_ntz"), gs % 86400).alias("created_at"),
    )

"""CSV files of daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR = ("open", "high", "low", "close")


def read_ohlc(spark: SparkSession, path: str, date: str = "date", complete: bool = True) -> DataFrame:
    """Bars with lower-case names, date as a timestamp, prices as doubles; ``complete`` drops rows with a gap."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    missing = {date, *BAR} - set(raw.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)} in {path}")
    prices = [c for c in raw.columns if c != date]
    out = raw.select(F.to_timestamp(date).alias(date), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in prices])
    return out.dropna(subset=[date, *BAR]) if complete else out


def read_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One numeric column of a CSV file, by name in any case."""
    raw = spark.read.csv(path, header=True)
    name = next((c for c in raw.columns if c.strip().lower() == column.lower()), None)
    if name is None:
        raise ValueError(f"no column {column} in {path}")
    return raw.select(F.expr(f"try_cast(`{name}` AS DOUBLE)").alias(column))

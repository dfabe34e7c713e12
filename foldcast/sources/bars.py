"""Bars and ticks from tables of single trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def bars(df: DataFrame, by: list[Column | str], price: str, order: str) -> DataFrame:
    """Open, high, low and close per group, first and last by ``order``; one aggregation, combined map-side."""
    p = F.col(price)
    return df.groupBy(*by).agg(F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"), F.count("*").alias("n"))


def daily_bars(orders: DataFrame) -> DataFrame:
    """A bar per order date of total prices, in order of the order key."""
    return bars(orders.select(F.col("o_orderdate").alias("d"), "o_totalprice", "o_orderkey"), ["d"], "o_totalprice", "o_orderkey")


def event_ticks(events: DataFrame) -> DataFrame:
    """Ticks (key, ts, price) per event type."""
    return events.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id"), F.col("value").alias("price"))


def tick_bars(ticks: DataFrame, width: str, key: str = "key", ts: str = "ts", price: str = "price") -> DataFrame:
    """Bars of a fixed width of time per key."""
    return bars(ticks, [key, F.window(ts, width).alias("w")], price, ts).select(key, F.col("w.start").alias("d"), "open", "high", "low", "close", "n")


def bad_bars(df: DataFrame) -> DataFrame:
    """How many bars are inconsistent."""
    return df.agg(F.count_if(S.garman_klass_vol("open", "high", "low", "close").isNull()).alias("bad"), F.count("*").alias("n"))

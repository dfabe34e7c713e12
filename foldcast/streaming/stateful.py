"""Streams: tick bars under a watermark; EWMA and GARCH volatility with one number of state per key.

The recurrences use the batch kernels, so a stream gives the bits of the batch. Rows must come in order per key: rows of
a micro-batch are sorted, and rows not after the last one of their key are late; they are dropped and counted
(column ``late``: how many of the key so far). Rows of one time are told apart by a whole number ``tie``, if it is given
(nulls first); without it a time has one row per key.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..contract import shared_dir, ship_code
from ..functions.scalars import normalise
from ..operators import kernels as K
from ..sources.bars import bars

STATE = "value double, seen boolean, last timestamp, late long"
TIED = ", known boolean, tie long"


def stream_bars(ticks: DataFrame, width: str, delay: str, key: str = "key", ts: str = "ts", price: str = "price") -> DataFrame:
    """Bars per key and window of time; a window is final once the watermark passes it."""
    t = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return bars(t, [key, F.window(ts, width).alias("w")], price, ts).select(key, F.col("w.start").alias("d"), "open", "high", "low", "close", "n")


def _stateful(df: DataFrame, key: str, ts: str, r: str, step: Callable[[np.ndarray, float | None], tuple[np.ndarray, float | None]], tie: str | None = None) -> DataFrame:
    ship_code(df.sparkSession)
    by = [ts] if tie is None else [ts, "_known", "_tie"]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, seen, last, late, *pair = state.get if state.exists else (0.0, False, None, 0, False, 0)[: 4 + 2 * (tie is not None)]
        rows = pd.concat(list(parts)).sort_values(by, kind="stable")
        if last is not None:
            at = pd.Timestamp(last)
            fresh = rows[ts] > at
            if tie is not None:
                known, least = pair
                fresh |= (rows[ts] == at) & ((rows["_known"] > known) | ((rows["_known"] == known) & (rows["_tie"] > least)))
            late += int((~fresh).sum())
            rows = rows[fresh]
        again = rows.duplicated(by)
        late += int(again.sum())
        rows = rows[~again]
        if len(rows):
            out, new = step(rows[r].to_numpy(float), value if seen else None)
            value, seen = (0.0, False) if new is None else (float(new), True)
            last = rows[ts].iloc[-1]
            if tie is not None:
                pair = [bool(rows["_known"].iloc[-1]), int(rows["_tie"].iloc[-1])]
            yield pd.DataFrame({"key": k[0], "ts": rows[ts], "r": rows[r].astype(float), "vol": out, "late": late})
        state.update((value, seen, last, late, *pair))

    tied = [] if tie is None else [F.col(tie).isNotNull().alias("_known"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("_tie")]
    given = df.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias(ts), F.col(r).cast("double").alias(r), *tied)
    kind = df.schema[key].dataType.simpleString()
    out = given.groupBy("key").applyInPandasWithState(run, f"key {kind}, ts timestamp, r double, vol double, late long", STATE + TIED * (tie is not None), "append", GroupStateTimeout.NoTimeout)
    return out.select("key", "ts", normalise("r").alias("r"), normalise("vol").alias("vol"), "late")


def stream_ewma(df: DataFrame, key: str, ts: str, r: str, lam: float = 0.94, tie: str | None = None) -> DataFrame:
    """(key, ts, r, vol, late): EWMA forecasts as rows arrive, in order of (ts, tie)."""
    if not 0 <= lam < 1:
        raise ValueError("lam must be at least 0 and under 1")
    return _stateful(df, key, ts, r, lambda x, v: K.ewma(x, lam, v), tie)


def stream_garch(df: DataFrame, key: str, ts: str, r: str, model: dict, tie: str | None = None) -> DataFrame:
    """(key, ts, r, vol, late): GARCH(1,1) forecasts as rows arrive, in order of (ts, tie), from the model's sigma2_next on."""
    o, a, b = (float(model[k]) for k in ("omega", "alpha", "beta"))
    first = float(model.get("sigma2_next", 0.0))
    if not 0 < first < math.inf:
        raise ValueError("the model has no current variance")
    return _stateful(df, key, ts, r, lambda x, v: K.garch_filter(x, o, a, b, first if v is None else v), tie)


def replay_ewma(spark: SparkSession, path: str, lam: float = 0.94) -> DataFrame:
    """All ticks of a Parquet source as one stream (key event_type, in order of ts and event_id), run until it is drained.

    The stream writes a Parquet table in the shared folder, which is what is returned: the micro-batches' rows never
    meet on the driver, and a restart resumes from the checkpoint.
    """
    at = f"{shared_dir(spark)}/foldcast/replay-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    name, folder = path.rstrip("/").rpartition("/")[2], path.rstrip("/").rpartition("/")[0]
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[0]}{name[1:-1]}?")
    ticks = rows.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("r"), "event_id")
    out = stream_ewma(ticks, "key", "ts", "r", lam, "event_id")
    q = out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")

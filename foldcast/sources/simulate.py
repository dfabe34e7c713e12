"""Simulated GARCH(1,1) series, the same on every platform."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..contract import ship_code

#: The 64-bit linear congruential generator (Knuth's MMIX) of the known-answer series.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407


def gaussians(seed: int, n: int) -> np.ndarray:
    """n standard normals by Box-Muller from pairs of generator steps."""
    u, s = np.empty(2 * n), seed
    for i in range(2 * n):
        s = (s * MULTIPLIER + INCREMENT) % 2**64
        u[i] = ((s >> 11) + 0.5) / 2**53
    return np.array([math.sqrt(-2 * math.log(a)) * math.cos(2 * math.pi * b) for a, b in zip(u[::2], u[1::2], strict=True)])


def garch_path(seed: int, n: int, omega: float, alpha: float, beta: float) -> np.ndarray:
    """Returns of a path that starts at its unconditional variance."""
    s2, out = omega / (1 - alpha - beta), np.empty(n)
    for t, z in enumerate(gaussians(seed, n).tolist()):
        r = math.sqrt(s2) * z
        out[t] = r
        s2 = omega + alpha * r * r + beta * s2
    return out


def simulated_garch(spark: SparkSession, seeds: list[int], n: int, omega: float = 2e-6, alpha: float = 0.10, beta: float = 0.85, start: float = 100.0) -> DataFrame:
    """(key, t, r, price): one series a seed, made on the executors."""
    ship_code(spark)

    def run(batches):
        for b in batches:
            for seed in b.column(0).to_pylist():
                r = garch_path(seed, n, omega, alpha, beta)
                yield pa.RecordBatch.from_arrays([pa.array([seed] * n), pa.array(np.arange(n)), pa.array(r), pa.array(start * np.cumprod(1 + r))], names=["key", "t", "r", "price"])

    return spark.createDataFrame([(s,) for s in seeds], "key long").repartition(len(seeds)).mapInArrow(run, "key long, t long, r double, price double")

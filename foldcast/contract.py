"""Terms shared by all operators: series, missing values, timing classes, errors, argument checks."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the volatility models and of sizing.
GARCH_MIN_SAMPLE = 100
GARCH_MAX_PERSISTENCE = 0.9999
SMALLEST_NORMAL = 2.2250738585072014e-308
LARGEST_COUNT = 2**63 - 1

#: Statuses of many-series operators, where one bad series must not end the job.
OK, INVALID, OUT_OF_DOMAIN = 0, 1, 4

PREDICTIVE, CONTEMPORANEOUS, FORWARD = "predictive", "contemporaneous", "forward"


class DomainError(ValueError):
    """The arguments are valid, but the question has no answer for these data."""


@dataclass(frozen=True)
class SeriesSpec:
    """How rows form series: ``key`` columns tell series apart, ``order`` columns order rows within one.

    Rows with equal order make results depend on chance; ``check_order`` refuses them.
    """

    key: tuple[str, ...]
    order: tuple[str, ...]

    @staticmethod
    def of(key: str | list[str] | None, order: str | list[str]) -> SeriesSpec:
        as_tuple = lambda x: () if x is None else (x,) if isinstance(x, str) else tuple(x)
        if not as_tuple(order):
            raise ValueError("a series needs an order column")
        return SeriesSpec(as_tuple(key), as_tuple(order))

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def trailing(self, rows: int) -> WindowSpec:
        return self.window().rowsBetween(1 - rows, 0)

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def whole(self) -> WindowSpec:
        """All rows of the series: less what is running, what follows (a frame that follows each row is made anew for each)."""
        return Window.partitionBy(*self.key)

    def ahead(self, rows: int) -> WindowSpec:
        return self.window().rowsBetween(0, rows - 1)


def check_order(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``df`` if no two rows of a series have equal order; else an error. Runs a job."""
    twice = df.groupBy(*spec.key, *spec.order).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"rows of one series share an order: {twice[0].asDict()}")
    return df


def check_same_rows(a: DataFrame, b: DataFrame, on: list[str]) -> None:
    """An error unless both frames have the same rows by ``on``. Runs two jobs."""
    for x, y in ((a, b), (b, a)):
        if x.join(y, on, "left_anti").limit(1).count():
            raise ValueError(f"the frames differ in their rows by {on}")


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def numeric(df: DataFrame, *names: str) -> None:
    """An error unless the columns are numeric or boolean."""
    for n in names:
        if not isinstance(df.schema[n].dataType, (T.NumericType, T.BooleanType)):
            raise TypeError(f"column {n} is {df.schema[n].dataType.simpleString()}, not numeric")


def count(value: object, name: str, least: int = 0) -> int:
    """A whole number of at least ``least``."""
    whole = hasattr(value, "__index__") or isinstance(value, float) and value.is_integer()
    if isinstance(value, bool) or not whole:
        raise TypeError(f"{name} is no whole number: {value!r}")
    out = int(value)  # type: ignore[call-overload]
    if not least <= out <= LARGEST_COUNT:
        raise ValueError(f"{name} must be at least {least}: {out}")
    return out


def positive(value: float, name: str) -> float:
    """A finite number over zero."""
    out = float(value)
    if not 0 < out < float("inf"):
        raise ValueError(f"{name} must be finite and over 0: {value!r}")
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, read from the session.

    Only a session in one process may lack it; it gets a folder of its own, which its executors see too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foldcast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def timed(c: Column, name: str, timing: str, ahead: int | None = None) -> Column:
    """The column under a name, with its timing class as metadata.

    ``ahead`` is how many periods it must be lagged by until it is known before its own period.
    """
    least = {PREDICTIVE: 0, CONTEMPORANEOUS: 1, FORWARD: 1}[timing]
    return c.alias(name, metadata={"timing": timing, "ahead": least if ahead is None else ahead})


def timing_of(df: DataFrame, name: str) -> str | None:
    return (df.schema[name].metadata or {}).get("timing")


def reach_of(df: DataFrame, *names: str) -> tuple[str, int]:
    """Class and ``ahead`` of what is made of these columns of the same rows and earlier ones: the latest known decides.

    A column without a class counts as contemporaneous.
    """
    each = [(df.schema[n].metadata or {}) for n in names]
    each = [(m.get("timing", CONTEMPORANEOUS), int(m.get("ahead", 0 if m.get("timing") == PREDICTIVE else 1))) for m in each]
    return max(each, key=lambda x: (x[1], x[0] == FORWARD))


def lagged(timing: str, ahead: int, periods: int) -> tuple[str, int]:
    """Class and ``ahead`` after a lag: what looks ahead stays so until it is lagged by all it looks ahead."""
    left = ahead - periods
    return (timing, left) if left > 0 else (PREDICTIVE, max(left, 0))


def with_timed(df: DataFrame, c: Column, name: str, timing: str, ahead: int | None = None) -> DataFrame:
    """``df`` with one more column (or that one replaced)."""
    return df.select(*[F.col(f"`{x}`") for x in df.columns if x != name], timed(c, name, timing, ahead))


def declared(df: DataFrame, name: str, timing: str) -> DataFrame:
    """``df`` whose column has this class, on the caller's word: for columns that expressions made, which have none."""
    if timing not in (PREDICTIVE, CONTEMPORANEOUS, FORWARD):
        raise ValueError(f"no timing class: {timing!r}")
    return df.select(*[timed(F.col(f"`{x}`"), x, timing) if x == name else F.col(f"`{x}`") for x in df.columns])

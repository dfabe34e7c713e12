"""A GARCH(1,1) model as an object: fitted or built by hand, applied to frames of any number of series."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import GARCH_MAX_PERSISTENCE, PREDICTIVE, DomainError, SeriesSpec, count, with_timed
from ..functions import garch as G
from . import fits, kernels, recurrences


@dataclass(frozen=True)
class GarchModel:
    """Parameters and state. A model built by hand has no state until sigma2_next is given."""

    omega: float
    alpha: float
    beta: float
    sigma2_next: float = 0.0
    loglik: float = math.nan
    converged: bool = False
    backcast: float = 0.0

    def __post_init__(self):
        if not (0 < self.omega < math.inf and self.alpha >= 0 and self.beta >= 0 and self.alpha + self.beta < GARCH_MAX_PERSISTENCE):
            raise ValueError("omega must be over 0, alpha and beta at least 0, their sum under 0.9999")

    @staticmethod
    def fit(df: DataFrame, r: str, order: list[str]) -> GarchModel:
        """The maximum likelihood model of one series."""
        return GarchModel(**fits.garch_fit_one(df, r, order))

    @property
    def persistence(self) -> float:
        return G.persistence_of(self.alpha, self.beta)

    @property
    def unconditional_variance(self) -> float:
        return G.variance_of(self.omega, self.persistence)

    @property
    def unconditional_vol(self) -> float:
        return math.sqrt(self.unconditional_variance)

    @property
    def half_life(self) -> float:
        return G.half_life_of(math.log(self.persistence)) if self.persistence > 0 else 0.0

    def filter(self, df: DataFrame, r: str, spec: SeriesSpec, out: str = "garch_vol") -> DataFrame:
        """Forecasts before each return, from the backcast (0: the unconditional variance) on."""
        return recurrences.garch_filter(df, r, spec, self._dict(), out)

    def filter_from(self, df: DataFrame, r: str, spec: SeriesSpec, sigma2_first: float | None = None, out: str = "garch_vol") -> DataFrame:
        """Forecasts of a continuation, whose first variance is sigma2_first (default: sigma2_next)."""
        first = self.sigma2_next if sigma2_first is None else float(sigma2_first)
        if not 0 < first < math.inf:
            raise ValueError("the first variance must be finite and over 0")
        return recurrences.garch_filter(df, r, spec, self._dict() | {"sigma2_next": first}, out, resume=True)

    def forecast(self, spark: SparkSession, horizon: int) -> DataFrame:
        """(h, vol): volatility of the next periods, h from 0."""
        h = count(horizon, "horizon", 1)
        if not 0 < self.sigma2_next < math.inf:
            raise DomainError("no forecast without a current variance")
        vol = kernels.garch_forecast(self.omega, self.alpha, self.beta, self.sigma2_next, min(h, 2))  # refuses what is not finite
        u, p = self.unconditional_variance, self.persistence
        rows = spark.range(h).withColumnRenamed("id", "h")
        s2 = F.lit(u) + F.pow(F.lit(p), F.col("h").cast("double")) * F.lit(float(vol[0]) ** 2 - u)
        return with_timed(rows, F.sqrt(s2), "vol", PREDICTIVE)

    def _dict(self) -> dict:
        return {"omega": self.omega, "alpha": self.alpha, "beta": self.beta, "sigma2_next": self.sigma2_next, "backcast": self.backcast}

"""Row-local functions: plain Catalyst expressions."""

from .scalars import (
    complete_cases,
    garman_klass_vol,
    half_life,
    is_finite,
    log_return,
    normalise,
    parkinson_vol,
    period_vol,
    persistence,
    register_sql,
    risk_cap_position,
    simple_return,
    unconditional_variance,
    unconditional_vol,
    usable,
    valid_garch,
    vol_target_position,
)

__all__ = ["complete_cases", "garman_klass_vol", "half_life", "is_finite", "log_return", "normalise", "parkinson_vol", "period_vol", "persistence", "register_sql", "risk_cap_position", "simple_return", "unconditional_variance", "unconditional_vol", "usable", "valid_garch", "vol_target_position"]

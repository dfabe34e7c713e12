"""Quantities of a GARCH(1,1) model, one definition for numbers and columns alike."""

from __future__ import annotations

import math

LOG_HALF = math.log(0.5)


def persistence_of(alpha, beta):
    return alpha + beta


def variance_of(omega, persistence):
    """The unconditional variance, for a persistence other than 1."""
    return omega / (1 - persistence)


def half_life_of(log_persistence):
    """Periods until a shock has halved, from the logarithm of a persistence between 0 and 1."""
    return LOG_HALF / log_persistence

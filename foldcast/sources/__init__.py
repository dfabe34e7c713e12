"""Sources: OHLC files, bars from orders and ticks, simulated series."""

from .bars import bad_bars, daily_bars, event_ticks, tick_bars
from .readers import read_column, read_ohlc
from .simulate import simulated_garch

__all__ = ["bad_bars", "daily_bars", "event_ticks", "read_column", "read_ohlc", "simulated_garch", "tick_bars"]

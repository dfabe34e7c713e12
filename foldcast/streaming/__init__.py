"""Structured Streaming forms: bars with watermarks, and the recurrences as stateful operators."""

from .stateful import replay_ewma, stream_bars, stream_ewma, stream_garch

__all__ = ["replay_ewma", "stream_bars", "stream_ewma", "stream_garch"]

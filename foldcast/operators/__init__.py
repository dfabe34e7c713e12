"""Operators on series: windows, recurrences, fits, folds."""

"""Operators: functions from DataFrames to DataFrames, grouped by the kind of work."""

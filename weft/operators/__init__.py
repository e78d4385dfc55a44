"""Operators: functions from DataFrames to DataFrames with plain column-name parameters."""

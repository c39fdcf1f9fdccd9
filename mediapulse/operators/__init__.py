"""Operators: functions from DataFrames to DataFrames with the usual settings as keyword defaults."""

"""Operators: functions from DataFrames to a DataFrame, without actions unless their docstring says so."""

"""Operators: functions from input DataFrames to result DataFrames."""

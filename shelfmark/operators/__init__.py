"""Operators of the library: functions from DataFrame to DataFrame."""

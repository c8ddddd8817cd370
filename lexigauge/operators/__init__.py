"""Operators: functions from DataFrame to DataFrame, lazy unless their name says they write."""

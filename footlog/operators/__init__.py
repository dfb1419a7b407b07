"""Operators: functions from a Scope (or tables) to a lazy DataFrame."""

"""Operators on ticks: pure functions from DataFrame to DataFrame."""

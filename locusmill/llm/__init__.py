"""Operators of the training-data pipeline tagged llm; nothing outside this package imports it."""

"""Operators of a training-data pipeline; nothing outside imports this package but the driver entry."""

"""Operators of a training-data pipeline over document and embedding tables. Nothing else in the package imports this."""

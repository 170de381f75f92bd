"""Operators of a training-data pipeline on text. Nothing else in the package imports them."""

"""Pipelines: features, training, forecasts, back-tests and evaluation."""

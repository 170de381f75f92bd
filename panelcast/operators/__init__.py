"""Operators on DataFrames: cleaning, joins, resampling, windows, labels, forecasts, scores."""

"""Panel time-series analytics on Spark: ingest, resample, features, labels, forecasts, scores."""

"""A Spark engine for hourly and daily time series: shaping, features, baselines, forecasts and their evaluation."""

"""Spark jobs over market bars: cleaning, features, statistics, forecasts, risk, signals, back-tests and validation."""

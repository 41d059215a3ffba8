"""Forecast accuracy on Spark: archive of forecast runs, revisable actuals, accuracy by horizon."""

"""plans of the forecast-accuracy engine."""

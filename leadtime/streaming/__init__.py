"""streaming of the forecast-accuracy engine."""

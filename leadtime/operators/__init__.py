"""operators of the forecast-accuracy engine."""

"""sources of the forecast-accuracy engine."""

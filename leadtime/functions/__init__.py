"""functions of the forecast-accuracy engine."""

"""Uplift analytics, propensity matching and daily sales forecasts as Spark jobs."""

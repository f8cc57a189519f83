"""Inpatient arrivals, length-of-stay and census forecasting on Spark DataFrames."""

from wardcast.config import ForecastConfig, SiteCodes

__all__ = ["ForecastConfig", "SiteCodes"]

"""tallycast: demand analytics and forecasting as Spark DataFrame transformations."""

from tallycast.config import EngineConfig, Filters

__all__ = ["EngineConfig", "Filters"]

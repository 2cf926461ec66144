"""A text-encoding engine on Spark: configurable pipelines from text to token encodings and back, as DataFrame transformations."""

from .plans.config import AddedToken, ConfigError
from .plans.engine import Engine

__all__ = ["AddedToken", "ConfigError", "Engine"]

"""Price-intelligence analytics expressed as Spark DataFrame plans."""

from .session import configure, get_spark
from .sources.catalog import Tables

__all__ = ["Tables", "configure", "get_spark"]

"""Querying HTML and XML documents at table scale: XPath compiled to Spark plans."""

from .version import __version__, build_info, check_spark_version, is_compatible

__all__ = ["__version__", "build_info", "check_spark_version", "is_compatible"]

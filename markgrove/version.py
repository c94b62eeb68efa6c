"""Version constants and checks."""

from __future__ import annotations

import platform

__version__ = "0.1.0"
API_VERSION = "1"
MINIMUM_SPARK = (4, 0)


def build_info() -> dict[str, str]:
    import pyspark

    return {"version": __version__, "api_version": API_VERSION, "spark_version": pyspark.__version__, "python_version": platform.python_version()}


def is_compatible(version: str) -> bool:
    """Whether code written for ``version`` runs with this one: the same major version, and not a later one."""
    try:
        wanted = tuple(int(x) for x in version.lstrip("v").split("."))
    except ValueError:
        return False
    own = tuple(int(x) for x in __version__.split("."))
    return wanted[:1] == own[:1] and wanted <= own


def check_spark_version() -> bool:
    import pyspark

    return tuple(int(x) for x in pyspark.__version__.split(".")[:2]) >= MINIMUM_SPARK

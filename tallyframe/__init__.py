"""Survey and claims analytics expressed as PySpark DataFrame operators."""

from tallyframe.session import build_session

__all__ = ["build_session"]

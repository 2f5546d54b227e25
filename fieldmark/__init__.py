"""Team-contest analytics as Spark DataFrame jobs."""

from fieldmark.session import build_session

__all__ = ["build_session"]

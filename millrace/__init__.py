"""Data preparation and analytics jobs written as plain Spark DataFrame code."""

from millrace.session import build_session

__all__ = ["build_session"]

"""Ranked findings about a table."""

from millrace.operators.insights.run import insight_report, insight_table, register_insight, run_insights

__all__ = ["insight_report", "insight_table", "register_insight", "run_insights"]

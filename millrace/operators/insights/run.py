"""Run all findings over one table and rank them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame

from millrace.operators.insights import findings
from millrace.operators.insights.facts import Facts, Insight
from millrace.operators.profile import detect_schema

Finding = Callable[[Facts], Insight | None]

REGISTRY: list[Finding] = [
    findings.forecast, findings.trend, findings.top_performer, findings.correlation, findings.anomaly,
    findings.change, findings.contribution, findings.segment, findings.distribution, findings.drivers,
    findings.data_quality, findings.outlier_summary, findings.numeric_summary, findings.categorical,
]


def register_insight(finding: Finding) -> Finding:
    """Add a user's own finding to every later run."""
    REGISTRY.append(finding)
    return finding


def run_insights(df: DataFrame, schema: dict[str, Any] | None = None, top_n: int = 8) -> list[Insight]:
    """The most important findings; one per type, metric and sign, padded with profile cards."""
    facts = Facts(df, schema or detect_schema(df))
    facts.warm()
    # findings are independent Spark jobs; a few at a time keep the cluster busy
    with ThreadPoolExecutor(4) as pool:
        results = list(pool.map(lambda finding: finding(facts), REGISTRY))
    seen, found = set(), []
    for insight in results:
        if insight is None:
            continue
        sign = ("pos" if insight.meta.get("r", 0) >= 0 else "neg") if insight.type == "correlation" else ""
        key = (insight.type, insight.metric, sign)
        if key not in seen:
            seen.add(key)
            found.append(insight)
    found.sort(key=lambda i: i.importance, reverse=True)
    found = found[:top_n]
    if len(found) < top_n:
        found += findings.profile_cards(facts, {i.title for i in found}, top_n - len(found))
    return found


def insight_table(df: DataFrame, insights: list[Insight]) -> DataFrame:
    """Typed rows: text columns, the chart as label/value pairs, numbers and words as maps."""
    rows = [
        (n + 1, i.type, i.title, i.description, round(float(i.importance), 6), i.metric, i.chart,
         [(str(label), float(value)) for label, value in zip(i.labels, i.values)],
         {k: float(v) for k, v in i.meta.items()}, dict(i.note))
        for n, i in enumerate(insights)
    ]
    return df.sparkSession.createDataFrame(
        rows, "rank int, type string, title string, description string, importance double, metric string, "
              "chart string, points array<struct<label:string,value:double>>, meta map<string,double>, "
              "note map<string,string>")


_SECTIONS = (
    ("Performance", ("trend", "change"), "No significant upward or downward trends."),
    ("Key Drivers", ("contribution", "segment", "categorical", "ranking"), "No dominant categories or predictors."),
    ("Risks", ("anomaly", "outlier_summary"), "No anomalies or outlier concentrations."),
)


def insight_report(insights: list[Insight]) -> str:
    """Plain text summary in sections of at most two lines."""
    if not insights:
        return "No significant insights in this dataset."
    quality = next((i for i in insights if i.type == "data_quality"), None)
    score = 100.0 - (quality.meta.get("overall_pct", 0.0) if quality else 0.0)
    band = next(w for limit, w in ((95, "Excellent"), (85, "Good"), (70, "Fair"), (-1, "Needs Attention")) if score >= limit)
    lines = ["Executive Summary", "-----------------", "Data Quality:", f"- Completeness Score: {score:.1f}% ({band})"]
    for title, kinds, empty in _SECTIONS:
        texts = [i.description for i in insights if i.type in kinds] or [empty]
        lines += ["", f"{title}:", *[f"- {t}" for t in texts[:2]]]
    return "\n".join(lines)

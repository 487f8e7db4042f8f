"""Step lists over one table: filter, group, derive, sort, rename and drop."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

from millrace.functions.formula import derive
from millrace.operators.aggregates import group_aggregate
from millrace.operators.filters import filter_rules
from millrace.operators.shape import drop_columns, rename, sort_rows

Step = dict[str, Any]

_STEPS: dict[str, Callable[[DataFrame, Step], DataFrame]] = {
    "filter": lambda d, s: filter_rules(d, s.get("rules", [])),
    "groupby": lambda d, s: group_aggregate(d, s.get("group", []), s.get("agg"), s.get("order", ())),
    "create": lambda d, s: derive(d, s.get("name", "new_col"), s.get("formula", "")),
    "sort": lambda d, s: sort_rows(d, s.get("by", []), bool(s.get("ascending", False))),
    "rename": lambda d, s: rename(d, s.get("map", {})),
    "drop_cols": lambda d, s: drop_columns(d, s.get("cols", [])),
}


class StepError(ValueError):
    def __init__(self, position: int, step: Step, reason: str):
        super().__init__(f"step {position} ({step.get('op')!r}): {reason}")
        self.position, self.step = position, step


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Apply steps in order; the first bad step stops the run, so nothing half-done is stored."""
    for position, step in enumerate(steps):
        action = _STEPS.get(str(step.get("op") or "").lower())
        if action is None:
            raise StepError(position, step, "unknown operation")
        try:
            df = action(df, step)
        except ValueError as error:
            raise StepError(position, step, str(error)) from error
    return df


def describe_steps(steps: Sequence[Step]) -> str:
    """One line of text for a step list: every step with what it names."""
    return "; ".join(_described(s) for s in steps) or "unchanged"


# per operation: verb and the settings worth showing
_TOLD = {
    "filter": ("keep rows where", lambda s: " and ".join(f"{r.get('col')} {r.get('op', '=')} {r.get('val', '')}".strip() for r in s.get("rules", []))),
    "groupby": ("one row per", lambda s: ", ".join(s.get("group", []))),
    "create": ("add", lambda s: f"{s.get('name')} = {s.get('formula') or s.get('expr') or '...'}"),
    "sort": ("order by", lambda s: f"{s.get('by')}{'' if s.get('ascending') else ' from the top'}"),
    "rename": ("rename", lambda s: ", ".join(f"{a} to {b}" for a, b in s.get("map", {}).items())),
    "drop_cols": ("leave out", lambda s: ", ".join(s.get("cols", []))),
}


def _described(step: Step) -> str:
    verb, detail = _TOLD.get(str(step.get("op")), (str(step.get("op")), lambda s: ""))
    return f"{verb} {detail(step)}".strip()

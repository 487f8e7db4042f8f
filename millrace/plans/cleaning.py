"""Ordered lists of cleaning rules, with one log row per action, and the one-click clean."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.columns import col, cols, is_numeric, is_text, present
from millrace.functions import text as texts
from millrace.operators import (
    chained, curves, features, forest, fuzzy, impute, neighbours, ordered, outliers, splines,
)
from millrace.operators.impute import Cleaned
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.shape import drop_columns
from millrace.operators.stats import column_stats, null_counts
from millrace.session import materialize

Rule = dict[str, Any]
ROW_ID = "_row_id"


def _entry(column: str, action: str, kind: str, gaps: int = 0, rows: int = 0) -> dict[str, Any]:
    share = round(gaps / rows * 100, 1) if rows else 0.0
    return {"column": column, "missing": gaps, "pct_missing": share, "action": action, "type": kind}


def _targets(df: DataFrame, rule: Rule) -> list[str]:
    names = rule.get("columns") or ([rule["column"]] if rule.get("column") else [])
    return present(df, names)


def _drop(df: DataFrame, names: list[str], rule: Rule) -> Cleaned:
    return Cleaned(drop_columns(df, names), [_entry(n, f"Dropped column '{n}'", "drop") for n in names])


def _order(rule: Rule) -> list[str]:
    order = rule.get("order_by") or []
    return [order] if isinstance(order, str) else list(order)


def _impute(df: DataFrame, names: list[str], rule: Rule) -> Cleaned:
    method = rule.get("impute_method", "median")
    numbers = [n for n in names if is_numeric(df, n)]
    if method == "knn":
        k, weights = int(rule.get("knn_neighbors", 5)), rule.get("knn_weights", "uniform")
        key = list(rule.get("key") or [])
        base = df
        if not key:
            base, key = materialize(df.withColumn(ROW_ID, F.monotonically_increasing_id())), [ROW_ID]
        out = neighbours.impute_knn(base, numbers, key, k, weights).select(*cols(df.columns))
        return Cleaned(out, [_entry(n, f"Imputed via KNN (k={k}, weights={weights})", "fill") for n in numbers])
    if method in ("mice", "iterative"):
        rounds = int(rule.get("mice_max_iter", 10))
        out = chained.impute_mice(df, numbers, rounds, rule.get("mice_initial", "median"))
        return Cleaned(out, [_entry(n, f"Imputed via MICE (max_iter={rounds})", "fill") for n in numbers])
    rows, gaps = null_counts(df, names)
    names = [n for n in names if gaps[n]]

    def logged(action: str, done: Sequence[str], kind: str = "fill") -> list[dict[str, Any]]:
        return [_entry(n, action, kind, gaps[n], rows) for n in done]

    if method in ("ffill", "bfill"):
        limit = int(rule["fill_limit"]) if rule.get("fill_limit") else None
        out = ordered.fill(df, names, _order(rule), rule.get("partition_by") or (), method == "ffill", limit)
        word = "Forward" if method == "ffill" else "Backward"
        return Cleaned(out, logged(f"{word}-filled values (limit={limit})", names))
    if method == "interpolate":
        names = [n for n in names if n in numbers]
        how = rule.get("interp_method", "linear")
        part = rule.get("partition_by") or ()
        if how == "spline":
            out = splines.interpolate_spline(df, names, _order(rule), part)
        elif how == "polynomial":
            out = curves.interpolate_curve(df, names, _order(rule), part, int(rule.get("interp_order", 2)))
        else:
            out = ordered.interpolate(df, names, _order(rule), part, rule.get("limit_direction", "both"))
        return Cleaned(out, logged(f"Interpolated ({how})", names))
    if method == "drop_rows":
        return Cleaned(impute.drop_missing(df, names), logged("Dropped rows with missing values", names, "drop"))
    values = impute.fill_value(df, names, method, **rule)
    labels = {"mean": "Mean", "median": "Median", "mode": "Mode", "zero": "", "constant": "Constant"}
    log = []
    for name, value in values.items():
        shown = f"{value:.4g}" if isinstance(value, float) else repr(value)
        log.append(_entry(name, f"Filled with {labels[method]} ({shown})", "fill", gaps[name], rows))
    return Cleaned(impute.fill_constants(df, values), log)


def _outlier(df: DataFrame, names: list[str], rule: Rule) -> Cleaned:
    method, action = rule.get("outlier_method", "iqr"), rule.get("outlier_action", "clip")
    names = [n for n in names if is_numeric(df, n)]
    if not names:
        return Cleaned(df)
    if method == "isolation_forest":
        share, trees = float(rule.get("iso_contamination", 0.05)), int(rule.get("iso_estimators", 100))
        out = forest.treat_isolated(df, names, share, trees, action)
        return Cleaned(out, [_entry(", ".join(names), f"Isolation forest: {action} of {share:.0%} of rows", "outlier")])
    options = {k: v for k, v in rule.items() if v is not None}
    groups = [[n] for n in names] if action == "drop_rows" else [names]
    log = []
    for group in groups:
        found = outliers.fences(df, group, method, **options)
        counts = outliers.count_outside(df, found)
        found = {n: f for n, f in found.items() if counts[n]}
        df = outliers.treat(df, found, action)
        log += [_entry(n, f"{action} of {counts[n]} outliers by {method}", "outlier") for n in found]
    return Cleaned(df, log)


def _scale(df: DataFrame, names: list[str], rule: Rule) -> Cleaned:
    method = rule.get("scaler_method", "robust")
    out = features.scale(
        df, names, method, float(rule.get("quantile_low", 25.0)), float(rule.get("quantile_high", 75.0)),
        float(rule.get("scale_min", 0.0)), float(rule.get("scale_max", 1.0)))
    return Cleaned(out, [_entry(n, f"Scaled by {method}", "scale") for n in names if is_numeric(df, n)])


def _encode(df: DataFrame, names: list[str], rule: Rule) -> Cleaned:
    method, log = rule.get("encode_method", "onehot"), []
    if method == "ordinal":
        return Cleaned(features.ordinal(df, names), [_entry(n, "Ordinal encoded", "encode") for n in names])
    for name in names:
        wide = features.one_hot(df, name, bool(rule.get("drop_first")), float(rule.get("min_freq") or 0.0))
        log.append(_entry(name, f"One-hot encoded into {len(wide.columns) - len(df.columns) + 1} column(s)", "encode"))
        df = wide
    return Cleaned(df, log)


def _text(df: DataFrame, names: list[str], rule: Rule) -> Cleaned:
    log = []
    for name in names:
        if not is_text(df, name):
            continue
        value = texts.change_case(col(name), rule.get("text_case", "trim"))
        log.append(_entry(name, f"Text case: {rule.get('text_case', 'trim')}", "normalize"))
        if rule.get("regex_pattern"):
            value = texts.replace_pattern(value, rule["regex_pattern"], rule.get("regex_replacement", ""))
            log.append(_entry(name, f"Replaced /{rule['regex_pattern']}/", "normalize"))
        if rule.get("pii_mask"):
            entities = rule.get("pii_entities", ["email", "phone"])
            value = texts.mask_personal_data(value, entities, rule.get("pii_order", texts.PII_ORDER))
            log.append(_entry(name, f"Masked {', '.join(entities)}", "normalize"))
        df = df.withColumn(name, value)
        if rule.get("fuzzy_dedupe"):
            threshold = float(rule.get("fuzzy_threshold", 0.85))
            df = fuzzy.fuzzy_dedupe(df, name, threshold)
            log.append(_entry(name, f"Merged labels with similarity of {threshold:.0%} or more", "normalize"))
    return Cleaned(df, log)


def _cast(df: DataFrame, names: list[str], rule: Rule) -> Cleaned:
    target = rule.get("cast_type", "float")
    return Cleaned(features.cast_lenient(df, names, target), [_entry(n, f"Cast to {target}", "cast") for n in names])


_ACTIONS = {"drop": _drop, "impute": _impute, "outlier": _outlier, "scale": _scale, "encode": _encode,
            "text": _text, "normalize": _text, "cast": _cast}


# methods that look at each column alone and keep all rows, so one pass can serve several columns
_APART = {"impute": ("mean", "median", "mode", "zero", "constant", "trimmed_mean"), "scale": None, "cast": None}


def _settings(rule: Rule) -> dict[str, Any] | None:
    """What two rules must share to run as one; None for rules that run alone."""
    action = rule.get("action_type")
    if action == "outlier":
        apart = rule.get("outlier_method", "iqr") != "isolation_forest" and rule.get("outlier_action", "clip") != "drop_rows"
    else:
        allowed = _APART.get(action, ())
        apart = allowed is None or rule.get("impute_method", "median") in allowed
    return {k: v for k, v in rule.items() if k not in ("column", "columns")} if apart else None


def _together(rules: Sequence[Rule]) -> list[Rule]:
    """Neighbouring rules that differ in their columns only, as one rule over all of these."""
    out: list[Rule] = []
    for rule in rules:
        names = list(rule.get("columns") or ([rule["column"]] if rule.get("column") else []))
        shared = _settings(rule)
        before = out[-1] if out else None
        if before and shared is not None and _settings(before) == shared and not set(names) & set(before["columns"]):
            out[-1] = before | {"columns": [*before["columns"], *names]}
        else:
            out.append({k: v for k, v in rule.items() if k != "column"} | {"columns": names})
    return out


def _costly(rule: Rule) -> bool:
    """Whether a rule leaves joins or windows behind, which later statistics would compute again."""
    action = rule.get("action_type")
    if action == "impute":
        return rule.get("impute_method") in ("knn", "mice", "iterative", "ffill", "bfill", "interpolate")
    if action == "outlier":
        return rule.get("outlier_method") == "isolation_forest"
    return action == "encode" and rule.get("encode_method") == "ordinal" or bool(rule.get("fuzzy_dedupe"))


def clean_rules(df: DataFrame, rules: Sequence[Rule]) -> Cleaned:
    """Apply rules in order; a rule whose columns are all absent is skipped.

    Neighbours of one kind share their statistics pass, and what a costly rule made is checkpointed if a
    later rule asks for statistics, so work does not grow with the square of the rules.
    """
    log: list[dict[str, Any]] = []
    steps = _together(rules)
    for place, rule in enumerate(steps):
        names = _targets(df, rule)
        if not names:
            continue
        action = rule.get("action_type")
        if action not in _ACTIONS:
            raise ValueError(f"unknown cleaning action {action!r}")
        step = _ACTIONS[action](df, names, rule)
        df, log = step.df, log + step.log
        if _costly(rule) and any(r.get("action_type") in ("impute", "outlier", "scale", "encode") for r in steps[place + 1:]):
            df = materialize(df)
    return Cleaned(df, log or [_entry("Dataset", "No rule changed the table", "info")])


def clean_auto(df: DataFrame, flag: bool = False) -> tuple[Cleaned, dict[str, int]]:
    """Automatic imputation, then structural clean-up; returns row and column counts as well."""
    filled = impute.impute_auto(df, flag)
    rows = filled.rows
    out, actions, kept = features.structural_clean(filled.df)
    log = filled.log + [_entry("Dataset", a, "structure") for a in actions]
    stats = {"original_rows": rows, "cleaned_rows": kept, "rows_removed": rows - kept,
             "original_cols": len(df.columns), "cleaned_cols": len(out.columns),
             "cols_removed": len(df.columns) - len(out.columns),
             "imputed_columns_count": sum(e["type"] == "fill" for e in filled.log)}
    return Cleaned(out, log), stats


def _summary(df: DataFrame, name: str, numeric: bool) -> dict[str, float | None]:
    rows, gaps = null_counts(df, [name])
    out: dict[str, float | None] = {"nulls": gaps[name], "null_pct": round(gaps[name] / max(rows, 1) * 100, 1)}
    if numeric and is_numeric(df, name):
        s = column_stats(df, [name])[name]
        if s.known:
            middle = exact_quantiles(df, {name: [0.5]}, rows)[name][0]
            values = {"mean": s.mean, "median": middle, "std": s.std or 0.0, "min": s.low, "max": s.high}
            out |= {k: round(v, 4) for k, v in values.items()}
    return out


def rule_diff(df: DataFrame, rule: Rule, key: Sequence[str], sample: int = 1000) -> dict[str, Any]:
    """Effect of one rule on the first rows of a key order: statistics and a row-level diff."""
    names = _targets(df, rule)
    if not names:
        raise ValueError("target columns not found")
    name = names[0]
    before = df.orderBy(*cols(key)).limit(sample)
    numeric = is_numeric(df, name)
    after = clean_rules(before, [rule | {"key": list(key), "order_by": rule.get("order_by") or list(key)}]).df
    if name not in after.columns:
        return {"column": name, "before": _summary(before, name, numeric), "after": None, "diff": None}
    left = before.select(*cols(key), col(name).cast("string").alias("before"))
    right = after.select(*cols(key), col(name).cast("string").alias("after"), F.lit(True).alias("_kept"))
    diff = left.join(right, list(key), "left").select(
        *cols(key), "before", F.when(F.col("_kept"), F.col("after")).otherwise("REMOVED").alias("after"),
        (~F.col("before").eqNullSafe(F.col("after")) | F.col("_kept").isNull()).alias("changed"))
    return {"column": name, "before": _summary(before, name, numeric), "after": _summary(after, name, numeric),
            "diff": diff}

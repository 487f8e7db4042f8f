"""The findings: each takes the shared facts and returns an insight, or None when nothing stands out."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from millrace.columns import as_double, col, is_numeric, micros
from millrace.functions.formats import precise_value, short_value
from millrace.operators import charts, series
from millrace.operators.forecast import forecast_table
from millrace.operators.hypothesis import numeric_correlations
from millrace.operators.insights.facts import Facts, Insight, clamp
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.stats import pearson
from millrace.session import materialize

# fixed values: limits below which a finding is not shown
TREND_MIN, CHANGE_MIN, CORRELATION_MIN, Z_LIMIT = 0.005, 5.0, 0.55, 2.8


def trend(f: Facts, always: bool = False) -> Insight | None:
    """Mean day-over-day change of the first metric; ``always`` reports it however small it is or few the rows."""
    if not f.date or not f.metrics or (not always and f.rows < 4):
        return None
    metric = f.metrics[0]
    days = materialize(series.daily_sums(f.df, f.date, metric))  # a row per day
    moved = series.pct_change(days)
    mean = moved.agg(F.avg("pct_change")).first()[0]
    if mean is None or (not always and abs(mean) < TREND_MIN):
        return None
    last = days.orderBy(F.desc("period")).limit(30).collect()[::-1]
    word, verb = ("upward", "increasing") if mean > 0 else ("downward", "decreasing") if mean < 0 else ("even", "changing")
    return Insight(
        "trend", f"{metric} Trend",
        f"'{metric}' shows an {word} trend, {verb} by {round(abs(mean) * 100, 1)}% per day on average.",
        clamp(abs(mean) * 2), metric, "line", [str(r["period"]) for r in last], [r["value"] for r in last],
        {"trend": mean})


def change(f: Facts) -> Insight | None:
    """Mean of the later half of the rows against the earlier half.

    The halves meet at the n//2-th row by date, found as an order statistic; rows with that very
    date are shared out between the halves in proportion.
    """
    if not f.metrics or f.rows < 10 or not f.date:
        return None
    metric = f.metrics[0]
    v = as_double(f.df, metric)
    timed = f.df.where(col(f.date).isNotNull()).select(micros(f.df, f.date).cast("double").alias("t"), v.alias("v"))
    n = timed.count()
    if n < 2:
        return None
    half = n // 2
    edge = exact_quantiles(timed, {"t": [half / (n - 1)]}, n)["t"][0]
    t = F.col("t")
    row = timed.agg(
        F.sum(F.when(t < edge, F.col("v"))).alias("s0"), F.count(F.when(t < edge, F.col("v"))).alias("n0"),
        F.sum(F.when(t == edge, F.col("v"))).alias("s1"), F.count(F.when(t == edge, F.col("v"))).alias("n1"),
        F.sum(F.when(t > edge, F.col("v"))).alias("s2"), F.count(F.when(t > edge, F.col("v"))).alias("n2"),
        F.count_if(t < edge).alias("r0"), F.count_if(t == edge).alias("r1")).first()
    share = (half - row["r0"]) / row["r1"]
    s1, n1 = row["s1"] or 0.0, row["n1"]
    early_n, late_n = row["n0"] + n1 * share, row["n2"] + n1 * (1 - share)
    if not early_n or not late_n:
        return None
    early = ((row["s0"] or 0.0) + s1 * share) / early_n
    late = ((row["s2"] or 0.0) + s1 * (1 - share)) / late_n
    if early == 0:
        return None
    pct = (late - early) / abs(early) * 100
    if abs(pct) < CHANGE_MIN:
        return None
    word = "an increase" if pct > 0 else "a decrease"
    return Insight(
        "change", f"{metric} Period Change",
        f"'{metric}' moved from an average of {precise_value(metric, early)} to {precise_value(metric, late)}, "
        f"{word} of {abs(pct):.1f}% between the earlier and the later half.",
        clamp(abs(pct) / 100), metric, "bar", ["Previous Period", "Current Period"],
        [round(early, 4), round(late, 4)], {"change_pct": round(pct, 2)})


def _ranked_groups(f: Facts, dimension: str, metric: str, n: int):
    groups = f.group(dimension, metric)
    totals = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("all")).first()
    top = groups.orderBy(F.desc("total"), "label").limit(n).collect()
    return totals["n"], totals["all"] or 0.0, top


def top_performer(f: Facts) -> Insight | None:
    """Share of the leading category in the total."""
    if not f.dimensions or not f.metrics:
        return None
    dimension, metric = f.dimensions[0], f.metrics[0]
    n, total, top = _ranked_groups(f, dimension, metric, 8)
    if n < 2 or total == 0:
        return None
    pct = round(top[0]["total"] / total * 100, 1)
    return Insight(
        "ranking", f"Top {dimension}",
        f"'{top[0]['label']}' leads '{dimension}' with {pct}% ({precise_value(metric, top[0]['total'])}) of the total "
        f"'{metric}' ({precise_value(metric, total)}).",
        clamp(pct / 100 * 1.5), metric, "bar", [r["label"] for r in top], [r["total"] for r in top], {"share_pct": pct})


def contribution(f: Facts) -> Insight | None:
    """Percent of the total per value of the second dimension (the first when there is one)."""
    if not f.dimensions or not f.metrics:
        return None
    dimension, metric = f.dimensions[min(1, len(f.dimensions) - 1)], f.metrics[0]
    n, total, top = _ranked_groups(f, dimension, metric, 6)
    if n < 2 or total == 0:
        return None
    shares = [round(r["total"] / total * 100, 1) for r in top]
    return Insight(
        "contribution", f"{metric} Breakdown by {dimension}",
        f"'{top[0]['label']}' contributes {shares[0]}% ({precise_value(metric, top[0]['total'])}) of '{metric}' "
        f"({precise_value(metric, total)}) across '{dimension}'.",
        clamp(shares[0] / 100), metric, "bar", [r["label"] for r in top], shares, {"top_pct": shares[0]})


def segment(f: Facts) -> Insight | None:
    """Ratio of the best to the worst mean of a dimension with 2 to 20 values."""
    if not f.dimensions or not f.metrics:
        return None
    dimension, metric = f.dimensions[0], f.metrics[0]
    if not 2 <= f.level_counts.get(dimension, 0) <= 20:
        return None
    means = f.group(dimension, metric).where("mean IS NOT NULL").orderBy(F.desc("mean"), "label").collect()
    if len(means) < 2 or means[-1]["mean"] == 0:
        return None
    best, worst = means[0], means[-1]
    ratio = round(best["mean"] / worst["mean"], 1)
    return Insight(
        "segment", f"{metric} by {dimension}",
        f"'{best['label']}' has the highest average '{metric}' ({precise_value(metric, best['mean'])}), {ratio}× that "
        f"of '{worst['label']}' ({precise_value(metric, worst['mean'])}).",
        clamp(min(ratio / 10, 0.9)), metric, "bar", [r["label"] for r in means], [r["mean"] for r in means],
        {"ratio": ratio})


def correlation(f: Facts) -> Insight | None:
    """The strongest pair that stays significant after control of the false discovery rate."""
    if len(f.metrics) < 2:
        return None
    complete = f.df.dropna(subset=f.metrics)
    tests = [t for t in numeric_correlations(complete, f.metrics)
             if t.significant and t.effect_size >= CORRELATION_MIN]
    if not tests:
        return None
    best = tests[0]
    strength = "strong" if best.effect_size >= 0.85 else "moderate" if best.effect_size >= 0.65 else "weak"
    sign = "positive" if best.statistic > 0 else "negative"
    x, y = as_double(complete, best.column_a), as_double(complete, best.column_b)
    points = complete.select(x.alias("x"), y.alias("y")).orderBy(F.xxhash64("x", "y")).limit(300).collect()
    return Insight(
        "correlation", f"Correlation: {best.column_a} ↔ {best.column_b}",
        f"A {strength} {sign} relationship between '{best.column_a}' and '{best.column_b}' (r = {best.statistic:.3f}, "
        f"q = {best.q_value:.4g}, p = {best.p_value:.4g}); {len(tests)} of the scanned pairs are significant.",
        clamp(best.effect_size), best.column_a, "scatter", [str(p["x"]) for p in points], [p["y"] for p in points],
        {"r": round(best.statistic, 4), "q_value": best.q_value, "p_value": best.p_value,
         "effect_size": round(best.effect_size, 4)})


def anomaly(f: Facts) -> Insight | None:
    """Values outside the IQR fences or more than 2.8 deviations from the mean."""
    if not f.metrics:
        return None
    metric = f.metrics[0]
    s = f.stats[metric]
    if s.known < 10:
        return None
    low, high = f.fences(metric)
    v = as_double(f.df, metric)
    spread = s.std if s.std else 1.0
    score = F.abs((v - s.mean) / spread)
    by_iqr = (v < low) | (v > high)
    by_z = score > Z_LIMIT if s.std else F.lit(False)
    label = col(f.date).cast("string") if f.date else v.cast("string")
    rows = f.df.select(v.alias("v"), score.alias("z"), by_iqr.alias("i"), by_z.alias("s"), label.alias("label"))
    odd = rows.where("i OR s")
    c = odd.agg(F.count(F.lit(1)).alias("n"), F.count_if("i").alias("i"), F.count_if("s").alias("s"),
                F.count_if(F.col("i") & F.col("s")).alias("both")).first()
    if not c["n"]:
        return None
    top = odd.orderBy(F.desc("z"), F.desc("v"), "label").limit(12).collect()
    worst = top[0]
    kind = "spike" if worst["v"] > s.mean else "drop"
    when = f" at {worst['label']}" if f.date else ""
    return Insight(
        "anomaly", f"{metric} Anomaly Detected",
        f"An unusual {kind} of '{metric}'{when}: {precise_value(metric, worst['v'])} lies {worst['z']:.1f} deviations "
        f"from the mean. {c['n']:,} unusual values in total.",
        clamp((worst["z"] if s.std else 0.0) / 6), metric, "bar", [str(r["label"]) for r in top], [r["v"] for r in top],
        {"n_anomalies": c["n"], "n_iqr": c["i"], "n_zscore": c["s"], "n_both": c["both"],
         "worst_value": round(worst["v"], 4), "worst_zscore": round(worst["z"] if s.std else 0.0, 3),
         "iqr_fence_lo": round(low, 4), "iqr_fence_hi": round(high, 4), "mean": round(s.mean, 4)})


def outlier_summary(f: Facts) -> Insight | None:
    """IQR sweep of all metrics."""
    if not f.metrics:
        return None
    counts = {m: n for m, n in f.outlier_counts.items() if m and n}
    if not counts:
        return Insight("outlier_summary", "Outlier Scan: No Anomalies Detected",
                       f"No values outside the usual range in {len(f.metrics)} numeric column(s).", 0.25)
    ranked = sorted(counts.items(), key=lambda p: (-p[1], f.metrics.index(p[0])))
    worst, n = ranked[0]
    rows, pct = f.outlier_counts[""], round(f.outlier_counts[""] / f.rows * 100, 1)
    low, high = f.fences(worst)
    share = round(n / f.stats[worst].known * 100, 1)
    return Insight(
        "outlier_summary", "Cross-Column Outlier Summary",
        f"{rows:,} rows ({pct}%) hold values outside the usual range in {len(ranked)} column(s); '{worst}' has the most "
        f"({n:,}, {share}%) outside [{precise_value(worst, low)}, {precise_value(worst, high)}].",
        round(min(pct / 100 + 0.3, 0.88), 3), worst, "bar_chart", [m for m, _ in ranked[:10]],
        [float(k) for _, k in ranked[:10]], {"n_outlier_rows": rows, "outlier_row_pct": pct})


def numeric_summary(f: Facts) -> Insight | None:
    """Most and least variable metric, and the widest one."""
    cv = {m: abs(s.std / s.mean) for m, s in f.stats.items() if s.std is not None and s.mean}
    if not cv:
        return None
    variable, stable = max(cv, key=cv.get), min(cv, key=cv.get)
    ranges = {m: s.high - s.low for m, s in f.stats.items() if s.known}
    widest = max(ranges, key=ranges.get)
    top = round(cv[variable] * 100, 1)
    return Insight(
        "numeric_summary", "Numeric Column Variability",
        f"Of {len(cv)} numeric column(s), '{variable}' varies most ({top}% of its mean) and '{stable}' least "
        f"({cv[stable] * 100:.1f}%); '{widest}' spans {precise_value(widest, round(ranges[widest], 2))}.",
        round(min(top / 200 + 0.35, 0.8), 3), variable, "bar_chart", list(cv), [round(v * 100, 1) for v in cv.values()],
        {"cv_pct": top, "stable_cv_pct": round(cv[stable] * 100, 1), "range_value": round(ranges[widest], 2)},
        {"most_variable": variable, "most_stable": stable, "widest_range": widest})


def distribution(f: Facts) -> Insight | None:
    """Percentiles, skewness, kurtosis and histogram of the first metric."""
    if not f.metrics:
        return None
    metric = f.metrics[0]
    s, q = f.stats[metric], f.quantiles[metric]
    if s.known < 5:
        return None
    skew, kurt = s.skew or 0.0, s.kurtosis or 0.0
    side = "right" if skew > 0 else "left"
    shape = "symmetric" if abs(skew) < 0.3 else f"slightly {side}-skewed" if abs(skew) < 1 else f"strongly {side}-skewed"
    tails = "heavy-tailed" if kurt > 1 else "light-tailed" if kurt < -1 else "normal-tailed"
    bins = charts.histogram(f.df, metric, min(20, s.known // 5 or 5)).orderBy("bin").collect()
    cv = round(s.std / abs(s.mean) * 100, 1) if s.mean and s.std is not None else None
    p10, p90, q1, q3 = (precise_value(metric, q[p]) for p in (0.1, 0.9, 0.25, 0.75))
    text = (f"The middle 80% of '{metric}' lies between {p10} and {p90}, the middle half between {q1} and {q3}; the "
            f"mean is {precise_value(metric, s.mean)}. The values are {shape} and {tails}.")
    if cv is not None:
        text += f" They vary by {cv}% of the mean."
    meta = {"mean": round(s.mean, 4), "median": round(q[0.5], 4), "std": round(s.std or 0.0, 4),
            "skewness": round(skew, 4), "kurtosis": round(kurt, 4), "q1": round(q[0.25], 4), "q3": round(q[0.75], 4),
            "p10": round(q[0.1], 4), "p90": round(q[0.9], 4)}
    return Insight("distribution", f"{metric} Distribution", text, 0.38, metric, "histogram",
                   [f"{round(b['bin_low'], 2)}" for b in bins], [float(b["n"]) for b in bins],
                   meta | ({"cv_pct": cv} if cv is not None else {}), {"skew_label": shape, "kurt_label": tails})


def entropy_table(df, names):
    """(column, entropy, levels, top value, top count) of several columns in one job."""
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("v")) for n in names])
    return entropies(df.select(F.inline(pairs)).where("v IS NOT NULL").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")))


def entropies(counts):
    """The same from a table of counts (column, v, n)."""
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.join(F.broadcast(totals), "column").groupBy("column").agg(
        F.sum(-share * F.log(share + 1e-10)).alias("entropy"), F.count(F.lit(1)).alias("levels"),
        F.min(F.struct((-F.col("n")).alias("k"), "v")).alias("top"),
    ).select("column", "entropy", "levels", F.col("top.v").alias("top_value"), (-F.col("top.k")).alias("top_count"))


def _entropies_of(f: Facts, names):
    counts = f.levels.where(F.col("dimension").isin(names)).select(F.col("dimension").alias("column"), F.col("label").alias("v"), "n")
    return {r["column"]: r for r in entropies(counts).collect()}


def categorical(f: Facts) -> Insight | None:
    """Most and least concentrated dimension by entropy."""
    names = [d for d in f.dimensions if not is_numeric(f.df, d)]
    if not names and f.dimensions:
        names = [d for d in f.dimensions if f.level_counts.get(d, 0) <= 30]
    if not names:
        return None
    rows = _entropies_of(f, names)
    if not rows:
        return None
    ordered = [n for n in names if n in rows]
    focus = min(ordered, key=lambda n: rows[n]["entropy"])
    spread = max(ordered, key=lambda n: rows[n]["entropy"])
    top = rows[focus]
    pct = round(top["top_count"] / f.rows * 100, 1)
    best = f.levels.where(F.col("dimension") == focus).orderBy(F.desc("n"), "label").limit(10).collect()
    return Insight(
        "categorical", f"Category Distribution: {focus}",
        f"'{focus}' is the most concentrated dimension: '{top['top_value']}' holds {pct}% of the rows "
        f"({top['levels']} values). '{spread}' is the most varied ({rows[spread]['levels']} values).",
        round(min(pct / 100 + 0.2, 0.85), 3), focus, "bar_chart", [r["label"] for r in best],
        [float(r["n"]) for r in best],
        {"dominant_pct": pct, "n_unique": top["levels"], "fragmented_unique": rows[spread]["levels"]},
        {"most_concentrated": focus, "dominant_value": top["top_value"], "most_fragmented": spread})


def data_quality(f: Facts) -> Insight | None:
    """Missing cells, completeness and the five worst columns."""
    rows, gaps = f.nulls
    cells = rows * len(gaps)
    if not cells:
        return None
    total = sum(gaps.values())
    pct = round(total / cells * 100, 1)
    bad = sorted(((n, g) for n, g in gaps.items() if g), key=lambda p: -p[1])
    meta = {"total_missing": total, "overall_pct": pct, "n_cols_affected": len(bad)}
    if not total:
        return Insight("data_quality", "Data Quality Assessment",
                       f"All {rows:,} rows × {len(gaps)} columns are filled; completeness 100%.", 0.3, meta=meta)
    worst, n = bad[0]
    return Insight(
        "data_quality", "Data Quality Assessment",
        f"Completeness is {round(100 - pct, 1)}%: {pct}% of the cells in {len(bad)} column(s) are missing, most in "
        f"'{worst}' ({n / rows * 100:.1f}%).",
        round(min(0.9, pct / 100 + 0.4), 3), "", "bar_chart", [k for k, _ in bad[:5]], [float(v) for _, v in bad[:5]], meta)


def drivers(f: Facts) -> Insight | None:
    """Given feature importance, else correlation with the first metric."""
    given = f.schema.get("feature_importance")
    first = f.metrics[0] if f.metrics else ""
    if given:
        ranked = sorted(given.items(), key=lambda p: -p[1])
        return Insight("ranking", "Key Drivers", f"Top predictors: {', '.join(n for n, _ in ranked[:3])}.", 0.75, first,
                       "bar", [n for n, _ in ranked[:8]], [float(v) for _, v in ranked[:8]])
    if len(f.metrics) < 2:
        return None
    complete = f.df.dropna(subset=f.metrics)
    row = complete.agg(*[F.abs(pearson(as_double(f.df, first), as_double(f.df, m))) for m in f.metrics[1:]]).first()
    ranked = sorted(((m, v) for m, v in zip(f.metrics[1:], row) if v is not None and not math.isnan(v)),
                    key=lambda p: -p[1])[:8]
    if not ranked:
        return None
    return Insight("ranking", "Key Drivers",
                   f"Key drivers of {first} by correlation: {', '.join(n for n, _ in ranked[:3])}.", 0.5, first, "bar",
                   [n for n, _ in ranked], [v for _, v in ranked])


def forecast(f: Facts) -> Insight | None:
    """Projection of the first metric over the usual horizon."""
    if not f.date or not f.metrics or f.rows < series.MIN_POINTS:
        return None
    metric = f.metrics[0]
    letter = series.infer_frequency(f.df, f.date)
    table = series.resample(f.df, f.date, metric, letter)
    past = series.summarize(table).first()
    if past is None or past["n_points"] < series.MIN_POINTS:
        return None
    ahead = forecast_table(table, letter).orderBy("step").collect()
    if not ahead:
        return None
    last, end = past["end_val"], ahead[-1]["point"]
    growth = (end - last) / abs(last) * 100 if last else 0.0
    word = {"upward": "grow", "downward": "decline"}.get(past["direction"], "stay stable")
    return Insight(
        "forecast", f"{metric} Forecast",
        f"'{metric}' is projected to {word} over the next {len(ahead)} periods ({letter}), {growth:+.1f}% to "
        f"{short_value(metric, end)}. Mean error {ahead[0]['avg_mape']:.1f}%, best model {ahead[0]['best_model']}.",
        clamp(min(abs(growth) / 50 + past["n_points"] / 200, 1.0), 0.55, 0.97), metric, "forecast",
        [str(r["period"]) for r in ahead], [r["point"] for r in ahead],
        {"projected_growth_pct": round(growth, 1), "avg_mape": ahead[0]["avg_mape"], "n_points": past["n_points"]},
        {"direction": past["direction"], "best_model": ahead[0]["best_model"], "frequency": letter})


def profile_cards(f: Facts, have: set[str], room: int) -> list[Insight]:
    """Plain facts that fill a report when few findings stand out."""
    cards = [Insight(
        "profile", "Dataset Overview",
        f"{f.rows:,} rows and {len(f.df.columns)} columns ({len(f.metrics)} metrics, {len(f.dimensions)} dimensions, "
        f"date column: {f.date or 'none'}); domain: {f.schema.get('dataset_type', 'general')}.", 0.2)]
    for metric in f.metrics[:3]:
        s = f.stats[metric]
        if s.known >= 2:
            cards.append(Insight(
                "profile", f"Summary Statistics: {metric}",
                f"'{metric}': mean {s.mean:,.2f}, median {f.quantiles[metric][0.5]:,.2f}, deviation {s.std:,.2f}, "
                f"range {s.low:,.2f} to {s.high:,.2f}, {s.null_share * 100:.1f}% missing.", 0.18, metric))
    if len(cards) < room and f.dimensions:
        table = _entropies_of(f, f.dimensions[:2])
        for dimension, r in table.items():
            cards.append(Insight(
                "profile", f"Category Breakdown: {dimension}",
                f"'{dimension}' has {r['levels']} values; the most common is '{r['top_value']}' "
                f"({r['top_count'] / max(f.rows, 1) * 100:.1f}% of rows).", 0.15, dimension))
    return [c for c in cards if c.title not in have][:room]

"""Time series as tables: frequency, regular periods, lags, decomposition and summaries.

Rows are reduced to one per series and period first; what follows works on that small, bounded
table, partitioned by series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.columns import as_double, col, cols, micros, require
from millrace.functions.dates import STEPS, period_start
from millrace.operators.ordered import Ordered
from millrace.operators.quantiles import exact_quantiles

# fixed values: periods ahead and season length by frequency
HORIZON = {"D": 30, "W": 12, "M": 6, "Q": 4, "Y": 2, "H": 48, "T": 60}
SEASON = {"D": 7, "W": 4, "M": 12, "Q": 4, "H": 24, "T": 60}
LAGS = (1, 2, 3, 7, 14, 30)
MIN_POINTS = 8
_DAY = 86_400


def _regular(low: float, high: float, firsts: bool) -> str | None:
    """Frequency of evenly spaced moments; months and longer must start on the first of a month."""
    exact = {60: "T", 3600: "H", _DAY: "D", 7 * _DAY: "W"}
    if low == high and low in exact:
        return exact[low]
    spans = {"M": (28, 31), "Q": (89, 92), "Y": (365, 366)}
    for word, (least, most) in spans.items():
        if firsts and least * _DAY <= low and high <= most * _DAY:
            return word
    return None


def gaps(df: DataFrame, date: str) -> DataFrame:
    """Seconds between consecutive distinct moments, across blocks where there are many."""
    moments = df.where(col(date).isNotNull()).select(micros(df, date).alias("t"), col(date).alias("d")).distinct()
    run = Ordered(moments, ["t"])
    keys = [F.col("_block")] if run.blocked else [F.lit(0)]
    before = F.lag("t").over(Window.partitionBy(*keys).orderBy("t"))
    if run.blocked:
        run.with_carry({"_edge": F.max("t")}, lambda n, w: F.max(n).over(w))
        before = F.coalesce(before, F.col("_edge"))
    first = F.dayofmonth(F.col("d").cast("date")) == 1
    return run.df.select(((F.col("t") - before) / 1e6).alias("gap"), first.alias("first"))


def infer_frequency(df: DataFrame, date: str) -> str:
    """Frequency letter by a regular pattern, else by the median gap."""
    found = gaps(df, date)
    low, high, n, firsts = found.agg(
        F.min("gap"), F.max("gap"), F.count("gap"), F.every(F.col("first"))).first()
    if not n:
        return "D"
    word = _regular(low, high, bool(firsts)) if n >= 2 else None
    if word:
        return word
    middle = exact_quantiles(found, {"gap": [0.5]}, n)["gap"][0]
    for limit, letter in ((3600, "T"), (_DAY, "H"), (8 * _DAY, "D"), (35 * _DAY, "W"), (100 * _DAY, "M")):
        if middle < limit:
            return letter
    return "Q"


def resample(df: DataFrame, date: str, metric: str, frequency: str, series: Sequence[str] = ()) -> DataFrame:
    """(series…, period, value): sums per period, periods without rows are 0."""
    require(df, [date, metric, *series])
    if frequency not in STEPS:
        frequency = "D"
    kept = df.where(col(date).isNotNull())
    sums = kept.groupBy(*cols(series), period_start(col(date), frequency).alias("period")).agg(
        F.coalesce(F.sum(as_double(df, metric)), F.lit(0.0)).alias("value"))
    spans = sums.groupBy(*cols(series)).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    calendar = spans.select(
        *cols(series), F.explode(F.sequence("lo", "hi", F.expr(STEPS[frequency]))).alias("period"))
    joined = calendar.join(sums, [*series, "period"], "left")
    return joined.select(*cols(series), "period", F.coalesce("value", F.lit(0.0)).alias("value"))


def _by_period(series: Sequence[str]):
    return Window.partitionBy(*(cols(series) or [F.lit(0)])).orderBy("period")


def pct_change(table: DataFrame, series: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Change against the previous period; a previous value of 0 gives NULL."""
    before = F.lag(value).over(_by_period(series))
    return table.withColumn("pct_change", F.try_divide(F.col(value), before) - 1)


def daily_sums(df: DataFrame, date: str, metric: str, series: Sequence[str] = ()) -> DataFrame:
    """(series…, period, value) of the days that occur."""
    kept = df.where(col(date).isNotNull())
    return kept.groupBy(*cols(series), period_start(col(date), "D").alias("period")).agg(
        F.coalesce(F.sum(as_double(df, metric)), F.lit(0.0)).alias("value"))


def lag_features(table: DataFrame, series: Sequence[str] = (), lags: Sequence[int] = LAGS) -> DataFrame:
    """Lags, mean and deviation of the previous three values, and the position in the series."""
    order = _by_period(series)
    last3 = order.rowsBetween(-3, -1)
    named = {f"lag_{k}": F.coalesce(F.lag("value", k).over(order), F.lit(0.0)) for k in lags}
    named["mean_3"] = F.coalesce(F.avg("value").over(last3), F.lit(0.0))
    named["std_3"] = F.coalesce(F.stddev_pop("value").over(last3), F.lit(0.0))
    named["position"] = F.row_number().over(order) - 1
    return table.withColumns(named)


def rolling_trend(table: DataFrame, width: int, series: Sequence[str] = ()) -> DataFrame:
    """Centred rolling mean that shrinks at the edges."""
    frame = _by_period(series).rowsBetween(-(width // 2), (width - 1) // 2)
    return table.withColumn("trend", F.avg("value").over(frame))


def decompose(table: DataFrame, frequency: str, series: Sequence[str] = ()) -> DataFrame:
    """Additive trend, season and residual; a series shorter than two seasons gets a rolling trend."""
    period = SEASON.get(frequency, 7)
    half = period // 2
    keys = cols(series) or [F.lit(0)]
    order, whole = _by_period(series), Window.partitionBy(*keys)
    span = order.rowsBetween(-half, half)
    full = F.count("value").over(span) == 2 * half + 1
    total = F.sum("value").over(span)
    if period % 2 == 0:
        total = total - 0.5 * (F.lag("value", half).over(order) + F.lead("value", half).over(order))
    work = table.withColumns({
        "_i": (F.row_number().over(order) - 1).cast("double"), "_n": F.count(F.lit(1)).over(whole),
        "_core": F.when(full, total / period)})
    lo = F.lit(float(half))
    hi = F.col("_n") - 1.0 - half
    head = F.when((F.col("_i") >= lo) & (F.col("_i") < lo + period), F.col("_core"))
    tail = F.when((F.col("_i") <= hi) & (F.col("_i") > hi - period), F.col("_core"))

    def line(part: Column) -> Column:
        slope, base = F.regr_slope(part, F.col("_i")).over(whole), F.regr_intercept(part, F.col("_i")).over(whole)
        return base + slope * F.col("_i")

    trend = F.coalesce("_core", F.when(F.col("_i") < lo, line(head)).otherwise(line(tail)))
    work = work.withColumn("trend", trend).withColumn("_phase", F.col("_i").cast("long") % period)
    phase = F.avg(F.col("value") - F.col("trend")).over(Window.partitionBy(*keys, F.col("_phase")))
    first = F.col("_i") < period
    work = work.withColumn("_phase_mean", phase)
    center = F.avg(F.when(first, F.col("_phase_mean"))).over(whole)
    work = work.withColumn("seasonal", F.col("_phase_mean") - center)
    short = F.col("_n") < 2 * period
    width = F.greatest(F.lit(3), F.least(F.lit(period), F.floor(F.col("_n") / 3)))
    near = F.avg(F.col("value")).over(order.rowsBetween(-half, half))
    work = work.withColumns({
        "trend": F.when(short & (width > 0), near).otherwise(F.col("trend")),
        "seasonal": F.when(short, F.lit(0.0)).otherwise(F.col("seasonal"))})
    out = work.withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal"))
    return out.select(*cols(series), "period", "value", "trend", "seasonal", "residual")


def summarize(table: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """First and last value, growth, total, slope and direction of every series."""
    numbered = table.withColumn("_i", (F.row_number().over(_by_period(series)) - 1).cast("double"))
    stats = numbered.groupBy(*cols(series)).agg(
        F.min_by("value", "period").alias("start_val"), F.max_by("value", "period").alias("end_val"),
        F.count(F.lit(1)).alias("n_points"), F.sum("value").alias("total"), F.avg("value").alias("_mean"),
        F.regr_slope(F.col("value"), F.col("_i")).alias("slope"))
    growth = F.when(F.col("start_val") != 0, (F.col("end_val") - F.col("start_val")) / F.abs("start_val") * 100)
    limit = F.abs("_mean") * 0.005
    direction = F.when(F.col("slope") > limit, "upward").when(F.col("slope") < -limit, "downward").otherwise("stable")
    return stats.select(
        *cols(series), F.round("start_val", 2).alias("start_val"), F.round("end_val", 2).alias("end_val"),
        F.round(F.coalesce(growth, F.lit(0.0)), 1).alias("growth_pct"), F.round("total", 2).alias("total"),
        "n_points", F.round("slope", 4).alias("slope"), direction.alias("direction"))


def future_periods(table: DataFrame, frequency: str, horizon: int | None = None, series: Sequence[str] = ()) -> DataFrame:
    """(series…, step, period) for the periods after the last one."""
    steps = horizon or HORIZON.get(frequency, 30)
    last = table.groupBy(*cols(series)).agg(F.max("period").alias("_last"))
    rows = last.select(*cols(series), "_last", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return rows.select(*cols(series), "step", ahead(F.col("_last"), F.col("step"), frequency).alias("period"))


def ahead(last: Column, step: Column, frequency: str) -> Column:
    months = {"M": 1, "Q": 3, "Y": 12}
    if frequency in months:
        return F.add_months(last, step * months[frequency])
    if frequency in ("H", "T"):
        return last + F.make_dt_interval(
            hours=step if frequency == "H" else F.lit(0), mins=step if frequency == "T" else F.lit(0))
    return F.date_add(last, step * (7 if frequency == "W" else 1))


def mape(actual: Column, predicted: Column) -> Column:
    """Mean absolute percentage error over non-zero actual values, as an aggregate; 100 when there are none."""
    return F.coalesce(F.avg(F.when(actual != 0, F.abs((actual - predicted) / actual))) * 100, F.lit(100.0))

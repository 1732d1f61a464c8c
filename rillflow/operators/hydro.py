"""Memory features of daily or monthly flow: recessions, baseflow, trailing windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import rounded
from .series import positions


def recession_segments(series: DataFrame, least: int = 5) -> DataFrame:
    """Maximal runs with q[i+1] <= q[i] and q[i] > 0 of at least `least` points: gauge, segment start, points, has_zero, log slope.

    Rows with null values are left out first, so a run may bridge a gap."""
    p = positions(series.filter(F.col("value").isNotNull()).select("gauge", "period", F.col("value").alias("q")))
    w = W.partitionBy("gauge").orderBy("idx")
    falls = F.coalesce((F.lead("q").over(w) <= F.col("q")) & (F.col("q") > 0), F.lit(False))
    p = p.withColumn("falls", falls).withColumn("held", F.coalesce(F.lag("falls").over(w), F.lit(False)))
    p = p.withColumn("segment", F.sum((F.col("falls") & ~F.col("held")).cast("int")).over(w)).filter("falls or held")
    q = F.when(F.col("q") > 0, F.log(F.nullif(F.greatest("q", F.lit(0.0)), F.lit(0.0))))
    out = p.groupBy("gauge", "segment").agg(
        F.min("idx").alias("start_idx"), F.count(F.lit(1)).alias("points"), F.max((F.col("q") <= 0).cast("int")).alias("has_zero"),
        F.regr_slope(q, F.col("idx").cast("double")).alias("slope"),
    )
    return out.filter(F.col("points") >= least).select("gauge", "start_idx", "points", "has_zero", "slope")


def recession_constant(series: DataFrame, least: int = 5, segments: int = 3) -> DataFrame:
    """k = -1 / median slope of falling segments, and the interquartile range of -1 / slope."""
    seg = recession_segments(series, least)
    slope = F.when((F.col("has_zero") == 0) & (F.col("slope") < 0), F.col("slope"))
    out = seg.groupBy("gauge").agg(
        F.count(F.lit(1)).alias("n_segments"), F.count(slope).alias("n_used"), F.median(slope).alias("b"),
        (F.percentile(-1 / slope, F.lit(0.75)) - F.percentile(-1 / slope, F.lit(0.25))).alias("iqr"),
    )
    return out.filter((F.col("n_segments") >= segments) & (F.col("n_used") >= segments)).select("gauge", "n_segments", "n_used", F.round(-1 / F.col("b"), 2).alias("k"), F.round("iqr", 2).alias("k_iqr"))


def recession_ratio(series: DataFrame, least: int = 10) -> DataFrame:
    """The other definition: median of those ratios -q / change of falling days that lie between 0 and 1000.

    n counts falling days; with no more than `least` of them, or no ratio in between, k is null."""
    w = W.partitionBy("gauge").orderBy("period")
    p = series.filter(F.col("value").isNotNull()).withColumn("change", F.lead("value").over(w) - F.col("value")).filter("change < 0")
    ratio = -F.col("value") / F.col("change")
    out = p.groupBy("gauge").agg(F.count(F.lit(1)).alias("n"), F.median(F.when((ratio > 0) & (ratio < 1000), ratio)).alias("k"))
    return out.select("gauge", "n", F.when(F.col("n") > least, F.round("k", 6)).alias("k"))


def trailing_stats(events: DataFrame, daily: DataFrame, days: int, least: int, inclusive: bool = False) -> DataFrame:
    """n, mean, coefficient of variation and zero share of the days before each event date (events: gauge, event_date).

    The range join is cut into blocks of `days`: every event meets two blocks of its gauge, so rows of long series are
    not compared with all events."""
    block = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    keyed = daily.filter(F.col("value").isNotNull()).select("gauge", "period", "value", block(F.col("period")).alias("block"))
    asked = events.select("gauge", "event_date").distinct().withColumn("b", block(F.col("event_date")))
    asked = asked.select("gauge", "event_date", F.explode(F.array(F.col("b") - 1, F.col("b"))).alias("block"))
    upto = F.col("period") <= F.col("event_date") if inclusive else F.col("period") < F.col("event_date")
    met = asked.join(keyed, ["gauge", "block"]).filter((F.col("period") >= F.date_sub("event_date", days)) & upto)
    out = met.groupBy("gauge", "event_date").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.avg((F.col("value") == 0).cast("double")).alias("z")
    )
    return out.filter(F.col("n") >= least).select(
        "gauge", "event_date", "n", rounded(F.col("m"), 2).alias("mean_value"), F.round(F.col("s") / F.nullif(F.col("m"), F.lit(0.0)), 4).alias("cv"), rounded(F.col("z"), 4).alias("zero_share")
    )


def static_features(series: DataFrame, least: int = 365, points: int = 5, segments: int = 5) -> DataFrame:
    """One row for each gauge over its whole record: values, years, mean, variation, zero share and recession constant.

    Null flow counts as zero in the recessions, so one that ends in a gap gives no slope.  With fewer than `least`
    values only n_days and data_years are given.  `baseflow_index` gives the share of baseflow."""
    held = series.groupBy("gauge").agg(
        F.count("value").alias("n_days"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.avg((F.col("value") == 0).cast("double")).alias("z")
    )
    k = recession_constant(series.withColumn("value", F.coalesce("value", F.lit(0.0))), points, segments).select("gauge", "k", "k_iqr")
    enough = F.col("n_days") >= least
    return held.join(k, "gauge", "left").select(
        "gauge", "n_days", rounded(F.col("n_days") / 365.25, 1).alias("data_years"), F.when(enough, F.col("k")).alias("recession_k"), F.when(enough, F.col("k_iqr")).alias("recession_k_iqr"),
        F.when(enough, rounded(F.col("m"), 2)).alias("mean_value"), F.when(enough & (F.col("m") > 0), F.round(F.col("s") / F.nullif(F.col("m"), F.lit(0.0)), 4)).alias("cv"),
        F.when(enough, rounded(F.col("z"), 4)).alias("zero_share"),
    )


def baseflow(q: np.ndarray, alpha: float = 0.925, passes: int = 3, definition: str = "A") -> np.ndarray:
    """Recursive digital filter, forward and backward in turn.

    Definition A bounds quickflow by the flow of the pass and baseflow by the input; B only keeps both from being negative."""
    q = np.asarray(q, float)
    if len(q) < 3:
        return q.copy()
    base = q.copy()
    for k in range(passes):
        run = base[::-1] if k % 2 else base
        quick, held = np.zeros(len(run)), (1 + alpha) / 2
        for i in range(1, len(run)):
            value = max(0.0, alpha * quick[i - 1] + held * (run[i] - run[i - 1]))
            quick[i] = min(value, run[i]) if definition == "A" else value
        rest = np.maximum(run - quick, 0.0)
        rest = rest[::-1] if k % 2 else rest
        base = np.minimum(rest, q) if definition == "A" else rest
    return base


def windows_baseflow(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, alpha: float = 0.925, passes: int = 3, definition: str = "A") -> np.ndarray:
    """Sum of the baseflow of every window q[lo:hi]: one recursion moves all windows on, a column of steps at a time.

    Each pass starts anew in each window, so overlapping windows share no result."""
    size = hi - lo
    longest = int(size.max(initial=0))
    at = np.arange(longest)
    inside = at < size[:, None]
    flow = np.where(inside, q[np.minimum(lo[:, None] + at, max(0, len(q) - 1))], 0.0)
    turned = np.where(inside, size[:, None] - 1 - at, at)  # places of the reversed window
    base, half = flow, (1 + alpha) / 2
    for k in range(passes):
        run = np.ascontiguousarray((np.take_along_axis(base, turned, 1) if k % 2 else base).T)
        quick = np.zeros_like(run)
        for i in range(1, longest):
            step = np.maximum(alpha * quick[i - 1] + half * (run[i] - run[i - 1]), 0.0)
            quick[i] = np.minimum(step, run[i]) if definition == "A" else step
        rest = np.maximum(run - quick, 0.0).T
        rest = np.take_along_axis(rest, turned, 1) if k % 2 else rest
        base = np.where(inside, np.minimum(rest, flow) if definition == "A" else rest, 0.0)
    return base.sum(axis=1)


def _recession_slopes(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, points: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """k and its interquartile range for every window: runs are found once, and cut at the ends of each window."""
    k, spread = np.full(len(lo), np.nan), np.full(len(lo), np.nan)
    q = np.maximum(q, 0.0)
    falls = np.append((q[1:] <= q[:-1]) & (q[:-1] > 0), False)
    edge = np.diff(np.concatenate(([0], falls.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # points first..last, both included
    y = np.log(np.where(q > 0, q, 1.0))
    t = np.arange(len(q), dtype=float)
    sums = [np.concatenate(([0.0], np.cumsum(v))) for v in (y - y.mean(), (y - y.mean()) * t)]
    for e in range(len(lo)):
        some = slice(np.searchsorted(last, lo[e] + 1), np.searchsorted(first, hi[e] - 1))
        a, b = np.maximum(first[some], lo[e]), np.minimum(last[some], hi[e] - 1)
        long = b - a + 1 >= points
        a, b = a[long], b[long]
        if len(a) < segments:
            continue
        m = (b - a + 1).astype(float)
        sy, sty = sums[0][b + 1] - sums[0][a], sums[1][b + 1] - sums[1][a]
        slope = (sty - (a + b) / 2 * sy) / (m * (m * m - 1) / 12)
        slope = slope[(q[b] > 0) & (slope < -1e-13)]  # only the last point of a segment can be zero
        if len(slope) >= segments:
            k[e] = -1 / np.median(slope)
            spread[e] = np.subtract(*np.percentile(-1 / slope, [75, 25]))
    return k, spread


def _recession_ratios(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> np.ndarray:
    k = np.full(len(lo), np.nan)
    change = np.diff(q)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = -q[:-1] / change
    for e in range(len(lo)):
        falls = change[lo[e] : hi[e] - 1] < 0
        if falls.sum() > least:
            r = ratio[lo[e] : hi[e] - 1][falls]
            r = r[(r > 0) & (r < 1000)]
            k[e] = np.median(r) if len(r) else np.nan
    return k


def event_memory(events: DataFrame, daily: DataFrame, definition: str = "A", days: int = 1095, least: int = 365) -> DataFrame:
    """Memory of the flow before each event: values in its window, baseflow index, recession constant and its
    interquartile range, mean, variation and zero share.

    A: the `days` days before the event, null values left out first; recession by slopes of at least three segments of five points.
    B: the event's own day too, values of zero and more only; recession by ratios of more than ten falling days, no range.
    Windows of fewer than `least` values give their number alone; every event (gauge, event_date) gives one row.

    Series are cut into blocks of `days` days.  An event meets its own block and the one before, so a group holds two
    blocks of daily rows and the dates of one, whatever the length of the series; its windows advance together."""
    kind = events.schema["gauge"].dataType.simpleString()
    block = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days).cast("long")
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    asked = events.select("gauge", "event_date").filter("event_date is not null").distinct()
    asked = asked.select("gauge", block(F.col("event_date")).alias("block"), number(F.col("event_date")).alias("day"))
    held = daily.filter(F.col("value").isNotNull() if definition == "A" else F.col("value") >= 0)
    held = held.select("gauge", F.explode(F.array(block(F.col("period")), block(F.col("period")) + 1)).alias("block"), number(F.col("period")).alias("day"), F.col("value").cast("double").alias("q"))
    own = 0 if definition == "A" else 1

    def run(dates: pd.DataFrame, flow: pd.DataFrame) -> pd.DataFrame:
        flow = flow.sort_values("day", kind="stable")
        at, q, day = flow["day"].to_numpy(), flow["q"].to_numpy(float), np.sort(dates["day"].to_numpy())
        lo, hi = np.searchsorted(at, day - days), np.searchsorted(at, day + own)
        n = hi - lo
        out = {c: np.full(len(day), np.nan) for c in ("bfi", "k", "k_iqr", "m", "s", "z")}
        full = np.flatnonzero(n >= max(1, least))
        if len(full):
            a, b = lo[full], hi[full]
            total = np.array([q[i:j].sum() for i, j in zip(a, b, strict=True)])
            whole = (b - a >= 30) & (total != 0) if definition == "A" else total > 0
            out["bfi"][full[whole]] = windows_baseflow(q, a[whole], b[whole], definition=definition) / total[whole]
            if definition == "A":
                out["k"][full], out["k_iqr"][full] = _recession_slopes(q, a, b, 5, 3)
            else:
                out["k"][full] = _recession_ratios(q, a, b, 10)
            out["m"][full] = total / n[full]
            out["s"][full] = [q[i:j].std() for i, j in zip(a, b, strict=True)]
            out["z"][full] = [(q[i:j] == 0).mean() for i, j in zip(a, b, strict=True)]
        return pd.DataFrame({"gauge": dates["gauge"].to_numpy(), "day": day, "n": n, **out})

    found = asked.groupBy("gauge", "block").cogroup(held.groupBy("gauge", "block")).applyInPandas(run, f"gauge {kind}, day int, n long, bfi double, k double, k_iqr double, m double, s double, z double")
    found = found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("bfi", "k", "k_iqr", "m", "s", "z")})
    digits = (4, 2, 2, 2, 4, 4) if definition == "A" else (9,) * 6
    values = (F.col("bfi"), F.col("k"), F.col("k_iqr"), F.col("m"), F.when(F.col("m") > 0, F.col("s") / F.nullif(F.col("m"), F.lit(0.0))), F.col("z"))
    names = ("bfi", "recession_k", "recession_k_iqr", "mean_value", "cv", "zero_share")
    return found.select("gauge", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("event_date"), "n", *[rounded(v, d).alias(name) for v, d, name in zip(values, digits, names, strict=True)])


def baseflow_index(series: DataFrame, least: int = 30, definition: str = "A") -> DataFrame:
    """Share of baseflow in the flow of each gauge; the recursion needs a gauge's rows in order, one group at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf.sort_values("period")["value"].dropna().to_numpy(float)
        if definition == "B":
            q = q[q >= 0]
        total = q.sum()
        if len(q) < least or total == 0:
            return pd.DataFrame({"gauge": [], "n": [], "bfi": []}).astype({"gauge": pdf["gauge"].dtype, "n": "int64", "bfi": "float64"})
        return pd.DataFrame({"gauge": pdf["gauge"].iloc[:1].to_numpy(), "n": [len(q)], "bfi": [round(float(baseflow(q, definition=definition).sum() / total), 4 if definition == "A" else 9)]})

    kind = series.schema["gauge"].dataType.simpleString()
    return series.select("gauge", "period", "value").groupBy("gauge").applyInPandas(run, f"gauge {kind}, n long, bfi double")

"""Event detection by run theory with pooling, event matching and classification.

Detection has a closed form.  An onset candidate is a row whose value and the two
after it are at or below the onset level.  Row j ends events (T) if it is above the
onset level and the row after it is above the termination level.  Candidates with the same next T (at least three rows on) belong to
one event; the earliest is its onset, and it ends right before that T (or with the
record).  So detection is window functions and one aggregation by gauge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import rounded
from .series import positions

ONSET, TERMINATION = -1.0, -0.5


def detect(series: DataFrame, column: str = "index", onset: float = ONSET, termination: float = TERMINATION, monthly: bool = True, by: Sequence[str] = ("gauge",)) -> DataFrame:
    """by, period, `column` -> one row per event with positions, dates, severity, peak, intensity and false recoveries."""
    rows = positions(series.select(*by, "period", F.col(column).alias("v")), by)
    w = W.partitionBy(*by).orderBy("idx")
    low = F.col("v") <= onset
    after = F.lead("v", 1).over(w)
    marked = rows.withColumns({
        "start": F.coalesce(low & (after <= onset) & (F.lead("v", 2).over(w) <= onset), F.lit(False)),
        "stop": F.coalesce((F.col("v") > onset) & (after > termination), F.lit(False)),
        "n": F.count(F.lit(1)).over(W.partitionBy(*by)),
    })
    # next stop at least three rows on: descending order keeps the frame incremental
    back = W.partitionBy(*by).orderBy(F.col("idx").desc()).rowsBetween(W.unboundedPreceding, -3)
    marked = marked.withColumn("next", F.min(F.when(F.col("stop"), F.col("idx"))).over(back))
    spans = marked.filter("start").groupBy(*by, F.coalesce("next", "n").alias("next")).agg(F.min("idx").alias("onset_idx"))
    spans = spans.select(*by, "onset_idx", (F.col("next") - 1).alias("term_idx"))
    inside = rows.join(spans, list(by)).filter("idx between onset_idx and term_idx")
    first = F.min_by("period", F.when(F.col("v").isNotNull(), F.struct("v", "idx")))
    last = F.max_by("period", "idx")
    out = inside.groupBy(*by, "onset_idx", "term_idx").agg(
        F.min_by("period", "idx").alias("onset_date"), (F.last_day(last) if monthly else last).alias("term_date"), F.sum("v").alias("total"),
        F.round(F.min("v"), 4).alias("peak"), first.alias("peak_date"), F.min_by("idx", F.when(F.col("v").isNotNull(), F.struct("v", "idx"))).alias("peak_idx"),
        F.count_if(F.col("v") > onset).cast("int").alias("false_recoveries"),
    )
    duration = F.col("term_idx") - F.col("onset_idx") + 1
    return out.select(
        *by, "onset_idx", "term_idx", "onset_date", "term_date", duration.alias("duration"), F.round("total", 4).alias("severity"),
        "peak", "peak_date", "peak_idx", rounded(F.col("total") / duration, 4).alias("intensity"), "false_recoveries",
    )


EVENT = ("onset_idx", "term_idx", "onset_date", "term_date", "duration", "severity", "peak", "peak_idx", "false_recoveries")


def _named(events: DataFrame, prefix: str, by: Sequence[str]) -> DataFrame:
    return events.select(*by, *[F.col(c).alias(f"{prefix}_{c}") for c in EVENT])


def candidates(driver: DataFrame, response: DataFrame, by: Sequence[str] = ("gauge",), window: int = 6, severity: float = -3.0) -> DataFrame:
    """Severe driver events that touch the window before a response event's onset."""
    a, b = _named(driver.filter(F.col("severity") <= severity), "d", by), _named(response, "r", by)
    near = (F.col("d_term_idx") >= F.col("r_onset_idx") - window) & (F.col("d_onset_idx") <= F.col("r_onset_idx"))
    met = b.join(a, list(by)).filter(near)
    overlap = F.greatest(F.lit(0), F.least("d_term_idx", "r_term_idx") - F.greatest("d_onset_idx", "r_onset_idx") + 1)
    return met.withColumns({
        "overlap": overlap, "propagation_lag": F.col("r_onset_idx") - F.col("d_onset_idx"), "event_recovery_lag": F.col("r_term_idx") - F.col("d_term_idx"),
    })


def match(driver: DataFrame, response: DataFrame, by: Sequence[str] = ("gauge",), window: int = 6, severity: float = -3.0) -> DataFrame:
    """Best candidate of every response event: most overlap, then least lag, then earliest."""
    best = W.partitionBy(*by, "r_onset_idx").orderBy(F.desc("overlap"), "propagation_lag", "d_onset_idx")
    return candidates(driver, response, by, window, severity).withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")


def leads(pairs: DataFrame) -> DataFrame:
    """Pairs whose response starts first.  The candidate window leaves none; kept for the table's shape."""
    return pairs.filter(F.col("propagation_lag") < 0)


def buffered(driver: DataFrame, pairs: DataFrame, by: Sequence[str] = ("gauge",), severity: float = -3.0) -> DataFrame:
    """Driver events that no response event chose, with the reason."""
    used = pairs.select(*by, F.col("d_onset_idx").alias("onset_idx")).distinct()
    reason = F.when(F.col("severity") > severity, "severity_below_threshold").otherwise("no_matching_response")
    return driver.join(used, [*by, "onset_idx"], "left_anti").withColumn("reason", reason)


def independent(response: DataFrame, pairs: DataFrame, by: Sequence[str] = ("gauge",)) -> DataFrame:
    """Response events without any candidate."""
    used = pairs.select(*by, F.col("r_onset_idx").alias("onset_idx"))
    return response.join(used, [*by, "onset_idx"], "left_anti")


def union_events(pairs: DataFrame, unused: DataFrame, alone: DataFrame, by: Sequence[str] = ("gauge",)) -> DataFrame:
    """All events with event_type: propagated, buffered or independent."""
    one = pairs.select(*by, F.col("r_onset_date").alias("onset_date"), F.col("r_severity").alias("severity"), F.lit("propagated").alias("event_type"))
    rest = [df.select(*by, "onset_date", "severity", F.lit(kind).alias("event_type")) for df, kind in ((unused, "buffered"), (alone, "independent"))]
    return one.unionByName(rest[0]).unionByName(rest[1])


def classify(driver: DataFrame, response: DataFrame, pairs: DataFrame, unused: DataFrame, alone: DataFrame, by: Sequence[str] = ("gauge",)) -> DataFrame:
    """Counts, percentages and lags for each gauge that has an event; empty denominators give 0."""
    by = list(by)
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    lags = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matched"), F.countDistinct("d_onset_idx").alias("unique_drivers"),
        rounded(F.avg("propagation_lag"), 2).alias("mean_propagation_lag"), rounded(F.median("propagation_lag"), 2).alias("median_propagation_lag"),
        rounded(F.avg("event_recovery_lag"), 2).alias("mean_recovery_lag"), rounded(F.median("event_recovery_lag"), 2).alias("median_recovery_lag"),
    )
    out = count(driver, "drivers")
    for df in (count(response, "responses"), lags, count(unused, "buffered"), count(alone, "independent")):
        out = out.join(df, by, "full")
    counts = ("drivers", "responses", "matched", "unique_drivers", "buffered", "independent")
    out = out.na.fill(0, list(counts))
    share = lambda a, b: rounded(F.when(F.col(b) > 0, 100 * F.col(a) / F.nullif(F.col(b), F.lit(0))).otherwise(0.0), 1)
    return out.withColumns({
        "leads": F.lit(0), "pct_propagated": share("unique_drivers", "drivers"), "pct_buffered": share("buffered", "drivers"),
        "pct_matched": share("matched", "responses"), "pct_independent": share("independent", "responses"),
    })


def accounts(driver: DataFrame, response: DataFrame, pairs: DataFrame, unused: DataFrame, alone: DataFrame, by: Sequence[str] = ("gauge",)) -> DataFrame:
    """Totals of all events and whether they add up: every driver event is chosen or buffered, every response event
    matched or independent, and no lag is negative.  One row."""
    count = lambda df, name, *more: df.agg(F.count(F.lit(1)).alias(name), *more)
    matched = count(pairs, "matched", F.countDistinct(*by, "d_onset_idx").alias("unique_drivers"), F.coalesce(F.min("propagation_lag"), F.lit(0)).alias("least_lag"))
    out = count(driver, "drivers")
    for one in (count(response, "responses"), matched, count(unused, "buffered"), count(alone, "independent")):
        out = out.join(one)  # one row each
    return out.select(
        "drivers", "responses", "matched", "unique_drivers", "buffered", "independent", (F.col("unique_drivers") + F.col("buffered") == F.col("drivers")).alias("drivers_add_up"),
        (F.col("matched") + F.col("independent") == F.col("responses")).alias("responses_add_up"), (F.col("least_lag") >= 0).alias("lags_not_negative"),
    )

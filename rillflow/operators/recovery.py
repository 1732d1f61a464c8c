"""Look-ahead metrics after events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import rounded, season
from .series import positions

AHEAD = 36


def recovery(pairs: DataFrame, panel: DataFrame, ahead: int = AHEAD, level: float = -0.5, by: Sequence[str] = ("gauge",)) -> DataFrame:
    """Recovery lag, half-life, state at the driver's end and rebound for every matched pair.

    panel: by, period, driver, response (index values).  Nothing is exploded: for every row of
    the panel the next recovered row is found by a window, and pairs look their rows up by
    position; only the half-life, whose target differs by pair, joins a bounded stretch."""
    p = positions(panel.select(*by, "period", "driver", "response"), by)
    w = W.partitionBy(*by).orderBy("idx")
    back = W.partitionBy(*by).orderBy(F.col("idx").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = p.select(
        *by, "idx", "response",
        F.min(F.when(F.col("response") > level, F.col("idx"))).over(back).alias("next_ok"),
        F.avg("driver").over(w.rowsBetween(0, 2)).alias("rebound_3"), F.avg("driver").over(w.rowsBetween(0, 5)).alias("rebound_6"),
        F.coalesce(F.sum("driver").over(w.rowsBetween(0, 5)), F.lit(0.0)).alias("post_signal"), F.count(F.lit(1)).over(W.partitionBy(*by)).alias("n"),
    )
    at_end = rows.select(*by, F.col("idx").alias("d_term_idx"), F.col("response").alias("antecedent"), "next_ok", "rebound_3", "rebound_6", "post_signal", "n")
    out = pairs.join(at_end, [*by, "d_term_idx"], "left")
    end = F.least(F.col("d_term_idx") + ahead, F.col("n"))
    found = F.coalesce(F.col("next_ok") < end, F.lit(False))
    out = out.withColumns({
        "recovery_lag": F.when(F.col("n").isNotNull(), F.when(found, F.col("next_ok") - F.col("d_term_idx")).otherwise(end - F.col("d_term_idx"))),
        "recovery_censored": F.when(F.col("n").isNotNull(), ~found), "end": end,
    })
    key = [*by, "r_onset_idx"]
    looked = out.select(*key, "d_term_idx", "r_peak_idx", F.col("r_peak").alias("low"), "end").join(p.select(*by, "idx", "response"), list(by))
    looked = looked.filter((F.col("idx") > F.col("r_peak_idx")) & (F.col("idx") < F.col("end")) & (F.col("response") >= F.col("low") / 2))
    half = looked.groupBy(*key).agg(F.min("idx").alias("half_idx"))
    out = out.join(half, key, "left")
    parts = season(F.month("d_term_date"))
    return out.withColumns({
        "half_life": F.when(F.col("half_idx").isNotNull(), F.col("half_idx") - F.col("r_peak_idx")).otherwise(F.greatest(F.col("end") - F.col("r_peak_idx"), F.lit(0))),
        "half_life_censored": F.col("half_idx").isNull(), "term_month": parts["month"],
        "term_sin": F.round(parts["month_sin"], 6), "term_cos": F.round(parts["month_cos"], 6),
        "rebound_3": rounded(F.col("rebound_3"), 4), "rebound_6": rounded(F.col("rebound_6"), 4), "post_signal": F.round("post_signal", 4),
        "had_false_recovery": (F.col("r_false_recoveries") > 0).cast("int"),
    }).drop("end", "half_idx", "next_ok", "n")


MEDIANS = ("propagation_lag", "recovery_lag", "half_life", "antecedent", "rebound_3", "rebound_6")
MEANS = ("propagation_lag", "recovery_lag", "half_life", "d_severity", "r_severity")


def rollup(pairs: DataFrame, by: Sequence[str] = ("gauge",)) -> DataFrame:
    """Pairs with a recovery lag, medians, means and the share with false recoveries."""
    return pairs.groupBy(*by).agg(
        F.count("recovery_lag").alias("n_pairs"), *[rounded(F.median(c), 4).alias(f"median_{c}") for c in MEDIANS],
        *[rounded(F.avg(c), 4).alias(f"mean_{c}") for c in MEANS], rounded(F.avg("had_false_recovery"), 4).alias("p_false_recovery"),
    )


def typology(buffered: DataFrame, independent: DataFrame, times: float = 2.0, by: Sequence[str] = ("gauge",)) -> DataFrame:
    """Gauges by which kind of unmatched event they have more than `times` as often."""
    a, b = (df.groupBy(*by).agg(F.count(F.lit(1)).alias(name)) for df, name in ((buffered, "n_buffered"), (independent, "n_independent")))
    both = a.join(b, list(by), "full").na.fill(0, ["n_buffered", "n_independent"])
    kind = F.when(F.col("n_buffered") > times * F.col("n_independent"), "buffered").when(F.col("n_independent") > times * F.col("n_buffered"), "independent").otherwise("mixed")
    return both.withColumn("typology", kind)


def dynamic_by_group(features: DataFrame, columns: Sequence[str], lag: str | None = None, how: str = "median", by: Sequence[str] = ("gauge",)) -> DataFrame:
    """Features of single events for each gauge: medians (with median and count of the lag), or means; nulls are skipped."""
    agg = F.median if how == "median" else F.avg
    more = [F.median(lag).alias(f"median_{lag}"), F.count(lag).alias("n_lags")] if lag and how == "median" else []
    return features.groupBy(*by).agg(*[rounded(agg(c), 6).alias(f"{how}_{c}") for c in columns], *more)

"""Operators on many independent series: rows (gauge, period, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clip, gamma_parameters, glo_cdf, glo_parameters, norm_ppf, rounded
from ..functions.special import gamma_cdf


def regular(df: DataFrame, keys: Sequence[str], value: Column, period: Column, how=F.sum, digits: int = 2) -> DataFrame:
    """One value for each gauge and period that has rows."""
    return df.groupBy(*[F.col(k).alias("gauge") for k in keys], period.alias("period")).agg(rounded(how(value), digits).alias("value"))


def densify(series: DataFrame, step: str = "1 month", least: int = 0) -> DataFrame:
    """Every period between a gauge's first and last one; gaps hold null.  Gauges of fewer than `least` periods go."""
    ends = series.groupBy("gauge").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    grid = ends.select("gauge", F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("period"))
    return (at_least(grid, least) if least else grid).join(series, ["gauge", "period"], "left")


def at_least(series: DataFrame, rows: int, by: Sequence[str] = ("gauge",)) -> DataFrame:
    """Series of at least so many rows, nulls counted."""
    long = series.groupBy(*by).agg(F.count(F.lit(1)).alias("#")).filter(F.col("#") >= rows).drop("#")
    return series.join(long, list(by), "left_semi")


def positions(series: DataFrame, by: Sequence[str] = ("gauge",)) -> DataFrame:
    """idx: place of a row in its series, from 0."""
    return series.withColumn("idx", F.row_number().over(W.partitionBy(*by).orderBy("period")) - 1)


def rolling_sum(series: DataFrame, k: int, column: str = "value", out: str = "rolled", by: Sequence[str] = ("gauge",)) -> DataFrame:
    """Sum of the last k rows; null where one of them is null or missing."""
    w = W.partitionBy(*by).orderBy("period").rowsBetween(-(k - 1), 0)
    return series.withColumn(out, F.when(F.count(column).over(w) == k, F.sum(column).over(w)))


def zscore(series: DataFrame, column: str, out: str = "index", digits: int = 4, population: bool = False) -> DataFrame:
    w = W.partitionBy("gauge")
    std = (F.stddev_pop if population else F.stddev_samp)(column).over(w)
    return series.withColumn(out, F.round((F.col(column) - F.avg(column).over(w)) / F.nullif(std, F.lit(0.0)), digits))


def quality(series: DataFrame, steps: Column) -> DataFrame:
    """First and last period, values, expected rows, completeness in percent and length in years.

    steps: number of periods from `first` to `last`, both included."""
    held = series.filter(F.col("value").isNotNull()).groupBy("gauge").agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count("value").alias("n"))
    out = held.withColumn("expected", steps)
    return out.withColumns({"completeness": F.round(100 * F.col("n") / F.col("expected"), 4), "years": F.round(F.datediff("last", "first") / 365.25, 4)})


def l_moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Unbiased probability-weighted moments: n, l1, l2, l3 (null for fewer than three values)."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(value)) - 1
    x, j, n = F.col(value), F.col("j#"), F.count(F.lit(1))
    sums = (
        df.filter(x.isNotNull()).withColumn("j#", rank.cast("double")).groupBy(*by)
        .agg(n.alias("n"), F.sum(x).alias("s0"), F.sum(x * j).alias("s1"), F.sum(x * j * (j - 1)).alias("s2"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"))
    )
    m = F.col("n").cast("double")
    enough = F.col("n") >= 3
    b0, b1, b2 = F.col("s0") / m, F.col("s1") / F.nullif(m * (m - 1), F.lit(0.0)), F.col("s2") / F.nullif(m * (m - 1) * (m - 2), F.lit(0.0))
    return sums.select(
        *by, "n", "mean", "variance",
        F.when(enough, b0).alias("l1"), F.when(enough, 2 * b1 - b0).alias("l2"), F.when(enough, 6 * b2 - 6 * b1 + b0).alias("l3"),
    )


def water_balance_index(series: DataFrame, k: int, least: int = 30, variant: str = "inverted") -> DataFrame:
    """Rolling sum, one generalised logistic fit for the whole record, normal quantile, clipped to 4 (column `index`)."""
    rolled = rolling_sum(series, k)
    fits = l_moments(rolled, ["gauge"], "rolled").filter(F.col("n") >= least)
    fits = fits.select("gauge", *[c.alias(name) for name, c in glo_parameters(F.col("l1"), F.col("l2"), F.col("l3"), variant).items()])
    p = glo_cdf(F.col("rolled"), F.col("xi"), F.col("alpha"), F.col("kappa"))
    out = rolled.join(fits, "gauge").withColumn("index", F.round(clip(norm_ppf(p), -4.0, 4.0), 4))
    return out.filter(F.col("index").isNotNull()).select("gauge", "period", "rolled", "index")


def gamma_fits(rolled: DataFrame, least_valid: int = 20, least_positive: int = 20, variant: str = "plain") -> DataFrame:
    """Gamma parameters and share of zeros for each gauge and calendar month."""
    keyed = rolled.withColumn("month", F.month("period"))
    held = keyed.groupBy("gauge", "month").agg(F.count("rolled").alias("valid"), F.count_if(F.col("rolled") == 0).alias("zeros"))
    fits = l_moments(keyed.filter(F.col("rolled") > 0), ["gauge", "month"], "rolled").filter(F.col("n") >= least_positive)
    shape = gamma_parameters(F.col("l1"), F.col("l2"), F.col("mean"), F.col("variance"), variant)
    fits = fits.select("gauge", "month", F.col("n").alias("positive"), *[c.alias(name) for name, c in shape.items()])
    return held.filter(F.col("valid") >= least_valid).join(fits, ["gauge", "month"]).withColumn("zero_share", F.col("zeros") / F.col("valid"))


def flow_index(series: DataFrame, k: int, least_valid: int = 20, least_positive: int = 20, least: int = 30) -> DataFrame:
    """Rolling sum, zero-inflated gamma fit for each calendar month, normal quantile, clipped to 4; null where there is no fit.

    A series of fewer than `least` rows has no fit at all."""
    rolled = rolling_sum(series, k).withColumn("month", F.month("period"))
    fits = gamma_fits(at_least(rolled.drop("month"), least), least_valid, least_positive)
    x, q = F.col("rolled"), F.col("zero_share")
    mixed = F.when(x == 0, q / 2).when(x > 0, q + (1 - q) * gamma_cdf(x, F.col("shape"), F.col("scale")))
    p = clip(mixed, 1e-6, 1 - 1e-6)
    return rolled.join(fits, ["gauge", "month"], "left").select("gauge", "period", "rolled", F.round(clip(norm_ppf(p), -4.0, 4.0), 4).alias("index"))


def frequent_events(index: DataFrame, columns: Sequence[str], level: float = -1.0, most: float = 50.0) -> DataFrame:
    """Gauges whose mean share (over the columns) of values at or below the level exceeds `most` percent."""
    shares = [F.avg(F.when(F.col(c).isNotNull(), (F.col(c) <= level).cast("double"))) * 100 for c in columns]
    held = index.groupBy("gauge").agg(*[s.alias(f"s{i}") for i, s in enumerate(shares)])
    cols = [F.col(f"s{i}") for i in range(len(columns))]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return held.withColumn("frequency", total / F.nullif(count, F.lit(0))).filter(F.col("frequency") > most).select("gauge", "frequency")

"""Base series of the registered queries, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import positions, regular, rolling_sum, zscore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _month(c: str):
    return F.to_date(F.date_trunc("month", F.col(c)))


def series(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """A: nation-month order totals; B: nation-month shipped quantity; C: user-day event value; D, E: supplier-month quantity and price;
    F: nation-day shipped quantity."""
    t = lambda name: table(spark, sf_dir, name)
    if which == "A":
        joined = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        return regular(joined.withColumn("g", F.col("c_nationkey").cast("long")), ["g"], F.col("o_totalprice"), _month("o_orderdate"))
    if which in "BF":
        joined = t("lineitem").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        return regular(joined.withColumn("g", F.col("s_nationkey").cast("long")), ["g"], F.col("l_quantity"), _month("l_shipdate") if which == "B" else F.to_date("l_shipdate"))
    if which == "C":
        return regular(t("events"), ["user_id"], F.col("value"), F.to_date("ts"))
    return regular(t("lineitem"), ["l_suppkey"], F.col("l_quantity" if which == "D" else "l_extendedprice"), _month("l_shipdate"))


def index(spark: SparkSession, sf_dir: str, which: str, k: int = 3) -> DataFrame:
    """Positions, rolling sum over k rows and its z-score (4 digits)."""
    return positions(zscore(rolling_sum(series(spark, sf_dir, which), k), "rolled"))


def half(x: str, digits: int) -> str:
    """SQL that rounds half away from zero also where a half is not exact in binary."""
    return f"round({x} + sign({x}) * 1e-{digits + 5}, {digits})"


BASE = {
    "A": "SELECT CAST(c_nationkey AS BIGINT) AS gauge, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "B": "SELECT CAST(s_nationkey AS BIGINT) AS gauge, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, round(sum(l_quantity), 2) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "C": "SELECT user_id AS gauge, CAST(ts AS DATE) AS period, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "D": "SELECT l_suppkey AS gauge, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2",
    "F": "SELECT CAST(s_nationkey AS BIGINT) AS gauge, CAST(l_shipdate AS DATE) AS period, round(sum(l_quantity), 2) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "E": "SELECT l_suppkey AS gauge, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2",
}


def rolled_sql(which: str, k: int) -> str:
    return (
        f"SELECT gauge, period, value, CASE WHEN count(value) OVER w = {k} THEN sum(value) OVER w END AS rolled "
        f"FROM ({BASE[which]}) WINDOW w AS (PARTITION BY gauge ORDER BY period ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    )


def index_sql(which: str, k: int = 3) -> str:
    """Aggregates joined back instead of windows."""
    return (
        f"SELECT r.gauge, r.period, r.value, r.rolled, round((r.rolled - s.m) / nullif(s.d, 0), 4) AS index, row_number() OVER (PARTITION BY r.gauge ORDER BY r.period) - 1 AS idx "
        f"FROM ({rolled_sql(which, k)}) r JOIN (SELECT gauge, avg(rolled) AS m, stddev_samp(rolled) AS d FROM ({rolled_sql(which, k)}) GROUP BY gauge) s USING (gauge)"
    )


def events_sql(which: str, k: int = 3, monthly: bool = True) -> str:
    """Events by self joins on positions: candidates, first stop row at least three on, groups by that row."""
    last = "last_day(max(CASE WHEN x.idx = p.term_idx THEN x.period END))" if monthly else "max(CASE WHEN x.idx = p.term_idx THEN x.period END)"
    return f"""
SELECT gauge, onset_idx, term_idx, onset_date, term_date, term_idx - onset_idx + 1 AS duration, round(total, 4) AS severity, round(peak, 4) AS peak,
       peak_date, peak_idx, {half('total / (term_idx - onset_idx + 1)', 4)} AS intensity, false_recoveries
FROM (
  WITH v AS (SELECT gauge, period, idx, index AS v FROM ({index_sql(which, k)})),
  n AS (SELECT gauge, count(*) AS n FROM v GROUP BY gauge),
  c AS (SELECT a.gauge, a.idx FROM v a JOIN v b ON b.gauge = a.gauge AND b.idx = a.idx + 1 JOIN v d ON d.gauge = a.gauge AND d.idx = a.idx + 2
        WHERE a.v <= -1 AND b.v <= -1 AND d.v <= -1),
  t AS (SELECT a.gauge, a.idx FROM v a JOIN v b ON b.gauge = a.gauge AND b.idx = a.idx + 1 WHERE a.v > -1 AND b.v > -0.5),
  s AS (SELECT c.gauge, c.idx, coalesce(min(t.idx), max(n.n)) AS nxt FROM c JOIN n ON n.gauge = c.gauge LEFT JOIN t ON t.gauge = c.gauge AND t.idx >= c.idx + 3 GROUP BY c.gauge, c.idx),
  p AS (SELECT gauge, min(idx) AS onset_idx, nxt - 1 AS term_idx FROM s GROUP BY gauge, nxt)
  SELECT p.gauge, p.onset_idx, p.term_idx, max(CASE WHEN x.idx = p.onset_idx THEN x.period END) AS onset_date, {last} AS term_date, sum(x.v) AS total, min(x.v) AS peak,
         min(CASE WHEN x.v = m.lo THEN x.period END) AS peak_date, min(CASE WHEN x.v = m.lo THEN x.idx END) AS peak_idx,
         CAST(count(*) FILTER (WHERE x.v > -1) AS INTEGER) AS false_recoveries
  FROM p JOIN v x ON x.gauge = p.gauge AND x.idx BETWEEN p.onset_idx AND p.term_idx
  JOIN (SELECT p.gauge, p.onset_idx, min(y.v) AS lo FROM p JOIN v y ON y.gauge = p.gauge AND y.idx BETWEEN p.onset_idx AND p.term_idx GROUP BY p.gauge, p.onset_idx) m
    ON m.gauge = p.gauge AND m.onset_idx = p.onset_idx
  GROUP BY p.gauge, p.onset_idx, p.term_idx)"""

"""Registered queries: every operator on the base series, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import events as ev
from ..operators import boosting, hydro, ml, recovery, stats
from ..operators import order as od
from ..operators import series as se
from ..session import scratch_path, stored_table
from ..sources import readers
from .base import BASE, events_sql, half, index, index_sql, rolled_sql, series, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- regular series ----------------------------------------------------------------------------

_MEAN = f"SELECT CAST(c_nationkey AS BIGINT) AS gauge, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, {half('avg(o_totalprice)', 2)} AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


@query(f"""WITH m AS ({_MEAN}), e AS (SELECT gauge, min(period) AS a, max(period) AS b FROM m GROUP BY gauge),
g AS (SELECT gauge, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS period FROM e)
SELECT g.gauge, g.period, m.value FROM g LEFT JOIN m ON m.gauge = g.gauge AND m.period = g.period""")
def monthly_mean_densified(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    means = se.regular(joined.withColumn("g", F.col("c_nationkey").cast("long")), ["g"], F.col("o_totalprice"), F.to_date(F.date_trunc("month", F.col("o_orderdate"))), F.avg)
    return se.densify(means).select("gauge", "period", "value")


def _rolling(which: str, k: int) -> Query:
    return lambda spark, sf_dir: se.rolling_sum(series(spark, sf_dir, which), k).select("gauge", "period", "value", F.round("rolled", 2).alias("rolled"))


for _w, _k in (("A", 3), ("B", 6)):
    QUERIES[f"rolling_sum_{_k}"] = _rolling(_w, _k)
    ORACLES[f"rolling_sum_{_k}"] = f"SELECT gauge, period, value, round(rolled, 2) AS rolled FROM ({rolled_sql(_w, _k)})"

_QC = f"""SELECT gauge, min(period) AS first, max(period) AS last, count(value) AS n,
 CAST(date_diff('day', min(period), max(period)) + 1 AS BIGINT) AS expected,
 round(100.0 * count(value) / (date_diff('day', min(period), max(period)) + 1), 4) AS completeness, round(date_diff('day', min(period), max(period)) / 365.25, 4) AS years FROM ({BASE['C']}) GROUP BY gauge"""


@query(_QC)
def series_qc(spark, sf_dir):
    return se.quality(series(spark, sf_dir, "C"), (F.datediff("last", "first") + 1).cast("long"))


@query(f"SELECT gauge, n, completeness FROM ({_QC}) WHERE completeness >= 90 AND n >= 25")
def series_qc_pass(spark, sf_dir):
    return series_qc(spark, sf_dir).filter("completeness >= 90 and n >= 25").select("gauge", "n", "completeness")


@query("SELECT gauge, period, round(index, 4) AS index FROM (" + index_sql("A") + ") UNION ALL SELECT gauge + 1000, period, round(index, 4) FROM (" + index_sql("B") + ")")
def zscore_index(spark, sf_dir):
    one = index(spark, sf_dir, "A").select("gauge", "period", "index")
    return one.unionByName(index(spark, sf_dir, "B").select((F.col("gauge") + 1000).alias("gauge"), "period", "index"))


# ---- distributions -----------------------------------------------------------------------------


def _moments_sql(rows: str, by: str, value: str) -> str:
    return f"""SELECT {by}, count(*) AS n, avg({value}) AS mean, var_samp({value}) AS variance, sum({value}) / count(*) AS b0, sum({value} * j) / nullif(count(*) * (count(*) - 1), 0) AS b1,
 sum({value} * j * (j - 1)) / nullif(CAST(count(*) AS DOUBLE) * (count(*) - 1) * (count(*) - 2), 0) AS b2
 FROM (SELECT {by}, {value}, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS DOUBLE) AS j FROM ({rows}) WHERE {value} IS NOT NULL) GROUP BY {by}"""


_LM = f"SELECT gauge, n, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3 FROM ({_moments_sql(rolled_sql('A', 3), 'gauge', 'rolled')}) WHERE n >= 3"


@query(f"SELECT gauge, n, round(l1, 2) AS l1, round(l2, 2) AS l2, round(l3, 2) AS l3 FROM ({_LM})")
def lmoments_per_group(spark, sf_dir):
    m = se.l_moments(se.rolling_sum(series(spark, sf_dir, "A"), 3), ["gauge"], "rolled").filter("n >= 3")
    return m.select("gauge", "n", *[F.round(c, 2).alias(c) for c in ("l1", "l2", "l3")])


_GLO = f"""SELECT gauge, n, l1 - alpha * (1 / kappa - pi() / sin(kappa * pi())) AS xi, alpha, kappa FROM (
 SELECT gauge, n, l1, -t AS kappa, l2 * abs(t) * pi() / sin(abs(t) * pi()) AS alpha FROM (SELECT *, greatest(-0.99, least(0.99, l3 / l2)) AS t FROM ({_LM})) WHERE n >= 30)"""


@query(f"SELECT gauge, n, round(xi, 2) AS xi, round(alpha, 2) AS alpha, round(kappa, 6) AS kappa FROM ({_GLO})")
def glo_params(spark, sf_dir):
    m = se.l_moments(se.rolling_sum(series(spark, sf_dir, "A"), 3), ["gauge"], "rolled").filter("n >= 30")
    p = fc.glo_parameters(F.col("l1"), F.col("l2"), F.col("l3"))
    return m.select("gauge", "n", F.round(p["xi"], 2).alias("xi"), F.round(p["alpha"], 2).alias("alpha"), F.round(p["kappa"], 6).alias("kappa"))



def _horner(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}) * {x} + {c!r}"
    return f"({out})"


_PPF = f"""CASE WHEN p < {fc.LOW} THEN {_horner(fc.C, 'q')} / {_horner(fc.D, 'q')} WHEN p > {1 - fc.LOW} THEN -{_horner(fc.C, 'u')} / {_horner(fc.D, 'u')}
 ELSE {_horner(fc.A, 'r')} * (p - 0.5) / {_horner(fc.B, 'r')} END"""


@query(f"""SELECT gauge, period, round(greatest(-4.0, least(4.0, {_PPF})), 4) AS index FROM (
 SELECT *, sqrt(-2 * ln(p)) AS q, sqrt(-2 * ln(1 - p)) AS u, (p - 0.5) * (p - 0.5) AS r FROM (
  SELECT v.gauge, v.period, greatest(1e-6, least(1 - 1e-6, 1 / (1 + power(greatest(1 - g.kappa * ((v.rolled - g.xi) / g.alpha), 1e-10), 1 / g.kappa)))) AS p
  FROM ({rolled_sql('A', 3)}) v JOIN ({_GLO}) g ON g.gauge = v.gauge WHERE v.rolled IS NOT NULL))""")
def glo_index(spark, sf_dir):
    return se.water_balance_index(series(spark, sf_dir, "A"), 3).select("gauge", "period", "index")


_MONTHLY = f"SELECT gauge, month(period) AS month, rolled FROM ({rolled_sql('B', 3)}) WHERE rolled > 0"


@query(f"""SELECT gauge, month, n, round(CASE WHEN ok THEN g ELSE mean * mean / variance END, 6) AS shape, round(CASE WHEN ok THEN b0 / g ELSE variance / mean END, 6) AS scale FROM (
 SELECT *, t > 0 AND t < 0.5 AND g > 0 AND g <= 1000 AS ok FROM (SELECT *, (1 - 0.308 * t) / (t - 0.05812 * t * t + 0.01765 * t * t * t) AS g FROM (
  SELECT *, (2 * b1 - b0) / b0 AS t FROM ({_moments_sql(_MONTHLY, 'gauge, month', 'rolled')}))) ) WHERE n >= 4""")
def gamma_params_by_month(spark, sf_dir):
    fits = se.gamma_fits(se.rolling_sum(series(spark, sf_dir, "B"), 3), least_valid=4, least_positive=4)
    return fits.select("gauge", "month", F.col("positive").alias("n"), F.round("shape", 6).alias("shape"), F.round("scale", 6).alias("scale"))


_FITS = f"""SELECT gauge, month, CASE WHEN ok THEN g ELSE mean * mean / variance END AS shape, CASE WHEN ok THEN b0 / g ELSE variance / mean END AS scale FROM (
 SELECT *, t > 0 AND t < 0.5 AND g > 0 AND g <= 1000 AS ok FROM (SELECT *, (1 - 0.308 * t) / (t - 0.05812 * t * t + 0.01765 * t * t * t) AS g FROM (
  SELECT *, (2 * b1 - b0) / b0 AS t FROM ({_moments_sql(_MONTHLY, 'gauge, month', 'rolled')}))) ) WHERE n >= 4"""


@query(f"""WITH v AS (SELECT gauge, period, month(period) AS month, rolled FROM ({rolled_sql('B', 3)})), f AS ({_FITS}),
z AS (SELECT gauge, month, count(*) FILTER (WHERE rolled = 0) / count(rolled) AS q FROM v WHERE gauge IN (SELECT gauge FROM v GROUP BY gauge HAVING count(*) >= 30) GROUP BY gauge, month HAVING count(rolled) >= 4),
c AS (SELECT v.gauge, v.period, CASE WHEN rolled = 0 THEN q / 2 WHEN rolled > 0 THEN q + (1 - q) * list_sum(list_transform(range(0, 600), lambda n: exp((shape + n) * ln(rolled / scale) - rolled / scale - lgamma(shape + n + 1)))) END AS p
 FROM v LEFT JOIN (SELECT f.*, z.q FROM f JOIN z USING (gauge, month)) g ON g.gauge = v.gauge AND g.month = v.month)
SELECT gauge, period, CASE WHEN p IS NOT NULL THEN round(greatest(-4.0, least(4.0, {_PPF})), 4) END AS index FROM (SELECT *, sqrt(-2 * ln(p)) AS q, sqrt(-2 * ln(1 - p)) AS u, (p - 0.5) * (p - 0.5) AS r
 FROM (SELECT gauge, period, CASE WHEN p IS NOT NULL THEN greatest(1e-6, least(1 - 1e-6, p)) END AS p FROM c))""")
def gamma_index(spark, sf_dir):
    return se.flow_index(series(spark, sf_dir, "B"), 3, least_valid=4, least_positive=4).select("gauge", "period", "index")


# ---- shaping -----------------------------------------------------------------------------------

_LONG = " UNION ALL ".join(f"SELECT gauge, period, {k} AS timescale, index FROM ({index_sql('A', k)})" for k in (3, 6))
_WIDE = f"SELECT gauge, period, max(CASE WHEN timescale = 3 THEN index END) AS driver_3, max(CASE WHEN timescale = 6 THEN index END) AS driver_6 FROM ({_LONG}) GROUP BY gauge, period"
_MERGED = f"""SELECT coalesce(a.gauge, b.gauge) AS gauge, coalesce(a.period, b.period) AS period, driver_3, driver_6, b.index AS response_3
 FROM ({_WIDE}) a FULL JOIN ({index_sql('B')}) b ON a.gauge = b.gauge AND a.period = b.period"""


@query(_MERGED)
def index_wide_merge(spark, sf_dir):
    long = [index(spark, sf_dir, "A", k).select("gauge", "period", F.lit(k).alias("timescale"), "index") for k in (3, 6)]
    wide = long[0].unionByName(long[1]).groupBy("gauge", "period").pivot("timescale", [3, 6]).agg(F.first("index", ignorenulls=True))
    wide = wide.withColumnsRenamed({"3": "driver_3", "6": "driver_6"})
    return wide.join(index(spark, sf_dir, "B").select("gauge", "period", F.col("index").alias("response_3")), ["gauge", "period"], "full")


@query(" UNION ALL ".join(f"SELECT gauge, period, '{c}' AS name, {c} AS value FROM ({_MERGED}) WHERE {c} IS NOT NULL" for c in ("driver_3", "driver_6", "response_3")))
def index_long_unpivot(spark, sf_dir):
    wide = index_wide_merge(spark, sf_dir)
    return wide.unpivot(["gauge", "period"], ["driver_3", "driver_6", "response_3"], "name", "value").filter("value is not null")


@query(f"""WITH i AS ({index_sql('B')}), f AS (SELECT gauge FROM i GROUP BY gauge HAVING 100.0 * avg(CASE WHEN index IS NOT NULL THEN CASE WHEN index <= -1 THEN 1.0 ELSE 0.0 END END) > 16)
SELECT gauge, period, index FROM i WHERE gauge NOT IN (SELECT gauge FROM f)""")
def arid_groups_removed(spark, sf_dir):
    i = index(spark, sf_dir, "B").select("gauge", "period", "index")
    return i.join(se.frequent_events(i, ["index"], most=16.0), "gauge", "left_anti")


# ---- events ------------------------------------------------------------------------------------


def _events(spark, sf_dir, which):
    return ev.detect(index(spark, sf_dir, which), monthly=which != "C")


@query(" UNION ALL ".join(f"SELECT '{w}' AS series, * FROM ({events_sql(w, 3, w != 'C')})" for w in "ABCD"))
def drought_events(spark, sf_dir):
    parts = [_events(spark, sf_dir, w).select(F.lit(w).alias("series"), "*") for w in "ABCD"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out




class _Sql:
    """Texts of matching at one timescale."""

    def __init__(self, k: int = 3):
        self.driver, self.response = events_sql("D", k), events_sql("E", k)
        self.cand = f"""SELECT r.gauge, d.onset_idx AS d_onset_idx, d.term_idx AS d_term_idx, d.term_date AS d_term_date, d.severity AS d_severity, r.onset_idx AS r_onset_idx, r.term_idx AS r_term_idx,
 r.onset_date AS r_onset_date, r.severity AS r_severity, r.duration AS r_duration, r.peak AS r_peak, r.peak_idx AS r_peak_idx, r.false_recoveries AS r_false_recoveries,
 greatest(0, least(d.term_idx, r.term_idx) - greatest(d.onset_idx, r.onset_idx) + 1) AS overlap, r.onset_idx - d.onset_idx AS propagation_lag, r.term_idx - d.term_idx AS event_recovery_lag
 FROM ({self.response}) r JOIN ({self.driver}) d ON d.gauge = r.gauge AND d.severity <= -3 AND d.term_idx >= r.onset_idx - 6 AND d.onset_idx <= r.onset_idx"""
        self.pairs = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gauge, r_onset_idx ORDER BY overlap DESC, propagation_lag, d_onset_idx) AS k FROM ({self.cand})) WHERE k = 1"
        self.buffered = f"""SELECT d.*, CASE WHEN severity > -3 THEN 'severity_below_threshold' ELSE 'no_matching_response' END AS reason FROM ({self.driver}) d
 WHERE NOT EXISTS (SELECT 1 FROM ({self.pairs}) p WHERE p.gauge = d.gauge AND p.d_onset_idx = d.onset_idx)"""
        self.alone = f"SELECT r.* FROM ({self.response}) r WHERE NOT EXISTS (SELECT 1 FROM ({self.cand}) p WHERE p.gauge = r.gauge AND p.r_onset_idx = r.onset_idx)"
        self.panel = f"""SELECT a.gauge, a.period, a.index AS driver, b.index AS response, row_number() OVER (PARTITION BY a.gauge ORDER BY a.period) - 1 AS idx, count(*) OVER (PARTITION BY a.gauge) AS n
 FROM ({index_sql('D', k)}) a JOIN ({index_sql('E', k)}) b ON a.gauge = b.gauge AND a.period = b.period"""


_S3 = _Sql(3)
_DRIVER, _RESPONSE, _CAND, _PAIRS, _BUFFERED, _ALONE = _S3.driver, _S3.response, _S3.cand, _S3.pairs, _S3.buffered, _S3.alone
_PAIR_COLS = "gauge, d_onset_idx, d_term_idx, d_severity, r_onset_idx, r_term_idx, r_severity, overlap, propagation_lag, event_recovery_lag"
_BY = ("gauge", "timescale")


class _Matched:
    """Events of D and E with their pairs and leftovers; with several timescales, for each of them.

    Both series come from one aggregation of lineitem and their events from one detection, stored once; so is the panel
    (by, period, driver, response) where it is read again."""

    def __init__(self, spark, sf_dir, timescales: tuple[int, ...] = (), keep_panel: bool = False):
        self.by = _BY if timescales else ("gauge",)
        panel = _panel(spark, sf_dir, timescales)
        self.panel = stored_table(panel, "panel") if keep_panel else panel
        events = ev.detect(self.panel.unpivot([*self.by, "period"], ["driver", "response"], "kind", "index"), by=("kind", *self.by))
        events = stored_table(events, "events")
        self.driver, self.response = (events.filter(F.col("kind") == k).drop("kind") for k in ("driver", "response"))
        self.pairs = ev.match(self.driver, self.response, self.by)
        self.buffered, self.alone = ev.buffered(self.driver, self.pairs, self.by), ev.independent(self.response, self.pairs, self.by)


def _panel(spark, sf_dir, timescales: tuple[int, ...] = ()) -> DataFrame:
    """by, period, driver, response: the indices of D and E side by side."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("gauge"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("period"))
    t = t.agg(fc.rounded(F.sum("l_quantity"), 2).alias("D"), fc.rounded(F.sum("l_extendedprice"), 2).alias("E"))
    scales = timescales or (3,)
    for k in scales:
        for c in "DE":
            t = se.zscore(se.rolling_sum(t, k, c, f"{c}{k}"), f"{c}{k}", f"index_{c}{k}")
    if not timescales:
        return t.select("gauge", "period", F.col("index_D3").alias("driver"), F.col("index_E3").alias("response"))
    parts = [F.struct(F.lit(k).alias("timescale"), F.col(f"index_D{k}").alias("driver"), F.col(f"index_E{k}").alias("response")) for k in scales]
    return t.select("gauge", "period", F.inline(F.array(*parts))).select("gauge", "timescale", "period", "driver", "response")


@query(f"SELECT {_PAIR_COLS} FROM ({_PAIRS})")
def matched_pairs(spark, sf_dir):
    return _Matched(spark, sf_dir).pairs.select(*_PAIR_COLS.split(", "))


@query(_BUFFERED)
def buffered_events(spark, sf_dir):
    return _Matched(spark, sf_dir).buffered


@query(_ALONE)
def independent_events(spark, sf_dir):
    return _Matched(spark, sf_dir).alone


@query(f"SELECT {_PAIR_COLS} FROM ({_PAIRS}) WHERE propagation_lag < 0")
def ssi_leads_pairs(spark, sf_dir):
    return ev.leads(_Matched(spark, sf_dir).pairs).select(*_PAIR_COLS.split(", "))


@query(f"""SELECT gauge, r_onset_date AS onset_date, r_severity AS severity, 'propagated' AS event_type FROM ({_PAIRS})
 UNION ALL SELECT gauge, onset_date, severity, 'buffered' FROM ({_BUFFERED}) UNION ALL SELECT gauge, onset_date, severity, 'independent' FROM ({_ALONE})""")
def union_events(spark, sf_dir):
    m = _Matched(spark, sf_dir)
    return ev.union_events(m.pairs, m.buffered, m.alone)


@query(f"""SELECT gauge, drivers, responses, matched, unique_drivers, mean_propagation_lag, median_propagation_lag, mean_recovery_lag, median_recovery_lag, buffered, independent, 0 AS leads,
 CASE WHEN drivers > 0 THEN {half('100.0 * unique_drivers / drivers', 1)} ELSE 0.0 END AS pct_propagated, CASE WHEN drivers > 0 THEN {half('100.0 * buffered / drivers', 1)} ELSE 0.0 END AS pct_buffered,
 CASE WHEN responses > 0 THEN {half('100.0 * matched / responses', 1)} ELSE 0.0 END AS pct_matched, CASE WHEN responses > 0 THEN {half('100.0 * independent / responses', 1)} ELSE 0.0 END AS pct_independent
FROM (SELECT g.gauge, coalesce(d.n, 0) AS drivers, coalesce(r.n, 0) AS responses, coalesce(p.n, 0) AS matched, coalesce(p.u, 0) AS unique_drivers, p.a AS mean_propagation_lag, p.b AS median_propagation_lag,
 p.c AS mean_recovery_lag, p.e AS median_recovery_lag, coalesce(b.n, 0) AS buffered, coalesce(i.n, 0) AS independent
 FROM (SELECT gauge FROM ({_DRIVER}) UNION SELECT gauge FROM ({_RESPONSE})) g
 LEFT JOIN (SELECT gauge, count(*) AS n FROM ({_DRIVER}) GROUP BY gauge) d ON d.gauge = g.gauge LEFT JOIN (SELECT gauge, count(*) AS n FROM ({_RESPONSE}) GROUP BY gauge) r ON r.gauge = g.gauge
 LEFT JOIN (SELECT gauge, count(*) AS n, count(DISTINCT d_onset_idx) AS u, {half('avg(propagation_lag)', 2)} AS a, {half('median(propagation_lag)', 2)} AS b, {half('avg(event_recovery_lag)', 2)} AS c,
   {half('median(event_recovery_lag)', 2)} AS e FROM ({_PAIRS}) GROUP BY gauge) p ON p.gauge = g.gauge
 LEFT JOIN (SELECT gauge, count(*) AS n FROM ({_BUFFERED}) GROUP BY gauge) b ON b.gauge = g.gauge LEFT JOIN (SELECT gauge, count(*) AS n FROM ({_ALONE}) GROUP BY gauge) i ON i.gauge = g.gauge)""")
def group_classification(spark, sf_dir):
    m = _Matched(spark, sf_dir)
    return ev.classify(m.driver, m.response, m.pairs, m.buffered, m.alone)


# ---- recovery ----------------------------------------------------------------------------------

def _recovery_sql(x: _Sql) -> str:
    return f"""WITH panel AS ({x.panel}), p AS (SELECT *, d_term_idx AS t FROM ({x.pairs})),
 j AS (SELECT p.*, z.n, z.response AS antecedent, least(p.t + 36, z.n) AS stop FROM p JOIN panel z ON z.gauge = p.gauge AND z.idx = p.t),
 l AS (SELECT j.gauge, j.r_onset_idx, min(CASE WHEN x.idx >= j.t AND x.response > -0.5 THEN x.idx END) AS ok, min(CASE WHEN x.idx > j.r_peak_idx AND x.response >= j.r_peak / 2 THEN x.idx END) AS half,
   avg(CASE WHEN x.idx >= j.t AND x.idx < j.t + 3 THEN x.driver END) AS r3, avg(CASE WHEN x.idx >= j.t AND x.idx < j.t + 6 THEN x.driver END) AS r6,
   coalesce(sum(CASE WHEN x.idx >= j.t AND x.idx < j.t + 6 THEN x.driver END), 0) AS post
   FROM j JOIN panel x ON x.gauge = j.gauge AND x.idx < j.stop GROUP BY j.gauge, j.r_onset_idx)
SELECT j.gauge, j.r_onset_idx, j.d_term_idx, j.d_severity, j.propagation_lag, j.event_recovery_lag, j.r_duration, j.r_severity, coalesce(l.ok, j.stop) - j.t AS recovery_lag, l.ok IS NULL AS recovery_censored, j.antecedent,
 CASE WHEN l.half IS NOT NULL THEN l.half - j.r_peak_idx ELSE greatest(j.stop - j.r_peak_idx, 0) END AS half_life, l.half IS NULL AS half_life_censored,
 CAST(month(j.d_term_date) AS INTEGER) AS term_month, round(sin(month(j.d_term_date) * (2 * pi() / 12)), 6) AS term_sin, round(cos(month(j.d_term_date) * (2 * pi() / 12)), 6) AS term_cos,
 {half('l.r3', 4)} AS rebound_3, {half('l.r6', 4)} AS rebound_6, round(l.post, 4) AS post_signal, CASE WHEN j.r_false_recoveries > 0 THEN 1 ELSE 0 END AS had_false_recovery
FROM j JOIN l ON l.gauge = j.gauge AND l.r_onset_idx = j.r_onset_idx"""


_RECOVERY = _recovery_sql(_S3)
_RECOVERY_COLS = "gauge r_onset_idx d_term_idx d_severity propagation_lag event_recovery_lag r_duration r_severity recovery_lag recovery_censored antecedent half_life half_life_censored term_month term_sin term_cos rebound_3 rebound_6 post_signal had_false_recovery".split()


@query(_RECOVERY)
def recovery_metrics(spark, sf_dir):
    m = _Matched(spark, sf_dir, keep_panel=True)
    return recovery.recovery(m.pairs, m.panel).select(*_RECOVERY_COLS)


def _rollup_sql(rows: str, by: str = "gauge") -> str:
    m = lambda how, c: half(f"{how}({c})", 4)
    return f"""SELECT {by}, count(recovery_lag) AS n_pairs, {m('median', 'propagation_lag')} AS median_propagation_lag, {m('avg', 'propagation_lag')} AS mean_propagation_lag,
 {m('median', 'recovery_lag')} AS median_recovery_lag, {m('avg', 'recovery_lag')} AS mean_recovery_lag, {m('median', 'half_life')} AS median_half_life, {m('avg', 'half_life')} AS mean_half_life,
 {m('avg', 'had_false_recovery')} AS p_false_recovery, {m('avg', 'd_severity')} AS mean_d_severity, {m('avg', 'r_severity')} AS mean_r_severity, {m('median', 'antecedent')} AS median_antecedent,
 {m('median', 'rebound_3')} AS median_rebound_3, {m('median', 'rebound_6')} AS median_rebound_6 FROM ({rows}) GROUP BY {by}"""


@query(_rollup_sql(_RECOVERY))
def group_recovery_rollup(spark, sf_dir):
    return recovery.rollup(recovery_metrics(spark, sf_dir))


@query(f"""SELECT *, CASE WHEN n_buffered > 2 * n_independent THEN 'buffered' WHEN n_independent > 2 * n_buffered THEN 'independent' ELSE 'mixed' END AS typology FROM (
 SELECT coalesce(a.gauge, b.gauge) AS gauge, coalesce(a.n, 0) AS n_buffered, coalesce(b.n, 0) AS n_independent FROM (SELECT gauge, count(*) AS n FROM ({_BUFFERED}) GROUP BY gauge) a
 FULL JOIN (SELECT gauge, count(*) AS n FROM ({_ALONE}) GROUP BY gauge) b ON a.gauge = b.gauge)""")
def event_typology(spark, sf_dir):
    m = _Matched(spark, sf_dir)
    return recovery.typology(m.buffered, m.alone)


@query(f"SELECT reason, count(*) AS n FROM ({_BUFFERED}) GROUP BY reason")
def value_counts(spark, sf_dir):
    return _Matched(spark, sf_dir).buffered.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- bins --------------------------------------------------------------------------------------

_JOINED = "SELECT c_acctbal, o_totalprice, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"""WITH j AS ({_JOINED}), e AS (SELECT quantile_cont(c_acctbal, 0.25) AS a1, quantile_cont(c_acctbal, 0.5) AS a2, quantile_cont(c_acctbal, 0.75) AS a3, quantile_cont(o_totalprice, 1.0/3) AS b1, quantile_cont(o_totalprice, 2.0/3) AS b2 FROM j),
b AS (SELECT 1 + (c_acctbal > a1)::INT + (c_acctbal > a2)::INT + (c_acctbal > a3)::INT AS balance_bin, 1 + (o_totalprice > b1)::INT + (o_totalprice > b2)::INT AS price_bin, o_totalprice FROM j, e)
SELECT balance_bin, {half('median(CASE WHEN price_bin = 1 THEN o_totalprice END)', 2)} AS p1, {half('median(CASE WHEN price_bin = 2 THEN o_totalprice END)', 2)} AS p2, {half('median(CASE WHEN price_bin = 3 THEN o_totalprice END)', 2)} AS p3 FROM b GROUP BY balance_bin""")
def quantile_bin_pivot(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    edges = od.quantiles(j, {"c_acctbal": [0.0, 0.25, 0.5, 0.75, 1.0], "o_totalprice": [0.0, 1 / 3, 2 / 3, 1.0]})
    binned = j.withColumns({f"{name}_bin": fc.quantile_bin(F.col(c), edges[c]) for name, c in (("balance", "c_acctbal"), ("price", "o_totalprice"))})
    out = binned.groupBy("balance_bin").pivot("price_bin", [1, 2, 3]).agg(fc.rounded(F.median("o_totalprice"), 2))
    return out.withColumnsRenamed({"1": "p1", "2": "p2", "3": "p3"})


_TIED = ", ".join(str(i / 20) for i in range(21))


@query(f"""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_discount, [{_TIED}]))) AS e FROM lineitem)
SELECT CAST(1 + len(list_filter(e[2:len(e) - 1], lambda x: l_discount > x)) AS INTEGER) AS bin, count(*) AS n, min(l_discount) AS least, max(l_discount) AS most FROM lineitem, e GROUP BY 1""")
def tied_quantile_bins(spark, sf_dir):
    """Twenty bins asked of a column with eleven values: equal edges are one."""
    t = table(spark, sf_dir, "lineitem")
    edges = od.quantiles(t, {"l_discount": [i / 20 for i in range(21)]})["l_discount"]
    bins = t.select(fc.quantile_bin(F.col("l_discount"), edges).alias("bin"), "l_discount")
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("l_discount").alias("least"), F.max("l_discount").alias("most"))


@query("""SELECT bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * 2000.0), 9) AS density FROM (
 SELECT CAST(least(49, floor(greatest(0, least(100000.0, l_extendedprice)) / 2000)) AS INTEGER) AS bin FROM lineitem) GROUP BY bin""")
def histogram_density(spark, sf_dir):
    x = fc.clip(F.col("l_extendedprice"), 0.0, 100000.0)
    bins = table(spark, sf_dir, "lineitem").select(F.least(F.lit(49), F.floor(x / 2000)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = bins.agg(F.sum("n").alias("total"))
    return bins.join(F.broadcast(total)).select("bin", "n", F.round(F.col("n") / (F.col("total") * 2000.0), 9).alias("density"))  # total: one row


@query("SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS x, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def density_grid(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.floor(F.col("l_quantity") / 5).alias("x"), F.floor(F.col("l_extendedprice") / 10000).alias("y")).agg(F.count(F.lit(1)).alias("n"))


# ---- flow memory -------------------------------------------------------------------------------

_POS = "SELECT gauge, period, value AS q, row_number() OVER (PARTITION BY gauge ORDER BY period) - 1 AS idx FROM ({})"


def _segments_sql(rows: str) -> str:
    """Islands by the difference of positions and row numbers."""
    return f"""SELECT gauge, start_idx, CAST(points AS BIGINT) AS points, has_zero, slope FROM (
 WITH v AS ({_POS.format(rows)}), f AS (SELECT a.gauge, a.idx FROM v a JOIN v b ON b.gauge = a.gauge AND b.idx = a.idx + 1 WHERE b.q <= a.q AND a.q > 0),
 g AS (SELECT gauge, idx, idx - row_number() OVER (PARTITION BY gauge ORDER BY idx) AS island FROM f),
 r AS (SELECT gauge, min(idx) AS a, max(idx) + 1 AS b FROM g GROUP BY gauge, island HAVING count(*) >= 4)
 SELECT r.gauge, r.a AS start_idx, count(*) AS points, max(CASE WHEN v.q <= 0 THEN 1 ELSE 0 END) AS has_zero, regr_slope(CASE WHEN v.q > 0 THEN ln(v.q) END, v.idx) AS slope
 FROM r JOIN v ON v.gauge = r.gauge AND v.idx BETWEEN r.a AND r.b GROUP BY r.gauge, r.a)"""


@query(f"SELECT gauge, start_idx, points, has_zero, round(slope, 6) AS slope FROM ({_segments_sql(BASE['C'])})")
def recession_segments(spark, sf_dir):
    return hydro.recession_segments(series(spark, sf_dir, "C")).select("gauge", "start_idx", "points", "has_zero", F.round("slope", 6).alias("slope"))


@query(f"""SELECT gauge, n_segments, n_used, round(-1 / b, 2) AS k, round(iqr, 2) AS k_iqr FROM (SELECT gauge, count(*) AS n_segments, count(s) AS n_used, median(s) AS b,
 quantile_cont(-1 / s, 0.75) - quantile_cont(-1 / s, 0.25) AS iqr FROM (SELECT gauge, CASE WHEN has_zero = 0 AND slope < 0 THEN slope END AS s FROM ({_segments_sql(BASE['D'])})) GROUP BY gauge) WHERE n_segments >= 1 AND n_used >= 1""")
def recession_k(spark, sf_dir):
    return hydro.recession_constant(series(spark, sf_dir, "D"), segments=1)


@query(f"""SELECT gauge, n, CASE WHEN n > 10 THEN round(k, 6) END AS k FROM (SELECT gauge, count(*) AS n, median(CASE WHEN -q / d > 0 AND -q / d < 1000 THEN -q / d END) AS k
 FROM (SELECT gauge, value AS q, lead(value) OVER (PARTITION BY gauge ORDER BY period) - value AS d FROM ({BASE['C']})) WHERE d < 0 GROUP BY gauge)""")
def recession_k_ratio(spark, sf_dir):
    return hydro.recession_ratio(series(spark, sf_dir, "C"))


def _trailing_sql(rows: str, events: str, days: int, least: int) -> str:
    return f"""SELECT gauge, event_date, n, {half('m', 2)} AS mean_value, round(s / nullif(m, 0), 4) AS cv, {half('z', 4)} AS zero_share FROM (
 SELECT e.gauge, e.event_date, count(*) AS n, avg(v.value) AS m, stddev_pop(v.value) AS s, avg(CASE WHEN v.value = 0 THEN 1.0 ELSE 0.0 END) AS z
 FROM (SELECT DISTINCT gauge, onset_date AS event_date FROM ({events})) e JOIN ({rows}) v ON v.gauge = e.gauge AND v.period >= e.event_date - {days} AND v.period < e.event_date GROUP BY 1, 2) WHERE n >= {least}"""


_TRAILING = _trailing_sql(BASE["C"], events_sql("C", 3, False), 7, 3)
_LONG_TRAILING = _trailing_sql(BASE["F"], events_sql("B"), 1095, 365)


@query(_TRAILING)
def trailing_window_stats(spark, sf_dir):
    onsets = _events(spark, sf_dir, "C").select("gauge", F.col("onset_date").alias("event_date"))
    return hydro.trailing_stats(onsets, series(spark, sf_dir, "C"), days=7, least=3)


@query(_LONG_TRAILING)
def trailing_three_years(spark, sf_dir):
    """Three years of daily values before each event, 365 of them at least."""
    onsets = _events(spark, sf_dir, "B").select("gauge", F.col("onset_date").alias("event_date"))
    return hydro.trailing_stats(onsets, series(spark, sf_dir, "F"), days=1095, least=365)


_FEATURES = ("mean_value", "cv", "zero_share")


@query(f"SELECT gauge, {', '.join(half(f'median({c})', 6) + f' AS median_{c}' for c in _FEATURES)}, median(n) AS median_n, count(n) AS n_lags FROM ({_LONG_TRAILING}) GROUP BY gauge")
def basin_dynamic_medians(spark, sf_dir):
    return recovery.dynamic_by_group(trailing_three_years(spark, sf_dir), _FEATURES, lag="n")


@query(f"SELECT gauge, {', '.join(half(f'avg({c})', 6) + f' AS mean_{c}' for c in _FEATURES)} FROM ({_LONG_TRAILING}) GROUP BY gauge")
def basin_dynamic_means(spark, sf_dir):
    return recovery.dynamic_by_group(trailing_three_years(spark, sf_dir), _FEATURES, how="mean")


_GAPS = f"""SELECT g.gauge, g.period, m.value FROM (SELECT gauge, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS period
 FROM (SELECT gauge, min(period) AS a, max(period) AS b FROM ({BASE['D']}) GROUP BY gauge)) g LEFT JOIN ({BASE['D']}) m ON m.gauge = g.gauge AND m.period = g.period"""


@query(f"""SELECT h.gauge, n_days, {half('n_days / 365.25', 1)} AS data_years, CASE WHEN n_days >= 70 THEN k.k END AS recession_k, CASE WHEN n_days >= 70 THEN k.iqr END AS recession_k_iqr, CASE WHEN n_days >= 70 THEN {half('m', 2)} END AS mean_value,
 CASE WHEN n_days >= 70 AND m > 0 THEN round(s / m, 4) END AS cv, CASE WHEN n_days >= 70 THEN {half('z', 4)} END AS zero_share
 FROM (SELECT gauge, count(value) AS n_days, avg(value) AS m, stddev_pop(value) AS s, avg(CASE WHEN value = 0 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END) AS z FROM ({_GAPS}) GROUP BY gauge) h
 LEFT JOIN (SELECT gauge, round(-1 / b, 2) AS k, round(iqr, 2) AS iqr FROM (SELECT gauge, count(s) AS used, median(s) AS b, quantile_cont(-1 / s, 0.75) - quantile_cont(-1 / s, 0.25) AS iqr
  FROM (SELECT gauge, CASE WHEN has_zero = 0 AND slope < 0 THEN slope END AS s FROM ({_segments_sql(f"SELECT gauge, period, coalesce(value, 0) AS value FROM ({_GAPS})")})) GROUP BY gauge) WHERE used >= 1) k ON k.gauge = h.gauge""")
def static_memory(spark, sf_dir):
    """Whole-record features of monthly series with gaps."""
    return hydro.static_features(se.densify(series(spark, sf_dir, "D")), least=70, segments=1)


def _baseflow_sql(definition: str, least: int = 10, alpha: float = 0.925) -> str:
    """Three passes of the recursion, forward, backward, forward, as recursive tables."""
    bound = "least(greatest(0, {x}), n.b)" if definition == "A" else "greatest(0, {x})"
    text = [f"WITH RECURSIVE v0 AS (SELECT gauge, row_number() OVER (PARTITION BY gauge ORDER BY period) AS i, value AS q, value AS b FROM ({BASE['D']}))"]
    for k in range(3):
        turn = "DESC" if k % 2 else "ASC"
        text.append(f"o{k} AS (SELECT gauge, i, q, b, row_number() OVER (PARTITION BY gauge ORDER BY i {turn}) AS j FROM v{k})")
        step = bound.format(x=f"{alpha} * r.f + {(1 + alpha) / 2} * (n.b - r.b)")
        text.append(f"r{k} AS (SELECT gauge, j, b, CAST(0 AS DOUBLE) AS f FROM o{k} WHERE j = 1 UNION ALL SELECT n.gauge, n.j, n.b, {step} FROM r{k} r JOIN o{k} n ON n.gauge = r.gauge AND n.j = r.j + 1)")
        rest = "greatest(o.b - r.f, 0)"
        text.append(f"v{k + 1} AS (SELECT o.gauge, o.i, o.q, {f'least({rest}, o.q)' if definition == 'A' else rest} AS b FROM o{k} o JOIN r{k} r ON r.gauge = o.gauge AND r.j = o.j)")
    return ", ".join(text) + f" SELECT gauge, count(*) AS n, round(sum(b) / sum(q), {4 if definition == 'A' else 9}) AS bfi FROM v3 GROUP BY gauge HAVING count(*) >= {least} AND sum(q) <> 0"


@query(_baseflow_sql("A"))
def baseflow_index_a(spark, sf_dir):
    return hydro.baseflow_index(series(spark, sf_dir, "D"), least=10)


@query(_baseflow_sql("B"))
def baseflow_index_b(spark, sf_dir):
    return hydro.baseflow_index(series(spark, sf_dir, "D"), least=10, definition="B")


def _memory_sql(definition: str, alpha: float = 0.925) -> str:
    """Windows of F before events of B: three passes of the recursion for each window as recursive tables, recessions as islands."""
    one, digits = definition == "A", (4, 2, 2, 2, 4, 4) if definition == "A" else (9,) * 6
    bound = "least(greatest(0, {x}), n.b)" if one else "greatest(0, {x})"
    text = [f"""WITH RECURSIVE ev AS (SELECT DISTINCT gauge, onset_date AS event_date FROM ({events_sql("B")})), d AS ({BASE['F']}),
 w AS (SELECT e.gauge || '|' || e.event_date AS e, d.value AS q, row_number() OVER (PARTITION BY e.gauge, e.event_date ORDER BY d.period) AS i
  FROM ev e JOIN d ON d.gauge = e.gauge AND d.period >= e.event_date - 1095 AND {'d.period < e.event_date' if one else 'd.period <= e.event_date AND d.value >= 0'}),
 c AS (SELECT e, count(*) AS n, avg(q) AS m, stddev_pop(q) AS s, avg(CASE WHEN q = 0 THEN 1.0 ELSE 0.0 END) AS z FROM w GROUP BY e),
 v0 AS (SELECT e, i, q, q AS b FROM w WHERE e IN (SELECT e FROM c WHERE n >= 365))"""]
    for k in range(3):
        text.append(f"o{k} AS (SELECT e, i, q, b, row_number() OVER (PARTITION BY e ORDER BY i {'DESC' if k % 2 else 'ASC'}) AS j FROM v{k})")
        step = bound.format(x=f"{alpha} * r.f + {(1 + alpha) / 2} * (n.b - r.b)")
        text.append(f"r{k} AS (SELECT e, j, b, CAST(0 AS DOUBLE) AS f FROM o{k} WHERE j = 1 UNION ALL SELECT n.e, n.j, n.b, {step} FROM r{k} r JOIN o{k} n ON n.e = r.e AND n.j = r.j + 1)")
        rest = "greatest(o.b - r.f, 0)"
        text.append(f"v{k + 1} AS (SELECT o.e, o.i, o.q, {f'least({rest}, o.q)' if one else rest} AS b FROM o{k} o JOIN r{k} r ON r.e = o.e AND r.j = o.j)")
    text.append("f AS (SELECT e, sum(b) / sum(q) AS bfi FROM v3 GROUP BY e HAVING sum(q) <> 0)")
    if one:
        slopes = _segments_sql("SELECT e AS gauge, i AS period, greatest(q, 0) AS value FROM v0")
        text.append(f"""k AS (SELECT e, -1 / median(s) AS k, quantile_cont(-1 / s, 0.75) - quantile_cont(-1 / s, 0.25) AS spread FROM (SELECT gauge AS e, CASE WHEN has_zero = 0 AND slope < -1e-13 THEN slope END AS s FROM ({slopes}))
 GROUP BY e HAVING count(s) >= 3)""")
    else:
        text.append("""k AS (SELECT e, CASE WHEN count(*) > 10 THEN median(CASE WHEN -q / x > 0 AND -q / x < 1000 THEN -q / x END) END AS k, CAST(NULL AS DOUBLE) AS spread
 FROM (SELECT e, q, lead(q) OVER (PARTITION BY e ORDER BY i) - q AS x FROM v0) WHERE x < 0 GROUP BY e)""")
    full = lambda x, at: f"CASE WHEN n >= 365 THEN {half(x, digits[at])} END"
    return ", ".join(text) + f""" SELECT ev.gauge, ev.event_date, coalesce(n, 0) AS n, {full('bfi', 0)} AS bfi, {full('k', 1)} AS recession_k, {full('spread', 2)} AS recession_k_iqr, {full('m', 3)} AS mean_value,
 {full('CASE WHEN m > 0 THEN s / m END', 4)} AS cv, {full('z', 5)} AS zero_share FROM ev LEFT JOIN c ON c.e = ev.gauge || '|' || ev.event_date LEFT JOIN f ON f.e = c.e LEFT JOIN k ON k.e = c.e"""


def _memory(spark, sf_dir, definition: str) -> DataFrame:
    onsets = _events(spark, sf_dir, "B").select("gauge", F.col("onset_date").alias("event_date"))
    return hydro.event_memory(onsets, series(spark, sf_dir, "F"), definition)


_MEMORY = {d: _memory_sql(d) for d in "AB"}
_MEMORY_COLS = ("bfi", "recession_k", "cv", "zero_share", "mean_value")


@query(_MEMORY["A"])
def event_memory_a(spark, sf_dir):
    """Baseflow, recession and flow of the three years before each event, the event's day left out."""
    return _memory(spark, sf_dir, "A")


@query(_MEMORY["B"])
def event_memory_b(spark, sf_dir):
    """The same by the other definitions, the event's day included."""
    return _memory(spark, sf_dir, "B")


@query(f"SELECT gauge, {', '.join(half(f'median({c})', 6) + f' AS median_{c}' for c in _MEMORY_COLS)} FROM ({_MEMORY['A']}) GROUP BY gauge")
def basin_memory_medians(spark, sf_dir):
    return recovery.dynamic_by_group(_memory(spark, sf_dir, "A"), _MEMORY_COLS)


@query(f"SELECT gauge, {', '.join(half(f'avg({c})', 6) + f' AS mean_{c}' for c in _MEMORY_COLS)} FROM ({_MEMORY['B']}) GROUP BY gauge")
def basin_memory_means(spark, sf_dir):
    return recovery.dynamic_by_group(_memory(spark, sf_dir, "B"), _MEMORY_COLS, how="mean")


# ---- relational shapes -------------------------------------------------------------------------


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY abs(s_acctbal) DESC, s_suppkey LIMIT 8")
def topk_by_abs(spark, sf_dir):
    return table(spark, sf_dir, "supplier").orderBy(F.abs("s_acctbal").desc(), "s_suppkey").limit(8).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_selected(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000 AND s_nationkey BETWEEN 3 AND 20")
def map_extent_filter(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter(F.col("s_acctbal").between(0, 5000) & F.col("s_nationkey").between(3, 20)).select("s_suppkey", "s_acctbal")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_per_key(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).filter("k = 1").select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT DISTINCT 'file_' || (s_nationkey % 7) AS raw_file FROM supplier WHERE s_acctbal > 9000""")
def explode_manifest(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    manifest = s.groupBy(F.concat(F.lit("file_"), (F.col("s_nationkey") % 7).cast("string")).alias("raw_file")).agg(F.array_join(F.sort_array(F.collect_set(F.col("s_suppkey").cast("string"))), ",").alias("sites"))
    return readers.manifest_files(manifest, s.filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("gauge")))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, round(t.m, 2)) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) t ON o_custkey = c_custkey""")
def update_missing(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.avg("o_totalprice"), 2).alias("c_acctbal"))
    return readers.fill_missing(old, new, ["c_custkey"], ["c_acctbal"])


@query(f"SELECT round(100 * avg(CASE WHEN driver_3 IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS driver_3, round(100 * avg(CASE WHEN driver_6 IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS driver_6, round(100 * avg(CASE WHEN response_3 IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS response_3 FROM ({_MERGED})")
def completeness(spark, sf_dir):
    return index_wide_merge(spark, sf_dir).agg(*[F.round(100 * F.avg(F.col(c).isNotNull().cast("double")), 4).alias(c) for c in ("driver_3", "driver_6", "response_3")])


@query(f"SELECT gauge, period, round(avg(value) OVER (PARTITION BY gauge ORDER BY period ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 2) AS smooth FROM ({BASE['D']})")
def centred_average(spark, sf_dir):
    w = W.partitionBy("gauge").orderBy("period").rowsBetween(-2, 2)
    return series(spark, sf_dir, "D").select("gauge", "period", F.round(F.avg("value").over(w), 2).alias("smooth"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS y, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n, greatest(count(*) OVER () // 15, 15) AS w FROM orders),
m AS (SELECT i AS pos, y FROM o UNION ALL SELECT -i - 1, y FROM o WHERE i < w UNION ALL SELECT 2 * n - 1 - i, y FROM o WHERE i >= n - w), p AS (SELECT pos, sum(y) OVER (ORDER BY pos) AS run FROM m)
SELECT o_orderkey, round((b.run - a.run) / w, 4) AS smooth FROM o JOIN p a ON a.pos = i - w // 2 - 1 JOIN p b ON b.pos = i - w // 2 + w - 1""")
def smoothed_trend(spark, sf_dir):
    """Mean customer key around each order by price, over a fifteenth of all orders, mirrored at both ends."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    out = od.reflected_average(t, ["o_totalprice", "o_orderkey"], "o_custkey", max(t.count() // 15, 15))
    return out.select("o_orderkey", F.round("smooth", 4).alias("smooth"))


# ---- statistics --------------------------------------------------------------------------------

NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRED = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]


@query("SELECT " + ", ".join(f"round(corr({a}, {b}), 6) AS r_{a}_{b}" for a, b in _PAIRED) + " FROM lineitem")
def pearson_matrix(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(*[F.round(fc.correlation(F.col(a), F.col(b)), 6).alias(f"r_{a}_{b}") for a, b in _PAIRED])


@query(" UNION ALL ".join(f"""SELECT '{c}' AS name, n, round(rho, 6) AS rho FROM (SELECT count(*) AS n, corr(rx, ry) AS rho FROM (
 SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem))""" for c in ("l_quantity", "l_discount", "l_tax")))
def spearman_vs_target(spark, sf_dir):
    rows = stats.spearman(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return spark.createDataFrame([(name, n, round(rho, 6)) for name, n, rho, _ in rows], "name string, n long, rho double")


_REGIME_ROWS = f"""SELECT gauge, x, y, x / (x + 50.0) AS bfi, y / 1000.0 AS k FROM (SELECT a.gauge, a.period, a.value AS x, b.value AS y FROM ({BASE['D']}) a JOIN ({BASE['E']}) b ON a.gauge = b.gauge AND a.period = b.period)
 UNION ALL SELECT gauge + 100000, x, CASE WHEN place > 1 THEN y END, x / (x + 50.0), y / 1000.0 FROM (SELECT a.gauge, a.value AS x, b.value AS y, row_number() OVER (PARTITION BY a.gauge ORDER BY a.period) AS place
  FROM ({BASE['D']}) a JOIN ({BASE['E']}) b ON a.gauge = b.gauge AND a.period = b.period) WHERE place <= gauge % 7 + 1"""


@query(f"""WITH t AS ({_REGIME_ROWS}), g AS (SELECT gauge, count(*) AS n, median(bfi) AS bfi, median(k) AS k FROM t GROUP BY gauge),
c AS (SELECT gauge, corr(rx, ry) AS rho FROM (SELECT gauge, rank() OVER (PARTITION BY gauge ORDER BY x) + (count(*) OVER (PARTITION BY gauge, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY gauge ORDER BY y) + (count(*) OVER (PARTITION BY gauge, y) - 1) / 2.0 AS ry FROM t WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY gauge HAVING count(*) > 4)
SELECT g.gauge, n, round(rho, 6) AS rho, round(bfi, 6) AS bfi, {half("k", 2)} AS k, CASE WHEN rho < -0.3 AND bfi < 0.4 THEN 'Climate-controlled' WHEN bfi > 0.6 AND k > 20 THEN 'Memory-controlled' ELSE 'Mixed' END AS regime
FROM g LEFT JOIN c ON c.gauge = g.gauge WHERE n >= 3""")
def group_spearman_regime(spark, sf_dir):
    """Regimes of suppliers, and of their first one to seven months, of which the first has no y."""
    both = series(spark, sf_dir, "D").withColumnRenamed("value", "x").join(series(spark, sf_dir, "E").withColumnRenamed("value", "y"), ["gauge", "period"])
    few = both.withColumn("place", F.row_number().over(W.partitionBy("gauge").orderBy("period"))).filter(F.col("place") <= F.col("gauge") % 7 + 1)
    few = few.select((F.col("gauge") + 100000).alias("gauge"), "x", F.when(F.col("place") > 1, F.col("y")).alias("y0"), "y")
    rows = both.select("gauge", "x", F.col("y").alias("y0"), "y").unionByName(few).withColumns({"bfi": F.col("x") / (F.col("x") + 50.0), "k": F.col("y") / 1000.0})
    out = stats.regimes(rows.drop("y").withColumnRenamed("y0", "y"), "x", "y", "bfi", "k")
    return out.select("gauge", "n", F.round("rho", 6).alias("rho"), F.round("bfi", 6).alias("bfi"), fc.rounded(F.col("k"), 2).alias("k"), "regime")


@query("SELECT " + ", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_{c}, round(stddev_samp({c}), 6) AS std_{c}" for c in NUMERIC) + " FROM lineitem")
def column_screen(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(*[x for c in NUMERIC for x in (F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(f"missing_{c}"), F.round(F.stddev_samp(c), 6).alias(f"std_{c}"))])


def _features(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))


FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]
GROUPS = {"amount": ["l_quantity"], "terms": ["l_discount", "l_tax"], "part": ["p_size", "p_retailprice"]}


_SCREENED = ["l_quantity", "l_extendedprice", "gross", "l_discount", "l_tax", "p_size", "p_retailprice"]
_JOINED_PART = "SELECT *, l_extendedprice * (1 + l_tax) AS gross FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(f"""WITH j AS ({_JOINED_PART}), r AS ({' UNION ALL '.join(f"SELECT '{b}' AS name, corr({a}, {b}) AS r FROM j" for i, a in enumerate(_SCREENED) for b in _SCREENED[i + 1:])})
SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS place, name FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(_SCREENED))}) n(place, name)
WHERE name NOT IN (SELECT name FROM r WHERE abs(r) >= 0.7)""")  # variance inflation takes nothing more here
def screened_predictors(spark, sf_dir):
    names = _SCREENED
    return spark.createDataFrame([(i, c) for i, c in enumerate(stats.screen(_features(spark, sf_dir), names))], "place int, name string")


@query("SELECT 'l_quantity' AS name, round(regr_slope(l_extendedprice, l_quantity), 4) AS beta, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_fit(spark, sf_dir):
    fit = stats.Gram.of(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"]).fit("l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([("l_quantity", round(float(fit["beta"][0]), 4), round(float(fit["intercept"]), 2), round(float(fit["r2"]), 6))], "name string, beta double, intercept double, r2 double")


@query("""SELECT 'amount' AS block, round(a * a, 6) AS r2 FROM (SELECT corr(l_extendedprice, l_quantity) AS a FROM lineitem)
 UNION ALL SELECT 'rate' AS block, round((a * a + b * b - 2 * a * b * c) / (1 - c * c), 6) FROM (SELECT corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_discount) AS b, corr(l_quantity, l_discount) AS c FROM lineitem)""")
def hierarchical_r2(spark, sf_dir):
    gram = stats.Gram.of(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"])
    rows = stats.hierarchical(gram, "l_extendedprice", {"amount": ["l_quantity"], "rate": ["l_discount"]})
    return spark.createDataFrame([(g, round(float(r2), 6)) for g, r2, _ in rows], "block string, r2 double")


@query()
def shapley_r2(spark, sf_dir):
    gram = stats.Gram.of(_features(spark, sf_dir), ["l_extendedprice", *FEATURES])
    rows = [(g, *(round(float(v), 6) for v in x)) for g, *x in stats.shapley(gram, "l_extendedprice", GROUPS)]
    return spark.createDataFrame(rows, "block string, mean double, std double, least double, most double")


@query("""WITH c AS (SELECT corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_discount) AS b, corr(l_quantity, l_discount) AS x FROM lineitem), r AS (SELECT a * a AS ra, b * b AS rb, (a * a + b * b - 2 * a * b * x) / (1 - x * x) AS rab FROM c),
g AS (SELECT 'amount' AS block, ra AS g1, rab - rb AS g2 FROM r UNION ALL SELECT 'terms', rb, rab - ra FROM r)
SELECT block, round((g1 + g2) / 2, 6) AS mean, round(abs(g1 - g2) / 2, 6) AS std, round(least(g1, g2), 6) AS least, round(greatest(g1, g2), 6) AS most FROM g""")
def shapley_two_blocks(spark, sf_dir):
    gram = stats.Gram.of(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"])
    rows = [(g, *(round(float(v), 6) + 0.0 for v in x)) for g, *x in stats.shapley(gram, "l_extendedprice", {"amount": ["l_quantity"], "terms": ["l_discount"]})]
    return spark.createDataFrame(rows, "block string, mean double, std double, least double, most double")


@query()
def stepwise_fit(spark, sf_dir):
    fit = stats.stepwise(stats.Gram.of(_features(spark, sf_dir), ["gross", "l_extendedprice", *FEATURES]), "gross", ["l_extendedprice", *FEATURES])
    rows = sorted(zip(fit["names"], fit["beta"].tolist(), fit["standard"].tolist(), fit["p"].tolist(), strict=True), key=lambda r: -abs(r[2]))
    return spark.createDataFrame([(i + 1, n, round(b, 6), round(s, 6), round(p, 6)) for i, (n, b, s, p) in enumerate(rows)], "place int, name string, beta double, standard double, p double")


@query()
def ridge_fit(spark, sf_dir):
    """Penalised fits with an interaction, one row for each penalty."""
    df = _features(spark, sf_dir).withColumn("size_x_quantity", F.col("p_size") * F.col("l_quantity"))
    gram = stats.Gram.of(df, ["l_extendedprice", *FEATURES, "size_x_quantity"])
    rows = [(a, round(float(gram.fit("l_extendedprice", [*FEATURES, "size_x_quantity"], ridge=a)["r2"]), 9)) for a in (0.01, 0.1, 1.0, 10.0, 100.0)]
    return spark.createDataFrame(rows, "penalty double, r2 double")


@query("""WITH r AS (SELECT corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_discount) AS b, corr(l_quantity, l_discount) AS x FROM lineitem),
s AS (SELECT 'l_quantity' AS name, (a - b * x) / (1 - x * x) AS beta FROM r UNION ALL SELECT 'l_discount', (b - a * x) / (1 - x * x) FROM r)
SELECT CAST(row_number() OVER (ORDER BY abs(beta) DESC) AS INTEGER) AS place, name, round(beta, 6) AS beta FROM s""")
def standardised_betas(spark, sf_dir):
    """Coefficients of standardised columns, largest first."""
    names = ["l_quantity", "l_discount"]
    betas = stats.Gram.of(table(spark, sf_dir, "lineitem"), ["l_extendedprice", *names]).standard_betas("l_extendedprice", names).tolist()
    ranked = sorted(zip(names, betas, strict=True), key=lambda x: -abs(x[1]))
    return spark.createDataFrame([(i + 1, c, round(b, 6)) for i, (c, b) in enumerate(ranked)], "place int, name string, beta double")


@query("""WITH j AS (SELECT p_size * l_quantity AS x, l_extendedprice AS y FROM lineitem JOIN part ON l_partkey = p_partkey), g AS (SELECT regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM j),
p AS (SELECT unnest([0.01, 1.0, 100.0, 1000000.0, 1000000000.0]) AS penalty)
SELECT CAST(penalty AS DOUBLE) AS penalty, round(sxy / (sxx + penalty), 6) AS beta, round((2 * sxy * sxy / (sxx + penalty) - sxy * sxy * sxx / power(sxx + penalty, 2)) / syy, 9) AS r2 FROM g, p""")
def ridge_interaction(spark, sf_dir):
    """Penalised fits on the product of two columns."""
    df = _features(spark, sf_dir).withColumn("size_x_quantity", F.col("p_size") * F.col("l_quantity"))
    gram = stats.Gram.of(df, ["l_extendedprice", "size_x_quantity"])
    fits = [(a, gram.fit("l_extendedprice", ["size_x_quantity"], ridge=a)) for a in (0.01, 1.0, 100.0, 1e6, 1e9)]
    return spark.createDataFrame([(a, round(float(f["beta"][0]), 6), round(float(f["r2"]), 9)) for a, f in fits], "penalty double, beta double, r2 double")


@query()
def rf_importance(spark, sf_dir):
    rows = ml.forest_importance(_features(spark, sf_dir), FEATURES, "l_extendedprice")
    block = {c: g for g, cols in GROUPS.items() for c in cols}
    total = dict(ml.grouped_importance(rows, GROUPS))
    return spark.createDataFrame([(n, round(v, 6), block[n], round(total[block[n]], 6)) for n, v in rows], "feature string, importance double, block string, block_importance double")


LINE = ("l_orderkey", "l_linenumber")


@query()
def gbt_cv_metrics(spark, sf_dir):
    """Five folds of the order of a seeded shuffle; their models grow side by side, without one of all rows."""
    rows = od.folds(_features(spark, sf_dir).select(*FEATURES, "l_extendedprice", *LINE), [od.by_seed(*LINE)], 5)
    _, scores = boosting.fit(rows, FEATURES, "l_extendedprice", LINE, F.col("fold"), 5, boosting.Options(whole=False))
    return spark.createDataFrame([(k, round(r2, 6), round(rmse, 4)) for k, r2, rmse in scores], "fold int, r2 double, rmse double")


@query()
def tree_shap_summary(spark, sf_dir):
    df = _features(spark, sf_dir)
    model, _ = boosting.fit(df, FEATURES, "l_extendedprice", LINE)
    return boosting.shap_summary(model, df).select("feature", *[F.round(c, 4).alias(c) for c in ("mean_abs_shap", "mean_shap", "gain")], "type")


@query()
def shap_by_class(spark, sf_dir):
    """Values of single rows by class and feature: rows, means, correlation with the feature, and the largest gap between a
    prediction and the sum of its values and the model's mean."""
    df = _features(spark, sf_dir)
    model, _ = boosting.fit(df, FEATURES, "l_extendedprice", LINE, options=boosting.Options(trees=50, depth=4))
    rows = boosting.shap_rows(model, df, ["l_returnflag"]).withColumn("gap", F.abs(F.col("total") + model.expected() - F.col("prediction")))
    return rows.groupBy("l_returnflag", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("shap"), 4).alias("mean_shap"), F.round(F.avg(F.abs("shap")), 4).alias("mean_abs_shap"),
        F.round(fc.correlation(F.col("x"), F.col("shap")), 4).alias("direction"), F.round(F.max("gap"), 6).alias("gap"),
    )


# ---- models of subsets -------------------------------------------------------------------------


@query("""SELECT l_returnflag AS subset, count(*) AS n, 1 AS predictors, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / (count(*) - 2)), 2) AS rmse FROM lineitem GROUP BY 1 HAVING count(*) >= 100
 UNION ALL SELECT 'All', count(*), 1, round(regr_r2(l_extendedprice, l_quantity), 6), round(sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / (count(*) - 2)), 2) FROM lineitem""")
def model_grid(spark, sf_dir):
    rows = stats.grid(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(s, n, k, round(r2, 6), round(e, 2)) for s, n, k, r2, _, e in rows], "subset string, n long, predictors int, r2 double, rmse double")


_PREDICTORS = ("dyn_BFI", "dyn_cv_Q", "mean_dyn_BFI", "mean_antecedent_ssi", "antecedent_ssi", "spei_intensity", "ssi_false_rec", "BFI_AVE", "ELEV_MEAN")


_TYPE = "CASE WHEN name IN ('dyn_BFI', 'dyn_recession_k_days', 'dyn_cv_Q', 'antecedent_ssi', 'mean_antecedent_ssi') OR name LIKE 'mean\\_dyn\\_%' ESCAPE '\\' THEN 'DYN' WHEN name IN ('spei_intensity', 'ssi_intensity', 'spei_false_rec', 'ssi_false_rec') THEN 'EVENT' ELSE 'STATIC' END"


@query(f"SELECT name, {_TYPE} AS type, count(*) AS n FROM (SELECT ({list(_PREDICTORS)})[p_partkey % {len(_PREDICTORS)} + 1] AS name FROM part) GROUP BY 1, 2")
def predictor_types(spark, sf_dir):
    """Types of names that the rows of a table carry."""
    names = table(spark, sf_dir, "part").select(F.element_at(F.array(*map(F.lit, _PREDICTORS)), (F.col("p_partkey") % len(_PREDICTORS) + 1).cast("int")).alias("name"))
    return names.withColumn("type", stats.predictor_type(F.col("name"))).groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))


_RATED = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query("SELECT l_returnflag, name, round(r, 6) AS r, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(r) DESC, name) AS place FROM (" + " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS name, corr({c}, l_extendedprice) AS r FROM lineitem GROUP BY 1" for c in _RATED) + ")) WHERE place <= 2")
def top_predictors(spark, sf_dir):
    """The two predictors of each subset that correlate most with the target."""
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[fc.correlation(F.col(c), F.col("l_extendedprice")).alias(c) for c in _RATED])
    w = W.partitionBy("l_returnflag").orderBy(F.abs("r").desc(), "name")
    return wide.unpivot(["l_returnflag"], list(_RATED), "name", "r").withColumn("place", F.row_number().over(w)).filter("place <= 2").withColumn("r", F.round("r", 6))


@query("""WITH p AS (SELECT unnest([0.01, 0.1, 1.0, 10.0, 100.0, 1000000.0]) AS penalty), f AS (SELECT l_orderkey % 5 AS fold, count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy, sum(l_extendedprice * l_extendedprice) AS yy FROM lineitem GROUP BY 1),
a AS (SELECT sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM f),
t AS (SELECT penalty, f.*, (a.xy - f.xy - (a.x - f.x) * (a.y - f.y) / (a.n - f.n)) / (a.xx - f.xx - (a.x - f.x) * (a.x - f.x) / (a.n - f.n) + penalty) AS b, (a.x - f.x) / (a.n - f.n) AS mx, (a.y - f.y) / (a.n - f.n) AS my FROM p, f, a),
e AS (SELECT penalty, (yy - 2 * b * xy + b * b * xx - 2 * (my - b * mx) * (y - b * x) + n * (my - b * mx) * (my - b * mx)) / n AS e FROM t)
SELECT CAST(penalty AS DOUBLE) AS penalty, round(sqrt(avg(e)), 2) AS error FROM e GROUP BY penalty""")
def ridge_penalties(spark, sf_dir):
    """Root of the mean squared error over five folds for each penalty."""
    _, rows = stats.ridge_cv(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"], F.col("l_orderkey") % 5, (0.01, 0.1, 1.0, 10.0, 100.0, 1e6))
    return spark.createDataFrame([(a, round(e**0.5, 2)) for a, e in rows], "penalty double, error double")


@query("""SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS fold, CAST(ntile(5) OVER (ORDER BY md5('42|' || o_orderkey)) - 1 AS INTEGER) AS shuffled FROM orders""")
def row_folds(spark, sf_dir):
    """Five folds of all orders along time, and five of them shuffled by a seed."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    along = od.folds(t, ["o_orderdate", "o_orderkey"], 5)
    return od.folds(along, [od.by_seed("o_orderkey"), "o_orderkey"], 5, out="shuffled").select("o_orderkey", "fold", "shuffled")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
k AS (SELECT *, least(5, greatest(2, n // 4)) AS k FROM o)
SELECT o_orderkey, CAST(CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - (n % k) * (n // k + 1)) // greatest(n // k, 1) END AS INTEGER) AS fold FROM k""")
def customer_folds(spark, sf_dir):
    """Folds inside each customer's orders; small customers have fewer of them."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return od.folds(t, ["o_orderdate", "o_orderkey"], None, ["o_custkey"], rows=4).select("o_orderkey", "fold")


_FIVE = "SELECT l_orderkey % 5 AS fold, count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy, sum(l_extendedprice * l_extendedprice) AS yy FROM lineitem GROUP BY 1"
_SLOPE = "(t.xy - t.x * t.y / t.n) / (t.xx - t.x * t.x / t.n + {penalty})"
_SQUARES = "(h.yy - 2 * b * h.xy + b * b * h.xx - 2 * (t.y - b * t.x) / t.n * (h.y - b * h.x) + h.n * power((t.y - b * t.x) / t.n, 2))"
_SUMS = ", ".join(f"sum(f.{c}) AS {c}" for c in ("n", "x", "y", "xx", "xy", "yy"))


@query(f"""WITH p AS (SELECT unnest([0.01, 1.0, 100.0, 1000000.0, 10000000.0]) AS penalty), f AS ({_FIVE}),
i AS (SELECT o.fold AS outside, h.fold AS held, {_SUMS} FROM f o JOIN f h ON h.fold <> o.fold JOIN f ON f.fold <> o.fold AND f.fold <> h.fold GROUP BY 1, 2),
e AS (SELECT outside, penalty, avg({_SQUARES} / h.n) AS e FROM (SELECT *, {_SLOPE.format(penalty='penalty')} AS b FROM i t, p) t JOIN f h ON h.fold = held GROUP BY 1, 2),
c AS (SELECT outside, arg_min(penalty, e) AS penalty FROM e GROUP BY 1),
w AS (SELECT o.fold AS outside, {_SUMS} FROM f o JOIN f ON f.fold <> o.fold GROUP BY 1)
SELECT outside AS fold, h.n, CAST(t.penalty AS DOUBLE) AS penalty, round(1 - {_SQUARES} / (h.yy - h.y * h.y / h.n), 6) AS r2, round(sqrt({_SQUARES} / h.n), 2) AS rmse
FROM (SELECT w.*, c.penalty, {_SLOPE.format(penalty='c.penalty').replace('t.', 'w.')} AS b FROM w JOIN c ON c.outside = w.outside) t JOIN f h ON h.fold = outside""")
def nested_ridge(spark, sf_dir):
    """Penalty chosen inside each of five outer folds, error of the fold outside."""
    rows = stats.nested_ridge(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"], F.col("l_orderkey") % 5, (0.01, 1.0, 100.0, 1e6, 1e7))
    return spark.createDataFrame([(k, n, a, round(r2, 6), round(e, 2)) for k, n, a, r2, e in rows], "fold long, n long, penalty double, r2 double, rmse double")


_LATTICE_COLS = ("l_quantity", "l_discount", "l_tax")


def _lattice_sql() -> str:
    """Explained share of a price by every subset of three columns, from correlations (adjugate over determinant)."""
    r = {(i, j): f"corr({a}, {b})" for i, a in enumerate(_LATTICE_COLS) for j, b in enumerate(_LATTICE_COLS) if i < j}
    c = ", ".join([f"corr(l_extendedprice, {x}) AS y{i}" for i, x in enumerate(_LATTICE_COLS)] + [f"{e} AS r{i}{j}" for (i, j), e in r.items()])
    two = lambda i, j: f"(y{i} * y{i} + y{j} * y{j} - 2 * y{i} * y{j} * r{i}{j}) / (1 - r{i}{j} * r{i}{j})"
    three = """(y0*y0*(1-r12*r12) + y1*y1*(1-r02*r02) + y2*y2*(1-r01*r01) + 2*y0*y1*(r02*r12-r01) + 2*y0*y2*(r01*r12-r02) + 2*y1*y2*(r01*r02-r12)) / (1 + 2*r01*r02*r12 - r01*r01 - r02*r02 - r12*r12)"""
    values = ["0.0", "y0 * y0", "y1 * y1", two(0, 1), "y2 * y2", two(0, 2), two(1, 2), three]
    return f"SELECT unnest(range(8)) AS mask, unnest([{', '.join(values)}]) AS r2 FROM (SELECT {c} FROM lineitem)"


@query(f"""WITH g AS (SELECT unnest(['amount', 'rate', 'tax']) AS block, unnest([0, 1, 2]) AS g), l AS ({_lattice_sql()}),
o AS (SELECT row_number() OVER (ORDER BY a.g, b.g, c.g) - 1 AS order_no, a.block || ',' || b.block || ',' || c.block AS order_text, [a.g, b.g, c.g] AS gs FROM g a, g b, g c WHERE a.g <> b.g AND a.g <> c.g AND b.g <> c.g),
s AS (SELECT order_no, order_text, place, gs[place] AS g, coalesce(list_sum(list_transform(gs[1:place - 1], lambda x: CAST(power(2, x) AS INTEGER))), 0) AS before FROM o, (SELECT unnest([1, 2, 3]) AS place))
SELECT order_no, order_text, CAST(place AS INTEGER) AS place, block, round(n.r2 - p.r2, 6) + 0.0 AS gain FROM s JOIN g ON g.g = s.g JOIN l p ON p.mask = before JOIN l n ON n.mask = before + CAST(power(2, s.g) AS INTEGER)""")
def shapley_orders(spark, sf_dir):
    """What each of three groups adds to the explained share, in each of their six orders."""
    gram = stats.Gram.of(table(spark, sf_dir, "lineitem"), ["l_extendedprice", *_LATTICE_COLS])
    groups = dict(zip(("amount", "rate", "tax"), ([c] for c in _LATTICE_COLS), strict=True))
    return stats.order_table(gram, "l_extendedprice", groups, spark).withColumn("gain", F.round("gain", 6) + 0.0)


_SUBSETS = """SELECT l.*, r_name, l_extendedprice * (1 + l_tax) AS gross FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _subsets_sql() -> str:
    parts = []
    for t in ("l_extendedprice", "gross"):
        a, b, x = f"corr({t}, l_quantity)", f"corr({t}, l_discount)", "corr(l_quantity, l_discount)"
        parts.append(f"""SELECT l_linestatus, r_name, l_returnflag, CASE WHEN grouping(r_name) = 0 THEN 2 WHEN grouping(l_returnflag) = 0 THEN 1 ELSE 0 END AS level, '{t}' AS target, count(*) AS n,
 coalesce(l_returnflag = 'R', FALSE) AS short, {a} * {a} AS r_one, ({a} * {a} + {b} * {b} - 2 * {a} * {b} * {x}) / (1 - {x} * {x}) AS r_two, regr_syy({t}, l_quantity) AS syy
 FROM j GROUP BY GROUPING SETS ((l_linestatus), (l_linestatus, l_returnflag), (l_linestatus, r_name, l_returnflag))""")
    return f"""WITH j AS ({_SUBSETS}), a AS ({' UNION ALL '.join(parts)}), b AS (SELECT *, CASE WHEN short THEN r_one ELSE r_two END AS r, CASE WHEN short THEN 1 ELSE 2 END AS predictors FROM a)
SELECT l_linestatus, l_returnflag, r_name, level, target, n, predictors, CASE WHEN n >= 50 THEN round(r, 6) END AS r2, CASE WHEN n >= 50 THEN round(1 - (1 - r) * (n - 1) / (n - predictors - 1), 6) END AS adj_r2,
 CASE WHEN n >= 50 THEN round(sqrt(syy * (1 - r) / (n - predictors - 1)), 2) END AS rmse FROM b WHERE level = 2 OR n >= 100"""


@query(_subsets_sql())
def model_grid_sets(spark, sf_dir):
    """Two targets for each status, status and flag, and status, region and flag; the rate is no predictor where the flag is R."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    rows = t("lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    one, two, three = ["l_linestatus"], ["l_linestatus", "l_returnflag"], ["l_linestatus", "r_name", "l_returnflag"]
    found = stats.grid_sets(rows, [(one, 100, False), (two, 100, False), (three, 50, True)], ["l_extendedprice", "gross"], ["l_quantity", "l_discount"], ("l_returnflag", "R", ["l_discount"]))
    schema = "l_linestatus string, l_returnflag string, r_name string, level int, target string, n long, predictors int, r2 double, adj_r2 double, rmse double"
    digits = {"r2": 6, "adj_r2": 6, "rmse": 2}
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(round(r[c], digits[c]) if c in digits and r[c] is not None else r[c] for c in names) for r in found], schema)


def _tree_sql(l1: float, l2: float, least: int) -> str:
    """One tree of depth two on three columns with few values: running sums over values, penalised gains, the best split of
    each node, and the weights of its leaves."""
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - {l1}, 0))"
    score = lambda g, h: f"{soft(g)} * {soft(g)} / ({h} + {l2})"
    cols = ("l_quantity", "l_discount", "l_tax")
    long = lambda rows: " UNION ALL ".join(f"SELECT node, {f} AS feature, {c} AS x, g FROM ({rows})" for f, c in enumerate(cols))
    best = lambda rows: f"""SELECT node, arg_min(feature, rank) AS feature, arg_min(x, rank) AS threshold, arg_min(gain, rank) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 3) DESC, feature, x) AS rank FROM (
  SELECT node, feature, x, ({score('gl', 'hl')} + {score('(g - gl)', '(h - hl)')} - {score('g', 'h')}) / 2 AS gain, hl, h FROM (
   SELECT node, feature, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY node, feature) AS g, sum(h) OVER (PARTITION BY node, feature) AS h
   FROM (SELECT node, feature, x, sum(g) AS g, count(*) AS h FROM ({long(rows)}) GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY node, feature ORDER BY x)))
  WHERE hl >= {least} AND h - hl >= {least} AND gain > 1e-9) GROUP BY node"""  # noqa: E731
    goes = lambda a: f"CASE {a}.feature " + " ".join(f"WHEN {f} THEN CASE WHEN r.{c} > {a}.threshold THEN 1 ELSE 0 END" for f, c in enumerate(cols)) + " END"
    rows = "SELECT 0 AS node, avg(l_extendedprice) OVER () - l_extendedprice AS g, l_quantity, l_discount, l_tax FROM lineitem"
    return f"""WITH r0 AS ({rows}), s0 AS ({best('SELECT * FROM r0')}), r1 AS (SELECT 1 + {goes('s')} AS node, g, l_quantity, l_discount, l_tax FROM r0 r, s0 s), s1 AS ({best('SELECT * FROM r1')}),
 r2 AS (SELECT CASE WHEN s.feature IS NULL THEN NULL ELSE 2 * r.node + 1 + {goes('s')} END AS node, g FROM r1 r LEFT JOIN s1 s ON s.node = r.node), s AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1),
 n AS (SELECT node, g FROM r0 UNION ALL SELECT node, g FROM r1 UNION ALL SELECT node, g FROM r2 WHERE node IS NOT NULL)
 SELECT '{l1},{l2}' AS penalty, CAST(a.node AS INTEGER) AS node, CAST(coalesce(s.feature, -1) AS INTEGER) AS feature, s.threshold, round(coalesce(s.gain, 0), 0) AS gain, a.h AS cover, round(-{soft('a.g')} / (a.h + {l2}), 4) AS value
 FROM (SELECT node, sum(g) AS g, count(*) AS h FROM n GROUP BY node) a LEFT JOIN s ON s.node = a.node"""


_PENALTIES = ((0.0, 0.0), (50000.0, 2000.0))


@query(" UNION ALL ".join(f"SELECT * FROM ({_tree_sql(a, b, 20)})" for a, b in _PENALTIES))
def boosted_tree(spark, sf_dir):
    """The first tree of depth two at full rate, without and with penalties."""
    out = []
    rows = boosting.binned(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["l_orderkey", "l_linenumber"])
    for l1, l2 in _PENALTIES:
        o = boosting.Options(trees=1, depth=2, rate=1.0, rows=1.0, columns=1.0, l1=l1, l2=l2)
        model, _ = boosting.fit_binned(rows, o)
        tree = model.trees[0]
        for i in (tree.cover > 0).nonzero()[0].tolist():
            f = int(tree.feature[i])
            out.append((f"{l1},{l2}", i, f, float(tree.threshold[i]) if f >= 0 else None, round(float(tree.gain[i]), 0), int(tree.cover[i]), round(float(tree.value[i]), 4)))
    rows.release()
    return spark.createDataFrame(out, "penalty string, node int, feature int, threshold double, gain double, cover long, value double")


# ---- two timescales ----------------------------------------------------------------------------

_SCALES = {3: _S3, 6: _Sql(6)}


def _both(text: Callable[[_Sql], str], columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS timescale, {columns} FROM ({text(x)})" for k, x in _SCALES.items())


@query(_both(lambda x: x.pairs, _PAIR_COLS))
def matched_pairs_by_timescale(spark, sf_dir):
    return _Matched(spark, sf_dir, (3, 6)).pairs.select("timescale", *_PAIR_COLS.split(", "))


@query(_both(lambda x: _rollup_sql(_recovery_sql(x)), "*"))
def recovery_rollup_by_timescale(spark, sf_dir):
    m = _Matched(spark, sf_dir, (3, 6), keep_panel=True)
    return recovery.rollup(recovery.recovery(m.pairs, m.panel, by=_BY), _BY)


@query("SELECT gauge, " + ", ".join(f"coalesce(max(CASE WHEN timescale = {k} AND kind = '{name}' THEN n END), 0) AS {name}_{k}" for k in (3, 6) for name in ("drivers", "responses", "matched", "buffered", "independent")) + " FROM ("
       + " UNION ALL ".join(f"SELECT {k} AS timescale, '{name}' AS kind, gauge, count(*) AS n FROM ({text}) GROUP BY gauge" for k, x in _SCALES.items() for name, text in (("drivers", x.driver), ("responses", x.response), ("matched", x.pairs), ("buffered", x.buffered), ("independent", x.alone))) + ") GROUP BY gauge")
def classification_wide(spark, sf_dir):
    """One row for each gauge, counts of both timescales side by side."""
    m, names = _Matched(spark, sf_dir, (3, 6)), ("drivers", "responses", "matched", "buffered", "independent")
    found = ev.classify(m.driver, m.response, m.pairs, m.buffered, m.alone, _BY)
    wide = found.groupBy("gauge").pivot("timescale", [3, 6]).agg(*[F.first(c).alias(c) for c in names])
    return wide.select("gauge", *[F.coalesce(F.col(f"{k}_{c}"), F.lit(0)).alias(f"{c}_{k}") for k in (3, 6) for c in names])


@query(f"""SELECT *, unique_drivers + buffered = drivers AS drivers_add_up, matched + independent = responses AS responses_add_up, least_lag >= 0 AS lags_not_negative FROM (SELECT
 (SELECT count(*) FROM ({_DRIVER})) AS drivers, (SELECT count(*) FROM ({_RESPONSE})) AS responses, (SELECT count(*) FROM ({_PAIRS})) AS matched, (SELECT count(*) FROM (SELECT DISTINCT gauge, d_onset_idx FROM ({_PAIRS}))) AS unique_drivers,
 (SELECT count(*) FROM ({_BUFFERED})) AS buffered, (SELECT count(*) FROM ({_ALONE})) AS independent, (SELECT coalesce(min(propagation_lag), 0) FROM ({_PAIRS})) AS least_lag)""".replace("SELECT *, unique", "SELECT drivers, responses, matched, unique_drivers, buffered, independent, unique", 1))
def event_accounts(spark, sf_dir):
    m = _Matched(spark, sf_dir)
    return ev.accounts(m.driver, m.response, m.pairs, m.buffered, m.alone)


# ---- further shapes ----------------------------------------------------------------------------


@query(f"SELECT a.gauge, a.period, round(a.value - b.value, 2) AS balance FROM ({BASE['A']}) a JOIN ({BASE['B']}) b ON a.gauge = b.gauge AND a.period = b.period")
def balance(spark, sf_dir):
    """Difference of two inputs that share gauge and period."""
    a, b = series(spark, sf_dir, "A"), series(spark, sf_dir, "B").withColumnRenamed("value", "less")
    return a.join(b, ["gauge", "period"]).select("gauge", "period", F.round(F.col("value") - F.col("less"), 2).alias("balance"))


@query("SELECT o_orderkey, coalesce(c_name, '') AS c_name FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def lookup_or_empty(spark, sf_dir):
    names = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return readers.lookup(table(spark, sf_dir, "orders"), names, "o_custkey", "c_name").select("o_orderkey", "c_name")


@query("""SELECT coalesce(a.k, b.k, c.k) AS s_suppkey, s_name, s_acctbal, s_nationkey FROM (SELECT s_suppkey AS k, s_name FROM supplier WHERE s_suppkey % 2 = 0) a
 FULL JOIN (SELECT s_suppkey AS k, s_acctbal FROM supplier WHERE s_acctbal > 0) b ON a.k = b.k FULL JOIN (SELECT s_suppkey AS k, s_nationkey FROM supplier WHERE s_nationkey < 12) c ON c.k = coalesce(a.k, b.k)""")
def attribute_chain(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    parts = [s.filter("s_suppkey % 2 = 0").select("s_suppkey", "s_name"), s.filter("s_acctbal > 0").select("s_suppkey", "s_acctbal"), s.filter("s_nationkey < 12").select("s_suppkey", "s_nationkey", "s_name")]
    return readers.outer_chain(parts, "s_suppkey")


@query("SELECT quantile_cont(l_extendedprice, 0.99) AS x_limit, round(quantile_cont(l_extendedprice * (1 - l_discount), 0.99), 4) AS y_limit FROM lineitem")
def percentile_limits(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))
    found = od.quantiles(t, {"x": [0.99], "y": [0.99]})
    limits = spark.createDataFrame([(found["x"][0], found["y"][0])], "x_limit double, y_limit double")
    return limits.withColumn("y_limit", F.round("y_limit", 4))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def first_rows(spark, sf_dir):
    return readers.head(table(spark, sf_dir, "orders"), 1000, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey) LIMIT 500")
def seeded_sample(spark, sf_dir):
    return readers.sample(table(spark, sf_dir, "orders"), 500, "o_orderkey").select("o_orderkey", "o_totalprice")


_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS name, count({c}) AS n, count(DISTINCT {c}) AS \"values\", CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most FROM lineitem" for i, c in enumerate(_NUMBERS)))
def numeric_predictors(spark, sf_dir):
    """Number columns without those that are left out for a subset, and what they hold."""
    return readers.column_catalog(table(spark, sf_dir, "lineitem"), but=("l_extendedprice",))


@query(f"SELECT gauge, period, value FROM (SELECT *, count(*) OVER (PARTITION BY gauge) AS n FROM ({_GAPS})) WHERE n >= 36")
def long_series(spark, sf_dir):
    """Monthly series with their gaps, of three years or more."""
    return se.densify(series(spark, sf_dir, "D"), least=36).select("gauge", "period", "value")


@query("""SELECT 'l_quantity' AS name, round(b, 4) AS beta, round(sqrt((1 - r) * syy / (n - 2) / sxx), 6) AS se, round(b / sqrt((1 - r) * syy / (n - 2) / sxx), 3) AS t, round(r, 6) AS r2, round(1 - (1 - r) * (n - 1) / (n - 2), 6) AS adj_r2, round(sqrt(syy * (1 - r) / (n - 2)), 2) AS rmse
FROM (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_r2(l_extendedprice, l_quantity) AS r, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxx(l_extendedprice, l_quantity) AS sxx FROM lineitem)""")
def ols_inference(spark, sf_dir):
    fit = stats.Gram.of(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"]).fit("l_extendedprice", ["l_quantity"])
    b, se_ = float(fit["beta"][0]), float(fit["se"][0])
    return spark.createDataFrame([("l_quantity", round(b, 4), round(se_, 6), round(b / se_, 3), round(float(fit["r2"]), 6), round(float(fit["adj_r2"]), 6), round(float(fit["rmse"]), 2))], "name string, beta double, se double, t double, r2 double, adj_r2 double, rmse double")


# ---- sources, from files that the query writes -------------------------------------------------


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS site, s_name, s_acctbal FROM supplier")
def csv_source(spark, sf_dir):
    path = scratch_path(spark, "csv")
    readers.write_table(table(spark, sf_dir, "supplier").select(F.format_string(" %d ", "s_suppkey").alias("site"), "s_name", "s_acctbal"), path, "csv")
    return readers.read_csv(spark, path, "site string, s_name string, s_acctbal double", keys=["site"])


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS \"STAID\", CAST(s_acctbal AS DOUBLE) AS elevation FROM supplier")
def latin1_attributes(spark, sf_dir):
    path = scratch_path(spark, "attributes")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("STAID"), F.concat(F.lit("é"), "s_name").alias("name"), F.col("s_acctbal").alias("elevation"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    found = readers.read_attributes(spark, path, columns=["elevation", "no such column"])
    return readers.as_numbers(found, ["elevation"])


_FLOW = "SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS day, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2"
_RDB = f"""SELECT file, site, day, CASE WHEN day_of_month = 13 THEN -1.0 ELSE q + file END AS flow, copy FROM (SELECT *, unnest(list_distinct([site // 25, (site + 10) // 25])) AS file, day(day) AS day_of_month FROM ({_FLOW})), (VALUES (0), (1)) c(copy)
 WHERE copy = 0 OR day_of_month = 7"""


def _rdb_files(spark, sf_dir) -> str:
    """Gzipped files of about 25 sites, a section each; two in five sites are in two files, days 7 come twice, days 13 have negative flow."""
    path = scratch_path(spark, "rdb")
    site = F.col("l_suppkey").alias("site")
    flow = table(spark, sf_dir, "lineitem").groupBy(site, F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    flow = flow.withColumn("file", F.explode(F.array_distinct(F.array(F.floor(F.col("site") / 25), F.floor((F.col("site") + 10) / 25)))))
    head = [F.lit("agency_cd\tsite_no\tdatetime\t9_00060_00003\t9_00060_00003_cd"), F.lit("5s\t15s\t20d\t14n\t10s")]
    q = F.when(F.dayofmonth("day") == 13, F.lit("-1")).otherwise((F.col("q") + F.col("file")).cast("string"))
    copies = F.when(F.dayofmonth("day") == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = flow.select("file", "site", F.explode(copies).alias("copy"), "day", q.alias("q")).select("file", "site", (2 + F.col("copy")).alias("kind"), "day", F.format_string("USGS\t%08d\t%s\t%s\tA", "site", F.col("day").cast("string"), "q").alias("value"))
    heads = flow.select("file", "site").distinct().select("file", "site", F.posexplode(F.array(*head)).alias("kind", "value")).select("file", "site", "kind", F.lit(None).cast("date").alias("day"), "value")
    lines = rows.unionByName(heads).withColumn("batch", F.format_string("b%08d", "file")).repartition("batch").sortWithinPartitions("batch", "site", "kind", "day")  # a file is written by one task
    lines.select("batch", "value").write.partitionBy("batch").option("compression", "gzip").text(path)
    return path


def _rdb(mode: str) -> Query:
    return lambda spark, sf_dir: readers.read_rdb(spark, f"{_rdb_files(spark, sf_dir)}/*/*.gz", mode)


_RDB_KEPT = {
    "a": "SELECT site, day, flow FROM r WHERE file = last",
    "b": "SELECT site, day, flow FROM r WHERE file = last AND copy = 0",
    "c": "SELECT site, day, flow FROM (SELECT *, row_number() OVER (PARTITION BY site, day ORDER BY file, copy) AS k FROM r WHERE flow >= 0) WHERE k = 1",
}
for _m, _kept in _RDB_KEPT.items():
    QUERIES[f"rdb_source_{_m}"] = _rdb(_m.upper())
    ORACLES[f"rdb_source_{_m}"] = f"WITH r AS (SELECT *, max(file) OVER (PARTITION BY site) AS last FROM ({_RDB})) SELECT lpad(CAST(site AS VARCHAR), 8, '0') AS site, day, flow FROM ({_kept})"


def _manifest(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The files above, a manifest of their folders with one more that does not exist, and suppliers in debt as wanted sites."""
    path, s = _rdb_files(spark, sf_dir), table(spark, sf_dir, "supplier")
    listed = s.select(F.col("s_suppkey").alias("k"), F.explode(F.array_distinct(F.array(F.floor(F.col("s_suppkey") / 25), F.floor((F.col("s_suppkey") + 10) / 25), F.lit(99_999_999)))).alias("file"))
    batches = listed.groupBy(F.format_string("batch=b%08d", "file").alias("raw_file")).agg(F.array_join(F.sort_array(F.collect_set(F.col("k").cast("string"))), ",").alias("sites"))  # 35 sites, or all: a line of the manifest
    return readers.read_manifest(spark, batches, s.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("gauge")), path)


@query(f"""WITH r AS (SELECT *, max(file) OVER (PARTITION BY site) AS last FROM ({_RDB}))
SELECT lpad(CAST(site AS VARCHAR), 8, '0') AS site, day, flow FROM r WHERE file = last AND copy = 0 AND site IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def manifest_source(spark, sf_dir):
    """Flow of the wanted sites from the files that hold them; other files are not opened."""
    return _manifest(spark, sf_dir)[0]


@query("""SELECT DISTINCT 'batch=b' || lpad(CAST(file AS VARCHAR), 8, '0') AS file, file < 99999999 AS found FROM (SELECT unnest([s_suppkey // 25, (s_suppkey + 10) // 25, 99999999]) AS file FROM supplier WHERE s_acctbal < 0)""")
def manifest_report(spark, sf_dir):
    """Files that the manifest asks for, and whether they exist."""
    return _manifest(spark, sf_dir)[1]

"""Hand-worked cases of rules at their edges."""

import datetime as dt
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.operators import events, hydro, recovery, series, stats
from rillflow.sources import readers


def test_typology_is_strict(spark):
    made = lambda counts: spark.createDataFrame([(g,) for g, n in counts.items() for _ in range(n)], "gauge string")
    got = recovery.typology(made({"two to one": 2, "more": 3, "alone": 1}), made({"two to one": 1, "more": 1, "other": 1}))
    assert {r.gauge: r.typology for r in got.collect()} == {"two to one": "mixed", "more": "buffered", "alone": "buffered", "other": "independent"}


def test_recession_ratios_are_dropped_singly(spark):
    start = dt.date(2000, 1, 1)
    q = [5000.0]
    for k in range(11):
        q.append(q[-1] - (1.0 if k < 7 else 100.0))  # seven ratios of about 5,000 are dropped, four of about 50 stay
    rows = [("a", start + dt.timedelta(i), x) for i, x in enumerate(q)] + [("few", start + dt.timedelta(i), float(9 - i)) for i in range(9)]
    got = {r.gauge: r for r in hydro.recession_ratio(spark.createDataFrame(rows, "gauge string, period date, value double")).collect()}
    kept = [a / (a - b) for a, b in zip(q, q[1:], strict=False) if a / (a - b) < 1000]
    assert len(kept) == 4 and got["a"].n == 11 and got["a"].k == round(float(np.median(kept)), 6)
    assert got["few"].n == 8 and got["few"].k is None


def test_regimes_of_small_groups(spark):
    rows = [("two", 1.0, 1.0, 0.9, 30.0)] * 2 + [("three", float(i), float(-i), 0.9, 30.0) for i in range(3)]
    rows += [("five", float(i), float(-i), 0.1, 30.0) for i in range(5)] + [("gaps", float(i), None if i < 3 else float(-i), 0.1, 30.0) for i in range(7)]
    got = {r.gauge: r for r in stats.regimes(spark.createDataFrame(rows, "gauge string, x double, y double, bfi double, k double"), "x", "y", "bfi", "k").collect()}
    assert set(got) == {"three", "five", "gaps"}
    assert got["three"].rho is None and got["three"].regime == "Memory-controlled" and got["three"].n == 3
    assert got["five"].regime == "Climate-controlled" and got["gaps"].rho is None and got["gaps"].regime == "Mixed"


def test_screen_of_a_chain(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=4000)
    b = a + 0.8 * rng.normal(size=4000)
    c = b + 0.9 * rng.normal(size=4000)  # c goes for b's sake although b is gone for a's
    d = rng.normal(size=4000)
    gap = [None if i % 3 == 0 else float(x) for i, x in enumerate(d)]
    rows = [(float(x), float(y), float(z), float(u), g, 1.0) for x, y, z, u, g in zip(a, b, c, d, gap, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, gap double, flat double")
    r = np.corrcoef([a, b, c])
    assert r[0, 1] > 0.7 > r[0, 2] and r[1, 2] > 0.7
    assert stats.screen(df, ["a", "b", "c", "d", "gap", "flat"]) == ["a", "d"]


def test_rollup_columns(spark):
    rows = [("g", 1, 2, 4, -3.5, -2.0, -0.4, 0.1, 0.2, 1), ("g", 3, None, 6, -4.5, -1.0, -0.6, 0.3, 0.6, 0)]
    df = spark.createDataFrame(rows, "gauge string, propagation_lag int, recovery_lag int, half_life int, d_severity double, r_severity double, antecedent double, rebound_3 double, rebound_6 double, had_false_recovery int")
    (r,) = recovery.rollup(df).collect()
    assert (r.n_pairs, r.median_propagation_lag, r.mean_recovery_lag, r.median_half_life, r.mean_d_severity, r.mean_r_severity) == (1, 2.0, 2.0, 5.0, -4.0, -1.5)
    assert (r.median_antecedent, r.median_rebound_3, r.median_rebound_6, r.p_false_recovery) == (-0.5, 0.2, 0.4, 0.5)


def test_short_series_have_no_flow_index(spark):
    rows = [(g, dt.date(2000 + i // 12, i % 12 + 1, 1), 1.0 + (7 * i) % 11) for g, n in (("short", 29), ("long", 60)) for i in range(n)]
    got = series.flow_index(spark.createDataFrame(rows, "gauge string, period date, value double"), 1, least_valid=2, least_positive=2)
    assert {r.gauge: r.n for r in got.groupBy("gauge").agg(F.count("index").alias("n")).collect()} == {"short": 0, "long": 60}
    assert series.densify(spark.createDataFrame(rows, "gauge string, period date, value double"), least=36).select("gauge").distinct().count() == 1


HEAD = "agency_cd\tsite_no\tdatetime\t{a}\t{a}_cd\n5s\t15s\t20d\t14n\t10s\n"


def write(folder, name, text):
    (folder / name).write_bytes(gzip.compress(text.encode("latin-1")))


def test_rdb_replacement(spark, tmp_path):
    mean = HEAD.format(a="1_00060_00003")
    write(tmp_path, "a.rdb.gz", "# note\n" + mean + "USGS\t123\t2000-01-01\t1\tA\nUSGS\t123\t2000-01-02\t2\tA\n" + mean + "USGS\t00000123\t2000-01-03\t3\tA\nUSGS\t00000123\t2000-01-03\t4\tA\n")
    write(tmp_path, "b.rdb.gz", mean + "USGS\t123\t2000-01-02\t9\tA\nUSGS\t123\t2000-01-04\t-5\tA\nUSGS\t77\t2000-01-01\t\tA\n")
    got = lambda mode: sorted((r.site[-3:], r.day.day, r.flow) for r in readers.read_rdb(spark, str(tmp_path), mode).collect())
    assert got("A") == [("123", 2, 9.0), ("123", 4, -5.0)] or got("A") == [("123", 1, None), ("123", 2, 9.0), ("123", 4, -5.0)]
    assert got("B") == [("077", 1, None), ("123", 2, 9.0), ("123", 4, -5.0)]
    assert got("C") == [("123", 1, 1.0), ("123", 2, 2.0), ("123", 3, 3.0)]


def test_rdb_sections_of_one_file():
    mean, other = HEAD.format(a="1_00060_00003"), HEAD.format(a="2_00060_00001")
    text = mean + "USGS\t1\t2000-01-01\t1\tA\n" + other + "USGS\t2\t2000-01-01\t2\tA\nUSGS\t2\t1979-12-31\t7\tA\n" + mean + "USGS\t3\t2000-01-01\t3\tA\tlonger\n"
    assert [r[0] for r in readers.parse_rdb(text, "A")] == ["1", "2"]  # the last section has a row longer than its columns
    assert [r[0] for r in readers.parse_rdb(text, "B")] == ["1", "3"]
    assert [(r[0], r[2]) for r in readers.parse_rdb(text, "C")] == [("1", 1.0), ("2", 2.0), ("2", 7.0), ("3", 3.0)]


def test_value_ranks(spark):
    values = [3, 1, 1, 2, 9, 9, 9, 4, None]
    df = spark.createDataFrame([(x,) for x in values], "x int").select(F.col("x").cast("double")).na.drop()
    for pieces in (1, 2, 64):
        (edges,) = stats.value_edges(df, ["x"], pieces)
        got = {r.x: r["rank"] for r in stats.value_ranks(df, "x", edges).collect()}
        assert got == {1.0: 1.5, 2.0: 3.0, 3.0: 4.0, 4.0: 5.0, 9.0: 7.0}


def test_spearman_with_gaps(spark):
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 9, 200), rng.integers(0, 12, 200)
    rows = [(float(a), None if i % 4 == 0 else float(a * a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    got = {name: (n, rho) for name, n, rho, _ in stats.spearman(spark.createDataFrame(rows, "x double, gap double, y double"), ["x", "gap"], "y")}
    for name, at in (("x", np.arange(200)), ("gap", np.arange(200)[np.arange(200) % 4 > 0])):
        rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
        assert got[name][0] == len(at) and got[name][1] == pytest.approx(np.corrcoef(rank(x[at]), rank(y[at]))[0, 1])


def test_grid_and_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=600)
    group = np.arange(600) % 3
    df = spark.createDataFrame([(int(g), float(a), float(b), float(t)) for g, (a, b), t in zip(group, x, y, strict=True)], "g int, a double, b double, y double")
    for label, n, _, r2, _, _ in stats.grid(df, "g", "y", ["a", "b"]):
        mine = np.ones(600, bool) if label == "All" else group == int(label)
        design = np.c_[np.ones(mine.sum()), x[mine]]
        rest = y[mine] - design @ np.linalg.lstsq(design, y[mine], rcond=None)[0]
        assert n == mine.sum() and abs(r2 - (1 - rest.var() / y[mine].var())) < 1e-9
    best, rows = stats.ridge_cv(df, "y", ["a", "b"], F.col("g"), (0.1, 1000.0))
    for penalty, error in rows:
        want = []
        for k in range(3):
            a, b = x[group != k], x[group == k]
            beta = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + penalty * np.eye(2), (a - a.mean(0)).T @ (y[group != k] - y[group != k].mean()))
            want.append(np.mean((y[group == k] - y[group != k].mean() - (b - a.mean(0)) @ beta) ** 2))
        assert error == pytest.approx(np.mean(want), rel=1e-9)
    assert best == 0.1


def test_events_by_timescale(spark):
    v = [0, -1.2, -1.5, -1.1, 0, 0, 0, -2, -2, -2, 0, 0]
    rows = [("g", k, dt.date(2000, i + 1, 1), float(x) * k) for k in (1, 2) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "gauge string, timescale int, period date, index double")
    got = events.detect(df, by=("gauge", "timescale")).collect()
    assert sorted((r.timescale, r.onset_idx, r.term_idx) for r in got) == [(1, 1, 3), (1, 7, 9), (2, 1, 3), (2, 7, 9)]

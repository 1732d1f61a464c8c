import datetime as dt
import gzip
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import columns as fc
from rillflow.functions.special import beta_i, gamma_p, t_two_sided
from rillflow.operators import hydro, stats
from rillflow.operators import series as se
from rillflow.sources import readers


def test_incomplete_gamma():
    x = np.array([0.1, 1.0, 3.0, 10.0, 40.0])
    assert np.allclose(gamma_p(np.ones(5), x), 1 - np.exp(-x), atol=1e-13)
    assert np.allclose(gamma_p(np.full(5, 0.5), x), [math.erf(math.sqrt(v)) for v in x], atol=1e-12)
    assert np.allclose(gamma_p(np.full(5, 3.0), x), 1 - np.exp(-x) * (1 + x + x * x / 2), atol=1e-12)
    assert np.isnan(gamma_p(np.array([-1.0]), np.array([1.0]))).all()


@pytest.mark.parametrize("a", [2e3, 3e4, 3e5, 4e6])
def test_incomplete_gamma_of_large_shapes(a):
    """Sums that stop after a fixed number of terms are too small here."""
    x = a + np.sqrt(a) * np.array([-4.0, -1.5, -0.3, 0.0, 0.4, 2.0, 3.5])

    def plain(v):
        log, total, n = a * math.log(v) - v - math.lgamma(a + 1), 0.0, 0
        term = 1.0
        while term > 1e-18 * max(total, 1.0):
            total, n = total + term, n + 1
            term *= v / (a + n)
        return total * math.exp(log)

    assert np.allclose(gamma_p(np.full(7, a), x), [plain(v) for v in x], rtol=2e-8, atol=1e-9)


def test_student():
    assert abs(t_two_sided(1.0, 1) - 0.5) < 1e-12
    assert abs(t_two_sided(2.0, 2) - (1 - 2 / math.sqrt(6))) < 1e-10
    assert abs(beta_i(2, 3, 0.4) - 0.5248) < 1e-10


def test_quantile_and_keys(spark):
    row = spark.range(1).select(fc.norm_ppf(F.lit(0.975)).alias("a"), fc.norm_ppf(F.lit(0.5)).alias("b"), fc.norm_ppf(F.lit(0.001)).alias("c"), fc.norm_ppf(F.lit(0.0)).alias("d")).first()
    assert abs(row.a - 1.959964) < 1e-6 and abs(row.b) < 1e-9 and abs(row.c + 3.090232) < 1e-6 and row.d is None
    keys = spark.createDataFrame([("01013500",), ("1013500.0",), (" 1013500 ",), ("123456789",), (None,)], "k string").select(fc.canonical_key(F.col("k")))
    assert [r[0] for r in keys.collect()] == ["01013500", "01013500", "01013500", "123456789", None]
    assert spark.range(1).select(fc.clip(F.lit(None).cast("double"), 0.0, 1.0)).first()[0] is None


def test_baseflow_stays_inside():
    q = np.abs(np.random.default_rng(1).normal(5, 3, 200))
    for d in "AB":
        b = hydro.baseflow(q, definition=d)
        assert (b >= 0).all() and (d == "B" or (b <= q + 1e-12).all())
    assert np.allclose(hydro.baseflow(np.full(50, 3.0)), 3.0)


def test_flow_index_is_bounded(spark):
    rng = np.random.default_rng(2)
    rows = [(g, dt.date(1980 + i // 12, i % 12 + 1, 1), float(max(0, rng.normal(3, 4)))) for g in range(3) for i in range(360)]
    got = [r["index"] for r in se.flow_index(spark.createDataFrame(rows, "gauge int, period date, value double"), 3).collect()]
    known = [x for x in got if x is not None]
    assert len(known) > 900 and all(-4 <= x <= 4 for x in known) and abs(np.mean(known)) < 0.2


def test_linear_models(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    gram = stats.Gram.of(df, ["y", "a", "b", "c"])
    fit = gram.fit("y", ["a", "b", "c"])
    want = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
    assert np.allclose([fit["intercept"], *fit["beta"]], want)
    assert stats.stepwise(gram, "y", ["a", "b", "c"])["names"][:2] == ["a", "b"]
    parts = stats.shapley(gram, "y", {"p": ["a"], "q": ["b"], "r": ["c"]})
    assert abs(sum(p[1] for p in parts) - fit["r2"]) < 1e-9
    twin = df.withColumn("d", F.col("a") * 2 + F.col("c") * 1e-3)
    assert stats.screen(twin, ["a", "b", "c", "d"]) == ["a", "b", "c"]
    rho = stats.spearman(df, ["a"], "y")[0]
    ranks = lambda v: np.argsort(np.argsort(v))
    assert abs(rho[2] - np.corrcoef(ranks(x[:, 0]), ranks(y))[0, 1]) < 1e-9


HEAD = "agency_cd\tsite_no\tdatetime\t{}\n5s\t15s\t20d\t14n\n"


@pytest.mark.parametrize("mode", ["A", "B", "C"])
def test_rdb(spark, tmp_path, mode):
    text = "# note\n" + HEAD.format("1_00060_00003\t1_00060_00003_cd") + "USGS\t01013500\t2001-01-01\t5.5\tA\nUSGS\t01013500\t2001-01-01\t7\tA\nUSGS\t01013500\t2001-01-02\tIce\tA\nUSGS\t01013500\tbad\t1\tA\nUSGS\t01013500\t2001-01-03\t-2\tA\n"
    text += HEAD.format("9_00010\t2_00060_00001\t2_00060_00003") + "USGS\t2\t2001-01-01\t0\t4\t6\n"
    (tmp_path / "x.rdb.gz").write_bytes(gzip.compress(text.encode()))
    rows = readers.read_rdb(spark, str(tmp_path / "*.rdb.gz"), mode).collect()
    got = {(r.site, str(r.day)): r.flow for r in rows}
    assert sorted(r.flow for r in rows if r.site == "01013500" and r.day.day == 1) == ([5.5, 7.0] if mode == "A" else [5.5])
    assert got.get(("01013500", "2001-01-02"), "gone") == ("gone" if mode == "C" else None)
    assert got.get(("01013500", "2001-01-03"), "gone") == ("gone" if mode == "C" else -2.0)
    assert got[("00000002", "2001-01-01")] == {"A": 4.0, "B": 6.0, "C": 0.0}[mode]


def test_rdb_rows_meet_no_join(spark, tmp_path):
    """Sites spelled in two ways, in two files: the last file counts; no row is shuffled in A and B, or carries a path."""
    row = "USGS\t{}\t2001-01-0{}\t{}\n"
    for name, rows in (("a", [("7", 1, 1), ("8", 1, 1)]), ("b", [("7", 1, 2), ("00000007", 1, 3), ("7", 2, 4)])):
        (tmp_path / f"{name}.rdb").write_text(HEAD.format("9_00060_00003") + "".join(row.format(*r) for r in rows))
    for mode, want in (("B", [("00000007", 1, 2.0), ("00000007", 2, 4.0), ("00000008", 1, 1.0)]), ("C", [("00000007", 1, 1.0), ("00000007", 2, 4.0), ("00000008", 1, 1.0)])):
        assert sorted((r.site, r.day.day, r.flow) for r in readers.read_rdb(spark, str(tmp_path), mode).collect()) == want
    plan = readers.read_rdb(spark, str(tmp_path), "B")._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("BroadcastExchange")]
    assert "hashpartitioning" not in top and "day" in top


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("STAID,X,NOTE\n123,1.5,\xe9\n01013500,bad,y\n", encoding="latin-1")
    df = readers.as_numbers(readers.read_attributes(spark, str(tmp_path / "a.csv"), columns=["X", "MISSING"]), ["X"])
    assert {tuple(r) for r in df.collect()} == {("00000123", 1.5), ("01013500", None)}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/m.csv", "a,b\n1,2\n")
    assert [tuple(r) for r in readers.read_zipped_csv(spark, str(tmp_path / "z.zip"), "in/m.csv", "b string, q string").collect()] == [("2", None)]
    readers.write_table(df, str(tmp_path / "out"), "csv")
    assert readers.read_csv(spark, str(tmp_path / "out")).count() == 2

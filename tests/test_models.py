"""Boosting, Shapley values, folds, smoothing, memory windows and manifests against plain code."""

import datetime as dt
import gzip
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import columns as fc
from rillflow.operators import boosting, hydro, ml, order, stats
from rillflow.sources import readers


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(c), float(5 * (a > 0) + 3 * (a > 0) * (b > 0.3) + 0.1 * rng.normal())) for i, (a, b, c) in enumerate(np.round(rng.normal(size=(900, 3)), 1))]
    return spark.createDataFrame(rows, "i int, dyn_BFI double, other double, third double, y double").repartition(3)


NAMES = ["dyn_BFI", "other", "third"]


def plain_tree(x, g, o, depth):
    """(predict of a row) of one tree grown by trying every split."""
    soft = lambda v: math.copysign(max(abs(v) - o.l1, 0), v)
    score = lambda v: soft(v.sum()) ** 2 / (len(v) + o.l2)

    def grow(at, level):
        best = (1e-12, None, None)
        if level < depth:
            for f in range(x.shape[1]):
                for cut in sorted(set(x[:, f]))[:-1]:
                    left = at & (x[:, f] <= cut)
                    right = at & ~left
                    if left.sum() >= o.least and right.sum() >= o.least:
                        gain = (score(g[left]) + score(g[right]) - score(g[at])) / 2
                        if gain > best[0] * (1 + 1e-12):
                            best = (gain, f, cut)
        if best[1] is None:
            w = -o.rate * soft(g[at].sum()) / (at.sum() + o.l2)
            return lambda row: w
        a, b = grow(at & (x[:, best[1]] <= best[2]), level + 1), grow(at & (x[:, best[1]] > best[2]), level + 1)
        return lambda row: a(row) if row[best[1]] <= best[2] else b(row)

    return grow(np.ones(len(x), bool), 0)


@pytest.mark.parametrize(("l1", "l2"), [(0.0, 0.0), (30.0, 50.0)])
def test_trees_equal_plain_ones(noisy, l1, l2):
    o = boosting.Options(trees=3, depth=3, rate=0.5, rows=1.0, columns=1.0, l1=l1, l2=l2, bins=100)
    model, _ = boosting.fit(noisy, NAMES, "y", ["i"], options=o)
    data = np.array([[r[c] for c in (*NAMES, "y")] for r in noisy.collect()])
    x, y = data[:, :3], data[:, 3]
    guess = np.full(len(y), y.mean())
    for _ in range(3):
        tree = plain_tree(x, guess - y, o, 3)
        guess = guess + np.array([tree(row) for row in x])
    assert np.abs(model.predict(x) - guess).max() < 1e-9


def test_cross_validation_and_draws(noisy):
    o = boosting.Options(trees=30, depth=3, rate=0.2)
    folded = order.folds(noisy, [order.by_seed("i")], 3)
    model, scores = boosting.fit(folded, NAMES, "y", ["i"], F.col("fold"), 3, o)
    assert [k for k, *_ in scores] == [0, 1, 2] and all(r2 > 0.9 for _, r2, _ in scores)
    again, _ = boosting.fit(folded.repartition(5), NAMES, "y", ["i"], options=o)
    x = np.random.default_rng(0).normal(size=(50, 3))
    assert np.abs(model.predict(x) - again.predict(x)).max() < 1e-9  # draws do not depend on partitions or folds
    assert any(set(t.feature) - {-1} < {0, 1, 2} for t in model.trees)  # columns are drawn for a tree
    held = folded.filter("fold = 0").toPandas()
    alone, _ = boosting.fit(folded.filter("fold <> 0"), NAMES, "y", ["i"], options=boosting.Options(trees=5, depth=2, bins=200))
    both, found = boosting.fit(folded, NAMES, "y", ["i"], F.col("fold"), 3, boosting.Options(trees=5, depth=2, bins=200))
    error = held["y"] - alone.predict(held[NAMES].to_numpy())
    assert abs(found[0][2] - math.sqrt((error**2).mean())) < 1e-3
    harder, _ = boosting.fit(folded, NAMES, "y", ["i"], options=boosting.Options(trees=5, depth=2, bins=200, l1=100.0))
    assert np.abs(harder.predict(x) - both.predict(x)).max() > 0.01
    few, none = boosting.fit(folded.filter("i < 0"), NAMES, "y", ["i"], options=boosting.Options(trees=1))
    assert few.predict(x).tolist() == [0.0] * 50 and none == []


def test_shapley_values_by_definition(noisy):
    model, _ = boosting.fit(noisy, NAMES, "y", ["i"], options=boosting.Options(trees=4, depth=3, rows=0.9, columns=1.0))
    x = np.random.default_rng(3).normal(size=(40, 3))
    phi = boosting.Kernel(model).values(x)

    def value(t, row, known, at=0):
        f = t.feature[at]
        if f < 0:
            return t.value[at]
        left, right = 2 * at + 1, 2 * at + 2
        if f in known:
            return value(t, row, known, left if row[f] <= t.threshold[at] else right)
        return (value(t, row, known, left) * t.cover[left] + value(t, row, known, right) * t.cover[right]) / t.cover[at]

    for row, p in zip(x, phi, strict=True):
        v = {k: sum(value(t, row, k) for t in model.trees) for n in range(4) for k in map(frozenset, itertools.combinations(range(3), n))}
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = sum((v[frozenset((*s, i))] - v[frozenset(s)]) / (3 * math.comb(2, len(s))) for n in range(3) for s in itertools.combinations(rest, n))
            assert abs(p[i] - want) < 1e-9
    assert np.abs(phi.sum(axis=1) + model.expected() - model.predict(x)).max() < 1e-9
    found = {r.feature: r for r in boosting.shap_summary(model, noisy).collect()}
    assert found["dyn_BFI"].mean_abs_shap > 10 * found["third"].mean_abs_shap and found["dyn_BFI"].type == "DYN" and found["other"].type == "STATIC"
    rows = boosting.shap_rows(model, noisy, ["i"]).collect()
    assert len(rows) == 2700
    one = [r for r in rows if r.i == 7]
    assert abs(sum(r.shap for r in one) + model.expected() - one[0].prediction) < 1e-9


def test_forest_importance(noisy):
    importance = ml.forest_importance(noisy, NAMES, "y", trees=4, depth=3)
    assert importance[0][1] > 0.8 and ml.grouped_importance(importance, {"one": ["other"], "two": ["dyn_BFI"]})[0][0] == "two"


def test_order_table_of_blocks(noisy, spark):
    gram = stats.Gram.of(noisy, ["y", *NAMES])
    groups = {"a": ["dyn_BFI"], "b": ["other", "third"], "c": ["third"]}
    rows = stats.order_table(gram, "y", groups, spark).collect()
    assert len(rows) == 18 and len({r.order_text for r in rows}) == 6
    for r in rows:
        names = r.order_text.split(",")
        r2 = lambda some: gram.fit("y", [c for g in groups if g in some for c in groups[g]])["r2"]
        assert names[r.place - 1] == r.block and abs(r.gain - (r2(names[: r.place]) - r2(names[: r.place - 1]))) < 1e-12
    table = {g: mean for g, mean, *_ in stats.shapley(gram, "y", groups)}
    for g in groups:
        assert abs(np.mean([r.gain for r in rows if r.block == g]) - table[g]) < 1e-9


def test_numbers_folds_and_smoothing(spark):
    rng = np.random.default_rng(5)
    data = [(i, None if i % 50 == 0 else f"g{int(g)}", float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 4, 500) ** 2, rng.integers(0, 90, 500), strict=True))]
    df = spark.createDataFrame(data, "i int, g string, v double").repartition(7)
    ranked = sorted(data, key=lambda r: (r[2], r[0]))
    got = {r.i: r for r in order.numbered(df, ["v", "i"], total=F.col("v")).collect()}
    total = 0.0
    for k, r in enumerate(ranked):
        total += r[2]
        assert got[r[0]].idx == k and abs(got[r[0]].running - total) < 1e-9
    inner = {r.i: r.idx for r in order.numbered(df, ["v", "i"], ["g"]).collect()}
    folds = {r.i: r.fold for r in order.folds(df, ["v", "i"], None, ["g"]).collect()}
    for group in {r[1] for r in data}:
        mine = [r[0] for r in ranked if r[1] == group]
        k = min(5, max(2, len(mine) // 30))
        want = np.concatenate([np.full(len(part), f) for f, part in enumerate(np.array_split(np.arange(len(mine)), k))])
        assert [inner[i] for i in mine] == list(range(len(mine))) and [folds[i] for i in mine] == want.tolist()
    for n, size in ((500, 15), (500, 16), (7, 15), (1, 4), (3, 3)):
        some = df.join(spark.createDataFrame([(r[0],) for r in ranked[:n]], "i int"), "i")
        y = np.array([r[2] for r in ranked[:n]])
        mirrored = np.concatenate([y, y[::-1]])
        want = [np.mean([mirrored[(k - size // 2 + j) % (2 * n)] for j in range(size)]) for k in range(n)]
        smooth = {r.i: r.smooth for r in order.reflected_average(some, ["v", "i"], "v", size).collect()}
        assert np.abs(np.array([smooth[r[0]] for r in ranked[:n]]) - want).max() < 1e-9
    assert order.reflected_average(df.limit(0), ["v"], "v", 3).collect() == []
    assert order.folds(df.limit(0), ["v"], 3).collect() == []


def test_quantiles_without_a_map_of_all_values(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = [(float(x), float(k), None) for x, k in zip(rng.normal(size=5000), rng.integers(0, 4, 5000), strict=True)] + [(None, None, None)] * 9
    df = spark.createDataFrame(data, "x double, k double, nothing double").repartition(6)
    shares = [0.0, 0.003, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    got = order.quantiles(df, {c: shares for c in ("x", "k", "nothing")})
    for i, c in enumerate(("x", "k")):
        assert np.allclose(got[c], np.quantile([r[i] for r in data if r[i] is not None], shares), rtol=0, atol=1e-12)
    assert got["nothing"] == [None] * 7 and order.quantiles(df.filter(F.col("x") == data[0][0]), {"x": [0.5]})["x"] == [data[0][0]]
    from rillflow.catalog import QUERIES

    def refused(*_):
        raise AssertionError("percentile of a whole column")

    monkeypatch.setattr(F, "percentile", refused)
    for name in ("percentile_limits", "tied_quantile_bins", "quantile_bin_pivot"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count()


def plain_memory(dates, q, day, definition):
    """The metrics of one window, one value at a time."""
    start = day - dt.timedelta(1095)
    held = [v for d, v in zip(dates, q, strict=True) if start <= d and (d < day or (definition == "B" and d == day)) and v is not None and (definition == "A" or v >= 0)]
    out = {"n": len(held)}
    if len(held) < 365:
        return out
    v = np.array(held)
    out["bfi"] = hydro.baseflow(v, definition=definition).sum() / v.sum() if v.sum() else None
    if definition == "B":
        d = np.diff(v)
        fall = d < 0
        r = -v[:-1][fall] / d[fall]
        r = r[(r > 0) & (r < 1000)]
        out["recession_k"] = np.median(r) if fall.sum() > 10 and len(r) else None
        return out
    slopes, i, segments = [], 0, 0
    w = np.maximum(v, 0)
    while i < len(w) - 1:
        j = i
        while j < len(w) - 1 and w[j + 1] <= w[j] and w[j] > 0:
            j += 1
        if j - i + 1 >= 5:
            segments += 1
            if w[i : j + 1].min() > 0:
                b = np.polyfit(np.arange(j - i + 1), np.log(w[i : j + 1]), 1)[0]
                slopes += [b] if b < -1e-12 else []
        i = max(j, i + 1)
    enough = len(slopes) >= 3
    out["recession_k"] = -1 / np.median(slopes) if enough else None
    out["recession_k_iqr"] = np.subtract(*np.percentile(-1 / np.array(slopes), [75, 25])) if enough else None
    return out


@pytest.mark.parametrize("definition", ["A", "B"])
def test_memory_of_events(spark, definition):
    rng = np.random.default_rng(9)
    day0, rows, asked = dt.date(1995, 3, 1), [], []
    for gauge in ("a", "b", "short", "dry"):
        n = 300 if gauge == "short" else 2600
        level, q = 50.0, []
        for _ in range(n):
            level = level * 0.9 if rng.random() < 0.85 else level + rng.exponential(60)
            q.append(0.0 if gauge == "dry" else round(level, 1) if level > 2 else 0.0)
        q = [None if rng.random() < 0.03 else -1.0 if rng.random() < 0.01 and definition == "B" else v for v in q]
        dates = [day0 + dt.timedelta(i) for i in range(n)]
        rows += [(gauge, d, v) for d, v in zip(dates, q, strict=True)]
        asked += [(gauge, day0 + dt.timedelta(int(k))) for k in rng.integers(0, 3900, 12)]
    asked += [asked[0], ("none", day0)]
    got = hydro.event_memory(spark.createDataFrame(asked, "gauge string, event_date date"), spark.createDataFrame(rows, "gauge string, period date, value double"), definition).collect()
    assert len(got) == len(set(asked))
    for r in got:
        mine = [(d, v) for g, d, v in rows if g == r.gauge]
        want = plain_memory([d for d, _ in mine], [v for _, v in mine], r.event_date, definition)
        assert r.n == want["n"]
        for c, digits in (("bfi", 4), ("recession_k", 2), ("recession_k_iqr", 2)):
            x = want.get(c)
            assert (r[c] is None) == (x is None) and (x is None or abs(r[c] - x) <= 0.51 * 10.0**-digits + 1e-7 * abs(x))


def test_equal_quantile_edges(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.0, 1.0, 2.0, 3.0, None, 9.0)], "v double")
    got = [r[0] for r in df.select(fc.quantile_bin(F.col("v"), [1.0, 1.0, 2.0, 2.0, 3.0])).collect()]
    assert got == [1, 1, 1, 1, 2, None, None]


def test_manifest_opens_what_it_needs(spark, tmp_path):
    head = "agency_cd\tsite_no\tdatetime\t9_00060_00003\n5s\t15s\t20d\t14n\n"
    for name, site in (("one.gz", 1), ("two.gz", 2), ("broken.gz", 3)):
        text = head + f"USGS\t{site:08d}\t2001-01-01\t{site}.5\nUSGS\t00000009\t2001-01-01\t9\n"
        (tmp_path / name).write_bytes(b"\x1f\x8bno gzip" if name == "broken.gz" else gzip.compress(text.encode()))
    manifest = spark.createDataFrame([("one.gz", "1,9"), ("two.gz", "2, 9"), ("broken.gz", "3"), ("gone.gz", "1,4")], "raw_file string, sites string")
    rows, report = readers.read_manifest(spark, manifest, spark.createDataFrame([("1",), ("4",)], "gauge string"), str(tmp_path))
    assert [(r.site, r.flow) for r in rows.collect()] == [("00000001", 1.5)]
    assert sorted(map(tuple, report.collect())) == [("gone.gz", False), ("one.gz", True)]
    rows, report = readers.read_manifest(spark, manifest, spark.createDataFrame([("77",)], "gauge string"), str(tmp_path))
    assert rows.count() == report.count() == 0


def test_grid_without_a_predictor(spark):
    rng = np.random.default_rng(2)
    rows = [(c, e, float(a), None if c == "Ref" and i % 2 else float(h), float(a + 2 * h + rng.normal())) for i, (a, h, c, e) in enumerate(zip(rng.normal(size=400), rng.normal(size=400), rng.choice(["Ref", "Non-ref"], 400), rng.choice(["x", "y", "z"], 400), strict=True))]
    df = spark.createDataFrame(rows, "class string, eco string, a double, human double, y double")
    found = stats.grid_sets(df, [((), 100, False), (("class",), 100, False), (("class", "eco"), 75, True)], ["y"], ["a", "human"], ("class", "Ref", ["human"]))
    assert len(found) == 1 + 2 + 6
    for f in found:
        mine = [r for r in rows if f["class"] in (None, r[0]) and f["eco"] in (None, r[1])]
        names = [2] if f["class"] == "Ref" else [2, 3]
        full = [r for r in mine if all(r[k] is not None for k in names)]
        assert f["n"] == len(full) and f["predictors"] == len(names) and (f["r2"] is None) == (f["level"] == 2 and len(full) < 75)
        if f["r2"] is not None:
            x, y = np.array([[1.0, *(r[k] for k in names)] for r in full]), np.array([r[4] for r in full])
            rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            assert abs(f["r2"] - (1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_boosting_reads_cells_instead_of_rows(spark):
    df = spark.range(4000).selectExpr("id", "double(id % 3) as a", "double(id % 2) as b", "double(id % 7) as y", "int(id % 5) as fold")
    data = boosting.binned(df, ["a", "b"], "y", ["id"], F.col("fold"), 5)
    blocks = data.rows.collect()
    assert sum(b[0].shape[1] for b in blocks) <= 6 + len(blocks) and sum(len(b[4]) for b in blocks) == 4000
    block = boosting.Block(*blocks[0], np.zeros((6, blocks[0][0].shape[1])))
    o = boosting.Options(rows=1.0)
    points = block.points(0, [1], o)
    assert points.bins.shape[1] == 2 and points.h[-1].sum() == 4000 and np.allclose(points.h[:5].sum(axis=1), 3200)
    data.release()


def test_boosted_tree_bins_rows_once(spark, sf_dir, monkeypatch):
    from rillflow.catalog import QUERIES

    made, binned = [], boosting.binned
    monkeypatch.setattr(boosting, "binned", lambda *a, **k: made.append(a) or binned(*a, **k))
    assert QUERIES["boosted_tree"](spark, sf_dir).count() == 14 and len(made) == 1


def test_shapley_values_by_sets_of_features(noisy, monkeypatch):
    """Tables that do not follow the number of trees give the values of the leaves' tables; a table too large leaves those."""
    model, _ = boosting.fit(noisy, NAMES, "y", ["i"], options=boosting.Options(trees=12, depth=4, rate=0.3))
    x = np.random.default_rng(4).normal(size=(300, 3))
    phi = boosting.Games(model).values(x)
    assert np.abs(phi - boosting.Kernel(model).values(x)).max() < 1e-9
    few = boosting.Games(boosting.Ensemble(NAMES, 1.0))
    assert few.values(x).tolist() == [[0.0] * 3] * 300
    one = {r.feature: r for r in boosting.shap_summary(model, noisy).collect()}
    row = boosting.shap_rows(model, noisy, ["i"]).filter("i = 3").collect()
    assert len(row) == 3 and abs(row[0].total - sum(r.shap for r in row)) < 1e-9
    monkeypatch.setattr(boosting.Games, "fits", staticmethod(lambda model: False))
    two = {r.feature: r for r in boosting.shap_summary(model, noisy).collect()}
    assert all(abs(one[c].mean_abs_shap - two[c].mean_abs_shap) < 1e-9 for c in NAMES)


def test_boosting_takes_two_levels_a_pass(noisy, monkeypatch):
    passes, summed, x = [], boosting._summed, np.random.default_rng(5).normal(size=(200, 3))
    monkeypatch.setattr(boosting, "_summed", lambda *a: passes.append(a) or summed(*a))
    o = boosting.Options(trees=7, depth=5, rate=0.3, columns=1.0, bins=16)
    folded = order.folds(noisy, [order.by_seed("i")], 3)
    model, scores = boosting.fit(folded, NAMES, "y", ["i"], F.col("fold"), 3, o)
    assert len(passes) == 1 + 7 * 3 + 1
    monkeypatch.setattr(boosting, "PAIR_SUMS", 0)
    monkeypatch.setattr(boosting, "KEEP", 2)
    other, found = boosting.fit(folded, NAMES, "y", ["i"], F.col("fold"), 3, o)
    assert all((a.feature == b.feature).all() and (a.cover == b.cover).all() for a, b in zip(model.trees, other.trees, strict=True))
    assert np.abs(model.predict(x) - other.predict(x)).max() < 1e-9 and np.allclose(scores, found)


def test_forest_equals_plain_trees_on_its_draws(spark, monkeypatch):
    """Trees grown on cells, level by level, have the gains of trees grown by trying every split; no job of Spark ML."""
    import pyspark.ml.regression as regression

    monkeypatch.setattr(regression.RandomForestRegressor, "_fit", lambda *a: pytest.fail("Spark ML"))
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), float(a * b + 3 * (b > 2) + rng.normal())) for i, (a, b) in enumerate(rng.integers(0, 6, (400, 2)))]
    df = spark.createDataFrame([*rows, *rows[:50]], "i int, a double, b double, y double").repartition(3)
    blocks = [b for b in boosting.binned(df, ["a", "b"], "y", ["i"]).rows.collect()]
    mean = float(np.mean([r[3] for r in [*rows, *rows[:50]]]))
    shares = []
    for t in range(3):
        held = [ml._draws(b, [t], mean, 42) for b in blocks]
        x, w, s = np.concatenate([h[0] for h in held], axis=1).T, *(np.concatenate([h[k][0] for h in held]).astype(float) for k in (1, 2))
        gain = np.zeros(2)

        def grow(at, level, w=w, s=s, x=x, gain=gain):
            best = (0.0, None, None)
            for f, cut in itertools.product(range(2), range(6)) if level < 4 else ():
                left, right = at & (x[:, f] <= cut), at & (x[:, f] > cut)
                if w[left].sum() >= 2 and w[right].sum() >= 2:
                    parts = [s[p].sum() ** 2 / w[p].sum() for p in (left, right, at)]
                    if parts[0] + parts[1] - parts[2] > best[0] + 1e-9 * (parts[0] + parts[1]):
                        best = (parts[0] + parts[1] - parts[2], f, cut)
            if best[1] is not None:
                gain[best[1]] += best[0]
                for part in (x[:, best[1]] <= best[2], x[:, best[1]] > best[2]):
                    grow(at & part, level + 1)

        grow(np.ones(len(w), bool), 0)
        shares.append(gain / gain.sum())
        assert abs(w.sum() - 450) < 90
    found = dict(ml.forest_importance(df, ["a", "b"], "y", trees=3, depth=4, least=2, key=["i"]))
    assert np.allclose([found["a"], found["b"]], np.mean(shares, axis=0), atol=1e-5)
    drawn = np.concatenate([ml._draws(b, [0], 0.0, 42)[1].sum(axis=1) for b in blocks])
    assert drawn.sum() != 450 and ml.forest_importance(df.filter("i < 0"), ["a"], "y", trees=2) == [("a", 0.0)]


def test_boosting_grows_a_tree_in_one_pass(noisy, monkeypatch):
    """Sums by joint bins give the trees of passes by level, also where some trees' draws are summed up at once and the model
    of all rows is left out; the driver gets no sums of trees."""
    o = boosting.Options(trees=7, depth=5, rate=0.3, columns=0.7, bins=16)
    folded = order.folds(noisy, [order.by_seed("i")], 3)
    data = boosting.binned(folded, NAMES, "y", ["i"], F.col("fold"), 3, o.bins)
    monkeypatch.setattr(boosting, "PAIR_SUMS", 0)
    passes, summed = [], boosting._summed
    monkeypatch.setattr(boosting, "_summed", lambda *a: passes.append(a) or summed(*a))
    model, scores = boosting.fit_binned(data, o)
    assert len(passes) == 2
    none, alone = boosting.fit_binned(data, boosting.replace(o, whole=False))
    assert len(passes) == 4 and none.trees == [] and np.allclose(scores, alone, rtol=1e-12)
    monkeypatch.setattr(boosting, "CUBE", 0)
    other, found = boosting.fit_binned(data, o)
    data.release()
    assert len(passes) == 4 + 2 + 7 * 5 and np.allclose(scores, found)
    assert all((a.feature == b.feature).all() and (a.cover == b.cover).all() and np.allclose(a.value, b.value) for a, b in zip(model.trees, other.trees, strict=True))


def test_leaves_by_masks_and_draws_in_pieces():
    rng = np.random.default_rng(6)
    bins = rng.integers(0, 20, (3, 5000)).astype(np.uint8)
    for depth in (1, 4, 6, 7):
        tree = boosting._stump(depth)
        inner = 2**depth - 1
        tree["feature"][:inner] = np.where(rng.random(inner) < 0.8, rng.integers(0, 3, inner), -1)
        for i in range(1, inner):
            if tree["feature"][(i - 1) // 2] < 0:
                tree["feature"][i] = -1
        tree["bin"][:inner], tree["value"] = rng.integers(0, 19, inner), rng.normal(size=len(tree["value"]))
        want = boosting._last_values(tree, depth)[boosting._places(tree, bins, depth)]
        assert (boosting._steps(tree, bins, depth) == want).all()
    key = rng.integers(0, 2**63, 50_000, dtype=np.uint64) * np.uint64(2)
    for share in (0.0, 0.3, 0.8, 1.0):
        assert (boosting._drawn(key, 77, share) == (boosting._uniform(key, 77) < share)).all()


def test_rows_are_read_once_for_many_trees(spark, monkeypatch):
    """Where cells hold many rows, draws of 25 trees are summed up in one pass, and rows are held once; trees stay the same."""
    from pyspark import RDD

    df = spark.range(6000).selectExpr("id", "double(id % 5) as a", "double(id % 3) as b", "double(pmod(hash(id), 97) + 9 * (id % 5) * (id % 3)) as y")
    data = boosting.binned(df, ["a", "b"], "y", ["id"])
    assert sum(data.rows.mapPartitions(lambda p: [len(list(p))]).collect()) == data.rows.getNumPartitions()  # a task's cells are whole
    reads, zipped = [], RDD.zip
    monkeypatch.setattr(RDD, "zip", lambda self, other: reads.append(1) or zipped(self, other))
    o = boosting.Options(trees=30, depth=3, rate=0.3, columns=1.0)
    model, _ = boosting.fit_binned(data, o)
    assert len(reads) == 2
    monkeypatch.setattr(boosting, "CUT", 5)
    other, _ = boosting.fit_binned(data, o)
    data.release()
    assert len(reads) == 2 + 6
    assert all((a.feature == b.feature).all() and np.allclose(a.value, b.value, rtol=1e-9) for a, b in zip(model.trees, other.trees, strict=True))
    summary = {r.feature: r.mean_abs_shap for r in boosting.shap_summary(model, df).collect()}
    monkeypatch.setattr(boosting, "CHUNK_ROWS", 7)
    assert all(abs(r.mean_abs_shap - summary[r.feature]) < 1e-9 for r in boosting.shap_summary(model, df).collect())

import pytest
from oracle import compare

from rillflow.catalog import ORACLES, QUERIES

SLOW = {"gbt_cv_metrics", "tree_shap_summary", "shap_by_class", "rf_importance"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows and all(v == v for r in rows for v in r if isinstance(v, float))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_model_queries_have_the_size_of_the_reference(spark, sf_dir, monkeypatch):
    """Real learners; only the number of trees is cut, after it has been noted."""
    from dataclasses import replace

    from rillflow.operators import boosting, ml

    made, forest, fit = [], ml.forest_importance, boosting.fit

    def fewer(df, names, target, key, fold=None, folds=0, options=boosting.Options()):
        made.append((options.trees, options.depth, options.rate, options.rows, options.columns, options.least, options.l1, options.l2))
        return fit(df, names, target, key, fold, folds, replace(options, trees=3))

    monkeypatch.setattr(boosting, "fit", fewer)
    monkeypatch.setattr(ml, "forest_importance", lambda df, names, target, trees=150, depth=12: made.append((trees, depth)) or forest(df, names, target, 5, 4))
    assert QUERIES["rf_importance"](spark, sf_dir).count() == 5 and made == [(150, 12)]
    assert [r.fold for r in QUERIES["gbt_cv_metrics"](spark, sf_dir).collect()] == [0, 1, 2, 3, 4]
    assert {r.feature for r in QUERIES["tree_shap_summary"](spark, sf_dir).collect() if r.mean_abs_shap > 0} > {"p_retailprice"}
    assert made[1:] == [(300, 6, 0.05, 0.8, 0.8, 20.0, 0.1, 1.0)] * 2
    rows = QUERIES["shap_by_class"](spark, sf_dir).collect()
    assert len(rows) == 15 and all(r.gap == 0 for r in rows)

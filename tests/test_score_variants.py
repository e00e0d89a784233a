"""All methods x proportions x models, really fitted, with few trees and rounds."""

from counterpoise.catalog import queries
from counterpoise.operators import evaluate as V
from counterpoise.plans.evaluation import evaluate_variants, tabulate


def test_all_models_over_all_variants(spark, sf):
    variants, test = queries._variants(spark, sf)
    scores = evaluate_variants(variants, test, "is_en", "documents", trees=3, rounds=3).collect()
    assert {(r["model"], r["method"], r["pct"]) for r in scores} == {(m, method, round(100 * p)) for m in V.MODELS for method in queries.METHODS for p in queries.PROPORTIONS}
    assert len(scores) == 54
    for r in scores:
        assert r["error"] is None and 0 <= r["cv_mean"] <= 1 and r["cv_std"] >= 0 and 0 <= r["test_roc"] <= 1
    table = tabulate(spark.createDataFrame(scores, V.SCORES)).collect()
    assert [r["model"] for r in table] == sorted(r["model"] for r in table) and len(table) == 54

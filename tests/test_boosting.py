"""Boosted trees over weighted rows of equal features are those over all rows."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from tidemark.operators import ml


def test_boosting_meets_equal_rows_once_with_the_same_trees(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.randrange(6), rng.randrange(5) / 4) for i in range(3000)]
    df = spark.createDataFrame([(i, a, b, 10.0 * a * b + 3 * (a > 3) + rng.gauss(0, 1)) for i, a, b in rows], "id long, a int, b double, y double")
    sizes, fit = [], GBTRegressor.fit

    def spy(self, data, *args):
        sizes.append(data.count())
        return fit(self, data, *args)

    train = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(ml.split(df, ["id"]).where("NOT is_test"))
    plain = GBTRegressor(maxIter=6, maxDepth=3, seed=42, labelCol="y").fit(train)
    monkeypatch.setattr(GBTRegressor, "fit", spy)
    model, scores, weights = ml.regression(df, "y", ["a", "b"], ["id"], "gradient_boosting", trees=6, depth=3)
    assert sizes == [30]
    want = {r.id: r.prediction for r in plain.transform(train).collect()}
    got = {r.id: r.prediction for r in model.transform(train).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len({round(v, 6) for v in want.values()}) > 10
    assert [r.weight for r in weights.collect()] == pytest.approx(list(plain.featureImportances.toArray()), abs=1e-9)
    assert sum(r.n for r in scores.collect()) == 3000

from dataclasses import replace

import numpy as np
import pytest
from revolva import registry
from revolva.operators import default_model
from revolva.plans import regression
from revolva.sources import store


@pytest.fixture(scope="module")
def model(spark, medium_dir):
    return registry.fitted_model(spark, medium_dir)


def test_split_is_stratified(spark, medium_dir):
    df = default_model.split(store.load(spark, medium_dir))
    share = {
        r.default_flag: (r.test, r.n)
        for r in df.groupBy("default_flag").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
        .join(df.where("split = 'test'").groupBy("default_flag").count().withColumnRenamed("count", "test"), "default_flag")
        .collect()
    }
    for test, n in share.values():
        assert test == -(-n // 5)


def test_split_does_not_depend_on_partitioning(spark, medium_dir):
    p = store.load(spark, medium_dir)
    other = replace(p, statements=p.statements.repartition(5))
    a, b = (default_model.split(x).select("card_id", "split") for x in (p, other))
    assert a.exceptAll(b).count() == 0


def test_discrimination(model):
    assert default_model.auc(model).first().roc_auc > 0.97


def test_confusion_covers_the_test_cards(model):
    cells = default_model.confusion(model).collect()
    assert len(cells) == 4 and sum(r.cards for r in cells) == model.test.count()


def test_report_follows_from_the_confusion(model):
    c = {(r.label, r.prediction): r.cards for r in default_model.confusion(model).collect()}
    lines = {r["class"]: r for r in default_model.report(model).collect()}
    assert lines["1"].recall == pytest.approx(c[1, 1] / (c[1, 0] + c[1, 1]))
    assert lines["1"].precision == pytest.approx(c[1, 1] / (c[0, 1] + c[1, 1]))
    assert lines["accuracy"].f1_score == pytest.approx((c[0, 0] + c[1, 1]) / sum(c.values()))
    assert lines["weighted avg"].support == sum(c.values())


def test_curve_runs_from_corner_to_corner(model):
    points = [(r.fpr, r.tpr) for r in default_model.roc(model).collect()]
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    assert points == sorted(points)


def test_weights(model):
    w = {r.feature: r.weight for r in default_model.coefficients(model).collect()}
    assert list(w) == ["intercept", *default_model.FEATURES]
    assert w["avg_dpd"] > 0


def test_probabilities(model):
    got = default_model.predictions(model)
    assert got.where("probability < 0 or probability > 1").count() == 0
    assert got.where("(probability > 0.5) <> (prediction = 1)").count() == 0


def test_the_loss_is_at_its_minimum(model):
    """Gradient of the penalised loss, recomputed from the cards in numpy."""
    rows = model.standardised(model.train).select(default_model.LABEL, *default_model.SCALED).collect()
    data = np.array(rows, float)
    x, y = np.hstack([np.ones((len(data), 1)), data[:, 1:]]), data[:, 0]
    w = np.array(model.fitted.weights)
    p = 1 / (1 + np.exp(-(x @ w)))
    slope = x.T @ (p - y) + np.concatenate([[0], w[1:]])
    assert np.abs(slope).max() < 1e-6
    assert np.abs(np.array(model.fitted.gradient)).max() < 1e-6
    assert model.fitted.steps < 30


def test_halved_steps_reach_the_minimum(spark):
    """Far outliers make plain Newton steps overshoot; a weak penalty leaves large weights."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=300), [40.0, -60.0, 80.0]])
    y = (x + 0.3 * rng.normal(size=303) > 0).astype(int)
    y[-1] = 0
    df = spark.createDataFrame([(float(a), float(a * a), int(b)) for a, b in zip(x, y)], "a double, b double, y int")
    fit = regression.newton(df, ["a", "b"], "y", penalty=1e-3)
    assert np.abs(np.array(fit.gradient)).max() < 1e-6
    same = regression.newton(df.repartition(5, "a"), ["a", "b"], "y", penalty=1e-3)
    assert same.weights == pytest.approx(fit.weights, rel=1e-9)


@pytest.mark.parametrize("rows", [[], [(1.0, 1), (2.0, 1)], [(1.0, 0), (None, 1)]])
def test_a_fit_needs_both_classes_and_no_nulls(spark, rows):
    with pytest.raises(ValueError, match="both classes"):
        regression.newton(spark.createDataFrame(rows, "a double, y int"), ["a"], "y")


def test_area_counts_pairs(spark):
    rng = np.random.default_rng(1)
    data = [(int(rng.integers(2)), float(s)) for s in np.round(rng.normal(size=400) * 30, 1)]
    won = [1.0 if a > b else 0.5 if a == b else 0.0 for y, a in data if y for z, b in data if not z]
    got = default_model.area(spark.createDataFrame(data, "label int, score double")).first().roc_auc
    assert got == pytest.approx(sum(won) / len(won), abs=1e-8)
    one = default_model.area(spark.createDataFrame([(1, 0.5)], "label int, score double"))
    assert one.first().roc_auc is None


def test_a_feature_without_spread_is_zero(spark, model):
    flat = replace(model, deviations=(0.0,) * 6)
    assert flat.standardised(model.test).where(" OR ".join(f"{z} <> 0" for z in default_model.SCALED)).count() == 0

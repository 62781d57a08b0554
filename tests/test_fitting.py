"""The fits against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException

from hoopline.operators import fitting as ft

FEATURES = ("a", "b", "c")


def table(spark, n=400, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3))
    y = (draw.random(n) < 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.7 * x[:, 1] * x[:, 2])))).astype(float)
    w = draw.choice([0.0, 0.5, 2.0], n)
    key = draw.integers(-(1 << 62), 1 << 62, n)
    rows = [(*map(float, r), float(t), float(v), int(k)) for r, t, v, k in zip(x, y, w, key, strict=True)]
    return x, y, w, key, spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE, w DOUBLE, key BIGINT")


def newton(x, y, w, c):
    design, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([*np.ones(x.shape[1]), 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-design @ beta))
        beta -= np.linalg.solve(c * (design * (w * p * (1 - p))[:, None]).T @ design + penalty, c * design.T @ (w * (p - y)) + penalty @ beta)
    return beta


def test_several_logistic_fits_in_the_same_passes(spark):
    x, y, w, _, rows = table(spark)
    settings = {
        "all": ft.LogisticSetting(FEATURES, 1.0),
        "weighted": ft.LogisticSetting(("a", "c"), 0.3, "w"),
        "scaled": ft.LogisticSetting(("b",), 5.0, None, {"b": 0.5}, {"b": 2.0}),
    }
    models = ft.fit_logistics(rows.repartition(5), settings, "y")
    wanted = {"all": newton(x, y, np.ones(400), 1.0), "weighted": newton(x[:, [0, 2]], y, w, 0.3), "scaled": newton((x[:, [1]] - 0.5) / 2.0, y, np.ones(400), 5.0)}
    for name, model in models.items():
        assert [*model.coefficients, model.intercept] == pytest.approx(list(wanted[name]), abs=1e-7)
        assert model.features == settings[name].features


def test_steps_that_overshoot_are_halved(spark):
    """Nearly separated rows and almost no penalty: whole Newton steps alone would run away."""
    rows = spark.createDataFrame([(float(k), float(k > 0)) for k in range(-20, 21)] + [(15.0, 0.0), (-15.0, 1.0)], "a DOUBLE, y DOUBLE")
    model = ft.fit_logistics(rows, {"m": ft.LogisticSetting(("a",), 1e6)}, "y")["m"]
    x, y = np.array([float(k) for k in range(-20, 21)] + [15.0, -15.0]), np.array([float(k > 0) for k in range(-20, 21)] + [0.0, 1.0])
    p = 1 / (1 + np.exp(-(model.coefficients[0] * x + model.intercept)))
    assert abs(((p - y) * x).sum()) < 1e-4 and abs((p - y).sum()) < 1e-4


def test_a_bad_value_stops_the_fit(spark):
    rows = spark.createDataFrame([(float("nan"), 1.0), (1.0, 0.0)], "a DOUBLE, y DOUBLE")
    with pytest.raises(PySparkException, match="no number"):
        ft.fit_logistics(rows, {"m": ft.LogisticSetting(("a",))}, "y")


def test_gradient_against_differences():
    draw = np.random.default_rng(3)
    x, y, w = draw.normal(size=(20, 3)), draw.integers(0, 2, 20).astype(float), draw.random(20)
    layers = ft.first_layers(3, ft.NetSetting(hidden=(5, 4)))
    kept = ft.kept_units(np.arange(20), 1, 1, 5, 0.3)

    def loss(flat):
        (w1, b1), (w2, b2), (w3, b3) = ft._shaped(flat, layers)
        h = np.maximum(np.maximum(x @ w1.T + b1, 0) * kept @ w2.T + b2, 0)
        z = (h @ w3.T + b3)[:, 0]
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum())

    flat = ft._flat(layers)
    value, slopes = ft.gradient(layers, x, y, w, kept)
    assert value == pytest.approx(loss(flat))
    for k in range(0, flat.size, 3):
        step = np.zeros(flat.size)
        step[k] = 1e-6
        assert ft._flat(slopes)[k] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-5)


def test_one_step_equals_numpy(spark):
    """One epoch of one mini-batch is one AdamW step on the mean weighted gradient of all rows, wherever they lie."""
    x, y, w, key, rows = table(spark, 120)
    setting = ft.NetSetting(hidden=(6, 4), dropout=0.25, learning_rate=0.01, weight_decay=0.1, epochs=1)
    layers = ft.first_layers(3, setting)
    _, slopes = ft.gradient(layers, x, y, w, ft.kept_units(key, setting.seed, 1, 6, 0.25))
    g = ft._flat(slopes) / 120
    mean, square = (0.1 * g) / (1 - 0.9), (0.001 * g * g) / (1 - 0.999)
    wanted = ft._flat(layers) * (1 - 0.01 * 0.1) - 0.01 * mean / (np.sqrt(square) + 1e-8)
    for parts in (1, 7):
        nets = ft.fit_nets(rows.repartition(parts), rows, {"n": setting}, FEATURES, "y", "key", "w", batches=1)
        assert ft._flat(nets["n"].layers) == pytest.approx(wanted, abs=1e-9)
        assert nets["n"].best_epoch == 1 and len(nets["n"].history) == 1


def test_dropout_keeps_the_mean_and_depends_on_row_and_step():
    kept = ft.kept_units(np.arange(5000), 42, 3, 8, 0.2)
    assert kept.mean() == pytest.approx(1.0, abs=0.01) and set(np.unique(kept)) == {0.0, 1.25}
    assert (ft.kept_units(np.arange(10, 20), 42, 3, 8, 0.2) == kept[10:20]).all()
    assert (ft.kept_units(np.arange(5000), 42, 4, 8, 0.2) != kept).any()


def test_training_learns_what_a_line_cannot_and_stops_early(spark):
    x, y, _, _, rows = table(spark, 1500, seed=2)
    train, validation = rows.where("key % 3 <> 0").persist(), rows.where("key % 3 = 0").persist()
    setting = ft.NetSetting(hidden=(32, 16), dropout=0.0, learning_rate=0.02, epochs=20, patience=3)
    stuck = ft.NetSetting(hidden=(4, 4), learning_rate=0.0, epochs=20, patience=2)
    nets = ft.fit_nets(train, validation, {"net": setting, "stuck": stuck}, FEATURES, "y", "key", batches=4)
    inside = np.array([(r.a, r.b, r.c, r.y) for r in validation.collect()])
    line = ft.fit_logistics(train, {"m": ft.LogisticSetting(FEATURES)}, "y")["m"]
    brier = lambda z: float(((1 / (1 + np.exp(-z)) - inside[:, 3]) ** 2).mean())
    net = brier(ft.forward(nets["net"].layers, inside[:, :3]))
    assert net < brier(inside[:, :3] @ np.array(line.coefficients) + line.intercept) - 0.01
    assert net == pytest.approx(min(b for _, b in nets["net"].history))
    # Weights that do not move never beat the first epoch.
    assert nets["stuck"].best_epoch == 1 and len(nets["stuck"].history) == 3

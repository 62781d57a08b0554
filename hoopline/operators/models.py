"""Scaling, fitting and scoring of home-win probability models on Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.functions import clock as ck
from hoopline.functions import fixed_values as fv
from hoopline.operators import dataset as ds
from hoopline.operators import metrics as mt
from hoopline.operators.fitting import FittedNet, LinearModel, LogisticSetting, NetSetting, fit_logistics, fit_nets
from hoopline.operators.ordinal import with_position

TRAIN_SEASON = fv.SPLIT_SEASONS["train"]


# --- Scaling ----------------------------------------------------------------------------


def fit_scaler(train: DataFrame, features=fv.MODEL_FEATURES) -> DataFrame:
    """One row: population mean and deviation of each scaled feature, from the train season only."""
    scaled = [c for c in features if c not in fv.UNSCALED_FEATURES]
    # A row of another season stops the fit rather than leaking into it.
    guard = f"max(CASE WHEN season <> '{TRAIN_SEASON}' THEN raise_error('Scaler must be fitted on {TRAIN_SEASON}') END)"
    row = train.agg(
        F.expr(guard).alias("_guard"),
        *[F.expr(f"avg(CAST({c} AS DOUBLE))").alias(f"m_{c}") for c in scaled],
        *[F.expr(f"stddev_pop(CAST({c} AS DOUBLE))").alias(f"s_{c}") for c in scaled],
    )
    names = ", ".join(f"'{c}'" for c in features)
    means = ", ".join(f"'{c}', m_{c}" for c in scaled)
    scales = ", ".join(f"'{c}', CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1D END" for c in scaled)
    binary = ", ".join(f"'{c}'" for c in sorted(fv.UNSCALED_FEATURES) if c in features)
    return row.where("_guard IS NULL").selectExpr(
        "1 AS version",
        f"array({names}) AS feature_names",
        f"'{TRAIN_SEASON}' AS fitted_season",
        f"map({means}) AS means",
        f"map({scales}) AS scales",
        f"map('home_possession', {fv.UNKNOWN_POSSESSION_VALUE}D) AS imputations",
        f"array({binary}) AS binary_features",
    )


def apply_scaler(states: DataFrame, scaler: DataFrame, features=fv.MODEL_FEATURES, keep=("season", "game_id", "source_event_index", fv.TARGET)) -> DataFrame:
    """Imputed and scaled features. The scaler is one row and comes in as a scalar subquery."""
    picked = [f"'i_{c}', imputations['{c}']" for c in features]
    picked += [f"'m_{c}', means['{c}'], 's_{c}', scales['{c}']" for c in features if c not in fv.UNSCALED_FEATURES]
    one = scaler.selectExpr(f"named_struct({', '.join(picked)})").scalar()
    columns = []
    for c in features:
        value = f"coalesce(CAST({c} AS DOUBLE), _scaler.i_{c})"
        scaled = value if c in fv.UNSCALED_FEATURES else f"({value} - _scaler.m_{c}) / _scaler.s_{c}"
        columns.append(f"{scaled} AS {c}")
    kept = [c for c in keep if c in states.columns]
    scaled_rows = states.withColumn("_scaler", one).selectExpr(*kept, *columns)
    # Checked in a projection of its own, so that no expression is worked out twice.
    return ds.checked_finite(scaled_rows, features)


# --- Fitting ----------------------------------------------------------------------------


def fit_logistic(
    train: DataFrame, features=fv.MODEL_FEATURES, c: float = 1.0, weight: str | None = None, tolerance: float = 1e-9
) -> LinearModel:
    """L2-penalised logistic regression; ``c`` weighs the summed loss against half the squared norm."""
    setting = LogisticSetting(tuple(features), c, weight)
    kept = train.select(*features, fv.TARGET, *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_logistics(kept, {"one": setting}, fv.TARGET, tolerance)["one"]
    finally:
        kept.unpersist()


def coefficient_rows(models: dict[str, LinearModel], spark) -> DataFrame:
    """``model``, ``feature`` (the intercept under that name), ``coefficient``."""
    rows = [(name, f, v) for name, m in models.items() for f, v in zip((*m.features, "intercept"), (*m.coefficients, m.intercept), strict=True)]
    return spark.createDataFrame(rows, "model STRING, feature STRING, coefficient DOUBLE")


def linear_logit(model: LinearModel) -> str:
    terms = " + ".join(f"({value!r}D * {name})" for name, value in zip(model.features, model.coefficients, strict=True))
    return f"({terms} + {model.intercept!r}D)"


def score_logistic(scaled: DataFrame, model: LinearModel, name: str = "probability") -> DataFrame:
    return scaled.withColumn(name, F.expr(ck.sigmoid_clip(linear_logit(model))))


#: The perceptrons that are tried; each row is a name and what differs from the defaults.
NETS = {
    "dropout 0.1": NetSetting(dropout=0.1),
    "dropout 0.2": NetSetting(dropout=0.2),
    "dropout 0.1 slow": NetSetting(dropout=0.1, learning_rate=3e-4),
}
ROW_KEY = ("season", "game_id", "source_event_index")


def fit_mlp(
    train: DataFrame, validation: DataFrame, settings: dict[str, NetSetting] = NETS, features=fv.MODEL_FEATURES, weight: str | None = None, batches: int = 8
) -> dict[str, FittedNet]:
    """Perceptrons on scaled rows with ``ROW_KEY``; see ``fitting.fit_nets``."""
    keyed = train.select(*features, fv.TARGET, F.xxhash64(*ROW_KEY).alias("_row_key"), *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
    judged = validation.select(*features, fv.TARGET).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_nets(keyed, judged, settings, features, fv.TARGET, "_row_key", weight, batches)
    finally:
        keyed.unpersist()
        judged.unpersist()


def score_fitted_mlp(scaled: DataFrame, net: FittedNet, features=fv.MODEL_FEATURES, name: str = "probability") -> DataFrame:
    logit = f"_{name}_logit"
    return score_mlp(scaled, net.layers, features, logit).withColumn(name, F.expr(ck.sigmoid_clip(logit))).drop(logit)


def score_mlp(scaled: DataFrame, weights: list[tuple[np.ndarray, np.ndarray]], features=fv.MODEL_FEATURES, name: str = "logit") -> DataFrame:
    """Forward pass with given layer weights (ReLU between layers), in Arrow batches."""
    layers = [(np.asarray(w, dtype=np.float64), np.asarray(b, dtype=np.float64)) for w, b in weights]

    @F.pandas_udf("double")
    def forward(*columns: pd.Series) -> pd.Series:
        signal = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
        for depth, (matrix, bias) in enumerate(layers):
            signal = signal @ matrix.T + bias
            if depth < len(layers) - 1:
                signal = np.maximum(signal, 0.0)
        return pd.Series(signal[:, 0])

    return scaled.withColumn(name, forward(*[F.col(c) for c in features]))


# --- Calibration ------------------------------------------------------------------------


def fit_platt(rows: DataFrame, logit: str = "logit") -> LinearModel:
    """Platt scaling: a nearly unpenalised logistic model of the outcome on the logit."""
    return fit_logistic(rows, (logit,), c=1e6)


def apply_platt(rows: DataFrame, model: LinearModel, name: str = "calibrated") -> DataFrame:
    return rows.withColumn(name, F.expr(ck.sigmoid_clip(linear_logit(model))))


def calibration_split(states: DataFrame) -> DataFrame:
    """Games in id order, the first half (rounded down) marked for fitting, the rest for judging.

    Ids are ten digits, so a block of ids is a block of numbers.
    """
    games = states.select("season", "game_id").distinct()
    block = F.expr("CAST(floor(CAST(game_id AS BIGINT) / 65536) AS BIGINT)")
    placed = with_position(games, ["season"], ["game_id"], block=block, position="place", total="games")
    return placed.selectExpr("season", "game_id", "place < floor(games / 2) AS fits")


# --- Baseline and experiments -----------------------------------------------------------


def constant_baseline(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row predicted by the win rate of the train rows."""
    return rows.withColumn("probability", train.agg(F.avg(fv.TARGET)).scalar())


EXPERIMENTS = (
    ("base", {}),
    ("with scores", {"features": (*fv.MODEL_FEATURES, "home_score", "away_score")}),
    ("known possession", {"drop_unknown": True}),
    ("game balanced", {"weighting": "game_balanced"}),
    ("time buckets", {"weighting": "time_bucket_30s"}),
    ("c 0.1", {"c": 0.1}),
    ("c 10", {"c": 10.0}),
)


def experiment_settings(train: DataFrame, experiments=EXPERIMENTS) -> tuple[DataFrame, dict[str, LogisticSetting], dict[str, int]]:
    """What the fits need: all train rows with the weight of each sort of experiment (0: left out), the settings with their scaling, and how many rows each has.

    Three scans at most: rows per game, last rows of time buckets, and all means, deviations and counts in one aggregate.
    """
    weights = {"full": "1D", "known": "CAST(possession_known = 1 AS DOUBLE)", "game_balanced": "_balanced", "time_bucket_30s": "_last"}
    rows = ds.time_bucket_marks(ds.game_balanced_weights(train, "_balanced"), "_last")
    features = sorted({f for _, o in experiments for f in o.get("features", fv.MODEL_FEATURES)})
    filled = [f"coalesce(CAST({f} AS DOUBLE), {fv.UNKNOWN_POSSESSION_VALUE}D) AS {f}" if f == "home_possession" else f"CAST({f} AS DOUBLE) AS {f}" for f in features]
    rows = rows.selectExpr(fv.TARGET, "season", *filled, *[f"{text} AS w_{kind}" for kind, text in weights.items()])
    guarded = f"CASE WHEN season <> '{TRAIN_SEASON}' THEN raise_error('Scaler must be fitted on {TRAIN_SEASON}') ELSE season END AS season"
    rows = ds.checked_finite(rows.selectExpr(guarded, *[c for c in rows.columns if c != "season"]), features).persist(StorageLevel.MEMORY_AND_DISK)
    scaled = [f for f in features if f not in fv.UNSCALED_FEATURES]
    # Weights leave rows out of the scaling, and count for nothing else there.
    moments = [f"{m}(CASE WHEN w_{kind} > 0 THEN {f} END) AS {m}_{kind}_{f}" for kind in weights for f in scaled for m in ("avg", "stddev_pop")]
    counts = [f"count_if(w_{kind} > 0) AS n_{kind}" for kind in weights]
    found = rows.selectExpr(*moments, *counts, "max(season)").first().asDict()
    settings, sizes = {}, {}
    for name, options in experiments:
        kind = "known" if options.get("drop_unknown") else options.get("weighting", "full")
        own = tuple(options.get("features", fv.MODEL_FEATURES))
        means = {f: found[f"avg_{kind}_{f}"] or 0.0 for f in own if f in scaled}
        scales = {f: found[f"stddev_pop_{kind}_{f}"] or 1.0 for f in own if f in scaled}
        settings[name] = LogisticSetting(own, options.get("c", 1.0), None if kind == "full" else f"w_{kind}", means, scales)
        sizes[name] = found[f"n_{kind}"]
    return rows, settings, sizes


def setting_logit(setting: LogisticSetting, model: LinearModel) -> str:
    """The logit of unscaled rows."""

    def scaled(name: str) -> str:
        value = f"coalesce(CAST({name} AS DOUBLE), {fv.UNKNOWN_POSSESSION_VALUE}D)" if name == "home_possession" else f"CAST({name} AS DOUBLE)"
        return f"(({value} - {setting.means[name]!r}D) / {setting.scales[name]!r}D)" if name in setting.means else value

    terms = [f"({value!r}D * {scaled(name)})" for name, value in zip(model.features, model.coefficients, strict=True)]
    return f"({' + '.join(terms)} + {model.intercept!r}D)"


def experiment_grid(train: DataFrame, validation: DataFrame, experiments=EXPERIMENTS) -> DataFrame:
    """The distinct experiments, one row each: setting, fitted coefficients, and metrics on the validation rows.

    All fits share each Newton step's pass over the train rows, and all models one pass over the validation rows.
    """
    options_of = dict(experiments)
    rows, settings, sizes = experiment_settings(train, experiments)
    try:
        models = fit_logistics(rows, settings, fv.TARGET)
    finally:
        rows.unpersist()
    probabilities = {n: ck.sigmoid_clip(setting_logit(settings[n], models[n])) for n in settings}
    kept = {n: f"CASE WHEN possession_known = 1 THEN {p} END" if options_of[n].get("drop_unknown") else p for n, p in probabilities.items()}
    pairs = ", ".join(f"'{n}', {p}" for n, p in kept.items())
    judged = validation.selectExpr(fv.TARGET, f"stack({len(kept)}, {pairs}) AS (experiment, probability)").where("probability IS NOT NULL")
    told = [
        (
            n, list(s.features), bool(options_of[n].get("drop_unknown", False)), options_of[n].get("weighting", "full"), float(s.c), sizes[n],
            dict(zip(models[n].features, models[n].coefficients, strict=True)), models[n].intercept,
        )
        for n, s in settings.items()
    ]
    fields = "experiment STRING, features ARRAY<STRING>, drop_unknown BOOLEAN, weighting STRING, c DOUBLE, train_rows BIGINT, coefficients MAP<STRING, DOUBLE>, intercept DOUBLE"
    return train.sparkSession.createDataFrame(told, fields).join(mt.probability_metrics(judged, ["experiment"]), "experiment")

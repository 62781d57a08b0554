"""From states to a chosen, calibrated and judged model.

Tuning reads the train and validation seasons only: it fits the scaler, the logistic model and the perceptrons, chooses by validation, decides on Platt scaling by games
that the scaling has not seen, and leaves everything as JSON artifacts. The test season is opened by ``evaluate_model`` alone, which fits nothing and needs all artifacts.
"""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopline.functions import fixed_values as fv
from hoopline.operators import dataset as ds
from hoopline.operators import metrics as mt
from hoopline.operators import models as md
from hoopline.operators import sampling as sa
from hoopline.operators.fitting import FittedNet, LinearModel, NetSetting
from hoopline.session import written
from hoopline.sources.scaler_files import load_scaler, save_scaler
from hoopline.sources.state_store import read_states

LINEAR = "features ARRAY<STRING>, coefficients ARRAY<DOUBLE>, intercept DOUBLE"
NET = "name STRING, features ARRAY<STRING>, layers ARRAY<STRUCT<weights: ARRAY<ARRAY<DOUBLE>>, biases: ARRAY<DOUBLE>>>, best_epoch INT, stopped_epoch INT, setting MAP<STRING, STRING>"
REPORT = (
    "selected STRING, constant DOUBLE, calibrated BOOLEAN, train_rows BIGINT, validation_rows BIGINT, "
    "models ARRAY<STRUCT<model: STRING, brier: DOUBLE, log_loss: DOUBLE, accuracy: DOUBLE, roc_auc: DOUBLE, ece: DOUBLE>>, "
    "raw_brier DOUBLE, raw_log_loss DOUBLE, calibrated_brier DOUBLE, calibrated_log_loss DOUBLE, "
    "history ARRAY<STRUCT<model: STRING, epoch: INT, train_loss: DOUBLE, validation_brier: DOUBLE>>"
)
KEPT = ("season", "game_id", "source_event_index", fv.TARGET)


def _write(spark: SparkSession, row: tuple, schema: str, path: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(path)


def _read(spark: SparkSession, schema: str, path: str):
    try:
        return spark.read.schema(schema).json(path).first()
    except AnalysisException as e:
        raise FileNotFoundError(f"There is no artifact at {path}") from e


def _linear(row) -> LinearModel:
    return LinearModel(tuple(row["features"]), tuple(row["coefficients"]), row["intercept"])


def tune_model(
    spark: SparkSession, states_path: str, artifacts: str, settings: dict[str, NetSetting] = md.NETS, weighting: str | None = None, batches: int = 8
) -> DataFrame:
    """Fit, choose and calibrate; writes the artifacts and returns the report (one row). ``weighting`` may be ``game_balanced``."""
    train = ds.make_split(read_states(spark, states_path, [fv.SPLIT_SEASONS["train"]]), "train")
    validation = ds.make_split(read_states(spark, states_path, [fv.SPLIT_SEASONS["validation"]]), "validation")
    ds.assert_isolated_splits({"train": train, "validation": validation})
    scaler = written(md.fit_scaler(train), "scaler")
    weight = None
    if weighting == "game_balanced":
        train, weight = ds.game_balanced_weights(train), "weight"
    elif weighting is not None:
        raise ValueError(f"Unknown weighting {weighting!r}")
    scaled = written(md.apply_scaler(train, scaler, keep=(*KEPT, "weight")), "train_rows")
    judged = written(md.apply_scaler(validation, scaler, keep=KEPT), "validation_rows")
    linear = md.fit_logistic(scaled, weight=weight)
    nets = md.fit_mlp(scaled, judged, settings, weight=weight, batches=batches)
    scored, columns = md.score_logistic(judged, linear, "p_linear"), {"logistic": "p_linear"}
    for k, (name, net) in enumerate(nets.items()):
        scored, columns[name] = md.score_fitted_mlp(scored, net, name=f"p_{k}"), f"p_{k}"
    compared = written(mt.compare_models(scored, columns), "candidates")
    selected = mt.select_model(compared.where("model <> 'logistic'")).first()["model"]
    net = nets[selected]

    # The first half of the validation games fits the scaling, the second half says whether it helps.
    logits = written(md.score_mlp(judged, net.layers), "validation_logits")
    halves = md.calibration_split(logits)
    platt = md.fit_platt(logits.join(halves.where("fits"), ["season", "game_id"], "left_semi"))
    held = md.apply_platt(logits.join(halves.where("NOT fits"), ["season", "game_id"], "left_semi"), platt)
    held = held.withColumn("raw", F.expr("1D / (1D + exp(-greatest(-50D, least(50D, logit))))"))
    raw, calibrated = (mt.compare_models(held, {"m": c}) for c in ("raw", "calibrated"))
    decided = mt.should_calibrate(raw, calibrated).first()

    constant = float(train.agg(F.avg(fv.TARGET)).first()[0])
    save_scaler(scaler, f"{artifacts}/preprocessing")
    _write(spark, (list(linear.features), list(linear.coefficients), linear.intercept), LINEAR, f"{artifacts}/logistic")
    layers = [(w.tolist(), b.tolist()) for w, b in net.layers]
    setting = {k: str(v) for k, v in asdict(settings[selected]).items()}
    _write(spark, (selected, list(fv.MODEL_FEATURES), layers, net.best_epoch, len(net.history), setting), NET, f"{artifacts}/model")
    if decided["calibrate"]:
        final = md.fit_platt(logits)
        _write(spark, (list(final.features), list(final.coefficients), final.intercept), LINEAR, f"{artifacts}/calibration")
    told = [tuple(r[c] for c in ("model", "brier", "log_loss", "accuracy", "roc_auc", "ece")) for r in compared.orderBy("brier", "log_loss").collect()]
    history = [(n, k + 1, loss, brier) for n, fitted in nets.items() for k, (loss, brier) in enumerate(fitted.history)]
    row = (
        selected, constant, bool(decided["calibrate"]), scaled.count(), judged.count(), told,
        decided["raw_brier"], decided["raw_log_loss"], decided["calibrated_brier"], decided["calibrated_log_loss"], history,
    )
    _write(spark, row, REPORT, f"{artifacts}/tuning_report")
    return spark.read.schema(REPORT).json(f"{artifacts}/tuning_report")


def scored_states(spark: SparkSession, states: DataFrame, artifacts: str) -> DataFrame:
    """``states`` with the probabilities of the artifacts: ``constant``, ``logistic``, ``raw`` and ``probability`` (calibrated, if tuning decided so)."""
    report = _read(spark, REPORT, f"{artifacts}/tuning_report")
    row = _read(spark, NET, f"{artifacts}/model")
    linear = _linear(_read(spark, LINEAR, f"{artifacts}/logistic"))
    net = FittedNet([(np.array(x["weights"]), np.array(x["biases"])) for x in row["layers"]], row["best_epoch"], [])
    scaler = load_scaler(spark, f"{artifacts}/preprocessing")
    keys = ["season", "game_id", "source_event_index"]
    scaled = md.apply_scaler(states, scaler, keep=tuple(keys))
    scored = md.score_mlp(md.score_logistic(scaled, linear, "logistic"), net.layers).withColumn("constant", F.lit(report["constant"]))
    scored = scored.withColumn("raw", F.expr("1D / (1D + exp(-greatest(-50D, least(50D, logit))))"))
    if report["calibrated"]:
        scored = md.apply_platt(scored, _linear(_read(spark, LINEAR, f"{artifacts}/calibration")), "probability")
    else:
        scored = scored.withColumn("probability", F.col("raw"))
    return states.join(scored.select(*keys, "constant", "logistic", "raw", "probability"), keys)


def evaluate_model(spark: SparkSession, states_path: str, artifacts: str) -> dict[str, DataFrame]:
    """The one look at the test season: models compared, reliability bins, slices, trajectories and the size of the set, also written below ``artifacts``."""
    _read(spark, REPORT, f"{artifacts}/tuning_report")  # stops before the test season is opened
    test = ds.make_split(read_states(spark, states_path, [fv.SPLIT_SEASONS["test"]]), "test")
    scored = written(scored_states(spark, test, artifacts), "test_rows")
    models = {"constant": "constant", "logistic": "logistic", "raw network": "raw", "network": "probability"}
    found = {
        "comparison": mt.compare_models(scored, models),
        "bins": mt.calibration_bins(scored),
        "slices": mt.slice_metrics(scored),
        "summary": ds.dataset_summary(test),
    }
    if not scored.where("period > 4").isEmpty():  # trajectories show an overtime game
        found["trajectories"] = sa.trajectory_samples(scored)
    for name, rows in found.items():
        rows.coalesce(1).write.mode("overwrite").json(f"{artifacts}/{name}")
    return found

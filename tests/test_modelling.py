"""The modelling plan on a small state table."""

from __future__ import annotations

import shutil

import numpy as np
import pytest

from hoopline.functions import fixed_values as fv
from hoopline.operators import fitting as ft
from hoopline.operators import models as md
from hoopline.plans import modelling as pm
from hoopline.sources import state_store as ss


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    draw = np.random.default_rng(11)
    rows = []
    for season in fv.SPLIT_SEASONS.values():
        for g in range(12):
            lead, win = 0, int(draw.random() < 0.5)
            for i in range(30):
                period = min(5, 1 + i // 6)
                lead += int(draw.integers(-3, 4)) + (1 if win else -1)
                left = float(120 * (5 - i % 6))
                known = int(draw.random() < 0.8)
                rows.append((season, f"{season[2:4]}{g:08d}", i, lead, period, left, float(max(0, (4 - period) * 720) + left if period <= 4 else 0), int(period > 4), max(0, period - 4),
                             int(draw.random() < 0.5) if known else None, known, i % 5, i % 4, 50 + lead, 50, win))
    names = "score_differential period seconds_remaining_period seconds_remaining_regulation is_overtime overtime_number home_possession possession_known home_team_fouls_period away_team_fouls_period home_score away_score home_win".split()
    kinds = ["INT", "INT", "DOUBLE", "DOUBLE", *["INT"] * 9]
    schema = "season STRING, game_id STRING, source_event_index INT, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    states = spark.createDataFrame(rows, schema)
    path = str(tmp_path_factory.mktemp("states"))
    ss.write_states(states.selectExpr("*", "'PT01M00.00S' AS clock", "CAST(NULL AS BIGINT) AS possession_team_id", "'' AS possession_reason"), path)
    return path


SETTINGS = {"a": ft.NetSetting(hidden=(8, 4), learning_rate=0.01, epochs=3), "b": ft.NetSetting(hidden=(6, 3), learning_rate=0.02, epochs=3)}


def test_tuning_leaves_the_test_season_sealed_and_evaluation_uses_the_artifacts(spark, table, tmp_path):
    artifacts, sealed = str(tmp_path / "artifacts"), str(tmp_path / "sealed")
    with pytest.raises(FileNotFoundError, match="tuning_report"):
        pm.evaluate_model(spark, table, artifacts)
    shutil.copytree(table, sealed, ignore=shutil.ignore_patterns(f"season={fv.SPLIT_SEASONS['test']}"))
    report = pm.tune_model(spark, sealed, artifacts, SETTINGS, batches=2).first()
    assert {m.model for m in report.models} == {"logistic", "a", "b"} and report.selected in SETTINGS
    nets = {m.model: m.brier for m in report.models if m.model != "logistic"}
    assert nets[report.selected] == min(nets.values())
    assert report.calibrated == (report.calibrated_brier < report.raw_brier and report.calibrated_log_loss < report.raw_log_loss)
    assert (report.train_rows, report.validation_rows) == (360, 360) and 0 < report.constant < 1
    best = min(h.validation_brier for h in report.history if h.model == report.selected)
    assert nets[report.selected] == pytest.approx(best, abs=1e-9)

    found = pm.evaluate_model(spark, table, artifacts)
    comparison = {r.model: r for r in found["comparison"].collect()}
    assert set(comparison) == {"constant", "logistic", "raw network", "network"}
    assert comparison["logistic"].brier < comparison["constant"].brier
    assert found["bins"].count() == 10 and found["slices"].count() > 5 and found["trajectories"].count() > 0
    # The stored network gives what its layers say.
    states = ss.read_states(spark, table, [fv.SPLIT_SEASONS["test"]])
    scored = pm.scored_states(spark, states, artifacts)
    row = pm._read(spark, pm.NET, f"{artifacts}/model")
    layers = [(np.array(x["weights"]), np.array(x["biases"])) for x in row["layers"]]
    scaled = md.apply_scaler(states, pm.load_scaler(spark, f"{artifacts}/preprocessing"))
    inside = sorted((r.game_id, r.source_event_index, [r[f] for f in fv.MODEL_FEATURES]) for r in scaled.collect())
    wanted = 1 / (1 + np.exp(-ft.forward(layers, np.array([v for _, _, v in inside]))))
    got = [r.raw for r in scored.orderBy("game_id", "source_event_index").collect()]
    assert got == pytest.approx(list(wanted), abs=1e-9)


def test_balanced_tuning(spark, table, tmp_path):
    report = pm.tune_model(spark, table, str(tmp_path / "artifacts"), {"a": SETTINGS["a"]}, weighting="game_balanced", batches=2).first()
    assert report.selected == "a"
    with pytest.raises(ValueError, match="weighting"):
        pm.tune_model(spark, table, str(tmp_path / "other"), SETTINGS, weighting="nothing")

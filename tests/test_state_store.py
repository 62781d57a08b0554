"""The state table is written without doubling and replaced only where it changed; scratch folders; score texts; live quarantine."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from hoopline import session
from hoopline.functions import clock as ck
from hoopline.operators import live_feed as lf
from hoopline.operators import metrics as mt
from hoopline.plans import season as ps
from hoopline.sources import state_store as ss


def rows(spark, *values):
    return spark.createDataFrame(values, "season string, game_id string, source_event_index int, home_score int")


def test_a_second_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "states")
    states = rows(spark, ("2021-22", "a", 0, 1), ("2021-22", "a", 1, 2), ("2022-23", "b", 0, 3))
    ss.write_states(states, path)
    ss.write_states(states, path)
    assert sorted(map(tuple, ss.read_states(spark, path).select(*states.columns).collect())) == sorted(map(tuple, states.collect()))


def test_only_touched_seasons_are_rewritten(spark, tmp_path):
    path = tmp_path / "states"
    ss.write_states(rows(spark, ("2021-22", "a", 0, 1), ("2021-22", "c", 0, 5), ("2022-23", "b", 0, 3)), str(path))
    files = lambda: {p.name for p in path.rglob("season=2022-23/*.parquet")}
    before = files()
    ss.replace_games(spark, rows(spark, ("2021-22", "a", 0, 9)), str(path))
    got = {(r.season, r.game_id): r.home_score for r in ss.read_states(spark, str(path)).collect()}
    assert got == {("2021-22", "a"): 9, ("2021-22", "c"): 5, ("2022-23", "b"): 3}
    assert before and files() == before


def test_a_season_with_a_missing_feed_stops(spark, tmp_path):
    log = spark.sql(
        "SELECT '2021-22' AS season, g AS GAME_ID, DATE '2021-10-20' AS GAME_DATE, t AS TEAM_ID, 'T' || t AS TEAM_ABBREVIATION, "
        "CASE t WHEN 100 THEN 'T100 vs. T200' ELSE 'T200 @ T100' END AS MATCHUP, CASE t WHEN 100 THEN 'W' ELSE 'L' END AS WL, CAST(t AS INT) AS PTS "
        "FROM VALUES ('0022100001'), ('0022100002') AS g(g), VALUES (100), (200) AS t(t)"
    )
    actions = spark.sql("SELECT '2021-22' AS season, '0022100001' AS game_id, 0 AS source_event_index")
    with pytest.raises(FileNotFoundError, match="0022100002"):
        ps.process_season(actions, log, str(tmp_path / "s"), str(tmp_path / "t"))


class OnCluster:
    """What ``scratch_root`` asks a session for, on a cluster without a shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"
        applicationId = "app"

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_no_machine_local_folder_on_a_cluster(spark):
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.scratch_root(OnCluster)
    assert Path(session.scratch_root(spark).removeprefix("file:")).exists()


@pytest.mark.parametrize("text", ["5d", "5f", "0x10", "NaN", "Infinity", "five"])
def test_score_texts_that_are_no_numbers(spark, text):
    with pytest.raises(PySparkException, match="not a number"):
        spark.sql(f"SELECT {ck.parse_score(f"'{text}'")} AS s").collect()


def test_live_rows_are_used_or_reported(spark):
    live = spark.createDataFrame(
        [("g", 0, 1, "PT05M00.00S"), ("g", 1, None, "PT05M00.00S"), ("g", 2, 1, " "), ("g", 3, 0, "PT05M00.00S")],
        "game_id string, source_index int, period int, clock string",
    ).selectExpr(
        "*", "1L AS actionNumber", "1L AS orderNumber", "0L AS teamId", "'' AS teamTricode", "'2pt' AS actionType", "'' AS subType", "'' AS descriptor",
        "array('') AS qualifiers", "'' AS description", "'' AS scoreHome", "'' AS scoreAway", "'' AS shotResult", "0L AS possession",
    )
    kept = {r.source_index for r in lf.adapt_live(live, mode="quarantine").collect()}
    aside = {r.source_index for r in lf.quarantined_live(live).collect()}
    assert kept == {0} and aside == {1, 2, 3}


def test_auc_of_saturated_probabilities(spark):
    """Probabilities crowded at both ends, with ties and exact 0 and 1, against a plain count of pairs."""
    p = [0.0, 1.0, 0.5, 1e-12, 1 - 1e-12, 1e-9, 1 - 1e-9] * 3 + [1 / (1 + 2.0**k) for k in range(-20, 21)]
    y = [(k * 7 + k // 3) % 2 for k in range(len(p))]
    frame = spark.createDataFrame(list(zip(p, y, strict=True)), "probability double, home_win int")
    won, lost = [a for a, b in zip(p, y, strict=True) if b], [a for a, b in zip(p, y, strict=True) if not b]
    pairs = sum((a > b) + (a == b) / 2 for a in won for b in lost)
    assert mt.probability_metrics(frame).first().roc_auc == pytest.approx(pairs / len(won) / len(lost))

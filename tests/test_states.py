"""Game-state reconstruction: named scenarios, and random games against a sequential walk."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from hoopline.operators import rollups as ru
from hoopline.operators import states as st
from tests.plays import AWAY, HOME, frame, index_of, play, random_game, walk

MADE, MISS = "Made Shot", "Missed Shot"

SCENARIOS = {
    "forward_fill": [play("period", "start"), play(MADE, "", HOME, home="2", away="0", clock="PT09M00.00S"), play("", "", AWAY, text="Player BLOCK (1 BLK)", clock="PT09M00.00S"), play("Turnover", "", AWAY, clock="PT08M00.00S")],
    "stale_replay": [play(MADE, "", HOME, home="3", away="0"), play("Instant Replay", "Support Ruling", home="0", away="0"), play("period", "end", home="0", away="0")],
    "overturn": [play(MADE, "", HOME, home="3", away="0"), play("Instant Replay", "Overturn Ruling", home="0", away="0")],
    "out_of_order": [play(MADE, "", HOME, number=10, home="1", away="0", clock="PT05M00.00S"), play(MADE, "", HOME, number=12, home="3", away="0", clock="PT04M00.00S"), play(MADE, "", HOME, number=11, home="1", away="0", clock="PT04M00.00S")],
    "period_end": [play(MADE, "", HOME, home="2", away="0"), play("period", "end", home="3", away="0"), play("Period", "end", home="1", away="0")],
    "ignored_replay": [play("Instant Replay", "Support Ruling", number=20, home="0", away="0"), play(MADE, "", HOME, number=18, home="1", away="0"), play(MADE, "", HOME, number=19, home="2", away="0")],
    "credit_between": [play(MISS, "", HOME), play("", "", AWAY, text="Player STEAL (1 STL)"), play("Rebound", "", AWAY)],
    "free_throws": [play("Free Throw", "Free Throw 1 of 2", HOME, shot="Made"), play("Free Throw", "Free Throw 2 of 2", HOME, shot="Made")],
    "missed_ft_offensive": [play("Free Throw", "Free Throw 1 of 1", HOME, text="MISS it"), play("Rebound", "", HOME)],
    "missed_ft_defensive": [play("Free Throw", "Free Throw 1 of 1", HOME, text="MISS it"), play("Rebound", "", AWAY)],
    "and_one": [play(MADE, "", HOME), play("Foul", "Shooting", AWAY), play("Free Throw", "Free Throw 1 of 1", HOME, shot="Made")],
    "technical": [play(MADE, "", HOME), play("Free Throw", "Free Throw Technical", AWAY, shot="Made")],
    "flagrant": [play("Free Throw", "Free Throw Flagrant 2 of 2", HOME, shot="Made")],
    "period_change": [play(MADE, "", HOME), play("period", "start", period=2)],
    "team_rebound": [play(MISS, "", HOME), play("Rebound", "", 0)],
    "fouls": [play("Foul", "Personal", HOME, text="(P1.T1)"), play("Foul", "Shooting", AWAY, text="(P1.T3)"), play("Foul", "Offensive", HOME), play("Foul", "Technical", AWAY), play("Foul", "Personal", AWAY, period=2, text="(P2.T1)")],
}


@pytest.fixture(scope="module")
def scenarios(spark):
    games = {name: plays for name, plays in SCENARIOS.items()}
    tracked = st.tracked_actions(frame(spark, games), index_of(spark, games, 99, 98)).collect()
    return {name: sorted((r for r in tracked if r.game_id == name), key=lambda r: r.source_event_index) for name in games}


def final_score(rows):
    return rows[-1].home_score, rows[-1].away_score


def test_forward_fill_and_emission(scenarios):
    rows = scenarios["forward_fill"]
    assert [r.source_event_index for r in rows if r.emitted] == [0, 1, 3]
    assert [r.home_score for r in rows if r.emitted] == [0, 2, 2]


@pytest.mark.parametrize(
    "name, score",
    [("stale_replay", (3, 0)), ("overturn", (0, 0)), ("out_of_order", (3, 0)), ("period_end", (3, 0)), ("ignored_replay", (2, 0))],
)
def test_scores(scenarios, name, score):
    assert final_score(scenarios[name]) == score


@pytest.mark.parametrize(
    "name, teams",
    [
        ("credit_between", [HOME, HOME, AWAY]), ("free_throws", [HOME, AWAY]), ("missed_ft_offensive", [HOME, HOME]),
        ("missed_ft_defensive", [HOME, AWAY]), ("and_one", [AWAY, HOME, AWAY]), ("technical", [AWAY, AWAY]), ("flagrant", [HOME]),
        ("period_change", [AWAY, None]), ("team_rebound", [HOME, None]),
    ],
)
def test_possession(scenarios, name, teams):
    assert [r.possession_team_id for r in scenarios[name]] == teams


def test_possession_reasons(scenarios):
    assert scenarios["credit_between"][-1].possession_reason == "defensive rebound"
    assert scenarios["missed_ft_offensive"][-1].possession_reason == "offensive rebound"
    assert "ambiguous" in scenarios["team_rebound"][-1].possession_reason


def test_fouls_and_markers(scenarios):
    rows = scenarios["fouls"]
    assert [(r.home_fouls, r.away_fouls) for r in rows] == [(1, 0), (1, 1), (1, 1), (1, 1), (0, 1)]
    assert [r.marker_matches for r in rows] == [1, 0, None, None, 1]
    assert rows[1].marker_reconstructed == 1


def test_outcome_is_a_check_and_not_an_input(spark, scenarios):
    games = {"label": [play(MADE, "", HOME, home="2", away="0")]}
    result = ru.game_results(st.tracked_actions(frame(spark, games), index_of(spark, games, 99, 98))).first()
    assert (result.final_home_score, result.final_score_matches) == (2, False)


GAMES = {f"g{seed}": random_game(seed, 60, anchors=seed % 3 > 0) for seed in range(24)}


@pytest.mark.parametrize("chunk_rows", [1, 7, 1024])
def test_random_games_against_a_sequential_walk(spark, chunk_rows):
    tracked = st.tracked_actions(frame(spark, GAMES), index_of(spark, GAMES), chunk_rows=chunk_rows).collect()
    got = {
        (r.game_id, r.source_event_index): (r.home_score, r.away_score, r.possession_team_id, r.possession_reason, r.home_fouls, r.away_fouls, r.emitted)
        for r in tracked
    }
    expected = {(g, i): state for g, plays in GAMES.items() for i, state in enumerate(walk(plays))}
    wrong = [(k, got.get(k), v) for k, v in expected.items() if got.get(k) != v]
    assert not wrong, wrong[:3]
    assert len(got) == len(expected)


def test_promised_length_gives_the_same_states_and_is_checked(spark):
    actions, index = frame(spark, GAMES), index_of(spark, GAMES)
    bound = st.longest_game(actions)
    assert bound == 60
    plain, promised = (st.game_states(actions, index, longest=n) for n in (None, bound))
    assert plain.exceptAll(promised).isEmpty() and promised.exceptAll(plain).isEmpty()
    with pytest.raises(PySparkException, match="longer than promised"):
        st.game_states(actions, index, longest=10).collect()


def test_no_window_or_group_spans_a_whole_game(spark):
    """In the plan every window over actions is keyed by chunk; game-wide ones read chunk summaries."""
    actions, index = frame(spark, GAMES), index_of(spark, GAMES)
    plan = st.game_states(actions, index, longest=60)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("chunk" in line for line in windows)


@pytest.mark.parametrize(
    "bad, message",
    [(play(MADE, clock="6:07"), "Clock"), (play(MADE, clock=""), "Clock"), (play(MADE, clock="PT13M00.00S"), "Clock"), (play(MADE, home="two"), "Score")],
)
def test_bad_values_fail_or_are_set_aside(spark, bad, message):
    games = {"bad": [play(MADE, "", HOME), bad]}
    with pytest.raises(PySparkException, match=message):
        st.game_states(frame(spark, games), index_of(spark, games)).collect()
    index = index_of(spark, games)
    assert st.quarantined_actions(frame(spark, games), index).count() == 1
    assert st.action_facts(frame(spark, games), index, mode="quarantine").count() == 1


def test_unknown_game_is_an_error(spark):
    games = {"known": [play(MADE)], "unknown": [play(MADE)]}
    with pytest.raises(PySparkException, match="no index row"):
        st.game_states(frame(spark, games), index_of(spark, ["known"])).collect()
    kept = st.game_states(frame(spark, games), index_of(spark, ["known"]), mode="quarantine").select("game_id").distinct().collect()
    assert [r.game_id for r in kept] == ["known"]
    aside = st.quarantined_actions(frame(spark, games), index_of(spark, ["known"])).collect()
    assert [(r.game_id, r.quarantine_reasons) for r in aside] == [("unknown", ["game"])]


@pytest.mark.parametrize("longest", [None, 1024])
def test_actions_are_dealt_by_chunk_into_all_partitions(spark, longest):
    """Partitions that are put together again hold more wide rows than two sorts keep in memory, so the one exchange of the actions has a fixed number."""
    tracked = st.tracked_actions(frame(spark, GAMES), index_of(spark, GAMES), longest=longest)
    plan = tracked._jdf.queryExecution().executedPlan().toString()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert dealt and all(f", {parts})" in line and "chunk#" in line for line in dealt) and "REPARTITION_BY_COL" not in plan

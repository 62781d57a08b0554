"""The replay tree against rebuilding every prefix."""

from __future__ import annotations

import random

import pytest

from hoopline.operators import live_feed as lf
from hoopline.operators import replay as rp
from hoopline.operators import states as st

FIELDS = (
    "game_id STRING, source_index INT, orderNumber BIGINT, actionNumber BIGINT, actionType STRING, subType STRING, descriptor STRING, qualifiers ARRAY<STRING>, "
    "clock STRING, period INT, teamId BIGINT, teamTricode STRING, possession BIGINT, scoreHome STRING, scoreAway STRING, shotResult STRING, description STRING"
)
KINDS = [("2pt", "jump shot", "Made"), ("2pt", "jump shot", "Missed"), ("rebound", "", ""), ("turnover", "bad pass", ""), ("foul", "personal", ""), ("period", "start", ""),
         ("period", "end", ""), ("freethrow", "1 of 2", "Made"), ("freethrow", "2 of 2", "Missed"), ("jumpball", "recovered", ""), ("timeout", "full", "")]


def random_game(game: str, n: int, seed: int) -> list[tuple]:
    """Actions that arrive out of order, are corrected, lack numbers or show one side of the score, with numbers that now and then run backwards."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        k = draw.randrange(max(1, i)) if i and draw.random() < 0.2 else i
        order = draw.choice([k * 10_000 + 10_000] * 8 + [0, None])
        number = draw.choice([k + 1] * 8 + [max(1, k - 3), None])
        kind, sub, shot = draw.choice(KINDS)
        home, away = draw.choice([(str(i // 2), str(i // 3))] * 4 + [("", "")] * 3 + [(str(i // 2), ""), ("", str(i // 3)), (str(i // 4), str(i // 4))])
        period = 1 + 3 * k // n
        clock = f"PT{draw.choice((9, 5, 5, 1)):02d}M{draw.choice((0, 30)):02d}.00S"
        out.append((game, i, order, number, kind, sub, None, [], clock, period, draw.choice((100, 200, 200, 100, 0, None)), "", None, home, away, shot, ""))
    return out


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_every_prefix(spark, block_rows):
    rows = [r for g, n in (("g1", 1), ("g2", 40), ("g3", 75)) for r in random_game(g, n, n)]
    arrivals = spark.createDataFrame(rows, FIELDS)
    index = spark.createDataFrame([("live", g, 100, 200) for g in ("g1", "g2", "g3")], "season STRING, game_id STRING, home_team_id BIGINT, away_team_id BIGINT")
    cuts = arrivals.selectExpr("game_id AS whole", "game_id || '/' || (source_index + 1) AS game_id", "source_index + 1 AS cursor")
    each = arrivals.withColumnRenamed("game_id", "whole").join(cuts.select("whole", "game_id"), "whole").drop("whole")
    teams = index.withColumnRenamed("game_id", "whole").join(cuts.select("whole", "game_id"), "whole").drop("whole")
    rebuilt = st.tracked_actions(lf.live_feed_actions(lf.replay_prefix(each, cuts.select("game_id", "cursor"))), teams)
    shown = ["home_score", "away_score", "period", "seconds", "possession_team_id", "home_fouls", "away_fouls"]
    wanted = {}
    for r in rebuilt.select("game_id", "source_event_index", *shown).collect():
        game, cursor = r.game_id.split("/")
        wanted.setdefault((game, int(cursor)), []).append((r.source_event_index, tuple(r[c] for c in shown)))
    got = {
        (r.game_id, r.cursor): (r.actions, (r.home_score, r.away_score, r.period, r.seconds_remaining_period, r.possession_team_id, r.home_team_fouls_period, r.away_team_fouls_period))
        for r in rp.replay_states(arrivals, index, block_rows).collect()
    }
    assert got == {key: (len(states), max(states)[1]) for key, states in wanted.items()}
    assert len(got) == len(rows)


def test_no_arrivals(spark):
    index = spark.createDataFrame([], "season STRING, game_id STRING, home_team_id BIGINT, away_team_id BIGINT")
    assert rp.replay_states(spark.createDataFrame([], FIELDS), index).collect() == []


def test_short_and_long_games_give_the_same(spark):
    """Games done in one task, level by level, and some in each way; a clock with many arrivals counts as long."""
    rows = [r for g, n in (("g1", 1), ("g2", 40), ("g3", 75)) for r in random_game(g, n, n)]
    arrivals = spark.createDataFrame(rows, FIELDS)
    index = spark.createDataFrame([("live", g, 100, 200) for g in ("g1", "g2", "g3")], "season STRING, game_id STRING, home_team_id BIGINT, away_team_id BIGINT")
    results = [sorted(rp.replay_states(arrivals, index, 3, short_game=n).collect(), key=lambda r: (r.game_id, r.cursor)) for n in (0, 50, 200, 10_000)]
    assert len(results[0]) == len(rows)
    assert all(r == results[0] for r in results[1:])


def test_arrivals_without_a_game(spark):
    """They belong to no game and are left out, whatever else they lack."""
    rows = random_game("g1", 5, 5)
    lost = [(None, None, None, None, "", "", None, [], "", None, None, "", None, "", "", "", "")]
    index = spark.createDataFrame([("live", "g1", 100, 200)], "season STRING, game_id STRING, home_team_id BIGINT, away_team_id BIGINT")
    with_lost, without = (sorted(map(tuple, rp.replay_states(spark.createDataFrame(r, FIELDS), index).collect())) for r in (rows + lost, rows))
    assert with_lost == without and len(without) == 5


def test_short_games_move_once(spark, monkeypatch):
    """The rows of short games are dealt by game, and no step after that deals them again or joins them with themselves."""
    plans = []
    monkeypatch.setattr(rp, "written", lambda df, name: plans.append((name, df)) or df)
    arrivals = spark.createDataFrame(random_game("g1", 40, 40), FIELDS)
    index = spark.createDataFrame([("live", "g1", 100, 200)], "season STRING, game_id STRING, home_team_id BIGINT, away_team_id BIGINT")
    rp.replay_states(arrivals, index)
    plan = dict(plans)["replay_states"]._jdf.queryExecution().executedPlan().toString()
    # The other exchange, if any, is that of the table of teams.
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) <= 2
    assert plan.count("Join") == 1

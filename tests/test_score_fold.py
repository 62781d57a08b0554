"""Score functions against the plain fold."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from hoopline.operators import score_fold as sf
from hoopline.operators import states as st
from hoopline.operators.states import _fold
from tests.plays import frame, index_of, play, walk

OPS = "ARRAY<STRUCT<home: INT, away: INT, is_period: BOOLEAN>>"


def random_rows(n: int, seed: int) -> list[tuple]:
    draw, rows = random.Random(seed), []
    for _ in range(n):
        top = draw.choice((3, 6, 40))
        ops = []
        for _ in range(draw.randrange(14)):
            period = draw.random() < 0.7
            home, away = draw.randrange(top), draw.randrange(top)
            shown = draw.choice(("both", "home", "away")) if period else draw.choice(("home", "away"))
            ops.append((home if shown != "away" else None, away if shown != "home" else None, period))
        rows.append((draw.randrange(top), draw.randrange(top), ops, draw.randrange(len(ops) + 1)))
    return rows


def test_functions_are_the_fold(spark):
    frame = spark.createDataFrame(random_rows(3000, 1), f"home INT, away INT, ops {OPS}, cut INT")
    first, rest = "slice(ops, 1, cut)", "slice(ops, cut + 1, size(ops))"
    rows = frame.withColumns({"f": F.expr(sf.of_rows(first)), "g": F.expr(sf.of_rows(rest)), "whole": F.expr(sf.of_rows("ops"))})
    rows = rows.withColumn("both", F.expr(sf.composed("f", "g")))
    rows = rows.withColumns({"folded": F.expr(_fold("named_struct('home', home, 'away', away)", "ops")), "at_once": F.expr(sf.applied("whole", "home", "away")), "in_two": F.expr(sf.applied("both", "home", "away"))})
    wrong = rows.where("NOT (folded <=> at_once) OR NOT (folded <=> in_two)")
    assert wrong.count() == 0, wrong.first()


def test_rising_period_rows_keep_one_threshold(spark):
    ops = [(k, k + 2, True) for k in range(0, 400, 2)]
    frame = spark.createDataFrame([(ops,)], f"ops {OPS}")
    found = frame.withColumn("f", F.expr(sf.of_rows("ops"))).first().f
    assert [(e.h, e.a, e.oh, e.oa) for e in found.entries] == [(398, 400, 398, 400)]


def test_a_feed_that_never_shows_both_scores(spark):
    """A thousand chunks without a full snapshot: same scores as one play at a time, and no summary grows with their number."""
    draw, plays, score = random.Random(3), [], [0, 0]
    for i in range(1000):
        side = draw.randrange(2)
        score[side] += draw.choice((0, 1, 2, -1 if i % 50 == 7 else 0))
        if i % 9 == 4:
            plays.append(play("period", "start", home=str(max(0, score[0] + draw.choice((0, 0, -4)))), away=str(max(0, score[1] + draw.choice((0, 0, 3)))), period=1 + i // 250, clock=f"PT{i % 12:02d}M{i % 60:02d}.00S"))
        else:
            shown = {"home": str(max(0, score[0]))} if side == 0 else {"away": str(max(0, score[1]))}
            plays.append(play("Made Shot", "", 100, period=1 + i // 250, clock=f"PT{i % 12:02d}M{i % 60:02d}.00S", **shown))
    actions, index = frame(spark, {"0000000001": plays}), index_of(spark, ["0000000001"])
    tracked = st.tracked_actions(actions, index, chunk_rows=1).select("source_event_index", "home_score", "away_score").collect()
    got = [(r.home_score, r.away_score) for r in sorted(tracked, key=lambda r: r.source_event_index)]
    assert got == [(s[0], s[1]) for s in walk(plays)]
    facts = st.action_facts(actions, index, chunk_rows=1).withColumn("clock_tops", F.expr("CAST(NULL AS MAP<STRING, INT>)"))
    linked = st._chunk_summaries(facts.where("has_next_chunk")).withColumn("fixed_score", F.expr("CASE WHEN chunk = 0 THEN named_struct('home', 0, 'away', 0) END"))
    inside = st._runs(linked.selectExpr("season", "game_id", "chunk AS at", "fixed_score AS fixed", "fold", "CAST(floor(chunk / 64) AS BIGINT) AS block"), "season, game_id, block")
    assert inside.count() == 999 and inside.agg(F.max(F.size("rest.entries"))).first()[0] <= 16

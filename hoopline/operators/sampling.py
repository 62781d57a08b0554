"""Samples, top-k reports and trajectories over states. No group is ever sorted whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoopline.functions import clock as ck
from hoopline.functions import events as ev
from hoopline.functions import fixed_values as fv
from hoopline.operators.ordinal import with_position
from hoopline.operators.states import IDX

GAME = ["season", "game_id"]
POSITION_BLOCK = 1 << 16


def latest_state(states: DataFrame) -> DataFrame:
    rest = [c for c in states.columns if c not in GAME]
    return states.groupBy(*GAME).agg(F.max_by(F.struct(*rest), IDX).alias("state")).select(*GAME, "state.*")


def placed_states(states: DataFrame) -> DataFrame:
    """States with their 0-based place in the game and the game's number of states."""
    block = F.expr(f"CAST(floor({IDX} / {POSITION_BLOCK}) AS BIGINT)")
    return with_position(states, GAME, [IDX], block=block, position="place", total="game_states")


def replay_sample(states: DataFrame, samples: int = 15) -> DataFrame:
    """Every k-th state of a game, k = max(1, states // samples), and the last one."""
    step = f"greatest(1, CAST(floor(game_states / {max(1, samples)}) AS BIGINT))"
    return placed_states(states).where(f"place % {step} = 0 OR place = game_states - 1")


def select_trajectory_games(states: DataFrame) -> DataFrame:
    """The closest game, the biggest comeback, the biggest blowout and the first overtime game.

    Ties go to the lower game id. Without an overtime game this is an error.
    """
    games = states.groupBy(*GAME).agg(
        F.expr(f"abs(max_by(score_differential, {IDX}))").alias("margin"),
        F.max("period").alias("last_period"),
        F.max("home_win").alias("home_win"),
        F.min("score_differential").alias("low"),
        F.max("score_differential").alias("high"),
    ).withColumn("comeback", F.expr("CASE WHEN home_win = 1 THEN -low ELSE high END"))
    picked = games.groupBy("season").agg(
        F.expr("min_by(game_id, struct(margin, game_id))").alias("close"),
        F.expr("min_by(game_id, struct(-comeback, game_id))").alias("comeback"),
        F.expr("min_by(game_id, struct(-margin, game_id))").alias("blowout"),
        F.expr("min(CASE WHEN last_period > 4 THEN game_id END)").alias("overtime"),
    )
    checked = "coalesce(overtime, raise_error('No overtime game to select'))"
    return picked.selectExpr(
        "season",
        f"stack(4, 'close', close, 'comeback', comeback, 'blowout', blowout, 'overtime', {checked}) AS (category, game_id)",
    )


def trajectory_samples(states: DataFrame, limit: int = 20) -> DataFrame:
    """Up to ``limit`` evenly spaced states of each selected game, first and last included."""
    chosen = select_trajectory_games(states)
    # Four games per season at most, so a few states travel.
    rows = placed_states(states.join(chosen.select(*GAME).distinct(), GAME, "left_semi"))
    wanted = F.expr(f"least({limit}, game_states)")
    # place p is kept if p = floor(k * (n - 1) / (m - 1)) for some k in 0..m-1
    kept = rows.withColumn("m", wanted).where(
        "place = CAST(floor(CAST(ceil(place * (m - 1) / greatest(game_states - 1, 1)) AS BIGINT) "
        "* (game_states - 1) / greatest(m - 1, 1)) AS BIGINT)"
    )
    return kept.join(chosen, GAME).selectExpr(
        *GAME,
        "category",
        "place",
        "period",
        "clock",
        "CAST(home_score AS STRING) || '-' || CAST(away_score AS STRING) AS score",
        "score_differential",
        "CASE WHEN possession_known = 0 THEN 'unknown' WHEN home_possession = 1 THEN 'home' ELSE 'away' END AS possession",
        *(["probability"] if "probability" in states.columns else []),
    )


def stratified_fixture(actions: DataFrame, head: int = 60, tail: int = 20, per_category: int = 4) -> DataFrame:
    """A small slice of every game: its start, its end and the first few of each category.

    One row per action number, as the last one written wins.
    """
    typed = actions.withColumn("category", F.expr(f"lower({ev.clean_text('actionType')})"))
    edges = typed.where(f"{IDX} < {head} OR {IDX} >= n_events - {tail}")
    order = Window.partitionBy(*GAME, "category").orderBy(IDX)
    first = (
        typed.where(f"category IN ({ev.text_list(fv.FIXTURE_CATEGORIES)})")
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= per_category)
        .drop("nth")
    )
    both = edges.unionByName(first)
    rest = [c for c in both.columns if c not in (*GAME, "actionNumber")]
    # Later additions replace earlier ones: head, then tail, then the categories in their order.
    rank = "array_position(array({}), category)".format(ev.text_list(fv.FIXTURE_CATEGORIES))
    turn = F.expr(f"struct(CASE WHEN stage = 1 THEN {rank} ELSE 0 END AS turn, {IDX} AS at)")
    both = edges.withColumn("stage", F.lit(0)).unionByName(first.withColumn("stage", F.lit(1))).withColumn("turn", turn)
    kept = both.groupBy(*GAME, "actionNumber").agg(F.max_by(F.struct(*rest), "turn").alias("row"))
    return kept.select(*GAME, "actionNumber", "row.*").orderBy(*GAME, "actionNumber")


def newest_states(states: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` states of each game; cut down before the shuffle (window group limit)."""
    order = Window.partitionBy(*GAME).orderBy(F.desc(IDX))
    return states.withColumn("_age", F.row_number().over(order)).where(F.col("_age") <= limit)


def probability_history(states: DataFrame, limit: int = 240) -> DataFrame:
    """The last probabilities of each game, oldest first, as one array per game."""
    entry = (
        f"struct({IDX} AS sequence, period, {ck.period_label('period')} AS period_label, clock, "
        "probability AS home_probability)"
    )
    return newest_states(states, limit).groupBy(*GAME).agg(F.expr(f"array_sort(collect_list({entry}))").alias("probability_history"))


def recent_events(states: DataFrame, limit: int = 12) -> DataFrame:
    """The last events of each game, oldest first, as one array per game."""
    entry = (
        f"struct({IDX} AS sequence, period, clock, "
        "coalesce(nullif(description, ''), nullif(semantic_event, ''), 'Game update') AS description, "
        "coalesce(semantic_event, '') AS semantic_event, home_score, away_score)"
    )
    return newest_states(states, limit).groupBy(*GAME).agg(F.expr(f"array_sort(collect_list({entry}))").alias("recent_events"))

"""Per-game and per-season results of a reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAME = ["season", "game_id"]
REPORTED_DISCREPANCIES = 100


def _agg(texts: dict[str, str]) -> list:
    return [F.expr(text).alias(name) for name, text in texts.items()]


def game_results(tracked: DataFrame) -> DataFrame:
    """One row per game. Markers are checked on all actions, possession on emitted states only."""
    results = tracked.groupBy(*GAME).agg(
        *_agg(
            {
                "raw_events": "count(1)",
                "emitted_states": "count_if(emitted)",
                "known_possession_states": "count_if(emitted AND possession_team_id IS NOT NULL)",
                "unknown_possession_states": "count_if(emitted AND possession_team_id IS NULL)",
                "final_home_score": "max_by(home_score, source_event_index)",
                "final_away_score": "max_by(away_score, source_event_index)",
                "expected_home_score": "max(home_pts)",
                "expected_away_score": "max(away_pts)",
                "foul_markers_checked": "count(marker_matches)",
                "foul_markers_matched": "coalesce(sum(marker_matches), 0)",
            }
        )
    )
    return results.withColumn(
        "final_score_matches",
        F.expr("final_home_score = expected_home_score AND final_away_score = expected_away_score"),
    )


def marker_discrepancies(tracked: DataFrame, limit: int | None = REPORTED_DISCREPANCIES) -> DataFrame:
    """Foul markers that disagree with the count; the season report keeps the first 100."""
    wrong = tracked.where("marker_matches = 0").selectExpr(
        *GAME,
        "source_event_index",
        "action_no AS action_number",
        "period",
        "clock_text AS clock",
        "team_id",
        "sub_type",
        "event_text AS description",
        "marker",
        "marker_reconstructed AS reconstructed",
    )
    if limit is None:
        return wrong
    # row_number() <= n is cut down before the shuffle (window group limit).
    order = Window.partitionBy("season").orderBy("game_id", "source_event_index")
    return wrong.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def possession_reasons(states: DataFrame) -> DataFrame:
    counted = states.groupBy("season", "possession_reason").agg(F.count(F.lit(1)).alias("states"))
    return counted.orderBy("season", F.desc("states"), "possession_reason")


def season_results(results: DataFrame, index: DataFrame) -> DataFrame:
    """Season roll-up of ``game_results``; percentages are 0 where there is nothing to divide by."""
    totals = results.groupBy("season").agg(
        *_agg(
            {
                "games_processed": "count(1)",
                "raw_events": "sum(raw_events)",
                "emitted_states": "sum(emitted_states)",
                "known_possession_states": "sum(known_possession_states)",
                "unknown_possession_states": "sum(unknown_possession_states)",
                "final_scores_valid": "count_if(final_score_matches)",
                "foul_markers_checked": "sum(foul_markers_checked)",
                "foul_markers_matched": "sum(foul_markers_matched)",
            }
        )
    )
    expected = index.groupBy("season").agg(F.countDistinct("game_id").alias("expected_games"))

    def percent(part: str, whole: str) -> str:
        return f"CASE WHEN {whole} > 0 THEN round(100D * {part} / {whole}, 6) ELSE 0D END"

    return totals.join(expected, "season", "left").withColumns(
        {
            name: F.expr(text)
            for name, text in {
                "known_possession_percent": percent("known_possession_states", "emitted_states"),
                "unknown_possession_percent": percent("unknown_possession_states", "emitted_states"),
                "final_score_validation_percent": percent("final_scores_valid", "games_processed"),
                "foul_marker_match_percent": percent("foul_markers_matched", "foul_markers_checked"),
            }.items()
        }
    )

"""Game log to game index, and look-ups against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_games(game_log: DataFrame) -> DataFrame:
    return game_log.where(F.col("GAME_ID").isNotNull()).select("GAME_ID").distinct().orderBy("GAME_ID")


def _split_sides(game_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    away = F.coalesce(F.col("MATCHUP").contains("@"), F.lit(False))
    return game_log.where(~away), game_log.where(away)


def game_index(game_log: DataFrame) -> DataFrame:
    """One row per game: home and away team, points, and whether the home side won (ties: 0)."""
    home, away = _split_sides(game_log)
    season = [c for c in ("season",) if c in game_log.columns]
    home = home.select(
        *season,
        "GAME_ID",
        "GAME_DATE",
        F.col("TEAM_ID").alias("home_team_id"),
        F.col("TEAM_ABBREVIATION").alias("home_team"),
        F.col("PTS").alias("home_pts"),
    )
    away = away.select(
        *season,
        "GAME_ID",
        F.col("TEAM_ID").alias("away_team_id"),
        F.col("TEAM_ABBREVIATION").alias("away_team"),
        F.col("PTS").alias("away_pts"),
    )
    return home.join(away, [*season, "GAME_ID"]).withColumn(
        "home_win", (F.col("home_pts") > F.col("away_pts")).cast("int")
    )


def ordered_index(game_log: DataFrame) -> DataFrame:
    return game_index(game_log).orderBy("GAME_DATE", "GAME_ID")


def state_index(game_log: DataFrame) -> DataFrame:
    """The index keyed the way actions are: season, game_id."""
    return game_index(game_log).withColumnRenamed("GAME_ID", "game_id")


def missing_games(index: DataFrame, present: DataFrame) -> DataFrame:
    """Games of the index that have no row in ``present``."""
    return index.select("season", "game_id").join(present.select("season", "game_id"), ["season", "game_id"], "left_anti")

"""Game logs as CSV. Ids are read as text, so their leading zeros survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "GAME_ID STRING, GAME_DATE DATE, TEAM_ID BIGINT, TEAM_ABBREVIATION STRING, MATCHUP STRING, WL STRING, PTS INT"
)


def game_log_name(season: str, season_type: str) -> str:
    return f"{season}_{season_type.lower().replace(' ', '_')}.csv"


def write_game_log(game_log: DataFrame, folder: str, season: str, season_type: str = "Regular Season") -> str:
    """Write one season; Spark writes a folder of part files under the season's name."""
    path = f"{folder}/{game_log_name(season, season_type)}"
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    game_log.select(*names).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_game_log(spark: SparkSession, folder: str, season: str, season_type: str = "Regular Season") -> DataFrame:
    path = f"{folder}/{game_log_name(season, season_type)}"
    return spark.read.schema(SCHEMA).option("header", True).csv(path).selectExpr(f"'{season}' AS season", "*")

"""The game-state table: zstd Parquet, one folder per season."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODEC = "zstd"


FILES_PER_SEASON = 16
ROWS_PER_FILE = 2_000_000


def write_states(states: DataFrame, path: str, mode: str = "overwrite", rows: int | None = None) -> None:
    """Write states by season; only the seasons that are written are replaced, so a second run changes nothing.

    Games are dealt over ``FILES_PER_SEASON`` files of a season, more if ``rows`` (a bound on the states, such as the number of actions) asks for it, and lie
    together in them, in list order.
    """
    order = [c for c in ("season", "game_id", "source_event_index") if c in states.columns]
    files = max(FILES_PER_SEASON, -(-(rows or 0) // ROWS_PER_FILE))
    dealt = states.repartition("season", F.pmod(F.xxhash64("game_id"), F.lit(files))).sortWithinPartitions(*order)
    (
        dealt.write.mode(mode)
        .option("compression", CODEC)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("season")
        .parquet(path)
    )


def replace_games(spark: SparkSession, states: DataFrame, path: str) -> None:
    """Replace the games in ``states`` in the table at ``path``. Only their seasons are read and written again."""
    games = states.select("season", "game_id").distinct()
    seasons = [r["season"] for r in games.select("season").distinct().collect()]
    kept = read_states(spark, path).where(F.col("season").isin(*seasons)).join(games, ["season", "game_id"], "left_anti")
    write_states(kept.unionByName(states.select(*kept.columns)), path)


def read_states(
    spark: SparkSession, path: str, seasons: list[str] | None = None, columns: list[str] | None = None
) -> DataFrame:
    """States of some or all seasons, pruned to ``columns``. A season without data is an error."""
    table = spark.read.parquet(path).withColumn("season", F.col("season").cast("string"))
    if seasons is not None:
        # Distinct values of the folder column come from file names and footers; one job for all seasons.
        there = {r["season"] for r in table.select("season").distinct().collect()}
        missing = [s for s in seasons if s not in there]
        if missing:
            raise FileNotFoundError(f"No game states for seasons {missing}")
        table = table.where(F.col("season").isin(*seasons))
    return table if columns is None else table.select(*columns)


def stored_places(spark: SparkSession, path: str) -> DataFrame:
    """All states of the table with ``stored_file`` and ``stored_row``, where they stand in its files."""
    table = spark.read.parquet(path).withColumn("season", F.col("season").cast("string"))
    return table.withColumns({"stored_file": F.col("_metadata.file_path"), "stored_row": F.col("_metadata.row_index")})


def union_seasons(*parts: DataFrame) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result

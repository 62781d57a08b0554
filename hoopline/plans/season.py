"""A season end to end: raw documents and game log to states, results and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hoopline.operators import dataset as ds
from hoopline.operators import index as ix
from hoopline.operators import rollups as ru
from hoopline.operators import states as st
from hoopline.sources.state_store import read_states, write_states


def process_season(
    actions: DataFrame,
    game_log: DataFrame,
    states_path: str,
    tracked_path: str,
    game_ids: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rebuild all selected games in one job; returns the season results. A game of the log without a feed stops it.

    The tracked actions are written once; states, results and discrepancies read that table.
    """
    index = ix.state_index(game_log)
    if game_ids is not None or limit is not None:
        chosen = ds.select_games(index, game_ids, limit)
        actions = actions.join(chosen, "game_id", "left_semi")
    spark = actions.sparkSession
    wanted = index if game_ids is None and limit is None else index.join(chosen, "game_id", "left_semi")
    absent = ix.missing_games(wanted, actions.select("season", "game_id").distinct()).limit(5).collect()
    if absent:
        raise FileNotFoundError(f"Games without a feed, for example {[r['game_id'] for r in absent]}")
    actions = st.with_game_length(actions)
    longest = st.longest_game(actions)
    # Counted while the rows are written, so nothing is read again for it.
    written = Observation("tracked")
    counted = st.tracked_actions(actions, index, longest=longest).observe(written, F.count(F.lit(1)).alias("actions"), F.expr("count_if(emitted)").alias("states"))
    counted.write.mode("overwrite").parquet(tracked_path)
    tracked = spark.read.parquet(tracked_path)
    write_states(st.emitted_states(tracked), states_path, rows=written.get["states"])
    return ru.season_results(ru.game_results(tracked), index)


def game_list(tracked: DataFrame, index: DataFrame) -> DataFrame:
    """Per game what its processing gave: actions, states, known possession, whether the last score is the index's, and foul markers."""
    games = tracked.groupBy("season", "game_id").agg(
        F.count(F.lit(1)).alias("raw_events"),
        F.expr("count_if(emitted)").alias("emitted_states"),
        F.expr("count_if(emitted AND possession_team_id IS NOT NULL)").alias("known_possession_states"),
        F.expr("count_if(emitted AND possession_team_id IS NULL)").alias("unknown_possession_states"),
        F.expr("max_by(struct(home_score, away_score), source_event_index)").alias("_last"),
        F.count("marker_matches").alias("foul_markers_checked"),
        F.expr("coalesce(sum(marker_matches), 0)").alias("foul_markers_matched"),
    )
    known = index.select("season", "game_id", "home_pts", "away_pts")
    same = "_last.home_score = home_pts AND _last.away_score = away_pts"
    return games.join(known, ["season", "game_id"]).withColumn("final_score_matches", F.expr(f"coalesce({same}, false)")).drop("_last", "home_pts", "away_pts")


def stored_bytes(spark: SparkSession, states_path: str) -> DataFrame:
    """Bytes of the state table's files by season; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(states_path)
    season = "regexp_extract(path, r'/season=([^/]+)/', 1)"
    return files.groupBy(F.expr(season).alias("season")).agg(F.sum("length").alias("processed_bytes"))


def season_report(spark: SparkSession, states_path: str, tracked_path: str, results: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One nested row per season: totals, possession reasons, the first marker discrepancies, bytes on disk and, with ``index``, the list of games."""
    reasons = ru.possession_reasons(read_states(spark, states_path)).groupBy("season").agg(
        F.expr("array_sort(collect_list(struct(-states AS order, possession_reason, states)))").alias("possession_reasons")
    )
    tracked = spark.read.parquet(tracked_path)
    wrong = ru.marker_discrepancies(tracked).groupBy("season").agg(
        F.expr("array_sort(collect_list(struct(game_id, source_event_index, marker, reconstructed)))").alias("marker_discrepancies")
    )
    report = results.join(reasons, "season", "left").join(wrong, "season", "left").join(stored_bytes(spark, states_path), "season", "left")
    if index is None:
        return report
    games = game_list(tracked, index)
    listed = ", ".join(c for c in games.columns if c != "season")
    # A season has as many games as its schedule, whatever the number of actions.
    return report.join(games.groupBy("season").agg(F.expr(f"array_sort(collect_list(struct({listed})))").alias("game_results")), "season", "left")


def write_report(report: DataFrame, path: str) -> None:
    """A small report as JSON; the committer makes it appear whole or not at all."""
    report.coalesce(1).write.mode("overwrite").json(path)

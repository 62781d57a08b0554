"""Which games are loaded, which failed, and which to load next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = (
    "game_id STRING, status STRING, attempts INT, last_action STRING, event_count INT, error_type STRING, error STRING, "
    "updated_at TIMESTAMP"
)
ERROR_LENGTH = 500
LISTED_ERROR_LENGTH = 90
LISTED_FAILURES = 20


def register_games(manifest: DataFrame, games: DataFrame) -> DataFrame:
    """Add games the manifest does not know as pending, with no attempts."""
    new = games.select("game_id").distinct().join(manifest.select("game_id"), "game_id", "left_anti")
    return manifest.unionByName(
        new.selectExpr("game_id", "'pending' AS status", "0 AS attempts"), allowMissingColumns=True
    )


def manifest_update(manifest: DataFrame, outcomes: DataFrame, now: str = "current_timestamp()") -> DataFrame:
    """Apply one run's outcomes (game_id, action, event_count, error_type, error).

    A success clears the error; a failure counts an attempt and keeps an earlier event count.
    """
    old = manifest.select("game_id", *[F.col(c).alias(f"o_{c}") for c in manifest.columns if c != "game_id"])
    new = outcomes.selectExpr("game_id", "action", "event_count AS n_count", "error_type AS n_type", "error AS n_error")
    both = old.join(new, "game_id", "full_outer")
    return both.selectExpr(
        "game_id",
        "CASE WHEN action IS NULL THEN o_status WHEN action = 'failed' THEN 'failed' ELSE 'downloaded' END AS status",
        "coalesce(o_attempts, 0) + CASE WHEN action = 'failed' THEN 1 ELSE 0 END AS attempts",
        "coalesce(action, o_last_action) AS last_action",
        "CASE WHEN action IS NULL OR action = 'failed' THEN o_event_count ELSE n_count END AS event_count",
        "CASE WHEN action IS NULL THEN o_error_type WHEN action = 'failed' THEN n_type END AS error_type",
        f"CASE WHEN action IS NULL THEN o_error WHEN action = 'failed' THEN left(n_error, {ERROR_LENGTH}) END AS error",
        f"CASE WHEN action IS NULL THEN o_updated_at ELSE {now} END AS updated_at",
    )


def failure_log(updated: DataFrame, outcomes: DataFrame, season: str, season_type: str, now: str = "current_timestamp()") -> DataFrame:
    """The rows this run appends to the failure history."""
    failed = outcomes.where("action = 'failed'").select("game_id")
    return updated.join(failed, "game_id", "left_semi").selectExpr(
        f"{now} AS timestamp", f"'{season}' AS season", f"'{season_type}' AS season_type", "game_id", "error_type", "error", "attempts"
    )


def games_to_process(index: DataFrame, valid: DataFrame, manifest: DataFrame, mode: str = "retry") -> DataFrame:
    """Games still to load. Valid data on disk settles the matter, whatever the manifest says.

    ``retry`` takes failed games too, ``no_retry`` leaves them out, ``only_failed`` takes nothing else.
    """
    if mode not in ("retry", "no_retry", "only_failed"):
        raise ValueError(f"Unknown mode {mode!r}")
    games = index.select("game_id").distinct()
    failed = manifest.where("status = 'failed'").select("game_id")
    if mode == "only_failed":
        games = games.join(failed, "game_id", "left_semi")
    elif mode == "no_retry":
        games = games.join(failed, "game_id", "left_anti")
    return games.join(valid.select("game_id"), "game_id", "left_anti")


def ingest_run_stats(outcomes: DataFrame) -> DataFrame:
    """One row for a run: games looked at, loaded, skipped, failed, and events loaded by it."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("considered"),
        F.expr("count_if(action = 'downloaded')").alias("downloaded"),
        F.expr("count_if(action = 'skipped')").alias("skipped"),
        F.expr("count_if(action = 'failed')").alias("failed"),
        F.expr("coalesce(sum(CASE WHEN action = 'downloaded' THEN event_count END), 0)").alias("events"),
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("total"),
        F.expr("count_if(status = 'pending')").alias("pending"),
        F.expr("count_if(status = 'downloaded')").alias("downloaded"),
        F.expr("count_if(status = 'failed')").alias("failed"),
        F.expr("coalesce(sum(event_count), 0)").alias("events"),
    )


def manifest_status(manifest: DataFrame) -> DataFrame:
    """Totals by status, then the first failed games with a short error."""
    totals = manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "'total' AS kind", "status AS label", "n", "CAST(NULL AS STRING) AS error"
    )
    failed = manifest.where("status = 'failed'").orderBy("game_id").limit(LISTED_FAILURES).selectExpr(
        "'failed game' AS kind",
        "game_id AS label",
        "CAST(NULL AS BIGINT) AS n",
        f"coalesce(error_type, '?') || ': ' || left(coalesce(error, ''), {LISTED_ERROR_LENGTH}) AS error",
    )
    return totals.unionByName(failed)

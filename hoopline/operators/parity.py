"""How far two reconstructions of the same games agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.functions import fixed_values as fv
from hoopline.operators.states import IDX


def _last_per_action(states: DataFrame, name: str) -> DataFrame:
    return states.groupBy("game_id", "action_number").agg(
        F.max_by(F.struct(*fv.PARITY_FIELDS), IDX).alias(name)
    )


def parity_fields(historical: DataFrame, live: DataFrame) -> DataFrame:
    """Per game and field: states aligned by action number, and how many are equal (null equals null)."""
    left, right = _last_per_action(historical, "h"), _last_per_action(live, "l").withColumnRenamed("game_id", "live_game_id")
    right = right.withColumnRenamed("action_number", "live_action_number")
    aligned = left.join(
        right, F.expr("game_id = live_game_id AND action_number <=> live_action_number"), "inner"
    )
    # Thirteen sums per game, then turned into rows, rather than thirteen rows per state.
    sums = aligned.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("compared"), *[F.expr(f"count_if(h.{c} <=> l.{c})").alias(c) for c in fv.PARITY_FIELDS]
    )
    games = historical.select("game_id").distinct().join(live.select("game_id").distinct(), "game_id")
    filled = games.join(sums, "game_id", "left").na.fill(0)
    pairs = ", ".join(f"'{c}', {c}" for c in fv.PARITY_FIELDS)
    return filled.selectExpr(
        "game_id", "compared", f"stack({len(fv.PARITY_FIELDS)}, {pairs}) AS (field, matches)"
    ).selectExpr(
        "game_id",
        "field",
        "matches",
        "compared",
        "CASE WHEN compared > 0 THEN round(100D * matches / compared, 6) ELSE 0D END AS percent",
    )


def parity_anchors(historical: DataFrame, live: DataFrame) -> DataFrame:
    """Distinct (period, clock, scores) of either side, and how many both have."""

    def side(states: DataFrame, h: int, l: int) -> DataFrame:
        return states.select("game_id", *fv.PARITY_ANCHOR, F.lit(h).alias("h"), F.lit(l).alias("l"))

    both = side(historical, 1, 0).unionByName(side(live, 0, 1))
    anchors = both.groupBy("game_id", *fv.PARITY_ANCHOR).agg(F.max("h").alias("h"), F.max("l").alias("l"))
    return anchors.groupBy("game_id").agg(
        F.sum("h").alias("historical_anchors"), F.sum("l").alias("live_anchors"), F.sum(F.expr("h * l")).alias("anchor_matches")
    )


def parity_report(historical: DataFrame, live: DataFrame) -> DataFrame:
    """One row per game: state counts, final scores, aligned states, anchors, percent per field. A game that one side lacks is an error."""

    def ends(states: DataFrame, side: str) -> DataFrame:
        return states.groupBy("game_id").agg(
            F.count(F.lit(1)).alias(f"{side}_states"),
            F.expr(f"max_by(home_score, {IDX})").alias(f"{side}_home"),
            F.expr(f"max_by(away_score, {IDX})").alias(f"{side}_away"),
        )

    fields = parity_fields(historical, live).groupBy("game_id").agg(
        F.max("compared").alias("aligned_states"),
        F.expr("map_from_entries(array_sort(collect_list(struct(field, percent))))").alias("percents"),
    )
    rows = (
        ends(historical, "historical")
        .join(ends(live, "live"), "game_id", "full")
        .join(fields, "game_id", "left")
        .join(parity_anchors(historical, live), "game_id")
    )
    checked = "CASE WHEN historical_states IS NULL OR live_states IS NULL THEN raise_error('Only one side has game ' || game_id) ELSE historical_states END"
    return rows.withColumns({"historical_states": F.expr(checked), "aligned_states": F.expr("coalesce(aligned_states, 0L)")})

"""Profiles of raw actions: what types, subtypes, markers and fields a season holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoopline.functions import events as ev
from hoopline.functions import fixed_values as fv
from hoopline.operators.states import IDX

EXAMPLES = 8


def labelled(actions: DataFrame) -> DataFrame:
    """Cleaned text columns with blanks shown as ``<blank>``."""
    cleaned = actions.withColumns(
        ev.exprs(
            {
                "type_text": ev.clean_text("actionType"),
                "subtype_text": ev.clean_text("subType"),
                "description_text": ev.clean_text("description"),
            }
        )
    )
    return cleaned.withColumns(
        ev.exprs(
            {
                "type_label": "CASE WHEN type_text = '' THEN '<blank>' ELSE lower(type_text) END",
                "subtype_label": "CASE WHEN subtype_text = '' THEN '<blank>' ELSE lower(subtype_text) END",
                "marker": ev.foul_marker("description_text"),
            }
        )
    )


def _fouls(actions: DataFrame) -> DataFrame:
    return labelled(actions).where("contains(type_label, 'foul')")


def event_inventory(actions: DataFrame) -> DataFrame:
    """Counts per season in long form: games, events, each action type and each period."""
    rows = labelled(actions)
    totals = rows.groupBy("season").agg(
        F.countDistinct("game_id").alias("games"), F.count(F.lit(1)).alias("events")
    )
    totals = totals.selectExpr("season", "stack(2, 'games', games, 'events', events) AS (measure, n)").selectExpr(
        "season", "measure", "'' AS label", "n"
    )
    facets = rows.selectExpr(
        "season",
        "inline(array(named_struct('measure', 'action type', 'label', type_label), "
        "named_struct('measure', 'period', 'label', CAST(period AS STRING))))",
    ).where("label IS NOT NULL")
    counted = facets.groupBy("season", "measure", "label").agg(F.count(F.lit(1)).alias("n"))
    return totals.unionByName(counted)


def subtype_counts(actions: DataFrame) -> DataFrame:
    return labelled(actions).groupBy("season", "type_label", "subtype_label").agg(F.count(F.lit(1)).alias("n"))


def blank_descriptions(actions: DataFrame, limit: int = 30) -> DataFrame:
    """The most frequent descriptions of rows without an action type, per season."""
    counted = labelled(actions).where("type_text = ''").groupBy("season", "description_text").agg(
        F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("season").orderBy(F.desc("n"), "description_text")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def foul_marker_hist(actions: DataFrame) -> DataFrame:
    return _fouls(actions).where("marker IS NOT NULL").groupBy("season", "marker").agg(F.count(F.lit(1)).alias("n"))


def foul_marker_coverage(actions: DataFrame) -> DataFrame:
    return _fouls(actions).groupBy("season", "subtype_label").agg(
        F.expr("count_if(marker IS NOT NULL)").alias("with_marker"),
        F.expr("count_if(marker IS NULL)").alias("without_marker"),
    )


def _foul_checks(actions: DataFrame, chunk_rows: int) -> DataFrame:
    """Fouls with a marker, once for each of two counting rules: ``rule``, ``expected`` (the running count per game, period value and team), ``observed`` (the marker).

    Counts run inside a chunk of list positions and start from the totals of the chunks before.
    """
    neutral = ev.text_list(fv.POSSESSION_NEUTRAL_FOULS)
    shown = ["season", "game_id", IDX, "actionNumber", "period", "clock", "teamId", "teamTricode", "type_text", "subtype_text", "description_text", "marker"]
    fouls = _fouls(actions).where("teamId > 0 AND period IS NOT NULL").selectExpr(
        *shown,
        f"CAST(floor({IDX} / {chunk_rows}) AS BIGINT) AS chunk",
        f"CAST(subtype_label NOT IN ({neutral}) AS INT) AS not_technical",
        f"CAST(subtype_label NOT IN ({neutral}) AND subtype_label NOT IN ('offensive', 'offensive charge') AS INT) AS defensive",
    )
    group = "season, game_id, period, teamId"
    piece = ["season", "game_id", "period", "teamId", "chunk"]
    totals = fouls.groupBy(*piece).agg(F.sum("not_technical").alias("t1"), F.sum("defensive").alias("t2"))
    before = f"OVER (PARTITION BY {group} ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = totals.selectExpr(*piece, f"coalesce(sum(t1) {before}, 0) AS s1", f"coalesce(sum(t2) {before}, 0) AS s2")
    so_far = f"OVER (PARTITION BY {group}, chunk ORDER BY {IDX} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    counted = fouls.join(starts, piece).selectExpr(*shown, f"s1 + sum(not_technical) {so_far} AS c1", f"s2 + sum(defensive) {so_far} AS c2")
    return counted.where("marker IS NOT NULL").selectExpr(
        *shown[:-1], "marker AS observed", "stack(2, 'exclude_technical', c1, 'exclude_technical_and_offensive', c2) AS (rule, expected)"
    )


def foul_rule_comparison(actions: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    """How often the markers agree with two counting rules."""
    label = F.expr("CASE WHEN observed = expected THEN 'match' ELSE 'mismatch' END").alias("label")
    return _foul_checks(actions, chunk_rows).groupBy("season", "rule", label).agg(F.count(F.lit(1)).alias("n"))


def foul_mismatches(actions: DataFrame, examples: int = EXAMPLES, chunk_rows: int = 4096) -> DataFrame:
    """The first fouls of each season whose marker differs from a rule's count, with both numbers."""
    wrong = _foul_checks(actions, chunk_rows).where("observed <> expected").withColumn("example", F.expr("'foul_mismatch:' || rule"))
    order = Window.partitionBy("season", "example").orderBy("game_id", IDX)
    return wrong.withColumn("place", F.row_number().over(order)).where(F.col("place") <= examples).selectExpr(
        "season", "example", "place", "game_id", IDX, "actionNumber AS action_number", "period", "clock", "teamId AS team_id", "teamTricode AS tricode",
        "type_text AS action_type", "subtype_text AS subtype", "description_text AS description", "expected", "observed",
    )


def timeout_attribution(actions: DataFrame) -> DataFrame:
    """Timeouts by team id and by tricode, in long form."""
    rows = labelled(actions).where("contains(type_label, 'timeout')").selectExpr(
        "season",
        f"""inline(array(
            named_struct('field', 'teamId', 'label', coalesce(nullif({ev.clean_text('teamId')}, ''), '<blank>')),
            named_struct('field', 'teamTricode', 'label', coalesce(nullif({ev.clean_text('teamTricode')}, ''), '<blank>'))))""",
    )
    return rows.groupBy("season", "field", "label").agg(F.count(F.lit(1)).alias("n"))


def missing_feeds(actions: DataFrame, index: DataFrame) -> DataFrame:
    """Per season of the index: games that it lists, those with a feed, and those without."""
    there = actions.select("season", "game_id").distinct().withColumn("has_feed", F.lit(1))
    games = index.select("season", "game_id").distinct().join(there, ["season", "game_id"], "left")
    return games.groupBy("season").agg(F.count(F.lit(1)).alias("listed"), F.count("has_feed").alias("with_feed"), F.expr("count_if(has_feed IS NULL)").alias("missing"))


def category_examples(actions: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """The first rows of each kind worth looking at; ``foul_mismatches`` has those of fouls that a rule counts differently."""
    keys = """array_compact(array(
        CASE WHEN type_text = '' THEN 'blank_action_type' END,
        CASE WHEN contains(type_label, 'foul') THEN 'foul:' || subtype_label END,
        CASE WHEN contains(type_label, 'free throw') THEN 'free_throw:' || subtype_label END,
        CASE WHEN contains(type_label, 'rebound') THEN 'rebound:' || subtype_label END,
        CASE WHEN contains(type_label, 'jump ball') THEN 'jump_ball' END,
        CASE WHEN contains(type_label, 'timeout') THEN 'timeout:' || subtype_label END))"""
    rows = labelled(actions).withColumn("example", F.explode(F.expr(keys)))
    order = Window.partitionBy("season", "example").orderBy("game_id", IDX)
    return (
        rows.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= examples)
        .selectExpr(
            "season", "example", "place", "game_id", IDX, "actionNumber AS action_number", "period", "clock",
            "teamId AS team_id", "teamTricode AS tricode", "type_text AS action_type", "subtype_text AS subtype", "description_text AS description",
        )
    )


def field_presence(documents: DataFrame, column: str = "actions_json") -> DataFrame:
    """How many actions carry each key, null values included. Input: action objects as JSON text."""
    keys = documents.select("season", F.explode(F.expr(f"json_object_keys({column})")).alias("field"))
    return keys.groupBy("season", "field").agg(F.count(F.lit(1)).alias("n"))


def profile_fields(actions: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: rows, blanks, and distinct values, in one pass over the table."""
    parts = ", ".join(
        f"named_struct('field', '{name}', 'value', {ev.clean_text(name)})" for name in fields
    )
    values = actions.selectExpr(f"inline(array({parts}))")
    # Counting values first keeps the shuffle to one row per distinct value and task.
    counted = values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("field").agg(
        F.sum("n").alias("row_count"),
        F.expr("coalesce(sum(CASE WHEN value = '' THEN n END), 0)").alias("blanks"),
        F.expr("count_if(value <> '')").alias("distinct_values"),
    )


def value_counts(actions: DataFrame, field: str) -> DataFrame:
    return actions.groupBy(F.expr(ev.clean_text(field)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def home_win_rate(index: DataFrame) -> DataFrame:
    return index.groupBy("season").agg(
        F.sum("home_win").alias("home_wins"), F.expr("round(avg(home_win), 6)").alias("home_win_rate")
    )

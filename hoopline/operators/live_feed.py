"""Live feeds: one identity once, in feed order, in the historical contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.functions import events as ev
from hoopline.functions import live as lv
from hoopline.operators.ordinal import with_position
from hoopline.session import written

# Feed order numbers step by about ten thousand per action, so a block of this many holds a few thousand actions. List
# positions, which stand in for null and 0, step by one and are far below any order number.
ORDER_BLOCK, POSITION_BLOCK, POSITIONS = 1 << 25, 1 << 12, 1 << 24


def dedupe_live(actions: DataFrame, keys: list[str] = ["game_id"]) -> DataFrame:
    """The last arrival of each (orderNumber, actionNumber); actions with neither are all kept.

    ``max_by`` combines on the map side, so an identity that arrives very often costs no skew.
    """
    alone = F.expr("CASE WHEN orderNumber IS NULL AND actionNumber IS NULL THEN source_index END")
    identity = [*keys, "orderNumber", "actionNumber"]
    rest = [c for c in actions.columns if c not in identity]
    last = actions.groupBy(*identity, alone.alias("_alone")).agg(F.max_by(F.struct(*rest), "source_index").alias("_row"))
    return last.select(*identity, "_row.*").select(*actions.columns)


def live_order(actions: DataFrame, keys: list[str] = ["game_id"], short: bool = False) -> DataFrame:
    """Position in feed order: by orderNumber, those without one last; 0 and null go by arrival.

    ``short`` says that one task can sort a whole group; rows that are dealt by ``keys`` then stay where they are.
    """
    keyed = actions.withColumns(
        ev.exprs(
            {
                "_unordered": "CAST(orderNumber IS NULL AS INT)",
                "_order": "CAST(coalesce(nullif(orderNumber, 0), source_index) AS BIGINT)",
            }
        )
    )
    order = ["_unordered", "_order", "source_index"]
    if short:
        along = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND"
        places = {"source_event_index": f"CAST(row_number() {along} CURRENT ROW) - 1 AS INT)", "n_events": f"CAST(count(1) {along} UNBOUNDED FOLLOWING) AS INT)"}
        return keyed.withColumns(ev.exprs(places)).drop("_unordered", "_order")
    block = F.expr(
        f"struct(_unordered, CASE WHEN _unordered = 1 OR _order < {POSITIONS} THEN CAST(floor(_order / {POSITION_BLOCK}) AS BIGINT) "
        f"ELSE {POSITIONS // POSITION_BLOCK} + CAST(floor(_order / {ORDER_BLOCK}) AS BIGINT) END AS block)"
    )
    placed = with_position(
        keyed, keys, order, block=block, position="source_event_index", total="n_events"
    )
    return placed.drop("_unordered", "_order").withColumns(
        ev.exprs({"source_event_index": "CAST(source_event_index AS INT)", "n_events": "CAST(n_events AS INT)"})
    )


def _unusable() -> str:
    return f"(period IS NULL OR period < 1 OR {ev.clean_text('clock')} = '')"


def quarantined_live(actions: DataFrame) -> DataFrame:
    """The live actions that ``adapt_live`` leaves out with ``mode='quarantine'``."""
    return actions.where(_unusable())


def adapt_live(actions: DataFrame, mode: str = "fail", carried: tuple[str, ...] = ()) -> DataFrame:
    """Live actions in the historical contract, row by row, and the columns ``carried`` as they are.

    The feed's own possession is kept for diagnosis as ``source_possession_team_id`` and used nowhere.
    """
    bad = _unusable()
    if mode == "quarantine":
        actions, period = actions.where(f"NOT ({bad})"), "period"
    else:
        period = f"CASE WHEN {bad} THEN raise_error('Live action without period or clock: ' || source_index) ELSE period END"
    kept = [c for c in ("game_id", "season", "poll", "source_index", "source_event_index", "n_events") if c in actions.columns]
    return actions.selectExpr(
        *kept,
        *carried,
        "CAST(coalesce(actionNumber, orderNumber, source_index) AS BIGINT) AS sequence",
        "CAST(coalesce(orderNumber, actionNumber, source_index) AS STRING) AS event_id",
        f"{period} AS period",
        f"{ev.clean_text('clock')} AS clock",
        f"{ev.normalize_team_id('teamId')} AS team_id",
        f"{ev.clean_text('teamTricode')} AS team_tricode",
        f"{lv.canonical_type('actionType', 'shotResult')} AS action_type",
        f"{lv.canonical_subtype('actionType', 'subType', 'descriptor', 'qualifiers')} AS sub_type",
        f"{ev.clean_text('description')} AS description",
        f"{ev.clean_text('scoreHome')} AS score_home",
        f"{ev.clean_text('scoreAway')} AS score_away",
        f"{ev.clean_text('shotResult')} AS shot_result",
        f"{ev.normalize_team_id('possession')} AS source_possession_team_id",
        f"{ev.clean_text('actionType')} AS source_action_type",
        f"{ev.clean_text('subType')} AS source_action_subtype",
    )


def as_actions(adapted: DataFrame, season: str = "live", carried: tuple[str, ...] = ()) -> DataFrame:
    """Adapted live events under the names that the state reconstruction reads, and the columns ``carried`` as they are."""
    poll = ["poll"] if "poll" in adapted.columns else []
    return adapted.selectExpr(
        f"'{season}' AS season" if "season" not in adapted.columns else "season",
        "game_id",
        *poll,
        *carried,
        "source_event_index",
        "n_events",
        "event_id AS actionId",
        "sequence AS actionNumber",
        "action_type AS actionType",
        "sub_type AS subType",
        "clock",
        "period",
        "team_id AS teamId",
        "team_tricode AS teamTricode",
        "description",
        "score_home AS scoreHome",
        "score_away AS scoreAway",
        "shot_result AS shotResult",
    )


def live_feed_actions(actions: DataFrame, keys: list[str] = ["game_id"], mode: str = "fail") -> DataFrame:
    """Raw live actions to the historical contract: once each, in order, translated.

    Putting in order reads its rows twice, so they are written once they are single; else the whole actions are sorted and shuffled twice for that.
    """
    return as_actions(adapt_live(live_order(written(dedupe_live(actions, keys), "live_once"), keys), mode))


def replay_prefix(actions: DataFrame, cursors: DataFrame, keys: list[str] = ["game_id"]) -> DataFrame:
    """The first ``cursor`` arrivals of each game; cut before doubles are dropped and order is made."""
    return actions.join(cursors.select(*keys, "cursor"), keys).where("source_index < cursor").drop("cursor")

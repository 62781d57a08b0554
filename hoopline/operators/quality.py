"""Validation of raw feeds and re-verification of what was built from them.

Every check is a partial aggregate per game, so a huge game is summed up where its rows lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.functions import clock as ck
from hoopline.functions import events as ev
from hoopline.functions import fixed_values as fv
from hoopline.operators.history import carry_last
from hoopline.operators.ordinal import with_position
from hoopline.operators.states import IDX

GAME = ["season", "game_id"]


def _problems(rules: dict[str, str]) -> str:
    """An array of the messages whose condition holds; a message is expression text."""
    return "array_compact(array(" + ", ".join(f"CASE WHEN {condition} THEN {message} END" for message, condition in rules.items()) + "))"


def _field_text(key: str) -> str:
    return ev.clean_text(f"try_variant_get(a, '$.{key}', 'string')")


# --- Raw feeds --------------------------------------------------------------------------


def validate_feeds(documents: DataFrame) -> DataFrame:
    """One row per game: is_valid, event_count, problems.

    ``documents`` has season, game_id (the one asked for) and value (JSON text); a game may be
    split over several documents. A key that is present with null is not a missing key.
    """
    parsed = documents.select(*GAME, F.expr("try_parse_json(value)").alias("v"))
    shaped = parsed.selectExpr(
        *GAME,
        "CASE WHEN v IS NULL THEN 'corrupt' WHEN NOT startswith(schema_of_variant(v), 'OBJECT') THEN 'not an object' "
        "WHEN NOT coalesce(startswith(schema_of_variant(variant_get(v, '$.game', 'variant')), 'OBJECT'), false) THEN 'no game' "
        "WHEN NOT coalesce(startswith(schema_of_variant(variant_get(v, '$.game.actions', 'variant')), 'ARRAY'), false) THEN 'no list' "
        "ELSE 'list' END AS shape",
        "v",
    ).withColumns(
        ev.exprs(
            {
                "found_id": "CASE WHEN shape IN ('no list', 'list') THEN coalesce(try_variant_get(v, '$.game.gameId', 'string'), '') END",
                "actions": "CASE WHEN shape = 'list' THEN variant_get(v, '$.game.actions', 'array<variant>') END",
            }
        )
    )
    rows = shaped.selectExpr(*GAME, "shape", "found_id", "explode_outer(actions) AS a")
    facts = rows.selectExpr(
        *GAME,
        "shape",
        "found_id",
        "a IS NOT NULL AS is_event",
        *[f"variant_get(a, '$.{key}', 'variant') IS NOT NULL AS has_{key}" for key in fv.REQUIRED_ACTION_KEYS],
        "CASE WHEN schema_of_variant(variant_get(a, '$.period', 'variant')) = 'BIGINT' THEN try_variant_get(a, '$.period', 'bigint') END AS period",
        f"coalesce({_field_text('clock')} RLIKE r'{fv.CLOCK_PATTERN}', false) AS clock_ok",
        "coalesce(is_variant_null(variant_get(a, '$.actionType', 'variant')), false) "
        f"OR {_field_text('actionType')} <> '' AS typed",
    )
    sums = facts.groupBy(*GAME).agg(
        F.expr("min_by(shape, CASE shape WHEN 'corrupt' THEN 0 WHEN 'not an object' THEN 1 WHEN 'no game' THEN 2 WHEN 'no list' THEN 3 ELSE 4 END)").alias("shape"),
        F.expr("max(CASE WHEN found_id <> game_id THEN found_id END)").alias("other_id"),
        F.expr("count_if(is_event)").alias("n"),
        *[F.expr(f"count_if(is_event AND NOT has_{key})").alias(f"no_{key}") for key in fv.REQUIRED_ACTION_KEYS],
        F.expr("min(period)").alias("low"),
        F.expr("count_if(clock_ok)").alias("clocks"),
        F.expr("count_if(is_event AND typed)").alias("types"),
    )
    rules = {
        "'the document is not readable JSON'": "shape = 'corrupt'",
        "'the document is not an object'": "shape = 'not an object'",
        "'the document has no game object'": "shape = 'no game'",
        "'the document is for game ' || coalesce(nullif(other_id, ''), 'nothing')": "other_id IS NOT NULL",
        "'there is no list of actions'": "shape = 'no list'",
        "'the list of actions is empty'": "shape = 'list' AND n = 0",
        f"'too few events: ' || n": f"n > 0 AND n < {fv.MINIMUM_EVENTS}",
        **{f"'{key} is missing from events: ' || no_{key}": f"no_{key} > 0" for key in fv.REQUIRED_ACTION_KEYS},
        "'no whole-number period'": "n > 0 AND low IS NULL",
        "'period is below one: ' || low": "n > 0 AND low < 1",
        "'no readable clock'": "n > 0 AND clocks = 0",
        "'too few readable clocks: ' || clocks": f"n > 0 AND clocks > 0 AND clocks < {fv.MINIMUM_CLOCK_SHARE}D * n",
        "'no action type'": "n > 0 AND types = 0",
        "'too few action types: ' || types": f"n > 0 AND types > 0 AND types < {fv.MINIMUM_TYPE_SHARE}D * n",
    }
    result = sums.withColumn("problems", F.expr(_problems(rules)))
    return result.selectExpr(*GAME, "size(problems) = 0 AS is_valid", "CASE WHEN shape = 'list' THEN n ELSE 0 END AS event_count", "problems")


def validate_files(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Every expected game once: absent, unreadable and bad files become invalid rows, never errors.

    ``documents`` with a column ``error``, as ``feeds.landed_files`` gives them, tell files that cannot be read from missing ones.
    """
    expected = index.select(*GAME).distinct()
    if "error" in documents.columns:
        unreadable = documents.where("error IS NOT NULL").groupBy(*GAME).agg(F.min("error").alias("error"))
        documents = documents.where("error IS NULL")
    else:
        unreadable = expected.limit(0).withColumn("error", F.lit(None).cast("string"))
    joined = expected.join(validate_feeds(documents), GAME, "left").join(unreadable, GAME, "left")
    return joined.selectExpr(
        *GAME,
        "coalesce(is_valid, false) AND error IS NULL AS is_valid",
        "coalesce(event_count, 0L) AS event_count",
        "CASE WHEN error IS NOT NULL THEN array('the file cannot be read: ' || error) ELSE coalesce(problems, array('there is no file')) END AS problems",
        "is_valid IS NULL AND error IS NULL AS is_missing",
    )


def verify_downloads(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Season coverage, worked out again from the documents; no manifest is trusted.

    ``bytes`` are those on disk where ``documents`` have the length of their file, else those of the text.
    """
    files = validate_files(index, documents)
    coverage = files.groupBy("season").agg(
        F.count(F.lit(1)).alias("expected"),
        F.expr("count_if(is_valid)").alias("verified"),
        F.expr("count_if(is_missing)").alias("missing"),
        F.expr("count_if(NOT is_valid AND NOT is_missing)").alias("invalid"),
        F.expr("sum(CASE WHEN is_valid THEN event_count ELSE 0 END)").alias("events"),
    )
    size = "length" if "length" in documents.columns else "octet_length(value)"
    sizes = documents.join(files.where("is_valid").select(*GAME), GAME, "left_semi").groupBy("season").agg(F.expr(f"sum({size})").alias("bytes"))
    wins = index.groupBy("season").agg(F.sum("home_win").alias("home_wins"), F.expr("round(avg(home_win), 6)").alias("home_win_rate"))
    return coverage.join(wins, "season").join(sizes, "season", "left").selectExpr(
        "*", "CASE WHEN verified > 0 THEN round(events / verified, 6) END AS mean_events", "missing = 0 AND invalid = 0 AS complete"
    )


# --- Game states ------------------------------------------------------------------------


def stored_disorder(states: DataFrame) -> DataFrame:
    """Per game with rows out of list order as stored: ``misplaced``, the rows whose list position is below that of the row before in their file, and ``files``.

    ``states`` have ``stored_file`` and ``stored_row``, as ``state_store.stored_places`` gives them. A game's rows may repeat a position but not go back.
    """
    before = carry_last(states.select(*GAME, IDX, "stored_file", "stored_row"), [*GAME, "stored_file"], "stored_row", {"before": IDX})
    return before.groupBy(*GAME).agg(F.expr(f"count_if({IDX} < before)").alias("misplaced"), F.countDistinct("stored_file").alias("files")).where("misplaced > 0 OR files > 1")


def verify_states(states: DataFrame, index: DataFrame) -> DataFrame:
    """One row per game of the index (and any game it does not know): problems found in its states.

    States that say where they are stored (``stored_file``, ``stored_row``) are also checked to stand in list order there.
    """
    missing = set(fv.STATE_COLUMNS) - set(states.columns)
    if missing:
        raise ValueError(f"States lack columns {sorted(missing)}")
    expected = index.selectExpr(
        *GAME, "home_team_id AS x_home", "away_team_id AS x_away", "home_pts AS x_home_pts", "away_pts AS x_away_pts", "home_win AS x_win"
    )
    # Per-row rules need the two teams; they are in the states and are compared with the index below.
    sums = states.groupBy(*GAME).agg(
        *[
            F.expr(text).alias(name)
            for name, text in {
                "states": "count(1)",
                "home_low": "min(home_team_id)",
                "home_high": "max(home_team_id)",
                "away_low": "min(away_team_id)",
                "away_high": "max(away_team_id)",
                "bad_index": f"count_if({IDX} IS NULL OR {IDX} < 0)",
                "bad_difference": "count_if(score_differential <> home_score - away_score)",
                "last_home": f"max_by(home_score, {IDX})",
                "last_away": f"max_by(away_score, {IDX})",
                "low_win": "min(home_win)",
                "high_win": "max(home_win)",
                "bad_regulation": f"count_if(period <= 4 AND seconds_remaining_regulation <> (4 - period) * {fv.PERIOD_SECONDS}D + seconds_remaining_period)",
                "bad_overtime": "count_if(period >= 5 AND seconds_remaining_regulation <> 0)",
                "bad_team": "count_if(possession_team_id NOT IN (home_team_id, away_team_id))",
                "bad_side": "count_if(possession_known = 1 AND NOT (home_possession <=> CAST(possession_team_id = home_team_id AS INT)))",
                "bad_fouls": "count_if(home_team_fouls_period < 0 OR away_team_fouls_period < 0)",
            }.items()
        ]
    )
    rules = {
        "'no states'": "states IS NULL",
        "'game is not in the index'": "x_home IS NULL",
        "'teams differ from the index'": "states IS NOT NULL AND x_home IS NOT NULL "
        "AND NOT (home_low <=> x_home AND home_high <=> x_home AND away_low <=> x_away AND away_high <=> x_away)",
        "'bad list position'": "bad_index > 0",
        "'score difference'": "bad_difference > 0",
        "'final score'": "last_home <> x_home_pts OR last_away <> x_away_pts",
        "'outcome label'": "states IS NOT NULL AND x_home IS NOT NULL AND NOT (low_win <=> x_win AND high_win <=> x_win)",
        "'regulation clock'": "bad_regulation > 0",
        "'overtime clock'": "bad_overtime > 0",
        "'possession team'": "bad_team > 0",
        "'possession side'": "bad_side > 0",
        "'negative fouls'": "bad_fouls > 0",
    }
    joined = expected.join(sums, GAME, "full_outer")
    if "stored_row" in states.columns:
        joined = joined.join(stored_disorder(states), GAME, "left")
        rules["'not stored in list order'"] = "misplaced > 0"
        rules["'stored in several files: ' || files"] = "files > 1"
    joined = joined.withColumn("problems", F.expr(_problems(rules)))
    return joined.selectExpr(*GAME, "coalesce(states, 0L) AS states", "problems", "size(problems) = 0 AS is_valid")


def verified_totals(states: DataFrame, verified: DataFrame) -> DataFrame:
    """Season totals over the games that passed; markers are those of emitted states only."""
    games = verified.groupBy("season").agg(
        F.expr("count_if(is_valid)").alias("verified"),
        F.expr("count_if(states = 0)").alias("missing"),
        F.expr("count_if(NOT is_valid AND states > 0)").alias("invalid"),
    )
    good = states.join(verified.where("is_valid").select(*GAME), GAME, "left_semi").groupBy("season").agg(
        F.count(F.lit(1)).alias("states"),
        F.sum("possession_known").alias("known"),
        F.count("foul_marker_matches").alias("markers_checked"),
        F.expr("coalesce(sum(foul_marker_matches), 0)").alias("markers_matched"),
    )
    return games.join(good, "season", "left")


# --- Data contract ----------------------------------------------------------------------


def schema_checks(actions: DataFrame) -> DataFrame:
    """One row per game with every expectation of the data contract as a boolean."""
    required = ["period", "clock", "scoreHome", "scoreAway", "actionType", "description", "teamId", "teamTricode"]
    missing = [c for c in required if c not in actions.columns]
    if missing:
        raise ValueError(f"Actions lack columns {missing}")
    rows = actions.withColumns(
        ev.exprs(
            {
                "_clock": ev.clean_text("clock"),
                "_type": f"lower({ev.clean_text('actionType')})",
                "_text": ev.clean_text("description"),
                "_team": ev.clean_text("teamTricode"),
                "_home": ev.clean_text("scoreHome"),
                "_away": ev.clean_text("scoreAway"),
            }
        )
    ).withColumns(
        ev.exprs(
            {
                "_seconds": ck.parse_clock("_clock", "quarantine"),
                "_h": "try_cast(_home AS DOUBLE)",
                "_a": "try_cast(_away AS DOUBLE)",
            }
        )
    )
    sums = rows.groupBy(*GAME).agg(
        *[
            F.expr(text).alias(name)
            for name, text in {
                "events": "count(1)",
                "id_ok": f"bool_and(game_id RLIKE r'{fv.GAME_ID_PATTERN}')",
                "no_nulls": "bool_and(period IS NOT NULL AND clock IS NOT NULL AND actionType IS NOT NULL)",
                "period_ok": "bool_and(period BETWEEN 1 AND 10) AND min(period) = 1",
                "clock_ok": "bool_and(_clock = '' OR _seconds IS NOT NULL) AND bool_or(_clock <> '')",
                "scores_ok": "bool_and((_home = '' OR _h >= 0) AND (_away = '' OR _a >= 0)) AND bool_or(_home <> '') AND bool_or(_away <> '')",
                "typed": "count_if(_type <> '')",
                "described": "count_if(_text <> '')",
                "teamed": "count_if(_team <> '')",
                # A game has two teams; a bad feed may name more, so names are counted, not collected.
                "teams": "count(DISTINCT nullif(_team, ''))",
                "core_types": "bool_or(_type = 'made shot') AND bool_or(_type = 'missed shot') AND bool_or(_type = 'rebound') AND bool_or(_type = 'turnover')",
                "has_foul": "bool_or(contains(_type, 'foul'))",
                "has_timeout": "bool_or(contains(_type, 'timeout'))",
            }.items()
        ]
    )
    return sums.selectExpr(
        *GAME,
        "events",
        "id_ok",
        "no_nulls",
        "period_ok",
        "clock_ok",
        "scores_ok",
        "typed > 0.8D * events AND core_types AS types_ok",
        "described > 0.9D * events AS descriptions_ok",
        "teamed > 0.8D * events AND teams = 2 AS teams_ok",
        "has_foul AND has_timeout AS fouls_and_timeouts_ok",
    )


def differential_check(tracked: DataFrame) -> DataFrame:
    """The running score exists at every event and its difference stays plausible."""
    return tracked.groupBy(*GAME).agg(
        F.expr("bool_and(home_score IS NOT NULL AND away_score IS NOT NULL) AND max(abs(home_score - away_score)) < 100").alias("differential_ok")
    )


def order_consistency(actions: DataFrame, threshold: float = 0.99) -> DataFrame:
    """Spearman correlation per game of action numbers with the order by period and clock.

    Both ranks are worked out in blocks: of action numbers, and of at most 4,096 list positions inside a second.
    """
    number = "CAST(actionNumber AS BIGINT)" if ev.is_whole(actions, "actionNumber") else ev.whole_number("actionNumber")
    # Rows are filtered on the raw columns: a filter on a computed one would be worked out twice.
    usable = actions.where(r"period IS NOT NULL AND actionNumber IS NOT NULL AND clock RLIKE r'^\s*PT\d+M\d+(\.\d+)?S\s*$'")
    rows = usable.withColumn("_clock", F.expr(ev.clean_text("clock"))).selectExpr(
        *GAME, IDX, "period", f"{ck.clock_seconds('_clock')} AS seconds", f"{number} AS number"
    )
    in_time = with_position(
        rows,
        GAME,
        ["period", F.desc("seconds"), IDX],
        block=F.expr(f"struct(period, -seconds AS before_end, CAST(floor({IDX} / 4096) AS BIGINT) AS block)"),
        position="place",
    )
    counted = rows.groupBy(*GAME, "number").agg(F.count(F.lit(1)).alias("ties"))
    blocks = counted.withColumn("block", F.expr("CAST(floor(number / 4096) AS BIGINT)"))
    per_block = blocks.groupBy(*GAME, "block").agg(F.sum("ties").alias("n"))
    earlier = per_block.selectExpr(
        *GAME,
        "block",
        "coalesce(sum(n) OVER (PARTITION BY season, game_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
    )
    ranks = blocks.join(earlier, [*GAME, "block"]).selectExpr(
        *GAME,
        "number",
        "before + coalesce(sum(ties) OVER (PARTITION BY season, game_id, block ORDER BY number "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (ties + 1) / 2D AS number_rank",
    )
    both = in_time.join(ranks, [*GAME, "number"])
    return both.groupBy(*GAME).agg(F.expr("corr(number_rank, CAST(place AS DOUBLE))").alias("correlation")).selectExpr(
        *GAME, "correlation", f"coalesce(correlation > {threshold}D, false) AS consistent"
    )

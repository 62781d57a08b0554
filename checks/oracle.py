"""Comparison statements for DuckDB, one per query that SQL can express."""

from __future__ import annotations

from checks import sql_base as sb
from checks.sql_base import with_

ORACLE: dict[str, str] = {}

ORACLE["game_states"] = with_(sb.STATES, "SELECT * FROM states")
ORACLE["game_states_chunked"] = ORACLE["game_states"]

ROW = "season, game_id, source_event_index"
NORM = f"{sb.ACTIONS}, {sb.normalized()}"


def acts(key: str, columns: str) -> None:
    ORACLE[key] = with_(NORM, f"SELECT {ROW}, {columns} FROM norm")


def trk(key: str, columns: str) -> None:
    ORACLE[key] = with_(sb.TRACKED, f"SELECT {ROW}, {columns} FROM trk")


def states(key: str, select: str) -> None:
    ORACLE[key] = with_(sb.STATES, select)


# --- Column expressions -----------------------------------------------------------------

acts("clean_text", "action_type AS type_text, clock_text, sh AS home_text")
acts(
    "normalize_team_id",
    "team_id, TRY_CAST(NULLIF(substr(teamTricode, 2), '') AS BIGINT) AS from_tricode, "
    "CASE WHEN sh NOT LIKE '%.%' AND TRY_CAST(sh AS BIGINT) > 0 THEN TRY_CAST(sh AS BIGINT) END AS from_score",
)
acts("event_category", "category")
acts("ft_made", "is_made")
acts("ft_sequence", "ft_attempt AS attempt, ft_total AS total, is_special_ft AS is_special")
acts("foul_counts", "foul_counts AS counts")
acts("foul_marker", "TRY_CAST(regexp_extract(upper(event_text), '\\.T(\\d+)\\)', 1) AS INT) AS marker")
acts("score_authoritative", "authoritative")
acts("parse_clock", "seconds")
acts("parse_score", "hv AS home, av AS away")
acts("regulation_seconds", "CASE WHEN period <= 4 THEN (4 - period) * 720 + seconds ELSE CAST(0 AS DOUBLE) END AS left_in_game")
acts("overtime_cols", "CASE WHEN period > 4 THEN 1 ELSE 0 END AS is_overtime, CASE WHEN period > 4 THEN period - 4 ELSE 0 END AS overtime_number")
acts("period_label", "CASE period - 1 WHEN 0 THEN 'Pregame' WHEN 1 THEN 'Q1' WHEN 2 THEN 'Q2' WHEN 3 THEN 'Q3' WHEN 4 THEN 'Q4' WHEN 5 THEN 'OT1' END AS label")
acts("period_bucket", "CASE period WHEN 1 THEN 'Q1' WHEN 2 THEN 'Q2' WHEN 3 THEN 'Q3' WHEN 4 THEN 'Q4' ELSE 'OT' END AS bucket")
acts("elapsed_seconds", "CASE WHEN period <= 4 THEN period * 720 - seconds ELSE 2880 + (period - 4) * 300 - seconds END AS elapsed")
acts(
    "normalize_events",
    "action_type, sub_type, category, team_id, event_text AS description, is_made, ft_attempt, ft_total, is_special_ft",
)

TIME_BIN = (
    "CASE WHEN seconds_remaining_regulation > 2160 THEN '>36m' WHEN seconds_remaining_regulation > 1440 THEN '24-36m' "
    "WHEN seconds_remaining_regulation > 720 THEN '12-24m' WHEN seconds_remaining_regulation > 360 THEN '6-12m' "
    "WHEN seconds_remaining_regulation > 120 THEN '2-6m' ELSE '0-2m' END"
)
SCORE_BIN = (
    "CASE WHEN abs(score_differential) > 20 THEN '20+' WHEN abs(score_differential) > 10 THEN '11-20' "
    "WHEN abs(score_differential) > 5 THEN '6-10' WHEN abs(score_differential) > 2 THEN '3-5' ELSE '0-2' END"
)
PERIOD_BUCKET = "CASE WHEN period > 4 THEN 'OT' ELSE 'Q' || CAST(period AS VARCHAR) END"
states("time_bin", f"SELECT {ROW}, {TIME_BIN} AS bin FROM states")
states("score_bin", f"SELECT {ROW}, {SCORE_BIN} AS bin FROM states")
states(
    "sigmoid_clip",
    f"SELECT {ROW}, round(1.0 / (1.0 + exp(-CAST(CASE WHEN score_differential * 3 > 50 THEN 50 WHEN score_differential * 3 < -50 "
    "THEN -50 ELSE score_differential * 3 END AS DOUBLE))), 9) AS probability FROM states",
)

# --- Game-state reconstruction ----------------------------------------------------------

ORACLE["period_segments"] = with_(
    sb.TRACKED,
    f"SELECT {ROW}, period, changed AS segment_starts, CAST(sum(CAST(changed AS INT)) OVER (PARTITION BY season, game_id "
    "ORDER BY source_event_index) AS INT) AS segment FROM (SELECT *, coalesce(lag(period) OVER (PARTITION BY season, game_id "
    "ORDER BY source_event_index) <> period, true) AS changed FROM trk)",
)
trk("out_of_order_snapshots", "coalesce(late, false) AS out_of_order")
trk("running_score", "home_score, away_score")
ORACLE["pending_miss"] = with_(
    sb.TRACKED,
    f"SELECT {ROW}, CASE WHEN lag(period) OVER w = period THEN lag(pending_after) OVER w END AS pending_team FROM trk "
    "WINDOW w AS (PARTITION BY season, game_id ORDER BY source_event_index)",
)
trk("possession_states", "possession_team_id, possession_reason")
trk("team_fouls", "home_fouls, away_fouls")
trk("foul_marker_check", "marker, marker_reconstructed, marker_matches")
trk("visible_states", "emitted")

GAME_RESULTS = """SELECT season, game_id, count(*) AS raw_events, count(*) FILTER (emitted) AS emitted_states,
    count(*) FILTER (emitted AND possession_team_id IS NOT NULL) AS known_possession_states,
    count(*) FILTER (emitted AND possession_team_id IS NULL) AS unknown_possession_states,
    arg_max(home_score, source_event_index) AS final_home_score, arg_max(away_score, source_event_index) AS final_away_score,
    any_value(home_pts) AS expected_home_score, any_value(away_pts) AS expected_away_score,
    count(marker_matches) AS foul_markers_checked, CAST(coalesce(sum(marker_matches), 0) AS BIGINT) AS foul_markers_matched,
    arg_max(home_score, source_event_index) = any_value(home_pts)
        AND arg_max(away_score, source_event_index) = any_value(away_pts) AS final_score_matches
    FROM trk GROUP BY season, game_id"""
ORACLE["game_results"] = with_(sb.TRACKED, GAME_RESULTS)
ORACLE["marker_discrepancies"] = with_(
    sb.TRACKED,
    "SELECT season, game_id, source_event_index, actionNumber AS action_number, period, clock_text AS clock, team_id, sub_type, "
    "event_text AS description, marker, marker_reconstructed AS reconstructed FROM trk WHERE marker_matches = 0 "
    "QUALIFY row_number() OVER (PARTITION BY season ORDER BY game_id, source_event_index) <= 100",
)
states("possession_reasons", "SELECT season, possession_reason, count(*) AS states FROM states GROUP BY ALL")
ORACLE["season_results"] = with_(
    f"{sb.TRACKED}, res AS ({GAME_RESULTS}), tot AS (SELECT season, count(*) AS games_processed, sum(raw_events)::BIGINT AS raw_events, "
    "sum(emitted_states)::BIGINT AS emitted_states, sum(known_possession_states)::BIGINT AS known_possession_states, "
    "sum(unknown_possession_states)::BIGINT AS unknown_possession_states, count(*) FILTER (final_score_matches) AS final_scores_valid, "
    "sum(foul_markers_checked)::BIGINT AS foul_markers_checked, sum(foul_markers_matched)::BIGINT AS foul_markers_matched "
    "FROM res GROUP BY season)",
    "SELECT *, (SELECT count(DISTINCT game_id) FROM idx WHERE idx.season = tot.season) AS expected_games, "
    "round(100.0::DOUBLE * known_possession_states / emitted_states, 6) AS known_possession_percent, "
    "round(100.0::DOUBLE * unknown_possession_states / emitted_states, 6) AS unknown_possession_percent, "
    "round(100.0::DOUBLE * final_scores_valid / games_processed, 6) AS final_score_validation_percent, "
    "CASE WHEN foul_markers_checked > 0 THEN round(100.0::DOUBLE * foul_markers_matched / foul_markers_checked, 6) "
    "ELSE 0::DOUBLE END AS foul_marker_match_percent FROM tot",
)

# --- Joins, sets, look-ups --------------------------------------------------------------

ORACLE["game_index"] = with_(sb.INDEX, "SELECT * RENAME (game_id AS GAME_ID) FROM idx")
ORACLE["unique_games"] = with_(sb.GAME_LOG, "SELECT DISTINCT GAME_ID FROM game_log")
states("states_with_labels", f"SELECT {ROW}, home_team_id, away_team_id, home_win FROM states")
states(
    "missing_games",
    "SELECT season, game_id FROM idx WHERE CAST(game_id AS BIGINT) % 16 = 13",
)

# --- Aggregations and profiles ----------------------------------------------------------

LABELLED = (
    f"{NORM}, lab AS (SELECT *, coalesce(nullif(lower(action_type), ''), '<blank>') AS type_label, "
    "coalesce(nullif(lower(sub_type), ''), '<blank>') AS subtype_label, "
    "TRY_CAST(regexp_extract(upper(event_text), '\\.T(\\d+)\\)', 1) AS INT) AS mark FROM norm)"
)


def lab(key: str, select: str) -> None:
    ORACLE[key] = with_(LABELLED, select)


lab(
    "event_inventory",
    "SELECT season, 'games' AS measure, '' AS label, count(DISTINCT game_id) AS n FROM lab GROUP BY season "
    "UNION ALL SELECT season, 'events', '', count(*) FROM lab GROUP BY season "
    "UNION ALL SELECT season, 'action type', type_label, count(*) FROM lab GROUP BY season, type_label "
    "UNION ALL SELECT season, 'period', CAST(period AS VARCHAR), count(*) FROM lab GROUP BY season, period",
)
lab("subtype_counts", "SELECT season, type_label, subtype_label, count(*) AS n FROM lab GROUP BY ALL")
lab(
    "blank_descriptions_top30",
    "SELECT *, row_number() OVER (PARTITION BY season ORDER BY n DESC, description_text) AS place FROM (SELECT season, "
    "event_text AS description_text, count(*) AS n FROM lab WHERE type_label = '<blank>' GROUP BY ALL) QUALIFY place <= 30",
)
lab("foul_marker_hist", "SELECT season, mark AS marker, count(*) AS n FROM lab WHERE type_label LIKE '%foul%' AND mark IS NOT NULL GROUP BY ALL")
lab(
    "foul_marker_coverage",
    "SELECT season, subtype_label, count(mark) AS with_marker, count(*) - count(mark) AS without_marker "
    "FROM lab WHERE type_label LIKE '%foul%' GROUP BY ALL",
)
lab(
    "foul_rule_comparison",
    f"SELECT season, rule, CASE WHEN mark = seen THEN 'match' ELSE 'mismatch' END AS label, count(*) AS n FROM ("
    f"SELECT f.season, r.rule, f.mark, (SELECT count(*) FROM lab g WHERE g.season = f.season AND g.game_id = f.game_id "
    f"AND g.period = f.period AND g.teamId = f.teamId AND g.source_event_index <= f.source_event_index "
    f"AND g.type_label LIKE '%foul%' AND g.subtype_label NOT IN ({sb._NEUTRAL}) "
    "AND (r.rule = 'exclude_technical' OR g.subtype_label NOT IN ('offensive', 'offensive charge'))) AS seen "
    "FROM lab f CROSS JOIN (VALUES ('exclude_technical'), ('exclude_technical_and_offensive')) r(rule) "
    "WHERE f.type_label LIKE '%foul%' AND f.teamId > 0 AND f.mark IS NOT NULL) GROUP BY ALL",
)
lab(
    "foul_mismatches",
    "SELECT season, 'foul_mismatch:' || rule AS example, CAST(row_number() OVER (PARTITION BY season, rule ORDER BY game_id, source_event_index) AS INT) AS place, game_id, source_event_index, "
    "actionNumber AS action_number, period, teamId AS team_id, teamTricode AS tricode, trim(subType) AS subtype, seen AS expected, mark AS observed FROM ("
    "SELECT f.*, r.rule, (SELECT count(*) FROM lab g WHERE g.season = f.season AND g.game_id = f.game_id "
    "AND g.period = f.period AND g.teamId = f.teamId AND g.source_event_index <= f.source_event_index "
    f"AND g.type_label LIKE '%foul%' AND g.subtype_label NOT IN ({sb._NEUTRAL}) "
    "AND (r.rule = 'exclude_technical' OR g.subtype_label NOT IN ('offensive', 'offensive charge'))) AS seen "
    "FROM lab f CROSS JOIN (VALUES ('exclude_technical'), ('exclude_technical_and_offensive')) r(rule) "
    "WHERE f.type_label LIKE '%foul%' AND f.teamId > 0 AND f.mark IS NOT NULL) WHERE mark <> seen QUALIFY place <= 8",
)
ORACLE["missing_feeds"] = with_(
    sb.INDEX,
    "SELECT season, count(DISTINCT game_id) AS listed, count(DISTINCT game_id) FILTER (CAST(game_id AS BIGINT) % 4 <> 1) AS with_feed, "
    "count(DISTINCT game_id) FILTER (CAST(game_id AS BIGINT) % 4 = 1) AS missing FROM idx GROUP BY season",
)
lab(
    "timeout_attribution",
    "SELECT season, 'teamId' AS field, coalesce(CAST(teamId AS VARCHAR), '<blank>') AS label, count(*) AS n FROM lab "
    "WHERE type_label LIKE '%timeout%' GROUP BY ALL UNION ALL SELECT season, 'teamTricode', coalesce(nullif(teamTricode, ''), '<blank>'), "
    "count(*) FROM lab WHERE type_label LIKE '%timeout%' GROUP BY ALL",
)
lab(
    "category_examples",
    "SELECT season, example, row_number() OVER (PARTITION BY season, example ORDER BY game_id, source_event_index) AS place, game_id, "
    "source_event_index, actionNumber AS action_number, period, clock, teamId AS team_id, teamTricode AS tricode, action_type, sub_type AS subtype, "
    "event_text AS description FROM (SELECT *, 'blank_action_type' AS example FROM lab WHERE type_label = '<blank>' "
    "UNION ALL SELECT *, 'foul:' || subtype_label FROM lab WHERE type_label LIKE '%foul%' "
    "UNION ALL SELECT *, 'free_throw:' || subtype_label FROM lab WHERE type_label LIKE '%free throw%' "
    "UNION ALL SELECT *, 'rebound:' || subtype_label FROM lab WHERE type_label LIKE '%rebound%' "
    "UNION ALL SELECT *, 'jump_ball' FROM lab WHERE type_label LIKE '%jump ball%' "
    "UNION ALL SELECT *, 'timeout:' || subtype_label FROM lab WHERE type_label LIKE '%timeout%') QUALIFY place <= 8",
)
ORACLE["profile_fields"] = with_(
    NORM,
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) AS row_count, count(*) FILTER ({sb.trim(c)} = '') AS blanks, "
        f"count(DISTINCT nullif({sb.trim(c)}, '')) AS distinct_values FROM norm"
        for c in ("clock", "scoreHome", "actionType", "subType", "teamTricode", "description")
    ),
)
ORACLE["value_counts"] = with_(NORM, f"SELECT {sb.trim('subType')} AS value, count(*) AS n FROM norm GROUP BY ALL")
ORACLE["home_win_rate"] = with_(
    sb.INDEX, "SELECT season, sum(home_win)::BIGINT AS home_wins, round(avg(home_win), 6) AS home_win_rate FROM idx GROUP BY season"
)
states(
    "dataset_summary",
    "SELECT season, count(*) AS row_count, count(DISTINCT game_id) AS games, round(avg(home_win), 6) AS row_home_win_rate, "
    "(SELECT round(avg(w), 6) FROM (SELECT game_id, max(home_win) AS w FROM states b WHERE b.season = a.season GROUP BY game_id)) AS game_home_win_rate, "
    "round(avg(possession_known), 6) AS possession_known_rate, round(count(*) / count(DISTINCT game_id), 6) AS mean_states_per_game "
    "FROM states a GROUP BY season",
)
# The model inputs of the contract.
FEATURES = [
    "score_differential",
    "period",
    "seconds_remaining_period",
    "seconds_remaining_regulation",
    "is_overtime",
    "overtime_number",
    "home_possession",
    "possession_known",
    "home_team_fouls_period",
    "away_team_fouls_period",
]
states(
    "feature_ranges",
    " UNION ALL ".join(
        f"SELECT season, '{c}' AS feature, count(*) - count({c}) AS missing, CAST(min({c}) AS DOUBLE) AS minimum, "
        f"CAST(max({c}) AS DOUBLE) AS maximum FROM states GROUP BY season"
        for c in FEATURES
    ),
)
states(
    "states_per_game_dist",
    "SELECT season, min(n) AS minimum, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, "
    "round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS maximum FROM (SELECT season, game_id, count(*) AS n FROM states GROUP BY ALL) GROUP BY season",
)
states("states_by_period", "SELECT season, period, count(*) AS n FROM states GROUP BY ALL")


def histogram(key: str, label: str, bins: list[str]) -> None:
    values = ", ".join(f"({i}, '{b}')" for i, b in enumerate(bins))
    states(
        key,
        f"SELECT s.season, b.bin, b.label, (SELECT count(*) FROM states x WHERE x.season = s.season AND {label} = b.label) AS n "
        f"FROM (SELECT DISTINCT season FROM states) s CROSS JOIN (VALUES {values}) b(bin, label)",
    )


TIME_LABELS = ["0-2m", "2-6m", "6-12m", "12-24m", "24-36m", ">36m"]
SCORE_LABELS = ["0-2", "3-5", "6-10", "11-20", "20+"]
histogram("states_by_time_bin", TIME_BIN, TIME_LABELS)
histogram("states_by_score_bin", SCORE_BIN, SCORE_LABELS)

# --- Modelling sets ---------------------------------------------------------------------

states("filter_known_possession", f"SELECT {ROW}, possession_team_id FROM states WHERE possession_team_id IS NOT NULL")
states("select_games", "SELECT DISTINCT game_id FROM states WHERE period > 4 ORDER BY game_id LIMIT 40")
states("make_split", f"SELECT {ROW}, score_differential, home_win FROM states WHERE season = '2022-23'")
states(
    "assert_isolated_splits",
    "SELECT 'wrong season' AS problem, 'test holds 2021-22' AS detail FROM states WHERE season = '2021-22' AND period > 4 HAVING count(*) > 0 "
    "UNION ALL SELECT DISTINCT 'shared game', game_id || ' in test, train' FROM states WHERE season = '2021-22' AND period > 4",
)
states(
    "assert_no_target_leak",
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS filled, {'false' if c == 'home_win' else 'true'} AS is_input FROM states"
        for c in (*FEATURES, "home_win")
    ),
)
states("features_and_target", f"SELECT {ROW}, {', '.join(FEATURES)}, home_win FROM states WHERE possession_known = 1")
INPUTS = ", ".join(
    f"CAST(coalesce({c}, 0.5) AS DOUBLE) AS {c}" if c == "home_possession" else f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES
)
states("model_input", f"SELECT {ROW}, {INPUTS} FROM states")
states(
    "assert_finite",
    " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS row_count, 0::BIGINT AS nulls, 0::BIGINT AS not_finite FROM states" for c in (*FEATURES, "probability"))
    + " UNION ALL SELECT 'home_possession', count(*), count(*) - count(home_possession), 0 FROM states",
)
states(
    "game_balanced_weights",
    f"SELECT {ROW}, round((1.0::DOUBLE / count(*) OVER (PARTITION BY season, game_id)) / (SELECT sum(1.0::DOUBLE / n) / sum(1) FROM "
    "(SELECT count(*) OVER (PARTITION BY season, game_id) AS n FROM states)), 9) AS weight FROM states",
)
ELAPSED = "CASE WHEN period <= 4 THEN period * 720 - seconds_remaining_period ELSE 2880 + (period - 4) * 300 - seconds_remaining_period END"
states(
    "time_bucket_sample",
    f"SELECT {ROW}, CAST(floor({ELAPSED} / 30) AS INT) AS time_bucket, home_score, away_score, period FROM states QUALIFY row_number() OVER "
    f"(PARTITION BY season, game_id, floor({ELAPSED} / 30) ORDER BY source_event_index DESC) = 1",
)

# --- Live feeds -------------------------------------------------------------------------


def live(key: str, columns: str) -> None:
    ORACLE[key] = with_(sb.LIVE, f"SELECT game_id, source_index, {columns} FROM live")


live("live_canonical_type", f"{sb.LIVE_TYPE} AS action_type")
live("live_foul_subtype", f"{sb.LIVE_FOUL} AS sub_type")
live("live_ft_subtype", f"{sb.LIVE_FT} AS sub_type")
live("adapt_live", sb.ADAPTED)
ORACLE["dedupe_live"] = with_(
    sb.LIVE_DEDUPED, "SELECT game_id, source_index, orderNumber, actionNumber, scoreHome, description FROM live_one"
)
ORACLE["live_order"] = with_(
    sb.LIVE,
    f"SELECT game_id, source_index, {sb._PLACE} AS source_event_index, CAST(count(*) OVER (PARTITION BY game_id) AS INT) AS n_events, "
    "orderNumber FROM live",
)
ORACLE["live_states"] = with_(sb.LIVE_STATES, "SELECT * FROM live_states")

# --- Parity -----------------------------------------------------------------------------

PARITY = (
    "period clock home_score away_score score_differential seconds_remaining_period seconds_remaining_regulation is_overtime "
    "overtime_number home_team_fouls_period away_team_fouls_period possession_team_id possession_known"
).split()
ALIGNED = (
    f"{sb.BOTH_STATES}, hl AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY game_id, action_number ORDER BY source_event_index DESC) = 1), "
    "ll AS (SELECT * FROM live_states QUALIFY row_number() OVER (PARTITION BY game_id, action_number ORDER BY source_event_index DESC) = 1)"
)
FIELD_PARITY = " UNION ALL ".join(
    f"SELECT hl.game_id, '{c}' AS field, count(*) FILTER (hl.{c} IS NOT DISTINCT FROM ll.{c}) AS matches, count(*) AS compared, "
    f"round(100.0::DOUBLE * count(*) FILTER (hl.{c} IS NOT DISTINCT FROM ll.{c}) / count(*), 6) AS percent "
    "FROM hl JOIN ll ON hl.game_id = ll.game_id AND hl.action_number IS NOT DISTINCT FROM ll.action_number GROUP BY hl.game_id"
    for c in PARITY
)
ORACLE["parity_fields"] = with_(ALIGNED, FIELD_PARITY)
ANCHORS = (
    "SELECT g.game_id, (SELECT count(*) FROM (SELECT DISTINCT period, clock, home_score, away_score FROM states s WHERE s.game_id = g.game_id)) AS historical_anchors, "
    "(SELECT count(*) FROM (SELECT DISTINCT period, clock, home_score, away_score FROM live_states s WHERE s.game_id = g.game_id)) AS live_anchors, "
    "(SELECT count(*) FROM (SELECT period, clock, home_score, away_score FROM states s WHERE s.game_id = g.game_id INTERSECT "
    "SELECT period, clock, home_score, away_score FROM live_states s WHERE s.game_id = g.game_id)) AS anchor_matches "
    "FROM (SELECT DISTINCT game_id FROM states) g"
)
ORACLE["parity_anchors"] = with_(sb.BOTH_STATES, ANCHORS)
ORACLE["parity_report"] = with_(
    f"{ALIGNED}, fp AS ({FIELD_PARITY}), an AS ({ANCHORS}), "
    "he AS (SELECT game_id, count(*) AS historical_states, arg_max(home_score, source_event_index) AS historical_home, "
    "arg_max(away_score, source_event_index) AS historical_away FROM states GROUP BY game_id), "
    "le AS (SELECT game_id, count(*) AS live_states, arg_max(home_score, source_event_index) AS live_home, "
    "arg_max(away_score, source_event_index) AS live_away FROM live_states GROUP BY game_id)",
    "SELECT he.*, le.* EXCLUDE (game_id), an.* EXCLUDE (game_id), fp.compared AS aligned_states, fp.percent AS possession_percent "
    "FROM he JOIN le USING (game_id) JOIN an USING (game_id) JOIN fp USING (game_id) WHERE fp.field = 'possession_team_id'",
)
states("union_seasons", f"SELECT {ROW}, home_score FROM states")

# --- Samples, top-k, trajectories -------------------------------------------------------

states(
    "latest_state",
    "SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY season, game_id ORDER BY source_event_index DESC) = 1",
)
PLACED = (
    "SELECT *, row_number() OVER (PARTITION BY season, game_id ORDER BY source_event_index) - 1 AS place, "
    "count(*) OVER (PARTITION BY season, game_id) AS game_states FROM "
)
states(
    "replay_sample",
    f"SELECT {ROW}, place, game_states FROM ({PLACED} states) WHERE place % greatest(1, game_states // 15) = 0 OR place = game_states - 1",
)
CHOSEN = (
    "gm AS (SELECT season, game_id, abs(arg_max(score_differential, source_event_index)) AS margin, max(period) AS last_period, "
    "CASE WHEN max(home_win) = 1 THEN -min(score_differential) ELSE max(score_differential) END AS comeback FROM states GROUP BY season, game_id), "
    "chosen AS (SELECT season, 'close' AS category, game_id FROM gm QUALIFY row_number() OVER (PARTITION BY season ORDER BY margin, game_id) = 1 "
    "UNION ALL SELECT season, 'comeback', game_id FROM gm QUALIFY row_number() OVER (PARTITION BY season ORDER BY comeback DESC, game_id) = 1 "
    "UNION ALL SELECT season, 'blowout', game_id FROM gm QUALIFY row_number() OVER (PARTITION BY season ORDER BY margin DESC, game_id) = 1 "
    "UNION ALL SELECT season, 'overtime', min(game_id) FROM gm WHERE last_period > 4 GROUP BY season)"
)
ORACLE["select_trajectory_games"] = with_(f"{sb.STATES}, {CHOSEN}", "SELECT * FROM chosen")
ORACLE["trajectory_samples"] = with_(
    f"{sb.SCORED}, {CHOSEN}, pl AS ({PLACED} scored), ks AS (SELECT DISTINCT season, game_id, "
    "CASE WHEN game_states = 1 THEN 0 ELSE k * (game_states - 1) // (least(20, game_states) - 1) END AS place "
    "FROM (SELECT DISTINCT season, game_id, game_states FROM pl) CROSS JOIN range(20) r(k) WHERE k < least(20, game_states))",
    "SELECT season, game_id, category, place, period, clock, home_score || '-' || away_score AS score, score_differential, "
    "CASE WHEN possession_known = 0 THEN 'unknown' WHEN home_possession = 1 THEN 'home' ELSE 'away' END AS possession, probability "
    "FROM chosen JOIN pl USING (season, game_id) JOIN ks USING (season, game_id, place)",
)
ORACLE["stratified_fixture"] = with_(
    f"{sb.ACTIONS}, typed AS (SELECT *, lower({sb.trim('actionType')}) AS category FROM acts), "
    "cats AS (SELECT * FROM (VALUES (1, 'period'), (2, 'jump ball'), (3, 'made shot'), (4, 'missed shot'), (5, 'rebound'), "
    "(6, 'free throw'), (7, 'foul'), (8, 'turnover'), (9, 'timeout')) c(turn, category)), "
    "added AS (SELECT 0 AS turn, * FROM typed WHERE source_event_index < 60 UNION ALL SELECT 0, * FROM typed WHERE source_event_index >= n_events - 20 "
    "UNION ALL SELECT c.turn, t.* FROM typed t JOIN cats c USING (category) "
    "QUALIFY row_number() OVER (PARTITION BY season, game_id, category ORDER BY source_event_index) <= 4)",
    f"SELECT {ROW}, actionNumber, actionType FROM added QUALIFY row_number() OVER "
    "(PARTITION BY season, game_id, actionNumber ORDER BY turn DESC, source_event_index DESC) = 1",
)
LABEL = "CASE WHEN period <= 0 THEN 'Pregame' WHEN period <= 4 THEN 'Q' || period ELSE 'OT' || (period - 4) END"
ORACLE["probability_history"] = with_(
    sb.SCORED,
    f"SELECT season, game_id, source_event_index AS sequence, period, {LABEL} AS period_label, clock, probability AS home_probability FROM scored "
    "QUALIFY row_number() OVER (PARTITION BY season, game_id ORDER BY source_event_index DESC) <= 240",
)
states(
    "recent_events",
    "SELECT season, game_id, source_event_index AS sequence, period, clock, CASE WHEN description <> '' THEN description "
    "WHEN semantic_event <> '' THEN semantic_event ELSE 'Game update' END AS description, semantic_event, home_score, away_score FROM states "
    "QUALIFY row_number() OVER (PARTITION BY season, game_id ORDER BY source_event_index DESC) <= 12",
)

# --- Scoreboards ------------------------------------------------------------------------

BOARD_GAMES = (
    f"SELECT game_date, game_id, game_status, CASE game_status WHEN 1 THEN 'scheduled' WHEN 2 THEN 'active' WHEN 3 THEN 'final' END AS phase, "
    f"{sb.trim('status_text')} AS status_text, coalesce(CAST(period AS INT), 0) AS period, {sb.trim('clock')} AS clock, home_team_id, "
    f"{sb.trim('home_name')} AS home_name, '' AS home_city, {sb.trim('home_tricode')} AS home_tricode, TRY_CAST(home_score AS INT) AS home_score, "
    f"away_team_id, {sb.trim('away_name')} AS away_name, '' AS away_city, away_tricode, CAST(away_score AS INT) AS away_score FROM board"
)
ORACLE["read_scoreboard"] = with_(sb.BOARD, BOARD_GAMES)
ORACLE["read_game_details"] = with_(
    sb.BOARD,
    "SELECT game_id, game_status, CASE game_status WHEN 1 THEN 'scheduled' WHEN 2 THEN 'active' WHEN 3 THEN 'final' END AS phase, "
    "0 AS period, home_team_id, TRY_CAST(home_score AS INT) AS home_score, CAST(NULL AS BIGINT) AS away_team_id, '' AS away_name FROM board",
)
SHOWN = "CASE WHEN b.game_status = 3 AND b.home_score IS NOT NULL AND b.away_score IS NOT NULL THEN CAST(b.home_score > b.away_score AS INT)::DOUBLE ELSE s.probability END"
ORACLE["display_probability"] = with_(
    f"{sb.SCORED_AND_BOARD}, games AS ({BOARD_GAMES})",
    f"SELECT s.season, s.game_id, s.source_event_index, {SHOWN} AS home_probability, 1 - ({SHOWN}) AS away_probability, "
    "coalesce(b.game_status = 3 AND b.home_score IS NOT NULL AND b.away_score IS NOT NULL, false) AS overridden "
    "FROM scored s JOIN games b USING (game_id)",
)
ORACLE["possession_label"] = with_(
    f"{sb.STATES_AND_BOARD}, games AS ({BOARD_GAMES})",
    "SELECT s.season, s.game_id, s.source_event_index, CASE s.possession_team_id WHEN s.home_team_id THEN coalesce(nullif(home_tricode, ''), home_name) "
    "WHEN s.away_team_id THEN away_tricode ELSE 'Unknown' END AS label FROM states s JOIN games b USING (game_id)",
)

# --- Probability evaluation -------------------------------------------------------------

EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def bin_of(edges: list[float]) -> str:
    branches = " ".join(f"WHEN p >= {edge!r}::DOUBLE THEN {i}" for i, edge in reversed(list(enumerate(edges[:-1]))))
    return f"CASE {branches} ELSE 0 END"


def metrics(source: str, by: str, edges: list[float] = EDGES) -> str:
    """Row-level metrics of a relation with columns y, p and the group columns ``by``."""
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    also = f", {by}" if by else ""
    on = " AND ".join(f"{{0}}.{c.strip()} = {{1}}.{c.strip()}" for c in by.split(",")) if by else "true"
    return (
        f"SELECT a.*, round(e.ece, 9) AS ece FROM (SELECT {by + ', ' if by else ''} count(*) AS row_count, "
        "round(avg((p - y) * (p - y)), 9) AS brier, "
        "round(avg(-ln(CASE WHEN y = 1 THEN greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) ELSE 1 - greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) END)), 9) AS log_loss, "
        "round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END), 9) AS accuracy, "
        "round((sum(CASE WHEN y = 1 THEN r END) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / nullif(sum(y)::DOUBLE * (count(*) - sum(y)), 0), 9) AS roc_auc "
        f"FROM (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''} p) - 1) / 2.0 AS r FROM ({source})) {group}) a "
        f"JOIN (SELECT sum(n * abs(mp - my)) / sum(n) AS ece{also} FROM (SELECT count(*) AS n, avg(p) AS mp, avg(y) AS my{also} "
        f"FROM ({source}) GROUP BY {bin_of(edges)}{also}) {group}) e ON {on.format('a', 'e')}"
    )


def scored(key: str, select: str) -> None:
    ORACLE[key] = with_(sb.SCORED, select)


scored("probability_metrics", metrics("SELECT season, home_win AS y, probability AS p FROM scored", "season"))
BINS = (
    "SELECT g.season, b.bin, b.lower, b.upper, count(s.p) AS count, round(coalesce(avg(s.p), 0), 9) AS mean_predicted, "
    "round(coalesce(avg(s.y), 0), 9) AS observed_rate, round(coalesce(abs(avg(s.p) - avg(s.y)), 0), 9) AS absolute_gap "
    "FROM (SELECT DISTINCT season FROM scored) g CROSS JOIN (VALUES "
    + ", ".join(f"({i}, {EDGES[i]!r}::DOUBLE, {EDGES[i + 1]!r}::DOUBLE)" for i in range(10))
    + ") b(bin, lower, upper) LEFT JOIN (SELECT season, probability AS p, home_win AS y FROM scored) s ON s.season = g.season "
    "AND s.p >= b.lower AND (s.p < b.upper OR b.bin = 9) GROUP BY ALL"
)
scored("calibration_bins", BINS)
SEVEN = [i * (1.0 / 7) for i in range(7)] + [1.0]
scored(
    "ece",
    f"SELECT season, round(sum(n * abs(mp - my)) / sum(n), 9) AS ece FROM (SELECT season, count(*) AS n, avg(p) AS mp, avg(y) AS my "
    f"FROM (SELECT season, home_win AS y, probability AS p FROM scored) GROUP BY season, {bin_of(SEVEN)}) GROUP BY season",
)
SLICED = (
    f"SELECT 'period' AS dimension, {PERIOD_BUCKET} AS label, home_win AS y, probability AS p FROM scored "
    f"UNION ALL SELECT 'time_remaining', {TIME_BIN}, home_win, probability FROM scored "
    f"UNION ALL SELECT 'absolute_score_differential', {SCORE_BIN}, home_win, probability FROM scored"
)
scored("slice_metrics", f"SELECT * FROM ({metrics(SLICED, 'dimension, label')}) WHERE roc_auc IS NOT NULL")
RATE = "(SELECT avg(home_win) FROM states WHERE season = '2021-22')"
MODELS = (
    "SELECT 'sharp' AS model, home_win AS y, probability AS p FROM scored WHERE season = '2022-23' "
    "UNION ALL SELECT 'blunt', home_win, (probability + 1.5) / 4 FROM scored WHERE season = '2022-23' "
    f"UNION ALL SELECT 'constant', home_win, {RATE} FROM scored WHERE season = '2022-23'"
)
scored("compare_models", metrics(MODELS, "model"))
scored("select_model", f"SELECT * FROM ({metrics(MODELS, 'model')}) ORDER BY brier, log_loss LIMIT 1")
_CALIBRATION = metrics(
    "SELECT 'raw' AS model, home_win AS y, probability AS p FROM scored WHERE season = '2022-23' "
    "UNION ALL SELECT 'calibrated', home_win, (probability + 0.5) / 2 FROM scored WHERE season = '2022-23'",
    "model",
)
scored(
    "should_calibrate",
    "SELECT r.brier AS raw_brier, r.log_loss AS raw_log_loss, c.brier AS calibrated_brier, c.log_loss AS calibrated_log_loss, "
    f"c.brier < r.brier AND c.log_loss < r.log_loss AS calibrate FROM ({_CALIBRATION}) r JOIN ({_CALIBRATION}) c ON r.model = 'raw' AND c.model = 'calibrated'",
)
scored("constant_baseline", metrics(f"SELECT home_win AS y, {RATE} AS p FROM scored WHERE season = '2022-23'", ""))

# --- Models -----------------------------------------------------------------------------

SCALED_FEATURES = [c for c in FEATURES if c not in ("home_possession", "is_overtime", "possession_known")]
SCALER = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(coalesce(nullif(stddev_pop({c}), 0), 1), 6) AS scale "
    "FROM states WHERE season = '2021-22'"
    for c in SCALED_FEATURES
)
states("fit_scaler", SCALER)
states("load_save_preprocessor", f"SELECT '2021-22' AS fitted_season, 1 AS version, * FROM ({SCALER})")
STATS = "(SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in SCALED_FEATURES
) + " FROM states WHERE season = '2021-22')"


def scaled_value(c: str) -> str:
    if c == "home_possession":
        return "coalesce(CAST(home_possession AS DOUBLE), 0.5)"
    return f"({c} - m_{c}) / s_{c}" if c in SCALED_FEATURES else f"CAST({c} AS DOUBLE)"


SCALED = f"SELECT {ROW}, home_win, {', '.join(f'{scaled_value(c)} AS {c}' for c in FEATURES)} FROM states CROSS JOIN {STATS}"
states("apply_scaler", f"SELECT {ROW}, home_win, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM ({SCALED})")
WEIGHTS = (1.5, 0.25, -0.5, 0.125, 0.0625, -0.25, 0.5, -0.125, 0.25, -0.375)
LOGIT = " + ".join(f"({w}::DOUBLE) * {c}" for w, c in zip(WEIGHTS, FEATURES, strict=True)) + " + 0.1875::DOUBLE"
states(
    "score_logistic",
    f"SELECT {ROW}, round(1 / (1 + exp(-greatest(-50, least(50, z)))), 8) AS probability FROM (SELECT *, {LOGIT} AS z FROM ({SCALED}))",
)


def layer_sql(source: str, inputs: list[str], prefix: str, rows: int, relu: bool) -> tuple[str, list[str]]:
    """One dense layer with the weights of the query's rule, as a nested select."""
    outputs = []
    for r in range(rows):
        terms = " + ".join(f"({((r * 7 + c * 3) % 11 - 5) / 8.0}::DOUBLE) * {name}" for c, name in enumerate(inputs))
        value = f"({terms} + {(r % 5 - 2) / 4.0}::DOUBLE)"
        outputs.append(f"{f'greatest(0, {value})' if relu else value} AS {prefix}{r}")
    return f"SELECT {ROW}, {', '.join(outputs)} FROM ({source})", [f"{prefix}{r}" for r in range(rows)]


_L1, _n1 = layer_sql(SCALED, FEATURES, "a", 64, True)
_L2, _n2 = layer_sql(_L1, _n1, "b", 32, True)
_L3, _n3 = layer_sql(_L2, _n2, "c", 1, False)
states("score_mlp", f"SELECT {ROW}, round(c0, 6) AS logit FROM ({_L3})")
states(
    "apply_platt",
    f"SELECT {ROW}, round(1 / (1 + exp(-greatest(-50, least(50, 0.75::DOUBLE * score_differential / 8 - 0.125::DOUBLE)))), 9) AS calibrated FROM states",
)
states(
    "calibration_split",
    "SELECT season, game_id, row_number() OVER (ORDER BY game_id) <= (SELECT count(DISTINCT game_id) FROM states WHERE season = '2022-23') // 2 AS fits "
    "FROM (SELECT DISTINCT season, game_id FROM states WHERE season = '2022-23')",
)

#: Steps of the statements' fits; each squares the error near the optimum.
NEWTON_STEPS = 20


def newton(rows: str, size: int) -> str:
    """Recursive logistic fits: ``newton`` (step, setting, c, b) from ``rows`` (setting, c, w, y, x), x a list of ``size`` numbers that ends with 1.

    Each step sums gradient and Hessian, solves them by Gauss-Jordan elimination, and moves the coefficients; the last one has no penalty.
    """

    def entry(i: int, j: int) -> str:
        return f"any_value(c) * sum(v * x[{i}] * x[{j}])" + (" + 1" if i == j < size else "")

    def right(i: int) -> str:
        return f"any_value(c) * sum(e * x[{i}])" + (f" + any_value(b)[{i}]" if i < size else "")

    matrix = ", ".join("[" + ", ".join([*(entry(i, j) for j in range(1, size + 1)), right(i)]) + "]" for i in range(1, size + 1))
    solved = (
        f"SELECT step, setting, any_value(c) AS c, any_value(b) AS b, [{matrix}] AS m FROM "
        "(SELECT step, setting, c, b, x, w * p * (1 - p) AS v, w * (p - y) AS e FROM "
        "(SELECT step, setting, c, b, x, w, y, 1 / (1 + exp(-greatest(-50, least(50, list_dot_product(x, b))))) AS p "
        f"FROM newton JOIN ({rows}) USING (setting, c) WHERE step < {NEWTON_STEPS})) GROUP BY step, setting"
    )
    for k in range(1, size + 1):
        solved = (
            f"SELECT step, setting, c, b, list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda q: q / r[{k}]) "
            f"ELSE list_transform(r, lambda q, j: q - r[{k}] / m[{k}][{k}] * m[{k}][j]) END) AS m FROM ({solved})"
        )
    start = "[" + ", ".join(["0::DOUBLE"] * size) + "]"
    moved = f"SELECT step + 1, setting, c, list_transform(b, lambda q, i: q - m[i][{size + 1}]) FROM ({solved})"
    return f"newton(step, setting, c, b) AS (SELECT DISTINCT 0, setting, c, {start} FROM ({rows}) UNION ALL {moved})"


def coefficients(names: list[str]) -> str:
    """The fitted coefficients by name."""
    listed = ", ".join(f"({k}, '{name}')" for k, name in enumerate(names, 1))
    return f"SELECT setting AS model, f.name AS feature, round(b[f.k], 5) + 0.0 AS coefficient FROM newton, (VALUES {listed}) f(k, name) WHERE step = {NEWTON_STEPS}"


TRAIN_ROWS = f"SELECT 'logistic' AS setting, 1::DOUBLE AS c, 1::DOUBLE AS w, home_win::DOUBLE AS y, [{', '.join(FEATURES)}, 1::DOUBLE] AS x FROM ({SCALED}) WHERE season = '2021-22'"
ORACLE["fit_logistic"] = with_(f"{sb.STATES}, nr AS MATERIALIZED ({TRAIN_ROWS}), {newton('SELECT * FROM nr', 11)}", coefficients([*FEATURES, "intercept"]))
PLATT_ROWS = (
    "SELECT 'platt' AS setting, 1e6::DOUBLE AS c, 1::DOUBLE AS w, home_win::DOUBLE AS y, [score_differential / 8::DOUBLE, 1::DOUBLE] AS x FROM states JOIN "
    "(SELECT game_id, row_number() OVER (ORDER BY game_id) <= (SELECT count(DISTINCT game_id) FROM states WHERE season = '2022-23') // 2 AS fits "
    "FROM (SELECT DISTINCT game_id FROM states WHERE season = '2022-23')) USING (game_id) WHERE fits AND season = '2022-23'"
)
ORACLE["fit_platt"] = with_(f"{sb.STATES}, nr AS MATERIALIZED ({PLATT_ROWS}), {newton('SELECT * FROM nr', 2)}", coefficients(["logit", "intercept"]))

#: Name, features beyond the ten, only known possession, weighting, c.
GRID = (
    ("base", 0, False, "full", 1.0),
    ("with scores", 2, False, "full", 1.0),
    ("known possession", 0, True, "full", 1.0),
    ("game balanced", 0, False, "game_balanced", 1.0),
    ("time buckets", 0, False, "time_bucket_30s", 1.0),
    ("c 0.1", 0, False, "full", 0.1),
    ("c 10", 0, False, "full", 10.0),
)
GRID_FEATURES = [*FEATURES, "home_score", "away_score"]
GRID_SCALED = [*SCALED_FEATURES, "home_score", "away_score"]


def grid_sql() -> str:
    def kind(known: bool, weighting: str) -> str:
        return "w_known" if known else {"full": "w_full", "game_balanced": "w_balanced", "time_bucket_30s": "w_last"}[weighting]

    weighed = (
        "gridrows AS MATERIALIZED (SELECT *, 1::DOUBLE AS w_full, possession_known::DOUBLE AS w_known, "
        "count(*) OVER ()::DOUBLE / (games * count(*) OVER (PARTITION BY game_id)) AS w_balanced, "
        f"CASE WHEN source_event_index = max(source_event_index) OVER (PARTITION BY game_id, floor({ELAPSED} / 30)) THEN 1::DOUBLE ELSE 0 END AS w_last "
        "FROM states CROSS JOIN (SELECT count(DISTINCT game_id)::DOUBLE AS games FROM states WHERE season = '2021-22') WHERE season = '2021-22')"
    )
    moments = [
        f"avg({f}) FILTER (w_{k} > 0) AS m_{k}_{f}, coalesce(nullif(stddev_pop({f}) FILTER (w_{k} > 0), 0), 1) AS s_{k}_{f}" for k in ("full", "known", "balanced", "last") for f in GRID_SCALED
    ]
    counts = ", ".join(f"count(*) FILTER (w_{k} > 0) AS n_{k}" for k in ("full", "known", "balanced", "last"))

    def listed(more: int, which: str) -> str:
        parts = []
        for f in GRID_FEATURES:
            if f in ("home_score", "away_score") and not more:
                parts.append("0::DOUBLE")
            elif f == "home_possession":
                parts.append("coalesce(CAST(home_possession AS DOUBLE), 0.5)")
            elif f in GRID_SCALED:
                parts.append(f"({f} - m_{which}_{f}) / s_{which}_{f}")
            else:
                parts.append(f"CAST({f} AS DOUBLE)")
        return f"[{', '.join(parts)}, 1::DOUBLE]"

    fits = " UNION ALL ".join(
        f"SELECT '{name}' AS setting, {c}::DOUBLE AS c, {kind(known, weighting)} AS w, home_win::DOUBLE AS y, {listed(more, kind(known, weighting)[2:])} AS x FROM gridrows CROSS JOIN gm"
        for name, more, known, weighting, c in GRID
    )
    judged = " UNION ALL ".join(
        f"SELECT '{name}' AS experiment, home_win AS y, 1 / (1 + exp(-greatest(-50, least(50, list_dot_product(b, {listed(more, kind(known, weighting)[2:])}))))) AS p "
        f"FROM states CROSS JOIN gm JOIN newton ON setting = '{name}' AND step = {NEWTON_STEPS} WHERE season = '2022-23'{' AND possession_known = 1' if known else ''}"
        for name, more, known, weighting, c in GRID
    )
    told = " UNION ALL ".join(
        f"SELECT '{name}' AS experiment, {10 + more} AS n_features, {known} AS drop_unknown, '{weighting}' AS weighting, {c}::DOUBLE AS c, n_{kind(known, weighting)[2:]} AS train_rows, "
        + ", ".join(f"round(b[{k}], 5) + 0.0 AS w_{f}" if more or f not in ("home_score", "away_score") else f"NULL::DOUBLE AS w_{f}" for k, f in enumerate([*GRID_FEATURES, "intercept"], 1))
        + f" FROM gm JOIN newton ON setting = '{name}' AND step = {NEWTON_STEPS}"
        for name, more, known, weighting, c in GRID
    )
    return with_(
        f"{sb.STATES}, {weighed}, gm AS MATERIALIZED (SELECT {', '.join(moments)}, {counts} FROM gridrows), nr AS MATERIALIZED ({fits}), {newton('SELECT * FROM nr', 13)}, "
        f"judged AS MATERIALIZED ({judged})",
        f"SELECT t.*, g.* EXCLUDE (experiment) REPLACE ({', '.join(f'round({m}, 6) AS {m}' for m in ('brier', 'log_loss', 'accuracy', 'roc_auc', 'ece'))}) FROM ({told}) t JOIN ({metrics('SELECT * FROM judged', 'experiment')}) g USING (experiment)",
    )


ORACLE["experiment_grid"] = grid_sql()
ORACLE["fit_mlp"] = with_(
    f"{sb.STATES}, nr AS MATERIALIZED ({TRAIN_ROWS}), {newton('SELECT * FROM nr', 11)}",
    "SELECT count(*) AS row_count, 3 AS models, true AS best_is_lower, round(avg((p - y) ** 2), 6) AS logistic_brier FROM "
    f"(SELECT home_win AS y, 1 / (1 + exp(-greatest(-50, least(50, list_dot_product(b, [{', '.join(FEATURES)}, 1::DOUBLE]))))) AS p FROM ({SCALED}) "
    f"JOIN newton ON step = {NEWTON_STEPS} WHERE season = '2022-23')",
)

_LINEAR_P = f"1 / (1 + exp(-greatest(-50, least(50, list_dot_product(b, [{', '.join(FEATURES)}, 1::DOUBLE])))))"
FITTED = f"{sb.STATES}, nr AS MATERIALIZED ({TRAIN_ROWS}), {newton('SELECT * FROM nr', 11)}"
_SIX = ", ".join(f"round({m}, 6) AS {m}" for m in ("brier", "log_loss", "accuracy", "roc_auc", "ece"))


def _linear_rows(season: str) -> str:
    return f"SELECT 'logistic' AS model, home_win AS y, {_LINEAR_P} AS p FROM ({SCALED}) JOIN newton ON step = {NEWTON_STEPS} WHERE season = '{season}'"


ORACLE["tune_model"] = with_(
    f"{FITTED}, judged AS MATERIALIZED ({_linear_rows('2022-23')})",
    "SELECT (SELECT count(*) FROM states WHERE season = '2021-22') AS train_rows, row_count AS validation_rows, (SELECT round(avg(home_win), 9) FROM states WHERE season = '2021-22') AS constant, "
    f"2 AS candidates, {_SIX} FROM ({metrics('SELECT * FROM judged', 'model')})",
)
ORACLE["evaluate_model"] = with_(
    f"{FITTED}, judged AS MATERIALIZED ({_linear_rows('2023-24')} UNION ALL SELECT 'constant', home_win, {RATE} FROM states WHERE season = '2023-24')",
    f"SELECT model, row_count, {_SIX} FROM ({metrics('SELECT * FROM judged', 'model')})",
)

# --- Sources and sinks ------------------------------------------------------------------

LOG = "season, GAME_ID, GAME_DATE, TEAM_ID, TEAM_ABBREVIATION, MATCHUP, WL, PTS"
ORACLE["read_game_log"] = with_(sb.GAME_LOG, f"SELECT {LOG} FROM game_log")
ORACLE["write_game_log"] = with_(
    sb.GAME_LOG, "SELECT season, count(*) AS n, min(GAME_ID) AS first_id, sum(PTS)::BIGINT AS points FROM game_log GROUP BY season"
)
RAW = "actionId, actionNumber, actionType, subType, clock, period, teamId, teamTricode, description, scoreHome, scoreAway, shotResult"
ORACLE["read_raw_pbp"] = with_(sb.ACTIONS, f"SELECT {ROW}, n_events, {RAW} FROM acts")
ORACLE["explode_actions"] = with_(
    sb.ACTIONS, f"SELECT {ROW}, n_events, CAST(source_event_index // 25 AS INT) AS part, actionId, clock FROM acts"
)
ORACLE["write_raw_pbp"] = with_(
    sb.ACTIONS, "SELECT season, count(*) AS n, sum(period)::BIGINT AS periods, count(DISTINCT game_id) AS games FROM acts GROUP BY season"
)
states(
    "write_states",
    "SELECT season, count(*) AS states, sum(home_score + CASE WHEN game_id IN (SELECT game_id FROM states WHERE period > 4) THEN 1000 ELSE 0 END)::BIGINT "
    "AS home_points FROM states GROUP BY season",
)
states("read_states", f"SELECT {ROW}, home_score, away_score, possession_reason FROM states WHERE season IN ('2021-22', '2023-24')")
ORACLE["read_live_snapshots"] = with_(
    f"{sb.LIVE}, sized AS (SELECT *, count(*) OVER (PARTITION BY game_id) AS total FROM live)",
    "SELECT game_id, poll, source_index, orderNumber, actionType, scoreHome, CAST(len(qualifiers) AS INT) AS qualifiers FROM sized "
    "CROSS JOIN (VALUES (0), (1), (2)) p(poll) WHERE poll > 0 OR source_index < total / 2",
)
ORACLE["process_season"] = ORACLE["season_results"]
ORACLE["write_report"] = with_(
    sb.TRACKED,
    "SELECT a.season, count(DISTINCT game_id) AS games_processed, count(*) AS raw_events, count(*) FILTER (emitted) AS emitted_states, "
    "round(100.0::DOUBLE * count(*) FILTER (emitted AND possession_team_id IS NOT NULL) / count(*) FILTER (emitted), 6) AS known_possession_percent, "
    "CAST(count(DISTINCT possession_reason) FILTER (emitted) AS INT) AS reasons, "
    "(SELECT max(n) FROM (SELECT count(*) AS n FROM trk b WHERE b.season = a.season AND emitted GROUP BY possession_reason)) AS top_reason_states, "
    "CAST(least(100, count(*) FILTER (marker_matches = 0)) AS INT) AS discrepancies, true AS has_bytes, CAST(count(DISTINCT game_id) AS INT) AS listed, "
    "(SELECT CAST(count(*) FILTER (h = home_pts AND w = away_pts) AS INT) FROM (SELECT season, game_id, arg_max(home_score, source_event_index) AS h, arg_max(away_score, source_event_index) AS w "
    "FROM trk GROUP BY ALL) l JOIN idx USING (season, game_id) WHERE l.season = a.season) AS final_scores, count(*) FILTER (emitted) AS listed_states, count(marker_matches) AS markers_checked, "
    "min(game_id) AS first_game FROM trk a GROUP BY a.season",
)

# --- Data quality -----------------------------------------------------------------------

DEFECTS = f"{sb.STAGED}, facts AS MATERIALIZED (SELECT *, {sb.columns_sql(sb.DEFECT_COLUMNS)} FROM staged)"
LISTED = "defect NOT IN ('cut', 'no game', 'not an object', 'not a list', 'empty', 'absent')"
CHECKED = (
    f"{DEFECTS}, sums AS (SELECT season, game_id, defect, CASE WHEN {LISTED} THEN count(*) ELSE 0 END AS n, "
    f"count(*) FILTER (pv IS NULL) AS no_p, count(*) FILTER (cv IS NULL) AS no_c, min(TRY_CAST(pv AS INT)) AS low, "
    "count(*) FILTER (regexp_full_match(trim(cv, '\"'), 'PT\\d+M\\d+(\\.\\d+)?S')) AS clocks, "
    "count(*) FILTER (trim(trim(tv, '\"')) <> '') AS types FROM facts GROUP BY season, game_id, defect), "
    "listed AS (SELECT *, [CASE WHEN defect = 'cut' THEN 'the document is not readable JSON' END, "
    "CASE WHEN defect = 'not an object' THEN 'the document is not an object' END, "
    "CASE WHEN defect = 'no game' THEN 'the document has no game object' END, "
    "CASE WHEN defect = 'other id' THEN 'the document is for game 9999999999' END, "
    "CASE WHEN defect = 'not a list' THEN 'there is no list of actions' END, "
    "CASE WHEN defect = 'empty' THEN 'the list of actions is empty' END, "
    "CASE WHEN n > 0 AND n < 50 THEN 'too few events: ' || n END, "
    "CASE WHEN n > 0 AND no_p > 0 THEN 'period is missing from events: ' || no_p END, "
    "CASE WHEN n > 0 AND no_c > 0 THEN 'clock is missing from events: ' || no_c END, "
    "CASE WHEN n > 0 AND low IS NULL THEN 'no whole-number period' END, "
    "CASE WHEN n > 0 AND low < 1 THEN 'period is below one: ' || low END, "
    "CASE WHEN n > 0 AND clocks = 0 THEN 'no readable clock' END, "
    "CASE WHEN n > 0 AND clocks > 0 AND clocks < 0.95 * n THEN 'too few readable clocks: ' || clocks END, "
    "CASE WHEN n > 0 AND types = 0 THEN 'no action type' END, "
    "CASE WHEN n > 0 AND types > 0 AND types < 0.5 * n THEN 'too few action types: ' || types END] AS found FROM sums), "
    "checked AS (SELECT season, game_id, defect, n AS event_count, coalesce(array_to_string([p for p in found if p IS NOT NULL], '; '), '') AS reason FROM listed)"
)
ORACLE["validate_feeds"] = with_(
    CHECKED, "SELECT season, game_id, reason = '' AS is_valid, event_count, reason FROM checked WHERE defect <> 'absent'"
)
ALL_FILES = (
    "SELECT season, game_id, defect <> 'absent' AND reason = '' AS is_valid, event_count, defect = 'absent' AS is_missing, "
    "CASE WHEN defect = 'absent' THEN 'there is no file' ELSE reason END AS reason FROM checked"
)
ORACLE["validate_files"] = with_(CHECKED, ALL_FILES)
ORACLE["verify_downloads"] = with_(
    f"{CHECKED}, files AS ({ALL_FILES}), {sb.INDEX[len(sb.STAGED) + 2:]}",
    "SELECT f.season, count(*) AS expected, count(*) FILTER (is_valid) AS verified, count(*) FILTER (is_missing) AS missing, "
    "count(*) FILTER (NOT is_valid AND NOT is_missing) AS invalid, coalesce(sum(event_count) FILTER (is_valid), 0)::BIGINT AS events, "
    "(SELECT sum(home_win)::BIGINT FROM idx WHERE idx.season = f.season) AS home_wins, "
    "(SELECT round(avg(home_win), 6) FROM idx WHERE idx.season = f.season) AS home_win_rate, "
    "CASE WHEN count(*) FILTER (is_valid) > 0 THEN round(sum(event_count) FILTER (is_valid) / count(*) FILTER (is_valid), 6) END AS mean_events, "
    "count(*) FILTER (NOT is_valid) = 0 AS complete FROM files f GROUP BY f.season",
)
LANDED_GAMES = (
    f"{sb.ACTIONS}, kinds AS MATERIALIZED (SELECT season, game_id, CAST(game_id AS BIGINT) % 7 AS kind, count(*) AS n FROM acts GROUP BY ALL), "
    "told AS MATERIALIZED (SELECT season, game_id, kind, CASE WHEN kind IN (1, 2, 5) THEN 0 ELSE n END AS event_count, CASE kind WHEN 1 THEN 'the file cannot be read: it is cut off' "
    "WHEN 2 THEN 'the file cannot be read: it is not gzip' WHEN 5 THEN 'there is no file' ELSE CASE WHEN n < 50 THEN 'too few events: ' || n ELSE '' END END AS reason FROM kinds)"
)
ORACLE["read_landed_pbp"] = with_(
    LANDED_GAMES, f"SELECT {ROW}, n_events, actionId, clock, period, description FROM acts JOIN kinds USING (season, game_id) WHERE kind NOT IN (1, 2, 5)"
)
ORACLE["landed_files"] = with_(
    LANDED_GAMES,
    "SELECT season, game_id, kind <> 4 AS compressed, true AS has_bytes, kind NOT IN (1, 2) AS is_read, CASE kind WHEN 1 THEN 'it is cut off' WHEN 2 THEN 'it is not gzip' END AS error FROM kinds WHERE kind <> 5",
)
ORACLE["validate_landed_files"] = with_(LANDED_GAMES, "SELECT season, game_id, reason = '' AS is_valid, event_count, kind = 5 AS is_missing, reason FROM told")
ORACLE["verify_landed_downloads"] = with_(
    f"{LANDED_GAMES}, {sb.INDEX[len(sb.STAGED) + 2:]}",
    "SELECT f.season, count(*) AS expected, count(*) FILTER (reason = '') AS verified, count(*) FILTER (kind = 5) AS missing, "
    "count(*) FILTER (reason <> '' AND kind <> 5) AS invalid, coalesce(sum(event_count) FILTER (reason = ''), 0)::BIGINT AS events, "
    "(SELECT sum(home_win)::BIGINT FROM idx WHERE idx.season = f.season) AS home_wins, "
    "(SELECT round(avg(home_win), 6) FROM idx WHERE idx.season = f.season) AS home_win_rate, "
    "CASE WHEN count(*) FILTER (reason = '') > 0 THEN round(sum(event_count) FILTER (reason = '') / count(*) FILTER (reason = ''), 6) END AS mean_events, "
    "count(*) FILTER (reason <> '') = 0 AS complete, count(*) FILTER (reason = '') > 0 AS has_bytes FROM told f GROUP BY f.season",
)
VERIFIED = (
    f"{sb.STATES}, numbered AS (SELECT game_id, season, CAST(game_id AS BIGINT) % 13 AS g, count(*) AS states, "
    "arg_max(home_score, source_event_index) AS lh, arg_max(away_score, source_event_index) AS la, "
    "count(*) FILTER (source_event_index % 5 = 0) AS fifths, max(possession_known) AS known, max(period) AS last_period, "
    "min(home_team_fouls_period) AS low_fouls FROM states GROUP BY ALL), "
    "judged AS (SELECT n.*, x.home_pts, x.away_pts, array_to_string([p for p in ["
    "CASE WHEN g = 1 AND fifths > 0 THEN 'score difference' END, "
    "CASE WHEN lh <> home_pts OR la <> away_pts THEN 'final score' END, CASE WHEN g = 7 THEN 'outcome label' END, "
    "CASE WHEN g = 2 THEN 'regulation clock' END, CASE WHEN g = 3 AND last_period > 4 THEN 'overtime clock' END, "
    "CASE WHEN g = 4 AND known = 1 THEN 'possession team' END, CASE WHEN g IN (5) AND known = 1 THEN 'possession side' "
    "WHEN g = 4 AND known = 1 AND EXISTS (SELECT 1 FROM states s WHERE s.game_id = n.game_id AND s.home_possession = 1) THEN 'possession side' END, "
    "CASE WHEN g = 6 AND low_fouls < 3 THEN 'negative fouls' END] if p IS NOT NULL], '; ') AS found FROM numbered n JOIN idx x USING (season, game_id)), "
    "verified AS (SELECT season, game_id, states, coalesce(found, '') AS reason FROM judged WHERE g <> 8 "
    "UNION ALL SELECT season, game_id, 0, 'no states' FROM judged WHERE g = 8 "
    "UNION ALL SELECT season, '8' || substr(game_id, 2), states, 'game is not in the index' FROM judged WHERE g = 8)"
)
ORACLE["verify_states"] = with_(VERIFIED, "SELECT season, game_id, states, reason = '' AS is_valid, reason FROM verified")
states(
    "stored_disorder",
    "SELECT season, game_id, count(*) - 1 AS misplaced, 1::BIGINT AS files FROM states WHERE CAST(game_id AS BIGINT) % 3 = 0 GROUP BY season, game_id HAVING count(*) > 1",
)
ORACLE["verify_states_totals"] = with_(
    VERIFIED,
    "SELECT * FROM (SELECT season, count(*) FILTER (reason = '') AS verified, count(*) FILTER (states = 0) AS missing, "
    "count(*) FILTER (reason <> '' AND states > 0) AS invalid FROM verified GROUP BY season) LEFT JOIN "
    "(SELECT season, count(*) AS states, sum(possession_known)::BIGINT AS known, count(foul_marker_matches) AS markers_checked, "
    "coalesce(sum(foul_marker_matches), 0)::BIGINT AS markers_matched FROM states WHERE game_id IN (SELECT game_id FROM verified WHERE reason = '') "
    "GROUP BY season) USING (season)",
)
ORACLE["schema_checks"] = with_(
    NORM,
    "SELECT season, game_id, count(*) AS events, bool_and(length(game_id) = 10) AS id_ok, "
    "bool_and(period IS NOT NULL AND clock IS NOT NULL AND actionType IS NOT NULL) AS no_nulls, "
    "min(period) = 1 AND max(period) <= 10 AS period_ok, bool_and(seconds BETWEEN 0 AND 720) AS clock_ok, "
    "bool_and(coalesce(TRY_CAST(nullif(sh, '') AS DOUBLE), 0) >= 0 AND coalesce(TRY_CAST(nullif(sa, '') AS DOUBLE), 0) >= 0) "
    "AND count(nullif(sh, '')) > 0 AND count(nullif(sa, '')) > 0 AS scores_ok, "
    "count(nullif(action_type, '')) > 0.8 * count(*) AND count(*) FILTER (category = 'made shot') > 0 AND count(*) FILTER (category = 'missed shot') > 0 "
    "AND count(*) FILTER (category = 'rebound') > 0 AND count(*) FILTER (category = 'turnover') > 0 AS types_ok, "
    "count(nullif(event_text, '')) > 0.9 * count(*) AS descriptions_ok, "
    "count(nullif(teamTricode, '')) > 0.8 * count(*) AND count(DISTINCT nullif(teamTricode, '')) = 2 AS teams_ok, "
    "bool_or(lower(action_type) LIKE '%foul%') AND bool_or(lower(action_type) LIKE '%timeout%') AS fouls_and_timeouts_ok "
    "FROM norm GROUP BY season, game_id",
)
ORACLE["differential_check"] = with_(
    sb.TRACKED, "SELECT season, game_id, max(abs(home_score - away_score)) < 100 AS differential_ok FROM trk GROUP BY season, game_id"
)
ORACLE["order_consistency"] = with_(
    NORM,
    "SELECT season, game_id, round(corr(r, o), 6) AS correlation, coalesce(corr(r, o) > 0.99, false) AS consistent FROM (SELECT season, game_id, "
    "rank() OVER (PARTITION BY season, game_id ORDER BY actionNumber) + (count(*) OVER (PARTITION BY season, game_id, actionNumber) - 1) / 2.0 AS r, "
    "row_number() OVER (PARTITION BY season, game_id ORDER BY period, seconds DESC, source_event_index) AS o "
    "FROM norm WHERE actionNumber IS NOT NULL) GROUP BY season, game_id",
)
ORACLE["field_presence"] = with_(
    DEFECTS,
    " UNION ALL ".join(
        f"SELECT season, '{name}' AS field, count(*) AS n FROM facts WHERE {LISTED} AND {has} GROUP BY season"
        for name, has in (
            ("period", "pv IS NOT NULL"), ("clock", "cv IS NOT NULL"), ("actionType", "tv IS NOT NULL"), ("actionNumber", "true"), ("subType", "event_id % 3 = 0"),
        )
    ),
)

# --- Manifest ---------------------------------------------------------------------------


def _manifest_ctes() -> str:
    from checks.queries import EVERY_GAME, MANIFEST_COLUMNS, OUTCOME_COLUMNS

    return (
        "known AS (SELECT o_custkey AS custkey, arg_max(o_orderstatus, o_orderkey) AS last_status, "
        "count(*) FILTER (o_orderstatus = 'F') AS failures, count(*) FILTER (o_orderstatus = 'O') AS loads FROM orders "
        "GROUP BY o_custkey), "
        f"man AS (SELECT {sb.columns_sql(MANIFEST_COLUMNS)} FROM known), "
        f"outc AS (SELECT {sb.columns_sql(OUTCOME_COLUMNS)} FROM customer), "
        f"everyone AS (SELECT {EVERY_GAME['game_id']} AS game_id FROM customer), "
        "upd AS (SELECT coalesce(m.game_id, o.game_id) AS game_id, CASE o.action WHEN 'failed' THEN 'failed' WHEN 'downloaded' THEN 'downloaded' "
        "WHEN 'skipped' THEN 'downloaded' ELSE m.status END AS status, "
        "CAST(coalesce(m.attempts, 0) + CASE WHEN o.action = 'failed' THEN 1 ELSE 0 END AS INT) AS attempts, coalesce(o.action, m.last_action) AS last_action, "
        "CASE WHEN o.action IN ('downloaded', 'skipped') THEN o.event_count ELSE m.event_count END AS event_count, "
        "CASE WHEN o.action IS NULL THEN m.error_type ELSE o.error_type END AS error_type, "
        "CASE WHEN o.action IS NULL THEN m.error ELSE substr(o.error, 1, 500) END AS error, "
        "CASE WHEN o.action IS NULL THEN m.updated_at ELSE TIMESTAMP '2024-02-02 00:00:00' END AS updated_at "
        "FROM man m FULL JOIN outc o ON m.game_id = o.game_id)"
    )


MAN = _manifest_ctes()
ORACLE["register_games"] = with_(
    MAN,
    "SELECT game_id, status, attempts, event_count FROM man UNION ALL SELECT game_id, 'pending', 0, NULL FROM everyone "
    "WHERE game_id NOT IN (SELECT game_id FROM man)",
)
ORACLE["manifest_update"] = with_(MAN, "SELECT * FROM upd")
ORACLE["failure_log"] = with_(
    MAN,
    "SELECT season, 'Regular Season' AS season_type, game_id, error_type, error, attempts FROM upd CROSS JOIN (VALUES ('2021-22'), ('2022-23')) s(season) "
    "WHERE game_id IN (SELECT game_id FROM outc WHERE action = 'failed')",
)
ORACLE["games_to_process"] = with_(
    MAN,
    "SELECT game_id FROM everyone WHERE game_id NOT IN (SELECT game_id FROM outc WHERE action = 'downloaded') "
    "AND game_id NOT IN (SELECT game_id FROM man WHERE status = 'failed')",
)
ORACLE["ingest_run_stats"] = with_(
    MAN,
    "SELECT count(*) AS considered, count(*) FILTER (action = 'downloaded') AS downloaded, count(*) FILTER (action = 'skipped') AS skipped, "
    "count(*) FILTER (action = 'failed') AS failed, sum(event_count) FILTER (action = 'downloaded')::BIGINT AS events FROM outc",
)
ORACLE["manifest_summary"] = with_(
    MAN,
    "SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'downloaded') AS downloaded, "
    "count(*) FILTER (status = 'failed') AS failed, sum(event_count)::BIGINT AS events FROM man",
)
ORACLE["manifest_status"] = with_(
    MAN,
    "SELECT 'total' AS kind, status AS label, count(*) AS n, NULL AS error FROM man GROUP BY status UNION ALL "
    "SELECT * FROM (SELECT 'failed game', game_id, NULL, coalesce(error_type, '?') || ': ' || substr(error, 1, 90) FROM man WHERE status = 'failed' ORDER BY game_id LIMIT 20)",
)

# --- Snapshots and streams --------------------------------------------------------------


def _poll_ctes() -> str:
    from checks.queries import POLL

    return f"{sb.STAGED}, polls AS MATERIALIZED (SELECT event_id, event_type, {sb.columns_sql(POLL)} FROM staged)"


POLLS = _poll_ctes()
BY_GAME = "WINDOW w AS (PARTITION BY game_id ORDER BY poll)"
ORACLE["snapshot_fingerprint"] = with_(
    POLLS,
    "SELECT game_id, poll, sha256('{\"a\":{\"c\":\"' || event_type || '\",\"d\":' || poll || '},\"b\":' || x || '}') AS fingerprint FROM polls",
)
ORACLE["changed_snapshots"] = with_(
    POLLS, f"SELECT game_id, poll FROM polls {BY_GAME} QUALIFY lag(x) OVER w IS DISTINCT FROM x"
)


def _landed_ctes() -> str:
    from hoopline.sources.derived import LANDED_POLL_COLUMNS, POLL_VERSION

    return (
        f"{sb.LIVE}, pollrows AS MATERIALIZED (SELECT game_id, poll, total, {sb.columns_sql(LANDED_POLL_COLUMNS)} FROM (SELECT *, {POLL_VERSION} AS version FROM "
        "(SELECT DISTINCT user_id, game_id, home_id, away_id FROM staged) JOIN (SELECT game_id, count(*) AS total FROM live GROUP BY game_id) USING (game_id) "
        "CROSS JOIN (SELECT unnest(range(0, 8)) AS poll))), "
        "goodpolls AS (SELECT *, lag(shown) OVER w IS DISTINCT FROM shown AS feed_changed, row_number() OVER w = 1 OR lag(meta) OVER w IS DISTINCT FROM meta AS metadata_changed "
        "FROM (SELECT *, {'a': game_status, 'b': status_text, 'c': home_score, 'd': away_score} AS meta FROM pollrows WHERE NOT failed) WINDOW w AS (PARTITION BY game_id ORDER BY poll)), "
        "pollev AS (SELECT *, lag(failed) OVER w AS before, last_value(CASE WHEN NOT failed THEN meta END IGNORE NULLS) OVER "
        "(PARTITION BY game_id ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM "
        "(SELECT game_id, poll, shown, failed, meta, feed_changed, metadata_changed FROM goodpolls WHERE feed_changed OR metadata_changed "
        "UNION ALL SELECT game_id, poll, shown, failed, NULL, false, false FROM pollrows WHERE failed) WINDOW w AS (PARTITION BY game_id ORDER BY poll)), "
        "publog AS MATERIALIZED (SELECT game_id, CAST(poll AS INT) AS poll, CASE WHEN failed THEN 'failure' WHEN feed_changed AND metadata_changed THEN 'feed and metadata' WHEN feed_changed THEN 'feed' ELSE 'metadata' END AS cause, "
        "feed_changed, metadata_changed, CASE WHEN NOT failed THEN 'live' WHEN old IS NULL THEN 'waiting' ELSE 'degraded' END AS feed_status, "
        "CASE WHEN failed THEN 'The live feed did not answer; this is the last state that it gave.' END AS error, "
        "CASE WHEN failed THEN old.a ELSE meta.a END AS game_status, CASE WHEN failed THEN old.b ELSE meta.b END AS status_text, "
        "CASE WHEN failed THEN old.c ELSE meta.c END AS home_score, CASE WHEN failed THEN old.d ELSE meta.d END AS away_score "
        "FROM pollev WHERE NOT failed OR before IS NOT TRUE)"
    )


LANDED = _landed_ctes()
ORACLE["publish_log"] = with_(LANDED, "SELECT * FROM publog")
ORACLE["published_changes"] = with_(LANDED, "SELECT * EXCLUDE (feed_status, error) FROM publog WHERE feed_status = 'live'")
ORACLE["metadata_change"] = with_(LANDED, "SELECT game_id, poll, feed_changed, game_status, status_text, home_score, away_score FROM publog WHERE metadata_changed")
ORACLE["degraded_feed"] = with_(LANDED, "SELECT * FROM publog QUALIFY cause = 'failure' OR lag(cause) OVER (PARTITION BY game_id ORDER BY poll) = 'failure'")
ORACLE["changed_snapshots_stream"] = with_(LANDED, "SELECT game_id, poll FROM publog WHERE feed_changed")
# Every prefix is a game of its own here, walked from its first action.
ORACLE["replay_prefix"] = with_(
    sb.LIVE_STATES.replace("live AS MATERIALIZED (SELECT", "live_all AS MATERIALIZED (SELECT", 1)
    .replace(
        ", live_one AS (",
        ", cuts AS MATERIALIZED (SELECT game_id, unnest(range(1, count(*) + 1)) AS k FROM live_all GROUP BY game_id), "
        "live AS MATERIALIZED (SELECT l.* REPLACE (game_id || '/' || k AS game_id) FROM live_all l JOIN cuts USING (game_id) "
        "WHERE source_index < k), live_one AS (",
        1,
    )
    .replace("SELECT 'live' AS season, game_id, home_team_id", "SELECT 'live' AS season, game_id || '/' || k AS game_id, home_team_id", 1)
    .replace("CAST(NULL AS INT) AS home_win FROM idx)", "CAST(NULL AS INT) AS home_win FROM idx JOIN cuts USING (game_id))", 1),
    "SELECT season, split_part(game_id, '/', 1) AS game_id, CAST(split_part(game_id, '/', 2) AS INT) AS cursor, actions, home_score, away_score, period, seconds_remaining_period, "
    "possession_team_id, home_team_fouls_period, away_team_fouls_period FROM (SELECT * FROM live_states QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY source_event_index DESC) = 1) "
    "JOIN (SELECT game_id, CAST(count(*) AS INT) AS actions FROM live_one GROUP BY game_id) USING (game_id)",
)
_BATCHES = "(VALUES (0, 2), (1, 5), (2, 7)) bt(batch, last_poll)"
ORACLE["served_documents"] = with_(
    sb.LIVE_STATES.replace(sb.LIVE, LANDED.replace("live AS MATERIALIZED (SELECT", "live_all AS MATERIALIZED (SELECT", 1).replace("FROM live GROUP BY", "FROM live_all GROUP BY", 1), 1)
    .replace(
        ", live_one AS (",
        f", cuts AS MATERIALIZED (SELECT game_id, batch, max_by(shown, poll) AS k FROM pollrows, {_BATCHES} WHERE NOT failed AND poll <= last_poll GROUP BY game_id, batch), "
        "live AS MATERIALIZED (SELECT l.* REPLACE (game_id || '/' || batch AS game_id) FROM live_all l JOIN cuts USING (game_id) WHERE source_index < k), live_one AS (",
        1,
    )
    .replace("SELECT 'live' AS season, game_id, home_team_id", "SELECT 'live' AS season, game_id || '/' || batch AS game_id, home_team_id", 1)
    .replace("CAST(NULL AS INT) AS home_win FROM idx)", "CAST(NULL AS INT) AS home_win FROM idx JOIN cuts USING (game_id))", 1),
    "SELECT game_id, batch, poll, feed_status, game_status, CASE WHEN l.gid IS NULL THEN coalesce(nullif(status_text, ''), 'Waiting for play-by-play') ELSE status_text END AS status_text, "
    "l.home_score, l.away_score, l.period, CASE WHEN game_status = 3 THEN CASE WHEN p.home_score > p.away_score THEN 1::DOUBLE ELSE 0::DOUBLE END ELSE probability END AS home_win_probability, "
    "probability AS model_home_win_probability, game_status = 3 AS final_override_applied, l.gid IS NOT NULL AS has_events FROM "
    f"(SELECT p.*, batch FROM publog p JOIN {_BATCHES} ON poll BETWEEN last_poll - CASE WHEN batch = 2 THEN 1 ELSE 2 END AND last_poll QUALIFY row_number() OVER (PARTITION BY game_id, batch ORDER BY poll DESC) = 1) p "
    f"LEFT JOIN (SELECT game_id AS gid, home_score, away_score, period, greatest(0::DOUBLE, least(1::DOUBLE, CAST(50 + score_differential * period AS DOUBLE) / 100)) AS probability FROM live_states QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY source_event_index DESC) = 1) l "
    "ON l.gid = p.game_id || '/' || p.batch WHERE feed_status <> 'waiting'",
)
ORACLE["live_states_stream"] = ORACLE["live_states"]
ORACLE["cache_live_snapshots"] = with_(
    sb.STAGED,
    "SELECT game_id, CAST(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS INT) AS poll, 0 AS part FROM (SELECT DISTINCT user_id, game_id FROM staged)",
)

# --- Served documents -------------------------------------------------------------------

SERVED = (
    f"{sb.SCORED_AND_BOARD}, games AS ({BOARD_GAMES}), placed AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY source_event_index DESC) AS age, "
    "count(*) OVER (PARTITION BY game_id) AS total FROM scored WHERE CAST(game_id AS BIGINT) % 16 <> 13), latest AS (SELECT * FROM placed WHERE age = 1)"
)
ORACLE["games_list"] = with_(
    SERVED,
    "SELECT g.game_id, game_status, status_text, coalesce(l.period, g.period) AS period, coalesce(l.clock, g.clock) AS clock, "
    "coalesce(l.home_score, g.home_score) AS home_score, home_tricode, coalesce(l.away_score, g.away_score) AS away_score, away_name "
    "FROM games g LEFT JOIN latest l USING (game_id)",
)
FINAL = "(g.game_status = 3 AND g.home_score IS NOT NULL AND g.away_score IS NOT NULL)"
SHOWN_HOME = f"CASE WHEN {FINAL} THEN CAST(g.home_score > g.away_score AS INT)::DOUBLE ELSE l.probability END"
ORACLE["state_payload"] = with_(
    SERVED,
    "SELECT CASE WHEN c.hid IS NULL THEN 'live' ELSE 'replay' END AS mode, CAST(c.hid % 7 AS INT) AS cursor, c.hid % 7 = 6 AS complete, true AS is_dated, g.game_id, g.game_status, CASE WHEN l.game_id IS NULL AND g.status_text = '' THEN 'Waiting for play-by-play' ELSE g.status_text END AS status_text, "
    "coalesce(l.period, g.period) AS period, "
    + LABEL.replace("period", "coalesce(l.period, g.period)")
    + " AS period_label, coalesce(l.clock, g.clock) AS clock, CASE WHEN l.game_id IS NULL THEN g.home_score ELSE l.home_score END AS home_score, "
    "CASE WHEN l.game_id IS NULL THEN g.away_score ELSE l.away_score END AS away_score, l.score_differential, "
    "CASE WHEN l.possession_team_id = g.home_team_id THEN coalesce(nullif(home_tricode, ''), home_name) WHEN l.possession_team_id = g.away_team_id "
    "THEN away_tricode ELSE 'Unknown' END AS label, l.possession_team_id IS NOT NULL AS known, coalesce(l.home_team_fouls_period, 0) AS home_fouls, "
    f"CASE WHEN l.game_id IS NOT NULL THEN {SHOWN_HOME} END AS home_win_probability, CASE WHEN l.game_id IS NOT NULL THEN 1 - ({SHOWN_HOME}) END AS away_win_probability, "
    f"l.probability AS model_home_win_probability, l.game_id IS NOT NULL AND coalesce({FINAL}, false) AS final_override_applied, "
    "l.source_event_index AS last_sequence, CASE WHEN l.description <> '' THEN l.description ELSE l.semantic_event END AS last_description, "
    "CAST(CASE WHEN l.total IS NULL THEN 0 ELSE least(12, l.total) END AS INT) AS recent, CAST(CASE WHEN l.total IS NULL THEN 0 ELSE least(240, l.total) END AS INT) AS history, "
    "(SELECT min(source_event_index) FROM placed p WHERE p.game_id = g.game_id AND p.age <= 240) AS first_sequence, "
    "CASE WHEN l.game_id IS NULL THEN 'waiting' WHEN c.hid IS NULL THEN 'live' ELSE 'replay' END AS feed_status, coalesce(l.source_event_index, 0) AS sequence "
    "FROM games g LEFT JOIN latest l USING (game_id) LEFT JOIN (SELECT game_id AS cid, home_team_id AS hid FROM idx WHERE home_team_id % 3 = 0) c ON c.cid = g.game_id",
)

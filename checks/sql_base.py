"""DuckDB building blocks for the comparison statements.

Game states are worked out by a recursive statement that steps through a game one action at a
time and carries score, possession, pending shooter and fouls, which is nothing like the windows
the Spark side uses.
"""

from __future__ import annotations

from hoopline.sources.derived import ACTION_COLUMNS, BOARD_COLUMNS, DEFECT_COLUMNS, GAME_LOG_COLUMNS, LIVE_COLUMNS, columns_sql, stage_sql


def trim(c: str) -> str:
    return rf"regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '^\s+|\s+$', '', 'g')"


STAGED = (
    "ev AS MATERIALIZED (SELECT event_id, ts, user_id, event_type, value, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, "
    "count(*) OVER (PARTITION BY user_id) AS n FROM events), "
    f"staged AS MATERIALIZED ({stage_sql('SELECT * FROM ev')})"
)
ACTIONS = f"{STAGED}, acts AS MATERIALIZED (SELECT {columns_sql(ACTION_COLUMNS)} FROM staged)"
GAME_LOG = (
    f"{STAGED}, log_games AS (SELECT user_id, season, game_id, home_id, away_id, min(CAST(ts AS DATE)) AS game_date, "
    "max(home_points) AS home_top, max(away_points) AS away_top FROM staged GROUP BY ALL), "
    "log_sides AS (SELECT * FROM log_games CROSS JOIN (VALUES ('home'), ('away')) s(side)), "
    f"game_log AS MATERIALIZED (SELECT {columns_sql(GAME_LOG_COLUMNS)} FROM log_sides)"
)
# The single-pass form of the index: no join.
INDEX = (
    f"{GAME_LOG}, idx AS MATERIALIZED (SELECT season, GAME_ID AS game_id, "
    "max(CASE WHEN MATCHUP NOT LIKE '%@%' THEN GAME_DATE END) AS GAME_DATE, "
    "max(CASE WHEN MATCHUP NOT LIKE '%@%' THEN TEAM_ID END) AS home_team_id, "
    "max(CASE WHEN MATCHUP NOT LIKE '%@%' THEN TEAM_ABBREVIATION END) AS home_team, "
    "max(CASE WHEN MATCHUP NOT LIKE '%@%' THEN PTS END) AS home_pts, "
    "max(CASE WHEN MATCHUP LIKE '%@%' THEN TEAM_ID END) AS away_team_id, "
    "max(CASE WHEN MATCHUP LIKE '%@%' THEN TEAM_ABBREVIATION END) AS away_team, "
    "max(CASE WHEN MATCHUP LIKE '%@%' THEN PTS END) AS away_pts, "
    "CAST(max(CASE WHEN MATCHUP NOT LIKE '%@%' THEN PTS END) > max(CASE WHEN MATCHUP LIKE '%@%' THEN PTS END) AS INT) AS home_win "
    "FROM game_log GROUP BY season, GAME_ID)"
)
ACTIONS_AND_INDEX = f"{INDEX}, acts AS MATERIALIZED (SELECT {columns_sql(ACTION_COLUMNS)} FROM staged)"


def normalized(name: str = "norm", source: str = "acts") -> str:
    """CTEs that normalize the actions of ``source``."""
    return f"""{name}_t AS (SELECT *, {trim('actionType')} AS action_type, {trim('subType')} AS sub_type,
        {trim('description')} AS event_text, {trim('shotResult')} AS shot_text, {trim('clock')} AS clock_text,
        {trim('scoreHome')} AS sh, {trim('scoreAway')} AS sa,
        CASE WHEN teamId > 0 THEN teamId END AS team_id FROM {source}),
    {name}_c AS (SELECT *, CASE WHEN action_type <> '' THEN lower(action_type)
            WHEN upper(event_text) LIKE '% STEAL%' OR upper(event_text) LIKE '% BLOCK%' THEN 'credit' ELSE 'metadata' END AS category,
        TRY_CAST(regexp_extract(lower(sub_type), '(\\d+)\\s+of\\s+(\\d+)', 1) AS INT) AS ft_attempt,
        TRY_CAST(regexp_extract(lower(sub_type), '(\\d+)\\s+of\\s+(\\d+)', 2) AS INT) AS ft_total,
        (lower(sub_type) LIKE '%technical%' OR lower(sub_type) LIKE '%flagrant%' OR lower(sub_type) LIKE '%clear path%') AS is_special_ft,
        CAST(regexp_extract(clock_text, '^PT(\\d+)M', 1) AS DOUBLE) * 60
            + CAST(regexp_extract(clock_text, 'M(\\d+(\\.\\d+)?)S$', 1) AS DOUBLE) AS seconds,
        CAST(trunc(TRY_CAST(NULLIF(sh, '') AS DOUBLE)) AS INT) AS hv, CAST(trunc(TRY_CAST(NULLIF(sa, '') AS DOUBLE)) AS INT) AS av
        FROM {name}_t),
    {name} AS MATERIALIZED (SELECT *,
        CASE WHEN category = 'free throw' THEN CASE WHEN shot_text <> '' THEN lower(shot_text) = 'made'
            ELSE NOT upper(event_text) LIKE 'MISS %' END END AS is_made,
        category = 'foul' AND lower(sub_type) NOT IN ('offensive', 'offensive charge', 'technical', 'double technical',
            'delay technical', 'non-unsportsmanlike technical', 'hanging technical', 'too many players technical',
            'excess timeout technical', 'defense 3 second', 'flopping', 'bench') AS foul_counts,
        CASE WHEN category = 'foul' THEN TRY_CAST(regexp_extract(upper(event_text), '\\.T(\\d+)\\)', 1) AS INT) END AS marker,
        NOT (category = 'instant replay' AND lower(sub_type) NOT LIKE '%overturn%') AS authoritative,
        NOT (category = 'instant replay' AND lower(sub_type) NOT LIKE '%overturn%') AND (sh <> '' OR sa <> '') AS has_score
        FROM {name}_c)"""


_NEUTRAL = (
    "'technical', 'double technical', 'delay technical', 'non-unsportsmanlike technical', 'hanging technical', "
    "'too many players technical', 'excess timeout technical', 'defense 3 second', 'flopping', 'bench'"
)


def tracked(name: str = "trk", norm: str = "norm", index: str = "idx", index_on: str = "season, game_id") -> str:
    """CTEs that walk each game one action at a time. Needs WITH RECURSIVE."""
    return f"""{name}_in AS MATERIALIZED (SELECT a.*, x.home_team_id, x.away_team_id, x.home_pts, x.away_pts, x.home_win,
            a.has_score AND a.actionNumber < coalesce((SELECT max(b.actionNumber) FROM {norm} b
                WHERE b.season = a.season AND b.game_id = a.game_id AND b.period = a.period AND b.clock_text = a.clock_text
                AND b.has_score AND b.source_event_index < a.source_event_index), -1) AS late
        FROM {norm} a JOIN {index} x USING ({index_on})),
    {name}_walk AS (
        SELECT DISTINCT season, game_id, CAST(-1 AS INT) AS source_event_index, CAST(NULL AS INT) AS period, 0 AS hs, 0 AS as_,
            CAST(NULL AS BIGINT) AS team, CAST('game start unknown' AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS pend,
            0 AS hf, 0 AS af, CAST(NULL AS VARCHAR) AS shown, false AS emitted
        FROM {name}_in
        UNION ALL
        SELECT season, game_id, source_event_index, period, nhs, nas, nteam, nreason, npend, nhf, naf,
            concat_ws('/', nhs, nas, period, seconds, coalesce(nteam, -1), nhf, naf),
            concat_ws('/', nhs, nas, period, seconds, coalesce(nteam, -1), nhf, naf) IS DISTINCT FROM p_shown
        FROM (SELECT *,
            CASE WHEN takes THEN ch ELSE p_hs END AS nhs, CASE WHEN takes THEN ca ELSE p_as END AS nas,
            CASE WHEN foul_counts AND team_id = home_team_id THEN r_hf + 1 ELSE r_hf END AS nhf,
            CASE WHEN foul_counts AND team_id = away_team_id THEN r_af + 1 ELSE r_af END AS naf,
            CASE WHEN category = 'period' AND lower(sub_type) = 'end' THEN NULL
                WHEN category = 'jump ball' THEN NULL
                WHEN category IN ('made shot', 'turnover') THEN opp
                WHEN category = 'missed shot' THEN own
                WHEN category = 'rebound' THEN CASE WHEN r_pend IS NULL OR team_id IS NULL THEN NULL ELSE own END
                WHEN category = 'foul' AND lower(sub_type) NOT IN ({_NEUTRAL}) THEN opp
                WHEN category = 'free throw' AND ft = 'unparsed' THEN NULL
                WHEN category = 'free throw' AND ft IN ('continues', 'retained', 'missed') THEN own
                WHEN category = 'free throw' AND ft = 'made' THEN opp
                ELSE r_team END AS nteam,
            CASE WHEN category = 'period' AND lower(sub_type) = 'end' THEN 'period ended'
                WHEN category = 'jump ball' THEN 'jump ball winner ambiguous'
                WHEN category = 'made shot' THEN 'made field goal'
                WHEN category = 'turnover' THEN 'turnover'
                WHEN category = 'missed shot' THEN 'missed field goal awaiting rebound'
                WHEN category = 'rebound' THEN CASE WHEN r_pend IS NULL OR team_id IS NULL
                    THEN 'rebound ownership or associated miss ambiguous'
                    WHEN team_id = r_pend THEN 'offensive rebound' ELSE 'defensive rebound' END
                WHEN category = 'foul' AND lower(sub_type) NOT IN ({_NEUTRAL})
                    THEN coalesce(nullif(lower(sub_type), ''), 'untyped') || ' foul'
                WHEN category = 'free throw' AND ft = 'unparsed' THEN 'unparseable free throw sequence'
                WHEN category = 'free throw' AND ft = 'continues' THEN 'free throw sequence continues'
                WHEN category = 'free throw' AND ft = 'retained' THEN 'special free throws retain possession'
                WHEN category = 'free throw' AND ft = 'made' THEN 'final free throw made'
                WHEN category = 'free throw' AND ft = 'missed' THEN 'final free throw missed awaiting rebound'
                ELSE r_reason END AS nreason,
            CASE WHEN category = 'period' AND lower(sub_type) = 'end' THEN NULL
                WHEN category IN ('jump ball', 'made shot', 'turnover', 'rebound') THEN NULL
                WHEN category = 'missed shot' THEN team_id
                WHEN category = 'free throw' AND ft IN ('technical', 'continues', 'retained', 'made') THEN NULL
                WHEN category = 'free throw' AND ft = 'missed' THEN team_id
                ELSE r_pend END AS npend
            FROM (SELECT *, authoritative AND NOT coalesce(late, false)
                    AND (category <> 'period' OR (ch >= p_hs AND ca >= p_as)) AS takes
                FROM (SELECT a.*, w.hs AS p_hs, w.as_ AS p_as, w.shown AS p_shown,
                    coalesce(a.hv, w.hs) AS ch, coalesce(a.av, w.as_) AS ca,
                    CASE WHEN w.period IS DISTINCT FROM a.period THEN NULL ELSE w.team END AS r_team,
                    CASE WHEN w.period IS DISTINCT FROM a.period THEN 'period start unknown' ELSE w.reason END AS r_reason,
                    CASE WHEN w.period IS DISTINCT FROM a.period THEN NULL ELSE w.pend END AS r_pend,
                    CASE WHEN w.period IS DISTINCT FROM a.period THEN 0 ELSE w.hf END AS r_hf,
                    CASE WHEN w.period IS DISTINCT FROM a.period THEN 0 ELSE w.af END AS r_af,
                    CASE WHEN a.team_id IN (a.home_team_id, a.away_team_id) THEN a.team_id END AS own,
                    CASE WHEN a.team_id = a.home_team_id THEN a.away_team_id WHEN a.team_id = a.away_team_id THEN a.home_team_id END AS opp,
                    CASE WHEN lower(a.sub_type) LIKE '%technical%' THEN 'technical'
                        WHEN a.ft_attempt IS NULL OR a.ft_total IS NULL THEN 'unparsed'
                        WHEN a.ft_attempt < a.ft_total THEN 'continues'
                        WHEN lower(a.sub_type) LIKE '%flagrant%' OR lower(a.sub_type) LIKE '%clear path%' THEN 'retained'
                        WHEN a.is_made THEN 'made' ELSE 'missed' END AS ft
                    FROM {name}_walk w JOIN {name}_in a ON a.season = w.season AND a.game_id = w.game_id
                        AND a.source_event_index = w.source_event_index + 1)))),
    {name} AS MATERIALIZED (SELECT a.*, w.hs AS home_score, w.as_ AS away_score, w.team AS possession_team_id,
            w.reason AS possession_reason, w.pend AS pending_after, w.hf AS home_fouls, w.af AS away_fouls, w.emitted,
            CASE WHEN a.marker IS NOT NULL THEN CASE WHEN a.team_id = a.home_team_id THEN w.hf
                WHEN a.team_id = a.away_team_id THEN w.af END END AS marker_reconstructed,
            CASE WHEN a.marker IS NOT NULL AND a.team_id IN (a.home_team_id, a.away_team_id) THEN
                CAST(a.marker = CASE WHEN a.team_id = a.home_team_id THEN w.hf ELSE w.af END AS INT) END AS marker_matches
        FROM {name}_in a JOIN {name}_walk w USING (season, game_id, source_event_index))"""


STATE_SELECT = f"""season, game_id, source_event_index, actionNumber AS action_number,
    NULLIF({trim('actionId')}, '') AS action_id, clock_text AS clock, action_type, sub_type, category AS semantic_event,
    event_text AS description, home_team_id, away_team_id, home_score, away_score, home_score - away_score AS score_differential,
    period, seconds AS seconds_remaining_period,
    CASE WHEN period <= 4 THEN (4 - period) * 720 + seconds ELSE CAST(0 AS DOUBLE) END AS seconds_remaining_regulation,
    CAST(period >= 5 AS INT) AS is_overtime, greatest(period - 4, 0) AS overtime_number, possession_team_id,
    CASE WHEN possession_team_id = home_team_id THEN 1 WHEN possession_team_id = away_team_id THEN 0 END AS home_possession,
    CAST(possession_team_id IS NOT NULL AS INT) AS possession_known, possession_reason,
    home_fouls AS home_team_fouls_period, away_fouls AS away_team_fouls_period, marker AS foul_marker_team_count,
    marker_matches AS foul_marker_matches, home_win"""

TRACKED = f"{ACTIONS_AND_INDEX}, {normalized()}, {tracked()}"
STATES = f"{TRACKED}, states AS MATERIALIZED (SELECT {STATE_SELECT} FROM trk WHERE emitted)"


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"

# --- Live -------------------------------------------------------------------------------

LIVE = (
    f"{INDEX}, copies AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY copy, i) - 1 AS place FROM staged "
    "CROSS JOIN (VALUES (0), (1)) c(copy) WHERE copy = 0 OR event_id % 11 = 4), "
    f"live AS MATERIALIZED (SELECT {columns_sql(LIVE_COLUMNS)} FROM copies)"
)


def title(c: str) -> str:
    """First letter of every word up."""
    return f"array_to_string([upper(w[1]) || w[2:] for w in string_split(lower({c}), ' ')], ' ')"


_K = "lower(" + trim("actionType") + ")"
_S = trim("subType")
_D = "lower(" + trim("descriptor") + ")"
_SHOT = f"lower({trim('shotResult')})"
LIVE_TYPE = (
    f"CASE {_K} WHEN '2pt' THEN CASE WHEN {_SHOT} = 'made' THEN 'Made Shot' ELSE 'Missed Shot' END "
    f"WHEN '3pt' THEN CASE WHEN {_SHOT} = 'made' THEN 'Made Shot' ELSE 'Missed Shot' END "
    "WHEN 'freethrow' THEN 'Free Throw' WHEN 'rebound' THEN 'Rebound' WHEN 'turnover' THEN 'Turnover' WHEN 'foul' THEN 'Foul' "
    "WHEN 'jumpball' THEN 'Jump Ball' WHEN 'period' THEN 'period' WHEN 'substitution' THEN 'Substitution' "
    "WHEN 'timeout' THEN 'Timeout' WHEN 'violation' THEN 'Violation' ELSE '' END"
)
LIVE_FOUL = (
    f"CASE WHEN lower({_S}) = 'offensive' AND {_D} = 'charge' THEN 'Offensive Charge' WHEN lower({_S}) = 'offensive' THEN 'Offensive' "
    f"WHEN lower({_S}) = 'personal' AND {_D} = 'shooting' THEN 'Shooting' WHEN lower({_S}) = 'personal' AND {_D} = 'loose ball' "
    f"THEN 'Loose Ball' WHEN lower({_S}) = 'personal' THEN 'Personal' ELSE {title(f'trim({_D} || chr(32) || {_S})')} END"
)
_FOUND = f"lower({_D} || ' ' || coalesce(array_to_string(qualifiers, ' '), ''))"
LIVE_FT = (
    f"'Free Throw' || CASE WHEN {_FOUND} LIKE '%technical%' THEN ' technical' ELSE '' END "
    f"|| CASE WHEN {_FOUND} LIKE '%flagrant%' THEN ' flagrant' ELSE '' END "
    f"|| CASE WHEN {_FOUND} LIKE '%clear path%' THEN ' clear path' ELSE '' END || CASE WHEN {_S} = '' THEN '' ELSE ' ' || {_S} END"
)
LIVE_SUBTYPE = (
    f"CASE WHEN {_K} IN ('2pt', '3pt', 'substitution') THEN {_S} WHEN {_K} = 'freethrow' THEN {LIVE_FT} "
    f"WHEN {_K} = 'foul' THEN {LIVE_FOUL} WHEN {_K} = 'period' THEN lower({_S}) "
    f"WHEN {_K} IN ('rebound', 'turnover', 'jumpball', 'timeout', 'violation') THEN {title(_S)} ELSE '' END"
)
ADAPTED = f"""CAST(coalesce(actionNumber, orderNumber, source_index) AS BIGINT) AS sequence,
    CAST(coalesce(orderNumber, actionNumber, source_index) AS VARCHAR) AS event_id, period, {trim('clock')} AS clock,
    CASE WHEN teamId > 0 THEN teamId END AS team_id, {trim('teamTricode')} AS team_tricode, {LIVE_TYPE} AS action_type,
    {LIVE_SUBTYPE} AS sub_type, {trim('description')} AS description, {trim('scoreHome')} AS score_home,
    {trim('scoreAway')} AS score_away, {trim('shotResult')} AS shot_result,
    CASE WHEN possession > 0 THEN possession END AS source_possession_team_id, {trim('actionType')} AS source_action_type,
    {_S} AS source_action_subtype"""
LIVE_DEDUPED = (
    f"{LIVE}, live_one AS (SELECT * FROM live QUALIFY (orderNumber IS NULL AND actionNumber IS NULL) "
    "OR row_number() OVER (PARTITION BY game_id, orderNumber, actionNumber ORDER BY source_index DESC) = 1)"
)
_PLACE = (
    "CAST(row_number() OVER (PARTITION BY game_id ORDER BY orderNumber IS NULL, CASE WHEN orderNumber IS NULL OR orderNumber = 0 "
    "THEN source_index ELSE orderNumber END, source_index) - 1 AS INT)"
)
LIVE_ACTIONS = (
    f"{LIVE_DEDUPED}, live_at AS (SELECT *, {_PLACE} AS source_event_index FROM live_one), "
    "acts AS MATERIALIZED (SELECT 'live' AS season, game_id, source_event_index, event_id AS actionId, sequence AS actionNumber, "
    "action_type AS actionType, sub_type AS subType, clock, period, team_id AS teamId, team_tricode AS teamTricode, description, "
    "score_home AS scoreHome, score_away AS scoreAway, shot_result AS shotResult FROM "
    f"(SELECT game_id, source_index, source_event_index, {ADAPTED} FROM live_at)), "
    "live_idx AS (SELECT 'live' AS season, game_id, home_team_id, away_team_id, CAST(NULL AS INT) AS home_pts, "
    "CAST(NULL AS INT) AS away_pts, CAST(NULL AS INT) AS home_win FROM idx)"
)
LIVE_STATES = (
    f"{LIVE_ACTIONS}, {normalized('lnorm', 'acts')}, {tracked('ltrk', 'lnorm', 'live_idx')}, "
    f"live_states AS MATERIALIZED (SELECT {STATE_SELECT} FROM ltrk WHERE emitted)"
)
BOTH_STATES = (
    f"{LIVE_STATES}, hacts AS MATERIALIZED (SELECT {columns_sql(ACTION_COLUMNS)} FROM staged), "
    f"{normalized('norm', 'hacts')}, {tracked()}, states AS MATERIALIZED (SELECT {STATE_SELECT} FROM trk WHERE emitted)"
)

# --- Scoreboard and scored states -------------------------------------------------------

BOARD = (
    f"{STAGED}, board_games AS (SELECT user_id, game_id, home_id, away_id, min(CAST(ts AS DATE)) AS game_date, "
    "max(home_points) AS home_top, max(away_points) AS away_top FROM staged GROUP BY ALL), "
    f"board AS MATERIALIZED (SELECT {columns_sql(BOARD_COLUMNS)} FROM board_games)"
)
_BOARD_ONLY = BOARD[len(STAGED) + 2 :]
STATES_AND_BOARD = f"{STATES}, {_BOARD_ONLY}"
SCORED = (
    f"{STATES}, scored AS MATERIALIZED (SELECT *, greatest(0, least(1, CAST(50 + score_differential * period AS DOUBLE) / 100)) "
    "AS probability FROM states)"
)
SCORED_AND_BOARD = f"{SCORED}, {_BOARD_ONLY}"

"""Fixed values of the data contract. Results depend on them being exactly these."""

from __future__ import annotations

# --- Fixed values: foul subtypes ------------------------------------------------------
# Fouls that do not move possession.
POSSESSION_NEUTRAL_FOULS = (
    "technical",
    "double technical",
    "delay technical",
    "non-unsportsmanlike technical",
    "hanging technical",
    "too many players technical",
    "excess timeout technical",
    "defense 3 second",
    "flopping",
    "bench",
)
# Fouls that do not count toward the team total of the period.
UNCOUNTED_FOULS = ("offensive", "offensive charge", *POSSESSION_NEUTRAL_FOULS)

# --- Fixed values: patterns -----------------------------------------------------------
CLOCK_PATTERN = r"^PT(\d+)M(\d+(?:\.\d+)?)S$"
SCORE_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FREE_THROW_PATTERN = r"(?i)(\d+)\s+of\s+(\d+)"
FOUL_MARKER_PATTERN = r"(?i)\.T(\d+)\)"
GAME_ID_PATTERN = r"^\d{10}$"
SPECIAL_FREE_THROWS = ("technical", "flagrant", "clear path")

# --- Fixed values: game length --------------------------------------------------------
PERIOD_SECONDS = 720
OVERTIME_SECONDS = 300
REGULATION_PERIODS = 4

# --- Fixed values: validation ---------------------------------------------------------
MINIMUM_EVENTS = 50
MINIMUM_CLOCK_SHARE = 0.95
MINIMUM_TYPE_SHARE = 0.5
REQUIRED_ACTION_KEYS = ("period", "clock", "actionType")

# --- Fixed values: splits and model inputs --------------------------------------------
SPLIT_SEASONS = {"train": "2021-22", "validation": "2022-23", "test": "2023-24"}
MODEL_FEATURES = (
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
)
UNSCALED_FEATURES = ("home_possession", "is_overtime", "possession_known")
TARGET = "home_win"
UNKNOWN_POSSESSION_VALUE = 0.5

# --- Fixed values: histogram and slice labels -----------------------------------------
TIME_BINS = ((120, "0-2m"), (360, "2-6m"), (720, "6-12m"), (1440, "12-24m"), (2160, "24-36m"), (None, ">36m"))
SCORE_BINS = ((2, "0-2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (None, "20+"))
PERIOD_BUCKETS = ("Q1", "Q2", "Q3", "Q4", "OT")

# --- Fixed values: live vocabulary ----------------------------------------------------
LIVE_TYPES = {
    "freethrow": "Free Throw",
    "rebound": "Rebound",
    "turnover": "Turnover",
    "foul": "Foul",
    "jumpball": "Jump Ball",
    "period": "period",
    "substitution": "Substitution",
    "timeout": "Timeout",
    "violation": "Violation",
}

# --- Fixed values: parity -------------------------------------------------------------
PARITY_FIELDS = (
    "period",
    "clock",
    "home_score",
    "away_score",
    "score_differential",
    "seconds_remaining_period",
    "seconds_remaining_regulation",
    "is_overtime",
    "overtime_number",
    "home_team_fouls_period",
    "away_team_fouls_period",
    "possession_team_id",
    "possession_known",
)
PARITY_ANCHOR = ("period", "clock", "home_score", "away_score")

# --- Fixed values: fixture categories -------------------------------------------------
FIXTURE_CATEGORIES = (
    "period",
    "jump ball",
    "made shot",
    "missed shot",
    "rebound",
    "free throw",
    "foul",
    "turnover",
    "timeout",
)

# --- Fixed values: columns of the game-state contract ----------------------------------
STATE_COLUMNS = (
    "season",
    "game_id",
    "source_event_index",
    "action_number",
    "action_id",
    "clock",
    "action_type",
    "sub_type",
    "semantic_event",
    "description",
    "home_team_id",
    "away_team_id",
    "home_score",
    "away_score",
    "score_differential",
    "period",
    "seconds_remaining_period",
    "seconds_remaining_regulation",
    "is_overtime",
    "overtime_number",
    "possession_team_id",
    "home_possession",
    "possession_known",
    "possession_reason",
    "home_team_fouls_period",
    "away_team_fouls_period",
    "foul_marker_team_count",
    "foul_marker_matches",
    "home_win",
)

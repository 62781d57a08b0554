"""Clock, period, score and bin expressions, as Spark SQL expression text."""

from __future__ import annotations

from hoopline.functions import fixed_values as fv
from hoopline.functions.events import clean_text


def _checked(value: str, bad: str, message: str, mode: str) -> str:
    """``fail`` raises on a bad row, ``quarantine`` yields null so the caller can set it aside."""
    if mode == "fail":
        return f"CASE WHEN {bad} THEN raise_error({message}) ELSE {value} END"
    if mode == "quarantine":
        return f"CASE WHEN NOT ({bad}) THEN {value} END"
    raise ValueError(f"mode must be 'fail' or 'quarantine', got {mode!r}")


def clock_seconds(text: str) -> str:
    """Seconds of a trimmed ``PT#M#S`` text, null if it is not one. One pattern match, then cuts."""
    minutes = f"try_cast(substring({text}, 3, instr({text}, 'M') - 3) AS DOUBLE)"
    seconds = f"try_cast(substring({text}, instr({text}, 'M') + 1, length({text}) - instr({text}, 'M') - 1) AS DOUBLE)"
    return f"CASE WHEN {text} RLIKE r'{fv.CLOCK_PATTERN}' THEN {minutes} * 60 + {seconds} END"


def checked_clock(seconds: str, text: str, mode: str = "fail") -> str:
    bad = f"{seconds} IS NULL OR {seconds} > {fv.PERIOD_SECONDS}"
    return _checked(seconds, bad, f"'Clock is not a period clock: ' || {text}", mode)


def parse_clock(clock: str, mode: str = "fail") -> str:
    """``PT#M#S`` to seconds left in the period; must match wholly and lie in 0..720."""
    text = clean_text(clock)
    return checked_clock(f"({clock_seconds(text)})", text, mode)


def regulation_seconds(period: str, seconds: str, mode: str = "fail") -> str:
    left = (
        f"CASE WHEN {period} <= {fv.REGULATION_PERIODS} "
        f"THEN ({fv.REGULATION_PERIODS} - {period}) * {fv.PERIOD_SECONDS}D + {seconds} ELSE 0D END"
    )
    bad = f"{period} IS NULL OR {period} < 1"
    return _checked(left, bad, f"'Period must be positive: ' || coalesce(CAST({period} AS STRING), 'null')", mode)


def is_overtime(period: str) -> str:
    return f"CAST({period} > {fv.REGULATION_PERIODS} AS INT)"


def overtime_number(period: str) -> str:
    return f"CAST(greatest({period} - {fv.REGULATION_PERIODS}, 0) AS INT)"


def checked_score(number: str, text: str, mode: str = "fail") -> str:
    """The number a trimmed score text was cast to, cut toward zero; blank gives null."""
    bad = f"{number} IS NULL OR isnan({number}) OR abs({number}) = double('infinity')"
    message = f"'Score is not a number: ' || {text}"
    return f"CASE WHEN {text} <> '' THEN CAST({_checked(number, bad, message, mode)} AS INT) END"


def score_number(text: str) -> str:
    """A trimmed score text as a number. Spark's own cast also takes type letters, so '5d' must be kept out."""
    return f"CASE WHEN {text} RLIKE r'{fv.SCORE_PATTERN}' THEN try_cast({text} AS DOUBLE) END"


def parse_score(score: str, mode: str = "fail") -> str:
    """Score text to int, cut toward zero; blank gives null, meaning 'carry the score forward'."""
    text = clean_text(score)
    return checked_score(score_number(text), text, mode)


def period_label(period: str) -> str:
    return (
        f"CASE WHEN {period} <= 0 THEN 'Pregame' WHEN {period} <= 4 THEN 'Q' || CAST({period} AS STRING) "
        f"ELSE 'OT' || CAST({period} - 4 AS STRING) END"
    )


def period_bucket(period: str) -> str:
    return f"CASE WHEN {period} > 4 THEN 'OT' WHEN {period} BETWEEN 1 AND 4 THEN 'Q' || CAST({period} AS STRING) END"


def _right_closed(value: str, bins: tuple) -> str:
    """Right-closed bins above -1; a value at or below -1 (or null) belongs to none."""
    branches = " ".join(f"WHEN {value} <= {upper} THEN '{label}'" for upper, label in bins if upper is not None)
    return f"CASE WHEN {value} IS NULL OR {value} <= -1 THEN NULL {branches} ELSE '{bins[-1][1]}' END"


def time_bin(seconds_remaining_regulation: str) -> str:
    return _right_closed(seconds_remaining_regulation, fv.TIME_BINS)


def score_bin(score_differential: str) -> str:
    return _right_closed(f"abs({score_differential})", fv.SCORE_BINS)


def elapsed_seconds(period: str, seconds: str) -> str:
    return (
        f"CASE WHEN {period} <= 4 THEN ({period} - 1) * 720 + (720 - {seconds}) "
        f"ELSE 2880 + ({period} - 5) * 300 + (300 - {seconds}) END"
    )


def sigmoid_clip(logit: str) -> str:
    return f"(1D / (1D + exp(-greatest(least({logit}, 50D), -50D))))"


def final_override(status: str, home_score: str, away_score: str) -> str:
    return f"coalesce({status} = 3 AND {home_score} IS NOT NULL AND {away_score} IS NOT NULL, false)"


def display_home_probability(status: str, home_score: str, away_score: str, model: str) -> str:
    """An official final with both scores shows 1 or 0; until then the model's value is shown."""
    shown = f"CAST({home_score} > {away_score} AS DOUBLE)"
    return f"CASE WHEN {final_override(status, home_score, away_score)} THEN {shown} ELSE {model} END"


def possession_label(team: str, home_id: str, home_name: str, away_id: str, away_name: str) -> str:
    return f"CASE WHEN {team} = {home_id} THEN {home_name} WHEN {team} = {away_id} THEN {away_name} ELSE 'Unknown' END"

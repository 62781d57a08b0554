"""Expressions over raw actions.

Every function takes column names (or other expression text) and returns Spark SQL expression
text, to be used with ``F.expr`` or ``selectExpr``. They are built-in expressions only, so they
stay inside code generation, and one text costs one driver call however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.functions import fixed_values as fv


def text_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Every character that counts as white space at the ends of a text.
WHITE_SPACE = (
    r" \t\n\u000b\u000c\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    r"\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def clean_text(c: str) -> str:
    """Null becomes '', all leading and trailing white space goes (``trim`` alone drops blanks only)."""
    return f"btrim(coalesce(CAST({c} AS STRING), ''), '{WHITE_SPACE}')"


def whole_number(c: str) -> str:
    """Integer text (or an integer) to bigint, anything else to null; '100.0' is not an integer."""
    return f"try_cast({clean_text(c)} AS BIGINT)"


def normalize_team_id(c: str) -> str:
    return f"nullif(greatest({whole_number(c)}, 0), 0)"


def event_category(action_type: str, description: str) -> str:
    kind = f"lower({clean_text(action_type)})"
    text = f"upper({clean_text(description)})"
    return (
        f"CASE WHEN {kind} <> '' THEN {kind} WHEN contains({text}, ' STEAL') OR contains({text}, ' BLOCK') "
        "THEN 'credit' ELSE 'metadata' END"
    )


def free_throw_made(category: str, shot_result: str, description: str) -> str:
    result = f"lower({clean_text(shot_result)})"
    return (
        f"CASE WHEN {category} <> 'free throw' THEN NULL WHEN {result} <> '' THEN {result} = 'made' "
        f"ELSE NOT startswith(upper({clean_text(description)}), 'MISS ') END"
    )


def _matched_int(text: str, pattern: str, group: int) -> str:
    return f"try_cast(nullif(regexp_extract({text}, r'{pattern}', {group}), '') AS INT)"


def free_throw_attempt(sub_type: str) -> str:
    return _matched_int(clean_text(sub_type), fv.FREE_THROW_PATTERN, 1)


def free_throw_total(sub_type: str) -> str:
    return _matched_int(clean_text(sub_type), fv.FREE_THROW_PATTERN, 2)


def is_special_free_throw(sub_type: str) -> str:
    return f"lower({clean_text(sub_type)}) RLIKE '{'|'.join(fv.SPECIAL_FREE_THROWS)}'"


def foul_counts(category: str, sub_type: str) -> str:
    return f"({category} = 'foul' AND lower({clean_text(sub_type)}) NOT IN ({text_list(fv.UNCOUNTED_FOULS)}))"


def foul_marker(description: str) -> str:
    return _matched_int(clean_text(description), fv.FOUL_MARKER_PATTERN, 1)


def score_authoritative(category: str, sub_type: str) -> str:
    return f"NOT ({category} = 'instant replay' AND NOT contains(lower({clean_text(sub_type)}), 'overturn'))"


def exprs(columns: dict[str, str]) -> dict:
    """Name to expression text, as ``withColumns`` takes it."""
    return {name: F.expr(text) for name, text in columns.items()}


def is_whole(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")


def normalize_events(actions: DataFrame) -> DataFrame:
    """Raw actions plus the nine derived fields of a normalized event.

    Texts are cleaned once, in a projection of their own, and only then looked into.
    """
    texts = exprs(
        {
            "action_type": clean_text("actionType"),
            "sub_type": clean_text("subType"),
            "event_text": clean_text("description"),
            "shot_text": clean_text("shotResult"),
            "team_id": "CASE WHEN teamId > 0 THEN CAST(teamId AS BIGINT) END"
            if is_whole(actions, "teamId")
            else normalize_team_id("teamId"),
        }
    )
    lowered = exprs({"type_lower": "lower(action_type)", "sub_lower": "lower(sub_type)", "text_upper": "upper(event_text)"})
    special = " OR ".join(f"contains(sub_lower, '{word}')" for word in fv.SPECIAL_FREE_THROWS)

    def part(group: int) -> str:
        return f"CASE WHEN contains(sub_lower, 'of') THEN {_matched_int('sub_lower', fv.FREE_THROW_PATTERN, group)} END"

    derived = exprs(
        {
            "category": "CASE WHEN type_lower <> '' THEN type_lower "
            "WHEN contains(text_upper, ' STEAL') OR contains(text_upper, ' BLOCK') THEN 'credit' ELSE 'metadata' END",
            "ft_attempt": part(1),
            "ft_total": part(2),
            "is_special_ft": special,
        }
    )
    made = (
        "CASE WHEN category <> 'free throw' THEN NULL WHEN shot_text <> '' THEN lower(shot_text) = 'made' "
        "ELSE NOT startswith(text_upper, 'MISS ') END"
    )
    return actions.withColumns(texts).withColumns(lowered).withColumns(derived).withColumn("is_made", F.expr(made))

"""Expressions that map the live vocabulary onto the historical contract."""

from __future__ import annotations

from hoopline.functions import fixed_values as fv
from hoopline.functions.events import clean_text


def canonical_type(action_type: str, shot_result: str) -> str:
    """Historical action type of a live action; unknown live types become blank."""
    kind = f"lower({clean_text(action_type)})"
    branches = " ".join(f"WHEN '{live}' THEN '{name}'" for live, name in fv.LIVE_TYPES.items())
    shot = f"CASE WHEN lower({clean_text(shot_result)}) = 'made' THEN 'Made Shot' ELSE 'Missed Shot' END"
    return f"CASE WHEN {kind} IN ('2pt', '3pt') THEN {shot} ELSE CASE {kind} {branches} ELSE '' END END"


def foul_subtype(sub_type: str, descriptor: str) -> str:
    kind, detail = f"lower({clean_text(sub_type)})", f"lower({clean_text(descriptor)})"
    other = f"initcap(concat_ws(' ', nullif({detail}, ''), nullif({kind}, '')))"
    return (
        f"CASE {kind} WHEN 'offensive' THEN CASE WHEN {detail} = 'charge' THEN 'Offensive Charge' ELSE 'Offensive' END "
        f"WHEN 'personal' THEN CASE {detail} WHEN 'shooting' THEN 'Shooting' WHEN 'loose ball' THEN 'Loose Ball' ELSE 'Personal' END "
        f"ELSE {other} END"
    )


def free_throw_subtype(sub_type: str, descriptor: str, qualifiers: str) -> str:
    """'Free Throw', then the special words found in descriptor or qualifiers, then the subtype."""
    found = f"lower(concat_ws(' ', nullif({clean_text(descriptor)}, ''), nullif(array_join({qualifiers}, ' ', 'None'), '')))"
    words = ", ".join(f"CASE WHEN contains({found}, '{word}') THEN '{word}' END" for word in fv.SPECIAL_FREE_THROWS)
    return f"concat_ws(' ', 'Free Throw', {words}, nullif({clean_text(sub_type)}, ''))"


def canonical_subtype(action_type: str, sub_type: str, descriptor: str, qualifiers: str) -> str:
    kind, raw = f"lower({clean_text(action_type)})", clean_text(sub_type)
    return (
        f"CASE WHEN {kind} IN ('2pt', '3pt', 'substitution') THEN {raw} "
        f"WHEN {kind} = 'freethrow' THEN {free_throw_subtype(sub_type, descriptor, qualifiers)} "
        f"WHEN {kind} = 'foul' THEN {foul_subtype(sub_type, descriptor)} "
        f"WHEN {kind} = 'period' THEN lower({raw}) "
        f"WHEN {kind} IN ('rebound', 'turnover', 'jumpball', 'timeout', 'violation') THEN initcap({raw}) ELSE '' END"
    )

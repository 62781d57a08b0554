"""Score rows as functions that can be put together, as Spark SQL expression text.

What a run of one-sided and period rows does to a score is a function of the score before it. It is kept as a list of thresholds and what is left over: the first
threshold that the score does not exceed on either side gives the result, which no longer depends on the score before; if it exceeds all of them, each side is the last value set,
or the largest of it and the period rows that raise it. Two such functions make one of the same kind. A threshold that an
earlier one covers is never the first and is dropped, and one that leads to the same result as the next, which covers it, is dropped too; so a feed whose period rows rise keeps one threshold, and no feed
keeps more than it has different period scores.
"""

from __future__ import annotations

LOWEST, HIGHEST = "-2147483648", "2147483647"
_ENTRIES = "ARRAY<STRUCT<h: INT, a: INT, oh: INT, oa: INT>>"
#: ``hv``, ``av``: the value set last; ``hm``, ``am``: the largest value that raises the side.
TYPE = f"STRUCT<entries: {_ENTRIES}, hv: INT, hm: INT, av: INT, am: INT>"
_NONE = f"CAST(array() AS {_ENTRIES})"
IDENTITY = f"CAST(named_struct('entries', {_NONE}, 'hv', NULL, 'hm', {LOWEST}, 'av', NULL, 'am', {LOWEST}) AS {TYPE})"


def of_row(op: str) -> str:
    """The function of one score row (``home``, ``away``: shown values or null; ``is_period``)."""
    both = f"{op}.home IS NOT NULL AND {op}.away IS NOT NULL AND {op}.is_period"
    entry = f"array(named_struct('h', {op}.home, 'a', {op}.away, 'oh', {op}.home, 'oa', {op}.away))"
    return f"""CAST(named_struct('entries', CASE WHEN {both} THEN {entry} ELSE {_NONE} END,
        'hv', CASE WHEN NOT {op}.is_period THEN {op}.home END, 'hm', CASE WHEN {op}.is_period AND NOT ({both}) THEN coalesce({op}.home, {LOWEST}) ELSE {LOWEST} END,
        'av', CASE WHEN NOT {op}.is_period THEN {op}.away END, 'am', CASE WHEN {op}.is_period AND NOT ({both}) THEN coalesce({op}.away, {LOWEST}) ELSE {LOWEST} END) AS {TYPE})"""


def _side(f: str, side: str, value: str) -> str:
    return f"coalesce({f}.{side}v, greatest({f}.{side}m, {value}))"


def applied(f: str, home: str, away: str) -> str:
    """The score after ``f``, as a struct of home and away."""
    first = f"filter({f}.entries, q_e -> {home} <= q_e.h AND {away} <= q_e.a)"
    left = f"named_struct('home', {_side(f, 'h', home)}, 'away', {_side(f, 'a', away)})"
    return f"coalesce(get(transform({first}, q_r -> named_struct('home', q_r.oh, 'away', q_r.oa)), 0), {left})"


def composed(f: str, g: str) -> str:
    """The function that does ``f`` and then ``g``."""
    kept = (
        f"transform(transform({f}.entries, q_k -> named_struct('h', q_k.h, 'a', q_k.a, 'o', {applied(g, 'q_k.oh', 'q_k.oa')})), "
        "q_o -> named_struct('h', q_o.h, 'a', q_o.a, 'oh', q_o.o.home, 'oa', q_o.o.away))"
    )
    # A threshold of g, seen from before f where no threshold of f holds; null if it cannot hold.
    bound = lambda side: f"CASE WHEN {f}.{side}v IS NOT NULL THEN CASE WHEN {f}.{side}v <= q_n.{side} THEN {HIGHEST} END WHEN {f}.{side}m <= q_n.{side} THEN q_n.{side} END"
    added = f"filter(transform({g}.entries, q_n -> named_struct('h', {bound('h')}, 'a', {bound('a')}, 'oh', q_n.oh, 'oa', q_n.oa)), q_b -> q_b.h IS NOT NULL AND q_b.a IS NOT NULL)"
    settled = f"{f}.hv IS NOT NULL AND {f}.av IS NOT NULL"
    every = f"concat({kept}, CASE WHEN {settled} THEN {_NONE} ELSE {added} END)"
    last = "element_at(q_l, -1)"
    pruned = f"""aggregate({every}, {_NONE}, (q_l, q_x) -> CASE
        WHEN exists(q_l, q_y -> q_y.h >= q_x.h AND q_y.a >= q_x.a) THEN q_l
        WHEN size(q_l) > 0 AND {last}.oh = q_x.oh AND {last}.oa = q_x.oa AND {last}.h <= q_x.h AND {last}.a <= q_x.a THEN concat(slice(q_l, 1, size(q_l) - 1), array(q_x))
        ELSE concat(q_l, array(q_x)) END)"""
    constant = applied(g, f"{f}.hv", f"{f}.av")
    value = lambda side, name: f"CASE WHEN {settled} THEN {constant}.{name} ELSE coalesce({g}.{side}v, CASE WHEN {f}.{side}v IS NOT NULL THEN greatest({f}.{side}v, {g}.{side}m) END) END"
    raised = lambda side: f"greatest({f}.{side}m, {g}.{side}m)"
    return f"CAST(named_struct('entries', {pruned}, 'hv', {value('h', 'home')}, 'hm', {raised('h')}, 'av', {value('a', 'away')}, 'am', {raised('a')}) AS {TYPE})"


def of_list(functions: str) -> str:
    """All functions of a list, one after the other."""
    return f"aggregate({functions}, {IDENTITY}, (q_f, q_g) -> {composed('q_f', 'q_g')})"


def of_rows(ops: str) -> str:
    return of_list(f"transform({ops}, q_w -> {of_row('q_w')})")

"""Game-state reconstruction: score, clock, possession and team fouls after every action.

The state after an action depends on everything before it in the game's list order, yet no game
is ever handled whole. A game is cut into chunks of ``chunk_rows`` list positions, all windows run
inside one chunk, and what a chunk needs to know of the past (its *carry*) comes from summaries of
the chunks before it, one row each. Games that fit in one chunk, which is nearly all of them, have
no summaries at all, and a game that holds a third of all rows is spread over as many tasks as it
has chunks.

What makes this exact is that every part of the state is a scan with a short summary:

* possession: an action either sets it from its own columns or, if it is a rebound, from the
  pending shooter; the pending shooter is set or cleared from own columns only (a rebound always
  clears it). So both are "the last non-null setter so far".
* a new period segment starts where the period differs from the row before; it works as a setter.
* fouls: a running count, less the count at the last segment start.
* score: the last full snapshot is an anchor; the few rows that depend on the score so far
  (period rows, one-sided snapshots) are folded from there, inside a chunk row by row and over chunks as functions of the score (``score_fold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.functions import clock as ck
from hoopline.functions import events as ev
from hoopline.functions import fixed_values as fv
from hoopline.functions.events import exprs
from hoopline.operators import score_fold as sf

CHUNK_ROWS = 1024
GAME = ["season", "game_id"]
CHUNK = [*GAME, "chunk"]
IDX = "source_event_index"

_IN_CHUNK = f"OVER (PARTITION BY season, game_id, chunk ORDER BY {IDX}"
LAG = f"{_IN_CHUNK})"
SO_FAR = f"{_IN_CHUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = f"{_IN_CHUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

_ALONG = "OVER (PARTITION BY season, game_id ORDER BY chunk"
CHUNK_LAG = f"{_ALONG})"
CHUNKS_SO_FAR = f"{_ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
CHUNKS_BEFORE = f"{_ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def with_game_length(actions: DataFrame) -> DataFrame:
    """Add ``n_events`` where the source did not carry it; list positions are dense from 0."""
    if "n_events" in actions.columns:
        return actions
    lengths = actions.groupBy(*GAME).agg(F.expr(f"CAST(max({IDX}) + 1 AS INT)").alias("n_events"))
    return actions.join(lengths, GAME)


# --- What an action says on its own -----------------------------------------------------

_OWN = "CASE WHEN team_id IN (home_team_id, away_team_id) THEN team_id END"
_OTHER = "CASE WHEN team_id = home_team_id THEN away_team_id WHEN team_id = away_team_id THEN home_team_id END"

# The kinds of free throw, tried in this order; anything left over is a missed final one.
_FT_TECHNICAL = "contains(sub_lower, 'technical')"
_FT_UNPARSED = "ft_attempt IS NULL OR ft_total IS NULL"
_FT_CONTINUES = "ft_attempt < ft_total"
_FT_RETAINED = "contains(sub_lower, 'flagrant') OR contains(sub_lower, 'clear path')"

_CLEARED = "named_struct('team', CAST(NULL AS BIGINT))"
_SHOOTER = "named_struct('team', team_id)"


def _setter(team: str, reason: str) -> str:
    return f"named_struct('team', CAST({team} AS BIGINT), 'reason', {reason})"


_SEGMENT_DEFAULT = _setter("NULL", "'period start unknown'")

# A struct where the action sets the pending shooter (null inside: clears it), else null.
_TOUCH = f"""CASE
    WHEN category = 'period' AND sub_lower = 'end' THEN {_CLEARED}
    WHEN category IN ('jump ball', 'made shot', 'rebound', 'turnover') THEN {_CLEARED}
    WHEN category = 'missed shot' THEN {_SHOOTER}
    WHEN category = 'free throw' THEN CASE
        WHEN {_FT_TECHNICAL} THEN {_CLEARED}
        WHEN {_FT_UNPARSED} THEN NULL
        WHEN {_FT_CONTINUES} OR {_FT_RETAINED} OR is_made THEN {_CLEARED}
        ELSE {_SHOOTER} END
END"""

# A struct where the action sets possession from its own columns, else null. A rebound sets it
# too, but from the pending shooter; see _rebound.
_SETTER = f"""CASE
    WHEN category = 'period' AND sub_lower = 'end' THEN {_setter('NULL', "'period ended'")}
    WHEN category = 'jump ball' THEN {_setter('NULL', "'jump ball winner ambiguous'")}
    WHEN category = 'made shot' THEN {_setter(_OTHER, "'made field goal'")}
    WHEN category = 'missed shot' THEN {_setter(_OWN, "'missed field goal awaiting rebound'")}
    WHEN category = 'turnover' THEN {_setter(_OTHER, "'turnover'")}
    WHEN category = 'foul' AND sub_lower NOT IN ({ev.text_list(fv.POSSESSION_NEUTRAL_FOULS)}) THEN
        {_setter(_OTHER, "CASE WHEN sub_lower = '' THEN 'untyped' ELSE sub_lower END || ' foul'")}
    WHEN category = 'free throw' THEN CASE
        WHEN {_FT_TECHNICAL} THEN NULL
        WHEN {_FT_UNPARSED} THEN {_setter('NULL', "'unparseable free throw sequence'")}
        WHEN {_FT_CONTINUES} THEN {_setter(_OWN, "'free throw sequence continues'")}
        WHEN {_FT_RETAINED} THEN {_setter(_OWN, "'special free throws retain possession'")}
        WHEN is_made THEN {_setter(_OTHER, "'final free throw made'")}
        ELSE {_setter(_OWN, "'final free throw missed awaiting rebound'")} END
END"""


def _rebound(team: str, pending: str) -> str:
    known = f"CASE WHEN {team} IN (home_team_id, away_team_id) THEN {team} END"
    return f"""CASE
        WHEN {pending} IS NULL OR {team} IS NULL THEN {_setter('NULL', "'rebound ownership or associated miss ambiguous'")}
        WHEN {team} = {pending} THEN {_setter(known, "'offensive rebound'")}
        ELSE {_setter(known, "'defensive rebound'")} END"""


def action_facts(actions: DataFrame, index: DataFrame, *, chunk_rows: int = CHUNK_ROWS, mode: str = "fail") -> DataFrame:
    """Normalized actions with the two teams of their game and all columns that need no history.

    ``index`` has one row per game with home_team_id and away_team_id; a game without one is an
    error. Spark broadcasts it only if its size is below ``autoBroadcastJoinThreshold``.
    """
    wanted = [c for c in ("home_team_id", "away_team_id", "home_pts", "away_pts", "home_win") if c in index.columns]
    joined = ev.normalize_events(with_game_length(actions)).join(index.select(*GAME, *wanted), GAME, "left")
    if mode == "quarantine":
        joined = joined.where(f"size({_quarantine_reasons()}) = 0")
    home = (
        "CASE WHEN home_team_id IS NULL OR away_team_id IS NULL "
        "THEN raise_error('Game has no index row: ' || game_id) ELSE home_team_id END"
    )
    number = "CAST(actionNumber AS INT)" if ev.is_whole(actions, "actionNumber") else f"CAST({ev.whole_number('actionNumber')} AS INT)"
    texts = joined.withColumns(
        exprs(
            {
                "home_team_id": home,
                "chunk": f"CAST(floor({IDX} / {chunk_rows}) AS BIGINT)",
                "has_next_chunk": f"(floor({IDX} / {chunk_rows}) + 1) * {chunk_rows} < n_events",
                "clock_text": ev.clean_text("clock"),
                "home_text": ev.clean_text("scoreHome"),
                "away_text": ev.clean_text("scoreAway"),
                "action_no": number,
                "marker": f"CASE WHEN category = 'foul' THEN {ev.foul_marker('event_text')} END",
                "foul_counts": f"category = 'foul' AND sub_lower NOT IN ({ev.text_list(fv.UNCOUNTED_FOULS)})",
                "authoritative": "NOT (category = 'instant replay' AND NOT contains(sub_lower, 'overturn'))",
            }
        )
    )
    numbers = texts.withColumns(
        exprs(
            {
                "clock_value": ck.clock_seconds("clock_text"),
                "home_value": ck.score_number("home_text"),
                "away_value": ck.score_number("away_text"),
            }
        )
    )
    facts = numbers.withColumns(
        exprs(
            {
                "seconds": ck.checked_clock("clock_value", "clock_text", mode),
                "home_shown": ck.checked_score("home_value", "home_text", mode),
                "away_shown": ck.checked_score("away_value", "away_text", mode),
                "has_score": "authoritative AND (home_text <> '' OR away_text <> '')",
                "home_foul": "CASE WHEN foul_counts AND team_id = home_team_id THEN 1 ELSE 0 END",
                "away_foul": "CASE WHEN foul_counts AND team_id = away_team_id THEN 1 ELSE 0 END",
                "touch": _TOUCH,
                "setter": _SETTER,
            }
        )
    )
    return facts


def _quarantine_reasons() -> str:
    """Why an action, joined with the teams of its game, cannot be used; empty if it can."""
    return f"""array_compact(array(
        CASE WHEN home_team_id IS NULL OR away_team_id IS NULL THEN 'game' END,
        CASE WHEN {ck.parse_clock('clock', 'quarantine')} IS NULL THEN 'clock' END,
        CASE WHEN period IS NULL OR period < 1 THEN 'period' END,
        CASE WHEN {ev.clean_text('scoreHome')} <> '' AND {ck.parse_score('scoreHome', 'quarantine')} IS NULL THEN 'home score' END,
        CASE WHEN {ev.clean_text('scoreAway')} <> '' AND {ck.parse_score('scoreAway', 'quarantine')} IS NULL THEN 'away score' END))"""


def quarantined_actions(actions: DataFrame, index: DataFrame) -> DataFrame:
    """The actions that ``mode='quarantine'`` leaves out of the states, with the reasons; all others are used."""
    joined = actions.join(index.select(*GAME, "home_team_id", "away_team_id"), GAME, "left")
    marked = joined.withColumn("quarantine_reasons", F.expr(_quarantine_reasons())).where("size(quarantine_reasons) > 0")
    return marked.select(*actions.columns, "quarantine_reasons")


def unusable_actions(actions: DataFrame) -> DataFrame:
    """The actions that ``quarantined_actions`` lists whatever their game, by their own columns."""
    known = actions.withColumns({"home_team_id": F.lit(0), "away_team_id": F.lit(0)})
    return known.where(f"size({_quarantine_reasons()}) > 0").drop("home_team_id", "away_team_id")


# --- Scores -----------------------------------------------------------------------------

_CLOCK_KEY = "concat_ws('|', CAST(period AS STRING), clock_text)"
_NO_SCORE = "named_struct('home', 0, 'away', 0)"


def clock_carry(facts: DataFrame) -> DataFrame:
    """Per chunk of a long game: the highest action number that earlier chunks showed per clock."""
    seen = facts.where("has_score AND action_no IS NOT NULL")
    tops = seen.groupBy(*CHUNK, F.expr(_CLOCK_KEY).alias("at")).agg(F.expr("max(action_no)").alias("top"))
    carried = tops.selectExpr(
        *CHUNK,
        "at",
        "max(top) OVER (PARTITION BY season, game_id, at ORDER BY chunk "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_top",
    ).where("earlier_top IS NOT NULL")
    return carried.groupBy(*CHUNK).agg(F.expr("map_from_entries(collect_list(struct(at, earlier_top)))").alias("clock_tops"))


def _with_score_parts(facts: DataFrame) -> DataFrame:
    """Add out_of_order, anchor (a full snapshot) and op (a row that depends on the score so far).

    A snapshot is out of order if an earlier one at the same period and clock text has a higher
    action number; rejected snapshots count toward that maximum, ignored replays do not.
    """
    local = (
        f"max(CASE WHEN has_score THEN action_no END) OVER (PARTITION BY season, game_id, chunk, period, clock_text "
        f"ORDER BY {IDX} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    snapshot = f"named_struct('at', {IDX}, 'home', home_shown, 'away', away_shown, 'is_period', category = 'period')"
    full = "home_shown IS NOT NULL AND away_shown IS NOT NULL AND category <> 'period'"
    return (
        facts.withColumn("prior_action_no", F.expr(f"coalesce(greatest({local}, try_element_at(clock_tops, {_CLOCK_KEY})), -1)"))
        .withColumn("out_of_order", F.expr("coalesce(has_score AND action_no < prior_action_no, false)"))
        .withColumns(
            exprs(
                {
                    "anchor": f"CASE WHEN has_score AND NOT out_of_order AND {full} THEN {snapshot} END",
                    "op": f"CASE WHEN has_score AND NOT out_of_order AND NOT ({full}) THEN {snapshot} END",
                }
            )
        )
    )


def _fold(start: str, ops: str) -> str:
    """Apply score rows in order. A period row counts only if neither side would fall."""
    step = (
        "CASE WHEN NOT op.is_period OR (coalesce(op.home, score.home) >= score.home AND coalesce(op.away, score.away) >= score.away) "
        "THEN named_struct('home', coalesce(op.home, score.home), 'away', coalesce(op.away, score.away)) ELSE score END"
    )
    return f"aggregate({ops}, {start}, (score, op) -> {step})"


def _score_of(snapshot: str) -> str:
    return f"CASE WHEN {snapshot} IS NOT NULL THEN named_struct('home', {snapshot}.home, 'away', {snapshot}.away) END"


# --- Carry between the chunks of long games ---------------------------------------------


def _chunk_summaries(facts: DataFrame) -> DataFrame:
    """One row per chunk that has a successor: all that later chunks need to know of it."""
    rows = _with_score_parts(facts).withColumns(
        exprs(
            {
                "starts": f"coalesce(lag(period) {LAG} <> period, false)",
                "home_sum": f"sum(home_foul) {SO_FAR}",
                "away_sum": f"sum(away_foul) {SO_FAR}",
            }
        )
    )
    rows = rows.withColumn("local_touch", F.expr(f"coalesce(touch, CASE WHEN starts THEN {_CLEARED} END)"))
    rows = rows.withColumn(
        "pending", F.expr(f"CASE WHEN starts THEN {_CLEARED} ELSE last(local_touch, true) {BEFORE} END")
    )
    # A rebound before any other touch of the chunk stays open until the carry is known.
    resolved = f"""CASE WHEN category = 'rebound' THEN CASE WHEN pending IS NOT NULL THEN {_rebound('team_id', 'pending.team')} END
        ELSE coalesce(setter, CASE WHEN starts THEN {_SEGMENT_DEFAULT} END) END"""
    rows = rows.withColumns(exprs({"resolved": resolved, "open": "category = 'rebound' AND pending IS NULL"}))

    def last(value: str, where: str) -> str:
        return f"max_by({value}, CASE WHEN {where} THEN {IDX} END)"

    summary = rows.groupBy(*CHUNK).agg(
        *[
            F.expr(text).alias(name)
            for name, text in {
                "home_team_id": "first(home_team_id)",
                "away_team_id": "first(away_team_id)",
                "first_period": f"min_by(period, {IDX})",
                "last_period": f"max_by(period, {IDX})",
                "last_seconds": f"max_by(seconds, {IDX})",
                "last_touch": last("local_touch", "local_touch IS NOT NULL"),
                "last_setter": last(
                    "named_struct('team', resolved.team, 'reason', resolved.reason, 'open', open, 'rebounder', team_id)",
                    "open OR resolved IS NOT NULL",
                ),
                "home_total": "sum(home_foul)",
                "away_total": "sum(away_foul)",
                "start_sums": last("named_struct('home', home_sum - home_foul, 'away', away_sum - away_foul)", "starts"),
                "last_anchor": last("anchor", "anchor IS NOT NULL"),
                "ops": "array_sort(collect_list(op))",
            }.items()
        ]
    )
    # Only ops after the last full snapshot still matter; as one function of the score they have a small size whatever their number.
    return summary.withColumn("fold", F.expr(sf.of_rows("filter(ops, op -> op.at > coalesce(last_anchor.at, -1))"))).drop("ops")


#: Chunks, and then blocks of chunks, that are put together in one row.
FOLDED_TOGETHER, FOLD_LEVELS = 64, 2


def _runs(rows: DataFrame, keys: str) -> DataFrame:
    """Per row (``at``; ``fixed``, the score at its end, or ``fold``, what it does to the score) the score at its end, ``const``, if it follows from a fixed one of the
    group of ``keys``; else ``rest``, what the group does to the score up to there."""
    so_far = f"OVER (PARTITION BY {keys} ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    marked = rows.withColumns(exprs({"run": f"last(CASE WHEN fixed IS NOT NULL THEN at END, true) {so_far}", "since": f"last(fixed, true) {so_far}"}))
    in_run = f"OVER (PARTITION BY {keys}, run ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = marked.withColumn("folds", F.expr(f"collect_list(CASE WHEN fixed IS NULL THEN fold END) {in_run}")).withColumn("done", F.expr(sf.of_list("folds")))
    return whole.withColumns(
        exprs({"const": f"CASE WHEN since IS NOT NULL THEN {sf.applied('done', 'since.home', 'since.away')} END", "rest": "CASE WHEN since IS NULL THEN done END"})
    ).drop("run", "since", "folds", "done", "fixed", "fold")


def _end_scores(linked: DataFrame) -> DataFrame:
    """The score at the end of every chunk. A game's first chunk is fixed, so all scores are known once blocks of chunks, and blocks of those, are put together.

    A row holds the functions of ``FOLDED_TOGETHER`` chunks or blocks at most; on top, of one block in 4,096 chunks.
    """
    level = linked.selectExpr(*GAME, "chunk AS at", "fixed_score AS fixed", "fold")
    parts = []
    for _ in range(FOLD_LEVELS):
        inside = _runs(level.withColumn("block", F.expr(f"CAST(floor(at / {FOLDED_TOGETHER}) AS BIGINT)")), "season, game_id, block")
        parts.append(inside)
        last = inside.groupBy(*GAME, "block").agg(F.expr("max_by(struct(const, rest), at)").alias("e"))
        level = last.selectExpr(*GAME, "block AS at", "e.const AS fixed", "e.rest AS fold")
    ends = _runs(level, "season, game_id").selectExpr(*GAME, "at", "const AS score")
    for inside in reversed(parts):
        starts = ends.selectExpr(*GAME, "at + 1 AS block", "score AS start")
        ends = inside.join(starts, [*GAME, "block"], "left").selectExpr(*GAME, "at", f"coalesce(const, {sf.applied('rest', 'start.home', 'start.away')}) AS score")
    return ends.withColumnRenamed("at", "chunk")


def chunk_carries(facts: DataFrame) -> DataFrame:
    """The state at the start of every chunk but a game's first, from the chunks before it."""
    # A chunk with a full snapshot, like a game's first chunk, fixes the score on its own.
    fixed = sf.applied("fold", "coalesce(last_anchor.home, 0)", "coalesce(last_anchor.away, 0)")
    linked = _chunk_summaries(facts.where("has_next_chunk")).withColumns(
        exprs(
            {
                "starts": f"coalesce(lag(last_period) {CHUNK_LAG} <> first_period, true)",
                "home_before": f"coalesce(sum(home_total) {CHUNKS_BEFORE}, 0)",
                "away_before": f"coalesce(sum(away_total) {CHUNKS_BEFORE}, 0)",
                "fixed_score": f"CASE WHEN last_anchor IS NOT NULL OR chunk = 0 THEN {fixed} END",
            }
        )
    )
    linked = linked.withColumns(
        exprs(
            {
                "touch_out": f"coalesce(last_touch, CASE WHEN starts THEN {_CLEARED} END)",
            }
        )
    )
    linked = linked.withColumn("pending_in", F.expr(f"last(touch_out, true) {CHUNKS_BEFORE}"))
    linked = linked.withColumn("pending_team", F.expr("CASE WHEN NOT starts THEN pending_in.team END"))
    linked = linked.join(_end_scores(linked), CHUNK)
    linked = linked.withColumns(
        exprs(
            {
                "setter_out": f"""CASE WHEN last_setter.open THEN {_rebound('last_setter.rebounder', 'pending_team')}
                    WHEN last_setter IS NOT NULL THEN {_setter('last_setter.team', 'last_setter.reason')}
                    WHEN starts THEN {_SEGMENT_DEFAULT} END""",
                "home_base": "CASE WHEN start_sums IS NOT NULL THEN home_before + start_sums.home WHEN starts THEN home_before END",
                "away_base": "CASE WHEN start_sums IS NOT NULL THEN away_before + start_sums.away WHEN starts THEN away_before END",
            }
        )
    )
    return linked.selectExpr(
        *GAME,
        "chunk + 1 AS chunk",
        f"""named_struct(
            'period', last_period,
            'seconds', last_seconds,
            'pending', last(touch_out, true) {CHUNKS_SO_FAR},
            'setter', last(setter_out, true) {CHUNKS_SO_FAR},
            'home_fouls', home_before + home_total - last(home_base, true) {CHUNKS_SO_FAR},
            'away_fouls', away_before + away_total - last(away_base, true) {CHUNKS_SO_FAR},
            'score', score) AS carry""",
    )


# --- The state after every action -------------------------------------------------------


def _visible(score: str, period: str, seconds: str, team: str, home: str, away: str) -> str:
    return (
        f"named_struct('home', {score}.home, 'away', {score}.away, 'period', CAST({period} AS INT), 'seconds', {seconds}, "
        f"'team', {team}, 'home_fouls', CAST({home} AS INT), 'away_fouls', CAST({away} AS INT))"
    )


_CARRIED = _visible("carry.score", "carry.period", "carry.seconds", "carry.setter.team", "carry.home_fouls", "carry.away_fouls")
_CURRENT = _visible("score", "period", "seconds", "possession.team", "home_fouls", "away_fouls")


_CARRY_TYPE = (
    "STRUCT<period: INT, seconds: DOUBLE, pending: STRUCT<team: BIGINT>, setter: STRUCT<team: BIGINT, reason: STRING>, "
    "home_fouls: BIGINT, away_fouls: BIGINT, score: STRUCT<home: INT, away: INT>>"
)


def longest_game(actions: DataFrame) -> int:
    """The most actions any game has; on Parquet this reads one column."""
    return with_game_length(actions).agg(F.max("n_events")).first()[0] or 0


def _with_past(facts: DataFrame, chunk_rows: int, longest: int | None) -> DataFrame:
    """Add to every action the state at the start of its chunk (null in a game's first chunk); rows are dealt by chunk.

    The partitions are not put together again: rows pack so well that tasks of the usual shuffled size hold more of them than two sorts of wide
    rows can keep in memory.
    """
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if longest is not None and longest <= chunk_rows:
        # Every game is one chunk, so nothing is carried; a longer game than promised is an error.
        promise = f"CASE WHEN n_events > {longest} THEN raise_error('Game longer than promised: ' || game_id) ELSE chunk END"
        return facts.withColumns(
            exprs({"chunk": promise, "carry": f"CAST(NULL AS {_CARRY_TYPE})", "clock_tops": "CAST(NULL AS MAP<STRING, INT>)"})
        ).repartition(partitions, *CHUNK)
    # Only games longer than one chunk take part; on Parquet this filter skips row groups.
    long_games = facts.where(f"n_events > {chunk_rows}")
    tops = clock_carry(long_games)
    carries = chunk_carries(long_games.join(tops, CHUNK, "left"))
    return facts.repartition(partitions, *CHUNK).join(carries.join(tops, CHUNK, "full_outer"), CHUNK, "left")


def tracked_actions(
    actions: DataFrame,
    index: DataFrame,
    *,
    chunk_rows: int = CHUNK_ROWS,
    mode: str = "fail",
    longest: int | None = None,
) -> DataFrame:
    """Every action with the state after it; ``emitted`` marks the visible changes.

    ``longest`` is a proven bound on the length of a game, such as ``longest_game`` gives. If it
    is no more than a chunk, the plan has one exchange and no second look at the actions.
    """
    facts = action_facts(actions, index, chunk_rows=chunk_rows, mode=mode)
    # All windows below are keyed by the chunk or finer, so this is the only exchange of the actions.
    placed = _with_past(facts, chunk_rows, longest)
    rows = _with_score_parts(placed).withColumns(
        exprs(
            {
                "segment_starts": f"coalesce(coalesce(lag(period) {LAG}, carry.period) <> period, true)",
                "home_sum": f"sum(home_foul) {SO_FAR}",
                "away_sum": f"sum(away_foul) {SO_FAR}",
                "last_anchor": f"last(anchor, true) {SO_FAR}",
                "ops_so_far": f"collect_list(op) {SO_FAR}",
                "last_op_at": f"last(op.at, true) {SO_FAR}",
            }
        )
    )
    rows = rows.withColumns(
        exprs(
            {
                "touched": f"last(coalesce(touch, CASE WHEN segment_starts THEN {_CLEARED} END), true) {BEFORE}",
                "home_base": f"last(CASE WHEN segment_starts THEN home_sum - home_foul END, true) {SO_FAR}",
                "away_base": f"last(CASE WHEN segment_starts THEN away_sum - away_foul END, true) {SO_FAR}",
            }
        )
    )
    rows = rows.withColumn(
        "pending_team", F.expr("CASE WHEN NOT segment_starts THEN coalesce(touched, carry.pending).team END")
    )
    start = f"coalesce({_score_of('last_anchor')}, carry.score, {_NO_SCORE})"
    own_setter = f"""CASE WHEN category = 'rebound' THEN {_rebound('team_id', 'pending_team')}
        ELSE coalesce(setter, CASE WHEN segment_starts THEN {_SEGMENT_DEFAULT} END) END"""
    rows = rows.withColumns(
        exprs(
            {
                "possession": f"coalesce(last({own_setter}, true) {SO_FAR}, carry.setter)",
                "score": f"""CASE WHEN last_op_at > coalesce(last_anchor.at, -1)
                    THEN {_fold(start, "filter(ops_so_far, op -> op.at > coalesce(last_anchor.at, -1))")} ELSE {start} END""",
                "home_fouls": "CAST(coalesce(home_sum - home_base, home_sum + carry.home_fouls) AS INT)",
                "away_fouls": "CAST(coalesce(away_sum - away_base, away_sum + carry.away_fouls) AS INT)",
            }
        )
    )
    rows = rows.withColumn(
        "emitted",
        F.expr(f"NOT (coalesce(lag({_CURRENT}) {LAG}, CASE WHEN carry IS NOT NULL THEN {_CARRIED} END) <=> {_CURRENT})"),
    )
    kept = [*actions.columns, *(c for c in index.columns if c not in actions.columns and c in rows.columns)]
    added = [
        "n_events", "action_type", "sub_type", "event_text", "category", "team_id", "ft_attempt", "ft_total",
        "is_special_ft", "is_made", "clock_text", "action_no", "marker", "seconds", "out_of_order", "segment_starts",
        "pending_team", "home_fouls", "away_fouls", "emitted",
    ]
    own_count = "CASE WHEN team_id = home_team_id THEN home_fouls WHEN team_id = away_team_id THEN away_fouls END"
    return rows.selectExpr(
        *kept,
        *[c for c in added if c not in kept],
        "score.home AS home_score",
        "score.away AS away_score",
        "possession.team AS possession_team_id",
        "possession.reason AS possession_reason",
        f"CASE WHEN marker IS NOT NULL THEN {own_count} END AS marker_reconstructed",
        f"CAST(marker = {own_count} AS INT) AS marker_matches",
    )


def emitted_states(tracked: DataFrame) -> DataFrame:
    """The 29 columns of a game state, one row per visible change."""
    outcome = "CAST(home_win AS INT)" if "home_win" in tracked.columns else "CAST(NULL AS INT)"
    return tracked.where("emitted").selectExpr(
        "season",
        "game_id",
        IDX,
        "action_no AS action_number",
        f"nullif({ev.clean_text('actionId')}, '') AS action_id",
        "clock_text AS clock",
        "action_type",
        "sub_type",
        "category AS semantic_event",
        "event_text AS description",
        "home_team_id",
        "away_team_id",
        "home_score",
        "away_score",
        "home_score - away_score AS score_differential",
        "CAST(period AS INT) AS period",
        "seconds AS seconds_remaining_period",
        f"{ck.regulation_seconds('period', 'seconds')} AS seconds_remaining_regulation",
        f"{ck.is_overtime('period')} AS is_overtime",
        f"{ck.overtime_number('period')} AS overtime_number",
        "possession_team_id",
        "CASE WHEN possession_team_id = home_team_id THEN 1 WHEN possession_team_id = away_team_id THEN 0 END AS home_possession",
        "CAST(possession_team_id IS NOT NULL AS INT) AS possession_known",
        "possession_reason",
        "home_fouls AS home_team_fouls_period",
        "away_fouls AS away_team_fouls_period",
        "marker AS foul_marker_team_count",
        "marker_matches AS foul_marker_matches",
        f"{outcome} AS home_win",
    )


def game_states(
    actions: DataFrame,
    index: DataFrame,
    *,
    chunk_rows: int = CHUNK_ROWS,
    mode: str = "fail",
    longest: int | None = None,
) -> DataFrame:
    """Raw actions and game index to game states: the whole reconstruction."""
    return emitted_states(tracked_actions(actions, index, chunk_rows=chunk_rows, mode=mode, longest=longest))


def segment_numbers(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the period segments of a game from 1. ``rows`` carry ``segment_starts``.

    Starts are counted inside a chunk and begin at the number of starts in the chunks before it.
    """
    chunked = rows.withColumn("chunk", F.expr(f"CAST(floor({IDX} / {chunk_rows}) AS BIGINT)"))
    counts = chunked.groupBy(*CHUNK).agg(F.expr("count_if(segment_starts)").alias("starts"))
    before = counts.selectExpr(*CHUNK, f"coalesce(sum(starts) {CHUNKS_BEFORE}, 0) AS earlier")
    numbered = chunked.join(before, CHUNK).withColumn(
        "segment", F.expr(f"CAST(earlier + sum(CAST(segment_starts AS INT)) {SO_FAR} AS INT)")
    )
    return numbered.drop("chunk", "earlier")

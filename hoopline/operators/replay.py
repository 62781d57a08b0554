"""The state of a game after each of its arrivals, without rebuilding any prefix.

Arrivals come in any order, and a later one replaces an earlier one of the same identity. All of them are placed in feed
order once; an arrival is then in force from its own time until it is replaced. What a stretch of actions does to the
state is a short summary, and summaries of neighbouring stretches merge, so they form a tree of fan-out ``FAN`` over the
places of a game. A stretch changes only when an arrival falls into it, so each level of the tree has one version of a stretch per arrival in it:
all levels together have rows x levels versions, and the top has one summary for each prefix of the game.

Nearly all games fit one task: they are dealt by game once, and the whole tree is built where the rows are. Longer games, and those with very many
arrivals at one clock, are built level by level: each level is a look back along time inside its stretches (``carry_last``, in blocks of time, so a game that holds a third of all rows is
spread over as many tasks as it has blocks) and a merge of at most ``FAN`` summaries in one row.

Score rows since the last full snapshot are in it as one function of the score (``score_fold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.functions.events import exprs
from hoopline.operators import score_fold as sf
from hoopline.operators.history import carry_last
from hoopline.operators.live_feed import adapt_live, as_actions, live_order
from hoopline.operators.states import _CLEARED, _CLOCK_KEY, _SEGMENT_DEFAULT, GAME, IDX, _rebound, action_facts
from hoopline.session import written

FAN = 8
NEVER = (1 << 31) - 1
#: A game of so many arrivals is done by one task; tasks get about ``TASK_ROWS`` arrivals.
SHORT_GAME, TASK_ROWS = 1 << 16, 200_000
_SUMMARY = (
    "STRUCT<actions: BIGINT, home_team_id: BIGINT, away_team_id: BIGINT, first_period: INT, last_period: INT, seconds: DOUBLE, touch: STRUCT<team: BIGINT>, "
    "setter: STRUCT<team: BIGINT, reason: STRING, open: BOOLEAN, rebounder: BIGINT>, home_total: BIGINT, away_total: BIGINT, home_start: BIGINT, away_start: BIGINT, "
    f"anchor: STRUCT<home: INT, away: INT>, fold: {sf.TYPE}>"
)


def _put(setter: str) -> str:
    return f"named_struct('team', {setter}.team, 'reason', {setter}.reason, 'open', false, 'rebounder', CAST(NULL AS BIGINT))"


def _leaf(late: str) -> str:
    """The summary of one action; ``late`` says that its score came after a newer one of the same clock."""
    score = f"has_score AND NOT ({late})"
    full = "home_shown IS NOT NULL AND away_shown IS NOT NULL AND category <> 'period'"
    rebound = "named_struct('team', CAST(NULL AS BIGINT), 'reason', CAST(NULL AS STRING), 'open', true, 'rebounder', team_id)"
    op = "named_struct('home', home_shown, 'away', away_shown, 'is_period', category = 'period')"
    return f"""CAST(named_struct(
        'actions', 1, 'home_team_id', home_team_id, 'away_team_id', away_team_id, 'first_period', period, 'last_period', period, 'seconds', seconds, 'touch', touch,
        'setter', CASE WHEN category = 'rebound' THEN {rebound} WHEN setter IS NOT NULL THEN {_put('setter')} END,
        'home_total', home_foul, 'away_total', away_foul, 'home_start', NULL, 'away_start', NULL,
        'anchor', CASE WHEN {score} AND {full} THEN named_struct('home', home_shown, 'away', away_shown) END,
        'fold', CASE WHEN {score} AND NOT ({full}) THEN get(transform(array({op}), q_w -> {sf.of_row('q_w')}), 0) ELSE {sf.IDENTITY} END) AS {_SUMMARY})"""


def _merged(a: str, b: str) -> str:
    """The summary of two stretches, ``a`` before ``b``; a null one is empty."""
    starts = f"{a}.last_period <> {b}.first_period"

    def rebound(pending: str) -> str:
        text = _rebound(f"{b}.setter.rebounder", pending).replace("home_team_id", f"{b}.home_team_id").replace("away_team_id", f"{b}.away_team_id")
        return f"transform(array({text}), s -> {_put('s')})[0]"

    default = _put(_SEGMENT_DEFAULT)
    setter = f"""CASE WHEN {b}.setter.open THEN CASE WHEN {starts} THEN {rebound('CAST(NULL AS BIGINT)')} WHEN {a}.touch IS NOT NULL THEN {rebound(f'{a}.touch.team')} ELSE {b}.setter END
        WHEN {b}.setter IS NOT NULL THEN {b}.setter WHEN {starts} THEN {default} ELSE {a}.setter END"""
    base = lambda side: f"CASE WHEN {b}.{side}_start IS NOT NULL THEN {a}.{side}_total + {b}.{side}_start WHEN {starts} THEN {a}.{side}_total ELSE {a}.{side}_start END"
    return f"""CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE CAST(named_struct(
        'actions', {a}.actions + {b}.actions, 'home_team_id', {b}.home_team_id, 'away_team_id', {b}.away_team_id,
        'first_period', {a}.first_period, 'last_period', {b}.last_period, 'seconds', {b}.seconds,
        'touch', coalesce({b}.touch, CASE WHEN {starts} THEN {_CLEARED} END, {a}.touch), 'setter', {setter},
        'home_total', {a}.home_total + {b}.home_total, 'away_total', {a}.away_total + {b}.away_total, 'home_start', {base('home')}, 'away_start', {base('away')},
        'anchor', coalesce({b}.anchor, {a}.anchor), 'fold', CASE WHEN {b}.anchor IS NOT NULL THEN {b}.fold ELSE {sf.composed(f'{a}.fold', f'{b}.fold')} END) AS {_SUMMARY}) END"""


def _leaves(arrivals: DataFrame, index: DataFrame, short: bool = False) -> DataFrame:
    """Every arrival at its place in feed order, with all that needs no history, and when it is in force: from ``born`` until before ``died``."""
    # An action without any number is an identity of its own.
    identity = "game_id, orderNumber, actionNumber, CASE WHEN orderNumber IS NULL AND actionNumber IS NULL THEN source_index END"
    lives = {"born": "source_index + 1", "died": f"coalesce(lead(source_index) OVER (PARTITION BY {identity} ORDER BY source_index) + 1, {NEVER})"}
    placed = live_order(arrivals.withColumns(exprs(lives)), short=short)
    carried = ("born", "died")
    facts = action_facts(as_actions(adapt_live(placed, carried=carried), carried=carried), index)
    columns = ["seconds", "category", "team_id", "home_team_id", "away_team_id", "touch", "setter", "home_foul", "away_foul", "has_score", "home_shown", "away_shown"]
    return facts.selectExpr(*GAME, IDX, "action_no", f"{_CLOCK_KEY} AS at", *columns, "CAST(period AS INT) AS period", *carried)


_SPANS = "ARRAY<STRUCT<`from`: INT, `to`: INT>>"


def _with_spans(leaves: DataFrame) -> DataFrame:
    """Add ``spans``: when the score of an action is out of order, that is, while an earlier action of the same period and clock that has a score and a
    higher number is in force.

    Only such inversions are joined; in a feed that counts its actions in order there are none.
    """
    scores = leaves.where("has_score AND action_no IS NOT NULL").select("game_id", "at", IDX, "action_no", "born", "died")
    earlier = scores.selectExpr("game_id", "at", f"{IDX} AS other_place", "action_no AS other_no", "born AS other_born", "died AS other_died")
    inverted = f"other_place < {IDX} AND other_no > action_no AND other_born < died AND born < other_died"
    spans = scores.join(earlier, ["game_id", "at"]).where(inverted).groupBy("game_id", IDX).agg(
        F.expr("collect_list(named_struct('from', greatest(born, other_born), 'to', least(died, other_died)))").alias("spans")
    )
    return leaves.join(spans, ["game_id", IDX], "left").withColumn("spans", F.expr(f"coalesce(spans, CAST(array() AS {_SPANS}))"))


def _with_short_spans(leaves: DataFrame) -> DataFrame:
    """The same for short games: an action looks at a list of the earlier scores of its clock, so no row moves."""
    score = "CASE WHEN has_score AND action_no IS NOT NULL THEN named_struct('no', action_no, 'born', born, 'died', died) END"
    before = f"collect_list({score}) OVER (PARTITION BY game_id, at ORDER BY {IDX} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    inverted = "filter(before, x -> x.no > action_no AND x.born < died AND born < x.died)"
    spans = f"transform({inverted}, x -> named_struct('from', greatest(born, x.born), 'to', least(died, x.died)))"
    return leaves.withColumn("before", F.expr(before)).withColumn("spans", F.expr(f"CASE WHEN has_score AND action_no IS NOT NULL THEN {spans} ELSE CAST(array() AS {_SPANS}) END")).drop("before")


def _versions(leaves: DataFrame) -> DataFrame:
    """What each place of a game holds (``s``, null: nothing) from time ``t`` on; ``leaves`` with their ``spans``."""
    times = "array_distinct(concat(array(born), CASE WHEN died < " + str(NEVER) + " THEN array(died) ELSE array() END, flatten(transform(spans, x -> array(x.`from`, x.`to`)))))"
    each = leaves.withColumn("t", F.expr(f"explode(filter({times}, x -> x <= died AND x < {NEVER}))"))
    late = "exists(spans, x -> x.`from` <= t AND t < x.`to`)"
    return each.selectExpr(*GAME, f"CAST({IDX} AS BIGINT) AS node", "CAST(t AS BIGINT) AS t", f"CASE WHEN t < died THEN {_leaf(late)} END AS s")


def _parts(versions: DataFrame) -> DataFrame:
    parts = versions.selectExpr(*GAME, f"CAST(floor(node / {FAN}) AS BIGINT) AS node", f"CAST(node % {FAN} AS INT) AS part", "t", "s")
    return parts.withColumn("step", F.expr(f"t * {FAN} + part"))


def _put_together(seen: DataFrame) -> DataFrame:
    list_of = ", ".join(f"p{k}.s" for k in range(FAN))
    return seen.selectExpr(*GAME, "node", "t", f"aggregate(array({list_of}), CAST(NULL AS {_SUMMARY}), (a, b) -> {_merged('a', 'b')}) AS s")


def _one_level_up(versions: DataFrame, block_rows: int) -> DataFrame:
    """Versions of stretches from those of their ``FAN`` parts."""
    values = {f"p{k}": f"CASE WHEN part = {k} THEN struct(s) END" for k in range(FAN)}
    seen = carry_last(_parts(versions), [*GAME, "node"], "step", values, block_rows, include_current=True)
    # Of the parts that changed at one time, the last one in this order has seen all of them.
    return _put_together(seen.withColumn("is_last", F.expr("step = max(step) OVER (PARTITION BY season, game_id, node, t)")).where("is_last"))


def _one_short_level_up(versions: DataFrame) -> DataFrame:
    """The same for short games: looking back along a whole stretch, so no row moves."""
    along = "OVER (PARTITION BY game_id, node ORDER BY step"
    values = {f"p{k}": f"last(CASE WHEN part = {k} THEN struct(s) END, true) {along} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for k in range(FAN)}
    return _put_together(_parts(versions).withColumns(exprs(values | {"later": f"lead(t) {along})"})).where("later IS NULL OR later > t"))


def _sizes(arrivals: DataFrame) -> DataFrame:
    """For each game its number of arrivals (``n``) and the most that one period and clock has (``at_once``)."""
    return arrivals.groupBy("game_id", "period", "clock").agg(F.count(F.lit(1)).alias("m")).groupBy("game_id").agg(F.sum("m").alias("n"), F.max("m").alias("at_once"))


def _levels(places: int) -> int:
    levels, stretches = 1, -(-places // FAN)
    while stretches > 1:
        levels, stretches = levels + 1, -(-stretches // FAN)
    return levels


def _short_tree(arrivals: DataFrame, index: DataFrame, rows: int, longest: int) -> DataFrame:
    """The top of the tree for ``rows`` arrivals of games with at most ``longest``: dealt by game once, and every step after that stays in its task."""
    partitions = max(int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    level = _versions(_with_short_spans(_leaves(arrivals.repartition(partitions, "game_id"), index, short=True)))
    for _ in range(_levels(longest)):
        level = _one_short_level_up(level)
    return level


def _long_tree(arrivals: DataFrame, index: DataFrame, longest: int, block_rows: int) -> DataFrame:
    """The top of the tree for games of any length, level by level in blocks."""
    level = _versions(_with_spans(written(_leaves(arrivals, index), "replay_leaves")))
    for _ in range(_levels(longest)):
        level = written(_one_level_up(level, block_rows), "replay_level")
    return level


def replay_states(arrivals: DataFrame, index: DataFrame, block_rows: int = 4096, short_game: int = SHORT_GAME) -> DataFrame:
    """For every game and ``cursor`` from 1 to the number of arrivals: the state that its first ``cursor`` arrivals give.

    ``arrivals`` are raw live actions (``source_index`` counts them from 0 in each game), ``index`` the teams of each game under the season name ``live``.
    Games of at most ``short_game`` arrivals, each clock of them with at most a sixteenth of that, are done by one task each. Arrivals without a game are left out.
    """
    arrivals = arrivals.where("game_id IS NOT NULL")
    sizes = written(_sizes(arrivals).withColumn("is_long", F.expr(f"n > {short_game} OR at_once > {max(1, short_game // 16)}")), "replay_sizes")
    of = {r["is_long"]: r for r in sizes.groupBy("is_long").agg(F.sum("n").alias("rows"), F.max("n").alias("longest")).collect()}
    long_games = sizes.where("is_long").select("game_id")
    trees = []
    if False in of or not of:
        short = arrivals.join(long_games, "game_id", "left_anti") if True in of else arrivals
        trees.append(_short_tree(short, index, of[False]["rows"] if of else 0, of[False]["longest"] if of else 0))
    if True in of:
        trees.append(_long_tree(arrivals.join(long_games, "game_id", "left_semi"), index, of[True]["longest"], block_rows))
    level = trees[0].unionByName(trees[1]) if len(trees) > 1 else trees[0]
    score = sf.applied("s.fold", "coalesce(s.anchor.home, 0)", "coalesce(s.anchor.away, 0)")
    shown = level.withColumns(exprs({"score": score, "open": "coalesce(s.setter.open, true)"}))
    states = shown.selectExpr(
        *GAME, "CAST(t AS INT) AS cursor", "CAST(s.actions AS INT) AS actions", "score.home AS home_score", "score.away AS away_score",
        "s.last_period AS period", "s.seconds AS seconds_remaining_period", "CASE WHEN NOT open THEN s.setter.team END AS possession_team_id",
        "CAST(s.home_total - coalesce(s.home_start, 0) AS INT) AS home_team_fouls_period", "CAST(s.away_total - coalesce(s.away_start, 0) AS INT) AS away_team_fouls_period",
    )
    return written(states, "replay_states")

"""Play-by-play derived from the generic ``events`` table.

The given tables hold no play-by-play, so every event becomes one action of a game played by
its user. The expressions below are plain SQL that Spark and DuckDB read alike; the position of
an event in its game is worked out by each engine on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopline.operators.index import state_index
from hoopline.operators.live_feed import live_feed_actions
from hoopline.operators.ordinal import with_position
from hoopline.operators.states import emitted_states, game_states, longest_game, tracked_actions
from hoopline.session import DOCUMENT_WRITES, gathering_documents, scratch_path
from hoopline.sources.state_store import read_states, write_states

# Each stage may use the columns of the stages before it. Inputs: event_id, ts, user_id,
# event_type, value, i (0-based position in the game), n (events in the game).
_SCORED = "kind BETWEEN 0 AND 7 OR kind IN (39, 42, 46, 55, 56, 60, 61, 62, 63) OR (kind = 24 AND event_id % 5 = 0)"

STAGES: list[dict[str, str]] = [
    {
        "game_id": "lpad(CAST(user_id AS STRING), 10, '0')",
        "season": "CASE user_id % 3 WHEN 0 THEN '2021-22' WHEN 1 THEN '2022-23' ELSE '2023-24' END",
        "home_id": "CAST(1000 + user_id % 30 AS BIGINT)",
        "away_id": "CAST(2000 + (user_id * 7) % 30 AS BIGINT)",
        "np": "CAST(4 + (user_id % 7) % 3 AS INT)",
        "k": "CAST((event_id * 31 + length(event_type) * 7 + CAST(floor(value * 100) AS BIGINT)) % 64 AS INT)",
    },
    {
        "pbase": "CAST(1 + floor(CAST(i * np AS DOUBLE) / n) AS INT)",
        "frac": "CAST((i * np) % n AS DOUBLE) / n",
        "kind": "CASE WHEN i = 0 THEN 60 WHEN i = n - 1 THEN 61 ELSE k END",
    },
    {
        "period": "CASE WHEN event_id % 41 = 7 AND pbase > 1 THEN pbase - 1 ELSE pbase END",
        "plen": "CASE WHEN pbase <= 4 THEN 720 ELSE 300 END",
    },
    {"secs": "CAST(floor(plen * (CAST(1 AS DOUBLE) - frac) / 120) AS INT) * 120"},
    {
        "clock_text": "'PT' || lpad(CAST(CAST(floor(secs / 60) AS INT) AS STRING), 2, '0') || 'M' "
        "|| lpad(CAST(secs % 60 AS STRING), 2, '0') "
        "|| CASE WHEN event_id % 9 = 3 AND secs < plen THEN '.50S' ELSE '.00S' END",
        "team": "CASE WHEN kind IN (55, 56, 60, 61, 62) OR event_id % 17 = 0 THEN 0 "
        "WHEN event_id % 53 = 1 THEN 999 WHEN event_id % 59 = 2 THEN NULL "
        "WHEN (event_id + CAST(floor(value) AS BIGINT)) % 2 = 0 THEN home_id ELSE away_id END",
        "type_text": "CASE WHEN kind BETWEEN 0 AND 7 OR kind = 63 THEN 'Made Shot' "
        "WHEN kind BETWEEN 8 AND 14 OR kind IN (58, 59) THEN 'Missed Shot' "
        "WHEN kind BETWEEN 15 AND 23 THEN 'Rebound' WHEN kind BETWEEN 24 AND 27 THEN 'Turnover' "
        "WHEN kind BETWEEN 28 AND 37 THEN 'Foul' WHEN kind BETWEEN 38 AND 46 THEN 'Free Throw' "
        "WHEN kind = 47 THEN 'Jump Ball' WHEN kind = 48 THEN 'Substitution' "
        "WHEN kind IN (49, 50) THEN 'Timeout' WHEN kind = 51 THEN 'Violation' "
        "WHEN kind BETWEEN 52 AND 54 THEN '' WHEN kind IN (55, 56) THEN 'Instant Replay' "
        "WHEN kind = 57 THEN 'Ejection' WHEN kind = 62 THEN 'Period' ELSE 'period' END",
        "sub_text": "CASE kind WHEN 28 THEN 'Personal' WHEN 29 THEN 'Shooting' WHEN 30 THEN 'Offensive' "
        "WHEN 31 THEN 'Offensive Charge' WHEN 32 THEN 'Technical' WHEN 33 THEN 'Loose Ball' WHEN 34 THEN '' "
        "WHEN 35 THEN 'Defense 3 Second' WHEN 36 THEN 'Bench' WHEN 37 THEN 'Personal Take' "
        "WHEN 38 THEN 'Free Throw 1 of 2' WHEN 39 THEN 'Free Throw 2 of 2' WHEN 40 THEN 'Free Throw 2 of 2' "
        "WHEN 41 THEN 'Free Throw Technical' WHEN 42 THEN 'Free Throw Flagrant 2 of 2' "
        "WHEN 43 THEN 'Free Throw Flagrant 1 of 2' WHEN 44 THEN 'Free Throw Clear Path 2 OF 2' "
        "WHEN 45 THEN 'Free Throw' WHEN 46 THEN 'Free Throw 1  of  1' WHEN 49 THEN 'Regular' "
        "WHEN 50 THEN 'Coach Challenge' WHEN 51 THEN 'Delay Of Game' WHEN 55 THEN 'Support Ruling' "
        "WHEN 56 THEN 'Overturn Ruling' WHEN 60 THEN 'start' WHEN 61 THEN 'end' WHEN 62 THEN 'End ' "
        "WHEN 15 THEN 'Offensive' WHEN 16 THEN 'Unknown' WHEN 24 THEN 'Bad Pass' WHEN 25 THEN 'Traveling' "
        "ELSE '' END",
        "home_points": "CAST(floor(i * (4 + user_id % 5) / 8) AS INT)",
        "away_points": "CAST(floor(i * (4 + (user_id * 3) % 5) / 8) AS INT) + CAST(CASE WHEN i > n / 2 THEN user_id % 3 ELSE 0 END AS INT)",
    },
    {
        "home_shown": "CASE WHEN kind IN (55, 56) THEN greatest(home_points - 3, 0) "
        "WHEN kind IN (60, 62) AND event_id % 3 = 0 THEN greatest(home_points - 2, 0) ELSE home_points END",
        "away_shown": "CASE WHEN kind IN (55, 56) THEN greatest(away_points - 3, 0) "
        "WHEN kind IN (60, 62) AND event_id % 3 = 0 THEN away_points + 1 ELSE away_points END",
        "scored": f"CASE WHEN {_SCORED} THEN 1 ELSE 0 END",
    },
]

# The historical action contract, read from the stages above.
ACTION_COLUMNS: dict[str, str] = {
    "season": "season",
    "game_id": "game_id",
    "source_event_index": "CAST(i AS INT)",
    "n_events": "CAST(n AS INT)",
    "actionId": "CASE WHEN event_id % 71 = 0 THEN '' ELSE CAST(event_id AS STRING) END",
    "actionNumber": "CASE WHEN event_id % 61 = 0 THEN NULL "
    "ELSE CAST(2 * i + 1 - CASE WHEN event_id % 13 = 5 THEN 5 ELSE 0 END AS INT) END",
    "actionType": "CASE WHEN event_id % 43 = 0 AND type_text <> '' THEN ' ' || upper(type_text) || chr(9) ELSE type_text END",
    "subType": "CASE WHEN event_id % 47 = 3 THEN ' ' || upper(sub_text) ELSE sub_text END",
    "clock": "CASE WHEN event_id % 37 = 0 THEN ' ' || clock_text || chr(9) ELSE clock_text END",
    "period": "period",
    "teamId": "CAST(team AS BIGINT)",
    "teamTricode": "CASE WHEN team = home_id THEN 'H' || CAST(home_id AS STRING) "
    "WHEN team = away_id THEN 'A' || CAST(away_id AS STRING) ELSE '' END",
    "description": "CASE WHEN event_id % 97 = 4 THEN '' "
    "WHEN kind BETWEEN 28 AND 37 THEN 'Player ' || CAST(user_id AS STRING) || ' ' || upper(sub_text) || ' FOUL (P1' "
    "|| CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 8 = 3 THEN '.t' ELSE '.T' END "
    "|| CAST(1 + event_id % 3 AS STRING) || ')' "
    "WHEN kind IN (40, 44) THEN 'Miss ' || 'Player ' || CAST(user_id AS STRING) || ' ' || sub_text "
    "WHEN kind IN (38, 46) AND event_id % 2 = 0 THEN 'MISS Player ' || CAST(user_id AS STRING) "
    "WHEN kind = 52 THEN 'Player ' || CAST(user_id AS STRING) || ' BLOCK (1 BLK)' "
    "WHEN kind = 53 THEN 'Player ' || CAST(user_id AS STRING) || ' Steal (1 STL)' "
    "WHEN kind = 54 THEN 'Note ' || CAST(event_id % 40 AS STRING) "
    "ELSE 'Player ' || CAST(user_id AS STRING) || ' ' || type_text || ' ' || sub_text END",
    "scoreHome": "CASE WHEN scored = 0 OR (event_id % 29 = 1 AND i < n - 1) THEN '' "
    "WHEN event_id % 31 = 0 THEN CAST(home_shown AS STRING) || '.0' "
    "WHEN event_id % 67 = 0 THEN ' ' || CAST(home_shown AS STRING) || ' ' ELSE CAST(home_shown AS STRING) END",
    "scoreAway": "CASE WHEN scored = 0 OR (event_id % 23 = 0 AND i < n - 1) THEN '' "
    "WHEN event_id % 31 = 0 THEN CAST(away_shown AS STRING) || '.5' ELSE CAST(away_shown AS STRING) END",
    "shotResult": "CASE WHEN kind BETWEEN 0 AND 7 OR kind IN (39, 42, 63) THEN 'Made' "
    "WHEN kind BETWEEN 8 AND 14 OR kind IN (40, 43, 58, 59) THEN 'Missed' WHEN kind = 44 THEN ' missed' ELSE '' END",
}

# The live action contract. ``copy`` is 0 for an action and 1 for its later correction, ``place`` is
# the position in arrival order: all actions, then all corrections.
LIVE_COLUMNS: dict[str, str] = {
    "game_id": "game_id",
    "source_index": "CAST(place AS INT)",
    "actionNumber": "CASE WHEN event_id % 61 = 0 THEN NULL ELSE CAST(2 * i + 1 AS INT) END",
    "orderNumber": "CASE WHEN event_id % 19 = 3 THEN NULL WHEN event_id % 101 = 5 THEN 0 ELSE (i + 1) * 10000 END",
    "actionType": "CASE WHEN kind BETWEEN 0 AND 14 OR kind IN (58, 59, 63) THEN "
    "CASE WHEN event_id % 3 = 0 THEN '3pt' ELSE '2pt' END "
    "WHEN kind BETWEEN 15 AND 23 THEN 'rebound' WHEN kind BETWEEN 24 AND 27 THEN 'turnover' "
    "WHEN kind BETWEEN 28 AND 37 THEN 'foul' WHEN kind BETWEEN 38 AND 46 THEN 'freethrow' "
    "WHEN kind = 47 THEN 'jumpball' WHEN kind = 48 THEN 'substitution' WHEN kind IN (49, 50) THEN 'timeout' "
    "WHEN kind = 51 THEN 'violation' WHEN kind = 52 THEN 'block' WHEN kind = 53 THEN 'steal' "
    "WHEN kind IN (55, 56) THEN 'instantreplay' WHEN kind >= 60 THEN 'Period' ELSE 'new-unseen-type' END",
    "subType": "CASE kind WHEN 28 THEN 'personal' WHEN 29 THEN 'personal' WHEN 30 THEN 'offensive' "
    "WHEN 31 THEN 'offensive' WHEN 32 THEN 'technical' WHEN 33 THEN 'personal' WHEN 35 THEN 'technical' "
    "WHEN 37 THEN 'Personal' WHEN 38 THEN '1 of 2' WHEN 39 THEN '2 of 2' WHEN 40 THEN '2 of 2' WHEN 41 THEN '1 of 1' "
    "WHEN 42 THEN '2 of 2' WHEN 43 THEN '1 of 2' WHEN 44 THEN '2 of 2' WHEN 46 THEN '1 of 1' WHEN 49 THEN 'full' "
    "WHEN 51 THEN 'kicked ball' WHEN 15 THEN 'offensive' WHEN 17 THEN 'defensive' WHEN 24 THEN 'bad pass' "
    "WHEN 60 THEN 'start' WHEN 61 THEN 'end' WHEN 62 THEN ' END' ELSE NULL END",
    "descriptor": "CASE kind WHEN 29 THEN 'shooting' WHEN 31 THEN 'Charge' WHEN 33 THEN 'loose ball' "
    "WHEN 35 THEN 'defensive' WHEN 36 THEN 'bench' WHEN 37 THEN 'take' WHEN 42 THEN 'flagrant' ELSE NULL END",
    "qualifiers": "split(CASE WHEN kind = 41 THEN 'deadball,Technical' WHEN kind = 43 THEN 'flagrant' "
    "WHEN kind = 44 THEN 'clear path,2freethrow' WHEN event_id % 7 = 0 THEN 'fastbreak' ELSE NULL END, ',')",
    "clock": "CASE WHEN event_id % 37 = 0 THEN ' ' || clock_text ELSE clock_text END",
    "period": "period",
    "teamId": "CAST(team AS BIGINT)",
    "teamTricode": "CASE WHEN team = home_id THEN 'H' || CAST(home_id AS STRING) "
    "WHEN team = away_id THEN 'A' || CAST(away_id AS STRING) ELSE NULL END",
    "possession": "CASE WHEN event_id % 2 = 0 THEN home_id ELSE 0 END",
    "scoreHome": "CAST(CASE WHEN copy = 1 THEN home_shown + 1 ELSE home_shown END AS STRING)",
    "scoreAway": "CAST(away_shown AS STRING)",
    "shotResult": "CASE WHEN kind BETWEEN 0 AND 7 OR kind IN (39, 42, 63) THEN 'Made' "
    "WHEN kind BETWEEN 8 AND 14 OR kind IN (40, 43, 44, 58, 59) THEN 'Missed' ELSE NULL END",
    "description": "CASE WHEN copy = 1 THEN 'Corrected ' ELSE 'Player ' END || CAST(event_id AS STRING) || ' ' || type_text",
}


def stage_sql(source: str) -> str:
    """The staged expressions over a relation that has the input columns; works on both engines."""
    sql = source
    for stage in STAGES:
        added = ", ".join(f"{expression} AS {name}" for name, expression in stage.items())
        sql = f"SELECT *, {added} FROM ({sql})"
    return sql


def columns_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", "value"
    )
    # A block of a million event ids holds at most a million events of any one user.
    placed = with_position(
        events, ["user_id"], ["event_id"], block=F.floor(F.col("event_id") / F.lit(1 << 20)), position="i", total="n"
    )
    for stage in STAGES:
        placed = placed.withColumns({name: F.expr(expression) for name, expression in stage.items()})
    return placed


class DerivedFeed:
    """The derived tables of one scale factor, written once per application as Parquet.

    Reading typed Parquet lets later jobs prune columns and skip row groups by statistics,
    and a written table survives the loss of executors.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._paths: dict[str, str] = {}
        self._longest: int | None = None

    def _table(self, name: str, build) -> DataFrame:
        if name not in self._paths:
            path = scratch_path(self.spark, name)
            build().write.parquet(path)
            self._paths[name] = path
        return self.spark.read.parquet(self._paths[name])

    def _documents(self, name: str, build) -> DataFrame:
        """A table of documents, gathered and written a few at a time."""
        if name not in self._paths:
            path, rows = scratch_path(self.spark, name), build()
            with gathering_documents(self.spark):
                rows.write.options(**DOCUMENT_WRITES).parquet(path)
            self._paths[name] = path
        return self.spark.read.parquet(self._paths[name])

    def forget(self, name: str) -> None:
        """The next reader of this table has it built anew."""
        self._paths.pop(name, None)

    def staged(self) -> DataFrame:
        return self._table("staged", lambda: _staged(self.spark, self.sf_dir))

    def actions(self) -> DataFrame:
        """Historical actions, one row each, with season, game_id and source_event_index."""
        return self._table(
            "actions",
            lambda: self.staged().select(*[F.expr(e).alias(c) for c, e in ACTION_COLUMNS.items()]),
        )

    def live_actions(self) -> DataFrame:
        """Live actions in arrival order; every eleventh action is corrected once, later."""

        def build() -> DataFrame:
            copies = F.expr("CASE WHEN event_id % 11 = 4 THEN array(0, 1) ELSE array(0) END")
            both = self.staged().withColumn("copy", F.explode(copies))
            both = with_position(
                both, ["game_id"], ["copy", "i"], block=F.expr("struct(copy, CAST(floor(i / 4096) AS BIGINT) AS block)"), position="place"
            )
            return both.select(*[F.expr(e).alias(c) for c, e in LIVE_COLUMNS.items()])

        return self._table("live_actions", build)

    def game_log(self) -> DataFrame:
        """Two rows per game, one per team. Every tenth game carries a final score one too high."""

        def build() -> DataFrame:
            games = self.staged().groupBy("user_id", "season", "game_id", "home_id", "away_id").agg(
                F.min(F.col("ts").cast("date")).alias("game_date"),
                F.max("home_points").alias("home_top"),
                F.max("away_points").alias("away_top"),
            )
            sides = games.withColumn("side", F.explode(F.array(F.lit("home"), F.lit("away"))))
            return sides.select(*[F.expr(e).alias(c) for c, e in GAME_LOG_COLUMNS.items()])

        return self._table("game_log", build)

    def index(self) -> DataFrame:
        return self._table("index", lambda: state_index(self.game_log()))

    def longest(self) -> int:
        """A bound on game length, read once from the actions table."""
        if self._longest is None:
            self._longest = longest_game(self.actions())
        return self._longest

    def tracked(self) -> DataFrame:
        return tracked_actions(self.actions(), self.index(), longest=self.longest())

    def live_feed(self) -> DataFrame:
        """Live actions once each, in feed order, in the historical contract."""
        return self._table("live_feed", lambda: live_feed_actions(self.live_actions()))

    def states(self) -> DataFrame:
        """The fact table: game states, partitioned by season."""
        if "states" not in self._paths:
            path = scratch_path(self.spark, "states")
            write_states(emitted_states(self.tracked()), path)
            self._paths["states"] = path
        return read_states(self.spark, self._paths["states"])

    def live_index(self) -> DataFrame:
        """The teams of each game under the season name ``live``; a live game has no outcome yet."""
        return self.index().selectExpr("'live' AS season", "game_id", "home_team_id", "away_team_id")

    def live_states(self) -> DataFrame:
        if "live_states" not in self._paths:
            path = scratch_path(self.spark, "live_states")
            feed = self.live_feed()
            write_states(game_states(feed, self.live_index(), longest=longest_game(feed)), path)
            self._paths["live_states"] = path
        return read_states(self.spark, self._paths["live_states"])

    def live_scored(self) -> DataFrame:
        return self.live_states().withColumn("probability", F.expr(PROBABILITY))

    def board(self) -> DataFrame:
        """What the scoreboard says of every game, flat."""

        def build() -> DataFrame:
            games = self.staged().groupBy("user_id", "game_id", "home_id", "away_id").agg(
                F.min(F.col("ts").cast("date")).alias("game_date"),
                F.max("home_points").alias("home_top"),
                F.max("away_points").alias("away_top"),
            )
            return games.select(*[F.expr(e).alias(c) for c, e in BOARD_COLUMNS.items()])

        return self._table("board", build)

    def scoreboard_documents(self) -> DataFrame:
        """Scoreboard envelopes of at most four games each, as JSON text."""
        game = (
            "named_struct('gameId', game_id, 'gameStatus', game_status, 'gameStatusText', status_text, 'period', period, "
            "'gameClock', clock, 'homeTeam', named_struct('teamId', home_team_id, 'teamName', home_name, "
            "'teamTricode', home_tricode, 'score', home_score), 'awayTeam', named_struct('teamId', away_team_id, "
            "'teamName', away_name, 'teamTricode', away_tricode, 'score', away_score))"
        )
        games = self.board().withColumn("game", F.expr(game))
        # Four consecutive games per document, so a document is small whatever the day holds.
        boards = games.groupBy("board", "game_date").agg(F.collect_list("game").alias("games"))
        return boards.selectExpr("to_json(named_struct('scoreboard', named_struct('gameDate', game_date, 'games', games))) AS value")

    def details_documents(self) -> DataFrame:
        return self.board().selectExpr(
            "to_json(named_struct('game', named_struct('gameId', game_id, 'gameStatus', game_status, "
            "'homeTeam', named_struct('teamId', home_team_id, 'score', home_score)))) AS value"
        )

    def landed_documents(self) -> DataFrame:
        """Raw feed documents, one per game and 4,096 actions, with defects of every kind."""

        def build() -> DataFrame:
            facts = self.staged().withColumns({c: F.expr(e) for c, e in DEFECT_COLUMNS.items()})
            action = (
                "'{' || concat_ws(',', '\"period\":' || pv, '\"clock\":' || cv, '\"actionType\":' || tv, "
                "'\"actionNumber\":' || CAST(i AS STRING), CASE WHEN event_id % 3 = 0 THEN '\"subType\":null' END) || '}'"
            )
            rows = facts.selectExpr(
                "season", "user_id", "game_id", "defect", "CAST(floor(i / 4096) AS INT) AS part", "i", f"{action} AS action"
            )
            parts = rows.groupBy("season", "user_id", "game_id", "defect", "part").agg(
                F.expr("concat_ws(',', transform(array_sort(collect_list(struct(i, action))), x -> x.action))").alias("actions")
            )
            listed = "CASE defect WHEN 'empty' THEN '[]' WHEN 'not a list' THEN '{}' ELSE '[' || actions || ']' END"
            shown_id = "CASE WHEN defect = 'other id' THEN '9999999999' ELSE game_id END"
            whole = f"'{{\"game\":{{\"gameId\":\"' || {shown_id} || '\",\"actions\":' || {listed} || '}}}}'"
            value = (
                f"CASE defect WHEN 'cut' THEN substr({whole}, 1, 60) WHEN 'no game' THEN '{{\"scoreboard\":{{}}}}' "
                f"WHEN 'not an object' THEN '[1]' ELSE {whole} END"
            )
            return parts.where("defect <> 'absent'").selectExpr("season", "game_id", "part", f"{value} AS value")

        return self._documents("landed_documents", build)

    def snapshots(self) -> DataFrame:
        """Polled live documents: poll 0 holds the first half of a game, polls 1 and 2 all of it.

        Even games repeat poll 1 with the keys in another order, so nothing has changed.
        """

        def build() -> DataFrame:
            fields = [c for c in LIVE_COLUMNS if c not in ("game_id", "source_index")]
            names = ", ".join(f"'{c}', {c}" for c in fields)
            turned = ", ".join(f"'{c}', {c}" for c in reversed(fields))
            lengths = self.live_actions().groupBy("game_id").agg(F.count(F.lit(1)).alias("total"))
            rows = self.live_actions().selectExpr(
                "game_id",
                "CAST(floor(source_index / 4096) AS INT) AS part",
                "source_index",
                f"to_json(named_struct({names}), map('ignoreNullFields', 'false')) AS plain",
                f"to_json(named_struct({turned}), map('ignoreNullFields', 'false')) AS turned",
            )
            # An action becomes text and travels once for all polls; poll 0 shows the head of a list.
            listed = rows.groupBy("game_id", "part").agg(F.expr("array_sort(collect_list(struct(source_index, plain, turned)))").alias("listed"))
            polls = listed.join(lengths, "game_id").withColumn("poll", F.expr("explode(CASE WHEN listed[0].source_index < total / 2 THEN array(0, 1, 2) ELSE array(1, 2) END)"))
            shown = (
                "CASE poll WHEN 0 THEN transform(filter(listed, x -> x.source_index < total / 2), x -> x.plain) WHEN 1 THEN transform(listed, x -> x.plain) "
                "ELSE transform(listed, x -> x.turned) END"
            )
            parts = polls.withColumns({"items": F.expr(shown), "corrected": F.expr("poll = 2 AND CAST(game_id AS BIGINT) % 2 = 1")})
            actions = "concat_ws(',', items)"
            note = "CASE WHEN corrected THEN '\"note\":1,' ELSE '' END"
            value = f"'{{\"game\":{{' || {note} || '\"gameId\":\"' || game_id || '\",\"actions\":[' || {actions} || ']}}}}'"
            return parts.selectExpr("game_id", "poll", "part", f"{value} AS value")

        return self._documents("snapshots", build)

    def polls(self) -> DataFrame:
        """Eight polls of every game: how many of its arrivals the feed shows by then, whether the feed fails, and the scoreboard row."""

        def build() -> DataFrame:
            totals = self.live_actions().groupBy("game_id").agg(F.count(F.lit(1)).alias("total"))
            games = self.staged().select("user_id", "game_id", "home_id", "away_id").distinct().join(totals, "game_id")
            each = games.withColumn("poll", F.expr("explode(sequence(0, 7))")).withColumn("version", F.expr(POLL_VERSION))
            return each.select("game_id", "poll", "total", *[F.expr(e).alias(c) for c, e in LANDED_POLL_COLUMNS.items()])

        return self._table("polls", build)

    def polled_documents(self) -> DataFrame:
        """What the feed of every poll lands; a failed one is cut off."""

        def build() -> DataFrame:
            fields = [c for c in LIVE_COLUMNS if c not in ("game_id", "source_index")]
            names = ", ".join(f"'{c}', {c}" for c in fields)
            rows = self.live_actions().selectExpr(
                "game_id", "CAST(floor(source_index / 4096) AS INT) AS part", "source_index", f"to_json(named_struct({names}), map('ignoreNullFields', 'false')) AS item"
            )
            # An action becomes text and travels once, whatever the number of polls that show it; a poll shows the head of a list.
            listed = rows.groupBy("game_id", "part").agg(F.expr("array_sort(collect_list(struct(source_index, item)))").alias("listed"))
            shown = listed.join(self.polls().select("game_id", "poll", "shown", "failed"), "game_id").where("listed[0].source_index < shown")
            parts = shown.withColumn("items", F.expr("transform(filter(listed, x -> x.source_index < shown), x -> x.item)"))
            value = "'{\"game\":{\"gameId\":\"' || game_id || '\",\"actions\":[' || concat_ws(',', items) || CASE WHEN failed THEN '' ELSE ']}}' END"
            return parts.selectExpr("game_id", "poll", "part", f"{value} AS value")

        return self._documents("polled_documents", build)

    def scored(self) -> DataFrame:
        """States with a made-up home-win probability, a plain ratio that both engines agree on."""
        return self.states().withColumn("probability", F.expr(PROBABILITY))


GAME_LOG_COLUMNS: dict[str, str] = {
    "season": "season",
    "GAME_ID": "game_id",
    "GAME_DATE": "game_date",
    "TEAM_ID": "CASE WHEN side = 'home' THEN home_id ELSE away_id END",
    "TEAM_ABBREVIATION": "CASE WHEN side = 'home' THEN 'H' || CAST(home_id AS STRING) ELSE 'A' || CAST(away_id AS STRING) END",
    "MATCHUP": "CASE WHEN side = 'home' THEN 'H' || CAST(home_id AS STRING) || ' vs. A' || CAST(away_id AS STRING) "
    "ELSE 'A' || CAST(away_id AS STRING) || ' @ H' || CAST(home_id AS STRING) END",
    "WL": "CASE WHEN (side = 'home') = (home_top + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END > away_top) THEN 'W' ELSE 'L' END",
    "PTS": "CAST(CASE WHEN side = 'home' THEN home_top + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END ELSE away_top END AS INT)",
}

BOARD_COLUMNS: dict[str, str] = {
    "board": "CAST(floor(user_id / 4) AS BIGINT)",
    "game_date": "CAST(game_date AS STRING)",
    "game_id": "game_id",
    "game_status": "CASE user_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE NULL END",
    "status_text": "CASE user_id % 5 WHEN 0 THEN ' 7:00 pm ET ' WHEN 3 THEN 'Final' ELSE NULL END",
    "period": "CASE user_id % 5 WHEN 0 THEN NULL ELSE CAST(1 + user_id % 5 AS STRING) END",
    "clock": "CASE WHEN user_id % 2 = 0 THEN 'PT05M00.00S ' ELSE NULL END",
    "home_team_id": "CASE WHEN user_id % 31 = 7 THEN NULL ELSE home_id END",
    "home_name": "'Home ' || CAST(home_id AS STRING)",
    "home_tricode": "CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'H' || CAST(home_id AS STRING) END",
    "home_score": "CASE WHEN user_id % 13 = 5 THEN 'n/a' WHEN user_id % 13 = 6 THEN NULL ELSE CAST(home_top AS STRING) END",
    "away_team_id": "away_id",
    "away_name": "' Away ' || CAST(away_id AS STRING)",
    "away_tricode": "'A' || CAST(away_id AS STRING)",
    "away_score": "CAST(away_top AS STRING)",
}
# Polls of a game, as text that both engines read.
POLL_VERSION = "CASE WHEN poll < 2 THEN 0 WHEN poll < 5 THEN 1 WHEN user_id % 2 = 0 OR poll = 7 THEN 2 ELSE 1 END"
_POLL_FINAL = "poll >= 6 AND user_id % 4 = 0"
LANDED_POLL_COLUMNS: dict[str, str] = {
    "shown": "CAST(ceil(total * (version + 1) / 3.0) AS INT)",
    "failed": "(poll = 0 AND user_id % 7 = 3) OR (poll = 3 AND user_id % 3 = 1) OR (poll = 4 AND user_id % 6 = 1) OR (poll = 6 AND user_id % 5 = 2)",
    "game_status": f"CASE WHEN {_POLL_FINAL} THEN 3 ELSE 2 END",
    "status_text": f"CASE WHEN {_POLL_FINAL} THEN 'Final' WHEN user_id % 11 = 5 THEN NULL ELSE 'Q' || CAST(CAST(1 + floor(poll / 4) AS INT) AS STRING) END",
    "period": "CAST(1 + floor(poll / 4) AS INT)",
    "clock": "'PT05M00.00S'",
    "home_team_id": "home_id",
    "home_name": "'Home ' || CAST(home_id AS STRING)",
    "home_city": "''",
    "home_tricode": "'H' || CAST(home_id AS STRING)",
    "home_score": "CAST(user_id % 50 + CASE WHEN poll >= 5 THEN 2 ELSE 0 END AS INT)",
    "away_team_id": "away_id",
    "away_name": "'Away ' || CAST(away_id AS STRING)",
    "away_city": "''",
    "away_tricode": "'A' || CAST(away_id AS STRING)",
    "away_score": "CAST(user_id % 40 AS INT)",
}
PROBABILITY = "greatest(0D, least(1D, CAST(50 + score_differential * period AS DOUBLE) / 100D))"

# Defects of landed documents by game, and the JSON text of the three required keys.
DEFECT_COLUMNS: dict[str, str] = {
    "defect": "CASE user_id % 16 WHEN 1 THEN 'other id' WHEN 2 THEN 'bad clocks' WHEN 3 THEN 'some bad clocks' WHEN 4 THEN 'no types' "
    "WHEN 5 THEN 'few types' WHEN 6 THEN 'text periods' WHEN 7 THEN 'period zero' WHEN 8 THEN 'missing clocks' WHEN 9 THEN 'null types' "
    "WHEN 10 THEN 'not a list' WHEN 11 THEN 'cut' WHEN 12 THEN 'empty' WHEN 13 THEN 'absent' WHEN 14 THEN 'no game' "
    "WHEN 15 THEN CASE WHEN user_id % 32 = 15 THEN 'not an object' ELSE 'missing periods' END ELSE 'none' END",
    "pv": "CASE WHEN user_id % 16 = 6 THEN '\"' || CAST(period AS STRING) || '\"' WHEN user_id % 16 = 7 AND i = 3 THEN '0' "
    "WHEN user_id % 32 = 31 AND event_id % 5 = 0 THEN NULL ELSE CAST(period AS STRING) END",
    "cv": "CASE WHEN user_id % 16 = 2 THEN '\"6:07\"' WHEN user_id % 16 = 3 AND event_id % 10 = 0 THEN '\"\"' "
    "WHEN user_id % 16 = 8 AND event_id % 7 = 0 THEN NULL WHEN user_id % 16 = 0 AND event_id % 50 = 0 THEN 'null' "
    "ELSE '\"' || clock_text || '\"' END",
    "tv": "CASE WHEN user_id % 16 = 4 THEN '\"  \"' WHEN user_id % 16 = 5 AND event_id % 5 < 3 THEN '\"\"' "
    "WHEN user_id % 16 = 9 AND event_id % 7 <= 4 THEN 'null' ELSE '\"' || type_text || '\"' END",
}

_FEEDS: dict[tuple[str, str], DerivedFeed] = {}


def derived_feed(spark: SparkSession, sf_dir: str) -> DerivedFeed:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FEEDS:
        _FEEDS[key] = DerivedFeed(spark, sf_dir)
    return _FEEDS[key]

"""Documents and scoreboards as two streams that meet in one keyed state per game.

For each game the state store holds what the feed last said (a fingerprint and the poll), the scoreboard row that is known, the part of it that was
published, and whether the feed answers. A poll is published if its feed differs from the last good one or if status, text or scores differ from
what was published; a poll that fails is reported once, shows the game as degraded, and stays so until something is published again. The state has a fixed size;
document values only pass through. ``operators.snapshots.publish_log`` is the same rule over a table of polls.

With ``patience`` (seconds) a timer marks a game whose feed has not answered for so long. Timers go by the clock of the cluster and fire with
the next batch; without it results depend on the polls alone.

The query writes append-only folders named after the batch, as ``live_states`` does, so a batch that is run again writes the same again. A restart goes on from the checkpoint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hoopline.functions import fixed_values as fv
from hoopline.operators.live_feed import live_feed_actions
from hoopline.operators.payload import state_payload
from hoopline.operators.snapshots import FEED_UNAVAILABLE, METADATA, PARTS_PER_BLOCK, fingerprint
from hoopline.operators.states import game_states, longest_game
from hoopline.sources.feeds import read_live_snapshots
from hoopline.streaming.live_states import DOCUMENT_SCHEMA, SNAPSHOT_SCHEMA, LiveTables

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOARD_SCHEMA = (
    "game_id STRING, poll INT, game_status INT, status_text STRING, period INT, clock STRING, home_team_id BIGINT, home_name STRING, home_city STRING, "
    "home_tricode STRING, home_score INT, away_team_id BIGINT, away_name STRING, away_city STRING, away_tricode STRING, away_score INT"
)
STATE = "poll INT, print STRING, board STRING, meta STRING, shown_board STRING, shown_meta STRING, failing BOOLEAN"
LOG = "game_id STRING, poll INT, cause STRING, feed_changed BOOLEAN, metadata_changed BOOLEAN, feed_status STRING, error STRING, fingerprint STRING, board STRING"
OUTPUT = f"{LOG}, part INT, value STRING"
LOG_SCHEMA = f"{LOG}, batch BIGINT"
_ROW = Row(*[field.split()[0] for field in OUTPUT.split(", ")])


def board_columns() -> list[str]:
    return [field.split()[0] for field in BOARD_SCHEMA.split(", ") if not field.startswith("poll")]


def read_board_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Landed scoreboard rows, as JSON lines with the columns of ``BOARD_SCHEMA``."""
    return spark.readStream.schema(BOARD_SCHEMA).json(folder)


def poll_events(documents: DataFrame, boards: DataFrame) -> DataFrame:
    """Both inputs as rows of one shape; a document part that cannot be read has no ``print``."""
    own_id = "trim(from_json(value, 'STRUCT<game: STRUCT<gameId: STRING>>').game.gameId)"
    fit = f"coalesce({own_id} RLIKE r'{fv.GAME_ID_PATTERN}' AND {own_id} = game_id, false)"
    feed = documents.selectExpr("game_id", "poll", "part", "value", f"CASE WHEN {fit} THEN {fingerprint('value')} END AS print", "CAST(NULL AS STRING) AS board", "CAST(NULL AS STRING) AS meta")
    row = f"to_json(struct({', '.join(board_columns())}))"
    meta = f"to_json(struct({', '.join(METADATA)}), map('ignoreNullFields', 'false'))"
    known = boards.selectExpr("game_id", "poll", "CAST(NULL AS INT) AS part", "CAST(NULL AS STRING) AS value", "CAST(NULL AS STRING) AS print", f"{row} AS board", f"{meta} AS meta")
    return feed.unionByName(known)


def whole_print(prints: list[str | None]) -> str | None:
    """The fingerprint of a poll from those of its parts, in blocks, as ``snapshot_fingerprints`` makes it; none if a part has none."""
    if any(p is None for p in prints):
        return None
    joined = lambda texts: hashlib.sha256(",".join(texts).encode()).hexdigest()
    return joined([joined(prints[k : k + PARTS_PER_BLOCK]) for k in range(0, len(prints), PARTS_PER_BLOCK)])


class Game:
    """The state of one game, and the rule."""

    def __init__(self, stored: tuple | None):
        self.poll, self.print, self.board, self.meta, self.shown_board, self.shown_meta, self.failing = stored or (-1, None, None, None, None, None, False)

    def stored(self) -> tuple:
        return self.poll, self.print, self.board, self.meta, self.shown_board, self.shown_meta, self.failing

    def answered(self, poll: int, print_: str) -> tuple | None:
        """A good poll; the log row, if it is published."""
        feed_changed = print_ != self.print
        metadata_changed = self.shown_meta is None or self.meta != self.shown_meta
        self.poll, self.print = poll, print_
        if not feed_changed and not metadata_changed:
            return None
        self.shown_board, self.shown_meta, self.failing = self.board, self.meta, False
        cause = "feed and metadata" if feed_changed and metadata_changed else "feed" if feed_changed else "metadata"
        return poll, cause, feed_changed, metadata_changed, "live", None, print_, self.board

    def failed(self, poll: int, cause: str) -> tuple | None:
        """A poll that failed; the log row, if it is the first since something was published."""
        self.poll = poll
        if self.failing:
            return None
        self.failing = True
        return poll, cause, False, False, "waiting" if self.shown_meta is None else "degraded", FEED_UNAVAILABLE, self.print, self.shown_board


class PublishedState(StatefulProcessor):
    def __init__(self, patience: float | None = None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("game", STATE)

    def _game(self) -> Game:
        return Game(self.state.get() if self.state.exists() else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        game, out, documents_out, heard = self._game(), [], [], False
        boards: list[tuple] = []
        parts: dict[int, list[tuple]] = {}
        for row in rows:
            if row.meta is None:
                parts.setdefault(int(row.poll), []).append((int(row.part), row.value, row.print))
            else:
                boards.append((int(row.poll), row.board, row.meta))
        boards.sort()
        for poll in sorted(parts):
            while boards and boards[0][0] <= poll:
                _, game.board, game.meta = boards.pop(0)
            if poll <= game.poll:
                continue  # it comes late
            documents = sorted(parts[poll], key=lambda p: p[0])
            print_ = whole_print([p[2] for p in documents])
            heard |= print_ is not None
            logged = game.failed(poll, "failure") if print_ is None else game.answered(poll, print_)
            if logged:
                out.append(_ROW(key[0], *logged, None, None))
                if logged[2]:  # the documents of the newest changed feed go on
                    documents_out = [_ROW(key[0], *logged, part, value) for part, value, _ in documents]
        for _, game.board, game.meta in boards:
            pass
        self.state.update(game.stored())
        if self.patience is not None and heard:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.patience * 1000))
        return iter(out + documents_out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        game = self._game()
        logged = game.failed(game.poll, "silence")
        self.state.update(game.stored())
        return iter([_ROW(key[0], *logged, None, None)] if logged else [])

    def close(self) -> None:
        pass


class PublishedTables(LiveTables):
    """Where the stream keeps its log, changed documents, states and served documents."""

    def log(self) -> DataFrame:
        return self.read("log", LOG_SCHEMA)

    def in_force(self) -> DataFrame:
        """Per game with a usable feed: the poll in force and ``changed``, the batch that brought it."""
        changed = self.log().where("feed_changed")
        return changed.groupBy("game_id").agg(F.max("poll").alias("poll"), F.max("batch").alias("changed"))


def apply_published(tables: PublishedTables, index: DataFrame, rows: DataFrame, batch: int, score: Callable[[DataFrame], DataFrame] | None, chunk_rows: int = 4096) -> None:
    """One batch: the log, the newest changed documents, their states, and the served documents of what was published."""
    rows = rows.persist()
    try:
        tables.write(rows.where("part IS NULL").drop("part", "value"), "log", batch)
        # Each game's are of its newest changed poll alone.
        tables.write(rows.where("part IS NOT NULL").select("game_id", "poll", "part", "value"), "snapshots", batch)
    finally:
        rows.unpersist()
    landed = tables.of_batch("snapshots", SNAPSHOT_SCHEMA, batch)
    tables.write(live_feed_actions(read_live_snapshots(landed)), "actions", batch)
    actions = tables.spark.read.parquet(f"{tables.path('actions')}/batch={batch}")
    tables.write(game_states(actions, index, chunk_rows=chunk_rows, longest=longest_game(actions)), "states", batch)
    if score is None:
        return
    log = tables.of_batch("log", LOG_SCHEMA, batch)
    last = log.groupBy("game_id").agg(F.max_by(F.struct("poll", "feed_status", "error", "board"), "poll").alias("l")).where("l.board IS NOT NULL").select("game_id", "l.*")
    fields = ", ".join(f for f in BOARD_SCHEMA.split(", ") if not f.startswith("poll"))
    board = last.select(F.from_json("board", fields).alias("b")).select("b.*")
    payload = state_payload(board, score(tables.states())).drop("feed_status")
    tables.write(payload.join(last.select("game_id", "poll", "feed_status", "error"), "game_id"), "published", batch)


def start_published(
    documents: DataFrame,
    boards: DataFrame,
    index: DataFrame,
    tables: PublishedTables,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame] | None = None,
    patience: float | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Keep ``tables`` up to date with both streams. ``index`` has the teams of each game; ``score`` adds ``probability`` to states and makes documents served.

    The session's state store must be RocksDB; it is set here if it is not. Timers need a stream that goes on: with ``patience`` a run that ends with what
    has landed would never end.
    """
    if once and patience is not None:
        raise ValueError("patience needs a stream that goes on")
    spark = documents.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    mode = "ProcessingTime" if patience is not None else "None"
    published = poll_events(documents, boards).groupBy("game_id").transformWithState(PublishedState(patience), OUTPUT, "Update", mode)
    writer = published.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda rows, batch: apply_published(tables, index, rows, batch, score))
    return (writer.trigger(availableNow=True) if once else writer).start()


__all__ = ["BOARD_SCHEMA", "DOCUMENT_SCHEMA", "PublishedTables", "read_board_stream", "start_published"]

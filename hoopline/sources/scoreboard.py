"""Scoreboard and single-game documents to one row per game."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.functions import events as ev

_TEAM = "STRUCT<teamId STRING, teamName STRING, teamCity STRING, teamTricode STRING, score STRING>"
GAME_SCHEMA = (
    "STRUCT<gameId STRING, gameStatus STRING, gameStatusText STRING, period STRING, gameClock STRING, "
    f"homeTeam {_TEAM}, awayTeam {_TEAM}>"
)
SCOREBOARD_SCHEMA = f"STRUCT<scoreboard: STRUCT<gameDate STRING, games ARRAY<{GAME_SCHEMA}>>>"
DETAILS_SCHEMA = f"STRUCT<game: {GAME_SCHEMA}>"


def _side(side: str) -> list[str]:
    team = f"game.{side}Team"
    return [
        f"{ev.whole_number(f'{team}.teamId')} AS {side}_team_id",
        f"{ev.clean_text(f'{team}.teamName')} AS {side}_name",
        f"{ev.clean_text(f'{team}.teamCity')} AS {side}_city",
        f"{ev.clean_text(f'{team}.teamTricode')} AS {side}_tricode",
        f"CAST({ev.whole_number(f'{team}.score')} AS INT) AS {side}_score",
    ]


def _games(rows: DataFrame, keep: list[str]) -> DataFrame:
    game_id = ev.clean_text("game.gameId")
    status = f"CAST({ev.whole_number('game.gameStatus')} AS INT)"
    return rows.selectExpr(
        *keep,
        f"CASE WHEN {game_id} = '' THEN raise_error('Game without gameId') ELSE {game_id} END AS game_id",
        f"{status} AS game_status",
        f"CASE {status} WHEN 1 THEN 'scheduled' WHEN 2 THEN 'active' WHEN 3 THEN 'final' END AS phase",
        f"{ev.clean_text('game.gameStatusText')} AS status_text",
        f"coalesce(CAST({ev.whole_number('game.period')} AS INT), 0) AS period",
        f"{ev.clean_text('game.gameClock')} AS clock",
        *_side("home"),
        *_side("away"),
    )


def read_scoreboard(documents: DataFrame, column: str = "value") -> DataFrame:
    """Scoreboard documents to games. A document without a scoreboard object is an error."""
    parsed = documents.select(F.from_json(column, SCOREBOARD_SCHEMA).alias("d"))
    board = "CASE WHEN d.scoreboard IS NULL THEN raise_error('No scoreboard object') ELSE d.scoreboard END"
    games = parsed.selectExpr(f"{board} AS board").selectExpr(
        f"{ev.clean_text('board.gameDate')} AS game_date", "explode(board.games) AS game"
    )
    return _games(games.where("game IS NOT NULL"), ["game_date"])


def read_game_details(documents: DataFrame, column: str = "value") -> DataFrame:
    """Single-game documents to games."""
    parsed = documents.select(F.from_json(column, DETAILS_SCHEMA).alias("d"))
    game = "CASE WHEN d.game IS NULL THEN raise_error('No game object') ELSE d.game END AS game"
    return _games(parsed.selectExpr(game), [])

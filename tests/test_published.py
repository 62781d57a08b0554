"""The stream of published documents against the same rule over a table of polls."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hoopline.operators import snapshots as sn
from hoopline.operators.live_feed import live_feed_actions
from hoopline.sources.derived import DerivedFeed
from hoopline.sources.feeds import read_live_snapshots
from hoopline.streaming import live_states as ls
from hoopline.streaming import published as pb

GAMES = ("0000000001", "0000000002", "0000000003")
PLAYS = [(1, "2pt", "Made", 100, "2"), (2, "rebound", None, 200, "2"), (3, "2pt", "Made", 100, "4")]


def document(game: str, poll: int, shown: int, turned: bool = False, part: int = 0, first: int = 0) -> tuple:
    actions = [
        {"actionNumber": n, "orderNumber": n * 10000, "actionType": kind, "shotResult": shot, "teamId": team, "period": 1, "clock": "PT10M00.00S", "scoreHome": home, "scoreAway": "0"}
        for n, kind, shot, team, home in PLAYS[first:shown]
    ]
    whole = {"gameId": game, "actions": actions}
    return game, poll, part, json.dumps({"game": dict(reversed(list(whole.items()))) if turned else whole})


def board(game: str, poll: int, status: int, text: str | None, home: int | None) -> tuple:
    return game, poll, status, text, 1, "", 100, "H", "", "HHH", home, 200, "A", "", "AAA", 7


@pytest.fixture
def stream(spark, tmp_path):
    """A function that lands documents and boards and lets the stream take them in, starting again from its checkpoint."""
    index = spark.createDataFrame([("live", g, 100, 200) for g in GAMES], "season STRING, game_id STRING, home_team_id BIGINT, away_team_id BIGINT")
    tables = pb.PublishedTables(spark, str(tmp_path / "tables"))
    landings = iter(range(100))

    def run(documents: list[tuple], boards: list[tuple]) -> pb.PublishedTables:
        n = next(landings)
        spark.createDataFrame(documents, ls.DOCUMENT_SCHEMA).write.json(f"{tmp_path}/documents/{n}")
        spark.createDataFrame(boards, pb.BOARD_SCHEMA).write.json(f"{tmp_path}/boards/{n}")
        inputs = ls.read_document_stream(spark, f"{tmp_path}/documents/*"), pb.read_board_stream(spark, f"{tmp_path}/boards/*")
        score = lambda states: states.withColumn("probability", F.lit(0.6))
        pb.start_published(*inputs, index, tables, f"{tmp_path}/checkpoint", score, once=True).awaitTermination()
        return tables

    return run


def logged(tables, columns=("game_id", "poll", "cause", "feed_status")):
    return sorted(tuple(r[c] for c in columns) for r in tables.log().collect())


def test_random_polls_with_restarts(spark, stream):
    draw = random.Random(4)
    polls = []
    for game in GAMES:
        for poll in range(12):
            failed, shown = draw.random() < 0.3, draw.choice((1, 2, 2, 3))
            meta = draw.choice([(2, "Q1", 3), (2, "Q1", 3), (2, None, 3), (3, "Final", 5)])
            polls.append((game, poll, failed, shown, *meta))
    for first, last in ((0, 4), (5, 5), (6, 11)):
        here = [p for p in polls if first <= p[1] <= last]
        documents = [(g, p, 0, '{"game":{"gameId":') if failed else document(g, p, shown, turned=p % 2 == 1) for g, p, failed, shown, *_ in here]
        tables = stream(documents, [board(g, p, *meta) for g, p, _, _, *meta in here])
    prints = spark.createDataFrame([document(g, p, shown) for g, p, _, shown, *_ in polls], ls.DOCUMENT_SCHEMA)
    rows = spark.createDataFrame([(g, p, failed, status, text, home, 7) for g, p, failed, _, status, text, home in polls], "game_id STRING, poll INT, failed BOOLEAN, game_status INT, status_text STRING, home_score INT, away_score INT")
    wanted = sn.publish_log(sn.snapshot_fingerprints(prints).join(rows, ["game_id", "poll"]), "failed")
    names = ("game_id", "poll", "cause", "feed_changed", "metadata_changed", "feed_status", "error", "fingerprint")
    assert logged(tables, names) == sorted(tuple(r[c] for c in names) for r in wanted.collect())
    shown = tables.log().withColumn("b", F.from_json("board", "game_status INT, home_score INT")).selectExpr("game_id", "poll", "b.game_status", "b.home_score")
    assert sorted(map(tuple, shown.where("game_status IS NOT NULL").collect())) == sorted(tuple(r) for r in wanted.select("game_id", "poll", "game_status", "home_score").where("game_status IS NOT NULL").collect())


def test_final_on_an_unchanged_feed_late_polls_and_parts(stream):
    one, two, _ = GAMES
    parts = [document(two, 1, 2), document(two, 1, 3, part=1, first=2)]
    tables = stream([document(one, 1, 2), *parts], [board(one, 1, 2, "Q1", 2), board(two, 1, 2, "Q1", 2)])
    assert logged(tables) == [(one, 1, "feed and metadata", "live"), (two, 1, "feed and metadata", "live")]
    # Two parts are one poll; list positions of later parts count on.
    assert sorted((r.game_id, r.home_score) for r in tables.states().groupBy("game_id").agg(F.max("home_score").alias("home_score")).collect()) == [(one, 2), (two, 4)]
    # A late poll does nothing; the final comes with an unchanged feed.
    tables = stream([document(one, 0, 3), document(one, 2, 2, turned=True)], [board(one, 2, 3, "Final", 9)])
    assert logged(tables)[1] == (one, 2, "metadata", "live")
    served = {(r.game_id, r.batch): r for r in tables.published().collect()}
    assert served[one, 0].home_win_probability == 0.6 and served[one, 1].home_win_probability == 1.0 and (two, 1) not in served
    # Failing is reported once, and an unchanged feed does not end it; a changed one does.
    tables = stream([(one, 3, 0, "{}"), (one, 4, 0, "not json"), document(one, 5, 2)], [board(one, 3, 3, "Final", 9)])
    assert logged(tables)[2:-1] == [(one, 3, "failure", "degraded")]
    tables = stream([document(one, 6, 3)], [])
    assert logged(tables)[3:-1] == [(one, 6, "feed", "live")]


def test_a_silent_feed_is_marked_by_its_timer(spark, tmp_path):
    index = spark.createDataFrame([("live", g, 100, 200) for g in GAMES], "season STRING, game_id STRING, home_team_id BIGINT, away_team_id BIGINT")
    tables = pb.PublishedTables(spark, str(tmp_path / "tables"))
    spark.createDataFrame([document(GAMES[0], 0, 2)], ls.DOCUMENT_SCHEMA).write.json(f"{tmp_path}/documents/0")
    spark.createDataFrame([board(GAMES[0], 0, 2, "Q1", 2)], pb.BOARD_SCHEMA).write.json(f"{tmp_path}/boards/0")
    inputs = ls.read_document_stream(spark, f"{tmp_path}/documents/*"), pb.read_board_stream(spark, f"{tmp_path}/boards/*")
    with pytest.raises(ValueError, match="goes on"):
        pb.start_published(*inputs, index, tables, f"{tmp_path}/checkpoint", patience=0.0, once=True)
    query = pb.start_published(*inputs, index, tables, f"{tmp_path}/checkpoint", patience=0.0)
    try:
        until = time.time() + 90
        while time.time() < until and query.isActive:
            time.sleep(1)
            if (tmp_path / "tables/log").exists() and len(list((tmp_path / "tables/log").glob("batch=*/_SUCCESS"))) >= 2:
                break
    finally:
        query.stop()
    assert (GAMES[0], 0, "silence", "degraded") in logged(tables)


def test_fingerprints_are_worked_out_once(spark):
    """Looking back reads the fingerprints several times; the documents must not be parsed again for each."""
    prints = sn.snapshot_fingerprints(spark.createDataFrame([document(g, p, 2, turned=p == 1) for g in GAMES for p in range(3)], ls.DOCUMENT_SCHEMA))
    assert {r.game_id: r.n for r in prints.groupBy("game_id").agg(F.countDistinct("fingerprint").alias("n")).collect()} == dict.fromkeys(GAMES, 1)
    assert "parse_json" not in sn.changed_snapshots(prints)._jdf.queryExecution().toString().lower()


def test_polled_documents_hold_what_each_poll_shows(spark, tmp_path):
    """Games of over 4,096 actions among them; the items, in order, against the live actions."""
    events = [(e, e % 9 if e < 300 else 20, "click" if e % 3 else "view", e * 0.37) for e in range(5200)]
    frame = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, event_id)"))
    frame.write.parquet(f"{tmp_path}/events.parquet")
    feed = DerivedFeed(spark, str(tmp_path))
    actions = {}
    for r in feed.live_actions().collect():
        actions.setdefault(r.game_id, {})[r.source_index] = r.description
    wanted = {}
    for p in feed.polls().collect():
        for at in range(0, min(p.shown, len(actions[p.game_id])), 4096):
            wanted[p.game_id, p.poll, at // 4096] = (p.failed, [actions[p.game_id][k] for k in range(at, min(at + 4096, p.shown))])
    failed = {(g, p, part): f for (g, p, part), (f, _) in wanted.items()}
    got = {(r.game_id, r.poll, r.part): r.value for r in feed.polled_documents().collect()}
    assert feed.polled_documents().count() == len(got) and got.keys() == wanted.keys() and max(part for *_, part in got) == 1
    for key, value in got.items():
        assert value.endswith("]}}") != failed[key]
        game = json.loads(value + "]}}" if failed[key] else value)["game"]
        assert game["gameId"] == key[0] and [a["description"] for a in game["actions"]] == wanted[key][1]


def test_live_actions_are_made_single_once(spark):
    """Order is found in two looks at the actions; both must read what was written, not make the actions single again."""
    raw = spark.createDataFrame([document(GAMES[0], 0, 3)], ls.DOCUMENT_SCHEMA)
    plan = live_feed_actions(read_live_snapshots(raw))._jdf.queryExecution().toString().lower()
    assert "max_by" not in plan and "parquet" in plan


def test_a_game_takes_and_gives_plain_rows_and_only_its_newest_documents():
    """No frame is made for a game, and of several changed polls of a batch only the newest one's documents go on."""

    class Value:
        stored = None

        def exists(self):
            return self.stored is not None

        def get(self):
            return self.stored

        def update(self, value):
            self.stored = value

    state = pb.PublishedState()
    state.state = Value()
    event = Row("game_id", "poll", "part", "value", "print", "board", "meta")
    rows = [event("g", 1, p, f"text {poll}.{p}", f"print {poll}.{p}", None, None) for poll in (1,) for p in (1, 0)]
    rows += [event("g", 2, 0, "text 2", "print 2", None, None), event("g", 3, 0, "cut", None, None, None), event("g", 1, None, None, None, "board", "meta")]
    out = list(state.handleInputRows(("g",), iter(rows), None))
    assert [(r.poll, r.cause, r.part, r.value) for r in out] == [(1, "feed and metadata", None, None), (2, "feed", None, None), (3, "failure", None, None), (2, "feed", 0, "text 2")]
    assert not list(state.handleInputRows(("g",), iter([event("g", 2, 0, "text 2", "print 2", None, None)]), None))
    out = list(state.handleInputRows(("g",), iter([event("g", 4, p, f"text {p}", f"print {p}", None, None) for p in (1, 0)]), None))
    assert [(r.poll, r.part, r.value) for r in out] == [(4, None, None), (4, 0, "text 0"), (4, 1, "text 1")]

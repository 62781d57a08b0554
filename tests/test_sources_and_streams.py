"""Files with defects, round trips, and the live stream."""

from __future__ import annotations

import gzip
import json

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hoopline.operators import payload as pl
from hoopline.operators import quality as ql
from hoopline.operators import snapshots as sn
from hoopline.sources import feeds as fd
from hoopline.sources import game_log_files as gl
from hoopline.sources import scoreboard as sb
from hoopline.sources import state_store as ss
from hoopline.sources.derived import DerivedFeed
from hoopline.streaming import live_states as ls
from tests.plays import FIELDS, SCHEMA


def document(game_id: str, events: int = 60, **changes) -> dict:
    action = {"period": 1, "clock": "PT10M00.00S", "actionType": "Made Shot", "scoreHome": "2"}
    return {"game": {"gameId": game_id, "actions": [dict(action, actionNumber=i, **changes) for i in range(events)]}}


def test_bad_files_become_rows_and_compressed_files_win(spark, tmp_path):
    def plain(name, text):
        (tmp_path / f"{name}.json").write_bytes(text if isinstance(text, bytes) else text.encode())

    def packed(name, content, cut=None):
        (tmp_path / f"{name}.json.gz").write_bytes(gzip.compress(json.dumps(content).encode())[:cut])

    packed("0000000001", document("0000000001"))
    plain("0000000001", json.dumps(document("0000000001", 10)))
    plain("0000000002", json.dumps(document("0000000002"), indent=2))
    plain("0000000003", "")
    plain("0000000004", "<html>")
    packed("0000000005", document("0000000005", 400), cut=60)
    packed("0000000006", document("0000000099"))
    packed("0000000007", document("0000000007", 10))
    ids = [f"{i:010d}" for i in range(1, 12)]
    index = spark.createDataFrame([("s", i) for i in ids], "season STRING, game_id STRING")
    (tmp_path / "0000000008.json.gz").write_bytes(b"no gzip at all")
    (tmp_path / "0000000009.json").write_bytes(b'{"game": "\xff"}')
    packed("0000000010", document("0000000010"))
    whole = (tmp_path / "0000000010.json.gz").read_bytes()
    (tmp_path / "0000000010.json.gz").write_bytes(gzip.compress(b"  ") + whole)
    files = fd.landed_files(spark, str(tmp_path)).withColumn("season", F.lit("s"))
    found = {r.game_id: r for r in ql.validate_files(index, files).collect()}
    assert [i for i in ids if found[i].is_valid] == ["0000000001", "0000000002", "0000000010"]
    assert found["0000000001"].event_count == 60
    # Spark never lists empty files, so one counts as absent; it is invalid either way.
    assert found["0000000003"].problems == ["there is no file"]
    assert found["0000000004"].problems == ["the document is not readable JSON"]
    assert found["0000000005"].problems == ["the file cannot be read: it is cut off"] and not found["0000000005"].is_missing
    assert found["0000000006"].problems == ["the document is for game 0000000099"]
    assert found["0000000007"].problems == ["too few events: 10"]
    assert found["0000000008"].problems == ["the file cannot be read: it is not gzip"]
    assert found["0000000009"].problems == ["the file cannot be read: it is not UTF-8"]
    assert found["0000000011"].problems == ["there is no file"] and found["0000000011"].is_missing
    listing = fd.file_listing(spark, str(tmp_path))
    assert fd.storage_usage(listing).first().files == 10
    wins = index.withColumn("home_win", F.lit(1))
    on_disk = sum((tmp_path / f"{name}").stat().st_size for name in ("0000000001.json.gz", "0000000002.json", "0000000010.json.gz"))
    assert ql.verify_downloads(wins, files).first().bytes == on_disk


def test_files_are_written_whole_and_read_back(spark, tmp_path):
    actions = [("s1", "0000000001", i, 5000, f"a{i}", 1) for i in range(5000)] + [("s2", "0000000002", 0, 1, "b0", 1)]
    frame = spark.createDataFrame(actions, "season STRING, game_id STRING, source_event_index INT, n_events INT, actionId STRING, period INT")
    assert fd.write_landed_files(fd.compressed_files(fd.to_documents(frame)), str(tmp_path)) == 3
    names = sorted(p.name for p in tmp_path.rglob("*") if p.is_file())
    assert names == ["0000000001.json.gz", "0000000001~1.json.gz", "0000000002.json.gz"]
    back = fd.read_landed_pbp(spark, str(tmp_path)).select("season", "game_id", "source_event_index", "n_events", "actionId", "period")
    assert sorted(map(tuple, back.collect())) == sorted(actions)


def test_key_with_null_is_not_a_missing_key(spark):
    rows = [("s", "0000000001", json.dumps(document("0000000001", actionType=None))), ("s", "0000000002", json.dumps(document("0000000002", clock=None)))]
    found = {r.game_id: r for r in ql.validate_feeds(spark.createDataFrame(rows, "season STRING, game_id STRING, value STRING")).collect()}
    assert found["0000000001"].is_valid
    assert found["0000000002"].problems == ["no readable clock"]


def test_documents_round_trip_in_parts(spark, tmp_path):
    rows = [("2021-22", "0000000001", i, 10, str(i), i, "Foul", "", "PT01M00.00S", 1, 100, "d", "", "", "") for i in range(10)]
    actions = spark.createDataFrame(rows, SCHEMA)
    documents = fd.to_documents(actions, part_rows=4)
    assert documents.count() == 3
    fd.write_raw_pbp(fd.to_documents(actions), str(tmp_path / "raw"))
    back = fd.read_raw_pbp(spark, str(tmp_path / "raw")).select(*FIELDS)
    assert back.exceptAll(actions).isEmpty() and actions.exceptAll(back).isEmpty()


def test_empty_action_list_gives_no_rows(spark):
    rows = [("s", '{"game":{"gameId":"0000000001","actions":[]}}')]
    assert fd.explode_actions(spark.createDataFrame(rows, "season STRING, value STRING")).isEmpty()


def test_game_log_keeps_leading_zeros(spark, tmp_path):
    log = spark.sql("SELECT '0022300001' GAME_ID, DATE '2023-10-24' GAME_DATE, 1L TEAM_ID, 'AAA' TEAM_ABBREVIATION, 'AAA @ BBB' MATCHUP, 'L' WL, 100 PTS")
    path = gl.write_game_log(log, str(tmp_path), "2023-24")
    assert path.endswith("2023-24_regular_season.csv")
    assert gl.read_game_log(spark, str(tmp_path), "2023-24").first().GAME_ID == "0022300001"


def test_states_of_a_missing_season_are_an_error(spark, tmp_path):
    ss.write_states(spark.sql("SELECT '2021-22' season, 'g' game_id, 1 x"), str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError, match="2022-23"):
        ss.read_states(spark, str(tmp_path / "s"), ["2022-23"])
    assert ss.read_states(spark, str(tmp_path / "s"), ["2021-22"], ["season"]).first().season == "2021-22"


def test_overwrite_replaces_only_the_seasons_written(spark, tmp_path):
    path = str(tmp_path / "s")
    ss.write_states(spark.sql("SELECT * FROM VALUES ('2021-22', 'g', 1), ('2022-23', 'h', 2) AS t(season, game_id, x)"), path)
    ss.write_states(spark.sql("SELECT '2022-23' season, 'h' game_id, 7 x"), path, mode="overwrite")
    assert sorted((r.season, r.x) for r in ss.read_states(spark, path).collect()) == [("2021-22", 1), ("2022-23", 7)]


def test_scoreboard_defaults_and_errors(spark):
    def read(text):
        return sb.read_scoreboard(spark.createDataFrame([(text,)], "value STRING")).collect()

    game = {"gameId": "0000000001", "gameStatus": 3, "homeTeam": {"teamId": 5, "teamTricode": " AAA "}, "awayTeam": None}
    (row,) = read(json.dumps({"scoreboard": {"gameDate": "2024-01-01", "games": [game, None]}}))
    assert (row.phase, row.period, row.home_tricode, row.home_score, row.away_team_id, row.away_name) == ("final", 0, "AAA", None, None, "")
    with pytest.raises(PySparkException, match="No scoreboard"):
        read("{}")
    with pytest.raises(PySparkException, match="without gameId"):
        read('{"scoreboard":{"games":[{"gameStatus":1}]}}')


def test_live_documents_are_checked(spark):
    schema = "game_id STRING, poll INT, part INT, value STRING"

    def read(value):
        return fd.read_live_snapshots(spark.createDataFrame([("0000000001", 0, 0, value)], schema)).collect()

    assert read('{"game":{"gameId":"0000000001","actions":null}}') == []
    for bad in ('{"game":{"gameId":"12"}}', '{"game":{"gameId":"0000000002"}}', "{}"):
        with pytest.raises(PySparkException, match="valid game id"):
            read(bad)


def test_fingerprints_ignore_key_order(spark):
    a, b, c = '{"x":1,"y":{"p":1,"q":2}}', '{"y":{"q":2,"p":1},"x":1}', '{"x":1,"y":{"p":1,"q":3}}'
    prints = [spark.sql(f"SELECT {sn.fingerprint(chr(39) + t + chr(39))}").first()[0] for t in (a, b, c)]
    assert prints[0] == prints[1] != prints[2]


def test_a_b_a_is_three_changes(spark):
    rows = spark.createDataFrame([("g", i, f) for i, f in enumerate("AAABBA")], "game_id STRING, poll INT, fingerprint STRING")
    assert sorted(r.poll for r in sn.changed_snapshots(rows).collect()) == [0, 3, 5]


def test_final_on_an_unchanged_feed_is_published(spark):
    schema = "game_id STRING, poll INT, game_status INT, status_text STRING, home_score INT, away_score INT"
    rows = [("g", 0, 2, "Q4", 100, 90), ("g", 1, 2, "Q4", 100, 90), ("g", 2, 3, "Final", 100, 90)]
    assert sorted(r.poll for r in sn.metadata_changes(spark.createDataFrame(rows, schema)).collect()) == [0, 2]


def live(game_id: str, plays: list[tuple], poll: int) -> tuple:
    actions = [
        {"actionNumber": n, "orderNumber": n * 10000, "actionType": kind, "shotResult": shot, "teamId": team, "period": 1,
         "clock": "PT10M00.00S", "scoreHome": home, "scoreAway": "0", "description": f"play {n}"}
        for n, kind, shot, team, home in plays
    ]
    return game_id, poll, 0, json.dumps({"game": {"gameId": game_id, "actions": actions}})


def test_stream_rebuilds_changed_games_only(spark, tmp_path):
    index = spark.createDataFrame([("live", g, 100, 200) for g in ("0000000001", "0000000002")], "season STRING, game_id STRING, home_team_id BIGINT, away_team_id BIGINT")
    tables = ls.LiveTables(spark, str(tmp_path / "tables"))
    first = [(1, "2pt", "Made", 100, "2"), (2, "rebound", None, 200, "2"), (3, "2pt", "Made", 100, "4")]
    corrected = [first[0], (3, "2pt", "Made", 100, "5")]
    polls = [
        [live("0000000001", first, 0), live("0000000002", first[:1], 0)],
        [live("0000000001", first, 1), live("0000000002", first[:1], 1)],
        [live("0000000001", corrected, 2), live("0000000002", first[:1], 2)],
    ]
    seen = []
    for n, poll in enumerate(polls):
        spark.createDataFrame(poll, ls.DOCUMENT_SCHEMA).coalesce(1).write.json(f"{tmp_path}/landing/{n}")
        stream = ls.read_document_stream(spark, f"{tmp_path}/landing/*")
        ls.start_live_states(stream, index, tables, f"{tmp_path}/checkpoint", once=True).awaitTermination()
        seen.append({r.game_id: r.poll for r in tables.snapshots().collect()})
    # An equal poll changes nothing; a correction replaces all states of its game.
    assert seen == [{"0000000001": 0, "0000000002": 0}, {"0000000001": 0, "0000000002": 0}, {"0000000001": 2, "0000000002": 0}]
    states = sorted((r.game_id, r.source_event_index, r.home_score) for r in tables.states().collect())
    assert states == [("0000000001", 0, 2), ("0000000001", 1, 5), ("0000000002", 0, 2)]
    # Running a batch again writes the same folders again.
    ls.apply_batch(tables, index, spark.createDataFrame(polls[2], ls.DOCUMENT_SCHEMA), 2)
    assert sorted((r.game_id, r.source_event_index, r.home_score) for r in tables.states().collect()) == states

    board = spark.createDataFrame(
        [("0000000001", 3, "Final", 4, "", 100, "H", "", "HHH", 9, 200, "A", "", "AAA", 7), ("0000000003", 1, "", 0, "", 100, "H", "", "", None, 200, "A", "", "", None)],
        "game_id STRING, game_status INT, status_text STRING, period INT, clock STRING, home_team_id BIGINT, home_name STRING, home_city STRING, home_tricode STRING, "
        "home_score INT, away_team_id BIGINT, away_name STRING, away_city STRING, away_tricode STRING, away_score INT",
    )
    payload = {r.game_id: r for r in pl.state_payload(board, tables.states().withColumn("probability", F.lit(0.6))).collect()}
    final, waiting = payload["0000000001"], payload["0000000003"]
    assert (final.home_win_probability, final.final_override_applied, final.possession.label) == (1.0, True, "AAA")
    assert (waiting.feed_status, waiting.status_text, waiting.recent_events) == ("waiting", "Waiting for play-by-play", [])


def test_stream_sets_bad_games_aside_and_publishes_changes(spark, tmp_path):
    index = spark.createDataFrame([("live", g, 100, 200) for g in ("0000000001", "0000000002")], "season STRING, game_id STRING, home_team_id BIGINT, away_team_id BIGINT")
    tables = ls.LiveTables(spark, str(tmp_path / "tables"))
    plays = [(1, "2pt", "Made", 100, "2"), (3, "2pt", "Made", 100, "4")]
    one, two, strange = "0000000001", "0000000002", "0000000009"
    columns = (
        "game_id STRING, game_status INT, status_text STRING, period INT, clock STRING, home_team_id BIGINT, home_name STRING, home_city STRING, home_tricode STRING, "
        "home_score INT, away_team_id BIGINT, away_name STRING, away_city STRING, away_tricode STRING, away_score INT"
    )
    seen_board = {"status": (2, "Q1")}

    def board():
        teams = (1, "", 100, "H", "", "HHH", 9, 200, "A", "", "AAA", 7)
        return spark.createDataFrame([(one, *seen_board["status"], *teams), (two, 2, "Q1", *teams), ("0000000003", 1, "", *teams)], columns)

    def step(batch, rows):
        ls.apply_batch(tables, index, spark.createDataFrame(rows, ls.DOCUMENT_SCHEMA), batch)
        ls.publish(tables, board(), lambda states: states.withColumn("probability", F.lit(0.6)), batch)
        scores = {r.game_id: r.home_score for r in tables.states().orderBy("source_event_index").collect()}
        out = {r.game_id: r.feed_status for r in tables.published().where(F.col("batch") == batch).collect()}
        return scores, out

    # One broken document and one unknown game do not stop the good one.
    assert step(0, [live(one, plays, 0), (two, 0, 0, "{}"), live(strange, plays, 0)]) == ({one: 4}, {one: "live", two: "waiting", "0000000003": "waiting"})
    assert {(r.game_id, r.reason) for r in tables.problems().collect()} == {(two, "document"), (strange, "game")}
    # The second game recovers; the first is unchanged and not published again.
    assert step(1, [live(one, plays, 5), live(two, plays[:1], 5)]) == ({one: 4, two: 2}, {two: "live"})
    # A poll that arrives late is ignored.
    assert step(2, [live(one, plays[:1], 3)]) == ({one: 4, two: 2}, {})
    # A bad score sets the whole game aside: its last state stays, marked degraded.
    assert step(3, [live(one, [(1, "2pt", "Made", 100, "two")], 6)]) == ({one: 4, two: 2}, {one: "degraded"})
    # An equal feed keeps it degraded, as nothing new is known; the final score does not wait for the feed.
    assert step(4, [live(one, plays, 7)]) == ({one: 4, two: 2}, {})
    seen_board["status"] = (3, "Final")
    assert step(5, [live(one, plays, 8)]) == ({one: 4, two: 2}, {one: "live"})
    final = tables.published().where("batch = 5").first()
    assert final.home_win_probability == 1.0 and final.final_override_applied
    # The same batch again publishes the same.
    assert step(5, [live(one, plays, 8)])[1] == {one: "live"}


def test_only_doubtful_games_are_put_in_order_to_set_them_aside(spark, monkeypatch):
    """A bad arrival that is corrected later sets nothing aside; good games are not put in order for it."""
    good, fixed, bad, strange, half, clockless = (f"000000000{k}" for k in range(1, 7))
    rows = [("live", g, 100, 200) for g in (good, fixed, bad, clockless)] + [("live", half, 100, None), ("2021-22", strange, 100, 200)]
    index = spark.createDataFrame(rows, "season STRING, game_id STRING, home_team_id BIGINT, away_team_id BIGINT")
    wrong, right = (1, "2pt", "Made", 100, "two"), (1, "2pt", "Made", 100, "2")
    documents = [live(good, [right], 0), live(fixed, [wrong, right], 0), live(bad, [right, wrong], 0), live(strange, [right], 0), live(half, [right], 0)]
    documents.append((*live(clockless, [right], 0)[:3], live(clockless, [right], 0)[3].replace("PT10M00.00S", " ")))
    ordered, plain = set(), ls.live_feed_actions
    monkeypatch.setattr(ls, "live_feed_actions", lambda actions, **more: ordered.update(r.game_id for r in actions.select("game_id").distinct().collect()) or plain(actions, **more))
    found = {r.game_id: r.reason for r in ls.set_aside(spark.createDataFrame(documents, ls.DOCUMENT_SCHEMA), index).collect()}
    assert found == {bad: "home score", strange: "game", half: "game", clockless: "period or clock"}
    assert ordered == {fixed, bad, strange, half}


def most_read_at_once(folder) -> int:
    """The most bytes of documents in one row group."""
    groups = [m.row_group(k) for f in folder.rglob("*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    return max(g.column(c).total_uncompressed_size for g in groups for c in range(g.num_columns))


def test_large_documents_are_read_a_few_at_a_time(spark, tmp_path):
    """Readers hold the text of a whole row group; 80 documents of a megabyte were one."""
    rows = spark.range(0, 80, 1, 1).selectExpr("'0000000001' AS game_id", "CAST(id AS INT) AS poll", "0 AS part", "repeat(uuid(), 28000) AS value")
    tables = ls.LiveTables(spark, str(tmp_path / "tables"))
    tables.write(rows, "snapshots", 0)
    assert most_read_at_once(tmp_path / "tables") < 24 << 20
    assert tables.of_batch("snapshots", ls.SNAPSHOT_SCHEMA, 0).agg(F.sum(F.length("value"))).first()[0] == 80 * 36 * 28000


def test_polled_snapshots_show_what_has_arrived(spark, tmp_path):
    """Poll 0 shows half of a game, the others all of it, poll 2 with keys turned; one game is longer than a document. Gathering leaves the session as it was."""
    events = [(e, e % 9 if e < 300 else 20, "click" if e % 3 else "view", e * 0.37) for e in range(9500)]
    frame = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, event_id)"))
    frame.write.parquet(f"{tmp_path}/events.parquet")
    feed = DerivedFeed(spark, str(tmp_path))
    before = dict(spark.conf.getAll)
    actions = {}
    for r in feed.live_actions().collect():
        actions.setdefault(r.game_id, {})[r.source_index] = r.description
    wanted = {}
    for game, own in actions.items():
        for poll in range(3):
            shown = [own[k] for k in range(len(own)) if poll or k < len(own) / 2]
            for at in range(0, len(shown), 4096):
                wanted[game, poll, at // 4096] = shown[at : at + 4096]
    got = {(r.game_id, r.poll, r.part): r.value for r in feed.snapshots().collect()}
    assert feed.snapshots().count() == len(got) and got.keys() == wanted.keys() and max(part for *_, part in got) == 2
    for (game, poll, part), value in got.items():
        whole = json.loads(value)["game"]
        assert whole["gameId"] == game and [a["description"] for a in whole["actions"]] == wanted[game, poll, part]
        assert ("note" in whole) == (poll == 2 and int(game) % 2 == 1) and (list(whole["actions"][0])[-1] == "actionNumber") == (poll == 2)
    assert dict(spark.conf.getAll) == before

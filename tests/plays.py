"""Small play-by-play builders, and a plain sequential reading of the rules to compare with."""

from __future__ import annotations

import random
import re

SCHEMA = (
    "season STRING, game_id STRING, source_event_index INT, n_events INT, actionId STRING, actionNumber INT, "
    "actionType STRING, subType STRING, clock STRING, period INT, teamId BIGINT, description STRING, "
    "scoreHome STRING, scoreAway STRING, shotResult STRING"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
HOME, AWAY = 100, 200


def play(kind="", sub="", team=None, *, period=1, clock="PT10M00.00S", number=None, home="", away="", text="", shot=""):
    return dict(
        actionType=kind, subType=sub, teamId=team, period=period, clock=clock, actionNumber=number, scoreHome=home,
        scoreAway=away, description=text, shotResult=shot,
    )


def rows(game_id: str, plays: list[dict], season: str = "2021-22") -> list[tuple]:
    out = []
    for i, p in enumerate(plays):
        number = i + 1 if p["actionNumber"] is None else p["actionNumber"]
        full = dict(p, season=season, game_id=game_id, source_event_index=i, n_events=len(plays), actionId=str(i), actionNumber=number)
        out.append(tuple(full[f] for f in FIELDS))
    return out


def frame(spark, games: dict[str, list[dict]]):
    return spark.createDataFrame([r for g, plays in games.items() for r in rows(g, plays)], SCHEMA)


def index_of(spark, games, home_pts=0, away_pts=0, home_win=1):
    return spark.createDataFrame(
        [("2021-22", g, HOME, AWAY, home_pts, away_pts, home_win) for g in games],
        "season STRING, game_id STRING, home_team_id BIGINT, away_team_id BIGINT, home_pts INT, away_pts INT, home_win INT",
    )


NEUTRAL = {"technical", "double technical", "bench", "flopping"}
UNCOUNTED = NEUTRAL | {"offensive", "offensive charge"}


def walk(plays: list[dict]) -> list[tuple]:
    """(home, away, team, reason, home fouls, away fouls, emitted) after each play, one play at a time."""
    score, fouls, tops = [0, 0], {}, {}
    period = team = reason = pending = shown = None
    out = []
    for i, p in enumerate(plays):
        number = i + 1 if p["actionNumber"] is None else p["actionNumber"]
        kind, sub = p["actionType"].strip().lower(), p["subType"].strip().lower()
        who = p["teamId"] if p["teamId"] and p["teamId"] > 0 else None
        mine = who if who in (HOME, AWAY) else None
        other = {HOME: AWAY, AWAY: HOME}.get(who)
        if p["period"] != period:
            period, team, reason, pending, fouls = p["period"], None, "period start unknown", None, {HOME: 0, AWAY: 0}
        texts = [p["scoreHome"].strip(), p["scoreAway"].strip()]
        if any(texts) and not (kind == "instant replay" and "overturn" not in sub):
            key = (p["period"], p["clock"].strip())
            late = number < tops.get(key, -1)
            tops[key] = max(tops.get(key, -1), number)
            new = [int(float(t)) if t else s for t, s in zip(texts, score, strict=True)]
            if not late and (kind != "period" or all(n >= s for n, s in zip(new, score, strict=True))):
                score = new
        if kind == "period" and sub == "end":
            team, reason, pending = None, "period ended", None
        elif kind == "jump ball":
            team, reason, pending = None, "jump ball winner ambiguous", None
        elif kind in ("made shot", "turnover"):
            team, reason, pending = other, "made field goal" if kind == "made shot" else "turnover", None
        elif kind == "missed shot":
            team, reason, pending = mine, "missed field goal awaiting rebound", who
        elif kind == "rebound":
            if pending is None or who is None:
                team, reason = None, "rebound ownership or associated miss ambiguous"
            else:
                team, reason = mine, "offensive rebound" if who == pending else "defensive rebound"
            pending = None
        elif kind == "foul":
            if sub not in NEUTRAL:
                team, reason = other, f"{sub or 'untyped'} foul"
            if sub not in UNCOUNTED and who in fouls:
                fouls[who] += 1
        elif kind == "free throw":
            found = re.search(r"(\d+)\s+of\s+(\d+)", sub)
            made = p["shotResult"].strip().lower() == "made" if p["shotResult"].strip() else not p["description"].upper().startswith("MISS ")
            if "technical" in sub:
                pending = None
            elif not found:
                team, reason = None, "unparseable free throw sequence"
            elif int(found[1]) < int(found[2]):
                team, reason, pending = mine, "free throw sequence continues", None
            elif "flagrant" in sub or "clear path" in sub:
                team, reason, pending = mine, "special free throws retain possession", None
            elif made:
                team, reason, pending = other, "final free throw made", None
            else:
                team, reason, pending = mine, "final free throw missed awaiting rebound", who
        now = (*score, period, p["clock"], team, fouls[HOME], fouls[AWAY])
        out.append((*score, team, reason, fouls[HOME], fouls[AWAY], now != shown))
        shown = now
    return out


KINDS = [
    ("Made Shot", [""]), ("Missed Shot", [""]), ("Rebound", [""]), ("Rebound", [""]), ("Turnover", ["Bad Pass"]),
    ("Foul", ["Personal", "Offensive", "Technical", "", "Bench"]), ("Jump Ball", [""]), ("period", ["start", "end"]), ("Period", ["END"]),
    ("Free Throw", ["Free Throw 1 of 2", "Free Throw 2 of 2", "Free Throw Technical", "Free Throw Flagrant 2 of 2", "Free Throw"]),
    ("Instant Replay", ["Support Ruling", "Overturn Ruling"]), ("", [""]), ("Substitution", [""]),
]


def random_game(seed: int, length: int, anchors: bool = True) -> list[dict]:
    """A game with flapping periods, foreign teams, blanks on one side, stale and late scores."""
    r = random.Random(seed)
    plays, period, home, away = [], 1, 0, 0
    for i in range(length):
        if r.random() < 0.04:
            period = max(1, min(5, period + r.choice([1, 1, -1])))
        kind, subs = r.choice(KINDS)
        home, away = home + r.choice([0, 0, 2]), away + r.choice([0, 0, 3])
        shown_home, shown_away = "", ""
        if r.random() < 0.45:
            shown_home, shown_away = str(max(0, home - r.choice([0, 0, 4]))), str(max(0, away - r.choice([0, 0, 5])))
            side = r.random()
            if side < (0.3 if anchors else 0.5):
                shown_home = ""
            elif side > (0.7 if anchors else 0.5):
                shown_away = ""
        plays.append(
            play(
                kind, r.choice(subs), r.choice([HOME, HOME, AWAY, AWAY, None, 0, 999]), period=period,
                clock=f"PT{11 - (i // 4) % 12:02d}M00.00S", number=max(0, i + r.choice([0, 0, 0, -3, 2])),
                home=shown_home, away=shown_away, text=r.choice(["Player", "MISS Player", "x STEAL (1)"]), shot=r.choice(["", "Made", "Missed"]),
            )
        )
    return plays

"""Expressions, metrics, sets, samples and manifest on small inputs."""

from __future__ import annotations

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hoopline.functions import clock as ck
from hoopline.functions import events as ev
from hoopline.functions import fixed_values as fv
from hoopline.functions import live as lv
from hoopline.operators import dataset as ds
from hoopline.operators import live_feed as lf
from hoopline.operators import manifest as mf
from hoopline.operators import metrics as mt
from hoopline.operators import models as md
from hoopline.operators import parity as pa
from hoopline.operators import sampling as sa
from hoopline.operators.history import carry_last
from hoopline.operators.ordinal import with_position


def value(spark, text: str):
    return spark.sql(f"SELECT {text}").first()[0]


@pytest.mark.parametrize("text, seconds", [("PT06M07.00S", 367.0), ("PT00M02.60S", 2.6), (" PT12M00.00S\t", 720.0), ("PT5M3S", 303.0)])
def test_clock(spark, text, seconds):
    assert value(spark, ck.parse_clock(f"'{text}'")) == pytest.approx(seconds)


@pytest.mark.parametrize("text", ["6:07", "", "PT13M00.00S", "PT01M", "xPT01M00S"])
def test_bad_clock(spark, text):
    with pytest.raises(PySparkException, match="Clock"):
        value(spark, ck.parse_clock(f"'{text}'"))
    assert value(spark, ck.parse_clock(f"'{text}'", "quarantine")) is None


@pytest.mark.parametrize("period, seconds, left", [(1, 720, 2880), (4, 360, 360), (5, 300, 0), (7, 175, 0)])
def test_regulation_seconds(spark, period, seconds, left):
    assert value(spark, ck.regulation_seconds(str(period), f"{seconds}D")) == left


@pytest.mark.parametrize(
    "text, expected", [("'12'", 12), ("' 7 '", 7), ("'100.0'", None), ("'x'", None), ("0", None), ("-3", None), ("NULL", None)]
)
def test_team_ids(spark, text, expected):
    assert value(spark, ev.normalize_team_id(text)) == expected


def test_white_space_of_every_kind_goes(spark):
    assert value(spark, ev.clean_text(r"' \t a b 　\n'")) == "a b"


def test_bins_close_on_the_right_edge(spark):
    assert [value(spark, ck.time_bin(t)) for t in ("0", "120", "121", "2161", "-1")] == ["0-2m", "0-2m", "2-6m", ">36m", None]
    assert [value(spark, ck.score_bin(t)) for t in ("-2", "3", "20", "-21")] == ["0-2", "3-5", "11-20", "20+"]


@pytest.mark.parametrize("p, expected", [("0.3D", 2), ("0.30000000000000004D", 3), ("1D", 9), ("0D", 0), ("0.6D", 5), ("0.7D", 6)])
def test_bin_edges_are_those_of_floating_point(spark, p, expected):
    edges = np.linspace(0.0, 1.0, 11)
    assert mt.bin_edges(10) == pytest.approx(edges, abs=0)
    assert value(spark, mt.bin_number(p)) == expected == min(int(np.searchsorted(edges, float(p[:-1]), side="right")) - 1, 9)


def test_live_subtypes(spark):
    assert value(spark, lv.foul_subtype("'offensive'", "'Charge'")) == "Offensive Charge"
    assert value(spark, lv.foul_subtype("'technical'", "'defensive'")) == "Defensive Technical"
    assert value(spark, lv.free_throw_subtype("'1 of 2'", "NULL", "array('x', 'Flagrant')")) == "Free Throw flagrant 1 of 2"
    assert value(spark, lv.canonical_type("'new-unseen-type'", "''")) == ""


def test_known_metrics(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9)], "home_win INT, probability DOUBLE")
    found = mt.probability_metrics(rows).first()
    assert (found.brier, found.accuracy, found.roc_auc) == (pytest.approx(0.085), 1.0, 1.0)
    assert mt.calibration_bins(rows).count() == 10
    with pytest.raises(PySparkException, match="Not a probability"):
        mt.probability_metrics(rows.withColumn("probability", F.lit(1.5))).collect()


def test_auc_against_all_pairs(spark):
    r = random.Random(5)
    data = [(r.randint(0, 1), round(r.random(), 2)) for _ in range(400)]
    pairs = [(p > q) + (p == q) / 2 for y, p in data if y for z, q in data if not z]
    found = mt.probability_metrics(spark.createDataFrame(data, "home_win INT, probability DOUBLE")).first()
    assert found.roc_auc == pytest.approx(sum(pairs) / len(pairs))
    loss = -sum(math.log(max(p, 1e-7)) if y else math.log(max(1 - p, 1e-7)) for y, p in data) / len(data)
    assert found.log_loss == pytest.approx(loss, abs=1e-9)


def test_auc_of_saturated_probabilities(spark):
    """Most probabilities are distinct and lie below 2^-20 or near one half: they still spread over the blocks."""
    r = random.Random(7)
    draws = [lambda: r.random() * 2**-21, lambda: 0.5 + r.random() * 1e-9, lambda: 1 - r.random() * 1e-8, lambda: 0.25]
    data = [(int(r.random() < 0.3 + 0.4 * (k % 4 == 2)), draws[k % 4]()) for k in range(4000)]
    frame = spark.createDataFrame(data, "home_win INT, probability DOUBLE")
    counts = mt.outcome_counts(frame, [])
    sizes = [row["count"] for row in counts.repartitionByRange(8, "p").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    losers = sorted(p for y, p in data if not y)
    beaten = sum(bisect.bisect_left(losers, p) + (bisect.bisect_right(losers, p) - bisect.bisect_left(losers, p)) / 2 for y, p in data if y)
    found = mt.probability_metrics(frame).first()
    assert found.roc_auc == pytest.approx(beaten / (len(losers) * (len(data) - len(losers))), abs=1e-12)


def states_like(spark, games: dict[str, int], season="2021-22"):
    rows = [(season, g, i, float(i % 3), i % 2, int(g[-1]) % 2) for g, n in games.items() for i in range(n)]
    return spark.createDataFrame(rows, "season STRING, game_id STRING, source_event_index INT, x DOUBLE, possession_known INT, home_win INT")


def test_weights_balance_games(spark):
    weighted = ds.game_balanced_weights(states_like(spark, {"g1": 2, "g2": 4}))
    totals = {r.game_id: r.total for r in weighted.groupBy("game_id").agg(F.sum("weight").alias("total")).collect()}
    assert totals["g1"] == pytest.approx(totals["g2"])
    assert weighted.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_splits_must_be_isolated(spark):
    train, test = states_like(spark, {"g1": 3}), states_like(spark, {"g2": 3}, "2023-24")
    ds.assert_isolated_splits({"train": train, "test": test})
    with pytest.raises(ValueError, match="wrong season"):
        ds.assert_isolated_splits({"train": train, "test": train})
    with pytest.raises(ValueError, match="Unknown split"):
        ds.make_split(train, "holdout")
    with pytest.raises(ValueError, match="target"):
        ds.assert_no_target_leak(train, ("x", "home_win"))


def test_scaler_is_fitted_on_the_train_season_only(spark):
    features = ("x",)
    row = md.fit_scaler(states_like(spark, {"g1": 6}), features).first()
    assert (row.means["x"], row.scales["x"]) == (pytest.approx(1.0), pytest.approx(math.sqrt(2 / 3)))
    with pytest.raises(PySparkException, match="must be fitted"):
        md.fit_scaler(states_like(spark, {"g1": 6}, "2022-23"), features).collect()


def test_frozen_scaler_on_the_documented_state(spark):
    """A published scaler and a published model input."""
    means = dict(zip(fv.MODEL_FEATURES, (0.8871393649151496, 2.519594019589848, 343.5037085551236, 1413.56624443091, None, 0.006814313604431911, None, None, 2.2728165829564984, 2.26941255485658), strict=True))
    scales = dict(zip(fv.MODEL_FEATURES, (11.715110854057926, 1.1301893795059197, 212.30227791141047, 835.8047734993806, None, 0.0948226933146525, None, None, 1.9386411373541186, 1.9417753724464955), strict=True))
    state = dict(zip(fv.MODEL_FEATURES, (18, 2, 468.0, 1908.0, 0, 0, 1, 1, 1, 3), strict=True))
    scaler = spark.createDataFrame(
        [({k: v for k, v in means.items() if v is not None}, {k: v for k, v in scales.items() if v is not None}, {"home_possession": 0.5})],
        "means MAP<STRING, DOUBLE>, scales MAP<STRING, DOUBLE>, imputations MAP<STRING, DOUBLE>",
    )
    found = md.apply_scaler(spark.createDataFrame([state]), scaler).first().asDict()
    for name, raw in state.items():
        expected = raw if means[name] is None else (raw - means[name]) / scales[name]
        assert found[name] == pytest.approx(expected)
    layers = [(np.random.default_rng(i).normal(size=shape), np.random.default_rng(9).normal(size=shape[0])) for i, shape in enumerate([(64, 10), (32, 64), (1, 32)])]
    signal = np.array([found[n] for n in fv.MODEL_FEATURES])
    for depth, (w, b) in enumerate(layers):
        signal = w @ signal + b if depth == 2 else np.maximum(w @ signal + b, 0)
    scaled = md.apply_scaler(spark.createDataFrame([state]), scaler)
    assert md.score_mlp(scaled, layers).first().logit == pytest.approx(signal[0])


def test_logistic_fit_against_newton_steps(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(300, 2))
    y = (g.random(300) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1] + 0.3)))).astype(float)
    w = np.where(np.arange(300) % 3 == 0, 2.0, 0.5)
    design, beta, c = np.column_stack([x, np.ones(300)]), np.zeros(3), 0.7
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = c * design.T @ (w * (p - y)) + penalty @ beta
        hessian = c * (design * (w * p * (1 - p))[:, None]).T @ design + penalty
        beta -= np.linalg.solve(hessian, gradient)
    rows = spark.createDataFrame([(float(a), float(b), int(t), float(v)) for (a, b), t, v in zip(x, y, w, strict=True)], "a DOUBLE, b DOUBLE, home_win INT, w DOUBLE")
    model = md.fit_logistic(rows, ("a", "b"), c=c, weight="w", tolerance=1e-9)
    assert [*model.coefficients, model.intercept] == pytest.approx(list(beta), abs=1e-4)


def test_live_actions_once_each_and_in_order(spark):
    fields = "game_id STRING, source_index INT, orderNumber BIGINT, actionNumber BIGINT, scoreHome STRING"
    actions = [("g", i, (20 - i) * 10000, 20 - i, "0") for i in range(20)] + [("g", 20, 50000, 5, "9")]
    kept = lf.live_order(lf.dedupe_live(spark.createDataFrame(actions, fields))).orderBy("source_event_index").collect()
    assert [r.orderNumber for r in kept] == sorted(r.orderNumber for r in kept) and len(kept) == 20
    assert [r.scoreHome for r in kept if r.orderNumber == 50000] == ["9"]
    odd = spark.createDataFrame([("g", 0, None, None, ""), ("g", 1, None, None, ""), ("g", 2, 0, 7, ""), ("g", 3, 1, 8, "")], fields)
    assert [r.source_index for r in lf.live_order(lf.dedupe_live(odd)).orderBy("source_event_index").collect()] == [3, 2, 0, 1]


def test_parity_needs_both_sides(spark):
    row = {"season": "s", "source_event_index": 0, "action_number": 1, **{f: 1 for f in fv.PARITY_FIELDS}, "clock": "PT01M00.00S"}
    sides = [spark.createDataFrame([dict(row, game_id=g) for g in games]) for games in (("g1", "g2"), ("g1",))]
    same = pa.parity_report(sides[1], sides[1]).first()
    assert (same.historical_states, same.aligned_states, same.anchor_matches) == (1, 1, 1) and set(same.percents.values()) == {100.0}
    with pytest.raises(PySparkException, match="Only one side has game g2"):
        pa.parity_report(*sides).collect()


def test_positions_do_not_depend_on_blocks(spark):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.6 else r.choice("ab"), n) for n in r.sample(range(10_000), 500)]
    df = spark.createDataFrame(data, "k STRING, n INT")
    for width in (1, 13, 100_000):
        placed = with_position(df, ["k"], ["n"], block=F.expr(f"CAST(floor(n / {width}) AS BIGINT)"), total="size").collect()
        for key in ("hot", "a", "b"):
            mine = sorted((row for row in placed if row.k == key), key=lambda row: row.n)
            assert [row.position for row in mine] == list(range(len(mine)))
            assert {row.size for row in mine} == {len(mine)}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_carry_last(spark, block):
    r = random.Random(2)
    data = [(k, i, r.choice([None, None, i])) for k in "ab" for i in range(40)]
    got = carry_last(spark.createDataFrame(data, "k STRING, i INT, v INT"), ["k"], "i", {"seen": "v"}, block).collect()
    for row in got:
        earlier = [v for k, i, v in data if k == row.k and i < row.i and v is not None]
        assert row.seen == (earlier[-1] if earlier else None)


def test_manifest_rules(spark):
    old = spark.createDataFrame(
        [("a", "downloaded", 0, "downloaded", 400, None, None, None), ("b", "failed", 2, "failed", None, "E", "old", None), ("c", "pending", 0, None, None, None, None, None)],
        mf.COLUMNS,
    )
    run = spark.createDataFrame(
        [("a", "failed", None, "OSError", "x" * 600), ("b", "downloaded", 450, None, None)],
        "game_id STRING, action STRING, event_count INT, error_type STRING, error STRING",
    )
    new = {r.game_id: r for r in mf.manifest_update(old, run).collect()}
    assert (new["a"].status, new["a"].attempts, new["a"].event_count, len(new["a"].error)) == ("failed", 1, 400, 500)
    assert (new["b"].status, new["b"].attempts, new["b"].error) == ("downloaded", 2, None)
    assert new["c"].status == "pending"
    # The event count of a game that failed later is still summed.
    assert mf.manifest_summary(mf.manifest_update(old, run)).first().events == 850


def test_trajectories_need_an_overtime_game(spark):
    rows = spark.createDataFrame([("s", "g", 0, 1, 2, 1)], "season STRING, game_id STRING, source_event_index INT, period INT, score_differential INT, home_win INT")
    with pytest.raises(PySparkException, match="No overtime game"):
        sa.select_trajectory_games(rows).collect()

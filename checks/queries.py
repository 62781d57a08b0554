"""One query per operator of the inventory. All of them run over whole tables."""

from __future__ import annotations

import gzip
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopline.functions import clock as ck
from hoopline.functions import events as ev
from hoopline.functions import fixed_values as fv
from hoopline.functions import live as lv
from hoopline.operators import dataset as ds
from hoopline.operators import index as ix
from hoopline.operators import live_feed as lf
from hoopline.operators import manifest as mf
from hoopline.operators import metrics as mt
from hoopline.operators import models as md
from hoopline.operators import parity as pa
from hoopline.operators import payload as pl
from hoopline.operators import profiling as pf
from hoopline.operators import quality as ql
from hoopline.operators import replay as rp
from hoopline.operators import rollups as ru
from hoopline.operators import sampling as sa
from hoopline.operators import snapshots as sn
from hoopline.operators import states as st
from hoopline.operators.history import carry_last
from hoopline.plans import modelling as pm
from hoopline.plans import season as ps
from hoopline.session import scratch_path
from hoopline.sources import feeds as fd
from hoopline.sources import game_log_files as gl
from hoopline.sources import scaler_files as sc
from hoopline.sources import scoreboard as sb
from hoopline.sources import state_store as ss
from hoopline.sources.derived import PROBABILITY, DerivedFeed, derived_feed
from hoopline.streaming import live_states as ls
from hoopline.streaming import published as pb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    """Register ``f(feed)`` under ``key`` as ``f(spark, sf_dir)``."""

    def register(build: Callable[[DerivedFeed], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: build(derived_feed(spark, sf_dir))
        return build

    return register


def tracked(feed: DerivedFeed) -> DataFrame:
    return feed.tracked()


@query("game_states")
def _(feed):
    return st.emitted_states(feed.tracked())


@query("game_states_chunked")
def _(feed):
    """The same with every game cut into chunks of eight actions, so that all carries are used."""
    return st.game_states(feed.actions(), feed.index(), chunk_rows=8)


ROW = ["season", "game_id", "source_event_index"]


def projection(key: str, source: str = "actions", **columns: str) -> None:
    """Register a whole-table projection of expression texts."""

    def build(feed):
        return getattr(feed, source)().selectExpr(*ROW, *[f"{text} AS {name}" for name, text in columns.items()])

    query(key)(build)


# --- Column expressions -----------------------------------------------------------------

projection("clean_text", type_text=ev.clean_text("actionType"), clock_text=ev.clean_text("clock"), home_text=ev.clean_text("scoreHome"))
projection("normalize_team_id", team_id=ev.normalize_team_id("teamId"), from_tricode=ev.normalize_team_id("substr(teamTricode, 2)"), from_score=ev.normalize_team_id("scoreHome"))
projection("event_category", category=ev.event_category("actionType", "description"))
projection("ft_made", is_made=ev.free_throw_made(f"({ev.event_category('actionType', 'description')})", "shotResult", "description"))
projection("ft_sequence", attempt=ev.free_throw_attempt("subType"), total=ev.free_throw_total("subType"), is_special=ev.is_special_free_throw("subType"))
projection("foul_counts", counts=ev.foul_counts(f"({ev.event_category('actionType', 'description')})", "subType"))
projection("foul_marker", marker=ev.foul_marker("description"))
projection("score_authoritative", authoritative=ev.score_authoritative(f"({ev.event_category('actionType', 'description')})", "subType"))
projection("parse_clock", seconds=ck.parse_clock("clock"))
projection("parse_score", home=ck.parse_score("scoreHome"), away=ck.parse_score("scoreAway"))
projection("regulation_seconds", left_in_game=ck.regulation_seconds("period", f"({ck.parse_clock('clock')})"))
projection("overtime_cols", is_overtime=ck.is_overtime("period"), overtime_number=ck.overtime_number("period"))
projection("period_label", label=ck.period_label("period - 1"))
projection("period_bucket", bucket=ck.period_bucket("period"))
projection("elapsed_seconds", elapsed=ck.elapsed_seconds("period", f"({ck.parse_clock('clock')})"))
projection("time_bin", "states", bin=ck.time_bin("seconds_remaining_regulation"))
projection("score_bin", "states", bin=ck.score_bin("score_differential"))
projection("sigmoid_clip", "states", probability=f"round({ck.sigmoid_clip('score_differential * 3D')}, 9)")


@query("normalize_events")
def _(feed):
    return ev.normalize_events(feed.actions()).select(
        *ROW, "action_type", "sub_type", "category", "team_id", F.col("event_text").alias("description"),
        "is_made", "ft_attempt", "ft_total", "is_special_ft",
    )


# --- Game-state reconstruction ----------------------------------------------------------


def tracked_query(key: str, *columns: str) -> None:
    query(key)(lambda feed: tracked(feed).selectExpr(*ROW, *columns))


@query("period_segments")
def _(feed):
    return st.segment_numbers(tracked(feed).select(*ROW, "period", "segment_starts"))


tracked_query("out_of_order_snapshots", "out_of_order")
tracked_query("running_score", "home_score", "away_score")
tracked_query("pending_miss", "pending_team")
tracked_query("possession_states", "possession_team_id", "possession_reason")
tracked_query("team_fouls", "home_fouls", "away_fouls")
tracked_query("foul_marker_check", "marker", "marker_reconstructed", "marker_matches")
tracked_query("visible_states", "emitted")


@query("game_results")
def _(feed):
    return ru.game_results(tracked(feed))


@query("marker_discrepancies")
def _(feed):
    return ru.marker_discrepancies(tracked(feed))


@query("possession_reasons")
def _(feed):
    return ru.possession_reasons(feed.states())


@query("season_results")
def _(feed):
    return ru.season_results(ru.game_results(tracked(feed)), feed.index())


# --- Joins, sets, look-ups --------------------------------------------------------------


@query("game_index")
def _(feed):
    return ix.ordered_index(feed.game_log())


@query("unique_games")
def _(feed):
    return ix.unique_games(feed.game_log())


@query("states_with_labels")
def _(feed):
    return feed.states().select(*ROW, "home_team_id", "away_team_id", "home_win")


@query("missing_games")
def _(feed):
    """Games of the index that have no landed document."""
    return ix.missing_games(feed.index(), feed.landed_documents())


# --- Aggregations and profiles ----------------------------------------------------------

query("event_inventory")(lambda feed: pf.event_inventory(feed.actions()))
query("subtype_counts")(lambda feed: pf.subtype_counts(feed.actions()))
query("blank_descriptions_top30")(lambda feed: pf.blank_descriptions(feed.actions()))
query("foul_marker_hist")(lambda feed: pf.foul_marker_hist(feed.actions()))
query("foul_marker_coverage")(lambda feed: pf.foul_marker_coverage(feed.actions()))
query("foul_rule_comparison")(lambda feed: pf.foul_rule_comparison(feed.actions()))
query("timeout_attribution")(lambda feed: pf.timeout_attribution(feed.actions()))
query("category_examples")(lambda feed: pf.category_examples(feed.actions()))
query("foul_mismatches")(lambda feed: pf.foul_mismatches(feed.actions()).drop("clock", "description", "action_type"))
query("missing_feeds")(lambda feed: pf.missing_feeds(feed.actions().where("CAST(game_id AS BIGINT) % 4 <> 1"), feed.index()))
query("profile_fields")(
    lambda feed: pf.profile_fields(feed.actions(), ["clock", "scoreHome", "actionType", "subType", "teamTricode", "description"])
)
query("value_counts")(lambda feed: pf.value_counts(feed.actions(), "subType"))
query("home_win_rate")(lambda feed: pf.home_win_rate(feed.index()))
query("dataset_summary")(lambda feed: ds.dataset_summary(feed.states()))
query("feature_ranges")(lambda feed: ds.feature_ranges(feed.states()))
query("states_per_game_dist")(lambda feed: ds.states_per_game_dist(feed.states()))
query("states_by_period")(lambda feed: ds.states_by_period(feed.states()))
query("states_by_time_bin")(lambda feed: ds.states_by_time_bin(feed.states()))
query("states_by_score_bin")(lambda feed: ds.states_by_score_bin(feed.states()))


# --- Modelling sets ---------------------------------------------------------------------

query("filter_known_possession")(lambda feed: ds.filter_known_possession(feed.states()).select(*ROW, "possession_team_id"))
query("select_games")(
    lambda feed: ds.select_games(feed.index(), feed.states().where("period > 4").select("game_id").distinct(), 40)
)
query("make_split")(lambda feed: ds.make_split(feed.states(), "validation").select(*ROW, *fv.MODEL_FEATURES[:1], "home_win"))


@query("assert_isolated_splits")
def _(feed):
    """Problems found when one split is wrongly given another split's games."""
    states = feed.states()
    good = {name: ds.make_split(states, name) for name in fv.SPLIT_SEASONS}
    ds.assert_isolated_splits(good)
    wrong = dict(good, test=good["test"].unionByName(good["train"].where("period > 4")))
    return ds.isolation_problems(wrong)


@query("assert_no_target_leak")
def _(feed):
    """The columns a modelling set would hand over, and whether each may be an input."""
    states = feed.states()
    ds.assert_no_target_leak(states)
    rows = ds.features_and_target(states)
    allowed = ev.text_list(fv.MODEL_FEATURES)
    parts = ", ".join(f"named_struct('field', '{c}', 'filled', {c} IS NOT NULL)" for c in rows.columns if c not in ROW)
    return rows.selectExpr(f"inline(array({parts}))").groupBy("field").agg(
        F.expr("count_if(filled)").alias("filled"), F.expr(f"any(field IN ({allowed}))").alias("is_input")
    )


query("features_and_target")(lambda feed: ds.features_and_target(feed.states(), drop_unknown_possession=True))
query("model_input")(lambda feed: ds.model_input(feed.states()))


@query("assert_finite")
def _(feed):
    scored = ds.checked_finite(feed.scored(), ["probability"], 0.0, 1.0)
    inputs = ds.checked_finite(ds.model_input(feed.states()), list(fv.MODEL_FEATURES))
    return ds.finite_report(inputs, list(fv.MODEL_FEATURES)).unionByName(ds.finite_report(scored, ["probability", "home_possession"]))


@query("game_balanced_weights")
def _(feed):
    return ds.game_balanced_weights(feed.states()).selectExpr(*ROW, "round(weight, 9) AS weight")


query("time_bucket_sample")(
    lambda feed: ds.time_bucket_sample(feed.states()).select(*ROW, "time_bucket", "home_score", "away_score", "period")
)


# --- Live feeds -------------------------------------------------------------------------

LIVE = ["game_id", "source_index"]


def live_projection(key: str, **columns: str) -> None:
    query(key)(lambda feed: feed.live_actions().selectExpr(*LIVE, *[f"{text} AS {name}" for name, text in columns.items()]))


live_projection("live_canonical_type", action_type=lv.canonical_type("actionType", "shotResult"))
live_projection("live_foul_subtype", sub_type=lv.foul_subtype("subType", "descriptor"))
live_projection("live_ft_subtype", sub_type=lv.free_throw_subtype("subType", "descriptor", "qualifiers"))
query("adapt_live")(lambda feed: lf.adapt_live(feed.live_actions()))
query("dedupe_live")(
    lambda feed: lf.dedupe_live(feed.live_actions()).select(*LIVE, "orderNumber", "actionNumber", "scoreHome", "description")
)
query("live_order")(
    lambda feed: lf.live_order(feed.live_actions()).select(*LIVE, "source_event_index", "n_events", "orderNumber")
)
query("live_states")(lambda feed: feed.live_states())

# --- Parity -----------------------------------------------------------------------------

query("parity_fields")(lambda feed: pa.parity_fields(feed.states(), feed.live_states()))
query("parity_anchors")(lambda feed: pa.parity_anchors(feed.states(), feed.live_states()))


@query("parity_report")
def _(feed):
    report = pa.parity_report(feed.states(), feed.live_states())
    return report.selectExpr("* EXCEPT (percents)", "percents['possession_team_id'] AS possession_percent")


query("union_seasons")(
    lambda feed: ss.union_seasons(*[ds.make_split(feed.states(), name) for name in fv.SPLIT_SEASONS]).select(*ROW, "home_score")
)

# --- Samples, top-k, trajectories -------------------------------------------------------

query("latest_state")(lambda feed: sa.latest_state(feed.states()))
query("replay_sample")(lambda feed: sa.replay_sample(feed.states()).select(*ROW, "place", "game_states"))
query("select_trajectory_games")(lambda feed: sa.select_trajectory_games(feed.states()))
query("trajectory_samples")(lambda feed: sa.trajectory_samples(feed.scored()))
query("stratified_fixture")(lambda feed: sa.stratified_fixture(feed.actions()).select(*ROW, "actionNumber", "actionType"))


@query("probability_history")
def _(feed):
    return sa.probability_history(feed.scored()).selectExpr("season", "game_id", "inline(probability_history)")


@query("recent_events")
def _(feed):
    return sa.recent_events(feed.states()).selectExpr("season", "game_id", "inline(recent_events)")


# --- Scoreboards ------------------------------------------------------------------------

query("read_scoreboard")(lambda feed: sb.read_scoreboard(feed.scoreboard_documents()))
query("read_game_details")(
    lambda feed: sb.read_game_details(feed.details_documents()).select(
        "game_id", "game_status", "phase", "period", "home_team_id", "home_score", "away_team_id", "away_name"
    )
)


@query("display_probability")
def _(feed):
    """What a viewer is shown per state: the model's value, or certainty once the game is final."""
    board = sb.read_scoreboard(feed.scoreboard_documents()).select("game_id", "game_status", "home_score", "away_score")
    rows = feed.scored().drop("home_score", "away_score").join(board, "game_id")
    args = ("game_status", "home_score", "away_score")
    shown = rows.withColumn("shown", F.expr(ck.display_home_probability(*args, "probability")))
    return shown.selectExpr(*ROW, "shown AS home_probability", "1D - shown AS away_probability", f"{ck.final_override(*args)} AS overridden")


@query("possession_label")
def _(feed):
    board = sb.read_scoreboard(feed.scoreboard_documents()).selectExpr(
        "game_id", "coalesce(nullif(home_tricode, ''), home_name) AS home_label", "coalesce(nullif(away_tricode, ''), away_name) AS away_label"
    )
    label = ck.possession_label("possession_team_id", "home_team_id", "home_label", "away_team_id", "away_label")
    return feed.states().join(board, "game_id").selectExpr(*ROW, f"{label} AS label")


# --- Probability evaluation -------------------------------------------------------------

METRICS = ["brier", "log_loss", "accuracy", "roc_auc", "ece"]


def rounded(metrics: DataFrame, *keep: str) -> DataFrame:
    return metrics.selectExpr(*keep, "row_count", *[f"round({m}, 9) AS {m}" for m in METRICS])


query("probability_metrics")(lambda feed: rounded(mt.probability_metrics(feed.scored(), ["season"]), "season"))


@query("calibration_bins")
def _(feed):
    bins = mt.calibration_bins(feed.scored(), ["season"])
    return bins.selectExpr(
        "season", "bin", "lower", "upper", "count", "round(mean_predicted, 9) AS mean_predicted",
        "round(observed_rate, 9) AS observed_rate", "round(absolute_gap, 9) AS absolute_gap",
    )


@query("ece")
def _(feed):
    return mt.ece(mt.calibration_bins(feed.scored(), ["season"], bins=7), ["season"]).selectExpr("season", "round(ece, 9) AS ece")


query("slice_metrics")(lambda feed: rounded(mt.slice_metrics(feed.scored()), "dimension", "label"))


def three_models(feed: DerivedFeed) -> DataFrame:
    """Validation states under the constant, a sharp and a blunt model."""
    validation = ds.make_split(feed.scored(), "validation").withColumnRenamed("probability", "sharp")
    return md.constant_baseline(ds.make_split(feed.states(), "train"), validation).selectExpr(
        "home_win", "sharp", "(sharp + 1.5D) / 4D AS blunt", "probability AS constant"
    )


def three_metrics(feed: DerivedFeed) -> DataFrame:
    return mt.compare_models(three_models(feed), {"sharp": "sharp", "blunt": "blunt", "constant": "constant"})


query("compare_models")(lambda feed: rounded(three_metrics(feed), "model"))
query("select_model")(lambda feed: rounded(mt.select_model(three_metrics(feed)), "model"))


@query("should_calibrate")
def _(feed):
    """Whether drawing the made-up probabilities half-way to one half helps on the validation season."""
    rows = ds.make_split(feed.scored(), "validation").withColumn("drawn", F.expr("(probability + 0.5D) / 2D"))
    raw, calibrated = (mt.compare_models(rows, {"m": column}) for column in ("probability", "drawn"))
    decided = mt.should_calibrate(raw, calibrated)
    return decided.selectExpr(*[f"round({c}, 9) AS {c}" for c in decided.columns if c != "calibrate"], "calibrate")


@query("constant_baseline")
def _(feed):
    states = feed.states()
    scored = md.constant_baseline(ds.make_split(states, "train"), ds.make_split(states, "validation"))
    return rounded(mt.probability_metrics(scored))


# --- Models -----------------------------------------------------------------------------

FIXED_LINEAR = md.LinearModel(fv.MODEL_FEATURES, (1.5, 0.25, -0.5, 0.125, 0.0625, -0.25, 0.5, -0.125, 0.25, -0.375), 0.1875)


def scaled(feed: DerivedFeed, split: str | None = None) -> DataFrame:
    states = feed.states()
    scaler = md.fit_scaler(ds.make_split(states, "train"))
    return md.apply_scaler(states if split is None else ds.make_split(states, split), scaler)


@query("fit_scaler")
def _(feed):
    scaler = md.fit_scaler(ds.make_split(feed.states(), "train"))
    return scaler.selectExpr("explode(means) AS (feature, mean)", "scales").selectExpr(
        "feature", "round(mean, 6) AS mean", "round(scales[feature], 6) AS scale"
    )


@query("apply_scaler")
def _(feed):
    return scaled(feed).selectExpr(*ROW, "home_win", *[f"round({c}, 6) AS {c}" for c in fv.MODEL_FEATURES])


@query("score_logistic")
def _(feed):
    return md.score_logistic(scaled(feed), FIXED_LINEAR).selectExpr(*ROW, "round(probability, 8) AS probability")


def fixed_layers() -> list:
    """Weights by rule, so that any engine can rebuild them."""
    import numpy as np

    def layer(rows: int, columns: int):
        r, c = np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij")
        return ((r * 7 + c * 3) % 11 - 5) / 8.0, (np.arange(rows) % 5 - 2) / 4.0

    return [layer(64, 10), layer(32, 64), layer(1, 32)]


@query("score_mlp")
def _(feed):
    return md.score_mlp(scaled(feed), fixed_layers()).selectExpr(*ROW, "round(logit, 6) AS logit")


@query("apply_platt")
def _(feed):
    logits = feed.states().withColumn("logit", F.expr("score_differential / 8D"))
    model = md.LinearModel(("logit",), (0.75,), -0.125)
    return md.apply_platt(logits, model).selectExpr(*ROW, "round(calibrated, 9) AS calibrated")


query("calibration_split")(lambda feed: md.calibration_split(ds.make_split(feed.states(), "validation")))


def fitted(feed: DerivedFeed, models: dict[str, md.LinearModel]) -> DataFrame:
    return md.coefficient_rows(models, feed.spark).selectExpr("model", "feature", "round(coefficient, 5) + 0D AS coefficient")


query("fit_logistic")(lambda feed: fitted(feed, {"logistic": md.fit_logistic(scaled(feed, "train"))}))


@query("fit_platt")
def _(feed):
    logits = ds.make_split(feed.states(), "validation").withColumn("logit", F.expr("score_differential / 8D"))
    rows = logits.join(md.calibration_split(logits).where("fits"), ["season", "game_id"], "left_semi")
    return fitted(feed, {"platt": md.fit_platt(rows)})


@query("fit_mlp")
def _(feed):
    """The perceptrons, the best of them on all validation rows against the logistic model fitted to the same train rows."""
    train, validation = scaled(feed, "train"), scaled(feed, "validation")
    linear = mt.probability_metrics(md.score_logistic(validation, md.fit_logistic(train))).select("brier").first()[0]
    scored, names = validation, {}
    # The given tables make a few steps an epoch, so steps are larger than the library's defaults, which are for whole seasons.
    settings = {name: replace(setting, learning_rate=30 * setting.learning_rate) for name, setting in md.NETS.items()}
    for k, (name, net) in enumerate(md.fit_mlp(train, validation, settings).items()):
        names[name] = f"p{k}"
        scored = md.score_fitted_mlp(scored, net, name=f"p{k}")
    judged = mt.compare_models(scored, names)
    return judged.groupBy("row_count").agg(F.count(F.lit(1)).alias("models"), (F.min("brier") < F.lit(linear)).alias("best_is_lower")).withColumn("logistic_brier", F.lit(round(linear, 6)))


@query("experiment_grid")
def _(feed):
    states = feed.states()
    grid = md.experiment_grid(ds.make_split(states, "train"), ds.make_split(states, "validation"))
    weights = [f"round(coefficients['{f}'], 5) + 0D AS w_{f}" for f in (*fv.MODEL_FEATURES, "home_score", "away_score")]
    return grid.selectExpr(
        "experiment", "size(features) AS n_features", "drop_unknown", "weighting", "c", "train_rows", *weights, "round(intercept, 5) + 0D AS w_intercept",
        "row_count", *[f"round({m}, 6) AS {m}" for m in METRICS],
    )


_TUNED: dict[tuple[str, str], tuple[str, str]] = {}


def tuned(feed: DerivedFeed) -> tuple[str, str]:
    """Paths of a state table and of the artifacts of a model tuned on it."""
    key = (feed.spark.sparkContext.applicationId, feed.sf_dir)
    if key not in _TUNED:
        paths = scratch_path(feed.spark, "tuning_states"), scratch_path(feed.spark, "artifacts")
        ss.write_states(feed.states(), paths[0])
        pm.tune_model(feed.spark, *paths, settings={"small": md.NetSetting(hidden=(8, 4), epochs=2)}, batches=2)
        _TUNED[key] = paths
    return _TUNED[key]


@query("tune_model")
def _(feed):
    """The report's logistic model on validation, and what the artifacts were made from; the perceptrons are tested in numpy."""
    report = feed.spark.read.schema(pm.REPORT).json(f"{tuned(feed)[1]}/tuning_report")
    rows = report.selectExpr("train_rows", "validation_rows", "round(constant, 9) AS constant", "size(models) AS candidates", "explode(models) AS m")
    return rows.where("m.model = 'logistic'").selectExpr("train_rows", "validation_rows", "constant", "candidates", *[f"round(m.{c}, 6) AS {c}" for c in METRICS])


@query("evaluate_model")
def _(feed):
    """The baselines on the test season, scored from the artifacts."""
    found = pm.evaluate_model(feed.spark, *tuned(feed))["comparison"].where("model IN ('constant', 'logistic')")
    return found.selectExpr("model", "row_count", *[f"round({m}, 6) AS {m}" for m in METRICS])


@query("load_save_preprocessor")
def _(feed):
    path = scratch_path(feed.spark, "scaler")
    sc.save_scaler(md.fit_scaler(ds.make_split(feed.states(), "train")), path)
    loaded = sc.load_scaler(feed.spark, path)
    return loaded.selectExpr("fitted_season", "version", "explode(means) AS (feature, mean)", "scales").selectExpr(
        "fitted_season", "version", "feature", "round(mean, 6) AS mean", "round(scales[feature], 6) AS scale"
    )


# --- Sources and sinks ------------------------------------------------------------------


@query("read_game_log")
def _(feed):
    return ss.union_seasons(*saved_game_logs(feed))


def saved_game_logs(feed: DerivedFeed) -> list[DataFrame]:
    folder = scratch_path(feed.spark, "game_logs")
    logs = feed.game_log()
    for season in fv.SPLIT_SEASONS.values():
        gl.write_game_log(logs.where(F.col("season") == season), folder, season)
    return [gl.read_game_log(feed.spark, folder, season) for season in fv.SPLIT_SEASONS.values()]


@query("write_game_log")
def _(feed):
    read = ss.union_seasons(*saved_game_logs(feed))
    return read.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.min("GAME_ID").alias("first_id"), F.sum("PTS").alias("points"))


RAW = ["actionId", "actionNumber", "actionType", "subType", "clock", "period", "teamId", "teamTricode", "description", "scoreHome", "scoreAway", "shotResult"]


def written_documents(feed: DerivedFeed, csv: str | None = None) -> str:
    path = scratch_path(feed.spark, "raw")
    fd.write_raw_pbp(fd.to_documents(feed.actions()), path, csv)
    return path


query("read_raw_pbp")(lambda feed: fd.read_raw_pbp(feed.spark, written_documents(feed)).select(*ROW, "n_events", *RAW))
query("explode_actions")(
    lambda feed: fd.explode_actions(fd.to_documents(feed.actions(), part_rows=25)).select(*ROW, "n_events", "part", "actionId", "clock")
)


@query("write_raw_pbp")
def _(feed):
    flat = scratch_path(feed.spark, "flat")
    written_documents(feed, flat)
    rows = feed.spark.read.option("header", True).csv(flat).withColumn("season", F.col("season").cast("string"))
    return rows.groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.expr("sum(CAST(period AS INT))").alias("periods"), F.countDistinct("game_id").alias("games")
    )


@query("write_states")
def _(feed):
    """Write states twice, replace the games that went to overtime, and count what is there."""
    path = scratch_path(feed.spark, "states")
    states = feed.states()
    ss.write_states(states, path)
    ss.write_states(states, path)
    overtime = states.join(states.where("period > 4").select("season", "game_id").distinct(), ["season", "game_id"], "left_semi")
    ss.replace_games(feed.spark, overtime.withColumn("home_score", F.expr("home_score + 1000")), path)
    return ss.read_states(feed.spark, path).groupBy("season").agg(
        F.count(F.lit(1)).alias("states"), F.sum("home_score").alias("home_points")
    )


@query("read_states")
def _(feed):
    path = scratch_path(feed.spark, "states")
    ss.write_states(feed.states(), path)
    return ss.read_states(feed.spark, path, ["2021-22", "2023-24"], [*ROW, "home_score", "away_score", "possession_reason"])


@query("read_live_snapshots")
def _(feed):
    return fd.read_live_snapshots(feed.snapshots()).select("game_id", "poll", "source_index", "orderNumber", "actionType", "scoreHome", F.size("qualifiers").alias("qualifiers"))


@query("storage_usage")
def _(feed):
    listing = feed.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(written_documents(feed))
    return fd.storage_usage(listing.select("path", "length"))


@query("process_season")
def _(feed):
    return ps.process_season(feed.actions(), feed.game_log(), scratch_path(feed.spark, "states"), scratch_path(feed.spark, "tracked"))


@query("write_report")
def _(feed):
    states, tracked_path, path = (scratch_path(feed.spark, n) for n in ("states", "tracked", "report"))
    results = ps.process_season(feed.actions(), feed.game_log(), states, tracked_path)
    ps.write_report(ps.season_report(feed.spark, states, tracked_path, results, feed.index()), path)
    return feed.spark.read.json(path).selectExpr(
        "season", "games_processed", "raw_events", "emitted_states", "known_possession_percent",
        "size(possession_reasons) AS reasons", "get(possession_reasons, 0).states AS top_reason_states", "size(marker_discrepancies) AS discrepancies",
        "processed_bytes > 0 AS has_bytes", "size(game_results) AS listed", "size(filter(game_results, g -> g.final_score_matches)) AS final_scores",
        "aggregate(game_results, 0L, (a, g) -> a + g.emitted_states) AS listed_states", "aggregate(game_results, 0L, (a, g) -> a + g.foul_markers_checked) AS markers_checked",
        "get(game_results, 0).game_id AS first_game",
    )


# --- Data quality -----------------------------------------------------------------------


def reasons(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.selectExpr(*keep, "concat_ws('; ', problems) AS reason")


query("validate_feeds")(lambda feed: reasons(ql.validate_feeds(feed.landed_documents()), "season", "game_id", "is_valid", "event_count"))
query("validate_files")(
    lambda feed: reasons(ql.validate_files(feed.index(), feed.landed_documents()), "season", "game_id", "is_valid", "event_count", "is_missing")
)
query("verify_downloads")(lambda feed: ql.verify_downloads(feed.index(), feed.landed_documents()).drop("bytes"))


_LANDED: dict[tuple[str, str], str] = {}


def landed_folder(feed: DerivedFeed) -> str:
    """Every game's document as a file of its own; some are cut off, some are no gzip, some stand there twice or plain, some are missing."""
    key = (feed.spark.sparkContext.applicationId, feed.sf_dir)
    if key not in _LANDED:

        def damage(batches):
            import pandas as pd

            for batch in batches:
                out = []
                for season, name, content, kind in batch[["season", "name", "content", "kind"]].itertuples(index=False):
                    content, plain = bytes(content), name.removesuffix(".gz")
                    if kind == 1:
                        out.append((season, name, content[: len(content) // 2]))
                    elif kind == 2:
                        out.append((season, name, b"<html>" + content[6:]))
                    elif kind == 4:
                        out.append((season, plain, gzip.decompress(content)))
                    elif kind != 5:
                        out.append((season, name, content))
                        if kind == 3:
                            out.append((season, plain, b'{"game":{"gameId":"0000000000","actions":[]}}'))
                yield pd.DataFrame(out, columns=["season", "name", "content"])

        path = scratch_path(feed.spark, "landed")
        files = fd.compressed_files(fd.to_documents(feed.actions())).withColumn("kind", F.expr("CAST(substr(name, 1, 10) AS BIGINT) % 7"))
        fd.write_landed_files(files.mapInPandas(damage, "season STRING, name STRING, content BINARY"), path)
        _LANDED[key] = path
    return _LANDED[key]


query("read_landed_pbp")(lambda feed: fd.read_landed_pbp(feed.spark, landed_folder(feed)).select(*ROW, "n_events", "actionId", "clock", "period", "description"))


@query("landed_files")
def _(feed):
    files = fd.landed_files(feed.spark, landed_folder(feed))
    return files.selectExpr("season", "game_id", "path LIKE '%.gz' AS compressed", "length > 0 AS has_bytes", "value IS NOT NULL AS is_read", "error")


query("validate_landed_files")(
    lambda feed: reasons(ql.validate_files(feed.index(), fd.landed_files(feed.spark, landed_folder(feed))), "season", "game_id", "is_valid", "event_count", "is_missing")
)


@query("verify_landed_downloads")
def _(feed):
    found = ql.verify_downloads(feed.index(), fd.landed_files(feed.spark, landed_folder(feed)))
    return found.withColumn("has_bytes", F.expr("coalesce(bytes, 0) > 0")).drop("bytes")


def damaged_states(feed: DerivedFeed) -> DataFrame:
    """States with one kind of damage per game, by its number."""
    damage = {
        "score_differential": "CASE WHEN g % 13 = 1 AND source_event_index % 5 = 0 THEN score_differential + 1 ELSE score_differential END",
        "seconds_remaining_regulation": "CASE WHEN g % 13 = 2 AND period <= 4 THEN seconds_remaining_regulation + 1 "
        "WHEN g % 13 = 3 AND period > 4 THEN 5D ELSE seconds_remaining_regulation END",
        "possession_team_id": "CASE WHEN g % 13 = 4 AND possession_known = 1 THEN 77 ELSE possession_team_id END",
        "home_possession": "CASE WHEN g % 13 = 5 AND possession_known = 1 THEN 1 - home_possession ELSE home_possession END",
        "home_team_fouls_period": "CASE WHEN g % 13 = 6 THEN home_team_fouls_period - 3 ELSE home_team_fouls_period END",
        "home_win": "CASE WHEN g % 13 = 7 THEN 1 - home_win ELSE home_win END",
        "game_id": "CASE WHEN g % 13 = 8 THEN '8' || substr(game_id, 2) ELSE game_id END",
    }
    numbered = feed.states().withColumn("g", F.expr("CAST(game_id AS BIGINT)"))
    return numbered.withColumns({name: F.expr(text) for name, text in damage.items()}).drop("g")


@query("verify_states")
def _(feed):
    return reasons(ql.verify_states(damaged_states(feed), feed.index()), "season", "game_id", "states", "is_valid")


@query("stored_disorder")
def _(feed):
    """Every third game stored from its end to its start."""
    path = scratch_path(feed.spark, "shuffled")
    turned = feed.states().withColumn("_o", F.expr("CASE WHEN CAST(game_id AS BIGINT) % 3 = 0 THEN -source_event_index ELSE source_event_index END"))
    turned.repartition(4, "game_id").sortWithinPartitions("season", "game_id", "_o").drop("_o").write.partitionBy("season").parquet(path)
    return ql.stored_disorder(ss.stored_places(feed.spark, path))


@query("verify_states_totals")
def _(feed):
    states = damaged_states(feed)
    return ql.verified_totals(states, ql.verify_states(states, feed.index()))


query("schema_checks")(lambda feed: ql.schema_checks(feed.actions()))
query("differential_check")(lambda feed: ql.differential_check(tracked(feed)))


@query("order_consistency")
def _(feed):
    return ql.order_consistency(feed.actions()).selectExpr("season", "game_id", "round(correlation, 6) AS correlation", "consistent")


@query("field_presence")
def _(feed):
    actions = "explode(try_variant_get(try_parse_json(value), '$.game.actions', 'array<variant>')) AS a"
    return pf.field_presence(feed.landed_documents().selectExpr("season", actions).selectExpr("season", "to_json(a) AS actions_json"))


# --- Manifest ---------------------------------------------------------------------------

MANIFEST_COLUMNS = {
    "game_id": "lpad(CAST(custkey AS STRING), 10, '0')",
    "status": "CASE last_status WHEN 'F' THEN 'failed' WHEN 'O' THEN 'downloaded' ELSE 'pending' END",
    "attempts": "CAST(failures AS INT)",
    "last_action": "CASE last_status WHEN 'F' THEN 'failed' WHEN 'O' THEN 'downloaded' ELSE NULL END",
    "event_count": "CAST(CASE WHEN loads > 0 THEN loads * 100 ELSE NULL END AS INT)",
    "error_type": "CASE WHEN last_status = 'F' AND failures > 1 THEN 'ValueError' ELSE NULL END",
    "error": "CASE WHEN last_status = 'F' THEN 'old problem ' || repeat('x', CAST(custkey % 120 AS INT)) ELSE NULL END",
    "updated_at": "CAST('2024-01-01 00:00:00' AS TIMESTAMP)",
}
EVERY_GAME = {"game_id": "lpad(CAST(c_custkey AS STRING), 10, '0')"}
# Every fifth outcome is of a game that no list knows; the game of that customer took no part in the run.
OUTCOME_COLUMNS = {
    "game_id": "lpad(CAST(c_custkey + CASE WHEN c_custkey % 5 = 4 THEN 500000000 ELSE 0 END AS STRING), 10, '0')",
    "action": "CASE c_nationkey % 3 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'skipped' ELSE 'failed' END",
    "event_count": "CAST(CASE WHEN c_nationkey % 3 < 2 THEN 400 + c_custkey % 200 ELSE NULL END AS INT)",
    "error_type": "CASE WHEN c_nationkey % 3 = 2 THEN 'OSError' ELSE NULL END",
    "error": "CASE WHEN c_nationkey % 3 = 2 THEN 'cut off ' || repeat('y', CAST(300 + c_custkey % 400 AS INT)) ELSE NULL END",
}
NOW = "TIMESTAMP '2024-02-02 00:00:00'"


def expressions(columns: dict[str, str]) -> list:
    return [F.expr(text).alias(name) for name, text in columns.items()]


def manifest(feed: DerivedFeed) -> DataFrame:
    """Customers with orders are known games; the last order says how the last load went."""
    orders = feed.spark.read.parquet(f"{feed.sf_dir}/orders.parquet")
    known = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.expr("max_by(o_orderstatus, o_orderkey)").alias("last_status"),
        F.expr("count_if(o_orderstatus = 'F')").alias("failures"),
        F.expr("count_if(o_orderstatus = 'O')").alias("loads"),
    )
    return known.select(*expressions(MANIFEST_COLUMNS))


def customers(feed: DerivedFeed) -> DataFrame:
    return feed.spark.read.parquet(f"{feed.sf_dir}/customer.parquet")


def outcomes(feed: DerivedFeed) -> DataFrame:
    return customers(feed).select(*expressions(OUTCOME_COLUMNS))


query("register_games")(
    lambda feed: mf.register_games(manifest(feed), customers(feed).select(*expressions(EVERY_GAME))).select(
        "game_id", "status", "attempts", "event_count"
    )
)
query("manifest_update")(lambda feed: mf.manifest_update(manifest(feed), outcomes(feed), NOW))


@query("failure_log")
def _(feed):
    """The history appended twice: an append-only table keeps both runs."""
    path = scratch_path(feed.spark, "failures")
    updated = mf.manifest_update(manifest(feed), outcomes(feed), NOW)
    for season in ("2021-22", "2022-23"):
        mf.failure_log(updated, outcomes(feed), season, "Regular Season", NOW).write.mode("append").json(path)
    schema = "season STRING, season_type STRING, game_id STRING, error_type STRING, error STRING, attempts INT"
    return feed.spark.read.schema(schema).json(path)


query("games_to_process")(
    lambda feed: mf.games_to_process(
        customers(feed).select(*expressions(EVERY_GAME)),
        outcomes(feed).where("action = 'downloaded'"),
        manifest(feed),
        "no_retry",
    )
)
query("ingest_run_stats")(lambda feed: mf.ingest_run_stats(outcomes(feed)))
query("manifest_summary")(lambda feed: mf.manifest_summary(manifest(feed)))
query("manifest_status")(lambda feed: mf.manifest_status(manifest(feed)))

# --- Snapshots and streams --------------------------------------------------------------

POLL = {
    "game_id": "lpad(CAST(user_id AS STRING), 10, '0')",
    "poll": "CAST(i AS INT)",
    "x": "CAST(floor(i / 3) AS INT) % 2",
    "status": "CAST(1 + floor(i * 3 / n) AS INT)",
    "points": "CAST(floor(i / 4) AS INT)",
}


def polls(feed: DerivedFeed) -> DataFrame:
    return feed.staged().select("event_id", "event_type", *expressions(POLL))


@query("snapshot_fingerprint")
def _(feed):
    plain = "'{\"b\":' || x || ', \"a\":{\"d\":' || poll || ',\"c\":\"' || event_type || '\"}}'"
    turned = "'{\"a\":{\"c\":\"' || event_type || '\",\"d\":' || poll || '}, \"b\":' || x || '}'"
    rows = polls(feed).selectExpr("game_id", "poll", f"CASE WHEN event_id % 2 = 0 THEN {plain} ELSE {turned} END AS value")
    return rows.selectExpr("game_id", "poll", f"{sn.fingerprint('value')} AS fingerprint")


@query("changed_snapshots")
def _(feed):
    value = "CASE WHEN event_id % 2 = 0 THEN '{\"b\":1,\"x\":' || x || '}' ELSE '{\"x\":' || x || ', \"b\":1}' END"
    documents = polls(feed).selectExpr("game_id", "poll", "0 AS part", f"{value} AS value")
    return sn.changed_snapshots(sn.snapshot_fingerprints(documents)).select("game_id", "poll")


_PUBLISHED: dict[tuple[str, str], pb.PublishedTables] = {}
#: Which polls land before each start of the stream.
LANDINGS = ((0, 2), (3, 5), (6, 7))


def published(feed: DerivedFeed) -> pb.PublishedTables:
    """Land documents and scoreboards of a few polls at a time; the stream starts again from its checkpoint for each landing."""
    key = (feed.spark.sparkContext.applicationId, feed.sf_dir)
    if key not in _PUBLISHED:
        folder = scratch_path(feed.spark, "published")
        tables = pb.PublishedTables(feed.spark, f"{folder}/tables")
        for n, (first, last) in enumerate(LANDINGS):
            landed = F.col("poll").between(first, last)
            feed.polled_documents().where(landed).write.option("compression", "gzip").json(f"{folder}/documents/{n}")
            feed.polls().where(landed).select("poll", *pb.board_columns()).write.json(f"{folder}/boards/{n}")
            documents, boards = ls.read_document_stream(feed.spark, f"{folder}/documents/*"), pb.read_board_stream(feed.spark, f"{folder}/boards/*")
            score = lambda states: states.withColumn("probability", F.expr(PROBABILITY))
            pb.start_published(documents, boards, feed.live_index(), tables, f"{folder}/checkpoint", score, once=True).awaitTermination()
        _PUBLISHED[key] = tables
    return _PUBLISHED[key]


LOGGED = ["game_id", "poll", "cause", "feed_changed", "metadata_changed", "feed_status", "error"]
SHOWN = ["game_status", "status_text", "home_score", "away_score"]


def publish_log(feed: DerivedFeed) -> DataFrame:
    """The stream's log with the metadata that was shown."""
    fields = ", ".join(f for f in pb.BOARD_SCHEMA.split(", ") if not f.startswith("poll"))
    return published(feed).log().withColumn("b", F.from_json("board", fields)).select(*LOGGED, *[f"b.{c}" for c in SHOWN])


query("published_changes")(lambda feed: publish_log(feed).where("feed_status = 'live'").drop("feed_status", "error"))
query("metadata_change")(lambda feed: publish_log(feed).where("metadata_changed").select("game_id", "poll", "feed_changed", *SHOWN))


@query("degraded_feed")
def _(feed):
    """Failures and what ended them."""
    rows = carry_last(publish_log(feed), ["game_id"], "poll", {"before": "cause"})
    return rows.where("cause = 'failure' OR before = 'failure'").select(*LOGGED, *SHOWN)


query("changed_snapshots_stream")(lambda feed: published(feed).log().where("feed_changed").select("game_id", "poll"))


@query("publish_log")
def _(feed):
    """The rule over the table of polls; the same rows as the stream's log."""
    prints = sn.snapshot_fingerprints(feed.polled_documents()).join(feed.polls().select("game_id", "poll", "failed", *SHOWN), ["game_id", "poll"])
    return sn.publish_log(prints, "failed").select(*LOGGED, *SHOWN)


@query("served_documents")
def _(feed):
    """What each batch of the stream served, scored."""
    return published(feed).published().selectExpr(
        "game_id", "CAST(batch AS INT) AS batch", "poll", "feed_status", "game_status", "status_text", "home_team.score AS home_score", "away_team.score AS away_score",
        "period", "home_win_probability", "model_home_win_probability", "final_override_applied", "size(recent_events) > 0 AS has_events",
    )


@query("replay_prefix")
def _(feed):
    """Every game after each of its arrivals."""
    return rp.replay_states(feed.live_actions(), feed.live_index())


_STREAMED: dict[tuple[str, str], ls.LiveTables] = {}


def streamed(feed: DerivedFeed) -> ls.LiveTables:
    """Land the polls one after the other and let the stream take in each."""
    key = (feed.spark.sparkContext.applicationId, feed.sf_dir)
    if key not in _STREAMED:
        folder = scratch_path(feed.spark, "live")
        tables = ls.LiveTables(feed.spark, f"{folder}/tables")
        snapshots = feed.snapshots()
        for poll in range(3):
            snapshots.where(F.col("poll") == poll).write.option("compression", "gzip").json(f"{folder}/landing/{poll}")
            documents = ls.read_document_stream(feed.spark, f"{folder}/landing/*")
            ls.start_live_states(documents, feed.live_index(), tables, f"{folder}/checkpoint", once=True).awaitTermination()
        _STREAMED[key] = tables
    return _STREAMED[key]


query("live_states_stream")(lambda feed: streamed(feed).states())
query("cache_live_snapshots")(lambda feed: streamed(feed).snapshots().select("game_id", "poll", "part"))

# --- Served documents -------------------------------------------------------------------


def with_feed(feed: DerivedFeed, states: DataFrame) -> DataFrame:
    """The states of games whose feed has landed; the other games are still waiting."""
    return states.join(feed.landed_documents().select("season", "game_id").distinct(), ["season", "game_id"], "left_semi")


@query("games_list")
def _(feed):
    board = sb.read_scoreboard(feed.scoreboard_documents())
    return pl.games_list(board, with_feed(feed, feed.states())).selectExpr(
        "game_id", "game_status", "status_text", "period", "clock", "home_team.score AS home_score", "home_team.tricode AS home_tricode",
        "away_team.score AS away_score", "away_team.name AS away_name",
    )


@query("state_payload")
def _(feed):
    board = sb.read_scoreboard(feed.scoreboard_documents())
    cursors = feed.index().where("home_team_id % 3 = 0").selectExpr(
        "game_id", "home_team_id % 7 AS cursor", "7 AS total_actions", "false AS paused", "2D AS speed", "home_team_id % 7 = 6 AS complete"
    )
    return pl.state_payload(board, with_feed(feed, feed.scored()), replay=cursors).selectExpr(
        "mode", "replay.cursor AS cursor", "replay.complete AS complete", "last_update IS NOT NULL AS is_dated", "game_id", "game_status", "status_text", "period", "period_label", "clock", "home_team.score AS home_score",
        "away_team.score AS away_score", "score_differential", "possession.label AS label", "possession.known AS known",
        "fouls.home_period AS home_fouls", "home_win_probability", "away_win_probability", "model_home_win_probability",
        "final_override_applied", "last_event.sequence AS last_sequence", "last_event.description AS last_description",
        "size(recent_events) AS recent", "size(probability_history) AS history", "get(probability_history, 0).sequence AS first_sequence",
        "feed_status", "sequence",
    )

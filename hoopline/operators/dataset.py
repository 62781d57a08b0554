"""Leakage-safe modelling sets over game states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopline.functions import clock as ck
from hoopline.functions import fixed_values as fv
from hoopline.operators.states import IDX

GAME = ["season", "game_id"]


def split_season(name: str) -> str:
    if name not in fv.SPLIT_SEASONS:
        raise ValueError(f"Unknown split {name!r}; known: {', '.join(fv.SPLIT_SEASONS)}")
    return fv.SPLIT_SEASONS[name]


def make_split(states: DataFrame, name: str) -> DataFrame:
    """One season of states; on a table partitioned by season only its folder is read."""
    return states.where(F.col("season") == split_season(name))


def isolation_problems(splits: dict[str, DataFrame]) -> DataFrame:
    """Rows for every way in which splits are not isolated; empty when all is well."""
    tagged = None
    for name, frame in splits.items():
        part = frame.select(F.lit(name).alias("split"), F.lit(split_season(name)).alias("expected"), "season", "game_id")
        tagged = part if tagged is None else tagged.unionByName(part)
    games = tagged.distinct()
    seasons = games.where("season <> expected").selectExpr(
        "'wrong season' AS problem", "split || ' holds ' || season AS detail"
    ).distinct()
    shared = games.groupBy("game_id").agg(F.countDistinct("split").alias("n"), F.array_sort(F.collect_set("split")).alias("splits"))
    shared = shared.where("n > 1").selectExpr("'shared game' AS problem", "game_id || ' in ' || concat_ws(', ', splits) AS detail")
    return seasons.unionByName(shared)


def assert_isolated_splits(splits: dict[str, DataFrame]) -> None:
    found = isolation_problems(splits).limit(3).collect()
    if found:
        raise ValueError("Splits are not isolated: " + "; ".join(f"{r.problem}: {r.detail}" for r in found))


def assert_no_target_leak(states: DataFrame, features=fv.MODEL_FEATURES) -> None:
    if fv.TARGET in features:
        raise ValueError(f"{fv.TARGET} is the target and cannot be a feature")
    missing = [c for c in (*features, fv.TARGET) if c not in states.columns]
    if missing:
        raise KeyError(f"Columns missing from the modelling set: {missing}")


def filter_known_possession(states: DataFrame) -> DataFrame:
    return states.where("possession_known = 1")


def features_and_target(
    states: DataFrame, features=fv.MODEL_FEATURES, drop_unknown_possession: bool = False, keep: tuple = (*GAME, IDX)
) -> DataFrame:
    assert_no_target_leak(states, features)
    rows = filter_known_possession(states) if drop_unknown_possession else states
    return rows.select(*[c for c in keep if c not in features], *features, fv.TARGET)


def model_input(states: DataFrame, keep: tuple = (*GAME, IDX)) -> DataFrame:
    """The ten model inputs in order; unknown possession enters as one half."""
    columns = [
        f"coalesce(CAST({name} AS DOUBLE), {fv.UNKNOWN_POSSESSION_VALUE}D) AS {name}"
        if name == "home_possession"
        else f"CAST({name} AS DOUBLE) AS {name}"
        for name in fv.MODEL_FEATURES
    ]
    return states.selectExpr(*[c for c in keep], *columns)


def checked_finite(df: DataFrame, columns, low: float | None = None, high: float | None = None) -> DataFrame:
    """The same rows, failing on the first null, NaN, infinite or out-of-range value."""
    checks = []
    for c in columns:
        bad = f"{c} IS NULL OR isnan({c}) OR abs({c}) = double('infinity')"
        if low is not None:
            bad += f" OR {c} < {low}"
        if high is not None:
            bad += f" OR {c} > {high}"
        checks.append((c, f"CASE WHEN {bad} THEN raise_error('Not a finite model value: {c}') ELSE {c} END"))
    return df.withColumns({c: F.expr(text) for c, text in checks})


def finite_report(df: DataFrame, columns) -> DataFrame:
    """How many rows of each column could not enter a model."""
    parts = ", ".join(f"named_struct('field', '{c}', 'value', CAST({c} AS DOUBLE))" for c in columns)
    return df.selectExpr(f"inline(array({parts}))").groupBy("field").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.expr("count_if(value IS NULL)").alias("nulls"),
        F.expr("count_if(isnan(value) OR abs(value) = double('infinity'))").alias("not_finite"),
    )


def select_games(index: DataFrame, game_ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Games of the index, narrowed by an id table and to the first ``limit`` ids in order."""
    games = index.select("game_id").distinct()
    if game_ids is not None:
        games = games.join(game_ids.select("game_id"), "game_id", "left_semi")
    return games if limit is None else games.orderBy("game_id").limit(limit)


def game_balanced_weights(states: DataFrame, name: str = "weight") -> DataFrame:
    """Equal total weight per game, mean row weight one: rows / (games * rows of the game)."""
    sizes = states.groupBy(*GAME).agg(F.count(F.lit(1)).alias("game_rows"))
    totals = sizes.agg(F.struct(F.sum("game_rows").alias("rows"), F.count(F.lit(1)).alias("games")))
    # Weights are worked out per game (the totals are a scalar subquery), then joined to the states.
    weights = sizes.withColumn("_totals", totals.scalar()).selectExpr(
        *GAME, f"_totals.rows / (_totals.games * game_rows) AS {name}"
    )
    return states.join(weights, GAME)


def _time_bucket(seconds: int) -> Column:
    if seconds <= 0:
        raise ValueError("seconds must be positive")
    elapsed = ck.elapsed_seconds("period", "seconds_remaining_period")
    return F.expr(f"CAST(floor(({elapsed}) / {seconds}) AS INT)")


def time_bucket_marks(states: DataFrame, name: str, seconds: int = 30) -> DataFrame:
    """All states, with 1 in ``name`` at the last one of every elapsed-time bucket of a game and 0 at the others."""
    last = states.groupBy(*GAME, _time_bucket(seconds).alias("_bucket")).agg(F.max(IDX).alias(IDX)).select(*GAME, IDX, F.lit(1.0).alias(name))
    return states.join(last, [*GAME, IDX], "left").na.fill(0.0, [name])


def time_bucket_sample(states: DataFrame, seconds: int = 30) -> DataFrame:
    """The last state of every elapsed-time bucket of a game."""
    last = states.groupBy(*GAME, _time_bucket(seconds).alias("time_bucket")).agg(
        F.max_by(F.struct(*[c for c in states.columns if c not in GAME]), IDX).alias("state")
    )
    return last.select(*GAME, "time_bucket", "state.*")


def dataset_summary(states: DataFrame) -> DataFrame:
    """One row per season: sizes, rates and states per game."""
    games = states.groupBy(*GAME).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(fv.TARGET).alias("wins"),
        F.max(fv.TARGET).alias("label"),
        F.sum("possession_known").alias("known"),
    )
    return games.groupBy("season").agg(
        F.sum("n").alias("row_count"),
        F.count(F.lit(1)).alias("games"),
        F.expr("round(sum(wins) / sum(n), 6)").alias("row_home_win_rate"),
        F.expr("round(avg(label), 6)").alias("game_home_win_rate"),
        F.expr("round(sum(known) / sum(n), 6)").alias("possession_known_rate"),
        F.expr("round(sum(n) / count(1), 6)").alias("mean_states_per_game"),
    )


def feature_ranges(states: DataFrame, features=fv.MODEL_FEATURES) -> DataFrame:
    """Nulls, minimum and maximum per season and feature."""
    parts = ", ".join(f"named_struct('feature', '{c}', 'value', CAST({c} AS DOUBLE))" for c in features)
    return states.selectExpr("season", f"inline(array({parts}))").groupBy("season", "feature").agg(
        F.expr("count_if(value IS NULL)").alias("missing"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )


def states_per_game_dist(states: DataFrame) -> DataFrame:
    """Exact, linearly interpolated percentiles; game sizes have few distinct values."""
    sizes = states.groupBy(*GAME).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("season").agg(
        F.min("n").alias("minimum"),
        F.expr("round(avg(n), 6)").alias("mean"),
        F.expr("round(percentile(n, 0.5D), 6)").alias("median"),
        F.expr("round(percentile(n, 0.95D), 6)").alias("p95"),
        F.max("n").alias("maximum"),
    )


def states_by_period(states: DataFrame) -> DataFrame:
    return states.groupBy("season", "period").agg(F.count(F.lit(1)).alias("n"))


def _histogram(states: DataFrame, label: str, bins: tuple) -> DataFrame:
    """Counts in bin order with empty bins kept. The bin table is a handful of literal rows."""
    counted = states.groupBy("season", F.expr(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    literal = ", ".join(f"named_struct('bin', {i}, 'label', '{name}')" for i, (_, name) in enumerate(bins))
    grid = counted.select("season").distinct().selectExpr("season", f"inline(array({literal}))")
    return grid.join(counted, ["season", "label"], "left").selectExpr("season", "bin", "label", "coalesce(n, 0) AS n")


def states_by_time_bin(states: DataFrame) -> DataFrame:
    return _histogram(states, ck.time_bin("seconds_remaining_regulation"), fv.TIME_BINS)


def states_by_score_bin(states: DataFrame) -> DataFrame:
    return _histogram(states, ck.score_bin("score_differential"), fv.SCORE_BINS)

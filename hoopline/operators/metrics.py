"""Distributed evaluation of probabilities.

Everything is worked out from one table of counts: per group and distinct probability, how many
rows won and how many lost. It is combined on the map side, so a probability that a third of all
rows share costs nothing extra. All metrics are sums along one chain of steps over those counts, without
a second look at the rows: the counts are put in order by Spark's sampled range partitioning, so that
each block has its share of them however probabilities bunch up; each block is summed up on its own, and the few
blocks of a group are added. A value that is no probability is counted along and is an error at the end,
so it fails in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.functions import clock as ck

EPSILON = 1e-7


def _double(value: float) -> str:
    return f"{value!r}D"


def outcome_counts(rows: DataFrame, by: list[str], target: str = "home_win", probability: str = "probability") -> DataFrame:
    """Per group and distinct probability: ``won``, ``lost``, and ``bad``, the rows without a probability (they stand at 0)."""
    bad = f"({probability} IS NULL OR isnan({probability}) OR {probability} < 0 OR {probability} > 1)"
    return rows.groupBy(*by, F.expr(f"CASE WHEN {bad} THEN 0D ELSE CAST({probability} AS DOUBLE) END").alias("p")).agg(
        F.expr(f"count_if({target} = 1)").alias("won"), F.expr(f"count_if({target} = 0)").alias("lost"), F.expr(f"count_if({bad})").alias("bad")
    )


def _checked(value: str) -> str:
    return f"CASE WHEN bad > 0 THEN raise_error('Not a probability') ELSE {value} END"


def bin_edges(bins: int) -> list[float]:
    """Evenly spaced edges as floating point makes them: multiples of the step, the last one exact."""
    if bins <= 0:
        raise ValueError("bins must be positive")
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def bin_number(p: str, bins: int = 10) -> str:
    """The bin of a probability: [lower, upper), the last bin closed."""
    steps = " + ".join(f"CAST({p} >= {_double(edge)} AS INT)" for edge in bin_edges(bins)[1:-1]) or "0"
    return f"({steps})"


def calibration_bins(rows: DataFrame, by: list[str] = [], bins: int = 10, **names) -> DataFrame:
    """Reliability bins in order; empty bins stay as zeros."""
    edges, number = bin_edges(bins), bin_number("p", bins)
    sums = {f"{name}_{k}": f"sum(CASE WHEN {number} = {k} THEN {text} END)" for k in range(bins) for name, text in (("n", "won + lost"), ("p", "p * (won + lost)"), ("y", "won"))}
    counts = outcome_counts(rows, by, **names)
    group = counts.groupBy(*by).agg(F.sum("bad").alias("bad"), *[F.expr(text).alias(name) for name, text in sums.items()])
    each = ", ".join(
        f"named_struct('bin', {k}, 'lower', {_double(edges[k])}, 'upper', {_double(edges[k + 1])}, 'count', coalesce(n_{k}, 0L), "
        f"'mean_predicted', coalesce(p_{k} / n_{k}, 0D), 'observed_rate', coalesce(y_{k} / n_{k}, 0D), 'absolute_gap', coalesce(abs(p_{k} - y_{k}) / n_{k}, 0D))"
        for k in range(bins)
    )
    # Without groups there is always one row; a bad value has made no sum null.
    return group.selectExpr(*by, f"inline({_checked(f'array({each})')})")


def ece(bins: DataFrame, by: list[str] = []) -> DataFrame:
    """Expected calibration error of a bin table; a table without rows in it is an error."""
    total = "CASE WHEN sum(count) = 0 THEN raise_error('No rows to calibrate') ELSE sum(count) END"
    return bins.groupBy(*by).agg(F.expr(f"sum(count * absolute_gap) / {total}").alias("ece"))


def _metrics_of_counts(counts: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """All metrics per group.

    A winner beats every loser below it and half of those at the same probability. Losers below are those of earlier blocks plus those inside
    the block.
    """
    clipped = f"greatest(least(p, {_double(1 - EPSILON)}), {_double(EPSILON)})"
    inside = ", ".join([*by, "block"])
    placed = counts.repartitionByRange(*by, "p").withColumn("block", F.spark_partition_id())
    placed = placed.withColumn("below", F.expr(f"coalesce(sum(lost) OVER (PARTITION BY {inside} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    sums = {
        "n": "won + lost",
        "won": "won",
        "lost": "lost",
        "bad": "bad",
        "square": "won * (p - 1) * (p - 1) + lost * p * p",
        "log": f"won * ln({clipped}) + lost * ln(1 - {clipped})",
        "right": "CASE WHEN p >= 0.5D THEN won ELSE lost END",
        "beaten": "won * (below + lost / 2D)",
        **{f"gap_{k}": f"CASE WHEN {bin_number('p', bins)} = {k} THEN p * (won + lost) - won ELSE 0D END" for k in range(bins)},
    }
    blocks = placed.groupBy(*by, "block").agg(*[F.expr(f"sum({text})").alias(name) for name, text in sums.items()])
    blocks = blocks.withColumn("before", F.expr(f"coalesce(sum(lost) OVER (PARTITION BY {', '.join(by)} ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    total = blocks.groupBy(*by).agg(F.expr("sum(beaten + CAST(won AS DOUBLE) * before)").alias("beaten"), *[F.sum(name).alias(name) for name in sums if name != "beaten"])
    gaps = " + ".join(f"abs(gap_{k})" for k in range(bins))
    return total.selectExpr(
        *by, f"{_checked('n')} AS row_count", "square / n AS brier", "-log / n AS log_loss", "right / n AS accuracy",
        "beaten / nullif(CAST(won AS DOUBLE) * lost, 0D) AS roc_auc", f"({gaps}) / n AS ece",
    )


def probability_metrics(rows: DataFrame, by: list[str] = [], bins: int = 10, **names) -> DataFrame:
    """Rows, Brier, log loss, accuracy, AUC and ECE per group (or overall)."""
    if by:
        return _metrics_of_counts(outcome_counts(rows, by, **names), by, bins)
    whole = outcome_counts(rows.withColumn("_all", F.lit(0)), ["_all"], **names)
    return _metrics_of_counts(whole, ["_all"], bins).drop("_all")


SLICES = {
    "period": ck.period_bucket("period"),
    "time_remaining": ck.time_bin("seconds_remaining_regulation"),
    "absolute_score_differential": ck.score_bin("score_differential"),
}


def slice_metrics(rows: DataFrame, **names) -> DataFrame:
    """Metrics per period, time bin and score bin; slices that saw one outcome only are left out."""
    labels = rows.withColumns({name + "_slice": F.expr(text) for name, text in SLICES.items()})
    counts = outcome_counts(labels, [name + "_slice" for name in SLICES], **names)
    # Rows are turned into three slices each after they were counted, not before.
    parts = ", ".join(f"named_struct('dimension', '{name}', 'label', {name}_slice)" for name in SLICES)
    sliced = counts.selectExpr("p", "won", "lost", "bad", f"inline(array({parts}))").where("label IS NOT NULL")
    sliced = sliced.groupBy("dimension", "label", "p").agg(*[F.sum(c).alias(c) for c in ("won", "lost", "bad")])
    return _metrics_of_counts(sliced, ["dimension", "label"]).where("roc_auc IS NOT NULL")


def compare_models(rows: DataFrame, predictions: dict[str, str], target: str = "home_win") -> DataFrame:
    """One row of metrics per model; ``predictions`` maps model name to its probability column."""
    pairs = ", ".join(f"'{name}', {column}" for name, column in predictions.items())
    long = rows.selectExpr(target, f"stack({len(predictions)}, {pairs}) AS (model, probability)")
    return probability_metrics(long, ["model"], target=target)


def select_model(metrics: DataFrame) -> DataFrame:
    """The model with the lowest Brier score, then log loss. ``metrics`` has one row per model."""
    return metrics.orderBy("brier", "log_loss").limit(1)


def should_calibrate(raw: DataFrame, calibrated: DataFrame) -> DataFrame:
    """One row: calibration is used only if it lowers both Brier score and log loss."""
    better = calibrated.select(F.struct("brier", "log_loss")).scalar()
    return raw.select("brier", "log_loss").withColumn("_c", better).selectExpr(
        "brier AS raw_brier",
        "log_loss AS raw_log_loss",
        "_c.brier AS calibrated_brier",
        "_c.log_loss AS calibrated_log_loss",
        "_c.brier < brier AND _c.log_loss < log_loss AS calibrate",
    )

"""Fits whose sums are taken on the cluster: Newton steps for logistic models, and gradient steps for perceptrons.

Several fits share each pass over the rows. What a pass brings to the driver is one set of sums for each fit, whose size
depends on the number of features or weights only; rows stay where they are. Each pass is a job of its own, so lost executors cost
no more than the tasks that they ran.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLIP = 50.0
#: Partial sums of so many tasks at most go to the driver; more are added up on the cluster first.
FAN_IN = 64


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -CLIP, CLIP)))


def task_count(rows: DataFrame) -> int:
    """How many tasks read ``rows``; one pass, which also fills a persisted table."""
    return 1 + (rows.select(F.spark_partition_id().alias("task")).agg(F.max("task")).first()[0] or 0)


def summed(rows: DataFrame, partial, arguments: int, tasks: int) -> np.ndarray:
    """Sum over all batches of ``rows`` (read by so many ``tasks``) of ``partial(batch)``, an array of ``arguments`` numbers."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(arguments), False
        for batch in batches:
            if len(batch):
                total += partial(batch)
                seen = True
        if seen:
            yield pd.DataFrame({"total": [total]})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((np.sum(np.stack(batch["total"].to_list()), 0) for batch in batches if len(batch)), np.zeros(arguments))
        yield pd.DataFrame({"total": [total]})

    parts = rows.mapInPandas(add, "total array<double>")
    if tasks > FAN_IN:
        parts = parts.repartition(FAN_IN).mapInPandas(add_up, "total array<double>")
    return np.sum([r["total"] for r in parts.collect()] or [np.zeros(arguments)], 0)


# --- Logistic models ----------------------------------------------------------------------


@dataclass(frozen=True)
class LinearModel:
    """A fitted logistic model; small enough to be a literal in a projection."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class LogisticSetting:
    """One logistic fit: its features, ``c``, the column that weighs rows (0 leaves a row out; none: all alike), and what is taken from a feature and divides it."""

    features: tuple[str, ...]
    c: float = 1.0
    weight: str | None = None
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)


def fit_logistics(rows: DataFrame, settings: dict[str, LogisticSetting], target: str, tolerance: float = 1e-9, steps: int = 60) -> dict[str, LinearModel]:
    """The minimum of half the squared coefficients plus ``c`` times the weighted log loss, for all settings, one pass over ``rows`` a Newton step.

    A step that does not lower the loss is halved. Coefficients are those of the scaled features. ``rows`` is read once a step, so it should be
    persisted or written. Fits end when no coefficient moves by more than ``tolerance``, and fail after ``steps`` passes.
    """
    names, features = list(settings), sorted({f for s in settings.values() for f in s.features})
    weights = sorted({s.weight for s in settings.values() if s.weight})
    columns = [F.col(c).cast("double").alias(c) for c in [*features, target, *weights]]
    narrow = rows.select(*columns)
    places = {n: [features.index(f) for f in s.features] for n, s in settings.items()}
    shift = {n: np.array([s.means.get(f, 0.0) for f in s.features]) for n, s in settings.items()}
    scale = {n: np.array([s.scales.get(f, 1.0) for f in s.features]) for n, s in settings.items()}
    size = {n: len(s.features) + 1 for n, s in settings.items()}
    weight_of = {n: s.weight for n, s in settings.items()}

    def partial(at: dict[str, np.ndarray]):
        def sums(batch: pd.DataFrame) -> np.ndarray:
            x, y = batch[features].to_numpy(float), batch[target].to_numpy(float)
            if not np.isfinite(x).all() or not np.isfinite(y).all():
                raise ValueError("A row has a feature or an outcome that is no number")
            out = []
            for name in at:
                w = batch[weight_of[name]].to_numpy(float) if weight_of[name] else np.ones(len(y))
                design = np.column_stack([(x[:, places[name]] - shift[name]) / scale[name], np.ones(len(y))])
                z = design @ at[name]
                p = _sigmoid(z)
                loss = w * (np.logaddexp(0.0, z) - y * z)
                curve = (design * (w * p * (1 - p))[:, None]).T @ design
                out += [[loss.sum()], design.T @ (w * (p - y)), curve.reshape(-1)]
            return np.concatenate(out)

        return sums

    tasks, found = task_count(narrow), {}
    now = {n: np.zeros(size[n]) for n in names}
    step = {n: np.zeros(size[n]) for n in names}
    lowest = {n: np.inf for n in names}
    for _ in range(steps):
        if not now:
            break
        trial = {n: now[n] + step[n] for n in now}
        total = summed(narrow, partial(trial), sum(1 + size[n] + size[n] ** 2 for n in trial), tasks)
        for n in list(trial):
            k, total_of = size[n], total[: 1 + size[n] + size[n] ** 2]
            total = total[len(total_of) :]
            c, penalty = settings[n].c, np.append(np.ones(k - 1), 0.0)
            loss = c * total_of[0] + 0.5 * float(penalty @ trial[n] ** 2)
            if loss > lowest[n] + 1e-9 * max(1.0, abs(lowest[n])):
                step[n] = step[n] / 2
                continue
            now[n], lowest[n] = trial[n], loss
            slope = c * total_of[1 : 1 + k] + penalty * trial[n]
            curve = c * total_of[1 + k :].reshape(k, k) + np.diag(penalty)
            step[n] = -np.linalg.lstsq(curve, slope, rcond=None)[0]
            if np.abs(step[n]).max() < tolerance:
                *coefficients, intercept = (now.pop(n) + step[n]).tolist()
                found[n] = LinearModel(settings[n].features, tuple(coefficients), intercept)
    if now:
        raise RuntimeError(f"No optimum after {steps} steps: {sorted(now)}")
    return {n: found[n] for n in names}


# --- Perceptrons --------------------------------------------------------------------------


@dataclass(frozen=True)
class NetSetting:
    """A perceptron with two hidden layers and how it is trained; a pass over the train rows is ``batches`` steps."""

    hidden: tuple[int, int] = (64, 32)
    dropout: float = 0.1
    learning_rate: float = 1e-3
    weight_decay: float = 1e-5
    epochs: int = 25
    patience: int = 4
    seed: int = 42


@dataclass(frozen=True)
class FittedNet:
    """Layers (weights, biases) of the best epoch; ``history`` has train loss and validation Brier score of each epoch."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    best_epoch: int
    history: list[tuple[float, float]]


BETAS, TINY = (0.9, 0.999), 1e-8
#: A new best epoch lowers the Brier score by more than this.
LEAST_GAIN = 1e-7


def first_layers(inputs: int, setting: NetSetting) -> list[tuple[np.ndarray, np.ndarray]]:
    """Uniform weights and biases within one over the root of a layer's inputs."""
    draw = np.random.default_rng(setting.seed)
    sizes = (inputs, *setting.hidden, 1)
    bound = [1 / np.sqrt(n) for n in sizes]
    return [(draw.uniform(-b, b, (m, n)), draw.uniform(-b, b, m)) for n, m, b in zip(sizes, sizes[1:], bound, strict=False)]


def kept_units(row: np.ndarray, seed: int, step: int, units: int, dropout: float) -> np.ndarray:
    """Which hidden units stay (scaled up) for each row; depends on row, seed and step alone, so a task that runs again draws the same."""
    x = row.astype(np.int64).view(np.uint64)[:, None] ^ np.uint64((seed * 1_000_003 + step) % (1 << 63))
    x = (x + np.arange(1, units + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    u = (x >> np.uint64(11)).astype(float) / (1 << 53)
    return (u >= dropout) / (1.0 - dropout)


def forward(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Logits, without dropout."""
    for depth, (w, b) in enumerate(layers):
        x = x @ w.T + b
        if depth < len(layers) - 1:
            x = np.maximum(x, 0.0)
    return x[:, 0]


def gradient(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray, weight: np.ndarray, kept: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
    """Summed weighted log loss of the rows and its gradient; ``kept`` scales the units of the first hidden layer."""
    (w1, b1), (w2, b2), (w3, b3) = layers
    a = np.maximum(x @ w1.T + b1, 0.0)
    h1 = a * kept
    h2 = np.maximum(h1 @ w2.T + b2, 0.0)
    z = (h2 @ w3.T + b3)[:, 0]
    d3 = (weight * (_sigmoid(z) - y))[:, None]
    d2 = (d3 @ w3) * (h2 > 0)
    d1 = (d2 @ w2) * kept * (a > 0)
    loss = float((weight * (np.logaddexp(0.0, z) - y * z)).sum())
    return loss, [(d1.T @ x, d1.sum(0)), (d2.T @ h1, d2.sum(0)), (d3.T @ h2, d3.sum(0))]


def _flat(layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([part.reshape(-1) for layer in layers for part in layer])


def _shaped(flat: np.ndarray, like: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


class AdamW:
    """Adam with the decay of weights apart from the gradient."""

    def __init__(self, size: int, setting: NetSetting):
        self.setting, self.count = setting, 0
        self.mean, self.square = np.zeros(size), np.zeros(size)

    def moved(self, weights: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.count += 1
        self.mean = BETAS[0] * self.mean + (1 - BETAS[0]) * slope
        self.square = BETAS[1] * self.square + (1 - BETAS[1]) * slope**2
        mean, square = self.mean / (1 - BETAS[0] ** self.count), self.square / (1 - BETAS[1] ** self.count)
        rate = self.setting.learning_rate
        return weights * (1 - rate * self.setting.weight_decay) - rate * mean / (np.sqrt(square) + TINY)


def fit_nets(
    train: DataFrame, validation: DataFrame, settings: dict[str, NetSetting], features, target: str, row: str, weight: str | None = None, batches: int = 8
) -> dict[str, FittedNet]:
    """Perceptrons trained on mini-batches of ``train``, ended when the Brier score on ``validation`` stops falling.

    ``row`` is a long that tells rows apart (a hash of their key): it deals them into ``batches`` mini-batches of the same expected size, which grow with the
    table, taken in another order in each epoch, and draws their dropout. A step is one job over one mini-batch for all settings that still train, a
    row's loss being multiplied by ``weight``; the weights of the nets, some thousand numbers, go with the job. ``train`` should be
    persisted or written, with the rows of a batch together if it is large.
    """
    features = list(features)
    names = list(settings)
    columns = [*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y")]
    extra = [F.col(row).cast("long").alias("_row"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")]
    rows, judged = train.select(*columns, *extra), validation.select(*columns)
    batch_of = F.pmod(F.xxhash64("_row", F.lit(17)), F.lit(batches))
    train_tasks, judged_tasks = task_count(rows), task_count(judged)
    layers = {n: first_layers(len(features), settings[n]) for n in names}
    optimizers = {n: AdamW(_flat(layers[n]).size, settings[n]) for n in names}
    best = {n: (np.inf, 0, layers[n]) for n in names}
    history: dict[str, list[tuple[float, float]]] = {n: [] for n in names}
    stale = dict.fromkeys(names, 0)
    active, epoch, taken = set(names), 0, 0
    while active:
        epoch += 1
        order = np.random.default_rng([settings[names[0]].seed, epoch]).permutation(batches)
        losses, counts = dict.fromkeys(active, 0.0), dict.fromkeys(active, 0.0)
        for batch in order.tolist():
            taken += 1
            nets = {n: layers[n] for n in sorted(active)}

            def sums(part: pd.DataFrame, nets=nets, step=taken) -> np.ndarray:
                x, y, w, row = part[features].to_numpy(float), part["_y"].to_numpy(), part["_w"].to_numpy(), part["_row"].to_numpy()
                out = [[float(len(y))]]
                for n, net in nets.items():
                    kept = kept_units(row, settings[n].seed, step, settings[n].hidden[0], settings[n].dropout)
                    loss, slopes = gradient(net, x, y, w, kept)
                    out += [[loss], _flat(slopes)]
                return np.concatenate(out)

            total = summed(rows.filter(batch_of == batch), sums, 1 + sum(1 + _flat(net).size for net in nets.values()), train_tasks)
            n_rows, at = total[0], 1
            for n, net in nets.items():
                flat = _flat(net)
                if n_rows:
                    layers[n] = _shaped(optimizers[n].moved(flat, total[at + 1 : at + 1 + flat.size] / n_rows), net)
                    losses[n] += total[at]
                    counts[n] += n_rows
                at += 1 + flat.size
        nets = {n: layers[n] for n in sorted(active)}

        def squares(part: pd.DataFrame, nets=nets) -> np.ndarray:
            x, y = part[features].to_numpy(float), part["_y"].to_numpy()
            return np.array([float(len(y)), *[((_sigmoid(forward(net, x)) - y) ** 2).sum() for net in nets.values()]])

        total = summed(judged, squares, 1 + len(nets), judged_tasks)
        if not total[0]:
            raise ValueError("There are no validation rows")
        for n, square in zip(nets, total[1:], strict=True):
            brier = float(square / total[0])
            history[n].append((float(losses[n] / max(counts[n], 1.0)), brier))
            better = brier < best[n][0] - LEAST_GAIN
            stale[n] = 0 if better else stale[n] + 1
            if better:
                best[n] = (brier, epoch, layers[n])
            if stale[n] >= settings[n].patience or epoch >= settings[n].epochs:
                active.discard(n)
    return {n: FittedNet(best[n][2], best[n][1], history[n]) for n in names}

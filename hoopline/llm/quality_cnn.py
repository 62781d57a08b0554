"""Document quality by a byte-level convolutional network in numpy.

The UTF-8 bytes of the whole text are cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP``. Bytes are embedded,
``FILTERS`` learned filters of ``WIDTH`` bytes slide over each chunk, and each filter keeps its largest response there
(max-pooling). The mean and the maximum of these over all chunks go into one logistic unit.

The network is fitted by Adam on the driver, on at most ``TRAIN_DOCS`` labelled documents of at most ``TRAIN_CHARS`` characters
(lowest hash of the id first), of each at most ``TRAIN_CHUNKS`` chunks spread evenly. Scoring is a narrow pass over all
documents; a document is scored from all its chunks. Null and empty texts are one chunk of zero bytes. Labels other
than 0 and 1 are not used; with no labelled documents of both kinds every score is the share of label 1, or 0.5. Repeated rows and ids are scored each on
their own; a label holds for all rows of its id. An empty table gives no rows. Of the documents only doc_id and text are read, and the score takes a name that the caller chooses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.llm.common import fold, read_table

CHUNK, OVERLAP = 256, 32
WIDTH, STRIDE, EMBED, FILTERS = 8, 4, 6, 16
TRAIN_DOCS, TRAIN_CHARS, TRAIN_CHUNKS = 3000, 20_000, 8
EPOCHS, STEPS, BATCH, RATE = 6, 1200, 16, 5e-3
FOLDS, HELD_OUT = 4, 2
KEEP = 0.7
Model = dict[str, np.ndarray]


def chunks(text: str | None) -> np.ndarray:
    """All bytes of ``text`` as rows of CHUNK bytes, the last one filled up with zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros(n * step + OVERLAP, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def _windows(model: Model, rows: np.ndarray) -> np.ndarray:
    """Embedded windows: (chunk, position, WIDTH * EMBED)."""
    embedded = model["embed"][rows].reshape(len(rows), -1)
    return np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]


def pooled(model: Model, rows: np.ndarray, positions: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response of each filter in each chunk and, if asked for, its position."""
    values, places = [], []
    for k in range(0, len(rows), 256):
        windows = np.ascontiguousarray(_windows(model, rows[k : k + 256]))
        response = (model["filters"].T @ windows.reshape(-1, WIDTH * EMBED).T).reshape(FILTERS, *windows.shape[:2])
        values.append(response.max(2).T)
        if positions:
            places.append(response.argmax(2).T)
    return np.maximum(np.concatenate(values) + model["bias"], 0), np.concatenate(places) if positions else None


def _combined(model: Model, hidden: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(sizes) - sizes
    both = np.concatenate([np.add.reduceat(hidden, starts) / sizes[:, None], np.maximum.reduceat(hidden, starts)], 1)
    return both, 1 / (1 + np.exp(-np.clip(both @ model["out"] + model["shift"], -30, 30)))


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each text."""
    if "share" in model:
        return np.full(len(texts), float(model["share"][0]))
    out, held, size = [np.zeros(0)], [], 0
    for k, text in enumerate(texts):
        held.append(chunks(text))
        size += len(held[-1])
        if size > 4096 or k == len(texts) - 1:
            hidden, _ = pooled(model, np.concatenate(held))
            out.append(_combined(model, hidden, np.array([len(c) for c in held]))[1])
            held, size = [], 0
    return np.concatenate(out).astype(float)


def fit(texts: list[str | None], labels: list[int], epochs: int | None = None, seed: int = 7) -> Model:
    """The network that fits ``labels`` (0 or 1), after ``EPOCHS`` epochs or about ``STEPS`` steps, whichever is more."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return {"share": np.array([y.mean() if len(y) else 0.5])}
    epochs = epochs or max(EPOCHS, -(-STEPS * BATCH // len(y)))
    random = np.random.default_rng(seed)
    model: Model = {
        "embed": random.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": random.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": random.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "shift": np.zeros(1, np.float32),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    docs = []
    for text in texts:
        rows = chunks(text)
        docs.append(rows[np.unique(np.linspace(0, len(rows) - 1, TRAIN_CHUNKS).astype(int))])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            rows = np.concatenate([docs[i] for i in own])
            sizes = np.array([len(docs[i]) for i in own])
            step += 1
            rate = RATE * (1 - epoch / epochs) * (1 - 0.9**step) ** -1 * (1 - 0.99**step) ** 0.5
            for name, slope in _slopes(model, rows, sizes, y[own], weight[own]).items():
                first, second = moments[name]
                first += 0.1 * (slope - first)
                second += 0.01 * (slope**2 - second)
                model[name] -= (rate * first / (np.sqrt(second) + 1e-8)).astype(np.float32)
    return model


def _slopes(model: Model, rows: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Gradient of the weighted log loss, through the positions that won the pooling."""
    hidden, places = pooled(model, rows, positions=True)
    both, p = _combined(model, hidden, sizes)
    error = (weight * (p - y) / len(y)).astype(np.float32)
    to_both = error[:, None] * model["out"]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    top = both[doc, FILTERS:]
    ties = np.add.reduceat((hidden == top).astype(np.float32), np.cumsum(sizes) - sizes)
    to_hidden = to_both[doc, :FILTERS] / sizes[doc, None] + np.where(hidden == top, to_both[doc, FILTERS:] / ties[doc], 0)
    to_hidden *= hidden > 0
    chunk, filter_ = np.nonzero(to_hidden)
    slope = to_hidden[chunk, filter_]
    won = rows[chunk[:, None], places[chunk, filter_][:, None] * STRIDE + np.arange(WIDTH)]
    inputs = model["embed"][won].reshape(len(slope), -1)
    filters = np.zeros((FILTERS, WIDTH * EMBED), np.float32)
    for f in range(FILTERS):
        at = filter_ == f
        filters[f] = slope[at] @ inputs[at]
    to_inputs = (slope[:, None] * model["filters"].T[filter_]).reshape(-1, EMBED)
    flat = won.reshape(-1)
    embed = np.stack([np.bincount(flat, to_inputs[:, e], 256) for e in range(EMBED)], 1)
    return {
        "embed": embed.astype(np.float32),
        "filters": filters.T,
        "bias": to_hidden.sum(0),
        "out": (error @ both).astype(np.float32) + 1e-4 * model["out"],
        "shift": error.sum(keepdims=True),
    }


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The network fitted on the labelled documents outside the held-out fold."""
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(TRAIN_DOCS)
    )
    short = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS)
    rows = short.join(F.broadcast(chosen), "doc_id").limit(2 * TRAIN_DOCS).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or "", r["quality"]))
    return fit([r["text"] for r in rows], [r["quality"] for r in rows])


def score(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``; its doc_id and labels are no inputs of the network."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scores(model, [t or "" for t in batch]))

    return docs.withColumn(name, of("text"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's probability of quality label 1."""
    scored = score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))

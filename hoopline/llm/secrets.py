"""Secrets: fixed patterns, and strings that look random to two character Markov models.

The patterns (kinds assign, access, hex) give the base spans. The method adds spans of kind ``random``: of all other
tokens of at least ``MIN_TOKEN`` characters of the secret alphabet, those whose log-likelihood under a Markov model of
random strings exceeds that under a model of ordinary identifiers by ``THRESHOLD`` nats per character; tokens of fewer than ``MIN_DISTINCT`` different
characters, such as rules of dashes, are left alone.

Both models are bigram models of what the patterns label: values that they find are random strings, all
other tokens of at least ``MIN_ORDINARY`` characters are ordinary; part of the random model is uniform, as secrets have many alphabets. The pairs of characters are
counted over all documents, whole, and summed on the cluster into two tables of fixed size. With no labelled values, random strings are uniform.

Null text counts as empty and has no spans; very long texts are read whole. Repeated rows count as often as they stand there and each have their result. An empty table gives no
rows. Only the id and the text are read, so names of other columns don't matter. Spans are in code points, end exclusive; spans that start together stand in the order of their kinds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopline.llm.common import read_table
from hoopline.operators.fitting import FAN_IN, summed

MIN_TOKEN, MIN_ORDINARY = 20, 4
#: Share of the models that is spread evenly over all characters.
UNIFORM_RANDOM, UNIFORM_ORDINARY = 0.5, 0.02
THRESHOLD = 1.0
MIN_DISTINCT = 8

# The patterns of the base spans, in the order of their kinds, with the least length of the checked group.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
PATTERNS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_TOKEN)
#: Runs that can pass the hex pattern's length; a run of this class is always a whole match of the pattern.
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CODE = np.full(128, -1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
N = len(ALPHABET)
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Pattern spans as (start, kind's place, end, kind), by start and then kind."""
    found = []
    for place, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind == "access" and "AKIA" not in text:
            continue
        for m in (LONG_HEX if kind == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), place, m.end(), kind))
    return sorted(found)


def _tokens(text: str, spans: list) -> tuple[list, list[str]]:
    """Long tokens outside of ``spans`` and the values inside them."""
    free = list(TOKEN.finditer(text))
    if free and spans:
        covered = np.zeros(len(text) + 1, np.int64)
        for start, _, end, _ in spans:
            covered[start + 1 : end + 1] = 1
        before = covered.cumsum()
        free = [m for m in free if before[m.end()] == before[m.start()]]
    values = [ASSIGN.match(text, start)[2] if kind == "assign" else text[start:end] for start, _, end, kind in spans]
    return free, values


def bigram_logs(counts: np.ndarray, uniform: float) -> np.ndarray:
    """Log probabilities of a character after another from their ``counts``, ``uniform`` of them shared out evenly; row N is the start."""
    counts = counts + 1e-9
    return np.log((1 - uniform) * counts / counts.sum(1, keepdims=True) + uniform / N)


def ratio(word: str, table: np.ndarray) -> float:
    """Mean log-likelihood ratio of ``word`` per character, ``table`` being the difference of two bigram tables."""
    codes = CODE[np.frombuffer(word.encode(), np.uint8)]
    return float(table[np.concatenate([[N], codes[:-1]]), codes].mean())


def pair_counts(text: str) -> np.ndarray:
    """How often a character follows another in the values that the patterns find, and in the ordinary tokens: two flat tables of (N + 1, N)."""
    spans = base_spans(text)
    out = np.zeros((2, (N + 1) * N))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(points < 128, CODE[np.minimum(points, 127)], -1)
    inside = np.concatenate([[False], codes >= 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= MIN_ORDINARY
    if spans:
        covered = np.zeros(len(codes) + 1, np.int64)
        for start, _, end, _ in spans:
            covered[start + 1 : end + 1] = 1
        before = covered.cumsum()
        keep &= before[ends] == before[starts]
        for value in _tokens(text, spans)[1]:
            own = CODE[np.frombuffer(value.encode(), np.uint8)]
            np.add.at(out[0], np.concatenate([[N], own[:-1]]) * N + own, 1)
    starts, sizes = starts[keep], (ends - starts)[keep]
    if len(starts):
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
        previous = codes[at - 1]
        previous[first] = N
        out[1] = np.bincount(previous * N + codes[at], minlength=(N + 1) * N)
    return out.reshape(-1)


def tables(counts: np.ndarray) -> np.ndarray:
    """Difference of the tables of random strings and of ordinary tokens, from the summed ``pair_counts``."""
    random, ordinary = counts.reshape(2, N + 1, N)
    return bigram_logs(random, UNIFORM_RANDOM) - bigram_logs(ordinary, UNIFORM_ORDINARY)


def train(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """The models' table from all documents; counts are added up on the cluster, so the driver gets FAN_IN tables of fixed size at most."""

    def counts(batch: pd.DataFrame) -> np.ndarray:
        return sum((pair_counts(t) for t in batch["text"] if t), np.zeros(2 * (N + 1) * N))

    return tables(summed(docs.select(F.col(text_column).alias("text")), counts, 2 * (N + 1) * N, tasks=FAN_IN + 1))


def all_spans(text: str, table: np.ndarray) -> tuple[list, list]:
    """Base spans, and all spans with those that the models add."""
    base = base_spans(text)
    added = [(m.start(), 3, m.end(), "random") for m in _tokens(text, base)[0] if len(set(m[0])) >= MIN_DISTINCT and ratio(m[0], table) > THRESHOLD]
    return base, sorted(base + added, key=itemgetter(0, 1))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, counts of the base kinds, digest of the base spans, all spans as text."""
    table = train(docs)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shown = lambda spans: ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, spans = all_spans(text or "", table)
                kinds = [s[3] for s in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pd.DataFrame({"doc_id": batch["doc_id"], **dict(zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans"), columns, strict=True))})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(found, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return find_secrets(read_table(spark, sf_dir, "documents"))

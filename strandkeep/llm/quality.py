"""Quality by a factorisation machine.

Features of a text: hashed words (their shares of the text), statistics of its structure, and metadata
derived from it (its lengths). The machine adds to the linear part the pairwise interactions of all
features through low-rank factors; a score costs time linear in the features by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep.llm import common
from strandkeep.llm.labelled import fold, training_rows

#: Labelled documents the model is fitted on, at most.
TRAINING_ROWS = 6_000
#: Buckets of hashed words, rank of the factors, passes and step of the training, weight decay.
BUCKETS, RANK, PASSES, STEP, DECAY = 1 << 11, 6, 120, 0.03, 1e-4
CUT = 0.3
_UPPER, _LOWER, _DIGIT, _SPACE = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(97, 123), range(48, 58), b" \t\n\r\v\f"))
_MARKS = [ord(c) for c in "!?*&%$#|.,"]
STATISTICS = 11 + len(_MARKS)


def statistics(data: bytes, words: list[bytes]) -> list[float]:
    """Structure and length features of a text, each of the order of 1."""
    n, k = max(1, len(data)), max(1, len(words))
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(1, int(seen[_UPPER | _LOWER].sum()))
    return [
        math.log1p(len(words)) / 5, math.log1p(len(data)) / 7, len(data) / k / 8,
        seen[_UPPER].sum() / letters, seen[_DIGIT].sum() / n * 5, seen[128:].sum() / n * 5,
        seen[33:48].sum() / n * 5, len(set(words)) / k, len(set(lines)) / max(1, len(lines)),
        math.log1p(len(lines)) / 3, math.log1p(n / max(1, len(lines))) / 6,
        *(min(1.0, seen[c] / k) for c in _MARKS),
    ]


def sparse(data: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets of the words, the words' shares scaled to unit length, and the statistics."""
    words = data.split()
    stats = statistics(data, words)
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32), stats
    bucket = np.bincount((common.hash_words([data.lower()])[0] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    at = bucket.nonzero()[0]
    value = np.sqrt(bucket[at].astype(np.float32))
    return at, value / np.sqrt((value * value).sum()), stats


def forward(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Logits of dense rows, and the factor sums."""
    sums = x @ model["v"]
    return model["b"] + x @ model["w"] + 0.5 * (sums**2 - (x * x) @ (model["v"] ** 2)).sum(1), sums


def train(rows: list[tuple[str, int]]) -> dict | None:
    """Adam on the logistic loss over all training rows at once; None if a class is missing."""
    if len({label for _, label in rows}) < 2:
        return None
    rng = np.random.default_rng(11)
    x, y = np.zeros((len(rows), BUCKETS + STATISTICS), np.float32), np.array([label for _, label in rows], np.float32)
    for k, (text, _) in enumerate(rows):
        at, value, stats = sparse(text.encode("utf-8", "surrogatepass"))
        x[k, at] = value
        x[k, BUCKETS:] = stats
    mean, spread = x[:, BUCKETS:].mean(0), x[:, BUCKETS:].std(0) + 1e-3
    x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - mean) / spread, -5, 5) / math.sqrt(STATISTICS)
    m = {"b": np.float32(0), "w": np.zeros(x.shape[1], np.float32), "v": rng.normal(0, 0.05, (x.shape[1], RANK)).astype(np.float32)}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in m.items()}
    square = x * x
    for t in range(1, PASSES + 1):
        z, sums = forward(x, m)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grads = {"b": e.sum(), "w": x.T @ e + DECAY * m["w"], "v": x.T @ (e[:, None] * sums) - (square.T @ e)[:, None] * m["v"] + DECAY * m["v"]}
        for k, g in grads.items():
            a, b = moments[k]
            a[...] = 0.9 * a + 0.1 * g
            b[...] = 0.99 * b + 0.01 * g * g
            m[k] = (m[k] - STEP * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return m | {"mean": mean, "spread": spread}


def score(data: bytes, model: dict) -> float:
    """The score of one text, in time linear in its distinct words."""
    at, value, stats = sparse(data)
    s = np.clip((np.array(stats, np.float32) - model["mean"]) / model["spread"], -5, 5) / math.sqrt(STATISTICS)
    v, u = model["v"][at], model["v"][BUCKETS:]
    sums = value @ v + s @ u
    squares = (value**2) @ v**2 + (s**2) @ u**2
    z = float(model["b"] + value @ model["w"][at] + s @ model["w"][BUCKETS:] + 0.5 * (sums**2 - squares).sum())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score_quality(docs: DataFrame, labels: DataFrame, training_rows_: int = TRAINING_ROWS) -> DataFrame:
    """docs with held_out, score, predicted.

    Empty and null texts score by their statistics alone, very long ones by all their words. Without labelled
    rows of both classes every score is 0.5. Rows count one by one: repeated ones score alike, and of a labelled
    doc_id with several texts one is learnt from. Columns of these names are replaced. An empty table gives an
    empty one. The model, some 60 KB, goes in the function's closure.
    """
    docs = docs.drop("held_out", "score", "predicted")
    model = train(training_rows(docs, labels, "quality", 5, 0, training_rows_))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([0.5 if model is None else score((x or "").encode("utf-8", "surrogatepass"), model) for x in batch], dtype=float)

    out = docs.withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False))).withColumn("score", scored("text"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op8_quality": op8_quality}

"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text: one of ordinary words, one of the segments that set toxic
documents apart. A text is read in windows of one word; every different window, behind a short carrier
that both dictionaries hold, is compressed with either dictionary, and the difference of the two lengths in
bytes says how much better the toxic one explains it. A document's differences are counted over rising
thresholds, and a logistic curve turns the counts into a score. It is fitted across folds: each labelled
document is measured with dictionaries of the other folds, the final ones see all of them.

Windows of one word let a worker remember the difference of every word it has met, so the cost follows the
distinct words. Windows of two or three words were tried and find less, as chance matches of the neighbours
drown a word's gain. The carrier keeps short windows above the length from which zstandard compresses at all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep.llm import common
from strandkeep.llm.labelled import fold, training_rows

#: Labelled documents the model is fitted on, at most, and the folds of the calibration.
TRAINING_ROWS, FOLDS = 6_000, 3
#: Bytes of the dictionaries' contents.
TOXIC_BYTES, ORDINARY_BYTES = 4_000, 128_000
#: The optimal parser without its second passes: as good on such short windows, at a third of their cost.
LEVEL, STRATEGY = 19, zstandard.STRATEGY_BTOPT
THRESHOLDS = (2, 3, 4, 5, 6, 8, 10, 12)
#: Documents with this score or more are predicted toxic.
CUT = 0.3
#: Lengths of the segments that the toxic dictionary is chosen from.
SEGMENTS = range(4, 13)
_CARRIER = "|zqxj0vkw8yhg3bfm5pdl7ctn2r9s4u6e1aio|"
_MARKS = ".,;:!?*&%$#|\"'()[]{}<>-_/\\+=~^`@"
#: Words whose differences a worker remembers, some 50 MB of them.
_CACHE = 1 << 18


def _coded(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Distances(dict):
    """word -> bytes saved by the toxic dictionary against the ordinary one; bounded."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        self.compressors = [self.compressor(x) for x in (ordinary, toxic)]

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        data = content + _coded(_CARRIER)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, strategy=STRATEGY, source_size=128, dict_size=len(data), min_match=3, write_content_size=False, write_dict_id=False, write_checksum=False)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        bare = word.strip(_MARKS)
        if bare != word:
            value = self[bare]
        else:
            window = _coded(f"{_CARRIER} {bare} ")
            ordinary, toxic = self.compressors
            value = len(ordinary.compress(window)) - len(toxic.compress(window))
        self[word] = value
        return value


_KEPT: dict[str, Distances] = {}


def distances_of(model: dict) -> Distances:
    """The model's distances; a worker keeps those of the last model from one task to the next."""
    if model["key"] not in _KEPT:
        _KEPT.clear()
        _KEPT[model["key"]] = Distances(model["ordinary"], model["toxic"])
    return _KEPT[model["key"]]


def segments(word: str) -> set[str]:
    w = f" {word.strip(_MARKS)} "
    return {w[i : i + n] for n in SEGMENTS for i in range(len(w) - n + 1)}


def frequent_segments(words: Counter, least: float) -> Counter:
    """How often each segment occurs, of those that occur least times; length by length, as a frequent one has frequent parts."""
    bare: Counter = Counter()
    for word, n in words.items():
        bare[f" {word.strip(_MARKS)} "] += n
    found: Counter = Counter()
    for size in SEGMENTS:
        longer: Counter = Counter()
        for w, n in bare.items():
            for s in {w[k : k + size] for k in range(len(w) - size + 1)}:
                if size == SEGMENTS[0] or s[1:] in found and s[:-1] in found:
                    longer[s] += n
        found.update({s: n for s, n in longer.items() if n >= least})
    return found


def dictionaries(rows: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary's contents.

    The ordinary one holds the words of most ordinary documents (zstandard's own training on the same words was
    tried and lets more ordinary words through). The toxic one holds the segments of toxic documents ranked by the bytes they would save
    there, weighted by how much more often they occur than in ordinary ones; a segment inside one already
    chosen is passed over. In both the best stands last, where zstandard reaches it cheapest.
    """
    count = {0: Counter(), 1: Counter()}
    docs = Counter()
    for text, label in rows:
        count[label].update(set(words_of(text)))
        docs[label] += 1
    in_toxic = frequent_segments(count[1], max(2, min(4, docs[1] // 20), docs[1] * 0.003))
    in_ordinary: Counter = Counter()
    for word, n in count[0].items():
        w = f" {word.strip(_MARKS)} "
        if any(w[k : k + SEGMENTS[0]] in in_toxic for k in range(len(w) - SEGMENTS[0] + 1)):
            for s in segments(word) & in_toxic.keys():
                in_ordinary[s] += n
    ranked = []
    for s in in_toxic:
        odds = math.log((in_toxic[s] + 0.5) / (docs[1] + 1) / ((in_ordinary[s] + 0.5) / (docs[0] + 1)))
        if odds > 3:
            ranked.append((in_toxic[s] * (odds - 1) * (len(s) - 3), s))
    chosen: list[str] = []
    joined = ""
    for _, s in sorted(ranked, key=lambda x: (-x[0], x[1])):
        if s not in joined:
            chosen.append(s)
            joined += "|" + s
            if len(joined) > TOXIC_BYTES:
                break
    bare: Counter = Counter()
    for word, n in count[0].items():
        bare[word.strip(_MARKS)] += n
    common_words = sorted(bare, key=lambda w: (-bare[w], w))[:ORDINARY_BYTES // 4]
    return _coded(" ".join(reversed(common_words)))[-ORDINARY_BYTES:], _coded("|".join(reversed(chosen)))


def features(words: list[str], distances: Distances) -> list[float]:
    """What the curve is fitted on: the three largest differences, and the different words over each threshold."""
    d = sorted((distances[w] for w in set(words)), reverse=True) or [0]
    first = [*d[:3], 0, 0][:3]
    over = [math.log1p(sum(x >= k for x in d)) for k in THRESHOLDS] if first[0] >= THRESHOLDS[0] else [0.0] * len(THRESHOLDS)
    return [1.0, *first, float(first[0] >= 6), float(first[1] >= 6), *over, math.log1p(len(d))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights on the raw features by Newton steps on standardised ones; the first feature is constant."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    mean[0], spread[0] = 0.0, 1.0
    z, w = (x - mean) / spread, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
    w /= spread
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


def folds(rows: list[tuple[str, int]], most: int = FOLDS) -> np.ndarray | None:
    """The fold of each row, each class dealt evenly; None if a class has fewer than two rows."""
    labels = np.array([label for _, label in rows])
    least = min(int((labels == k).sum()) for k in (0, 1)) if rows else 0
    if least < 2:
        return None
    out, rng = np.zeros(len(rows), int), np.random.default_rng(5)
    for k in (0, 1):
        own = rng.permutation(np.flatnonzero(labels == k))
        out[own] = np.arange(len(own)) % min(most, least)
    return out


def train(rows: list[tuple[str, int]]) -> dict | None:
    """The model as plain data; None if a class has fewer than two rows."""
    of = folds(rows)
    if of is None:
        return None
    x, y = [], []
    for k in range(of.max() + 1):
        distances = Distances(*dictionaries([r for r, f in zip(rows, of, strict=True) if f != k]))
        own = [r for r, f in zip(rows, of, strict=True) if f == k]
        x += [features(words_of(text), distances) for text, _ in own]
        y += [label for _, label in own]
    ordinary, toxic = dictionaries(rows)
    weights = fit_logistic(np.array(x), np.array(y, float)).tolist()
    return {"ordinary": ordinary, "toxic": toxic, "weights": weights, "key": xxhash.xxh3_128_hexdigest(ordinary + b"|" + toxic)}


def score_toxicity(docs: DataFrame, labels: DataFrame, training_rows_: int = TRAINING_ROWS) -> DataFrame:
    """docs with held_out, score, predicted; columns of these names are replaced.

    Empty and null texts score as a text of no toxic words; very long ones are read whole, word by word. With
    fewer than two labelled rows of a class every score is 0. Rows count one by one: repeated ones score alike,
    and of a labelled doc_id with several texts one is learnt from. An empty table gives an empty one. The
    model, some 140 KB, goes in the function's closure.
    """
    docs = docs.drop("held_out", "score", "predicted")
    model = train(training_rows(docs, labels, "toxic", 4, 2, training_rows_))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distances = distances_of(model) if model else None
        weights = np.array(model["weights"]) if model else None
        for batch in batches:
            if model is None:
                yield pd.Series(np.zeros(len(batch)))
                continue
            z = np.array([features(words_of(text or ""), distances) @ weights for text in batch], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        common.release_memory()

    out = docs.withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False))).withColumn("score", scored("text"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}

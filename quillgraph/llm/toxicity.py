"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the hashed n-grams of each lower-cased word with its ends marked, present or not. It learns from at most TRAIN_ROWS
labelled rows (a share by the hash of their ids, so small label tables are used whole). How many rows of either class have a
feature is summed in each task before it is shuffled. The log-count ratio of a feature is that of its smoothed shares in
the two classes. Features whose ratio stands out from chance are kept (MOST_FEATURES at most), each scaled by its ratio, and
a logistic regression over them is fitted on the driver from the rows' kept features.

Scoring reads whole texts, one row at a time; the model is at most MOST_FEATURES numbers. Words recur, so a worker keeps which kept
features a word has.

Nulls and empty texts have no feature: the score is that of the intercept. Rows whose label or id is null are not learnt from. If no
labelled row is left, or all have one label, the score is the smoothed share of label 1. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, sliced, unused

#: Bits of a feature's hash.
BITS = 20
#: Lengths of n-grams; a word's ends are marked by a space each.
SIZES = (3, 4, 5, 6)
#: Labelled rows that are learnt from, and features that are kept, at most.
TRAIN_ROWS, MOST_FEATURES = 12_000, 5_000
#: Training rows that must have a feature, and how many standard errors its ratio must be from 0.
LEAST_ROWS, LEAST_Z = 4, 3.0
SMOOTH = 0.5
#: Words that a worker keeps the features of, and the length of those it keeps.
CACHED_WORDS, CACHED_LENGTH = 100_000, 64
#: Characters, and words, whose n-grams are made at a time, and bytes of text whose features are counted at a time.
PIECE, WORDS_AT_ONCE, TRAIN_BYTES = 1 << 15, 10_000, 1 << 18


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word in the list, hashed n-gram), in order of place; n-grams of a word may repeat. Words hold no spaces.

    The joined words are worked through PIECE characters at a time, so that memory beyond the result doesn't grow with them.
    """
    chars = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "replace"), "<u4")
    places, features, before = [], [], 0
    for at in range(0, len(chars), PIECE):
        x = chars[at : at + PIECE + SIZES[-1] - 1].astype("u8")
        own = min(PIECE, len(chars) - at)  # n-grams that start in this piece
        spaces = before + np.cumsum(x == 32)
        few, before = spaces[own - 1] - before < own // 64, int(spaces[own - 1])
        place, feature = [], []
        for n in SIZES:
            m = min(own, len(x) - n + 1)
            if m <= 0:
                continue
            h = np.zeros(m, "u8")
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + x[k : k + m]
            h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            inside = np.flatnonzero(spaces[n - 2 : n - 2 + m] == spaces[:m])
            place.append((spaces[inside] - 1).astype("i4"))
            feature.append((h[inside] >> np.uint64(64 - BITS)).astype("i4"))
        if place:
            found = np.concatenate(place), np.concatenate(feature)
            if few:  # long words: what repeats in a piece stands once
                keys = np.unique(found[0].astype("i8") << BITS | found[1])
                found = (keys >> BITS).astype("i4"), (keys & (1 << BITS) - 1).astype("i4")
            else:
                order = np.argsort(found[0], kind="stable")
                found = found[0][order], found[1][order]
            places.append(found[0])
            features.append(found[1])
    none = np.zeros(0, "i4")
    return np.concatenate(places or [none]), np.concatenate(features or [none])


@dataclass
class Model:
    """Kept features (sorted), their weights (ratio times coefficient) and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


class Scorer:
    """Which kept features texts have."""

    def __init__(self, features: np.ndarray):
        self._index = np.full(1 << BITS, -1, "i4")
        self._index[features] = np.arange(len(features))
        self._numbers = list(range(len(features)))  # one object for each, however many words have it
        self._words: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        found: dict[str, tuple[int, ...]] = dict.fromkeys(words, ())
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            place, feature = word_features(some)
            index = self._index[feature]
            place, index = place[index >= 0], index[index >= 0]
            edges = np.flatnonzero(np.diff(place)) + 1
            for which, own in zip(place[np.concatenate(([0], edges))].tolist() if len(place) else (), np.split(index, edges), strict=False):
                found[some[which]] = tuple(map(self._numbers.__getitem__, set(own.tolist())))
        return found

    def rows(self, texts: list[str]) -> list[list[int]]:
        """Sorted indexes of the kept features that each text has."""
        split = [set(text.lower().split()) for text in texts]
        if len(self._words) > CACHED_WORDS:
            self._words = {}
        known = self._words
        new = [w for w in set().union(*split) if w not in known]
        long = [w for w in new if len(w) > CACHED_LENGTH]
        known.update(self._learn([w for w in new if len(w) <= CACHED_LENGTH]))
        if long:
            known = known | self._learn(long)
        out = []
        for words in split:
            found: set[int] = set()
            for features in filter(None, map(known.__getitem__, words)):
                found.update(features)
            out.append(sorted(found))
        return out


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label) of documents with a label for which ``allowed`` (over labels) holds, of at most TRAIN_ROWS labels.

    Where there are more, a share of the labels by the hash of their id is taken. The labels taken are broadcast, as their number is
    bounded, so texts are not shuffled.
    """
    rows = labels.where(allowed & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    n = rows.count()
    if n > TRAIN_ROWS:
        cut = int(0.97 * TRAIN_ROWS / n * (1 << 32))
        place = F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(1 << 32))
        rows = rows.where(place < cut).orderBy(place, "__id", "label").limit(TRAIN_ROWS)  # an order, so that the same rows are learnt from each time
    return docs.select(F.col(f"`{id_col}`").alias("__doc"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(rows), F.col("__doc") == F.col("__id")).select("text", "label")


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(f, pos, neg): rows of label 1 and of label 0 that have each feature; -1 stands for all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), "i4")
        rows = [0, 0]
        for batch in sliced(batches, "text", TRAIN_BYTES):
            split = [list(set(t.decode("utf-8", "replace").lower().split())) for t in as_bytes(batch.column(0))]
            every = list(set().union(*split))
            number = {w: k for k, w in enumerate(every)}
            place, feature = word_features(every)
            start = np.searchsorted(place, np.arange(len(every) + 1))
            for words, y in zip(split, batch.column(1).to_pylist(), strict=True):
                rows[y] += 1
                if words:
                    own = np.fromiter(map(number.__getitem__, words), "i8", len(words))
                    size = start[own + 1] - start[own]
                    at = np.repeat(start[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    counts[y, np.unique(feature[at])] += 1
        at = np.flatnonzero(counts.any(axis=0))
        long = lambda y: pa.array(np.append(counts[y, at], rows[y]).astype("i8"))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype("i4")), long(1), long(0)], names=["f", "pos", "neg"])

    sums = labelled.select("text", "label").mapInArrow(run, "f int, pos long, neg long")
    return sums.groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(row: np.ndarray, feature: np.ndarray, y: np.ndarray, ratios: np.ndarray, rounds: int = 200, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of the regression on scaled features, by accelerated gradient steps with a ridge penalty.

    ``row`` and ``feature`` say which rows have which features.
    """
    value, n = ratios[feature], len(y)
    # A bound on the curvature: the largest eigenvalue of X'X/4, by power steps.
    v, norm = np.ones(len(ratios)), 0.0
    for _ in range(20):
        u = np.bincount(row, value * v[feature], n)
        v = np.bincount(feature, value * u[row], len(ratios))
        norm = np.linalg.norm(v)
        if norm == 0:
            break
        v /= norm
    step = 1 / (0.3 * max(norm, 1.0) + penalty)
    share = (y.sum() + SMOOTH) / (n + 2 * SMOOTH)
    bias = np.log(share / (1 - share))
    w = old = np.zeros(len(ratios))
    for t in range(rounds):
        look = w + t / (t + 3) * (w - old)
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, value * look[feature], n), -500, 500)))
        g = np.bincount(feature, value * (p - y)[row], len(ratios)) + penalty * look
        old, w = w, look - step * g
        bias -= 4 / n * (p - y).sum()
    return w, float(bias)


def train(labelled: DataFrame) -> Model:
    """Learn from rows (text, label 0 or 1), as ``training_rows`` gives them."""
    counts = feature_counts(labelled)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    total = counts.where("f < 0").head()
    n_pos, n_neg = (total["pos"], total["neg"]) if total else (0, 0)
    share = (n_pos + SMOOTH) / (n_pos + n_neg + 2 * SMOOTH)
    plain = Model(np.zeros(0, "i4"), np.zeros(0), float(np.log(share / (1 - share))))
    if not n_pos or not n_neg:
        return plain
    ratio = F.log((pos + SMOOTH) / (n_pos + 2 * SMOOTH)) - F.log((neg + SMOOTH) / (n_neg + 2 * SMOOTH))
    error = F.sqrt(1 / (pos + SMOOTH) - F.lit(1 / (n_pos + 2 * SMOOTH)) + 1 / (neg + SMOOTH) - F.lit(1 / (n_neg + 2 * SMOOTH)))
    ranked = counts.where(f"f >= 0 AND pos + neg >= {LEAST_ROWS}").select("f", ratio.alias("ratio"), (F.abs(ratio) / F.greatest(error, F.lit(1e-9))).alias("z"))
    best = ranked.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(MOST_FEATURES).select("f", "ratio").toArrow()
    if not best.num_rows:
        return plain
    kept, ratios = best.column("f").to_numpy(), best.column("ratio").to_numpy()
    order = np.argsort(kept)
    kept, ratios = kept[order], ratios[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(kept)
        for batch in sliced(batches, "text"):
            found = [np.array(f, "<i4").tobytes() for f in scorer.rows([t.decode("utf-8", "replace") for t in as_bytes(batch.column(0))])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["f", "y"])

    # At most TRAIN_ROWS rows (more only if the table repeats ids) of kept features, packed.
    rows = labelled.select("text", "label").mapInArrow(run, "f binary, y int").orderBy("f", "y").limit(2 * TRAIN_ROWS).toArrow()
    packed = rows.column("f").to_pylist()
    row = np.repeat(np.arange(len(packed), dtype="i4"), [len(f) // 4 for f in packed])
    weights, bias = fit(row, np.frombuffer(b"".join(packed), "<i4"), rows.column("y").to_numpy().astype("f8"), ratios)
    return Model(kept, weights * ratios, bias)


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, all by default) with the probability of label 1 as a double."""
    names = [c for c in (df.columns if keep is None else keep) if c != out_col]
    work = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias(unused(names, "__text")))
    schema = T.StructType([*work.schema.fields[: len(names)], T.StructField(out_col, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, bias = shared.value
        scorer, weight = Scorer(features), weights.tolist()
        for batch in sliced(batches, len(names)):
            sums = [bias + sum(weight[k] for k in found) for found in scorer.rows([t.decode("utf-8", "replace") for t in as_bytes(batch.column(len(names)))])]
            p = 1 / (1 + np.exp(-np.clip(np.array(sums, "f8"), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p)], names=schema.names)

    return work.mapInArrow(run, schema)

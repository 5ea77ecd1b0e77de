"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: byte trigrams, and up to three word forms in a row (case, marks, digits,
whether a word repeats the one before). Each n-gram indicator is scaled by its log-count ratio between the
classes, and a linear hinge-loss model is fitted to the scaled indicators by dual coordinate descent. Scores
are margins put through a logistic curve that is fitted on training rows the model has not seen.

The model is fitted on at most ``rows`` labelled documents, those whose key hashes lowest; scoring covers all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierspark.llm.common import bounded, pick, sliced

BUCKETS = 1 << 18
TRAINING_ROWS = 12_000
# Fixed values of the contract: rows with this remainder are held out, and a score from here on is good.
FOLDS, HELD_OUT, GOOD_FROM = 5, 0, 0.3

FORMS = 64


def word_form(word: str) -> int:
    """Case, marks and digits of a word as a number below 32; white-space words only."""
    core = word.rstrip(".,;:!?")
    upper, lower = core.isupper() and len(core) > 1, core.islower()
    marks = sum(not c.isalnum() for c in core)
    odd_end = len(word) - len(core) > 1
    digits = any(c.isdigit() for c in core)
    case = 3 if upper else 2 if lower else 1 if core[:1].isupper() else 0
    return case + 4 * (2 if marks > 1 else min(marks, 1)) + 12 * odd_end + (24 if digits and case == 0 else 0)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Codes spread over the buckets."""
    spread = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


class Features:
    """Distinct n-gram buckets per text of an Arrow batch."""

    def __init__(self) -> None:
        self._seen = np.zeros(BUCKETS, np.int64)
        self._forms: dict[str, int] = {}

    def _distinct(self, codes: np.ndarray) -> np.ndarray:
        order = np.arange(len(codes))
        self._seen[codes] = order
        return codes[self._seen[codes] == order]

    def _form_grams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        coded = lists.flatten().dictionary_encode()
        words, offsets = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        known = self._forms
        if len(known) > 200_000:
            known.clear()
        forms = [known[w] if w in known else known.setdefault(w, word_form(w)) for w in coded.dictionary.to_pylist()]
        again = np.zeros(len(words), np.int64)
        again[1:] = words[1:] == words[:-1]
        first = np.zeros(len(words) + 1, bool)
        first[offsets] = True
        again[first[:-1]] = 0
        one = np.array(forms, np.int64)[words] + 32 * again + 1 if len(words) else words
        two, three = np.zeros_like(one), np.zeros_like(one)
        two[1:] = one[1:] * (FORMS + 2) + one[:-1]
        three[2:] = two[2:] * (FORMS + 2) + one[:-2]
        start = np.flatnonzero(first[:-1])
        two[start] = 0
        three[start] = 0
        three[start[start + 1 < len(three)] + 1] = 0
        grams = np.stack([one, two + (1 << 20) * (two > 0), three + (1 << 22) * (three > 0)], axis=1) + (1 << 25)
        return _mixed(grams), offsets

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """The buckets of each text; none for NULL and empty ones but a mark that there is nothing."""
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        grams, words = self._form_grams(texts)
        out = []
        for at, text in enumerate(texts):
            raw = np.frombuffer(text.as_buffer() or b"", np.uint8).astype(np.int64)
            codes = _mixed((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]) if len(raw) > 2 else np.zeros(0, np.int64)
            own = grams[words[at] : words[at + 1]].ravel()
            out.append(self._distinct(np.concatenate([codes, own, _mixed(np.array([len(raw) == 0]) + (1 << 26))])))
        return out


@dataclass(frozen=True)
class Model:
    """``weights`` on raw indicators (log-count ratios multiplied in), and the logistic curve over margins."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(1, len(found))) + self.bias)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Per bucket the log of its smoothed share among good rows over that among bad ones."""
    counts = np.ones((2, BUCKETS))
    for found, label in zip(rows, good):
        counts[int(label)][found] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, rounds: int = 12
) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model, one dual variable at a time, rows in a fixed random order."""
    weights, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    squared = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / squared[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return weights, bias


def logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve that turns margins into probabilities, by Newton's method, slightly held back."""
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        gradient = x.T @ (p - good) + 0.1 * (theta - np.array([1.0, 0.0]))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), gradient)
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(rows: list[np.ndarray], good: np.ndarray, cost: float = 1.0) -> Model:
    """The model of labelled rows. Without both classes every score is the share of good rows, smoothed."""
    share = (good.sum() + 1) / (len(good) + 2)
    flat = Model(np.zeros(BUCKETS), 0.0, 1e-3, float(np.log(share / (1 - share))))
    if not 0 < good.sum() < len(good):
        return flat
    kept_back = np.arange(len(good)) % 5 == 4
    train = np.flatnonzero(~kept_back)
    if not 0 < good[train].sum() < len(train):
        return flat
    ratios = log_count_ratios([rows[i] for i in train], good[train])
    values = [ratios[rows[i]] / np.sqrt(max(1, len(rows[i]))) for i in train]
    # Both classes weigh the same in all.
    weight = np.where(good[train], 0.5 / good[train].mean(), 0.5 / (1 - good[train].mean()))
    weights, bias = dual_coordinate_descent(
        [rows[i] for i in train], values, np.where(good[train], 1.0, -1.0), cost * weight
    )
    raw = Model(weights * ratios, bias, 1.0, 0.0)
    seen = np.flatnonzero(kept_back) if kept_back.sum() >= 50 else np.arange(len(good))
    slope, shift = logistic(np.array([raw.margin(rows[i]) for i in seen]), good[seen].astype(float))
    return Model(raw.weights, bias, slope, shift)


def remainder(key: Column) -> Column:
    """The fold of a row: the CRC-32 of its key as text, modulo 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    rows: int = TRAINING_ROWS,
) -> Model:
    """Fit on labelled documents outside the held-out fold, at most ``rows`` of them.

    Labels other than 0 and 1, and rows without a key, are left out; of labels or texts that share a key
    one counts. The chosen labels are bounded in number, hence sent to the scan of the documents, so no text
    is moved but as n-grams.
    """
    known = pick(labels, _key=key, _label=label).where("_key IS NOT NULL AND _label IN (0, 1)")
    chosen = (
        known.where(remainder(F.col("_key")) != HELD_OUT)
        .groupBy("_key")
        .agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(rows)
    )
    texts = pick(docs, _key=key, _text=text).join(F.broadcast(chosen), "_key").select("_key", "_label", "_text")
    kind = texts.schema["_key"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in sliced(batches, 2):
            grams = [np.sort(f).astype("<i4").tobytes() for f in features.of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(grams, pa.binary())], ["_key", "_label", "grams"]
            )

    sample = (
        texts.mapInArrow(cut, f"_key {kind}, _label {texts.schema['_label'].dataType.simpleString()}, grams binary")
        .groupBy("_key", "_label")
        .agg(F.min("grams").alias("grams"))
    )

    def learn(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["at", "_key"])
        found = [np.frombuffer(g, "<i4").astype(np.int64) for g in sample["grams"]]
        model = fit(found, sample["_label"].to_numpy() == 1)
        weights = model.weights.astype("<f4").tobytes()
        return pd.DataFrame({"weights": [weights], "curve": [[model.bias, model.slope, model.shift]]})

    placed = sample.withColumn("at", F.xxhash64("_key")).withColumn("all", F.lit(1))  # bounded: one task learns
    row = placed.groupBy("all").applyInPandas(learn, "weights binary, curve array<double>").first()
    if row is None:
        return fit([], np.zeros(0, bool))
    return Model(np.frombuffer(row["weights"], "<f4").astype(np.float64), *row["curve"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, score, predicted)`` of every whole text; no row is moved.

    A NULL text is an empty one and has a score too. Rows that repeat are scored alike; a row without a key
    counts as the empty key for ``held_out``.
    """
    rows = pick(docs, **{key: key, "_text": text})
    held = rows.select(key, (remainder(F.col(key)) == HELD_OUT).alias("held_out"), "_text")
    weights = model.weights.astype(np.float32)
    curve = (model.bias, model.slope, model.shift)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = Features(), Model(weights.astype(np.float64), *curve)
        for batch in sliced(batches, 2):
            scores = np.array([fitted.score(found) for found in features.of(batch.column(2))])
            columns = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= GOOD_FROM).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [key, "held_out", "score", "predicted"])

    kind = held.schema[key].dataType.simpleString()
    return held.mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be good, with all their columns, whatever these are called.

    A NULL text is judged as an empty one; rows that repeat are judged alike and all stay or go.
    """
    bounded(docs.sparkSession)
    names, numbered = docs.columns, docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    place = names.index(text)
    weights, curve = model.weights.astype(np.float32), (model.bias, model.slope, model.shift)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = Features(), Model(weights.astype(np.float64), *curve)
        for batch in sliced(batches, place):
            good = [fitted.score(found) >= GOOD_FROM for found in features.of(batch.column(place))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return numbered.mapInArrow(run, numbered.schema).toDF(*names)

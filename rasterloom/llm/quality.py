"""Quality rules: base measures and a hashed n-gram logistic regression.

The model sees two blocks of relative frequencies, of word 1- and 2-grams and of character (code
point) 3- and 4-grams, hashed into 2^bits columns each. It is trained by full-batch Adam on at most
``sample`` labelled rows (the least by a hash of doc_id, a documented bound), with a quarter of them
held out for Platt calibration, in one task: only the weights reach the driver. It is scored in
Arrow batches: a document's logit is the mean of its grams' weights, so no sparse vector is built
and memory follows the chunk of texts.

A document is kept when the base rules pass and the calibrated probability reaches the fixed
threshold. Null or empty texts have zero measures and fail the base rules. Without labels of both
kinds the model is the smoothed share of good labels. Of labels that repeat for one doc_id the
greater holds; rows that repeat are rows of the sample each; ties of the hash go to the lesser
doc_id; a null doc_id has no label. An empty table gives no rows. A text over 1 MB is a chunk of its
own and read whole. score() returns its own columns only; keep_good() returns those of docs, whatever
their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches
from .words import Words, hash_ranges, mix64, word_chunks

SAMPLE, BITS, THRESHOLD = 2000, 16, 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def base_measures(words: Words) -> dict[str, np.ndarray]:
    """The base columns of each row."""
    n, data, offsets = len(words.offsets) - 1, words.data, words.offsets
    out = {"n_words": np.bincount(words.row, minlength=n).astype(np.int64)}

    def summed(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out["word_chars"] = summed(inside & ((data & 0xC0) != 0x80))
    out["n_symbols"] = summed(symbol[data])

    # Lines with a word: from one break or row start to the next.
    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    starts = starts[starts < len(data)]
    bound = np.append(starts[1:], len(data))
    ends = bound - ((bound > starts) & (data[bound - 1] == 10)) if len(starts) else bound
    row = np.searchsorted(offsets, starts, side="right") - 1
    wordy = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[wordy], ends[wordy], row[wordy]
    key = hash_ranges(data, starts, ends) ^ mix64(row.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)

    h, mul = words.hash, np.uint64(0xA0761D6478BD642F)
    if len(h) >= 3:
        whole = words.row[2:] == words.row[:-2]
        key = mix64((h[:-2] * mul + h[1:-1]) * mul + h[2:]) ^ mix64(words.row[2:].astype(np.uint64) + np.uint64(1))
        at = np.flatnonzero(whole)
        order = at[np.argsort(key[at], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[order[again] + k] = True
        out["n_repeat_words"] = np.bincount(words.row[covered], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return {k: v.astype(np.int64) for k, v in out.items()}


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of rows of UTF-8, and the row of each; what is no UTF-8 becomes U+FFFD."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
        size = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets])
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        points, size = np.frombuffer("".join(rows).encode("utf-32-le"), "<u4"), np.array([len(r) for r in rows], np.int64)
    return points, np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), size)


def grams(words: Words, bits: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """For word grams, then for character grams: (columns, rows) parts; character columns follow the word columns."""
    shift, size = np.uint64(64 - bits), np.int64(1 << bits)
    h, mul = words.hash, np.uint64(0xA0761D6478BD642F)
    pair = words.row[1:] == words.row[:-1]
    two = mix64(h[:-1] * mul + h[1:])[pair]
    yield [((h >> shift).astype(np.int64), words.row), ((two >> shift).astype(np.int64), words.row[1:][pair])]
    points, rows = code_points(words.data, words.offsets)
    points, parts = points.astype(np.uint64), []
    for k, odd in ((3, 0x9E3779B97F4A7C15), (4, 0xC2B2AE3D27D4EB4F)):
        m = len(points) - k + 1
        if m <= 0:
            continue
        # Code points have 21 bits: three fit a key, the fourth is mixed in.
        key = points[:m] << np.uint64(42) | points[1 : m + 1] << np.uint64(21) | points[2 : m + 2]
        if k == 4:
            key = (key ^ points[3:] * mul) + np.uint64(1)
        whole = rows[k - 1 :] == rows[:m]
        key = key[whole] * np.uint64(odd)
        parts.append(((key >> shift).astype(np.int64) + size, rows[:m][whole]))
    yield parts


@dataclass
class QualityModel:
    """Weights, bias and calibration; probability is sigmoid(slope * logit + offset)."""

    bits: int
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def logits(self, words: Words) -> np.ndarray:
        n = len(words.offsets) - 1
        z = np.full(n, self.bias)
        for parts in grams(words, self.bits):
            total, times = np.zeros(n), np.zeros(n)
            for columns, rows in parts:
                total += np.bincount(rows, weights=self.weights[columns], minlength=n)
                times += np.bincount(rows, minlength=n)
            z += total / np.maximum(1, times)
        return z

    def probability(self, words: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(words) + self.offset, -40, 40)))


def _sparse_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop, words in word_chunks(batch.column(2), False):
                keys, shares = [], []
                for parts in grams(words, bits):
                    columns, rows = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
                    key, count = np.unique((rows.astype(np.int64) << 32) | columns, return_counts=True)
                    keys.append(key)
                    shares.append(count / np.maximum(1, np.bincount(rows, minlength=stop - at))[key >> 32])
                key, share = np.concatenate(keys), np.concatenate(shares)
                order = np.argsort(key, kind="stable")
                key, share = key[order], share[order].astype(np.float32)
                cut = np.searchsorted(key, np.arange(stop - at + 1) << 32)
                out = [((key[i:j] & 0xFFFFFFFF).astype(np.int32).tobytes(), share[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), batch.column(1).slice(at, stop - at), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], ["doc_id", "label", "columns", "shares"])

    return run


def fit(columns: list[np.ndarray], shares: list[np.ndarray], label: np.ndarray, bits: int, steps: int = 80) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by Adam, with a small L2 penalty."""
    size = np.array([len(c) for c in columns])
    column, share = np.concatenate(columns), np.concatenate(shares).astype(np.float64)
    row = np.repeat(np.arange(len(columns)), size)
    w, b = np.zeros(2 << bits), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[column] * share, minlength=len(label)) + b
        error = (1 / (1 + np.exp(-z)) - label) / len(label)
        g = np.bincount(column, weights=error[row] * share, minlength=len(w)) + 1e-7 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = 0.5 * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
        w -= scale * m / (np.sqrt(v) + 1e-12)
        b -= 0.2 * scale * mb / (vb**0.5 + 1e-12)
    return w, b


def platt(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated probability, by Newton steps on smoothed targets."""
    good, bad = label.sum(), (1 - label).sum()
    aim = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ x, -40, 40)))
        g = x @ (p - aim) + 1e-3 * (a - [1.0, 0.0])
        h = (x * np.maximum(p * (1 - p), 1e-9)) @ x.T + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a = a - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def fit_model(columns: list[np.ndarray], shares: list[np.ndarray], label: np.ndarray, bits: int) -> QualityModel:
    """Fit on three quarters of the rows, calibrate on every fourth."""
    if len(label) < 8 or label.min() == label.max():
        share = (label.sum() + 1) / (len(label) + 2)
        return QualityModel(bits, np.zeros(2 << bits), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = np.arange(len(label)) % 4 == 3
    pick = lambda x, keep: [a for a, k in zip(x, keep, strict=True) if k]
    w, b = fit(pick(columns, ~held), pick(shares, ~held), label[~held], bits)
    z = np.array([w[c] @ s + b for c, s in zip(pick(columns, held), pick(shares, held), strict=True)])
    return QualityModel(bits, w, float(b), *platt(z, label[held]))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> QualityModel:
    """Fit on at most `sample` labelled rows of docs(doc_id, text) and labels(doc_id, quality)."""
    told = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label"))
    # `sample` rows at most.
    chosen = F.broadcast(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = bounded_batches(docs).select("doc_id", "text").join(chosen, "doc_id").select("doc_id", F.col("label").cast("long"), "text").where("text is not null")
    sparse = rows.mapInArrow(_sparse_rows(bits), "doc_id long, label long, columns binary, shares binary").orderBy(F.xxhash64("doc_id"), "doc_id", "columns").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, shares, label = [], [], []
        for batch in batches:
            label += batch.column(1).to_pylist()
            columns += [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            shares += [np.frombuffer(x, np.float32) for x in batch.column(3).to_pylist()]
        m = fit_model(columns, shares, np.array(label, np.float64), bits)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in (m.bias, m.slope, m.offset))], ["weights", "bias", "slope", "offset"])

    r = sparse.coalesce(1).mapInArrow(run, "weights binary, bias double, slope double, offset double").first()
    if r is None:
        return fit_model([], [], np.zeros(0), bits)
    return QualityModel(bits, np.frombuffer(r.weights), r.bias, r.slope, r.offset)


def judge(words: Words, model: QualityModel, threshold: float) -> dict[str, np.ndarray]:
    out: dict = base_measures(words)
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["probability"] = model.probability(words)
    out["kept"] = ~out["base_failed"] & (out["probability"] >= threshold)
    return out


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the measures, base_failed, kept and probability of each row of docs(doc_id, text)."""
    # Fields, not the object: executors need not have this package.
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    names = [*MEASURES, "base_failed", "kept", "probability"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = QualityModel(**sent.value)
        for batch in batches:
            for at, stop, words in word_chunks(batch.column(1), False):
                found = judge(words, model, threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), *(pa.array(found[x]) for x in names)], ["doc_id", *names])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that pass, with all their columns."""
    # Fields, not the object: executors need not have this package.
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = QualityModel(**sent.value)
        for batch in batches:
            keep = [judge(words, model, threshold)["kept"] for _, _, words in word_chunks(batch.column(text), False)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return bounded_batches(docs).mapInArrow(run, docs.schema)

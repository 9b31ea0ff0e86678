"""Quality scores by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of label 1, at most ``sample`` of them; the unlabelled
ones are all texts outside the held fold. The class prior is the least ratio, over
thresholds of a first positive-against-unlabelled model, of the shares of unlabelled and
positive rows above it. The final linear model minimises
prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]), and two numbers map
its output to the share of label 1 among labelled rows it may learn from.

A sample of texts only says where to start: feature means, the shares that give the prior
and the risk and gradient of the last PASSES steps are sums over all unlabelled texts,
taken by passes over a stored table of features, of which a few hundred numbers reach the
driver.

Features are frequencies, so that texts of any length compare: character classes, word
forms, repetition and hashed word endings. All texts are scored whole. Null and empty texts have no words, and
their features are zeros; repeated rows are scored alike; without rows of both kinds to
learn from the score is 0.5 for all; an empty table has no scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import save
from .text import Words, mix, slices

#: Labelled rows of each label to learn from, and unlabelled ones to start from, at most.
SAMPLE = 4000
#: Bytes of features that a worker holds as numbers at once.
MATRIX_BYTES = 1 << 20
#: Steps over all unlabelled texts.
PASSES = 6
THRESHOLD = 0.3
ENDINGS = 192
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:?!'\"-()"]] = True
_SIGN = ~(_LETTER | _DIGIT | _STOP)
_SIGN[:33] = False
#: Letters, capitals and digits as a, A and 0.
_FORM = np.arange(256, dtype=np.uint8)
_FORM[[*range(97, 123), *range(128, 256)]] = 97
_FORM[65:91] = 65
_FORM[48:58] = 48
N_FEATURES = 12 + ENDINGS


def fold(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def features(texts: pa.Array) -> np.ndarray:
    w = Words(texts)
    n, counts = len(w.at) - 1, w.counts
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(w):
        return out
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.at])
    per_word = lambda flags, bounds: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
    body = w.raw[: int(w.at[-1])]
    chars, words = np.maximum(np.diff(w.at), 1), np.maximum(counts, 1)
    for k, kind in enumerate((_UPPER, _LETTER, _DIGIT, _STOP, _SIGN)):
        out[:, k] = per_text(kind[body]) / chars
    size = w.end - w.start
    upper = np.concatenate([[0], np.cumsum(_UPPER[body])])
    letter = np.concatenate([[0], np.cumsum(_LETTER[body])])
    signs = np.concatenate([[0], np.cumsum(_SIGN[body])])
    capital, letters = upper[w.end] - upper[w.start], letter[w.end] - letter[w.start]
    h = w.hashes()
    doc = w.doc()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, 5] = per_word((capital > 1) & (capital == letters), w.first) / words
    out[:, 6] = per_word(signs[w.end] > signs[w.start], w.first) / words
    out[:, 7] = per_word(again, w.first) / words
    out[:, 8] = per_word(letters == 0, w.first) / words
    out[:, 9] = np.log1p(per_word(size, w.first) / words)
    distinct = np.unique(mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    out[:, 10] = np.bincount(doc[distinct], minlength=n) / words
    out[:, 11] = out[:, 10] * np.sqrt(words) / 10
    eight = np.ndarray((len(w.raw) - 7,), "<u8", _FORM[w.raw], strides=(1,))
    keep = np.minimum(size, 3)
    ending = eight[w.end - keep] & ((np.uint64(1) << (np.uint64(8) * keep.astype(np.uint64))) - np.uint64(1))
    cell = doc * ENDINGS + (mix(ending) % np.uint64(ENDINGS)).astype(np.int64)
    out[:, 12:] = np.bincount(cell, minlength=n * ENDINGS).reshape(n, ENDINGS) / words[:, None]
    return np.sqrt(out)


def feature_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns and ``x``, the features as bytes of 32-bit floats."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.tobytes() for x in features(batch.columns[-1])], pa.binary())], [*keep, "x"])

    return docs.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{kinds}, x binary")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def output(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.output(x) + self.shift)


def _descend(gradient, n: int, steps: int, rate: float) -> np.ndarray:
    """Adam over a vector that starts at zero."""
    v, m, s = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(1, steps + 1):
        g = gradient(v, k)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        v = v - rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return v


def class_prior(positive: np.ndarray, shares, least: float = 0.2) -> float:
    """The least ratio of shares above a threshold that ``least`` of the positives pass; shares(cuts): those of the unlabelled."""
    cuts = np.quantile(positive, np.linspace(0.0, 1 - least, 60))
    p = (positive[None] >= cuts[:, None]).mean(1)
    return float(np.clip((shares(cuts) / p).min(), 0.05, 0.98))


def _output(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return x @ v[:-1] + v[-1]


def negative_sums(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of rows taken as negative: gradient of the loss, summed, and the loss itself."""
    z = _output(u, v)
    s = _sigmoid(z)
    return np.concatenate([u.T @ s, [s.sum(), np.logaddexp(0, z).sum()]])


def risk(v: np.ndarray, p: np.ndarray, negative: np.ndarray, prior: float, decay: float) -> tuple[float, np.ndarray]:
    """The non-negative risk and its gradient; negative: means of negative_sums over the unlabelled rows."""
    z, n = _output(p, v), len(p)
    s = _sigmoid(z)
    gain = np.append(p.T @ (s - 1), (s - 1).sum()) * (prior / n)
    rest = negative[-1] - prior * np.logaddexp(0, z).mean()
    of_rest = negative[:-1] - np.append(p.T @ s, s.sum()) * (prior / n)
    value = prior * np.logaddexp(0, -z).mean() + max(0.0, rest) + decay / 2 * (v[:-1] ** 2).sum()
    # below 0 the step is back up, so that the estimate of the negative part does not overfit
    g = gain + of_rest if rest >= 0 else -of_rest
    g[:-1] += decay * v[:-1]
    return float(value), g


def train(positive: np.ndarray, sample: np.ndarray, prior: float | None = None, over=None, decay: float = 1e-3, steps: int = 400, passes: int = PASSES, seed: int = 7) -> tuple[Model, float]:
    """The model, and the prior that was given or estimated.

    over(f): the sum of f(rows) over all unlabelled rows; by default these are the sample.
    """
    over = over or (lambda f: f(sample))
    d = positive.shape[1]
    total = over(lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    n, mean = total[0], total[1 : d + 1] / total[0]
    scale = 1 / np.maximum(np.sqrt(np.maximum(total[d + 1 :] / n - mean * mean, 0.0)), 0.02)
    p, u = (positive - mean) * scale, (sample - mean) * scale

    def contrast(v, _):
        a, b = _sigmoid(_output(p, v)) - 1, _sigmoid(_output(u, v))
        g = np.append(p.T @ a / len(p) + u.T @ b / len(u), a.mean() + b.mean())
        g[:d] += decay * v[:d]
        return g

    if prior is None:
        v = _descend(contrast, d + 1, 150, 0.05)
        above = lambda cuts: over(lambda x: (_output((x - mean) * scale, v)[None] >= cuts[:, None]).sum(1)) / n
        prior = class_prior(_output(p, v), above)
    rng = np.random.default_rng(seed)

    def sampled(v, _):
        i, j = rng.integers(0, len(p), 1024), rng.integers(0, len(u), 1024)
        return risk(v, p[i], negative_sums(u[j], v) / 1024, prior, decay)[1]

    v = _descend(sampled, d + 1, steps, 0.02)
    # steps over all rows, as long as a step's last two gradients say; the best one seen stays
    best, before, rate = None, None, 4.0 / (d + 1)
    for _ in range(passes):
        value, g = risk(v, p, over(lambda x, v=v: negative_sums((x - mean) * scale, v)) / n, prior, decay)
        if best is None or value < best[0]:
            best = value, v
        if before is not None:
            moved, turned = v - before[0], g - before[1]
            rate = float(np.clip(moved @ moved / (moved @ turned), 1e-3, 2.0)) if moved @ turned > 0 else rate
        before = v, g
        v = v - rate * g
    v = v if best is None else best[1]
    return Model(mean, scale, v[:d], float(v[d])), prior


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    if len(set(y.tolist())) == 2:
        z = model.output(x)
        size = max(z.std(), 1e-6)
        target = np.where(y == 1, 1 - 1 / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
        design, v = np.stack([z / size, np.ones(len(z))], 1), np.array([1.0, 0.0])
        for _ in range(100):  # Newton with halved steps
            p = _sigmoid(design @ v)
            g = design.T @ (p - target) + 1e-3 * v
            h = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            v = v - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        model.slope, model.shift = v[0] / size, v[1]
    return model


def chosen(labels: DataFrame, label: str, n: int, folds: int, held: int) -> DataFrame:
    """doc_id, y of at most n rows of each label, by hash, out of the folds to learn from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(n) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def _matrix(x: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and features of all rows, stored: they are read once for each pass."""
    return save(feature_rows(docs, "doc_id"), "features")


def _sums(rows: DataFrame, f) -> np.ndarray:
    """The sum of f(features) over rows of x: partial sums per task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches, "x", MATRIX_BYTES):
            found = np.asarray(f(_matrix(batch.column(0))), np.float64)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    found = rows.select("x").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow().sort_by("k")
    return found["v"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> tuple[Model | None, float]:
    """Learns from at most ``sample`` rows of each label and all unlabelled texts outside the held fold.

    docs: doc_id and text, or a feature_table of them.
    """
    table = docs if "x" in docs.columns and "text" not in docs.columns else feature_table(docs)
    rows = table.join(F.broadcast(chosen(labels, label, sample, folds, held)), "doc_id").toArrow().sort_by("doc_id")  # 2 n rows of two numbers
    free = table.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    start = free.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(sample).distinct()
    start = table.join(F.broadcast(start), "doc_id").toArrow().sort_by("doc_id")
    x, y, u = _matrix(rows["x"]), np.array(rows["y"].to_pylist(), int), _matrix(start["x"])
    if not (y == 1).any() or not len(u):
        return None, 0.5
    model, prior = train(x[y == 1], u, over=lambda f: _sums(free, f))
    # rows of each label stand for as many as the prior says
    keep = np.flatnonzero((y == 0) | (np.arange(len(y)) % max(1, round((y == 1).sum() * (1 - prior) / max(1, (y == 0).sum() * prior))) == 0))
    return calibrate(model, x[keep], y[keep]), prior


def score(docs: DataFrame, model: Model | None, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted. docs: doc_id and text, or a feature_table of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = docs if "x" in docs.columns and "text" not in docs.columns else feature_rows(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", MATRIX_BYTES):
            s = model.score(_matrix(batch.column(1))) if model is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = table.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least the threshold, with all their columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = model.score(features(batch["text"]).astype(np.float64)) if model is not None else np.ones(batch.num_rows)
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema).select(*names)

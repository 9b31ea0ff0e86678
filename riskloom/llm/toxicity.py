"""Toxic spans by a linear-chain conditional random field over words.

Labels say only whether a document is toxic, so words to learn from are labelled first: a
word of a toxic document counts as toxic where it, or its first 4 to 7 bytes, occurs in
far more toxic documents than others, by a likelihood ratio that chance does not reach. The field then learns from hashed
features of each word (itself, first and last bytes) and from transitions. Chains are
sentences, cut after CHAIN words. Forward and backward sums give each word's probability;
a document's score is a logistic function of the largest and of the sums of the high and
of the low ones over its different words, fitted
on the documents to learn from, and words of at least 0.5 give the spans.

Samples to learn from are bounded by ``sample`` documents and ``most_bytes`` of text of each
label, and so is what the driver holds; all texts are scored whole. Null and empty texts have no words; repeated rows are scored alike; without
documents of both labels the score is 0 for all; an empty table has no scores; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .quality import THRESHOLD, _descend, _sigmoid, chosen, fold
from .text import LOWER, Words, mix, slices

SAMPLE = 1800
#: Bytes of text of each label at most, so that long documents do not fill the driver.
SAMPLE_BYTES = 5 << 20
CHAIN = 32
LOG_CELLS = 18
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_HALT = np.zeros(256, bool)
_HALT[[*b".!?"]] = True
#: (first or last bytes, how many; 0: all)
_VIEWS = ((0, 0), (0, 3), (0, 4), (0, 5), (0, 6), (0, 7), (1, 3))
#: Views by which words of toxic documents are labelled.
_STEMS = (0, 2, 3, 4, 5)


class Tokens:
    """Words in lower case without outer punctuation, with hashed features and chains."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        self.first, self.raw, self.at = words.first, words.raw, words.at
        start, end = words.start.copy(), words.end.copy()
        halt = _HALT[words.raw[end - 1]] | (words.raw[np.minimum(end, len(words.raw) - 1)] == 10) if len(end) else np.empty(0, bool)
        while len(more := np.flatnonzero((end - start > 1) & _PUNCTUATION[words.raw[end - 1]])):
            end[more] -= 1
        while len(more := np.flatnonzero((end - start > 1) & _PUNCTUATION[words.raw[start]])):
            start[more] += 1
        self.start, self.end, self.doc = start, end, words.doc()
        words.raw = LOWER[words.raw]
        views = []
        for k, (last, most) in enumerate(_VIEWS):
            words.start, words.end = (np.maximum(start, end - most), end) if last else (start, end)
            views.append(mix(words.hashes(most or None) ^ np.uint64(k << 56)))
        self.views = np.array(views)
        n = len(start)
        begin = np.zeros(n, bool)
        if n:
            begin[1:] = halt[:-1]
            begin[self.first[:-1][self.first[:-1] < n]] = True
            at = np.flatnonzero(begin)
            place = np.arange(n) - np.repeat(at, np.diff(at, append=n))
            begin |= place % CHAIN == 0
        self.chain = np.flatnonzero(begin)
        self.length = np.diff(self.chain, append=n)

    def cells(self) -> np.ndarray:
        return (self.views & np.uint64((1 << LOG_CELLS) - 1)).astype(np.int32)


def marginals(emission: np.ndarray, chain: np.ndarray, length: np.ndarray, move: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of label 1 for each word, expected moves (2, 2) and expected first labels."""
    p = np.zeros(len(emission))
    moves, firsts = np.zeros((2, 2)), 0.0
    if not len(emission):
        return p, moves, np.zeros(1)
    order = np.argsort(-length, kind="stable")
    chain, length = chain[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    t = np.exp(move)
    odds = np.exp(np.clip(emission, -30, 30))
    forward = []  # share of label 1 at each place
    for k, n in enumerate(active):
        e = odds[chain[:n] + k]
        if k:
            a = forward[-1][:n]
            one, zero = e * ((1 - a) * t[0, 1] + a * t[1, 1]), (1 - a) * t[0, 0] + a * t[1, 0]
        else:
            one, zero = e * np.exp(start), np.ones(n)
        forward.append(one / (one + zero))
    back = np.full(len(chain), 0.5)  # share of label 1 in the sum over what follows
    for k in range(len(active) - 1, -1, -1):
        n = active[k]
        a, b = forward[k], back[:n]
        one = a * b
        p[chain[:n] + k] = one / np.maximum(one + (1 - a) * (1 - b), 1e-300)
        if k:
            e = odds[chain[:n] + k]
            before = forward[k - 1][:n]
            w = [[(1 - before) * t[0, 0] * (1 - b), (1 - before) * t[0, 1] * e * b], [before * t[1, 0] * (1 - b), before * t[1, 1] * e * b]]
            total = np.maximum(w[0][0] + w[0][1] + w[1][0] + w[1][1], 1e-300)
            moves += [[float((x / total).sum()) for x in row] for row in w]
            one, zero = t[1, 1] * e * b + t[1, 0] * (1 - b), t[0, 1] * e * b + t[0, 0] * (1 - b)
            back[:n] = one / (one + zero)
        else:
            firsts = float(p[chain[:n]].sum())
    return p, moves, np.array([firsts])


@dataclass
class Field:
    weight: np.ndarray
    move: np.ndarray
    start: float
    document: np.ndarray | None = None

    def probabilities(self, tokens: Tokens) -> np.ndarray:
        emission = self.weight[tokens.cells()].sum(0) if len(tokens.start) else np.empty(0)
        return marginals(emission, tokens.chain, tokens.length, self.move, self.start)[0]


def _of_documents(p: np.ndarray, tokens: Tokens) -> np.ndarray:
    """Largest and summed probabilities of each document's different words, on scales a line fits."""
    first = tokens.first
    n = len(first) - 1
    most = np.zeros(n)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        most[full] = np.maximum.reduceat(p, first[full])
    most = np.clip(most, 1e-4, 1 - 1e-4)
    some = np.flatnonzero(p > 0.02)
    word = mix(tokens.views[0][some] ^ mix(tokens.doc[some].astype(np.uint64)))
    some = some[np.unique(word, return_index=True)[1]]
    high = p[some] > 0.5
    sums = [np.bincount(tokens.doc[some[k]], p[some[k]], n) for k in (high, ~high)]
    return np.stack([np.log(most / (1 - most)) / 4, *map(np.log1p, sums), np.ones(n)], 1)


def silver(tokens: Tokens, toxic: np.ndarray, least: float = 30.0, ratio: float = 4.0) -> np.ndarray:
    """Words of toxic documents that stand out by themselves or by their first bytes."""
    label = np.zeros(len(tokens.start), bool)
    share = toxic.mean()
    for view in _STEMS:
        keys, of = np.unique(tokens.views[view], return_inverse=True)
        pair = np.unique(of.astype(np.int64) * len(toxic) + tokens.doc)
        unit, doc = pair // len(toxic), pair % len(toxic)
        both = np.bincount(unit, minlength=len(keys)).astype(float)
        bad = np.bincount(unit[toxic[doc]], minlength=len(keys)).astype(float)
        good = both - bad
        part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / (both * q)), 0.0)
        g2 = 2 * (part(bad, share) + part(good, 1 - share))
        label |= ((g2 >= least) & (bad / share >= ratio * (good + 0.5) / (1 - share)))[of]
    return label & toxic[tokens.doc]


def train(texts: pa.Array, toxic: np.ndarray, steps: int = 60, decay: float = 1e-6) -> Field:
    tokens = Tokens(texts)
    label = silver(tokens, toxic).astype(np.float64)
    cells = tokens.cells()
    # chains with labelled words and a fifth of the others
    holds = np.add.reduceat(label, tokens.chain) > 0
    used = np.flatnonzero(holds | (np.arange(len(tokens.chain)) % 5 == 0))
    chain, length = tokens.chain[used], tokens.length[used]
    place = np.repeat(chain - (np.cumsum(length) - length), length) + np.arange(length.sum())
    cells, y = cells[:, place], label[place]
    new = np.cumsum(length) - length
    inner = np.ones(len(y), bool)
    inner[new] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1.0)
    size = 1 << LOG_CELLS
    target = np.bincount(cells.ravel(), np.tile(y, len(cells)), size)
    first, n = y[new].sum(), len(y)

    def gradient(v, _):
        p, moves, firsts = marginals(v[:size][cells].sum(0), new, length, v[size : size + 4].reshape(2, 2), v[-1])
        g = np.bincount(cells.ravel(), np.tile(p, len(cells)), size) - target
        return np.concatenate([g + decay * n * v[:size], (moves - seen).ravel() + 1e-3 * v[size : size + 4], firsts - first + 1e-3 * v[-1:]]) / n * 100

    v = _descend(gradient, size + 5, steps, 0.15)
    field = Field(v[:size].astype(np.float32), v[size : size + 4].reshape(2, 2), float(v[-1]))
    x = _of_documents(field.probabilities(tokens), tokens)
    y = toxic.astype(np.float64)

    def logistic(v, _):
        return x.T @ (_sigmoid(x @ v) - y) / len(y) + 1e-4 * v

    field.document = _descend(logistic, 4, 2000, 0.05)
    return field


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Field | None:
    """Learns from at most ``sample`` documents and ``most_bytes`` of text of each label outside the held fold.

    Documents are taken in order of a hash until either is reached; sizes come to the driver first.
    """
    known = chosen(labels, label, sample, folds, held)
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    about = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("b")).join(F.broadcast(known), "doc_id")  # 2 n rows of two numbers
    about = about.groupBy("doc_id", "y").agg(F.sum("b").cast("long").alias("b")).withColumn("h", F.xxhash64("doc_id", F.lit(1))).toArrow()
    ids, y, b, h = (about[c].to_numpy() for c in ("doc_id", "y", "b", "h"))
    order = np.lexsort((ids, h))
    taken = [(int(ids[k]), int(y[k])) for v in (0, 1) for mine in [order[y[order] == v]] for k in mine[(np.cumsum(b[mine]) <= most_bytes) | (np.arange(len(mine)) == 0)]]
    if len({v for _, v in taken}) < 2:
        return None
    picked = docs.sparkSession.createDataFrame(taken, "doc_id long, y int")
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text").toArrow().sort_by("doc_id")
    return train(rows["text"].combine_chunks(), rows["y"].to_numpy() == 1)


def score(docs: DataFrame, field: Field | None, folds: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = np.zeros(batch.num_rows)
            if field is not None:
                tokens = Tokens(batch.column(1))
                s = _sigmoid(_of_documents(field.probabilities(tokens), tokens) @ field.document)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def spans(docs: DataFrame, field: Field, least: float = 0.5) -> DataFrame:
    """doc_id, begin, end (code points), probability of each run of toxic words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens = Tokens(batch.column(1))
            p = field.probabilities(tokens)
            hit = np.flatnonzero(p >= least)
            begins = np.flatnonzero((np.diff(hit, prepend=-9) > 1) | (np.diff(tokens.doc[hit], prepend=-1) != 0))
            ends = np.append(begins[1:], len(hit)) - 1
            points = np.concatenate([[0], np.cumsum((tokens.raw & 0xC0) != 0x80)])
            a, b = hit[begins], hit[ends] if len(hit) else hit
            zero = points[tokens.at[tokens.doc[a]]]
            best = np.maximum.reduceat(p[hit], begins) if len(hit) else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(tokens.doc[a])), pa.array(points[tokens.start[a]] - zero, pa.int64()), pa.array(points[tokens.end[b]] - zero, pa.int64()), pa.array(best, pa.float64())],
                ["doc_id", "begin", "end", "probability"],
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, begin long, end long, probability double")

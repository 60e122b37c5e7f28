"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled documents of quality 1, the unlabelled web text is any documents. With the class prior
p, the risk of a score s is p * E+[l(s)] + max(0, E_u[l(-s)] - p * E+[l(-s)]) with the logistic loss l; where the
second term turns negative the step goes against it, as in the non-negative estimator. The prior is estimated from the
positives and the unlabelled rows alone: a first classifier of positives against unlabelled scores both, and the median
over groups of like score of the density ratio of unlabelled to positive rows is the share of positives.

The text's features are shares of byte classes, word shape and repetition figures over the whole text; ids, sources and
languages are not among them. The model is a logistic one over the features and their squares, fitted on at most
`SAMPLE` positives and as many unlabelled rows, those with the smallest md5 of their id: a bound on fitting alone,
every document is scored.

Defined cases: null and empty texts have the features of an empty text and are scored like any other; labels of null
count as none; without positives every score is 0.5; other columns pass through, but for one
with the result's name, which the result replaces; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import clear_of
from .words import slices, utf8

SAMPLE = 20_000
STEPS = 600
RATE = 0.05
GROUPS = 20

_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _LINE = range(7)


def _byte_classes() -> np.ndarray:
    """(256, 7) shares of a byte's classes."""
    table = np.zeros((256, 7))
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or "a" <= c <= "z":
            table[b, _LETTER] = 1
        elif "A" <= c <= "Z":
            table[b, _LETTER] = table[b, _UPPER] = 1
        elif "0" <= c <= "9":
            table[b, _DIGIT] = 1
        elif c in " \t\r\n":
            table[b, _SPACE] = 1
            table[b, _LINE] = c == "\n"
        elif c in ".,;:'\"?-()":
            table[b, _STOP] = 1
        else:
            table[b, _MARK] = 1
    return table


_CLASSES = _byte_classes()
FEATURES = (
    "upper", "digits", "spaces", "stops", "marks", "marks_per_word", "lines", "word_length", "distinct", "repeats",
    "top_word", "marked_words", "upper_words", "log_words",
)


def features(text: bytes | None) -> list[float]:
    """Figures of one whole text, each between 0 and about 1."""
    text = text or b""
    size = max(len(text), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letter, upper, digit, space, stop, mark, line = counts @ _CLASSES
    found = text.split()
    n = max(len(found), 1)
    seen: dict[bytes, int] = {}
    for word in found:
        seen[word] = seen.get(word, 0) + 1
    repeats = sum(map(bytes.__eq__, found, found[1:]))
    marked = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 0x80 and w[-1] not in b".,;:'\"?-()")
    uppers = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    return [
        upper / max(letter, 1),
        digit / size,
        space / size,
        stop / size,
        mark / size,
        min(mark / n, 3.0) / 3,
        min(line / n, 1.0),
        min((size - space) / n, 20.0) / 20,
        # distinct words against what a text of this length has, which falls with the logarithm
        min(len(seen) / n**0.8, 1.0),
        repeats / n,
        max(seen.values(), default=0) / n,
        marked / n,
        uppers / n,
        np.log1p(len(found)) / 12,
    ]


def _feature_rows(docs: DataFrame, text: str, result: str) -> DataFrame:
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(result, T.ArrayType(T.DoubleType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = pa.array([list(map(float, features(t))) for t in utf8(batch.column(place))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, result])

    return docs.mapInArrow(scan, schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return _basis(x, self.mean, self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _basis(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([z, z * z / 8])


class _Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, groups: int = GROUPS) -> float:
    """Share of positives among the unlabelled rows, from the scores of a positive-against-unlabelled classifier.

    Groups are quantiles of the positives' scores. In a group without negatives the unlabelled rows' share is the prior
    times the positives' share. Negatives crowd into the groups of low scores, so the median ratio is free of them.
    """
    edges = np.unique(np.quantile(positive, np.linspace(0, 1, groups + 1)[1:-1]))
    held = np.bincount(np.searchsorted(edges, positive, side="right"), minlength=len(edges) + 1)
    found = np.bincount(np.searchsorted(edges, unlabelled, side="right"), minlength=len(edges) + 1)
    ratio = (found / len(unlabelled))[held > 0] / (held / len(positive))[held > 0]
    return float(np.clip(np.median(ratio), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, steps: int = STEPS, rate: float = RATE) -> Model:
    """Minimises the non-negative risk over all given rows at once; the result depends on them alone."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = _basis(positive, mean, scale), _basis(unlabelled, mean, scale)
    width = p.shape[1]

    def descend(gradient_of) -> tuple[np.ndarray, float]:
        theta, adam = np.zeros(width + 1), _Adam(width + 1, rate)
        for _ in range(steps):
            gradient = gradient_of(theta[:-1], theta[-1])
            gradient[:-1] += 1e-3 * theta[:-1]
            theta = theta - adam.step(gradient)
        return theta[:-1], float(theta[-1])

    def mean_gradient(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(x.T @ slope, slope.sum()) / len(x)

    def plain(w: np.ndarray, b: float) -> np.ndarray:  # positives against unlabelled
        return mean_gradient(p, _sigmoid(p @ w + b) - 1) + mean_gradient(u, _sigmoid(u @ w + b))

    first_w, first_b = descend(plain)
    prior = estimate_prior(p @ first_w + first_b, u @ first_w + first_b)

    def non_negative(w: np.ndarray, b: float) -> np.ndarray:
        zp, zu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = mean_gradient(u, _sigmoid(zu)) - prior * mean_gradient(p, _sigmoid(zp))
        if negative < 0:
            return -of_negative
        return prior * mean_gradient(p, _sigmoid(zp) - 1) + of_negative

    w, b = descend(non_negative)
    return Model(mean, scale, w, b, prior)


def _sampled(rows: DataFrame, ids: DataFrame, doc_id: str, text: str, sample: int) -> np.ndarray:
    """Features of the rows of the `sample` ids with the smallest md5.

    Only ids are sorted and joined; the picked ones, no more than `sample`, are broadcast, so texts are not shuffled.
    """
    order = F.md5(F.col(doc_id).cast("string"))
    picked = ids.where(F.col(doc_id).isNotNull()).select(doc_id).orderBy(order, doc_id).limit(sample)
    mine = rows.join(F.broadcast(picked), doc_id, "left_semi").select(text)
    kept = _feature_rows(mine, text, "__f").select("__f").collect()
    return np.array(sorted(r["__f"] for r in kept), float).reshape(-1, len(FEATURES))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    usable: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
) -> Model | None:
    """Fits on documents that are `usable` (default all); None without positives."""
    rows = docs.select(F.col(doc_id), F.col(text))
    if usable is not None:
        rows = rows.where(usable)
    ids = rows.select(doc_id).distinct()
    good = labels.where(F.col(label) == 1).select(F.col(doc_id)).distinct()
    positive = _sampled(rows, ids.join(good, doc_id, "left_semi"), doc_id, text, sample)
    if not len(positive):
        return None
    return fit(positive, _sampled(rows, ids, doc_id, text, sample))


def score(docs: DataFrame, model: Model | None, *, text: str = "text", result: str = "score") -> DataFrame:
    """Adds `result` (0 to 1) to every document."""
    docs = clear_of(docs, result)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(result, T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if model is None or not batch.num_rows:
                values = np.full(batch.num_rows, 0.5)
            else:
                values = model.score(np.array([features(t) for t in utf8(batch.column(place))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, result])

    return docs.mapInArrow(scan, schema)

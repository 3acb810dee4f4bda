"""Toxicity severity by cumulative-link ordinal regression.

Grades are ordered (0 clean, 1 toxic, 2 severely toxic).  One weight vector is
shared by all thresholds: P(grade > k) = sigmoid(w . x - theta_k) with
theta_0 < theta_1.  Features are sparse: for each selected term (a word or the
beginning of one) its presence and its density.  The output is the expected severity, the sum over k of
P(grade > k).

The labels say toxic or not; the grade of a toxic training text is 2 where its
density of terms that mark toxic training texts is above their median, else 1.
Training reads at most ``MAX_TRAIN`` labelled rows, those with the smallest
hash of ``doc_id``; scoring reads every row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import text_batches, tidy

MAX_TRAIN, MIN_DOCS, CHI2 = 20_000, 4, 15.0
THRESHOLD = 0.5
#: Bytes that end a term: everything in ASCII but letters and digits; other bytes belong to terms.
_BREAKS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


#: Word beginnings, in bytes, that are terms of their own: they stand for words not seen in training.
BEGINNINGS = (5, 7)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_BREAKS).split()


def terms_of(words: list[bytes]) -> list[bytes]:
    """The words, and the beginnings of longer ones with a mark in front."""
    return words + [b"^" + w[:k] for k in BEGINNINGS for w in words if len(w) > k]


@dataclass
class OrdinalModel:
    """``weights``: presence of each term, then density of each term."""

    terms: list[bytes]
    weights: np.ndarray
    thetas: np.ndarray

    def features(self, found: dict[int, int], n: int) -> tuple[list[int], list[float]]:
        """Indices and values for term -> count in a text of ``n`` terms."""
        at = list(found)
        return at + [i + len(self.terms) for i in at], [1.0] * len(at) + [float(np.log1p(100 * found[i] / n)) for i in at]

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, as columns."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thetas[None, :], -500, 500)))


@dataclass
class Sparse:
    """Rows of features as (row, column, value) triples."""

    shape: tuple[int, int]
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[list[int], list[float]]], width: int) -> Sparse:
        sizes = [len(at) for at, _ in rows]
        row = np.repeat(np.arange(len(rows)), sizes)
        column = np.fromiter((i for at, _ in rows for i in at), np.int64, sum(sizes))
        return cls((len(rows), width), row, column, np.fromiter((x for _, v in rows for x in v), np.float64, sum(sizes)))

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def sums(self, by_row: np.ndarray) -> np.ndarray:
        """Sums over rows of each column, every row multiplied by its number in ``by_row``."""
        return np.bincount(self.column, self.value * by_row[self.row], self.shape[1])


def log_likelihood(x: Sparse, y: np.ndarray, w: np.ndarray, thetas: np.ndarray, times: np.ndarray) -> float:
    """Sum over rows of ``times`` log P(grade)."""
    p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - thetas, -40, 40)))
    p = np.concatenate([np.ones((len(y), 1)), p, np.zeros((len(y), 1))], 1)
    rows = np.arange(len(y))
    return float(times @ np.log(np.maximum(p[rows, y] - p[rows, y + 1], 1e-12)))


def fit_ordinal(x: Sparse, y: np.ndarray, grades: int, l2: float = 1e-4, steps: int = 400, rate: float = 0.1, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the penalised likelihood (Adam, full batch).

    The likelihood is averaged over rows, ``times`` tells how often each
    counts, and the penalty is ``l2 / 2`` times the squares of the weights.
    """
    times = np.ones(len(y)) if times is None else times
    d, n = x.shape[1], times.sum()
    w, gaps = np.zeros(d), np.zeros(grades - 1)
    moments = [np.zeros(d + grades - 1), np.zeros(d + grades - 1)]
    rows = np.arange(len(y))
    for step in range(1, steps + 1):
        thetas = gaps[0] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(gaps[1:])))])
        p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - thetas, -40, 40)))
        upper = np.concatenate([np.ones((len(y), 1)), p], 1)[rows, y]
        lower = np.concatenate([p, np.zeros((len(y), 1))], 1)[rows, y]
        like = np.maximum(upper - lower, 1e-12)
        # derivative of the log-likelihood by the margin of each threshold
        slope = p * (1 - p)
        g = np.zeros_like(p)
        g[rows[y > 0], y[y > 0] - 1] += slope[rows[y > 0], y[y > 0] - 1] / like[y > 0]
        most = y < grades - 1
        g[rows[most], y[most]] -= slope[rows[most], y[most]] / like[most]
        g *= times[:, None]
        by_theta = -g.sum(0) / n
        by_gap = np.concatenate([[by_theta.sum()], [by_theta[k:].sum() / (1 + np.exp(-gaps[k])) for k in range(1, grades - 1)]])
        grad = -np.concatenate([x.sums(g.sum(1)) / n - l2 * w, by_gap])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        change = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w -= change[:d]
        gaps -= change[d:]
    return w, gaps[0] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(gaps[1:])))])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> OrdinalModel:
    """Fit the model on a bounded sample of labelled rows.

    Rows with a null ``doc_id`` or ``toxic`` take no part; of repeated labels
    the worst counts, of rows that share a ``doc_id`` the one whose text has
    the least hash.  Every term that ``MIN_DOCS`` rows of the sample hold and
    that goes with toxic labels (chi-squared of ``CHI2`` or more) is a feature.
    Without any labelled text, or with one class only, the model has no terms
    and calls every text clean.
    """
    own = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).dropna()
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))  # at most max_train ids
    sample = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].alias("text")).join(chosen, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                counts = Counter(terms_of(words))
                rows.append((toxic, len(words), list(counts), list(counts.values())))
            types = [pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", "text_hash", "toxic", "n", "terms", "counts"])

    schema = T.StructType([sample.schema["doc_id"], *(T.StructField(n, t) for n, t in (("text_hash", T.LongType()), ("toxic", T.IntegerType()), ("n", T.LongType()), ("terms", T.ArrayType(T.BinaryType())), ("counts", T.ArrayType(T.LongType()))))])
    counted = sample.mapInArrow(tidy(count), schema)
    counted = counted.groupBy("doc_id").agg(F.min(F.struct("text_hash", "toxic", "n", "terms", "counts")).alias("r")).select("r.toxic", "r.n", "r.terms", "r.counts").persist()
    try:
        n_all, n_bad = counted.agg(F.count("*"), F.sum("toxic")).first()
        if not n_bad or n_bad == n_all:
            return OrdinalModel([], np.zeros(0), np.array([np.inf, np.inf]))
        stats = counted.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("df")).filter(F.col("df") >= MIN_DOCS)
        bad, df = F.col("bad").cast("double"), F.col("df").cast("double")
        off = bad * n_all - df * n_bad
        stats = stats.withColumn("chi2", off * off * n_all / (df * (n_all - df) * n_bad * (n_all - n_bad))).filter(F.col("df") < n_all)
        stats = stats.filter((F.col("chi2") >= CHI2) & (bad * n_all > df * n_bad))
        terms = [bytes(r["term"]) for r in stats.orderBy("term").collect()]  # terms of the bounded sample
        at = {t: i for i, t in enumerate(terms)}

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [[(at[t], n) for t, n in zip(ts, ns) if t in at] for ts, ns in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist())]
                lists = [pa.array([[p[k] for p in pairs] for pairs in found], pa.list_(pa.int64())) for k in range(2)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("n"), *lists], names=["toxic", "n", "at", "times"])

        rows = counted.mapInArrow(tidy(keep), "toxic int, n long, at array<long>, times array<long>").collect()  # at most max_train rows
    finally:
        counted.unpersist()
    model = OrdinalModel(terms, np.zeros(2 * len(terms)), np.zeros(2))
    y = np.array([min(1, max(0, r["toxic"])) for r in rows])
    density = np.array([sum(r["times"]) / max(1, r["n"]) for r in rows])
    y[(y == 1) & (density > np.median(density[y == 1]))] = 2
    # most texts have none of the terms: equal rows without features are one row that counts as often
    some = np.array([bool(r["at"]) for r in rows])
    plain = np.bincount(y[~some], minlength=3)
    features = [model.features(dict(zip(r["at"], r["times"])), max(1, r["n"])) for r in rows if r["at"]]
    x = Sparse.of([*features, ([], []), ([], []), ([], [])], 2 * len(terms))
    model.weights, model.thetas = fit_ordinal(x, np.concatenate([y[some], [0, 1, 2]]), 3, times=np.concatenate([np.ones(some.sum()), plain]))
    return model


def score(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, p_toxic, p_severe, severity, grade, rejected`` for every row, without a shuffle.

    ``severity`` is the expected grade, ``grade`` the number of thresholds
    passed with probability ``threshold`` or more, ``rejected`` whether that is
    at least one.  Null and empty texts have no terms and get what the
    thresholds alone say; repeated rows are scored each; other columns are not
    read.  The model has at most the terms of ``MAX_TRAIN`` rows.
    """
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    schema = T.StructType([own.schema["doc_id"], *(T.StructField(n, t) for n, t in (("p_toxic", T.DoubleType()), ("p_severe", T.DoubleType()), ("severity", T.DoubleType()), ("grade", T.IntegerType()), ("rejected", T.BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: i for i, t in enumerate(model.terms)}
        for batch in batches:
            for begin, texts in text_batches(batch.column("text")):
                p = model.above(np.array([_margin(model, at, t) for t in texts]))
                grade = (p >= threshold).sum(1).astype(np.int32)
                columns = [p[:, 0], p[:, 1], p.sum(1), grade, grade > 0]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(texts)), *map(pa.array, columns)], names=schema.names)

    return own.mapInArrow(tidy(run), schema)


def _margin(model: OrdinalModel, at: dict[bytes, int], text: str) -> float:
    words = words_of(text)
    hits = [t for t in terms_of(words) if t in at]
    if not hits:
        return 0.0
    where, values = model.features({at[t]: n for t, n in Counter(hits).items()}, len(words))
    return float(model.weights[where] @ np.array(values))


def keep_clean(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the rows whose text isn't rejected."""
    if docs.columns.count("text") != 1:
        raise ValueError("docs needs exactly one column named text")
    at = {t: i for i, t in enumerate(model.terms)}
    return docs.mapInArrow(tidy(_kept(model, at, docs.columns.index("text"), threshold)), docs.schema)


def _kept(model: OrdinalModel, at: dict[bytes, int], place: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_batches(batch.column(place)):
                margins = np.array([_margin(model, at, t) for t in texts])
                yield batch.slice(begin, len(texts)).filter(pa.array(model.above(margins)[:, 0] < threshold))

    return run

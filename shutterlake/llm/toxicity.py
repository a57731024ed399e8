"""Toxicity by cumulative-link ordinal regression.

P(grade > k) is the logistic function of w.x - t_k: the weights w are shared by
all of the ordered thresholds t_0 < t_1 < ... . Features are sparse: the shares of the
words of a vocabulary chosen on the labelled sample, each with the weight
log(1 + n) of its count, and one for how many of them there are; shares keep a
text with few of the words from looking clean beside one with many. The output
is the expected grade, the sum of P(grade > k) over k.

The model is fitted on a bounded sample of labelled rows (about ``SAMPLE`` rows
by the hash of their id, twice as many at most; equal texts count once). Every document is
scored over its whole text. Words are maximal runs of letters in lower case.

Rows: a null or empty text has no features and gets the intercepts' grade. Null
labels are ignored; of equal texts the largest grade counts; with no labels, or a single grade, every score is 0.
Repeated rows and null ids are scored alike; further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.common import hash_sample, small_batches
from shutterlake.llm.langid import words_of

#: Labelled rows that the model is fitted on.
SAMPLE = 12_288
#: Words in the vocabulary, and the documents a word must be in.
WORDS, LEAST_DOCS, LEAST_CHI = 2_048, 5, 28.0
#: Steps and rate of the full-batch Adam fit, and its L2 penalty for each row.
STEPS, RATE, PENALTY = 800, 0.1, 1e-4


class Model:
    """Word weights, the weight of their amount, and ordered thresholds."""

    def __init__(self, weights: dict[str, float], amount: float, thresholds: np.ndarray) -> None:
        self.weights, self.amount, self.thresholds = weights, amount, thresholds


def grades(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, grade) of the driver's labels: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return labels.select(doc_id, F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, 2 - F.coalesce(F.col("quality"), F.lit(1))).alias("grade"))


def _choose_words(lists: list[np.ndarray], size: int, toxic: np.ndarray) -> np.ndarray:
    """The words whose presence tells most about grade > 0: the largest chi-square values."""
    present = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    docs = np.bincount(present, minlength=size).astype(float)
    bad = np.bincount(present, weights=toxic[rows].astype(float), minlength=size)
    n, share = len(lists), toxic.mean()
    expected = docs * share
    chi = np.where(docs >= LEAST_DOCS, (bad - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - docs / (n + 1)), 1e-9), 0)
    order = np.argsort(-chi, kind="stable")[:WORDS]
    # only words that speak for it; at this value chance passes one word in ten million
    return order[(chi[order] > LEAST_CHI) & (bad[order] > expected[order])]


def _shares(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse features: shares of words, and in column ``width`` the amount of them."""
    weight = np.log1p(counts)
    total = np.bincount(rows, weights=weight, minlength=n)
    some = np.flatnonzero(total > 0)
    amount = np.log1p(np.bincount(rows, weights=counts, minlength=n)[some]) / 4
    return np.concatenate([rows, some]), np.concatenate([cols, np.full(len(some), width)]), np.concatenate([weight / total[rows], amount])


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch Adam on the sparse matrix (rows, cols, values)."""
    k, n = int(y.max()), len(y)
    share = np.array([(y > j).mean() for j in range(k)])
    share = np.clip(share, 1e-4, 1 - 1e-4)
    # gaps between thresholds are exponentials, so they stay in order
    first = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))])

    low, high = np.maximum(y - 1, 0), np.minimum(y, k - 1)
    for t in range(1, STEPS + 1):
        th = thresholds(p)
        s = np.bincount(rows, weights=values * p[cols], minlength=n)
        # P(y) = F(s - th[y-1]) - F(s - th[y]), with F at the ends 1 and 0
        a = np.where(y > 0, 1 / (1 + np.exp(-(s - th[low]))), 1.0)
        b = np.where(y < k, 1 / (1 + np.exp(-(s - th[high]))), 0.0)
        prob = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / prob, b * (1 - b) / prob
        ds = -(da - db) / n
        dth = np.bincount(low, weights=np.where(y > 0, da, 0.0), minlength=k) - np.bincount(high, weights=np.where(y < k, db, 0.0), minlength=k)
        dth = dth / n
        grad = np.concatenate([np.bincount(cols, weights=values * ds[rows], minlength=width) + PENALTY * p[:width], [dth.sum()], np.cumsum(dth[::-1])[::-1][1:] * np.exp(p[width + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:width], thresholds(p)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` rows of ``labels`` (doc_id, grade)."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col("grade").isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max("grade").cast("int").alias("grade"))
    chosen = hash_sample(chosen, doc_id, sample)
    # the sample's size bounds what is broadcast
    rows = docs.select(F.col(doc_id), F.col(text)).join(F.broadcast(chosen), doc_id)
    counted = rows.select("grade", F.xxhash64(text).alias("same"), words_of(F.col(text)).alias("words")).toArrow()
    same = counted["same"].to_numpy()
    # of equal texts the one with the largest grade counts, in the order of the texts' hashes, however rows arrive
    order = np.lexsort((-counted["grade"].to_numpy(), same)) if len(same) else np.zeros(0, dtype=np.int64)
    first = order[np.concatenate([[True], np.diff(same[order]) != 0])] if len(same) else order
    counted = counted.take(pa.array(first)).combine_chunks()
    y = counted["grade"].to_numpy().astype(np.int64) if len(first) else np.zeros(0, dtype=np.int64)
    if not len(y) or y.max() == 0 or y.min() == y.max():
        return Model({}, 0.0, np.zeros(0))
    lists = pa.concat_arrays(counted["words"].chunks)
    coded = lists.flatten().dictionary_encode()
    size = max(1, len(coded.dictionary))
    bounds, index = lists.offsets.to_numpy() - lists.offsets[0].as_py(), coded.indices.to_numpy()
    distinct = [np.unique(index[a:b], return_counts=True) for a, b in zip(bounds, bounds[1:], strict=False)]
    words = _choose_words([x[0] for x in distinct], size, y > 0)
    place = np.full(size, -1)
    place[words] = np.arange(len(words))
    r = np.repeat(np.arange(len(y)), [len(x[0]) for x in distinct])
    c, n = place[np.concatenate([x[0] for x in distinct])], np.concatenate([x[1] for x in distinct])
    used = c >= 0
    weights, thresholds = fit_cumulative_link(*_shares(r[used], c[used], n[used], len(y), len(words)), y, len(words) + 1)
    names = coded.dictionary.take(pa.array(words)).to_pylist()
    return Model(dict(zip(names, weights[:-1].tolist(), strict=True)), float(weights[-1]), thresholds)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_severity``, ``p_toxic`` = P(grade > 0), the likeliest ``grade``, and ``toxic`` = p_toxic >= 0.5."""
    added = [("expected_severity", T.DoubleType()), ("p_toxic", T.DoubleType()), ("grade", T.IntegerType()), ("toxic", T.BooleanType())]
    keep = [f for f in docs.schema.fields if f.name not in dict(added)]
    inner = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)]
    out = T.StructType([*inner, *[T.StructField(a, b) for a, b in added]])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            words = batch.column(len(inner))
            bounds = words.offsets.to_numpy().astype(np.int64)
            coded = words.flatten().dictionary_encode()
            size = max(1, len(coded.dictionary))
            weight = np.array([m.weights.get(w, np.nan) for w in coded.dictionary.to_pylist()] or [np.nan])
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            told = np.flatnonzero(~np.isnan(weight[index])) if len(index) else index
            pair, n = np.unique(row[told] * size + index[told], return_counts=True)
            r, c, x = _shares(pair // size, pair % size, n, batch.num_rows, size)
            s = np.bincount(r, weights=x * np.append(weight, m.amount)[c], minlength=batch.num_rows)
            above = 1 / (1 + np.exp(-(s[:, None] - m.thresholds[None, :]))) if len(m.thresholds) else np.zeros((batch.num_rows, 1))
            ends = np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(inner)], pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array((ends[:, :-1] - ends[:, 1:]).argmax(axis=1), pa.int32()), pa.array(above[:, 0] >= 0.5)], names=out.names)

    cut = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(keep)], words_of(F.col(f"`{text}`")).alias("words"))
    done = cut.mapInArrow(scored, out)
    return done.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(keep)], *[a for a, _ in added])

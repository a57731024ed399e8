"""Quality classifier: supervised subword embeddings.

A text's features are its words (runs without white space, case kept), pairs of
neighbouring words, and the character n-grams of 3 to 5 within each word and the
one white space on either side, all hashed into ``BUCKETS`` vectors, and one
feature that every text has. A pair is hashed by the difference of its words'
hashes, so that each immediate repetition is the same feature, whatever the word.
A text is the mean of its features' vectors, and a softmax over two classes
follows. Vectors and softmax are learned together by stochastic gradient
descent in NumPy, one text at a step, with a falling rate.

The fit takes about ``SAMPLE`` labelled rows by the hash of their id (twice as
many at most); tasks turn their whole texts into counts of buckets, so the
driver gets no text, and ``BUCKETS`` numbers a row at most. Every document is
scored over its whole text: since softmax and mean are linear in the vectors but
for the last step, each bucket's share of the difference of the two classes is
worked out once, and a text's score is the logistic function of their mean.

Rows: a null or empty text has only the feature that every text has. Null labels
and null ids teach nothing; of a document's labels the largest counts. With no
labels every score is 0.5. Repeated rows are scored alike; further columns stay,
except those replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.common import hash_sample, small_batches

#: Labelled rows that the model is fitted on, vectors, and their length.
SAMPLE, BUCKETS, SIZE = 4_096, 1 << 17, 16
#: Lengths of the character n-grams.
GRAMS = (3, 4, 5)
#: Passes over the sample, first rate, and the seed of the start and of the order.
EPOCHS, RATE, SEED = 5, 0.25, 1
#: Score from which a document is predicted to be of quality.
LEAST = 0.7
#: Bytes of text that are turned into features at a time (more only for a word that is longer).
SLICE = 1 << 20
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_FACTOR, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - (BUCKETS.bit_length() - 1))
#: The bucket of the feature that every text has; hashes use the others.
EVERY = 0


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + np.uint64(kind)) * _MIX
    return np.maximum((mixed ^ (mixed >> np.uint64(29))) * _MIX >> _SHIFT, np.uint64(1)).astype(np.int64)


def features(chars: np.ndarray, begins: np.ndarray, before: np.uint64 | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.uint64 | None]:
    """(places, buckets) of the words, of pairs of neighbours and of the n-grams of each length, and the hash of the last text's last word.

    ``chars`` are the code points of texts that begin at ``begins``, with a space
    before and after each; ``before`` is the last word of what the first continues.
    """
    n = len(chars)
    space = np.where(chars < 256, _SPACES[np.minimum(chars, 255)], False)
    wide = np.where(space, 32, chars).astype(np.uint64)
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if not len(starts):
        return [], before if len(begins) == 1 else None
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    # a word's hash: its code points times powers that begin anew at each word
    powers = np.full(int((ends - starts).max()), _FACTOR, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    offset = np.arange(n) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [n]])))
    shares = np.where(space, np.uint64(0), (wide + np.uint64(1)) * powers[np.minimum(offset, len(powers) - 1)])
    words = np.add.reduceat(shares, starts)
    text = np.searchsorted(begins, starts, side="right")
    # a pair's hash is the difference of its words', so every word said twice is the same pair
    second = np.flatnonzero(text[1:] == text[:-1]) + 1
    found = [(starts, _bucket(words, 1)), (starts[second], _bucket(words[second] - words[second - 1], 2))]
    if before is not None and text[0] == 1:
        found.append((starts[:1], _bucket(words[:1] - before, 2)))
    spaces = np.concatenate([[0], np.cumsum(space)])
    rolled = wide
    for long in range(2, min(n, max(GRAMS)) + 1):
        rolled = rolled[: n - long + 1] * _FACTOR + wide[long - 1 :]
        if long in GRAMS:
            # white space at the ends only: an n-gram lies within a word and its borders
            places = np.flatnonzero(spaces[long - 1 : n] == spaces[1 : n - long + 2])
            found.append((places, _bucket(rolled[places], long)))
    return found, words[-1] if text[-1] == len(begins) else None


def _found(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(rows, places where their shares begin, code points, features) of each piece of the texts; a text's share begins with the space before it."""
    last, row = None, None
    for rows, begins, chars in _pieces(texts):
        found, last = features(chars, begins, last if rows[0] == row else None)
        row = rows[-1]
        yield rows, begins - 1, len(chars), found


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, code points) of texts joined by spaces, about ``SLICE`` bytes at a time; long texts are cut at white space."""
    rows, parts, held = [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = b" " + b" ".join(parts) + b" "
        begin = np.cumsum([1, *[len(p) + 1 for p in parts[:-1]]])
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        whole = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
        return np.array(rows), np.cumsum(whole)[begin - 1], chars

    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    for row, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while at < end:
            stop = end
            if end - at > SLICE:
                found = np.flatnonzero(_SPACES[data[at : at + SLICE]])
                if not len(found):  # a word longer than a slice
                    found = np.flatnonzero(_SPACES[data[at:end]])[:1]
                stop = at + int(found[-1]) + 1 if len(found) else end
            rows.append(row)
            parts.append(data[at:stop].tobytes())
            held, at = held + stop - at, stop
            if held >= SLICE or at < end:  # each part of a text that is cut ends a piece
                yield joined()
                rows, parts, held = [], [], 0
    if parts:
        yield joined()


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares of all its features."""
    keys, counts = [np.arange(len(texts)) * BUCKETS + EVERY], [np.ones(len(texts))]
    for rows, begins, _, found in _found(texts):
        for places, buckets in found:
            owner = rows[np.searchsorted(begins, places, side="right") - 1]
            pair, n = np.unique(owner * BUCKETS + buckets, return_counts=True)
            keys.append(pair)
            counts.append(n.astype(float))
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(place, weights=np.concatenate(counts))
    bounds = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
    return [(key[a:b] % BUCKETS, count[a:b] / count[a:b].sum()) for a, b in zip(bounds, bounds[1:], strict=False)]


def sums(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its features' entries in ``table``, and how many features it has."""
    total, count = np.full(len(texts), table[EVERY]), np.ones(len(texts))
    for rows, begins, size, found in _found(texts):
        value, number = np.zeros(size), np.zeros(size)
        for places, buckets in found:
            value[places] += table[buckets]
            number[places] += 1
        np.add.at(total, rows, np.add.reduceat(value, begins))
        np.add.at(count, rows, np.add.reduceat(number, begins))
    return total, count


def gradients(vectors: np.ndarray, out: np.ndarray, shares: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient of the text's vectors, gradient of the softmax weights) of one text: its features' vectors and their shares."""
    mean = shares @ vectors
    z = out @ mean
    p = np.exp(z - z.max())
    p /= p.sum()
    err = p - (np.arange(2) == label)
    return -float(np.log(max(p[label], 1e-300))), np.outer(shares, out.T @ err), np.outer(err, mean)


def fit(texts: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, softmax weights) by stochastic gradient descent over (buckets, shares, label)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    out, step, steps = np.zeros((2, SIZE), dtype=np.float32), 0, max(1, epochs * len(texts))
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            buckets, shares, label = texts[i]
            _, by_vector, by_out = gradients(vectors[buckets], out, shares, label)
            now = rate * (1 - step / steps)
            # the vectors' steps are as small as their shares; so scaled, the text's mean moves by the rate whatever its length
            vectors[buckets] -= (now / (shares @ shares) * by_vector).astype(np.float32)
            out -= (now * by_out).astype(np.float32)
            step += 1
    return vectors, out


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Each bucket's share of the difference between the classes, from about ``sample`` rows of ``labels`` (doc_id, 0 or 1)."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    chosen = hash_sample(chosen, "id", sample)
    # the sample's size bounds what is broadcast
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.make_valid_utf8(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bags(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())), pa.array([s.astype(np.float32) for _, s in found], pa.list_(pa.float32()))], names=["label", "buckets", "shares"])

    table = rows.mapInArrow(counted, "label int, buckets array<int>, shares array<float>").toArrow()
    # views of what came, not copies; the same order however rows arrive
    texts = [(b.values.to_numpy(), s.values.to_numpy(), y.as_py()) for y, b, s in zip(table["label"], table["buckets"], table["shares"], strict=True)]
    texts.sort(key=lambda t: (t[2], hashlib.sha256(t[0]).digest(), hashlib.sha256(t[1]).digest()))
    vectors, out = fit(texts)
    return vectors.astype(np.float64) @ (out[1] - out[0]).astype(np.float64)


def score(docs: DataFrame, table: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1, and ``predicted``, 1 from ``LEAST`` on, else 0."""
    small_batches(docs.sparkSession)
    added = [("score", T.DoubleType()), ("predicted", T.IntegerType())]
    keep = [f for f in docs.schema.fields if f.name not in dict(added) and f.name != text]
    held = docs.sparkSession.sparkContext.broadcast(table)
    out = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)], *[T.StructField(a, b) for a, b in added]])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = sums(batch.column(len(keep)), held.value)
            p = 1 / (1 + np.exp(-np.clip(total / count, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p), pa.array((p >= LEAST).astype(np.int32))], names=out.names)

    cut = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(keep)], F.make_valid_utf8(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"))
    return cut.mapInArrow(scored, out).select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(keep)], *[a for a, _ in added])

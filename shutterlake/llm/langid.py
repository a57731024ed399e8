"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's likelihood is the sum over all of its segmentations into pieces, got by
the forward algorithm; a text's is the product over its words (maximal runs of
letters, in lower case). Piece probabilities are learned by expectation
maximisation over the counts of all words of all labelled texts: the E-step
runs on the distinct (language, word) table in parallel, and only the expected
piece counts, bounded by vocabulary size times languages, reach the driver.

The vocabulary works on bytes and holds every single byte, so each word has a
segmentation; pieces of every length take part.

Rows: a null text, or one without a letter, gives ``und`` and score 0. Texts
whose language is null teach nothing. With nothing to learn from, every text is
``und``. Equal scores go to the language first in order. Repeated rows and null
ids are scored alike; columns of the input stay, except those replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.bpe import load_ranks
from shutterlake.llm.common import discard, slices, small_batches, written

#: Rounds of expectation maximisation.
ROUNDS = 2
#: Added to every expected piece count.
SMOOTHING = 0.05
#: Bytes of distinct words scored at a time, words that a slice of a batch holds, and words whose scores a task keeps.
CHUNK, SLICE, KEPT = 1 << 16, 500_000, 100_000
UNKNOWN = "und"
#: Bytes between two divisions of a word's sums.
RESCALE = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary as sorted hashes by length, and which hashes begin a piece."""

    def __init__(self, path: str) -> None:
        ranks = load_ranks(path)
        self.size = len(ranks)
        pieces = sorted(ranks, key=ranks.__getitem__)
        self.start = 1.0 / (np.arange(self.size) + 100.0)
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = np.array([len(p) for p in pieces])
        flat, starts = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(sizes) - sizes
        hashes = np.zeros(self.size, dtype=np.uint64)
        for n in range(1, int(sizes.max()) + 1):
            long = np.flatnonzero(sizes >= n)
            hashes[long] = hashes[long] * _BASE + (flat[starts[long] + n - 1].astype(np.uint64) + np.uint64(1))
            begins = np.zeros(1 << 18, dtype=bool)
            begins[_slot(hashes[long])] = True
            ids = np.flatnonzero(sizes == n)
            ids = ids[np.argsort(hashes[ids])]
            self.by_length.append((hashes[ids], ids, begins))

    def matches(self, flat: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, piece ids) of the pieces in ``flat``; ``left`` holds the bytes to the word's end.

        A position is left once no piece begins with the bytes read from it.
        """
        at, hashes = np.arange(len(flat)), np.zeros(len(flat), dtype=np.uint64)
        for n, (known, ids, begins) in enumerate(self.by_length, 1):
            going = left[at] >= n
            at, hashes = at[going], hashes[going]
            hashes = hashes * _BASE + (flat[at + n - 1].astype(np.uint64) + np.uint64(1))
            going = begins[_slot(hashes)]
            at, hashes = at[going], hashes[going]
            if not len(at):
                return
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                same = known[place] == hashes
                yield n, at[same], ids[place[same]]


def _slot(hashes: np.ndarray) -> np.ndarray:
    """18 well-mixed bits of each hash."""
    return (hashes * _BASE) >> np.uint64(46)


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The vocabulary, built once in a Python worker."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _chunks(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes, lengths, bytes) of words of about equal length, ``CHUNK`` bytes at a time. Words start with a space."""
    raw = [b" " + w.encode() for w in words]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths[order]) // CHUNK)) + 1
    for part in np.split(order, cuts):
        yield part, lengths[part], np.frombuffer(b"".join([raw[i] for i in part]), dtype=np.uint8)


def _edges(pieces: Pieces, lengths: np.ndarray, flat: np.ndarray):
    """The lattice of a chunk: edges (from node, to node, piece) by offset in the word, and each word's first node.

    A word of n bytes has n + 1 nodes.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    word = np.repeat(np.arange(len(lengths)), lengths)
    offset = np.arange(len(flat)) - starts[word]
    src, dst, ids, step = [], [], [], []
    for n, where, piece in pieces.matches(flat, lengths[word] - offset):
        node = where + word[where]
        src.append(node)
        dst.append(node + n)
        ids.append(piece)
        step.append(offset[where])
    src, dst, ids, step = (np.concatenate(x) for x in (src, dst, ids, step))
    # of edges from the same offset, those of one length have different targets
    order = np.lexsort((dst - src, step))
    return src[order], dst[order], ids[order], step[order], starts + np.arange(len(lengths))


def _runs(step: np.ndarray, gap: np.ndarray) -> Iterator[slice]:
    """Slices of edges with the same offset and length: their targets differ, so one vector step adds them."""
    cuts = np.flatnonzero((np.diff(step) != 0) | (np.diff(gap) != 0)) + 1
    bounds = [0, *cuts.tolist(), len(step)]
    yield from (slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a)


def forward(path: str, words: list[str], logp: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word under each column of ``logp`` (pieces by languages).

    Sums are of probabilities themselves. Every ``RESCALE`` bytes the nodes that a
    piece may have reached are divided by their greatest value, whose logarithm is
    kept, so that words of any length stay within a double's range.
    """
    pieces, out = pieces_of(path), np.zeros((len(words), logp.shape[1]))
    if not words:
        return out
    chances = np.exp(logp)
    for part, lengths, flat in _chunks(words):
        src, dst, ids, step, first = _edges(pieces, lengths, flat)
        alpha, scale = np.zeros((len(flat) + len(part), logp.shape[1])), np.zeros((len(part), logp.shape[1]))
        alpha[first] = 1.0
        due = RESCALE
        for s in _runs(step, dst - src):
            if step[s.start] == due:
                # words are in the order of their lengths: these have that many bytes
                some = slice(int(np.searchsorted(lengths, due)), None)
                span = np.arange(due, min(due + len(pieces.by_length), int(lengths[-1])) + 1)
                nodes = first[some, None] + np.minimum(span, lengths[some, None])
                values = alpha[nodes]
                most = values.max(axis=1)
                alpha[nodes] = values / most[:, None]
                scale[some] += np.log(most)
                due += RESCALE
            alpha[dst[s]] += alpha[src[s]] * chances[ids[s]]
        out[part] = np.log(alpha[first + lengths]) + scale
    return out


def expected_counts(path: str, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in ``words`` with multiplicities ``counts``, under one language's ``logp``."""
    pieces, out = pieces_of(path), np.zeros(len(logp))
    for part, lengths, flat in _chunks(words):
        src, dst, ids, step, first = _edges(pieces, lengths, flat)
        runs = list(_runs(step, dst - src))
        alpha = np.full(len(flat) + len(part), -np.inf)
        beta = alpha.copy()
        alpha[first], beta[first + lengths] = 0.0, 0.0
        for s in runs:
            alpha[dst[s]] = np.logaddexp(alpha[dst[s]], alpha[src[s]] + logp[ids[s]])
        for s in reversed(runs):
            beta[src[s]] = np.logaddexp(beta[src[s]], beta[dst[s]] + logp[ids[s]])
        word = np.searchsorted(first, src, side="right") - 1
        gamma = np.exp(alpha[src] + logp[ids] + beta[dst] - alpha[first + lengths][word]) * counts[part][word]
        out += np.bincount(ids, weights=gamma, minlength=len(out))
    return out


def words_of(text: Column) -> Column:
    """Maximal runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each (language, word) within a batch."""
    for batch in slices(batches, 4_096, 1, SLICE):
        langs, words = batch.column(0).dictionary_encode(), batch.column(1)
        coded = words.flatten().dictionary_encode()
        sizes = np.diff(words.offsets.to_numpy()[: batch.num_rows + 1])
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), sizes).astype(np.int64)
        pair = lang * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        found, n = np.unique(pair, return_counts=True)
        names = langs.dictionary.take(pa.array(found // max(1, len(coded.dictionary))))
        yield pa.RecordBatch.from_arrays([names, coded.dictionary.take(pa.array(found % max(1, len(coded.dictionary)))), pa.array(n, pa.int64())], names=["lang", "word", "n"])


class Model:
    """Learned languages, and the log-probability of each piece under each."""

    def __init__(self, path: str, langs: list[str], logp: np.ndarray, prior: np.ndarray) -> None:
        self.path, self.langs, self.logp, self.prior = path, langs, logp, prior


def learn(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> Model:
    """Fit piece probabilities to all rows of ``docs`` with a language, over all of their words."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), words_of(F.col(text)).alias("words"))
    partial = known.mapInArrow(_word_counts, "lang string, word string, n long")
    table = written(partial.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = {r["lang"]: r["n"] for r in table.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    size = pieces_of(path).size
    start = pieces_of(path).start
    logp = np.repeat(np.log(start / start.sum())[:, None], max(1, len(langs)), axis=1)
    for _ in range(rounds if langs else 0):
        held = spark.sparkContext.broadcast(logp)

        def e_step(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                names = np.array(batch.column(0).to_pylist(), dtype=object)
                words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for name in set(names):
                    rows = np.flatnonzero(names == name)
                    got = expected_counts(path, [words[i] for i in rows], n[rows].astype(float), held.value[:, langs.index(name)])
                    sums[name] = sums.get(name, 0.0) + got
            for name, got in sums.items():
                ids = np.flatnonzero(got > 0)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids, pa.int32()), pa.array(got[ids])], names=["lang", "piece", "n"])

        counted = table.mapInArrow(e_step, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        logp = np.full((size, len(langs)), SMOOTHING)
        at = np.array([langs.index(x) for x in counted["lang"].to_pylist()], dtype=np.int64)
        logp[counted["piece"].to_numpy(), at] += counted["n"].to_numpy()
        logp = np.log(logp / logp.sum(axis=0))
        held.unpersist()
    discard(table)
    share = np.array([totals[x] for x in langs], dtype=float)
    return Model(path, langs, logp, np.log(share / share.sum()) if langs else np.zeros(0))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, the posterior of that language, and ``fit``.

    ``fit`` is the log-likelihood of the words under that language less that under
    equally probable pieces, for each byte (with a space before each word); null
    for ``und``. Below 0 the language explains the text worse than knowing none.
    """
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "fit")]
    inner = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)]
    out = T.StructType([*inner, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        # words that this task has scored, up to KEPT of them
        known, kept = pa.array([], pa.string()), np.zeros((0, len(m.langs) + 1))
        logp = np.column_stack([m.logp, np.full(len(m.logp), -np.log(max(1, len(m.logp))))])
        for batch in slices(batches, 4_096, len(inner), SLICE):
            words = batch.column(len(inner))
            bounds = words.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            coded = words.flatten().dictionary_encode()
            names, scores, fit = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
            if m.langs and bounds[-1]:
                at = pc.index_in(coded.dictionary, value_set=known)
                new, old = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (at.is_null(), at.is_valid()))
                fresh, each = coded.dictionary.take(pa.array(new)), np.zeros((len(at), len(m.langs) + 1))
                each[old], each[new] = kept[at.drop_null().to_numpy()], forward(m.path, fresh.to_pylist(), logp)
                if len(known) < KEPT:
                    known, kept = pa.concat_arrays([known, fresh]), np.concatenate([kept, each[new]])
                index = coded.indices.to_numpy(zero_copy_only=False)
                some = np.flatnonzero(np.diff(bounds) > 0)
                said = np.stack([np.add.reduceat(each[:, k][index], bounds[:-1][some]) for k in range(len(m.langs) + 1)], axis=1)
                total = said[:, :-1] + m.prior
                best = total.argmax(axis=1)
                names[some] = np.array(m.langs, dtype=object)[best]
                scores[some] = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                size = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                fit[some] = (said[np.arange(len(some)), best] - said[:, -1]) / np.add.reduceat(size[index], bounds[:-1][some])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(inner)], pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(fit, from_pandas=True)], names=out.names)

    cut = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(keep)], words_of(F.col(f"`{text}`")).alias("words"))
    done = cut.mapInArrow(score, out)
    return done.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(keep)], "lang_pred", "score", "fit")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of the id's text mod 4 is 2. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))

"""Removal of byte strings that occur twice, by prefix-free parsing.

Every ``LENGTH``-byte string has one trigger: of the rolling hashes of its
``GRAM``-byte substrings, the least (the leftmost of equals). Strings that start
side by side mostly share their trigger, so triggers cut a text into phrases: a
phrase is the text from the first to the end of the last string that a trigger
serves. Phrases overlap by what a string needs, so every string lies in exactly
one phrase, and equal strings have equal triggers at equal places. Which strings
repeat is therefore decided among the phrases of one trigger hash:

* the dictionary holds each distinct phrase once; a phrase that occurs twice is
  removed wherever it occurs, with all its strings;
* the strings of the distinct phrases of one trigger are brought together in
  suffix order (by fingerprint, which puts equal prefixes of ``LENGTH`` bytes
  side by side, as their order in a suffix array would), and equal neighbours
  repeat. Triggers that occur once in the corpus are dropped before that.

The parse is not sorted beyond this, because no string reaches over the end of
its phrase. Fingerprints are two 64-bit hashes.

The texts are written once as a table in the shared folder, bucketed by row, so
that looking up the phrases that are left over, and cutting the spans out, do not
shuffle them. It is dropped and deleted whether or not the job succeeds.

One trigger, or one phrase of a group of copies, may have a third of all rows.
Those with over one in ``HOT`` rows, of which there are fewer than ``HOT``, are
broadcast by that bound and their rows dealt over ``SALTS`` keys.

Rows: a null text is empty; texts shorter than ``LENGTH`` bytes lose nothing.
Rows are told apart even where ids are null or repeated. Columns other than
doc_id and text do not matter. Strings never reach over a document's end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import delete, discard, new_path, small_batches, written

LENGTH, GRAM = 200, 64
#: Bytes of text hashed together, distinct phrases compared together, and phrases of one trigger from which they are compared by a shuffle.
CHUNK, PHRASES, CROWD = 1 << 20, 8_192, 2_048
#: A key is hot with more than one in so many rows; the keys that its rows are dealt over.
HOT, SALTS = 1_000, 64
#: Text in a bucket of the table.
BUCKET_BYTES = 24 << 20

_DRAW = np.random.default_rng(7)
_BYTES = [_DRAW.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 30) - 1)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses, up to ``size``."""
    if not _POWERS or len(_POWERS[0][0]) <= size:
        _POWERS.clear()
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, 2**64)):
                row = np.full(size + 1, b, dtype=np.uint64)
                row[0] = 1
                both.append(np.cumprod(row))
            _POWERS.append((both[0], both[1]))
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Fingerprints of the substrings [start, end)."""
    up, down = _powers(len(data))[which]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[which][data] * up[: len(data)])])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def phrases_of(data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first start, last start, trigger, trigger's hash) of the phrases of concatenated texts; ``last`` is the end of the text at each byte."""
    size = len(data)
    if size < LENGTH:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h, step, base = _BYTES[0][data], 1, np.uint64(_BASES[0])
    factor = base
    while step < GRAM:
        h = h[: len(h) - step] * factor + h[step:]
        factor, step = factor * factor, step * 2
    h = _mixed(h)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    wide, span = LENGTH - GRAM + 1, 1
    while span * 2 <= wide:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    starts = np.arange(len(least))
    good = np.flatnonzero(starts + LENGTH <= last[: len(least)])
    at = (least[good] & _PLACE).astype(np.int64)
    if not len(good):
        return phrases_of(data[:0], last)
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(good) != 1)) + 1
    first, final = good[np.concatenate([[0], cut])], good[np.concatenate([cut - 1, [len(good) - 1]])]
    place = at[np.concatenate([[0], cut])]
    return first, final, place, h[place]


def _chunks(ids: list, texts: list) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(row ids, their bounds, bytes) of whole texts, about ``CHUNK`` bytes together."""
    held, size, names = [], 0, []
    for i, text in zip(ids, texts, strict=True):
        if len(text) < LENGTH:
            continue
        held.append(text)
        names.append(i)
        size += len(text)
        if size >= CHUNK:
            yield names, np.concatenate([[0], np.cumsum([len(t) for t in held])]), np.frombuffer(b"".join(held), dtype=np.uint8)
            held, size, names = [], 0, []
    if held:
        yield names, np.concatenate([[0], np.cumsum([len(t) for t in held])]), np.frombuffer(b"".join(held), dtype=np.uint8)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases (row, lo, size, trigger, phrase): ``lo`` to ``lo + size`` are the starts of strings."""
    for batch in batches:
        for names, bounds, data in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            last = np.repeat(bounds[1:], np.diff(bounds))
            first, final, place, trigger = phrases_of(data, last)
            doc = np.searchsorted(bounds, first, side="right") - 1
            # where the trigger stands is part of the phrase
            phrase = _hashes(data, first, final + LENGTH, 1) ^ _mixed((place - first).astype(np.uint64) + np.uint64(1))
            rows = np.array(names, dtype=np.int64)[doc]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array((first - bounds[doc]).astype(np.int32)), pa.array((final - first).astype(np.int32)), pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64))], names=["row", "lo", "size", "trigger", "phrase"])


def _spans(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts as (row, start, end) of the bytes they cover."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    cut = np.flatnonzero((np.diff(rows) != 0) | (np.diff(starts) > 1)) + 1
    first, final = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(rows) - 1]])
    return rows[first], starts[first], starts[final] + LENGTH


def _strings(rows: np.ndarray, los: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, two fingerprints) of every string of some phrases."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = lengths - LENGTH + 1
    which = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[which] + inside
    return rows[which], los[which] + inside, _hashes(data, at, at + LENGTH, 0), _hashes(data, at, at + LENGTH, 1)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of strings that two phrases of one trigger share; rows come sorted by trigger."""
    held: pa.Table | None = None

    def spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        row, start, a, b = _strings(table["row"].to_numpy(), table["lo"].to_numpy().astype(np.int64), table["bytes"].to_pylist())
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        twice = np.zeros(len(order), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.any():
            r, s, e = _spans(row[twice], start[twice])
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["row", "start", "end"])

    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows >= PHRASES:
            trigger = held["trigger"].to_numpy()
            # the last trigger may go on in the next batch
            cut = int(np.searchsorted(trigger, trigger[-1], side="left"))
            yield from spans(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield from spans(held)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            row, start, a, b = _strings(part.column("row").to_numpy(), part.column("lo").to_numpy().astype(np.int64), part.column("bytes").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(start.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["row", "start", "a", "b"])


def _of_keys(rows: DataFrame, keys: DataFrame, by: list[str], total: int) -> DataFrame:
    """The ``rows`` (row, lo, ..), ``total`` at least, whose ``by`` is among ``keys`` (by.., n); n is a key's rows."""
    hot = F.col("n") * F.lit(HOT) > F.lit(total)
    few = keys.where(hot).select(*by, F.lit(True).alias("hot"))
    dealt = rows.join(F.broadcast(few), by, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row", "lo"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(keys.select(*by, F.explode(salts).alias("salt")), [*by, "salt"]).drop("salt")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(row, start, end), overlapping, of the bytes of ``texts`` (row, bytes) that a repeated string covers."""
    phrases = texts.select("row", "bytes").mapInArrow(_parse, "row long, lo int, size int, trigger long, phrase long")
    often = written(phrases.groupBy("trigger").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "triggers")
    # no more rows than there are, so that at most ``HOT`` keys are hot
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    candidates = written(_of_keys(phrases, often, ["trigger"], total), "phrases")
    one = F.min(F.struct("row", "lo", "size")).alias("one")
    dictionary = written(candidates.groupBy("trigger", "phrase").agg(F.count(F.lit(1)).alias("times"), one), "dictionary")
    twice = dictionary.where("times > 1").select("trigger", "phrase", F.col("times").alias("n"))
    whole = _of_keys(candidates, twice, ["trigger", "phrase"], total).select("row", F.col("lo").alias("start"), (F.col("lo") + F.col("size") + LENGTH).alias("end"))

    several = written(dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("distinct")).where("distinct > 1"), "several")
    left = dictionary.join(several, "trigger").select("trigger", "distinct", "one.row", "one.lo", "one.size")
    wanted = left.groupBy("row").agg(F.collect_list(F.struct("lo", "size", "trigger", "distinct")).alias("wanted"))
    found = texts.join(wanted, "row").select("row", "bytes", F.explode("wanted").alias("w"))
    found = found.select("row", "w.lo", "w.trigger", "w.distinct", F.substring("bytes", F.col("w.lo") + 1, F.col("w.size") + LENGTH).alias("bytes"))
    found = written(found, "found")
    few = found.where(F.col("distinct") <= CROWD).select("trigger", "row", "lo", "bytes")
    parts = few.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_compare, "row long, start int, end int")
    spans = whole.union(parts)
    same = None
    crowd = found.where(F.col("distinct") > CROWD).select("row", "lo", "bytes")
    if not crowd.isEmpty():
        prints = crowd.mapInArrow(_fingerprints, "row long, start int, a long, b long")
        same = written(prints.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "same")
        spans = spans.union(prints.join(same, ["a", "b"]).select("row", "start", (F.col("start") + LENGTH).alias("end")))
    out = written(spans, "spans")
    discard(often, candidates, dictionary, several, found, *([same] if same is not None else []))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, starts, ends in zip(batch.column("bytes"), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            text = raw.as_py()
            kept, removed, spans, done = [], 0, 0, 0
            for start, end in sorted(zip(starts or [], ends or [], strict=True)):
                if start > done or not spans:
                    spans += 1
                    kept.append(text[done:start])
                    done = start
                if end > done:
                    removed += end - done
                    done = end
            kept.append(text[done:])
            out.append((len(text), removed, spans, b"".join(kept)))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes ``kept`` for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    raw = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    name, path = f"repeats_{uuid.uuid4().hex}", new_path(spark, "texts")
    rows = raw.withColumn("row", F.monotonically_increasing_id())
    try:
        rows.write.bucketBy(max(8, -(-int(total) // BUCKET_BYTES)), "row").format("parquet").option("path", path).saveAsTable(name)
        texts = spark.table(name)
        spans = repeated_spans(texts)
        # neighbouring spans of a row become one list
        listed = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("s")).select("row", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
        joined = texts.join(listed, "row", "left").select("doc_id", "bytes", "starts", "ends")
        out = written(joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"), "repeats")
        discard(spans)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)
    return out

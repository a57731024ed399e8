"""Collocations: phrases of two and three words that occur together more often than their parts would.

* Texts become blocks of one language: the block's distinct words, their counts,
  and the texts as places in that list, broken at the ends of pieces. A block
  has about ``BLOCK`` bytes, so a word has one row a block however frequent it is.
* Words that are frequent enough get an id (a phrase cannot be more frequent than
  its words); blocks are rewritten in ids, and pieces are broken at other words.
* Each block sorts its pairs and triples, and sends every one once, with its
  count, as a binary key of fixed width: three ids of eight bytes, big-endian,
  the last zero in a pair. Keys go to ranges; the ranges' bounds come from a
  sample of the keys and decide only which task counts a key.
* A task has one range, of about ``RANGE`` keys: it sorts the keys by radix (two
  bytes a pass, passes of equal bytes left out) and adds the counts of equal
  ones, again whenever as many keys have come in as it holds.
* Scores, the dropping of parts of longer phrases and the ranks are joins and
  aggregations of the counted phrases. Ranks are cut within salted parts of a
  language first, so no task has a whole language.

Arithmetic is on integers: counts are 64 bits, products decimals of 38 digits.

Rows: a null text is an empty one, a null language ``und``. Repeated rows and
null ids count like others. A text without a word, or of one word a piece, gives
no phrase; an empty table gives no rows. Long texts are cut at the ends of
pieces; a piece is held whole. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import discard, small_batches, written

#: Bytes of text in a block, and of all a task holds before it makes blocks of less.
BLOCK, HELD = 4 << 20, 16 << 20
#: Starts of phrases that are counted at a time, keys of a range, and keys sampled for the ranges' bounds from about so many blocks.
STARTS, RANGE, SAMPLED, SAMPLED_BLOCKS = 1 << 19, 1 << 20, 1 << 17, 48
#: Parts of a language whose first phrases are found apart.
SALTS = 32
WIDTH = 24
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in lower case, and whether each begins a piece."""
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    kind = _KIND[data]
    word = kind == 0
    after, before = np.zeros(len(word), dtype=bool), np.zeros(len(word), dtype=bool)
    after[1:], before[:-1] = word[:-1], word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(word))]
    after[inner], before[inner - 1] = False, False
    starts, ends = np.flatnonzero(word & ~after), np.flatnonzero(word & ~before) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_LOWER[data[word]].tobytes()))
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else starts
    text = np.searchsorted(bounds, starts, side="right")
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (np.diff(piece) != 0) | (np.diff(text) != 0)
    return words, first


def _cut(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, those longer than ``BLOCK`` in parts that end where a piece does."""
    long = np.flatnonzero(np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]) > BLOCK)
    at = 0
    for i in long:
        if i > at:
            yield texts.slice(at, i - at)
        raw, begin = np.frombuffer(texts[int(i)].as_buffer(), dtype=np.uint8), 0
        ends = np.flatnonzero(_KIND[raw] == 2) + 1
        while begin < len(raw):
            found = ends[(ends > begin) & (ends <= begin + BLOCK)][-1:] if len(raw) - begin > BLOCK else np.array([len(raw)])
            if not len(found):  # a piece longer than a block
                found = ends[ends > begin][:1]
            stop = int(found[0]) if len(found) else len(raw)
            yield pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, stop - begin], dtype=np.int32).tobytes()), pa.py_buffer(raw[begin:stop].tobytes()))
            begin = stop
        at = int(i) + 1
    if at < len(texts):
        yield texts.slice(at)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, n, words, counts, codes): texts of a language as places in its list of words, -1 between pieces."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    number, packer = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)

    def made(lang: str) -> pa.RecordBatch:
        nonlocal number
        words, first = _split(pa.concat_arrays(held.pop(lang)))
        size.pop(lang)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        breaks = np.cumsum(first)
        stream = np.full(len(codes) + int(breaks[-1]) if len(codes) else 0, -1, dtype=np.int32)
        stream[np.arange(len(codes)) + breaks] = codes
        number += 1
        listed = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), pa.array([len(codes)]), pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), listed(np.bincount(codes, minlength=len(coded.dictionary)), pa.int64()), pa.array([packer.compress(stream.tobytes())])], names=["block", "lang", "n", "words", "counts", "codes"])

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        index, texts = coded.indices.to_numpy(), batch.column(1)
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            own = texts if len(coded.dictionary) == 1 else texts.take(pa.array(np.flatnonzero(index == i)))
            for part in _cut(own):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + part.nbytes
                if size[lang] >= BLOCK:
                    yield made(lang)
        while sum(size.values()) > HELD:
            yield made(max(size, key=size.__getitem__))
    for lang in list(held):
        yield made(lang)


def _in_ids(ids: pa.Table, block: pa.Table) -> pa.Table:
    """(block, lang, n, ids, codes): a block's words as places in the sorted list of its frequent words' ids, -1 where pieces break."""
    out = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("ids", pa.binary()), ("codes", pa.binary())])
    if not ids.num_rows or not block.num_rows:
        return out.empty_table()
    packer = zstandard.ZstdCompressor(level=1)
    place, number = ids["place"].to_numpy(), ids["id"].to_numpy()
    order = np.argsort(number, kind="stable")
    codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block["codes"][0].as_py()), dtype=np.int32)
    new = np.full(int(codes.max(initial=-1)) + 2, -1, dtype=np.int32)
    new[place[order]] = np.arange(len(order))
    codes = new[codes]  # the last entry stands for -1
    codes = codes[(codes >= 0) | np.concatenate([[True], codes[:-1] >= 0])]
    kept = int((codes >= 0).sum())
    return pa.table([block["block"], block["lang"], pa.array([kept]), pa.array([packer.compress(number[order].astype("<i8").tobytes())]), pa.array([packer.compress(codes.tobytes())])], schema=out)


def _keys(ids: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts), sorted, of the pairs and then of the triples that begin at each stretch of ``STARTS`` places."""
    many = len(ids)
    for at in range(0, len(codes), STARTS):
        c = codes[at : at + STARTS + 2].astype(np.int64)
        pair = c[:-1] * many + c[1:]
        begin = np.flatnonzero((c[:-1] >= 0) & (c[1:] >= 0))
        begin = begin[begin < STARTS]
        two, which, n2 = np.unique(pair[begin], return_inverse=True, return_counts=True)
        third = np.concatenate([c, [-1]])[begin + 2]
        three, n3 = np.unique((which * many + third)[third >= 0], return_counts=True)
        for code, last, n in ((two, None, n2), (two[three // many], three % many, n3)):
            keys = np.zeros((len(n), 3), dtype=">i8")
            keys[:, 0], keys[:, 1] = ids[code // many], ids[code % many]
            if last is not None:
                keys[:, 2] = ids[last]
            yield keys.view(f"S{WIDTH}").ravel(), n


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, codes) of each block."""
    raw = zstandard.ZstdDecompressor().decompress
    for ids, codes in zip(batch.column("ids").to_pylist(), batch.column("codes").to_pylist(), strict=True):
        yield np.frombuffer(raw(ids), dtype="<i8"), np.frombuffer(raw(codes), dtype=np.int32)


def _bounds(coded: DataFrame, keys: int, ranges: int) -> np.ndarray:
    """Keys that part the ranges, from a sample; at most ``ranges`` - 1 of ``WIDTH`` bytes each."""
    blocks = coded.count()
    some = coded.where(F.pmod(F.xxhash64("block"), F.lit(1 << 31)) < F.lit(int((1 << 31) * min(1.0, SAMPLED_BLOCKS / max(1, blocks)))))
    every = max(1, int(keys * min(1.0, SAMPLED_BLOCKS / max(1, blocks))) // SAMPLED)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, codes in _opened(batch):
                for found, _ in _keys(ids, codes):
                    yield pa.RecordBatch.from_arrays([pa.array(found[every // 2 :: every].astype(object), pa.binary())], names=["key"])

    found = some.mapInArrow(sample, "key binary").toArrow()["key"].to_pylist()
    found = np.sort(np.array(found, dtype=f"S{WIDTH}"))
    return np.unique(found[np.arange(1, ranges) * len(found) // ranges]) if len(found) else found


def sorted_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (rows of bytes) in order, with the sums of their counts: a radix sort from the last two bytes to the first, then runs of equal keys."""
    if not len(keys):
        return keys, counts
    digits, order = keys.view(">u2"), None
    for d in reversed(range(digits.shape[1])):
        column = digits[:, d].astype(np.uint16)
        if (column == column[0]).all():
            continue
        order = np.argsort(column, kind="stable") if order is None else order[np.argsort(column[order], kind="stable")]
    if order is not None:
        keys, counts = keys[order], counts[order]
    wide = keys.view("<u8")
    starts = np.flatnonzero(np.concatenate([[True], (wide[1:] != wide[:-1]).any(axis=1)]))
    return keys[starts], np.add.reduceat(counts, starts)


def _counted(coded: DataFrame, least: int) -> DataFrame:
    """(a, b, c, f): pairs (c = 0) and triples of ids that occur ``least`` times or more."""
    spark = coded.sparkSession
    keys = 2 * (coded.agg(F.sum("n")).first()[0] or 0)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // RANGE))
    held = spark.sparkContext.broadcast(_bounds(coded, keys, ranges))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for ids, codes in _opened(batch):
                for found, n in _keys(ids, codes):
                    cuts = np.concatenate([[0], np.searchsorted(found, held.value), [len(found)]])
                    some = np.flatnonzero(np.diff(cuts))
                    # bytes of equal place stand together, so that they pack well
                    planes = [packer.compress(np.ascontiguousarray(found[cuts[r] : cuts[r + 1]].view(np.uint8).reshape(-1, WIDTH).T).tobytes()) for r in some]
                    counts = [packer.compress(n[cuts[r] : cuts[r + 1]].astype("<i8").tobytes()) for r in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(planes, pa.binary()), pa.array(counts, pa.binary())], names=["range", "keys", "counts"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = zstandard.ZstdDecompressor().decompress
        keys, counts, waiting = np.zeros((0, WIDTH), dtype=np.uint8), np.zeros(0, dtype=np.int64), []

        def taken() -> tuple[np.ndarray, np.ndarray]:
            both = [(keys, counts), *waiting]
            return sorted_counts(np.concatenate([k for k, _ in both]), np.concatenate([n for _, n in both]))

        come = 0
        for batch in batches:
            for planes, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = np.frombuffer(raw(n), dtype="<i8")
                waiting.append((np.frombuffer(raw(planes), dtype=np.uint8).reshape(WIDTH, -1).T, n))
                come += len(n)
                if come >= max(len(keys), RANGE // 2):
                    keys, counts = taken()
                    waiting, come = [], 0
        keys, counts = taken()
        keys, counts = keys[counts >= least], counts[counts >= least]
        ids = keys.view(">i8").astype(np.int64)
        yield from pa.table([*[pa.array(ids[:, i]) for i in range(3)], pa.array(counts)], names=["a", "b", "c", "f"]).to_batches(1 << 16)

    runs = coded.select("ids", "codes").mapInArrow(sent, "range int, keys binary, counts binary")
    return runs.repartitionById(ranges, F.col("range")).mapInArrow(merged, "a long, b long, c long, f long")


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, l and r those of its parts at the cut with the least
    score, floor(10^6 a a / (l r)), the shorter first part on ties; n counts all
    words of the language. A pair that lies in a triple with half its count or
    more is dropped. Order: score and a falling, then the phrase's bytes.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    blocks = written(texts.mapInArrow(_blocks, "block long, lang string, n long, words array<string>, counts array<long>, codes binary"), "blocks")
    totals = written(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counts = blocks.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("f")))).groupBy("lang", "word").agg(F.sum("f").alias("f"))
    words = written(counts.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id() + 1), "words")
    listed = blocks.select("block", "lang", F.posexplode("words").alias("place", "word"))
    ids = listed.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), "place", "id")
    coded = ids.groupBy("of").cogroup(blocks.select("block", "lang", "codes").groupBy("block")).applyInArrow(_in_ids, "block long, lang string, n long, ids binary, codes binary")
    coded = written(coded, "coded")
    discard(blocks)
    found = written(_counted(coded, least), "phrases")
    discard(coded)

    pairs, triples = found.where("c = 0"), found.where("c <> 0")
    inside = triples.select("a", "b", "f").union(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f"))
    longer = inside.groupBy("a", "b").agg(F.max("f").alias("most"))
    whole = pairs.join(longer, ["a", "b"], "left").where(F.col("most").isNull() | (100 * F.col("most") < 50 * F.col("f")))
    two = whole.select("a", "b", "c", "f", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    three = triples.join(pairs.select("a", "b", F.col("f").alias("start")), ["a", "b"]).join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("end")), ["b", "c"])
    each = two.unionByName(three.select(two.columns))
    for place in "abc":
        known = words.select(F.col("id").alias(place), F.col("word").alias(f"word_{place}"), F.col("f").alias(f"f_{place}"), *(["lang"] if place == "a" else []))
        each = each.join(known, place, "left" if place == "c" else "inner")
    single = F.col("start").isNull()
    # the cut after the first word, and in a triple the one after the second
    by_one = F.struct(F.col("f_a").alias("l"), F.when(single, F.col("f_b")).otherwise(F.col("end")).alias("r"))
    by_two = F.struct(F.col("start").alias("l"), F.col("f_c").alias("r"))
    cuts = each.withColumns({"one": by_one, "two": by_two})
    cuts = cuts.withColumns({"score_one": _score(F.col("f"), F.col("one.l"), F.col("one.r")), "score_two": _score(F.col("f"), F.col("two.l"), F.col("two.r"))})
    cut = F.when(single | (F.col("score_one") <= F.col("score_two")), F.struct("one.l", "one.r", F.col("score_one").alias("score"))).otherwise(F.struct("two.l", "two.r", F.col("score_two").alias("score")))
    scored = cuts.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("f").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    out = written(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(totals, words, found)
    return out

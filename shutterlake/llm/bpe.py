"""Byte-level BPE encoding and decoding.

A text is cut into words by the vocabulary's pattern. Each distinct word of the
table is encoded once, by folding ranked merges over its bytes with Spark
higher-order functions and a constant rank map (:func:`fold_word`). Documents are
held in blocks as indexes into the block's distinct words, in a work table that is
bucketed by block, so they are never shuffled; only each block's words go to the
tasks that fold them, by the part of the word's checksum, and their ids come back
packed. A loop with equal results inside the Arrow function that forms the blocks
(:func:`merge_word`) is kept beside it: it shuffles nothing and writes no work
table, but folds a word once in every block. Memory is bounded by ``BLOCK_WORDS``
and the longest document.

In Spark columns bytes are carried as strings of the characters U+0000 to U+00FF, one for each
byte, because Spark's string functions then work on bytes.

Rows: a null or empty text gives no ids and an empty decoded text. Repeated
rows, null ids and further columns are passed through unchanged. An unbroken
word of over ``FOLD_BYTES`` bytes takes the same merges from a heap,
since a fold's work grows with the square of the word's length.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.common import new_path, small_batches

#: Buckets of the constant map of merges; a lookup compares the few keys of one bucket.
BUCKETS = 16384
#: Words in a block.
BLOCK_WORDS = 500_000
#: Words in a block that shares folded words: those of a whole 16 MB split, since a larger block sends fewer words.
FOLDED_WORDS = 6_000_000
#: The longest word that is folded by Spark.
FOLD_BYTES = 60
#: Parts that the table's words are dealt by, and what stands between words in a text of them (no byte is this character).
PARTS, BETWEEN = 1024, "\u0100"
#: In the fold a piece is one character, that of its rank from here on; and what ends a word that is done.
FIRST_CHARACTER, ENDED = 0x10000, "\u0100"
#: Encoded words that a task keeps between blocks (some 10 MB), and "no such pair".
SEEN_WORDS, NO_RANK = 32_768, 1 << 31


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with lines of base64 piece and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def spark_pattern(pattern: str) -> str:
    """The pattern with Unicode white space for Java's ``\\s``."""
    return "(?U)" + pattern


@lru_cache(maxsize=4)
def splits(path: str) -> dict[bytes, int]:
    """For each piece of 2 to ``FOLD_BYTES`` bytes that merges lead to, the length of its left half in the last of them.

    Boundaries only go, so the merges within a piece are those of the piece by
    itself, and no other pair of halves ever meets in a word. Merging a pair
    everywhere at once needs the halves to have lower ranks than the piece, which is
    checked for every piece.
    """
    ranks, found = load_ranks(path), {}
    for piece, rank in ranks.items():
        if not 1 < len(piece) <= FOLD_BYTES:
            continue
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            pairs = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
            if (least := min(pairs)) == NO_RANK:
                break
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            if any(len(part) > 1 and ranks[part] > rank for part in parts):
                raise ValueError(f"the piece {piece!r} has a lower rank than a half of it")
            found[piece] = len(parts[0])
    return found


def in_order(path: str) -> bool:
    """Whether :func:`fold_word` does: all pieces come after the halves they are merged from, every byte is a piece, and ranks are few enough for characters."""
    try:
        splits(path)
    except ValueError:
        return False
    ranks = load_ranks(path)
    return all(bytes([b]) in ranks for b in range(256)) and max(ranks.values()) < 0x110000 - FIRST_CHARACTER


def _character(rank: int) -> str:
    return chr(FIRST_CHARACTER + rank)


@lru_cache(maxsize=4)
def _rank_rows(path: str) -> pa.Table:
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    ranks, cut = load_ranks(path), splits(path)
    for piece, rank in ranks.items():
        at = cut.get(piece)
        # a piece that no merge makes is found as a whole word only
        key, merged = piece.decode("latin-1"), _character(rank)
        if at:
            key = _character(ranks[piece[:at]]) + _character(ranks[piece[at:]])
            merged += key
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = merged
    return pa.table({"held": pa.array([[list(b.items()) for b in buckets]], pa.list_(pa.map_(pa.string(), pa.string())))})


@lru_cache(maxsize=4)
def _piece_json(path: str) -> str:
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return json.dumps(pieces)


def with_literal(table: Column, use: Callable[[Column], Column]) -> Column:
    """``use(table)`` with the large constant bound to a name, so that the plan holds it once."""
    return F.get(F.transform(F.array(table), use), F.lit(0))


def rank_table(path: str) -> Column:
    """The constant map of merges, in buckets by CRC-32 of the key: from a pair of pieces to what it becomes and the pair.

    Pieces are characters, so the least of several values is that of the least rank.
    Pieces that no merge makes, among them single bytes, are there by their bytes.

    It is the one value of a local table. Written as a literal, its megabytes
    would be spelled out in every description of a plan, and the driver keeps those
    of a thousand queries. Select it in a step of its own: Spark allows no subquery
    within a higher-order function, and puts the two steps together afterwards.
    """
    return SparkSession.active().createDataFrame(_rank_rows(path)).scalar()


def look_up(key: Column, table: Column) -> Column:
    """What the map of merges has for a key, or null."""
    return F.try_element_at(F.get(table, F.pmod(F.crc32(key), F.lit(BUCKETS)).cast("int")), key)


def fold_word(word: Column, table: Column, path: str) -> Column:
    """The ids of one word: merge the pair of least rank, the leftmost of equals, until none has one.

    The pieces are a string of one character each, so a merge is a replacement of
    two characters by one, and the order of characters is that of ranks. A round
    looks up every pair that stands side by side and merges the least, everywhere
    at once: a pair with the merged piece has a higher rank (see :func:`splits`),
    so it could not have come between two of these.
    """
    ranks = load_ranks(path)
    start = F.translate(word, "".join(map(chr, range(256))), "".join(_character(ranks[bytes([b])]) for b in range(256)))

    def merge(pieces: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(pieces) - 1), lambda i: F.substring(pieces, i, F.lit(2)))
        least = F.array_min(F.transform(pairs, lambda pair: look_up(pair, table)))
        merged = with_literal(least, lambda m: F.replace(pieces, F.substring(m, 2, 2), F.substring(m, 1, 1)))
        return F.when(F.endswith(pieces, F.lit(ENDED)), pieces).otherwise(F.coalesce(merged, F.concat(pieces, F.lit(ENDED))))

    def ids(pieces: Column) -> Column:
        return F.transform(F.split(F.rtrim(pieces, F.lit(ENDED)), ""), lambda c: F.ascii(c) - FIRST_CHARACTER)

    folded = F.aggregate(F.sequence(F.lit(1), F.length(word)), start, merge, ids)
    whole = look_up(word, table)
    return F.when(whole.isNotNull(), ids(whole)).when(F.length(word) > FOLD_BYTES, F.lit(None)).otherwise(folded)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold in Python; a word of over ``FOLD_BYTES`` bytes takes its merges from a heap of (rank, position)."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > FOLD_BYTES:
        return _merge_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) != NO_RANK:
        at = pairs.index(least)
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(pieces[at] + pieces[at + 1], NO_RANK)
        if at:
            pairs[at - 1] = ranks.get(pieces[at - 1] + pieces[at], NO_RANK)
    return [ranks[p] for p in pieces]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    size = len(word)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(size)]
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < size:
            both = pieces[i] + pieces[after[i]]
            if both in ranks:
                heapq.heappush(heap, (ranks[both], i, both))

    for i in range(size):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if pieces[i] is None or after[i] >= size or pieces[i] + pieces[after[i]] != both:
            continue
        gone = after[i]
        pieces[i], pieces[gone], after[i] = both, None, after[gone]
        if after[i] < size:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in pieces if p is not None]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray]]:
    """Runs of documents of about ``BLOCK_WORDS`` words: the documents, the bounds of their words, and the words, coded."""
    offsets = batch.column("words").offsets.to_numpy()
    start = 0
    while start < batch.num_rows:
        stop = start + 1
        while stop < batch.num_rows and offsets[stop + 1] - offsets[start] <= BLOCK_WORDS:
            stop += 1
        part = batch.slice(start, stop - start)
        words = part.column("words")
        yield part, words.offsets.to_numpy().astype(np.int64) - offsets[start], words.flatten().dictionary_encode()
        start = stop


def _gather(coded: pa.ListArray, index: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words at ``index``, and where each document's begin and end."""
    first = coded.offsets.to_numpy().astype(np.int64)
    counts = np.diff(first)[index]
    ends = np.concatenate([[0], np.cumsum(counts)])
    where = np.repeat(first[index] - ends[:-1], counts) + np.arange(int(ends[-1]))
    return coded.values.to_numpy()[where].astype(np.int32), ends[bounds]


def _rows(columns: list[pa.Array], ids: np.ndarray, cuts: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Output rows, some documents at a time."""
    for s in range(0, len(cuts) - 1, 256):
        e = min(s + 256, len(cuts) - 1)
        lists = pa.ListArray.from_arrays(pa.array(cuts[s : e + 1] - cuts[s], pa.int32()), pa.array(ids[cuts[s] : cuts[e]]))
        raw = [pa.array([ids[cuts[i] : cuts[i + 1]].astype("<u4").tobytes() for i in range(s, e)], pa.binary())] if "ids_bytes" in names else []
        yield pa.RecordBatch.from_arrays([c.slice(s, e - s) for c in columns] + [lists, *raw], names=names)


def _pack(at: np.ndarray) -> bytes:
    """32-bit numbers, deflated with their first bytes together, then their second ones, and so on."""
    return zlib.compress(at.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def _form_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with indexes into its block's distinct words, and for each block a row with the words of each part and one with the words' parts.

    Words are byte strings, in the order of their indexes within a part. A block has
    about ``FOLDED_WORDS`` words, of which only the distinct ones are held.
    """
    block, places, words = TaskContext.get().partitionId() << 33, {}, 0
    kinds = None

    def told() -> pa.RecordBatch:
        raw = [w.encode() for w in places]
        parts = np.array([zlib.crc32(w) % PARTS for w in raw], dtype=np.int32)
        order = np.argsort(parts, kind="stable")
        found, starts = np.unique(parts[order], return_index=True)
        texts = [BETWEEN.join(raw[i].decode("latin-1") for i in run) for run in np.split(order, starts)[1:]]
        n = len(found) + 1
        columns = [pa.array(np.full(n, block)), pa.array([*found.tolist(), None], pa.int32()), pa.array([*texts, None], pa.string()), *[pa.nulls(n, k) for k in kinds], pa.array([*[None] * (n - 1), _pack(parts)], pa.binary()), pa.array([True] * n)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for part, bounds, coded in (x for batch in batches for x in _blocks(batch)):
        if words and words + bounds[-1] > FOLDED_WORDS:
            yield told()
            block, places, words = block + 1, {}, 0
        names, kept = ["home", "part", "words", *part.schema.names[:-1], "at", "own"], part.columns[:-1]
        kinds, words = [c.type for c in kept], words + int(bounds[-1])
        known = np.array([places.setdefault(w, len(places)) for w in coded.dictionary.to_pylist()], dtype=np.int32)
        at = known[coded.indices.to_numpy(zero_copy_only=False)]
        packed = pa.array([_pack(at[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), *kept, packed, pa.array([False] * n)], names=names)
    # a block of empty documents too has its row
    if kinds is not None:
        yield told()


def _bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``rows`` as a work table in buckets of ``key``, so that what goes by that key reads them where they are.

    The catalog's entry goes at once; the files stay as the work table.
    """
    spark, path, entry = rows.sparkSession, new_path(rows.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    out._work_path = path
    return out


def _pack_ids(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (block, part, pos, ids, long) in that order as (block, part, pos, packed): the ids of a run of words of one block and part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("ids")
            if coded.null_count:
                ranks = load_ranks(path)
                coded = pa.array([merge_word(w.encode("latin-1"), ranks) if x is None else x for x, w in zip(coded.to_pylist(), batch.column("long").to_pylist(), strict=True)], pa.list_(pa.int32()))
            first, ids = coded.offsets.to_numpy(), coded.values.to_numpy().astype(np.int32)
            block, part = batch.column("block").to_numpy(), batch.column("part").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0)) + 1])
            ends = [*starts[1:], batch.num_rows]
            packed = [_pack(np.concatenate([[b - a], np.diff(first[a : b + 1]), ids[first[a] : first[b]]]).astype(np.int32)) for a, b in zip(starts, ends, strict=True)]
            columns = [pa.array(block[starts]), pa.array(part[starts]), batch.column("pos").take(pa.array(starts)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "pos", "packed"])

    return pack


def _fold_once(cut: DataFrame, inner: list[T.StructField], out: T.StructType, path: str) -> DataFrame:
    """The rows of ``out`` from documents cut into words: each distinct word of the table is folded by Spark once.

    The blocks are a work table. A part's words go to one task, with the places that
    hold them, and their ids from there to the blocks, whose documents are put together.
    """
    tasks = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = [T.StructField("home", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("words", T.StringType()), *inner, T.StructField("at", T.BinaryType()), T.StructField("own", T.BooleanType())]
    blocks = _bucketed(cut.mapInArrow(_form_blocks, T.StructType(fields)), "blocks", "home", tasks)
    # dealt by the part; grouping by word and part, and going back to the blocks, then need no other shuffle
    dealt = blocks.where("words is not null").select(F.col("home").alias("block"), "part", "words").repartition(tasks, "part")
    words = dealt.select("block", "part", F.posexplode(F.split("words", BETWEEN)).alias("pos", "word"))
    distinct = words.groupBy("word", "part").agg(F.collect_list(F.struct("block", "pos")).alias("held"))
    ranked = distinct.select("word", "part", "held", rank_table(path).alias("ranks"))
    folded = ranked.select("word", "part", "held", with_literal(F.col("ranks"), lambda table: fold_word(F.col("word"), table, path)).alias("ids"))
    joined = folded.select("part", "ids", F.when(F.col("ids").isNull(), F.col("word")).alias("long"), F.inline("held"))
    joined = joined.select("block", "part", "pos", "ids", "long")
    told = joined.sortWithinPartitions("block", "part", "pos").mapInArrow(_pack_ids(path), "block long, part int, pos int, packed binary")
    docs = blocks.where("words is null").select("home", *[f.name for f in inner], "at", "own")

    def put_together(docs: pa.Table, told: pa.Table) -> pa.Table:
        own = docs["own"].to_numpy()
        parts = _unpack(docs["at"][int(np.flatnonzero(own)[0])].as_py())
        docs = docs.filter(pa.array(~own))
        told = told.sort_by([("part", "ascending"), ("pos", "ascending")])
        counts, ids = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for packed in told["packed"]:
            run = _unpack(packed.as_py())
            counts.append(run[1 : 1 + run[0]])
            ids.append(run[1 + run[0] :])
        # the words came by part; back to the order of their indexes
        sizes, place = np.concatenate(counts), np.empty(len(parts), np.int64)
        place[np.argsort(parts, kind="stable")] = np.arange(len(parts))
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        coded = pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(ids)))
        made, at, words, start = [], [], 0, 0
        for i, packed in enumerate(docs["at"]):
            at.append(place[_unpack(packed.as_py())])
            words += len(at[-1])
            if words >= BLOCK_WORDS or i + 1 == docs.num_rows:
                every, cuts = _gather(coded, np.concatenate(at), np.cumsum([0, *map(len, at)]))
                part = docs.slice(start, i + 1 - start)
                made += _rows([part[f.name].combine_chunks() for f in inner], every, cuts, out.names)
                at, words, start = [], 0, i + 1
        return pa.Table.from_batches(made)

    return docs.groupBy("home").cogroup(told.groupBy("block")).applyInArrow(put_together, out)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", ids_bytes: str | None = None, higher_order: bool = True) -> DataFrame:
    """``docs`` with the ids of ``text`` in the array column ``ids``, and the text's column dropped.

    ``ids_bytes`` names a further binary column with the ids as little-endian
    unsigned 32-bit integers. A column of ``docs`` with either name is replaced.
    ``higher_order`` folds the table's distinct words by :func:`fold_word` in Spark;
    otherwise, and for a vocabulary that is not :func:`in_order`, each task folds
    its own by :func:`merge_word` in the Arrow function.
    """
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in (text, ids, ids_bytes)]
    # the columns that are kept travel under names of their own, so none can clash
    inner = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)]
    words = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(spark_pattern(pattern)), F.lit(0))
    cut = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(keep)], words.alias("words"))
    out = T.StructType([*inner, T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("ids_bytes", T.BinaryType())] if ids_bytes else [])])

    def fold_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = load_ranks(path), {}
        for batch in batches:
            for part, bounds, coded in _blocks(batch):
                folded = []
                for word in coded.dictionary.to_pylist():
                    got = seen.get(word)
                    if got is None:
                        got = merge_word(word.encode(), ranks)
                        if len(seen) < SEEN_WORDS:
                            seen[word] = got
                    folded.append(got)
                every, cuts = _gather(pa.array(folded, pa.list_(pa.int32())), coded.indices.to_numpy(zero_copy_only=False), bounds)
                yield from _rows(part.columns[:-1], every, cuts, out.names)

    if higher_order and in_order(path):
        done = _fold_once(cut, inner, out, path)
    else:
        done = cut.mapInArrow(fold_here, out)
    names = [F.col(f"c{i}").alias(f.name) for i, f in enumerate(keep)]
    return done.select(*names, F.col("ids").alias(ids), *([F.col("ids_bytes").alias(ids_bytes)] if ids_bytes else []))


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids: its pieces, concatenated. An unknown id gives null; null gives null."""
    table = F.from_json(F.lit(_piece_json(path)), T.ArrayType(T.StringType()))
    # an unknown id becomes what is no byte
    joined = with_literal(table, lambda pieces: F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "", BETWEEN))
    return F.encode(with_literal(joined, lambda text: F.when(~F.contains(text, F.lit(BETWEEN)), text)), "ISO-8859-1")

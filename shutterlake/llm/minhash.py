"""Near-duplicates by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so 60 permutations fill 120 rows, banded by four. Either value
agrees with probability J, so a pair at J = 0.85 shares one of the 30 bands but
for 1 in 10^9 cases (0.8: 1 in 10^7). Every link is confirmed on the full
shingle sets.

Documents with equal shingle sets form a class and one of them stands for it.
Candidates are verified in rounds. First each class is compared with the least
id of its bands, which joins up groups of copies with one comparison for each
member. Only bands whose members are then still in several components go on, and
of these only members that have enough shingles in common with other candidates
to link at all. Small bands are compared pair by pair across components. Large
ones are cut into blocks, and a pair of blocks is compared by one product of its
shingle matrices, which sends each set once to each block and no pairs at all;
only a spanning forest of the links comes out. No candidate pair across
components is left out.

Rows: a null or empty text has no shingles and links with nothing. Rows that
share an id are one node. A row with a null id links with nothing, has a null
component, and is kept. Further columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import connected_components, discard, slices, small_batches, written

PERMUTATIONS, ROWS = 60, 4
#: Members up to which a band is compared pair by pair, members and shingles in a block beyond that, and columns multiplied at a time.
FEW, BLOCK, BLOCK_SHINGLES, COLUMNS = 24, 1_024, 1_000_000, 4_096

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _finish(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of fewer words, the whole sequence is one."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(width, len(h))
    # the length is hashed too, so short texts never meet full shingles
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = _finish(out * _MIX[0] + h[k : len(h) - size + 1 + k] + _MIX[1])
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def band_hashes(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """One hash for each band of the min-max signature."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(len(factors), dtype=np.uint64)
    for s in range(0, len(shingles), 4096):
        part = shingles[s : s + 4096, None] * factors[None, :] + shifts[None, :]
        part ^= part >> np.uint64(29)
        part *= _MIX[2]
        np.minimum(low, part.min(axis=0), out=low)
        np.maximum(high, part.max(axis=0), out=high)
    rows = np.concatenate([low, high]).reshape(-1, ROWS)
    out = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        out = _finish(out * _MIX[0] + rows[:, k])
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) of ``docs`` (doc_id, text); set_a and set_b identify the shingle set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _permutations()
        for batch in slices(batches, 1_024):
            sizes, first, second, bands = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                both = xxhash.xxh3_128_digest(s.tobytes())
                first.append(int.from_bytes(both[:8], "big", signed=True))
                second.append(int.from_bytes(both[8:], "big", signed=True))
                bands.append(band_hashes(s, factors, shifts).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(bands) if bands else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of ``docs`` (doc_id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                found = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(1).slice(s, 64)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, 64), lists], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, shingles array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _in_mixed_bands(members: DataFrame, links: DataFrame) -> DataFrame:
    """(band, rep, n, part, top) of the members of bands whose members are in several components; top is the band's largest."""
    parts = connected_components(links)
    placed = written(members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("part")), "placed")
    sizes = placed.groupBy("band", "part").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("size", "part")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("band", F.col("top.part").alias("top"))
    mixed = written(mixed, "mixed")
    inside = written(placed.join(mixed, "band"), "inside")
    discard(parts, placed, mixed)
    return inside


def _linkable(inside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members that can link at all: shingles that no other candidate has are in no intersection.

    With u such shingles of n, no similarity exceeds (n - u) / n, so this drops no link.
    """
    reps = inside.select(F.col("rep").alias("doc_id")).distinct()
    own = sets.join(reps, "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("shingle"))
    alone = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("rep")).where("times = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("u"))
    sizes = inside.select("rep", "n").distinct().join(alone, "rep", "left")
    return written(sizes.where(100 * (F.col("n") - F.coalesce("u", F.lit(0))) >= percent * F.col("n")).select("rep"), "linkable")


def _connections(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the least index that it is connected with by links; exact, by products of the sets' matrices."""
    sizes = np.array([len(x) for x in sets], dtype=np.float64)
    codes, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    # a shingle of one set is in no intersection
    place = np.cumsum(times > 1) - 1
    told = np.flatnonzero(times[at] > 1)
    rows, cols = rows[told], place[at[told]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for c in range(0, int(cols[-1]) + 1 if len(cols) else 0, COLUMNS):
        lo, hi = np.searchsorted(cols, (c, c + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[rows[lo:hi], cols[lo:hi] - c] = 1
        common += part @ part.T
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    labels = np.arange(len(sets))
    while True:
        least = np.where(linked, labels[None, :], len(sets)).min(axis=1)
        least = np.minimum(labels, least)
        if (least == labels).all():
            return labels
        labels = least


def _compare_crowds(inside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect the members (band, rep, members, shingles) of large bands wherever links do."""
    # a pair of blocks is bounded by its shingles as well, since sets may be long
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(BLOCK), F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    own = inside.select("band", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("i"))
    pairs = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = pairs.select("band", "rep", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    rows = placed.join(sets.withColumnRenamed("doc_id", "rep"), "rep")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        reps = rows["rep"].to_numpy()
        root = _connections([np.asarray(x) for x in rows["shingles"]], percent)
        some = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": reps[some], "b": reps[root[some]]})

    found = rows.groupBy("band", "lo", "hi").applyInPandas(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, and set_size, the documents with an equal set.

    Links are pairs with 100 * intersection >= percent * union of their sets of
    ``width``-word shingles; a component is named by its least id.
    """
    small_batches(docs.sparkSession)
    signed = written(signatures(docs, width), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"), F.countDistinct("doc_id").alias("set_size")), "classes")
    bands = classes.select("rep", "n", F.explode("bands").alias("band"))
    crowded = bands.groupBy("band").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("members")).where("members > 1")
    crowded = written(crowded, "crowded")
    members = written(bands.join(crowded, "band").select("band", "rep", "n", "low"), "members")

    # the texts of the candidates, and no others, are read again
    # (their ids are written, so that their exact size decides whether the texts are shuffled)
    wanted = written(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    chosen = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    sets = shingle_sets(chosen, width).where(F.size("shingles") > 0)
    sets = written(sets, "sets")
    discard(wanted)

    first = members.where("rep <> low").groupBy("rep").agg(F.min("low").alias("low")).select(F.col("low").alias("a"), F.col("rep").alias("b"))
    links = written(_confirm(first, sets, percent), "links")
    inside = _in_mixed_bands(members, links)
    if not inside.isEmpty():
        open_ends, before, wide = _linkable(inside, sets, percent), members, inside
        members = written(wide.select("band", "rep", "n").join(open_ends, "rep"), "members")
        inside = _in_mixed_bands(members, links)
        discard(before, wide, open_ends)
    crowds = inside.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where(F.col("members") > FEW)
    crowds = written(crowds, "crowds")
    if not crowds.isEmpty():
        before, wide = links, inside
        links = written(links.union(_compare_crowds(inside.join(crowds, "band"), sets, percent)), "links")
        # what crowded bands hold is settled now
        inside = written(wide.join(crowds, "band", "left_anti"), "inside")
        discard(before, wide)
    discard(crowds)
    if not inside.isEmpty():
        # of two members in different parts, one at least is outside the band's largest part
        x, y = inside.where("part <> top").alias("x"), inside.alias("y")
        apart = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.part") != F.col("y.part")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
        pairs = apart.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
        before = links
        links = written(links.union(_confirm(pairs, sets, percent)), "links")
        discard(before)

    joined = connected_components(links)
    same = full.select("doc_id", "set_a", "set_b").join(classes.select("set_a", "set_b", "rep", "set_size"), ["set_a", "set_b"])
    same = same.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("part"), "set_size")
    out = _by_document(signed, same)
    discard(signed, classes, crowded, members, sets, links, inside, joined)
    return out


def _by_document(signed: DataFrame, same: DataFrame) -> DataFrame:
    """Carry the components of classes over to rows; an id with several texts joins their components."""
    shared = same.groupBy("doc_id").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("set_size").alias("set_size"))
    shared = written(shared, "shared")
    several = same.join(shared.where("low <> high").select("doc_id", "low"), "doc_id").where("part <> low").select(F.col("part").alias("a"), F.col("low").alias("b"))
    several, merged, found = written(several, "several"), None, shared
    if not several.isEmpty():
        merged = connected_components(several)
        shared = shared.join(merged, shared["low"] == merged["node"], "left").select("doc_id", F.coalesce("component", "low").alias("low"), "set_size")
    out = signed.select("doc_id", "n_shingles").join(shared.select("doc_id", "low", "set_size"), "doc_id", "left")
    component = F.coalesce("low", "doc_id")
    out = written(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("set_size", F.lit(1)).cast("long").alias("set_size")), "near")
    discard(found, several, *([merged] if merged is not None else []))
    return out

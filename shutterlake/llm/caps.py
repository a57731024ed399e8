"""Embedding near-dedup with spherical-cap filters.

The filter directions are a structured random product code: the rotated space is
cut into ``BLOCKS`` parts with ``CODES`` random directions each, and a filter
takes one direction of each part, so a million filters need 128 short vectors.
A vector's score under a filter is a sum over the parts; list decoding finds all
filters whose cap holds the vector, that is, whose score reaches the vector's
own threshold, its ``LIST``-th best. The height is a vector's own because one
height for all would serve them too unevenly: at 64 dimensions and 32 filters on
average some vectors lie in over a thousand caps and others in none, and a code
misses 45 pairs of a hundred at the threshold instead of under one. Vectors that share a filter are candidates,
and a link is a candidate pair with cosine >= threshold in double precision.

At 64 dimensions a pair at cosine 0.95 shares 13 of 32 filters on average and
misses all of them in under one case of a hundred. So there are several
independent codes: as many as bring the misses of pairs at the threshold, as
measured on random pairs of the dimension, down to ``MISSES``. Where one code
misses more than ``POOR``, which is in few dimensions, the filters are instead
the cells of a grid that the ball around a vector reaches whose radius is half
the greatest distance of a link. The middle of a link lies in both balls, so its
cell is in both lists and no link is missed.

The more vectors there are, the more directions a part has: ``ROOM`` filters a
vector, so that the vectors that share a filter by chance do not grow with the
table, up to where a code would miss more than ``RARE``.

Candidates of a filter with up to ``FEW`` members are pairs. The members of a
fuller filter (a cluster of near copies) are compared in blocks, two at a time,
by a matrix product; a pair counts under the least full filter that both share,
and what leaves a block is each member's number of links and a spanning forest,
never the pairs. So neither a task nor what is written grows with the square of
a cluster, though the products' work does, as every link is counted.

Equal vectors form a class that is compared once. Rows: vectors that are null,
zero, or hold null or non-finite components link with nothing, nor do rows with
a null id. Vectors of different length are never linked. Rows that share an id
are one node. Labels and further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import connected_components, discard, small_batches, written

BLOCKS, CODES, LIST, THRESHOLD = 4, 32, 32, 0.95
#: The share of pairs at the threshold that all codes together may miss, and that one may at most.
MISSES, POOR = 1e-6, 0.05
#: Filters a vector, and the share of pairs that one code may miss for it.
ROOM, RARE = 64, 0.15
#: Members up to which a filter's candidates are pairs, and members of a block of a fuller one.
FEW, BLOCK = 64, 1024
#: Random pairs that the misses of one code are measured on; coordinates that the grid cuts.
TRIALS, AXES = 4000, 5

_CODES: dict[tuple[int, int, int], tuple[np.ndarray, list[np.ndarray]]] = {}
_MISSED: dict[tuple[int, int, float, int], float] = {}


def _code(size: int, number: int = 0, wide: int = CODES) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotation and ``wide`` directions a part of code ``number`` for vectors of ``size`` components; the same everywhere."""
    if (size, number, wide) not in _CODES:
        draw = np.random.default_rng([size, number] if number else size)
        rotation, _ = np.linalg.qr(draw.normal(size=(size, size)))
        parts = []
        for part in np.array_split(np.arange(size), min(BLOCKS, size)):
            directions = draw.normal(size=(wide, len(part)))
            parts.append(directions / np.linalg.norm(directions, axis=1, keepdims=True))
        _CODES[size, number, wide] = rotation, parts
    return _CODES[size, number, wide]


def decode_filters(vectors: np.ndarray, keep: int = LIST, number: int = 0, wide: int = CODES) -> np.ndarray:
    """The numbers of the ``keep`` filters of one code with the best scores, for each unit vector."""
    size = vectors.shape[1]
    rotation, parts = _code(size, number, wide)
    rotated = vectors @ rotation.T
    scores, ids, at = np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1), dtype=np.int64), 0
    for directions in parts:
        own = rotated[:, at : at + directions.shape[1]] @ directions.T
        at += directions.shape[1]
        best = np.argsort(-own, axis=1, kind="stable")[:, :keep]
        # of sorted lists, only pairs of ranks i * j <= keep can be among the best sums
        i, j = np.nonzero((np.arange(scores.shape[1])[:, None] + 1) * (np.arange(best.shape[1])[None, :] + 1) <= keep)
        sums = scores[:, i] + np.take_along_axis(own, best, axis=1)[:, j]
        both = ids[:, i] * wide + best[:, j]
        order = np.argsort(-sums, axis=1, kind="stable")[:, :keep]
        scores, ids = np.take_along_axis(sums, order, axis=1), np.take_along_axis(both, order, axis=1)
    return ids


def missed_by_code(size: int, keep: int = LIST, threshold: float = THRESHOLD, wide: int = CODES) -> float:
    """The share of random pairs at the threshold that share no filter of one code."""
    if (size, keep, threshold, wide) not in _MISSED:
        draw = np.random.default_rng(size)
        x, y = draw.normal(size=(2, TRIALS, size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= x * (x * y).sum(axis=1, keepdims=True)
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        a, b = decode_filters(x, keep, wide=wide), decode_filters(y, keep, wide=wide)
        shared = np.array([np.isin(p, q).any() for p, q in zip(a, b, strict=True)])
        _MISSED[size, keep, threshold, wide] = max(1, int((~shared).sum())) / TRIALS
    return _MISSED[size, keep, threshold, wide]


def code_shape(size: int, keep: int = LIST, threshold: float = THRESHOLD, total: int = 0) -> tuple[int, int]:
    """(directions a part, codes) for a table of ``total`` vectors; no codes where one is too poor.

    Together the codes miss ``MISSES`` of the pairs at the threshold.
    """
    if missed_by_code(size, keep, threshold) > POOR:
        return CODES, 0
    wide = max(CODES, int(np.ceil((total * ROOM) ** (1 / BLOCKS))))
    while wide > CODES and missed_by_code(size, keep, threshold, wide) > RARE:
        wide = max(CODES, wide * 3 // 4)
    return wide, int(np.ceil(np.log(MISSES) / np.log(missed_by_code(size, keep, threshold, wide))))


def grid_filters(vectors: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The numbers of the grid's cells that each unit vector's ball reaches; a cell may be named twice."""
    # a little more than the distance of a link, for rounding
    side = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    cells, per_axis = np.zeros((len(vectors), 1), dtype=np.int64), int(2 / side) + 4
    # a cell's number fits 64 bits
    for axis in range(min(AXES, vectors.shape[1], int(62 / np.log2(per_axis)))):
        at = vectors[:, axis, None] + np.array([-0.5, 0.5]) * side
        own = np.floor((at + 1) / side).astype(np.int64) + 1
        cells = (cells[:, :, None] * per_axis + own[:, None, :]).reshape(len(vectors), -1)
    return cells


def list_filters(vectors: np.ndarray, keep: int = LIST, threshold: float = THRESHOLD, total: int = 0) -> np.ndarray:
    """All filters that each unit vector is listed under, in a table of ``total`` vectors."""
    wide, count = code_shape(vectors.shape[1], keep, threshold, total)
    if not count:
        return grid_filters(vectors, threshold)
    return np.concatenate([decode_filters(vectors, keep, i, wide) + i * wide**BLOCKS for i in range(count)], axis=1)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def filters(vectors: DataFrame, keep: int = LIST, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, size, embedding, filters) of the rows that can link."""
    total = vectors.count()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                # a null component becomes NaN
                values = _matrix(part.column(1), size)
                largest = np.abs(values).max(axis=1)
                good = np.flatnonzero(np.isfinite(largest) & (largest > 0))
                if not len(good):
                    continue
                # scaled first, so that no norm over- or underflows
                values = values[good] / largest[good, None]
                ids = list_filters(values / np.linalg.norm(values, axis=1, keepdims=True), keep, threshold, total)
                taken = part.take(pa.array(good))
                offsets = pa.array(np.arange(len(good) + 1) * ids.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(np.full(len(good), size), pa.int32()), taken.column(1), pa.ListArray.from_arrays(offsets, pa.array(ids.ravel(), pa.int64()))], names=["vec_id", "size", "embedding", "filters"])

    known = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return known.mapInArrow(decode, "vec_id long, size int, embedding array<double>, filters array<long>")


def _cosines(pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs that carry both vectors x and y."""

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = np.diff(batch.column(2).offsets.to_numpy()), np.zeros(batch.num_rows)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                x, y = _matrix(part.column(2), size), _matrix(part.column(3), size)
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                out[rows] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "cosine"])

    return pairs.select("a", "b", "x", "y").mapInArrow(dot, "a long, b long, cosine double")


def _spanning(links: np.ndarray) -> np.ndarray:
    """For each member the first of its component; ``links`` is a symmetric boolean matrix."""
    root = np.arange(len(links))
    for first in np.flatnonzero(links.any(axis=1)):
        if root[first] != first:
            continue
        reached = np.zeros(len(links), dtype=bool)
        reached[first] = True
        new = np.array([first])
        while len(new):
            new = np.flatnonzero(links[new].any(axis=0) & ~reached)
            reached[new] = True
        root[reached] = first
    return root


def _share_earlier(members: np.ndarray, filters_of: np.ndarray, count: int) -> np.ndarray:
    """Whether two of ``count`` members share a filter; entries are (members[i], filters_of[i])."""
    shared = np.zeros((count, count), dtype=bool)
    found, column, times = np.unique(filters_of, return_inverse=True, return_counts=True)
    for low in range(0, len(found), 2048):
        of = (column >= low) & (column < low + 2048) & (times[column] > 1)
        holds = np.zeros((count, min(2048, len(found) - low)), dtype=np.float32)
        holds[members[of], column[of] - low] = 1
        shared |= holds @ holds.T > 0
    return shared


def _block_links(threshold: float):
    """Compares a block of a full filter with itself or another: (rep, root, linked) of the members."""

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        own, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
        lists, vectors = rows["crowded"].combine_chunks(), rows["embedding"].combine_chunks()
        reps, block, copies = (rows[c].to_numpy() for c in ("rep", "i", "copies"))
        units = _matrix(vectors, key[1].as_py())
        units = units / np.abs(units).max(axis=1, keepdims=True)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        links = np.triu(units @ units.T >= threshold, 1)
        links |= links.T
        if low != high:
            links &= block[:, None] != block[None, :]
        if links.any():
            entries = lists.flatten().to_numpy()
            holder = np.repeat(np.arange(len(reps)), np.diff(lists.offsets.to_numpy()))
            before = entries < own
            links &= ~_share_earlier(holder[before], entries[before], len(reps))
        some = np.flatnonzero(links.any(axis=1))
        root = _spanning(links)
        return pa.table({"rep": reps[some], "root": reps[root[some]], "linked": (links[some] @ copies).astype(np.int64)})

    return compare


def _crowd_links(members: DataFrame, crowded: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(rep, root, linked) of the ``members`` (filter, size, rep, n) of full filters; ``crowded`` has each member's full filters."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = members.select("filter", "size", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep", "filter"), blocks).cast("int").alias("i"))
    pairs = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = pairs.select("filter", "size", "rep", "i", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    rows = placed.join(classes.select("rep", "embedding", "copies"), "rep").join(crowded, "rep")
    return rows.groupBy("filter", "size", "lo", "hi").applyInArrow(_block_links(threshold), "rep long, root long, linked long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, keep: int = LIST) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding)."""
    small_batches(vectors.sparkSession)
    ids = vectors.select("vec_id")
    # two hashes name a vector
    decoded = filters(vectors, keep, threshold).withColumns({"ka": F.xxhash64("embedding"), "kb": F.xxhash64(F.lit(1), "embedding")})
    named = written(decoded.select("vec_id", "ka", "kb"), "named")
    equal = written(decoded.groupBy("ka", "kb").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"), F.first("embedding").alias("embedding"), F.first("size").alias("size"), F.first("filters").alias("filters")), "classes")
    caps = equal.select("rep", "size", F.explode(F.array_distinct("filters")).alias("filter"))
    full = written(caps.groupBy("filter", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW), "full")
    members = written(caps.join(full, ["filter", "size"]).select("filter", "size", "rep", "n"), "members")
    crowded = written(members.groupBy("rep").agg(F.collect_list("filter").alias("crowded")), "crowded")
    counted = written(_crowd_links(members, crowded, equal, threshold), "counted")

    few = caps.join(full.select("filter", "size"), ["filter", "size"], "left_anti")
    left, right = few.alias("l"), few.alias("r")
    shared = left.join(right, (F.col("l.filter") == F.col("r.filter")) & (F.col("l.size") == F.col("r.size")) & (F.col("l.rep") < F.col("r.rep")))
    pairs = shared.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()
    sides = equal.select("rep", "embedding").join(crowded, "rep", "left")
    x = sides.select(F.col("rep").alias("a"), F.col("embedding").alias("x"), F.col("crowded").alias("cx"))
    y = sides.select(F.col("rep").alias("b"), F.col("embedding").alias("y"), F.col("crowded").alias("cy"))
    # a pair that shares a full filter was counted there
    open_pairs = pairs.join(x, "a").join(y, "b").where(~F.coalesce(F.arrays_overlap("cx", "cy"), F.lit(False)))
    links = written(_cosines(open_pairs).where(F.col("cosine") >= threshold), "links")
    parts = written(connected_components(links.select("a", "b").union(counted.select("rep", "root").distinct())), "parts")
    sizes = equal.select("rep", "copies")
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    ends = ends.join(sizes.withColumnRenamed("rep", "other"), "other").select("rep", F.col("copies").alias("linked"))
    counts = ends.union(counted.select("rep", "linked")).groupBy("rep").agg(F.sum("linked").alias("linked"))
    classes = equal.select("ka", "kb", "rep", "copies").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    rows = named.join(classes, ["ka", "kb"]).select("vec_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = rows.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = ids.join(rows, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    done = written(out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True))), "near")
    discard(named, equal, full, members, crowded, counted, links, parts)
    return done

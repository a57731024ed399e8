"""An index of vectors for exact cosine search.

Vectors are scaled to length one, so that the order by cosine is the order by
distance. Each distinct vector lies in the cell of its nearest pivot, and a cell
knows how near and how far its vectors are from the pivot. Two bounds then tell
which cells cannot hold anything within a distance r of a query: by the triangle
inequality, those whose ring about the pivot the query's ball does not touch, and
since a cell's vectors are nearer to its pivot than to any other, those whose
border with the query's own cell is farther than r.

* :func:`search` reads the nearest cells that hold k vectors, takes the k-th
  distance found as r, and then reads only the cells that r cannot rule out.
* :func:`within` deals the distinct vectors as seeds to blocks, and sends each
  block the cells within the link's distance of some seed, not all cells.

Cells are folders, so a search's scan lists only its cells (partition filters).
A crowded cell is split into parts by hash, and the queries that meet it into
chunks, so a task holds two blocks of about ``BLOCK`` rows. Copies of a vector
are one row with their least ``KEEP`` keys: of equals, no more can be in a result.

Vectors that are null, empty or not finite are not indexed. A vector of zeros has
cosine 0 to all. Keys should be distinct and not null; equal cosines (to nine
places) go by key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.sources import work

#: Vectors to a cell, cells at most (their pivots are broadcast), and rounds that move pivots to the middle of a sample's cells.
CELL, MOST_CELLS, ROUNDS = 512, 4096, 3
#: Rows of a block, and keys kept of a vector; a search returns no more.
BLOCK, KEEP = 2048, 500
#: Blocks of seeds in a join of all, seeds in a block at most, and cosines held at a time.
SEED_BLOCKS, MOST_SEEDS, PRODUCT = 64, 16_384, 1 << 22
#: What the bounds allow for rounding.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """A built index; ``cells`` rows of pivots and what is known of each cell."""

    spark: SparkSession
    folder: str
    pivots: np.ndarray
    keys: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray
    ddl: str

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """(cell, part, vid, keys, embedding), of some cells only."""
        rows = self.spark.read.schema(self.ddl).parquet(f"{self.folder}/vectors")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def members(self) -> DataFrame:
        """(key, vid) of every vector."""
        return self.spark.read.parquet(f"{self.folder}/members")

    def drop(self) -> None:
        """Delete the index."""
        work.delete(self.spark, self.folder)


def _finite(embedding: Column) -> Column:
    plain = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) > 0) & plain


def _vid(embedding: Column) -> Column:
    """128 bits that tell vectors apart."""
    return F.concat(F.hex(F.xxhash64(embedding)), F.lit("."), F.hex(F.xxhash64(F.lit(1), embedding)))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists as rows of length one (zeros stay)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True, initial=0), 1e-300)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def _pivots(rows: DataFrame, count: int, total: int) -> np.ndarray:
    """Middles of ``count`` groups of a sample of four times as many distinct vectors."""
    share = min(1.0, 8 * count / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("vid"), F.lit(1 << 31)) < F.lit(int((1 << 31) * share))).select("vid", "embedding").dropDuplicates(["vid"])
    found = sample.orderBy("vid").limit(4 * count).toArrow()
    points = _matrix(found["embedding"]) if found.num_rows else np.zeros((1, 1))
    centres = points[:count].copy()
    for _ in range(ROUNDS if len(points) > count else 0):
        own = _distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def build(vectors: DataFrame, folder: str | None = None, cell: int = CELL) -> VectorIndex:
    """The index of (key, embedding), written to ``folder``."""
    spark = vectors.sparkSession
    folder = folder or work.new_path(spark, "vector-index")
    rows = vectors.where(_finite(F.col("embedding"))).select("key", _vid(F.col("embedding")).alias("vid"), "embedding")
    rows.select("key", "vid").write.parquet(f"{folder}/members")
    total = spark.read.parquet(f"{folder}/members").count()
    pivots = _pivots(rows, max(1, min(MOST_CELLS, total // cell)), total)
    held = spark.sparkContext.broadcast(pivots)
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("vid").orderBy("key"))).where(F.col("n") <= KEEP)
    distinct = few.groupBy("vid").agg(F.array_sort(F.collect_list("key")).alias("keys"), F.any_value("embedding").alias("embedding"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_matrix(batch.column(2)), held.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=1), pa.int32()), pa.array(far.min(axis=1))], names=["vid", "keys", "embedding", "cell", "distance"])

    kinds = dict(distinct.dtypes)
    flat = work.written(distinct.mapInArrow(placed, f"vid string, keys {kinds['keys']}, embedding {kinds['embedding']}, cell int, distance double"), "placed")
    known = flat.groupBy("cell").agg(F.sum(F.size("keys")).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    stats = known.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).toPandas().set_index("cell").reindex(range(len(pivots)))
    stats = stats.fillna({"n": 0, "low": np.inf, "high": -np.inf, "parts": 0})
    ddl = f"part int, vid string, keys {kinds['keys']}, embedding {kinds['embedding']}, cell int"
    meta = {"ddl": ddl, "pivots": pivots.tolist(), "keys": stats["n"].tolist(), "low": stats["low"].tolist(), "high": stats["high"].tolist(), "parts": stats["parts"].tolist()}
    parts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(meta["parts"])], "cell int, parts int")
    # a row for each cell, of which there are at most MOST_CELLS
    parted = flat.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part"), "vid", "keys", "embedding")
    parted.repartition("cell", "part").write.partitionBy("cell").parquet(f"{folder}/vectors")
    work.write_text(spark, f"{folder}/meta.json", json.dumps(meta))
    work.discard(flat)
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> VectorIndex:
    """An index that was written before."""
    meta = json.loads(work.read_text(spark, f"{folder}/meta.json"))
    pivots = np.array(meta["pivots"], dtype=np.float64).reshape(len(meta["pivots"]), -1)
    return VectorIndex(spark, folder, pivots, *(np.array(meta[c], dtype=np.float64) for c in ("keys", "low", "high", "parts")), meta["ddl"])


def index_of(vectors: DataFrame) -> VectorIndex:
    """The index of a table, built once for its files as they are and kept in the shared folder; built anew for what reads no files."""
    spark = vectors.sparkSession
    name = work.fingerprint(vectors, CELL, BLOCK, KEEP)
    if name is None:
        return build(vectors)
    folder = f"{work.shared_dir(spark)}/vector-index-{name}"
    if not work.exists(spark, folder):
        made = build(vectors)
        if not work.move(spark, made.folder, folder):  # another session was quicker
            made.drop()
    return opened(spark, folder)


def _bounds(index: VectorIndex, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of queries from the pivots, and from what a cell may hold at the nearest; infinite for empty cells."""
    if not index.keys.sum():
        return np.zeros((len(units), len(index.keys))), np.full((len(units), len(index.keys)), np.inf)
    far = _distances(units, index.pivots)
    least = np.maximum(far - index.high[None, :], index.low[None, :] - far)
    own = far.argmin(axis=1)
    apart = _distances(index.pivots[own], index.pivots)
    border = (far**2 - far.min(axis=1, keepdims=True) ** 2) / np.maximum(2 * apart, 1e-9)
    least = np.maximum(least, np.where(apart > 1e-9, border, 0))
    return far, np.where(index.keys[None, :] > 0, np.maximum(least - SLACK, 0), np.inf)


def _nearest_cells(index: VectorIndex, far: np.ndarray, k: int) -> np.ndarray:
    """For each query the nearest cells that together hold ``k`` keys, as a mask."""
    order = np.argsort(far, axis=1, kind="stable")
    before = np.cumsum(index.keys[order], axis=1) - index.keys[order]
    mask = np.zeros(far.shape, dtype=bool)
    np.put_along_axis(mask, order, (before < k) & (index.keys[order] > 0), axis=1)
    return mask


def _light(index: VectorIndex) -> VectorIndex:
    """The index without its session, to send to tasks."""
    return VectorIndex(None, index.folder, index.pivots, index.keys, index.low, index.high, index.parts, index.ddl)


def _probes(index: VectorIndex, queries: DataFrame, choose) -> DataFrame:
    """(cell, seed, query): each query (seed, query, further columns) with the cells that ``choose`` marks, given a batch and the two bounds."""
    held = index.spark.sparkContext.broadcast(_light(index))
    kinds = dict(queries.dtypes)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                row, cell = np.nonzero(choose(held.value, batch, *_bounds(held.value, _matrix(batch.column(1)))))
                for a in range(0, len(row), BLOCK):
                    some = batch.take(pa.array(row[a : a + BLOCK]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + BLOCK], pa.int32()), some.column(0), some.column(1)], names=["cell", "seed", "query"])

    return queries.mapInArrow(sent, f"cell int, seed {kinds['seed']}, query {kinds['query']}")


def _best(index: VectorIndex, probes: DataFrame, k: int, floor: float = -2.0, skip_self: bool = False) -> DataFrame:
    """(seed, key, similarity, near): of each block that a probe meets its ``k`` best keys with a cosine of ``floor`` or more."""
    spark = index.spark
    probes = work.written(probes, "probes")
    met = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_CELLS rows
    cut = spark.createDataFrame([(c, -(-n // BLOCK), int(index.parts[c])) for c, n in met.items()], "cell int, chunks int, parts int")
    left = probes.join(F.broadcast(cut), "cell").select(F.col("cell").alias("qc"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("qp"), F.pmod(F.xxhash64("seed"), F.col("chunks")).cast("int").alias("qk"), "seed", "query")
    right = index.vectors(sorted(met)).join(F.broadcast(cut), "cell").select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "keys", "embedding")
    kinds = dict(probes.dtypes) | dict(right.dtypes)
    key_kind = kinds["keys"][len("array<") : -1]

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["seed", "key", "similarity", "near"]
        lists = b["keys"].combine_chunks()
        if not a.num_rows or not len(lists.flatten()):
            return pa.table({"seed": a["seed"].slice(0, 0), "key": lists.flatten().slice(0, 0), "similarity": pa.array([], pa.float64()), "near": pa.array([], pa.float64())})
        keys, owner = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")
        keys, owner = keys.take(pa.array(order)), owner[order]
        sims = (_matrix(a["query"]) @ _matrix(b["embedding"]).T)[:, owner]
        near = np.round(sims, 9)
        near[sims < floor - 1e-9] = -np.inf
        if skip_self:
            near[a["seed"].to_numpy()[:, None] == keys.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
        most = min(k, near.shape[1])
        least = np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most, None]
        # of ties at the last place, the least keys
        above, tied = near > least, near == least
        taken = above | (tied & (np.cumsum(tied, axis=1) <= most - above.sum(axis=1, keepdims=True)))
        row, col = np.nonzero(taken & np.isfinite(near))
        return pa.table([a["seed"].take(pa.array(row)), keys.take(pa.array(col)), pa.array(sims[row, col]), pa.array(near[row, col])], names=names)

    return left.groupBy("qc", "qp", "qk").cogroup(right.groupBy("cell", "part", "chunk")).applyInArrow(product, f"seed {kinds['seed']}, key {key_kind}, similarity double, near double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("seed").orderBy(F.desc("near"), F.asc("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, with_self: bool = True) -> DataFrame:
    """(seed, key, similarity, rank): the ``k`` vectors (1 to 500) nearest to each query (key, embedding); ties by key."""
    k = max(1, min(KEEP, k))
    q = queries.where(_finite(F.col("embedding"))).select(F.col("key").alias("seed"), F.col("embedding").alias("query"))
    enough = k + (not with_self)
    home = lambda i, batch, far, least: _nearest_cells(i, far, enough)
    first = work.written(_best(index, _probes(index, q, home), k, skip_self=not with_self), "first")
    # with fewer than k found every cell may hold more
    worst = _ranked(first, k).groupBy("seed").agg(F.when(F.count(F.lit(1)) == k, F.min("near")).alias("kth"))

    def rest(i: VectorIndex, batch: pa.RecordBatch, far: np.ndarray, least: np.ndarray) -> np.ndarray:
        kth = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
        radius = np.sqrt(np.maximum(2 - 2 * (np.where(np.isnan(kth), -1, kth) - 2e-9), 0))
        return (least <= radius[:, None]) & ~_nearest_cells(i, far, enough)

    again = _probes(index, q.join(worst, "seed", "left").select("seed", "query", "kth"), rest)
    found = first.unionByName(_best(index, again, k, skip_self=not with_self))
    return _ranked(found, k).drop("near")


def cells_of(index: VectorIndex, queries: DataFrame, radius: float) -> DataFrame:
    """(cell, seed, query): the cells that may hold a vector within a distance of each query (key, embedding)."""
    q = queries.where(_finite(F.col("embedding"))).select(F.col("key").alias("seed"), F.col("embedding").alias("query"))
    return _probes(index, q, lambda i, batch, far, least: least <= radius)


def _homes(index: VectorIndex) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, its first block, its blocks) for blocks of seeds, and their number: neighbouring cells share a block, a crowded one has several."""
    size = min(MOST_SEEDS, max(CELL, int(-(-index.keys.sum() // SEED_BLOCKS))))
    middle = index.pivots - index.pivots.mean(axis=0)
    # along the direction in which the pivots differ most
    place = middle @ np.linalg.svd(middle, full_matrices=False)[2][0]
    homes, block, held = [], 0, 0
    for cell in np.argsort(place, kind="stable"):
        n = int(index.keys[cell])
        shares = max(1, -(-n // size))
        if held and (shares > 1 or held + n > size):
            block, held = block + 1, 0
        homes.append((int(cell), block, shares))
        block, held = (block + shares, 0) if shares > 1 else (block, held + n)
    return homes, block + 1


def _first(row: np.ndarray, keys: np.ndarray, sims: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` of each row by cosine, then key, with their ranks."""
    order = np.lexsort((np.unique(keys, return_inverse=True)[1], -near, row))
    row = row[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    order = order[rank <= k]
    return row[rank <= k], keys[order], sims[order], near[order], rank[rank <= k]


class _Seeds:
    """A block of seeds, and the best that they have met."""

    def __init__(self, names: pa.Array, queries: pa.Array, floor: float, k: int):
        self.names, self.queries, self.k = names, _matrix(queries), k
        self.least = np.full(len(names), floor - 1e-9)
        self.best: tuple | None = None
        self.new: list[tuple] = []
        self.count = 0

    def meet(self, lists: pa.Array, embedding: pa.Array) -> None:
        step = max(64, PRODUCT // len(self.queries))
        for at in range(0, len(lists), step):
            part = lists.slice(at, step)
            keys, bounds = part.flatten().to_numpy(zero_copy_only=False), part.offsets.to_numpy().astype(np.int64)
            sims = self.queries @ _matrix(embedding.slice(at, step)).T
            row, col = np.nonzero(sims >= self.least[:, None])
            times = np.diff(bounds)[col]
            place = np.repeat(bounds[col] - bounds[0] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            row, found = np.repeat(row, times), np.repeat(sims[row, col], times)
            self.new.append((row, keys[place], found, np.round(found, 9)))
            self.count += len(row)
            if self.count > PRODUCT:
                self.settle()

    def settle(self) -> None:
        parts = self.new if self.best is None else [self.best[:4], *self.new]
        if parts:
            self.best = _first(*(np.concatenate(c) for c in zip(*parts, strict=True)), self.k)
            full = self.best[4] == self.k
            # rounding may have raised what ties with the last
            self.least[self.best[0][full]] = np.maximum(self.least[self.best[0][full]], self.best[3][full] - 2e-9)
        self.new, self.count = [], 0

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        self.settle()
        if self.best is not None:
            row, keys, sims, _, rank = self.best
            for a in range(0, len(row), 1 << 16):
                s = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([self.names.take(pa.array(row[s])), pa.array(keys[s], kind), pa.array(sims[s]), pa.array(rank[s], pa.int32())], names=["seed", "key", "similarity", "rank"])


def _met(index: VectorIndex, seeds: DataFrame, radius: float) -> DataFrame:
    """(block, cell): the cells that may hold a vector within ``radius`` of some seed (block, embedding) of a block."""
    held = index.spark.sparkContext.broadcast(_light(index))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                near = _bounds(held.value, _matrix(batch.column(1)))[1] <= radius
                blocks, own = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                any_near = np.zeros((len(blocks), near.shape[1]), dtype=bool)
                np.logical_or.at(any_near, own, near)
                row, cell = np.nonzero(any_near)
                yield pa.RecordBatch.from_arrays([pa.array(blocks[row], pa.int32()), pa.array(cell, pa.int32())], names=["block", "cell"])

    return seeds.select("block", "embedding").mapInArrow(cells, "block int, cell int").distinct()


def within(index: VectorIndex, floor: float, k: int) -> DataFrame:
    """(seed, key, similarity, rank): of every vector its best ``k`` (1 to 500), itself included, that have a cosine of ``floor`` or more; ties by key.

    Seeds lie in blocks of neighbouring cells. A task holds one block and reads the
    vectors that it may meet one after another, keeping each seed's best ``k``; what
    is shuffled is the table once a block, of which there are ``SEED_BLOCKS`` up to
    ``SEED_BLOCKS * MOST_SEEDS`` vectors. Where the bounds rule nothing out, the
    products are still those of all pairs.
    """
    k = max(1, min(KEEP, k))
    radius = float(np.sqrt(max(0.0, 2 - 2 * (floor - 1e-9))))
    homes, blocks = _homes(index)
    rows, home = index.vectors(), index.spark.createDataFrame(homes, "cell int, first int, shares int")
    block = (F.col("first") + F.pmod(F.xxhash64(F.lit(2), F.col("vid")), F.col("shares"))).cast("int")
    # a row for each cell, of which there are at most MOST_CELLS
    seeds = rows.join(F.broadcast(home), "cell").select(block.alias("block"), F.lit(0).alias("side"), "vid", F.lit(None).cast(dict(rows.dtypes)["keys"]).alias("keys"), "embedding")
    met = work.written(_met(index, seeds, radius), "met")
    others = rows.join(met, "cell").select("block", F.lit(1).alias("side"), F.lit(None).cast("string").alias("vid"), "keys", "embedding")
    dealt = seeds.unionByName(others).repartition(blocks, "block").sortWithinPartitions("block", "side")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, queries, held = None, [], [], None
        for batch in batches:
            kind = batch.column(3).type.value_type
            number, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(side) != 0)) + 1), len(number)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if number[a] != now:
                    if held:
                        yield from held.rows(kind)
                    now, names, queries, held = number[a], [], [], None
                if side[a] == 0:
                    names.append(batch.column(2).slice(a, b - a))
                    queries.append(batch.column(4).slice(a, b - a))
                    continue
                held = held or _Seeds(pa.concat_arrays(names), pa.concat_arrays(queries), floor, k)
                held.meet(batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a))
        if held:
            yield from held.rows(kind)

    found = dealt.mapInArrow(best, f"seed string, key {dict(rows.dtypes)['keys'][len('array<') : -1]}, similarity double, rank int").where(F.col("similarity") >= floor)
    # copies of a vector have the same neighbours
    return index.members().select(F.col("key").alias("member"), F.col("vid").alias("seed")).join(found, "seed").select(F.col("member").alias("seed"), "key", "similarity", "rank")

"""The vector index against brute force, with ties, copies, crowded cells and clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.operators import vector_index as I
from shutterlake.operators import vectors as V


def _frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "key long, embedding array<float>").repartition(5)


def _plain(rows, seeds, k, floor=-2.0, with_self=True):
    """(seed, key, rank) by comparing all pairs."""
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v is not None and len(v) and np.isfinite(np.array(v, dtype=float)).all()]
    unit = {i: v / max(np.linalg.norm(v), 1e-300) for i, v in good}
    out = set()
    for s in seeds:
        if s in unit:
            near = sorted((-round(float(unit[s] @ u), 9), i) for i, u in unit.items() if (with_self or i != s) and float(unit[s] @ u) >= floor)
            out |= {(s, i, n) for n, (_, i) in enumerate(near[:k], 1)}
    return out


def _rows(seed, clusters=12, each=25, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    rows = [(i, centres[i % clusters] + 0.05 * rng.normal(size=size)) for i in range(clusters * each)]
    n = len(rows)
    copies = [(n + i, rows[3][1]) for i in range(40)] + [(n + 40 + i, 2 * np.array(rows[3][1])) for i in range(3)]
    odd = [(n + 50, None), (n + 51, [float("nan")] * size), (n + 52, [0.0] * size), (n + 53, [0.0] * size), (n + 54, [float("inf")] * size), (n + 55, [-1.0] + [0.0] * (size - 1))]
    # vectors of small whole numbers tie often
    ties = [(n + 60 + i, rng.integers(-1, 2, size)) for i in range(60)]
    return rows + copies + odd + ties


@pytest.fixture
def small(monkeypatch):
    """Cells and blocks so small that every cell is split."""
    monkeypatch.setattr(I, "BLOCK", 16)


@pytest.mark.parametrize("k, with_self", [(1, True), (7, True), (30, False), (500, True)])
def test_search_equals_brute_force(spark, small, k, with_self):
    rows = _rows(1)
    df = _frame(spark, rows)
    index = I.build(df, cell=20)
    assert len(index.pivots) > 10 and index.parts.max() > 1
    seeds = [i for i, _ in rows if i % 9 == 0 or i >= 340]
    got = {(r["seed"], r["key"], r["rank"]) for r in I.search(index, df.where(F.col("key").isin(seeds)), k, with_self).collect()}
    assert got == _plain(rows, seeds, k, with_self=with_self)
    index.drop()


@pytest.mark.parametrize("floor, k", [(0.9, 160), (0.99, 3), (0.0, 20)])
def test_within_equals_brute_force(spark, small, floor, k):
    rows = _rows(2)
    index = I.build(_frame(spark, rows), cell=20)
    got = {(r["seed"], r["key"], r["rank"]) for r in I.within(index, floor, k).collect()}
    assert got == _plain(rows, [i for i, _ in rows], k, floor)


def test_copies_are_one_row(spark):
    """A third of all rows is one vector: the index holds it once, with its least keys."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(900)] + [(900 + i, v) for i, v in enumerate(np.random.default_rng(3).normal(size=(1800, 3)))]
    index = I.build(_frame(spark, rows), cell=100)
    sizes = sorted(len(r["keys"]) for r in index.vectors().collect())
    assert sizes[-1] == I.KEEP and sizes[-2] == 1 and len(sizes) == 1801
    got = [r["key"] for r in I.search(index, _frame(spark, [(7000, [2.0, 4.0, 6.0])]), 500).orderBy("rank").collect()]
    assert got == list(range(500))


def test_cells_read_grow_slower_than_the_table(spark):
    """In clustered data a search reads about as many cells however many there are."""
    shares = []
    for clusters in (8, 32, 128):
        rng = np.random.default_rng(4)
        centres = rng.normal(size=(clusters, 16))
        rows = [(i, centres[i % clusters] + 0.02 * rng.normal(size=16)) for i in range(clusters * 20)]
        df = _frame(spark, rows)
        index = I.build(df, cell=20)
        read = I.cells_of(index, df.where("key < 32"), 0.2).groupBy("seed").count().agg(F.avg("count")).first()[0]
        shares.append(read)
        assert {(r["seed"], r["key"], r["rank"]) for r in I.search(index, df.where("key < 8"), 5).collect()} == _plain(rows, range(8), 5)
    assert shares[2] < 3 * shares[0] and shares[2] < 0.1 * 128


def test_search_scans_its_cells_only(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = 3 * np.eye(16)
    rows = [(i, centres[i % 16] + 0.01 * rng.normal(size=16)) for i in range(480)]
    index = I.build(_frame(spark, rows), cell=30)
    plan = index.vectors([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and index.vectors([1, 2]).select("cell").distinct().count() == 2


def test_index_is_kept_for_the_same_files(spark, tmp_path):
    rows = _rows(6)
    path = str(tmp_path / "v")
    _frame(spark, rows).write.parquet(path)
    read = lambda: spark.read.parquet(path).select("key", "embedding")
    first = I.index_of(read())
    assert I.index_of(read()).folder == first.folder
    assert I.index_of(read().where("key < 100")).folder != first.folder
    _frame(spark, [(5000, rows[0][1])]).write.mode("append").parquet(path)
    again = I.index_of(read())
    assert again.folder != first.folder and again.members().where("key = 5000").count() == 1
    first.drop()
    again.drop()


def test_empty_tables(spark):
    df = _frame(spark, _rows(7))
    none = df.limit(0)
    assert I.search(I.build(none), df, 3).count() == 0 and I.within(I.build(none), 0.9, 3).count() == 0
    assert I.search(I.build(df), none, 3).count() == 0


def test_similarity_counters(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02]), (4, [1.0, 0.03]), (5, [1.0, 0.04]), (6, None), (7, [0.0, 1.0])]
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key long")
    df, hidden, blank = _frame(spark, rows), keys(3), keys(5)
    rejected = spark.createDataFrame([(1, 2)], "key_a long, key_b long")
    pairs = V.similar_pairs(df, hidden, blank)
    made = V.similarity_candidates(pairs, df.select("key", (-F.col("key")).alias("seed_rank")), blank, rejected)
    # 1, 2 and 4 see each other and 5; 1-2 is refused both ways, 5 is blank for all three
    assert sorted(map(tuple, made.select("seed_key", "candidate_key", "rank").collect())) == [(4, 1, 2), (4, 2, 1)]
    got = V.similarity_counters(df, hidden, blank, rejected, pairs, made).first().asDict()
    assert got == {"embedded_catalog_images": 7, "skipped_non_primary": 1, "skipped_no_embedding": 1, "skipped_blank_frame": 4, "skipped_rejected": 2, "groups_created": 1, "candidates_created": 2}

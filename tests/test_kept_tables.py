"""Tables in buckets, the text index, resumed work, kept facets, deep pages and catalog files."""

import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from shutterlake.functions.udfs import porter_stem
from shutterlake.operators import catalog as C
from shutterlake.operators import kept as P
from shutterlake.operators import rank_index as G
from shutterlake.operators import resume as R
from shutterlake.operators import sync as Y
from shutterlake.operators import text_index as T
from shutterlake.sources import catalog_files as L
from shutterlake.sources import work
from shutterlake.sources.buckets import BUCKET, BucketTable


def _table(spark, tmp_path, rows, buckets=8):
    return BucketTable.create(spark.createDataFrame(rows, "key long, v string"), str(tmp_path / "t"), ["key"], buckets)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --------------------------------------------------------------------- buckets


def test_change_touches_its_buckets_only(spark, tmp_path):
    table = _table(spark, tmp_path, [(i, "old") for i in range(200)] + [(None, "none"), (7, "again")])
    before = table.versions()
    # keys of another type go to the same buckets
    touched = table.change(spark.createDataFrame([(3, "new"), (900, "new")], "key int, v string"), lambda old, new: Y.replace_rows(old, new, "key"))
    after = table.versions()
    assert 1 <= len(touched) <= 2 and {b for b in before if before[b] != after[b]} == set(touched)
    want = [(i, "old") for i in range(200) if i != 3] + [(None, "none"), (7, "again"), (3, "new"), (900, "new")]
    assert _rows(table.read()) == sorted(want, key=repr)
    # only the touched buckets were written
    written = {n for v in set(after.values()) - set(before.values()) for n in os.listdir(tmp_path / "t" / v) if n.startswith(BUCKET)}
    assert written == {f"{BUCKET}={b}" for b in touched}
    plan = table.read(touched)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [{BUCKET}" in plan


def test_stopped_write_leaves_the_table(spark, tmp_path):
    table = _table(spark, tmp_path, [(i, "old") for i in range(50)])
    want = _rows(table.read())
    changes = spark.createDataFrame([(i, "new") for i in range(10)], "key long, v string")
    with pytest.raises(Exception, match="stop"):
        table.change(changes, lambda old, new: new.withColumn("v", F.raise_error(F.lit("stop")).cast("string")))
    assert _rows(table.read()) == want and table.commits() == 1
    table.change(changes, lambda old, new: Y.replace_rows(old, new, "key"))
    table.vacuum()
    assert _rows(BucketTable.open(spark, table.folder).read()) == sorted([(i, "new" if i < 10 else "old") for i in range(50)], key=repr)
    assert len(work.names(spark, f"{table.folder}/commits")) == 1


def test_second_of_two_changes_fails(spark, tmp_path):
    table = _table(spark, tmp_path, [(1, "a"), (2, "b")])

    def slow(old, new):
        BucketTable.open(spark, table.folder).change(spark.createDataFrame([(2, "other")], "key long, v string"), lambda o, n: Y.replace_rows(o, n, "key"))
        return Y.replace_rows(old, new, "key")

    with pytest.raises(RuntimeError, match="meanwhile"):
        table.change(spark.createDataFrame([(1, "mine")], "key long, v string"), slow)
    assert _rows(table.read()) == [(1, "a"), (2, "other")]


def test_changes_equal_whole_snapshots(spark, tmp_path):
    """Upserts, updates and deletes by buckets give what the functions give on whole tables."""
    rng = random.Random(4)
    old = spark.createDataFrame([(i, rng.randint(0, 5), i % 2, f"{rng.randint(0, 9)}") for i in range(120)], "key long, rating int, instagram_posted int, analyzed_at string")
    new = spark.createDataFrame([(rng.randint(0, 200), rng.randint(0, 5), 7, f"{rng.randint(0, 9)}") for _ in range(40)], old.schema)
    table = BucketTable.create(old, str(tmp_path / "t"), ["key"], 8)
    whole = old
    for rows, how in ((new, Y.upsert_images), (new.select("key", F.lit(3).alias("rating")), lambda a, b: Y.set_values(a, b, "rating")), (new.where("key % 3 = 0").select("key"), Y.delete_keys)):
        table.change(rows, how)
        whole = how(whole, rows)
    assert _rows(table.read().select("key", "rating", "instagram_posted")) == _rows(whole.select("key", "rating", "instagram_posted"))


def test_empty_tables_and_changes(spark, tmp_path):
    table = _table(spark, tmp_path, [])
    assert table.read().count() == 0
    none = spark.createDataFrame([], "key long, v string")
    assert table.change(none, lambda old, new: new) == [] and table.commits() == 1
    table.change(spark.createDataFrame([(5, "x")], "key long, v string"), lambda old, new: old.union(new))
    assert _rows(table.read()) == [(5, "x")]
    table.change(spark.createDataFrame([(5,)], "key long"), Y.delete_keys)
    assert table.read().count() == 0


# ------------------------------------------------------------------ text index

WORDS = ["running", "runs", "Café", "cafe", "ponies", "pony", "the", "Über", "naïve", "日本", "x1", "a_b", "don't", "flies"]


def _texts(rng, n):
    return [(i, None if i % 17 == 5 else " ".join(["the", *(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))]) if i % 11 else "") for i in range(n)]


def test_index_equals_stemming_every_text(spark, tmp_path):
    texts = spark.createDataFrame(_texts(random.Random(1), 150), "key long, text string").repartition(4)
    index = T.build(texts, str(tmp_path / "i"), 8)
    for terms in (["run"], ["the"], ["cafe", "the"], ["pony", "run", "the"], ["uber"], ["naive", "fly"], ["b"], ["don"], ["nowhere"], ["the", "nowhere"]):
        assert _rows(C.full_text(index, terms).select("key")) == _rows(C.full_text(texts, terms).select("key")), terms
    counts = {r["stem"]: r["n"] for r in index.counts.read().collect()}
    assert counts == {r["stem"]: r["n"] for r in index.postings.read().groupBy("stem").agg(F.count("key").alias("n")).collect()}
    assert T.build(texts.limit(0), str(tmp_path / "j"), 4).search(["the"]).count() == 0


def test_search_reads_its_stems_buckets_from_the_rarest(spark, tmp_path):
    texts = spark.createDataFrame([(i, "common" + (" rare" if i == 7 else "")) for i in range(100)], "key long, text string")
    index = T.build(texts, str(tmp_path / "i"), 32)
    found = index.search([porter_stem("common"), porter_stem("rare")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # one bucket for each stem, and the rare one on the left of the semi join
    assert plan.count(f"IN ({BUCKET}") + plan.count(f"{BUCKET}#") >= 2 and plan.index("= rare") < plan.index("= common")
    assert [r["key"] for r in found.collect()] == [7]
    assert found._jdf.queryExecution().executedPlan().toString().count(f"PartitionFilters: [isnotnull({BUCKET}") + found._jdf.queryExecution().executedPlan().toString().count(f"PartitionFilters: [{BUCKET}") >= 2


def test_index_after_upserts_equals_a_new_one(spark, tmp_path):
    rng = random.Random(2)
    old, new = dict(_texts(rng, 60)), {i: t for i, t in _texts(rng, 90) if i % 4 == 0}
    frame = lambda d: C.with_tokens(spark.createDataFrame(sorted(d.items()), "key long, text string"))
    index = T.build_from_tokens(frame(old), str(tmp_path / "i"), 16)
    gone = [i for i in old if i % 10 == 1]
    before = {i: t for i, t in old.items() if i in new or i in gone}
    touched = index.upsert(frame(before).select("key", "tokens"), frame(new).select("key", "tokens"))
    now = {i: t for i, t in (old | new).items() if i not in gone}
    want = T.build_from_tokens(frame(now), str(tmp_path / "w"), 16)
    assert touched and _rows(index.postings.read()) == _rows(want.postings.read()) and _rows(index.counts.read()) == _rows(want.counts.read())
    # the same words again change nothing
    again = frame({i: now[i] for i in list(now)[:5]}).select("key", "tokens")
    assert index.upsert(again, again) == []


# -------------------------------------------------------------------- resuming


def test_stopped_work_goes_on(spark, tmp_path):
    todo, folder = spark.createDataFrame([(i, i * i) for i in range(40)] + [(None, 1)], "key long, v long"), str(tmp_path / "r")
    log = tmp_path / "log"
    log.mkdir()

    def step(rows):
        def mark(batches):
            for b in batches:
                for k in b["key"].tolist():
                    (log / f"{k}-{random.getrandbits(64)}").touch()
                yield b

        return rows.mapInPandas(mark, rows.schema)

    assert R.in_buckets(todo, step, folder, {"model": "a"}, buckets=6, most=2) is None
    part = len(os.listdir(log))
    assert 0 < part < 41
    with pytest.raises(Exception, match="mid"):  # a failure in mid-bucket leaves no entry
        R.in_buckets(todo, lambda rows: rows.withColumn("v", F.raise_error(F.lit("mid")).cast("long")), folder, {"model": "a"}, buckets=6)
    out = R.in_buckets(todo, step, folder, {"model": "a"}, buckets=6)
    assert _rows(out) == _rows(todo) and len(os.listdir(log)) == 41  # no bucket twice
    R.in_buckets(todo, step, folder, {"model": "a"}, buckets=6)
    assert len(os.listdir(log)) == 41
    R.in_buckets(todo, step, folder, {"model": "b"}, buckets=6)
    assert len(os.listdir(log)) == 82 and len(os.listdir(folder)) == 1  # changed knobs start anew, and the old log is gone
    R.in_buckets(todo.where("key < 3"), step, folder, {"model": "b"}, buckets=6)
    assert len(os.listdir(log)) == 85
    assert R.in_buckets(todo.limit(0), step, folder, {}, buckets=3).count() == 0


def test_composite_starts_anew_after_changes(spark, tmp_path):
    path, ran = str(tmp_path / "in"), []
    spark.range(3).write.parquet(path)

    def stage(name):
        def run(tables, add=1):
            ran.append(name)
            return {"a": tables["a"].withColumn(name, F.lit(add))}

        return run

    go = lambda add: R.composite([("x", stage("x")), ("y", stage("y"), {"add": add})], {"a": spark.read.parquet(path)}, str(tmp_path / "c"))["a"]
    assert go(1).select("y").distinct().first()[0] == 1 and ran == ["x", "y"]
    go(1)
    assert ran == ["x", "y"]
    assert go(2).select("y").distinct().first()[0] == 2 and ran == ["x", "y", "y"]  # a stage's knobs: it and those after
    spark.range(9).write.mode("overwrite").parquet(path)
    assert go(2).count() == 9 and ran == ["x", "y", "y", "x", "y"]  # the input: all


# ---------------------------------------------------------------- kept facets


def test_kept_facets_equal_a_scan(spark):
    rng = random.Random(8)
    image = lambda i: (i, rng.choice([None, "2001-02-03", "1999-12-31T10:00", "2020-05-06"]), rng.choice([None, 0, 1, 5]), rng.choice([None, "", " ", "Red", "green"]), rng.choice([None, 0, 1]))
    text = lambda i: (i, rng.choice([None, "[]", '["a","b"]', "no json"]), rng.choice([None, '["calm"]', '["calm","dark"]', "null"]), rng.choice([None, 0, 1]))
    frame = lambda d: spark.createDataFrame(list(d.values()), "key long, date_taken string, rating int, color_label string, instagram_posted int")
    told = lambda d: spark.createDataFrame(list(d.values()), "key long, dominant_colors string, mood_tags string, has_repetition int")
    images, texts = {i: image(i) for i in range(60)}, {i: text(i) for i in range(40)}
    scores = spark.createDataFrame([(1, "street", 3), (2, "street", 4), (3, "light", 9)], "image_key long, perspective_slug string, score int")
    kept = P.counted(P.of_images(frame(images)).unionByName(P.of_descriptions(told(texts))).unionByName(P.of_scores(scores)))
    for _ in range(3):
        new = {i: image(i) for i in rng.sample(range(80), 12)}
        gone = set(rng.sample(sorted(images), 6)) - set(new)
        old = {i: images[i] for i in images if i in new or i in gone}
        kept = P.changed(kept, P.of_images(frame(old)), P.of_images(frame(new)))
        images = {i: r for i, r in (images | new).items() if i not in gone}
        again = {i: text(i) for i in rng.sample(range(50), 9)}
        was = {i: texts[i] for i in again if i in texts}
        kept = work.written(P.changed(kept, P.of_descriptions(told(was or {0: (0, None, None, None)})).limit(10**6 if was else 0), P.of_descriptions(told(again))), "kept")
        texts |= again
    want = C.facets(frame(images), told(texts), scores)
    assert P.facets(kept).select(want.columns).first() == want.first()


# ------------------------------------------------------------------ deep pages


def test_pages_read_their_ranges(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 13 == 0 else f"20{rng.randint(10, 12)}-0{rng.randint(1, 9)}-01") for i in range(500)]
    df = spark.createDataFrame(rows, "key long, date_taken string").repartition(3)
    index = G.build(df, C.page_order, size=40)
    whole = [r["key"] for r in df.orderBy(*C.page_order()).collect()]
    assert index.total() == 500 and len(index.counts) == 13
    for limit, offset in ((10, 0), (50, 37), (500, 490), (20, 499), (5, 500), (5, 10_000)):
        assert [r["key"] for r in index.page(limit, offset).collect()] == whole[offset : offset + limit]
    assert len(index.ranges(10, 400)[0]) <= 2 and index.ranges(10, 10_000) == ([], 0)
    assert "PartitionFilters: [" in index.page(10, 400)._jdf.queryExecution().executedPlan().toString()
    index.drop()
    assert G.build(df.limit(0), C.page_order).page(5, 0).count() == 0


# --------------------------------------------------------------- catalog files


@pytest.fixture
def catalogs(spark, tmp_path):
    rows = spark.createDataFrame([(i, i / 2 if i % 5 else None, f"n{i % 7}", i % 3) for i in range(1, 301)], "id_local long, price double, name string, pick int")
    L.write(rows, str(tmp_path / "c"), "AgImages", "id_local", files=3)
    return rows, str(tmp_path / "c")


def test_catalog_round_trip(spark, catalogs):
    rows, folder = catalogs
    assert L.tables(folder) == ["AgImages"] and L.tables(folder, ("folder",)) == []
    assert [f.name for f in L.columns(folder, "AgImages")] == rows.columns
    got = L.read(spark, folder, "AgImages", rows=32)
    assert got.rdd.getNumPartitions() >= 10 and _rows(got) == _rows(rows)
    assert L.read(spark, os.path.join(folder, sorted(os.listdir(folder))[0]), "AgImages").count() == 100
    with pytest.raises(Exception, match="no table"):
        L.read(spark, folder, "nothing").count()


@pytest.mark.parametrize("test", ["id_local between 40 and 60", "id_local in (5, 299)", "price > 100 and pick = 1", "price is not null and id_local < 20", "name = 'n3' and id_local >= 290", "price <= 3 or pick = 2", "id_local > 1000"])
def test_catalog_filters_equal_sparks(spark, catalogs, test):
    rows, folder = catalogs
    got = L.read(spark, folder, "AgImages", rows=32, schema="id_local long, price double, name string, pick long")
    assert _rows(got.where(test)) == _rows(rows.where(test))


def test_catalog_ranges_are_pruned(spark, catalogs):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan, StringContains

    _, folder = catalogs
    reader = lambda: L.CatalogReader({"path": folder, "table": "AgImages", "key": "id_local", "rows": "32"}, L.columns(folder, "AgImages"))
    every, few, none = reader(), reader(), reader()
    assert list(every.pushFilters([StringContains(("name",), "3"), EqualTo(("name",), "n3")])) != []  # text is left to Spark
    assert list(few.pushFilters([GreaterThan(("id_local",), 40), LessThan(("id_local",), 60)])) == []
    list(none.pushFilters([GreaterThan(("id_local",), 999)]))
    assert len(every.partitions()) >= 10 and len(few.partitions()) <= 2
    assert [p.path for p in none.partitions()] == [""] and list(none.read(none.partitions()[0])) == []


def test_catalog_is_opened_read_only(catalogs):
    _, folder = catalogs
    with L._open(L._files(folder)[0]) as db, pytest.raises(sqlite3.OperationalError, match="readonly"):
        db.execute("DELETE FROM AgImages")


# ------------------------------------------------------------- streamed bursts


def _plain_bursts(rows, gap):
    """{(group, start, start key): (end, members, representative)}"""
    out = {}
    for group in {r[0] for r in rows}:
        run = []
        for _, at, key, score in [*sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2])), (None, 10**18, None, None)]:
            if run and at - run[-1][0] > gap:
                out[group, *run[0][:2]] = (run[-1][0], [k for _, k, _ in run], max((float("-inf") if s is None else s, t, k) for t, k, s in run)[2])
                run = []
            run.append((at, key, score))
    return out


def test_merged_rows_in_any_order():
    from shutterlake.streaming import bursts as B

    rng = random.Random(6)
    for _ in range(50):
        rows = [("g", rng.randint(0, 60), i, rng.randint(0, 3)) for i in range(25)]
        segments = []
        for _, at, key, score in rows:
            segments = B.merged(segments, at, key, score, 2)
        assert {("g", s[0], s[1]): (s[2], [k for _, k in s[4]], s[3][2]) for s in segments} == _plain_bursts(rows, 2)


def test_streamed_bursts_take_in_late_rows(spark, tmp_path):
    from shutterlake.streaming import bursts as B

    rng, second = random.Random(9), 1_000_000
    rows = [(rng.choice("ab"), rng.randint(1, 400) * second, i, rng.choice([None, 1.0, 2.0])) for i in range(120)]
    schema = "camera string, ts timestamp, key long, score double"
    put = lambda some, name: spark.createDataFrame(some, "camera string, us long, key long, score double").select("camera", F.timestamp_micros("us").alias("ts"), "key", "score").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    run = lambda late: B.run_once(B.burst_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")), "ts", "key", "camera", "score", 3000, late), str(tmp_path / "s"))
    for i in range(3):
        put(rows[i * 30 : i * 30 + 30], f"f{i}")
    run("1 hour")
    put([*rows[90:], ("a", None, 999, 1.0)], "f3")  # a second run goes on, with rows older than most
    got = {(r["group"], r["start_us"], r["start_key"]): (r["end_us"], r["members"], r["representative"]) for r in B.standing(run("1 hour")).collect()}
    assert got == _plain_bursts(rows, 3 * second)
    # what is behind the watermark is dropped, and closed bursts stay as they were
    put([("a", 90_000 * second, 500, 1.0)], "f4")
    put([("a", 89_999 * second, 501, 1.0)], "f5")
    run("1 hour")
    put([("a", 5 * second, 502, 1.0)], "f6")
    late = {k: v for k, v in ((("a" if r["group"] == "a" else "b", r["start_us"], r["start_key"]), (r["end_us"], r["members"], r["representative"])) for r in B.standing(run("1 hour")).collect())}
    assert late == got | {("a", 89_999 * second, 501): (90_000 * second, [501, 500], 500)}


def test_groups_of_streamed_bursts_share_calls_and_states(spark, tmp_path):
    """However many groups there are, a call and a state is one of a bucket's; names that are null or not plain have their own."""
    from shutterlake.streaming import bursts as B

    rng, second = random.Random(4), 1_000_000
    rows = [(rng.choice([None, *range(20)]), rng.randint(1, 200) * second, i, rng.choice([None, 1.0, 2.0])) for i in range(300)]
    for i in range(2):
        part = spark.createDataFrame(rows[i * 150 : i * 150 + 150], "job int, us long, key long, score double")
        part.select("job", F.timestamp_micros("us").alias("ts"), "key", "score").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    for name, group, most in (("shared", F.col("job"), 21), ("apart", F.col("job").cast("decimal(5,0)"), 21)):
        stream = spark.readStream.schema("job int, ts timestamp, key long, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withColumn("job", group)
        found = B.standing(B.run_once(B.burst_stream(stream, "ts", "key", "job", "score", 3000, "1 hour", **({"buckets": 4} if name == "shared" else {})), str(tmp_path / name)))
        got = {(r["group"], r["start_us"], r["start_key"]): (r["end_us"], r["members"], r["representative"]) for r in found.collect()}
        assert got == _plain_bursts(rows, 3 * second), name
        states = spark.read.format("statestore").load(str(tmp_path / name / "checkpoint")).count()
        assert states <= (5 if name == "shared" else most) and states > 1

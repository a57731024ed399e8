"""What shows only beyond the small driver tables."""

import os

import duckdb

from shutterlake.plans.registry import ORACLE_SQL, QUERIES


def same_as_sql(spark, folder, name):
    """Whether a query and its SQL give the same rows on the tables in a folder."""
    db = duckdb.connect()
    for path in os.listdir(folder):
        db.execute(f"CREATE VIEW {path.split('.')[0]} AS SELECT * FROM '{folder}/{path}/*.parquet'")
    wanted = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    got = QUERIES[name](spark, str(folder))
    return sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(wanted.fetchall())


def test_wrong_links_when_file_ids_meet_image_ids(spark, tmp_path):
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    files = [(i, 1) for i in (2, 3, 4, 8, 100002, 100004, 100008, 200004, 200008)]
    spark.createDataFrame(files, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    assert same_as_sql(spark, tmp_path, "wrong_keyword_links")


def test_postings_of_odd_texts_and_many(spark, monkeypatch):
    from shutterlake.functions.udfs import fold, porter_stem, words_in
    from shutterlake.operators import text_index as T

    monkeypatch.setattr(T, "ROWS", 7)
    monkeypatch.setattr(T, "KNOWN", 20)
    monkeypatch.setattr(T, "WRITTEN", 5)
    rows = [(1, None), (2, ""), (3, "..."), (4, "Things óf the thing"), (5, "snake_case two_things"), (5, "other things"), (6, "é ́")]
    rows += [(i, " ".join(f"word{j} running{j}" for j in range(i % 13)) + " runs run") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "key long, text string")
    wanted = {(porter_stem(w), k) for k, t in rows if t for w in words_in(fold(t))}
    found = T.postings(df)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    # the texts' words are not shuffled: without repeated keys no exchange is left but the one that deals out the rows
    once = T.postings(df.where("key <> 5"))._jdf.queryExecution().executedPlan().toString()
    assert once.count("Exchange hashpartitioning") == 0, once


def test_within_deals_the_table_once_a_block(spark, monkeypatch):
    import numpy as np

    from shutterlake.operators import vector_index as I

    draw = np.random.default_rng(5)
    rows = draw.normal(size=(300, 8)).astype(np.float32)
    rows[100:200] = rows[100] + draw.normal(scale=0.01, size=(100, 8))
    rows[200:240] = rows[7]
    names = [f"k{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(n, r.tolist()) for n, r in zip(names, rows, strict=True)], "key string, embedding array<float>")
    index = I.build(df, cell=20)
    for name, value in (("CELL", 16), ("SEED_BLOCKS", 5), ("MOST_SEEDS", 40), ("PRODUCT", 3000)):
        monkeypatch.setattr(I, name, value, raising=False)
    assert I._homes(index)[1] >= 5
    monkeypatch.setattr(I, "_probes", None)  # a row for each seed and cell would be as many as pairs of vectors over the cell's size
    units = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    near = np.round(units @ units.T, 9)
    wanted = set()
    for i in range(300):
        order = sorted((j for j in range(300) if near[i, j] >= 0.3), key=lambda j: (-near[i, j], names[j]))[:60]
        wanted |= {(names[i], names[j], n) for n, j in enumerate(order, 1)}
    got = [(r.seed, r.key, r["rank"]) for r in I.within(index, 0.3, 60).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_ranges_do_not_grow_with_the_table(spark):
    from pyspark.sql import functions as F

    from shutterlake.operators import rank_index as G

    index = G.build(spark.range(600).select(((F.col("id") * 7) % 600).alias("id")), lambda: [F.desc("id")], size=1)
    assert len(index.counts) <= 256 and index.total() == 600
    assert [r.id for r in index.page(5, 500).collect()] == [99, 98, 97, 96, 95]


def test_delete_version_deals_out_what_is_left(spark):
    from shutterlake.operators import scores as S

    rows = spark.createDataFrame([(i, "catalog", i % 3, "v1", i) for i in range(9)], "image_key long, image_type string, perspective_slug int, prompt_version string, score int")
    left = S.delete_version(rows, rows.where("image_key % 2 = 0").drop("score"))
    assert sorted(r.image_key for r in left.collect()) == [1, 3, 5, 7] and left.columns == rows.columns
    assert "RepartitionByExpression" in left._jdf.queryExecution().optimizedPlan().toString()


def test_postings_of_stored_stems_are_not_shuffled_twice(spark):
    from shutterlake.operators import text_index as T

    rows = [(1, None), (2, []), (3, ["a", "b", "a"]), (4, ["a"]), (5, ["b", "c"]), (5, ["c", "d"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "key long, tokens array<string>")
    got = [tuple(r) for r in T.stored_postings(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, k) for k, t in rows for s in t or []}
    once = T.stored_postings(df.where("key <> 5"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, once.collect())) == [("a", 3), ("a", 4), ("b", 3)]


def test_supersede_deals_rows_once(spark):
    from shutterlake.operators import scores as S

    rows = spark.createDataFrame([(i, "catalog", i % 3, "v1", "2020", 1, i) for i in range(9)], "image_key long, image_type string, perspective_slug int, prompt_version string, scored_at string, is_current long, id long")
    after = S.supersede(rows, rows.where("image_key = 4").selectExpr("image_key", "image_type", "perspective_slug", "'v2' AS prompt_version", "scored_at", "is_current", "-id AS id"))
    assert sorted((r.image_key, r.prompt_version, r.is_current) for r in after.collect()) == sorted([(i, "v1", int(i != 4)) for i in range(9)] + [(4, "v2", 1)])
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_scores_are_dealt_to_a_given_number_of_partitions(spark, tmp_path):
    from shutterlake.sources import driver as D

    rows = [(i // 3, i % 2, f"2020-01-0{1 + i % 3}", i, i, 1.0 * i, i, "N", "O") for i in range(30)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_shipdate string, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = D.scores(spark, str(tmp_path))
    assert found.count() == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def _plans_written(monkeypatch):
    """The plans of what is written to tables in buckets from now on."""
    from shutterlake.sources import buckets as K

    plans, writer = [], K._writer
    monkeypatch.setattr(K, "_writer", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or writer(rows))
    return plans


def _described_rows(spark, rows):
    fixed = "null AS subjects, null AS dominant_colors, '[\"calm\"]' AS mood_tags, null AS perspectives, null AS best_perspective, null AS has_repetition"
    return spark.createDataFrame(rows, "image_key long, summary string, described_at string").selectExpr("image_key", "summary", *[f"cast({c.replace(' AS ', ' AS string) AS ')}" for c in fixed.split(", ")], "described_at")


def test_change_shuffles_no_rows_of_other_keys(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from shutterlake.operators import sync as Y
    from shutterlake.sources import buckets as K

    rows = [(i, "x", i % 5) for i in range(300)] + [(None, "x", 1), (None, "y", 2), (7, "x", 9), (8, None, 3)]
    df = spark.createDataFrame(rows, "key long, name string, v int")
    new = spark.createDataFrame([(7, "x", -1), (None, "x", -2), (900, "z", -3), (8, None, -4)], "key int, name string, v int")
    made = {name: K.BucketTable.create(df, str(tmp_path / name), ["key", "name"], 4) for name in ("all", "copied", "many")}
    seen = {}

    def how(name):
        def replaced(old, some):
            seen[name] = old.count()
            keys = some.withColumnsRenamed({"key": "k", "name": "n"})
            left = old.join(keys, F.col("key").eqNullSafe(F.col("k")) & F.col("name").eqNullSafe(F.col("n")), "left_anti")
            return left.unionByName(some)

        return replaced

    plans = _plans_written(monkeypatch)
    for name, small, few in (("all", 1 << 30, 9), ("copied", -1, 9), ("many", -1, 1)):
        monkeypatch.setattr(K, "SMALL", small)
        monkeypatch.setattr(K, "FEW", few)
        del plans[:]
        touched = made[name].change(new, how(name))
        if name == "copied":
            copies = [p for p in plans if "Repartition" not in p.replace("Repartition 2, false", "")]
            assert len(copies) == len(touched) and len(plans) == len(copies) + 1
    want = sorted([r for r in rows if r[:2] not in {(7, "x"), (None, "x"), (8, None)}] + [(7, "x", -1), (None, "x", -2), (900, "z", -3), (8, None, -4)], key=repr)
    assert all(sorted(map(tuple, table.read().collect()), key=repr) == want for table in made.values())
    assert seen["copied"] == 4 and seen["many"] == seen["all"] > 100
    assert sorted(map(tuple, made["all"].lookup(new).collect()), key=repr) == sorted(map(tuple, new.collect()), key=repr)
    # however often a bucket is copied, it has as many files
    monkeypatch.setattr(K, "FEW", 9)
    for _ in range(3):
        made["copied"].change(new, lambda old, some: Y.replace_rows(old, some, "key"))
    for b, version in made["copied"].versions().items():
        assert len(list((tmp_path / "copied" / version / f"{K.BUCKET}={b}").glob("*.parquet"))) <= 2 * K.SHARES


def test_descriptions_are_dealt_before_their_stems_are_added(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from shutterlake.operators import sync as Y

    rows = [(i, f"Things number {i} óf  the sea", "1") for i in range(60)] + [(1, "newer", "2"), (2, "b tie", "3"), (2, "a tie", "3"), (3, None, "0"), (4, "older", "0")]
    df = _described_rows(spark, rows)
    none = df.limit(0).withColumns({"description_search_document": F.lit(""), "tokens": F.array().cast("array<string>")})
    plans = _plans_written(monkeypatch)
    table = Y.create_descriptions(df, str(tmp_path / "a"), 4)
    want = Y.upsert_descriptions(none, df)
    assert table.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and table.read().count() == 60
    del plans[:]
    Y.create_descriptions(df.where("image_key > 4"), str(tmp_path / "b"), 4)
    # from the top: the write, the stems, then the only shuffle, of what came in
    (plan,) = plans
    dealt = plan.index("RepartitionBy")
    assert plan.count("RepartitionBy") == 1 and 0 < plan.index("porter_tokens") < dealt and "porter_tokens" not in plan[dealt:] and "Window" not in plan


def test_postings_are_packed_for_the_shuffle_and_changed_by_key(spark, monkeypatch, tmp_path):
    from shutterlake.operators import text_index as T
    from shutterlake.sources import buckets as K

    rows = [(1, None), (2, []), *[(i, sorted({"all", f"m{i % 3}", f"w{i}"})) for i in range(3, 60)]]
    frame = lambda rows: spark.createDataFrame(rows, "key long, tokens array<string>")
    pairs = spark.createDataFrame([(s, k) for k, t in rows for s in t or []], "stem string, key long").coalesce(1)
    packed = pairs.mapInArrow(T._packed, "stem string, keys array<bigint>").collect()
    assert len(packed) == len({s for _, t in rows for s in t or []})
    assert sorted((r.stem, k) for r in packed for k in r["keys"]) == sorted((s, k) for k, t in rows for s in t or [])
    monkeypatch.setattr(T, "PACKED", 10)
    monkeypatch.setattr(K, "SMALL", -1)
    before = [(k, t) for k, t in rows if k % 7 == 3] + [(2, [])]
    after = [(k, None if k % 2 else ["all", "new"]) for k, _ in before] + [(99, ["m1", "all"])]
    now = dict(rows) | dict(after)
    want = T.build_from_tokens(frame(sorted(now.items())), str(tmp_path / "w"), 8)
    for few in (100, 0):
        monkeypatch.setattr(K, "FEW", few)
        index = T.build_from_tokens(frame(rows), str(tmp_path / f"i{few}"), 8)
        plans = _plans_written(monkeypatch)
        touched = index.upsert(frame(before), frame(after))
        assert touched and sorted(index.postings.read().collect()) == sorted(want.postings.read().collect())
        assert sorted(index.counts.read().collect()) == sorted(want.counts.read().collect())
        if few:
            # a bucket of postings that is copied is not shuffled
            copies = [p for p in plans if "left_anti" in p.lower() or "LeftAnti" in p]
            assert len(copies) >= len(touched) and not any("RepartitionBy" in p or "Sort" in p for p in copies)


def test_upsert_with_index_leaves_no_old_files(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from shutterlake.operators import sync as Y
    from shutterlake.operators import text_index as T
    from shutterlake.sources import buckets as K

    monkeypatch.setattr(K, "SMALL", -1)
    old, new = _described_rows(spark, [(i, f"Things number {i}", "1") for i in range(40)]), _described_rows(spark, [(3, "others", "2"), (99, "things", "2")])
    table = Y.create_descriptions(old, str(tmp_path / "t"), 4)
    index = T.build_from_tokens(table.read().select(F.col("image_key").alias("key"), "tokens"), str(tmp_path / "i"), 4)
    Y.upsert_descriptions_indexed(table, index, new, vacuum=True)
    want = Y.upsert_descriptions(Y.described(old), new)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))
    pairs = want.select(F.explode("tokens"), "image_key").collect()
    assert sorted(map(tuple, index.postings.read().collect())) == sorted(map(tuple, pairs))
    for t in (table, index.postings, index.counts):
        assert {n for n in t._names("") if n.startswith("v-")} == set(t.versions().values()) and len(t._names("commits")) == 1

"""Small scenarios with results known by hand or from a plain computation."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import scalars as X
from shutterlake.functions.udfs import binomial_tail, parsed_description, porter_stem, repaired
from shutterlake.operators import catalog as C
from shutterlake.operators import identity as I
from shutterlake.operators import jobs as J
from shutterlake.operators import resume as R
from shutterlake.operators import scores as S
from shutterlake.operators import stacks as K
from shutterlake.operators import sync as Y
from shutterlake.operators import vectors as V


def scores(spark, rows):
    return spark.createDataFrame([(k, p, s, 0) for k, p, s in rows], "image_key string, perspective_slug string, score long, not_attempted int")


def test_midrank_ties(spark):
    got = {(r.image_key): r.pct for r in S.percentiles(scores(spark, [("a", "x", 5), ("b", "x", 5), ("c", "x", 10), ("a", "y", 3)])).where("perspective_slug = 'x'").collect()}
    assert got == {"a": 0.25, "b": 0.25, "c": 1.0}


def test_single_image_lens_is_one(spark):
    assert S.percentiles(scores(spark, [("a", "y", 3)])).first().pct == 1.0


def test_excused_cells_are_left_out(spark):
    lenses = spark.createDataFrame([("x", 1), ("old", 0)], "slug string, active int")
    rows = spark.createDataFrame([("a", "x", 4, 0), ("b", "x", 10, 1), ("c", "old", 9, 0)], "image_key string, perspective_slug string, score long, not_attempted int")
    got = S.percentiles(S.attempted(rows, lenses)).collect()
    assert [(r.image_key, r.pct) for r in got] == [("a", 1.0)]


def test_best_score_tie_goes_to_least_slug(spark):
    got = S.best_score(scores(spark, [("a", "z", 7), ("a", "b", 7), ("a", "c", 6)])).first()
    assert (got.score, got.perspective_slug) == (7, "b")


def test_votes_against_plain(spark):
    draw = random.Random(5)
    rows = [(f"i{i}", p, draw.randint(1, 10)) for i in range(60) for p in "abcd" if draw.random() < 0.7]
    pct = {(r.image_key, r.perspective_slug): r.pct for r in S.percentiles(scores(spark, rows)).collect()}
    won, seen, chance = dict.fromkeys("abcd", 0), dict.fromkeys("abcd", 0), dict.fromkeys("abcd", 0.0)
    for _, group in itertools.groupby(sorted(pct), key=lambda k: k[0]):
        group = list(group)
        if len(group) < 2:
            continue
        top = max(pct[k] for k in group)
        for k in group:
            seen[k[1]] += 1
            chance[k[1]] += 1 / len(group)
        if sum(pct[k] == top for k in group) == 1:
            won[next(k[1] for k in group if pct[k] == top)] += 1
    got = {r.perspective_slug: (r.votes, r.photos_on, round(r.expected, 9)) for r in I.votes(S.percentiles(scores(spark, rows))).collect()}
    assert got == {p: (won[p], seen[p], round(chance[p], 9)) for p in "abcd"}


def test_crown_and_labels(spark):
    rows = [(f"i{i}", "hot", 10) for i in range(10)] + [(f"i{i}", "cold", 2) for i in range(10)]
    rows += [(f"j{i}", "hot", 5) for i in range(2)] + [(f"j{i}", "cold", 9) for i in range(2)]
    got = {r.perspective_slug: r for r in I.signature(S.percentiles(scores(spark, rows)), spark.createDataFrame([(12,)], "total long")).collect()}
    assert got["hot"].photos_on == 12
    labels = spark.createDataFrame([(True, 6.0, False), (True, 3.0, False), (True, 2.0, False), (False, 9.0, True), (False, 1.0, False)], "c boolean, z double, f boolean").select(X.strength(F.col("c"), F.col("z"), F.col("f")).alias("s"))
    assert [r.s for r in labels.collect()] == [X.DEFINING, X.CLEAR, X.STRENGTH, X.LEADING, X.LEADING]


def test_binomial_tail():
    assert binomial_tail(0, 5, 0.3) == 1.0
    assert math.isclose(binomial_tail(2, 2, 0.5), 0.25)
    assert math.isclose(binomial_tail(60, 100, 0.5), 0.5 * math.erfc(9.5 / math.sqrt(50)))


def plain_bursts(rows, delta):
    out, last = [], None
    for ts, key in sorted(rows):
        if last is None or (ts - last).total_seconds() * 1000 > delta:
            out.append([])
        out[-1].append(key)
        last = ts
    return sorted(map(tuple, out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bursts_against_plain(spark, seed):
    draw = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows, at = [], start
    for i in range(300):
        at += dt.timedelta(milliseconds=draw.choice([0, 500, 2000, 2001, 3_600_000, 9_000_000]))
        rows.append((at, i))
    df = spark.createDataFrame(rows, "ts timestamp, key long")
    found = K.burst_ids(df, "ts", "key", 2000).groupBy("burst").agg(F.sort_array(F.collect_list("key")).alias("k")).collect()
    assert sorted(tuple(r.k) for r in found) == plain_bursts(rows, 2000)


def test_representative_is_the_best_rated(spark):
    rows = spark.createDataFrame([(1, "a", 1, "2024-01-01"), (1, "b", 5, "2024-01-01"), (1, "c", None, "2024-01-02")], "stack_id long, key string, rating int, date_taken string")
    none = spark.createDataFrame([], "image_key string, mean_score double")
    assert K.representatives(rows, none).first().representative_key == "b"


def test_stack_commands(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "stack_id long, key string")
    rows = lambda df: sorted((r.stack_id, r.key) for r in df.collect())
    assert rows(K.split_out(members, "a")) == [(2, "c"), (2, "d")]
    assert rows(K.merge(members, 2, 1)) == [(1, "a"), (1, "b"), (1, "c"), (1, "d")]
    assert rows(K.accept_pair(members, "x", "y", 9))[-2:] == [(9, "x"), (9, "y")]
    assert rows(K.accept_pair(members, "a", "c", 9)) == [(1, "a"), (1, "b"), (1, "c"), (1, "d")]
    assert rows(K.accept_pair(members, "a", "x", 9))[:3] == [(1, "a"), (1, "b"), (1, "x")]
    with pytest.raises(ValueError):
        K.create(members, ["a"], 3)


def test_rejections_are_unordered(spark):
    old = spark.createDataFrame([("a", "b", "1")], "key_a string, key_b string, rejected_at string")
    new = spark.createDataFrame([("b", "a", "2"), ("d", "c", "3")], old.schema)
    assert sorted((r.key_a, r.key_b, r.rejected_at) for r in K.reject(old, new).collect()) == [("a", "b", "1"), ("c", "d", "3")]


def test_sync_skips_junk_ids(spark):
    source = spark.createDataFrame([("1",), (" 2 ",), ("junk",), (None,)], "id string")
    library = spark.createDataFrame([("2",), ("3",)], "id string")
    assert [r.id for r in Y.missing(source, library).collect()] == [1]
    assert [r.id for r in Y.stale(source, library).collect()] == [3]


def test_upserts(spark):
    schema = "key string, instagram_posted long, phash string, exif string, catalog_path string, description string, analyzed_at string"
    old = spark.createDataFrame([("a", 1, "h", "e", "p", "d", "1")], schema)
    new = spark.createDataFrame([("a", 0, None, "E", None, "D", "2"), ("b", 0, "x", None, None, None, "2")], schema)
    got = {r.key: r for r in Y.upsert_images(old, new).collect()}
    assert (got["a"].instagram_posted, got["a"].phash, got["b"].phash) == (1, None, "x")
    got = {r.key: r for r in Y.upsert_catalog_images(old, new).collect()}
    assert (got["a"].phash, got["a"].exif, got["a"].catalog_path) == ("h", "E", "p")


def test_supersede_keeps_one_current(spark):
    schema = "id long, image_key string, image_type string, perspective_slug string, score long, prompt_version string, scored_at string, is_current long"
    old = spark.createDataFrame([(1, "a", "c", "x", 5, "v1", "1", 1), (2, "b", "c", "x", 5, "v1", "1", 1)], schema)
    new = spark.createDataFrame([(3, "a", "c", "x", 7, "v2", "0", 1)], schema)
    assert sorted((r.id, r.is_current) for r in S.supersede(old, new).collect()) == [(1, 0), (2, 1), (3, 1)]


def test_backfill_of_legacy_maps(spark):
    rows = spark.createDataFrame([("a", "c", "m", "t", '{"x":{"score":7},"y":{"score":"11"},"z":{"score":8.0}}'), ("b", "c", "m", "t", "not json")], "image_key string, image_type string, model_used string, described_at string, perspectives string")
    have = spark.createDataFrame([("a", "c", "z", 1)], "image_key string, image_type string, perspective_slug string, is_current long")
    assert [(r.image_key, r.perspective_slug, r.score) for r in S.backfill_legacy(rows, have).collect()] == [("a", "x", 7)]


def test_search_terms():
    assert X.search_terms("Drop TABLE; x y2!") == ["Drop", "TABLE", "y2"]
    assert X.search_terms("  ") is None
    assert X.search_terms("!!!") is None
    with pytest.raises(ValueError):
        X.search_terms("u")


def test_porter():
    assert {porter_stem(w) for w in ("running", "run", "runs")} == {"run"}
    assert porter_stem("photograph") != porter_stem("photography")
    assert [porter_stem(w) for w in ("caresses", "ponies", "relational", "hopping", "falling", "happy", "sky", "adjustment", "controll")] == ["caress", "poni", "relat", "hop", "fall", "happi", "sky", "adjust", "control"]


def test_full_text(spark):
    texts = spark.createDataFrame([("a", "Running at the Café"), ("b", "a run OR cafe"), ("c", None)], "key string, text string")
    assert sorted(r.key for r in C.full_text(texts, ["runs", "cafe"]).collect()) == ["a", "b"]
    assert [r.key for r in C.full_text(texts, ["OR"]).collect()] == ["b"]


def test_scalars(spark):
    df = spark.createDataFrame([("2024-03-31T10:00:00", "a b", 2.675)], "d string, t string, x double")
    row = df.select(
        X.year_month(F.lit("2024-03-31T23:30:00-05:00")).alias("month"),
        X.year_month(F.lit("2024")).alias("bare"),
        X.months_before(F.to_date(F.lit("2024-03-31")), 1).cast("string").alias("before"),
        X.image_key(F.col("d"), F.lit("x.jpg")).alias("key"),
        X.image_key(F.lit(None).cast("string"), F.lit("")).alias("none"),
        X.like_substring(F.lit("ÄB\\c"), "b\\C").alias("like"),
        X.match_label(F.lit(0.985)).alias("label"),
        X.json_any_of(F.lit("not json"), ["a"]).alias("bad"),
        X.json_any_of(F.lit('["a"]'), [" a "]).alias("good"),
        X.prompt_version(F.lit("s"), F.lit("m")).alias("v"),
        X.normal_slug(F.lit(" Street (beta) ")).alias("slug"),
        X.not_video(F.lit("/a/B.MOV")).alias("video"),
        X.gap_seconds(F.lit(None).cast("timestamp"), F.lit("1970-01-01 00:00:09").cast("timestamp")).alias("gap"),
        X.exact_round(F.col("x"), 2).alias("r"),
        F.length(X.preview(F.lit("x" * 300))).alias("p"),
    ).first()
    assert row.asDict() == {"month": "202404", "bare": None, "before": "2024-03-02", "key": "2024-03-31_x.jpg", "none": "unknown_unknown", "like": True, "label": "Visual match (98%)", "bad": False, "good": True, "v": "s:62c66a7a5dd70c31", "slug": "street", "video": False, "gap": 9, "r": 2.67, "p": 240}


def test_json_repair():
    assert repaired('```json\n{"a": [1, 2,],}\n```') == '{"a": [1, 2]}'
    assert parsed_description('so: {"summary": "x",} ok') == '{"summary": "x"}'
    assert parsed_description("plain") == '{"summary": "plain"}'


def test_nearest_against_plain(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(rows, "key long, embedding array<double>")
    size = lambda v: math.sqrt(sum(x * x for x in v))
    got = {}
    for r in V.nearest(df.where("key < 5"), df, 4).collect():
        got.setdefault(r.seed, []).append((r["rank"], r.key))
    for seed, found in got.items():
        wanted = sorted(rows, key=lambda r: (-sum(a * b for a, b in zip(r[1], rows[seed][1])) / size(r[1]) / size(rows[seed][1]), r[0]))[:4]
        assert [k for _, k in sorted(found)] == [k for k, _ in wanted]


def test_jobs(spark):
    jobs = spark.createDataFrame([("1", "running", '{"checkpoint_version": 1}'), ("2", "running", "{}"), ("3", "done", "{}")], "id string, status string, metadata string")
    assert [r.status for r in J.recovered(jobs).orderBy("id").collect()] == ["pending", "failed", "done"]
    work = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    assert J.fingerprint({"a": 1}, work) == J.fingerprint({"a": 1}, work.orderBy(F.desc("x")))
    assert J.fingerprint({"a": 1}, work) != J.fingerprint({"a": 1}, work.where("x = 1"))


def test_pages():
    assert X.page_bounds(None, None) == (50, 0)
    assert X.page_bounds(9999, -3) == (500, 0)
    assert X.page_envelope(101, 50, 50) == {"total": 101, "has_more": True, "current_page": 2, "total_pages": 3}


def test_files(spark, tmp_path):
    from shutterlake.sources import tables as T

    (tmp_path / "street_photo.md").write_text("# Street\n\n<!-- optional: true -->\nbody")
    row = T.read_prompts(spark, str(tmp_path)).first()
    assert (row.slug, row.display_name, row.optional) == ("street_photo", "Street Photo", 1)
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    assert T.export_csv(df, str(tmp_path / "csv")) and not T.export_csv(df.limit(0), str(tmp_path / "none"))
    assert T.export_then_drop(df, str(tmp_path / "json")) == 1


def test_prompts_seed_an_empty_table_only(spark, tmp_path):
    from shutterlake.schema import TABLES
    from shutterlake.sources import tables as T

    (tmp_path / "b_two.md").write_text("# Two\n\nbody")
    (tmp_path / "a_one.md").write_text("# One\n\nbody")
    none = spark.createDataFrame([], TABLES["perspectives"])
    seeded = T.seeded(none, str(tmp_path))
    assert seeded.schema.simpleString() == none.schema.simpleString()
    assert [(r.id, r.slug, r.active) for r in seeded.orderBy("id").collect()] == [(1, "a_one", 1), (2, "b_two", 1)]
    kept = seeded.where("id = 2")
    assert T.seeded(kept, str(tmp_path / "nowhere")) is kept


def test_schema_round_trip(spark, tmp_path):
    from shutterlake.schema import TABLES
    from shutterlake.sources import tables as T

    df = spark.createDataFrame([], TABLES["perspectives"]).withColumn("more", F.array(F.struct(F.lit(1).alias("x"))))
    T.export_schema(df, str(tmp_path / "schema"))
    assert T.read_schema(spark, str(tmp_path / "schema")) == df.schema


def test_models_are_tried_again_and_replaced(spark):
    from shutterlake.operators import model_calls as M

    slept, asked = [], []

    def model(name, *answers):
        turns = iter(answers)

        def run(x):
            asked.append(name)
            answer = next(turns)
            if isinstance(answer, Exception):
                raise answer
            return answer, x

        return run

    # the second try answers, after the wait that the failure asks for
    assert M.call([model("a", M.Unavailable(after=5.0), "yes")], 7, (1, 2), slept.append) == (("yes", 7), 0)
    # every wait is used before the next model is asked
    first = model("a", *[M.Unavailable()] * 3)
    assert M.call([first, model("b", "yes")], 7, (1, 2), slept.append) == (("yes", 7), 1)
    assert slept == [5.0, 1, 2] and asked == ["a", "a", "a", "a", "a", "b"]
    with pytest.raises(M.Unavailable):
        M.call([model("a", M.Unavailable()), model("b", M.Unavailable())], 7, (), slept.append)
    # a refused request is neither tried again nor given to another model
    with pytest.raises(ValueError, match="refused"):
        M.call([model("c", ValueError("refused")), model("d", "yes")], 7, (1,), slept.append)
    assert asked[-1] == "c" and len(slept) == 3

    def down(values):
        from shutterlake.operators.model_calls import Unavailable

        raise Unavailable("down")

    rows = spark.createDataFrame([(1, "x"), (2, "yy")], "key long, text string")
    got = V.encode(rows, [down, lambda values: [[len(v), 0] for v in values]], "text", 2, waits=()).collect()
    assert sorted((r.key, list(r.embedding)) for r in got) == [(1, [1.0, 0.0]), (2, [1.0, 0.0])]


def test_stream_of_bursts(spark, tmp_path):
    from shutterlake.streaming import bursts as B

    start = dt.datetime(2024, 1, 1)
    rows = [(1, start), (1, start + dt.timedelta(seconds=2)), (1, start + dt.timedelta(hours=1)), (1, start + dt.timedelta(hours=9))]
    spark.createDataFrame(rows, "camera long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = B.follow(spark, str(tmp_path / "in"), "camera long, ts timestamp")
    q = B.burst_sessions(stream, "ts", "camera").writeStream.outputMode("append").format("memory").queryName("burst_test").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.members for r in spark.sql("SELECT members FROM burst_test").collect()) == [1, 2]


def test_wrong_links_and_perspectives(spark):
    links = spark.createDataFrame([(1, 7), (11, 7), (5, 9)], "image long, tag long")
    names = spark.createDataFrame([(7, "k")], "id_local long, name string")
    images = spark.createDataFrame([(11, 1), (12, 2)], "id_local long, rootFile long")
    assert [tuple(r) for r in Y.wrong_keyword_links(links, names, images).collect()] == [(1, 7, 11)]
    schema = "id long, slug string, prompt_markdown string, optional long, updated_at string, created_at string"
    old = spark.createDataFrame([(1, "a", "x", 0, "1", "1")], schema)
    new = spark.createDataFrame([(9, "a", "<!-- optional: TRUE -->", 0, "2", "2"), (2, "b", "y", 1, "2", "2")], schema)
    assert sorted(tuple(r)[:4] for r in Y.upsert_perspective(old, new).collect()) == [(1, "a", "<!-- optional: TRUE -->", 1), (2, "b", "y", 0)]


def test_composite_resumes(spark, tmp_path):
    start, ran = {"a": spark.range(3)}, []

    def stage(name):
        def run(tables):
            ran.append(name)
            return {"a": tables["a"].withColumn(name, F.lit(1))}

        return name, run

    R.composite([stage("x")], start, str(tmp_path))
    out = R.composite([stage("x"), stage("y")], start, str(tmp_path))
    assert ran == ["x", "y"] and out["a"].columns == ["id", "x", "y"] and out["a"].count() == 3


def test_path_states_and_attributes(spark):
    images = spark.createDataFrame([("a", "/a"), ("b", " "), ("c", "/c"), ("d", "/d")], "key string, filepath string")
    wanted = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    cache, files = spark.createDataFrame([("d",)], "key string"), spark.createDataFrame([("/a",)], "path string")
    got = {r.key: r.state for r in C.classify_paths(wanted, images, cache, files).collect()}
    assert got == {"a": "readable", "b": "empty_path", "c": "unresolved", "d": "cached", "e": "no_row"}
    rows = spark.createDataFrame([("[]", "[]"), (None, None), ('["red"]', '["calm"]')], "c string, m string")
    color, mood = X.visual_attributes(F.col("c"), F.col("m"), F.lit('{"dominant_colors":["blue"],"mood":" dark "}'))
    assert [tuple(r) for r in rows.select(color, mood).collect()] == [('["blue"]', "[]"), ('["blue"]', '["dark"]'), ('["red"]', '["calm"]')]

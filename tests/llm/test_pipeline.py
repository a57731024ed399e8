"""The pipeline on a small corpus with one case for each stage, and the registration of its queries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from shutterlake.llm import bpe, queries


def text(seed, lines=6, lang="en"):
    draw = random.Random(seed)
    parts = {"en": "the of and ing ion er ea th st ly re".split(), "de": "sch ung keit ein der ich pf tz ge ver zu".split()}[lang]
    word = lambda: "".join(draw.choices(parts, k=draw.randint(1, 4)))
    return "\n".join(" ".join(word() for _ in range(14)).capitalize() + "." for _ in range(lines))


def corpus():
    rows = [(i, text(i, lang="en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(40)]
    rows += [(50, None, "en"), (51, "1234 ...", "en"), (54, "日本語の文章です", None), (56, rows[9][1].split(" ")[0], "en"), (52, rows[3][1], "en")]
    near = rows[5][1].replace("\n", " ").split(" ")
    near[7] = "changed"
    rows += [(53, " ".join(near), "en"), (60, text(60) + "\n" + rows[7][1].split("\n")[2], "en")]
    item = text(99, 3)
    rows += [(61, text(61) + " " + item + " " + text(62), "en")]
    return rows, [(1, item), (2, text(98, 3))]


def test_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left, seen = {i for i, _, _ in rows}, docs
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:4], [{50, 51, 54}, {52}, {53}, {61}], strict=True):
        seen = stage(spark, seen, str(tmp_path))
        left -= gone
        assert seen.columns == docs.columns and {r.doc_id for r in seen.select("doc_id").collect()} == left, name
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.BPE_RANKS), special_tokens={})
    wanted = {i: t for i, t, _ in rows}
    # the line that document 7 had before it
    wanted[60] = "\n".join(wanted[60].split("\n")[:-1])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == left
    for r in got:
        ids = known.encode_ordinary(wanted[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(wanted[r.doc_id].encode()).hexdigest()


def test_stages_on_hard_rows(spark, tmp_path):
    rows, items = corpus()
    item = items[0][1]
    hard = [(None, "no item here, " + text(70)), (None, text(71) + " " + item), (None, None), (80, item), (80, text(72)), (81, ""), (82, text(73, 3000))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, `a.b` string, id string, fit string"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "x", "y", "z") for i, t in hard], schema)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, df, str(tmp_path))
        assert got.columns == df.columns, name
        found = [(r.doc_id, r.text) for r in got.collect()]
        if name == "decontamination":
            assert sorted(found, key=repr) == sorted([hard[0], hard[2], hard[5], hard[6]], key=repr)
        elif name == "language_id":
            assert len(found) == 5 and (81, "") not in found
        else:
            assert len(found) == len(hard)
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.byte_bpe(spark, df, str(tmp_path)).count() == len(hard)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= names


def test_bpe_folds_each_word_of_the_table_once_in_spark(spark, tmp_path, monkeypatch):
    """The stage and op1's operator fold by higher-order functions, over the distinct words of the table."""
    rows = [(i, f"common words {i} " + "qzx" * 30) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for coded in (corpus_pipeline.byte_bpe(spark, df, str(tmp_path)), bpe.encode(df, queries.BPE_RANKS, public_tokenizers.PATTERN)):
        plan = coded._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(sequence" in plan and "Aggregate [word" in plan, plan[:2000]


def test_near_duplicates_leave_the_texts_where_they_are(spark, tmp_path):
    """Few ids that go are broadcast, however many are looked at."""
    rows = [(i, text(i, 2), "en", "s", 0) for i in range(1500)] + [(1500, text(3, 2), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        left = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        plan = left._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
        assert left.count() == 1500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bpe_blocks_are_put_together_some_documents_at_a_time(spark):
    """A block of several runs of documents, and words that take many merges, give tiktoken's ids."""
    draw = random.Random(5)
    rows = [(i, "a b " * 100_000 + "".join(draw.choices("abeinrst the", k=400)) + text(i)) for i in range(8)]
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.BPE_RANKS), special_tokens={})
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    wanted = {i: hashlib.sha256(np.array(known.encode_ordinary(t), dtype="<u4").tobytes()).hexdigest() for i, t in rows}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.byte_bpe(spark, df, "").collect()} == wanted


def test_bpe_splits(spark, tmp_path):
    """Each piece has one last merge, of halves that come before it; a vocabulary where that fails is folded by the loop."""
    ranks, found = bpe.load_ranks(queries.BPE_RANKS), bpe.splits(queries.BPE_RANKS)
    assert set(found) == {p for p in ranks if 1 < len(p) <= bpe.FOLD_BYTES}
    assert all(max(ranks[p[:at]] if at > 1 else -1, ranks[p[at:]] if len(p) - at > 1 else -1) < ranks[p] for p, at in found.items())
    pieces = [b"a", b"b", b"c", b"abc", b"ab"]
    (tmp_path / "odd").write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for i, p in enumerate(pieces)))
    with pytest.raises(ValueError):
        bpe.splits(str(tmp_path / "odd"))
    df = spark.createDataFrame([(1, "abcab")], "doc_id long, text string")
    assert bpe.encode(df, str(tmp_path / "odd"), public_tokenizers.PATTERN).first().ids == [3, 4]


def test_bpe_documents_stay_in_place_and_words_go_by_parts(spark):
    """Only words and ids are shuffled, several words a part, some in several blocks and some too long for the fold."""
    rows = [(i, " ".join(f"word{j * 7919 % 10007}x{j % 5}" for j in range(i * 500, i * 500 + 1500)) + " " + "qzx" * (30 + i)) for i in range(6)]
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.BPE_RANKS), special_tokens={})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    coded = bpe.encode(df, queries.BPE_RANKS, public_tokenizers.PATTERN)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(home" not in plan, plan[:5000]
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: known.encode_ordinary(t) for i, t in rows}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("blocks")]


def test_bpe_rank_map_is_not_spelled_out_in_plans(spark):
    """Each description of a plan would hold the map's megabytes, and the driver keeps them."""
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    coded = bpe.encode(df, queries.BPE_RANKS, public_tokenizers.PATTERN)
    assert len(coded._jdf.queryExecution().toString()) < 200_000
    # the map is no column of the rows either: the steps that name and use it are put together
    assert "AS ranks" not in coded._jdf.queryExecution().optimizedPlan().toString()


def test_bpe_fold_looks_up_neighbours_only(spark, tmp_path):
    """A word's pieces are looked up in pairs, not all its parts, and ids are put in place of pieces once; a piece that no merge makes is a whole word or nothing."""
    df = spark.createDataFrame([(1, "xabcd abcd"), (2, "abcd"), (3, "xabcdxabcdd")], "doc_id long, text string")
    coded = bpe.encode(df, queries.BPE_RANKS, public_tokenizers.PATTERN)
    plan = coded.select(bpe.decode(F.col("ids"), queries.BPE_RANKS))._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(" not in plan and "exists(" not in plan
    ranks = {bytes([b]): b for b in range(256)} | {p: 256 + i for i, p in enumerate([b"xa", b"ab", b"bc", b"bcd", b"abcd"])}
    (tmp_path / "own").write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for p, i in ranks.items()))
    assert bpe.in_order(str(tmp_path / "own")) and b"abcd" not in bpe.splits(str(tmp_path / "own"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode(df, str(tmp_path / "own"), public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in coded.collect()} == {r.doc_id: known.encode_ordinary(r.text) for r in df.collect()}

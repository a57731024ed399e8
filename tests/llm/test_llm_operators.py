"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from shutterlake.llm import bpe, caps, decontaminate, html, langid, lines, minhash, repeats, toxicity, warc
from shutterlake.llm.common import connected_components, new_path, shared_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def prose(seed, words, vocabulary=400):
    draw = random.Random(seed)
    known = ["".join(random.Random(i).choices("abcdefghij", k=2 + i % 7)) for i in range(vocabulary)]
    return " ".join(draw.choice(known) for _ in range(words))


# --- op1 -----------------------------------------------------------------------


@pytest.mark.parametrize("higher_order", [False, True])
def test_bpe_like_tiktoken(spark, higher_order):
    rows = [(1, None), (2, ""), (3, "don't  stop\n\n  　x"), (4, "日本語 🎉🎉 àé"), (5, "a" * 700 + " " + "qzx" * 300), (6, prose(1, 300)), (6, prose(1, 300)), (None, "x")]
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    df = docs(spark, rows).withColumns({"c0": F.lit(1), "ids": F.lit("clash"), "words": F.lit(2)})
    coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN, ids_bytes="raw", higher_order=higher_order)
    assert coded.columns == ["doc_id", "c0", "words", "ids", "raw"]
    got = coded.withColumn("back", bpe.decode(F.col("ids"), RANKS)).collect()
    wanted = collections.Counter((i, tuple(known.encode_ordinary(t or ""))) for i, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == wanted
    assert all(bytes(r.raw) == np.array(r.ids, dtype="<u4").tobytes() for r in got)
    assert collections.Counter((r.doc_id, bytes(r.back)) for r in got) == collections.Counter((i, (t or "").encode()) for i, t in rows)


def test_bpe_empty_table_and_unknown_ids(spark):
    assert bpe.encode(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    bad = spark.createDataFrame([([1, 60000],), ([-1],), (None,), ([],)], "ids array<int>").select(bpe.decode(F.col("ids"), RANKS).alias("b")).collect()
    assert [r.b for r in bad] == [None, None, None, b""]


# --- op2 -----------------------------------------------------------------------


def test_toxicity(spark):
    rows = [(i, prose(i, 60) + (" vile rotten" * (1 + i % 3) if i % 4 == 0 else "")) for i in range(200)] + [(900, None), (901, ""), (None, "vile rotten vile")]
    labels = spark.createDataFrame([(i, int(i % 8 != 0), int(i % 4 == 0)) for i in range(160)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows).withColumn("grade", F.lit("clash"))
    model = toxicity.learn(df, toxicity.grades(labels))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    got = toxicity.score(df, model).collect()
    assert all(r.toxic == ("vile" in (r.text or "")) for r in got)
    assert all(0 <= r.expected_severity <= 2 for r in got) and len(got) == len(rows)


def test_toxicity_without_labels(spark):
    model = toxicity.learn(docs(spark, [(1, "x")]), spark.createDataFrame([], "doc_id long, grade int"))
    assert toxicity.score(docs(spark, [(1, "x"), (2, None)]), model).agg(F.sum("expected_severity")).first()[0] == 0


def test_toxicity_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, prose(i % 90, 40) + (" vile rotten" if i % 90 % 4 == 0 else "")) for i in range(180)]
    # equal texts with labels that disagree
    labels = spark.createDataFrame([(i, 1, int(i % 90 % 4 == 0 and i < 150)) for i in range(180)], "doc_id long, quality int, toxic int")
    rows += [(500, "vile " * 30000), (501, ""), (501, "")]
    found = []
    for order in (rows, rows[::-1]):
        df = docs(spark, order)
        got = toxicity.score(df, toxicity.learn(df, toxicity.grades(labels))).collect()
        assert len(got) == len(rows)
        found.append(sorted((r.doc_id, round(r.expected_severity, 9)) for r in got))
    assert found[0] == found[1]
    empty = docs(spark, [])
    assert toxicity.score(empty, toxicity.learn(empty, toxicity.grades(labels))).count() == 0


def test_cumulative_link_fit():
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=400), None
    y = (x + draw.logistic(size=400) > 0).astype(int) + (x + draw.logistic(size=400) > 1.5).astype(int)
    w, t = toxicity.fit_cumulative_link(np.arange(400), np.zeros(400, dtype=int), x, y, 1)
    assert 0.3 < w[0] < 2 and t[0] < t[1]


# --- op3 -----------------------------------------------------------------------


def plain_lines(rows, min_chars):
    order = sorted({(2**63 - 1 if i is None else i, t) for i, t in rows if t is not None})
    text = [(i, t.split("\n")) for i, t in order]
    gone, k = {(i, "\n".join(x)): np.zeros(len(x), bool) for i, x in text}, 1
    while True:
        seen, twice = set(), False
        for i, x in text:
            for p in range(len(x) - k + 1):
                run = tuple(x[p : p + k])
                if run in seen:
                    twice = True
                    if sum(map(len, run)) + k - 1 >= min_chars:
                        gone[i, "\n".join(x)][p : p + k] = True
                seen.add(run)
        if not twice:
            return {key: "\n".join(x for x, g in zip(key[1].split("\n"), v) if not g) for key, v in gone.items()}
        k *= 2


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_against_plain(spark, seed):
    draw = random.Random(seed)
    known = [f"line {c * 5}" for c in "abcdefgh"] + ["x", "y", ""]
    rows = [(i, "\n".join(draw.choices(known, k=draw.randint(1, 25)))) for i in range(20)]
    rows += [(30, None), (31, ""), (None, "only here and long enough"), rows[3], (40, "same\n" * 40)]
    wanted = plain_lines(rows, 9)
    got = lines.dedup(docs(spark, rows).withColumns({"id": F.lit(1), "key": F.lit(2), "at": F.lit(3), "n_lines": F.lit("clash")}), 9).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((i, None if t is None else wanted[2**63 - 1 if i is None else i, t]) for i, t in rows)


def plain_later_runs(rows, min_chars):
    """As plain_lines, with runs of every length."""
    order = sorted({(2**63 - 1 if i is None else i, t) for i, t in rows if t is not None})
    text = [(i, t.split("\n")) for i, t in order]
    gone = {(i, "\n".join(x)): np.zeros(len(x), bool) for i, x in text}
    for k in range(1, max(len(x) for _, x in text) + 1):
        seen = set()
        for i, x in text:
            for p in range(len(x) - k + 1):
                run = tuple(x[p : p + k])
                if run in seen and sum(map(len, run)) + k - 1 >= min_chars:
                    gone[i, "\n".join(x)][p : p + k] = True
                seen.add(run)
    return {key: "\n".join(x for x, g in zip(key[1].split("\n"), v) if not g) for key, v in gone.items()}


@pytest.mark.parametrize("min_chars", [0, 9, 20])
def test_line_dedup_of_every_length(spark, min_chars):
    draw = random.Random(5)
    menu, uneven, poem = "Home\nAbout us\nContact", "five5\n5five\n" + "thirty" * 5, "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk"
    rows = [(i, f"only in {i}\n{menu}\nlast of {i}") for i in range(3)] + [(10 + i, f"{i}\n{uneven}\n{i}{i}") for i in range(3)]
    rows += [(20, poem), (21, f"z\n{poem}"), (22, poem[2:]), (23, poem[::-1]), (24, "\n" * 30), (25, "x\n" * 9), (None, menu), (26, None), (27, "")]
    rows += [(30 + i, "\n".join(draw.choices(["x", "yy", "", "line z", "long " * 5], k=draw.randint(1, 40)))) for i in range(25)] + [(20, poem)]
    wanted = plain_later_runs(rows, min_chars)
    got = lines.dedup(docs(spark, rows), min_chars).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((i, None if t is None else wanted[2**63 - 1 if i is None else i, t]) for i, t in rows)
    if min_chars == 20:
        found = {r.doc_id: r.text for r in got}
        assert found[1] == "only in 1\nlast of 1" and found[11] == "1\n11" and found[21] == "z"


def test_line_suffix_array(spark):
    rows = lines.suffix_array(docs(spark, [(1, "a\nb\nc"), (2, "z\na\nb\nc"), (3, "b")])).collect()
    assert {(r.doc_id, r["at"], r.lcp) for r in rows} == {(1, 0, 2), (2, 1, 2), (1, 1, 2), (2, 2, 2), (3, 0, 1), (1, 2, 1), (2, 3, 1)}
    assert lines.suffix_array(docs(spark, [])).count() == 0 and lines.dedup(docs(spark, [])).count() == 0


# --- op4 -----------------------------------------------------------------------


def plain_repeats(rows):
    raw = [(t or "").encode() for _, t in rows]
    times = collections.Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    out = []
    for (i, _), b in zip(rows, raw):
        mark = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 199):
            if times[b[p : p + 200]] > 1:
                mark[p : p + 200] = True
        edges = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        out.append((i, len(b), int(mark.sum()), edges, hashlib.sha256(bytes(c for c, m in zip(b, mark) if not m)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("crowd", [1, 2048])
def test_repeats_against_plain(spark, crowd, monkeypatch):
    passage = prose(7, 60)
    rows = [(1, "ab" * 400), (2, "x" * 205), (3, "ab" * 100), (4, None), (5, ""), (6, "q" * 199), (7, "abc" * 90 + "z" + "abc" * 90)]
    rows += [(10 + i, prose(i, 40) + passage[i:] + prose(50 + i, 40)) for i in range(12)] + [(None, "hello" * 50), (None, "hello" * 50), (10, "é" * 150)]
    rows += [(40, passage[:200]), (41, passage[:199]), (42, prose(3, 200)), (43, prose(3, 200)[5:-5])]
    monkeypatch.setattr(repeats, "CROWD", crowd)
    df = docs(spark, rows).withColumns({"row": F.lit(1), "bytes": F.lit("clash")})
    got = repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows)


def test_repeats_of_hot_keys(spark, monkeypatch):
    """Phrases and triggers that have more than one in ``HOT`` rows are dealt over salts: the same rows are found."""
    draw = np.random.default_rng(8)
    word = lambda n: "".join(map(chr, draw.integers(97, 123, n)))
    copy = word(900)
    rows = [(i, copy) for i in range(40)] + [(100 + i, word(400) + copy[:350] + word(300)) for i in range(10)] + [(200, word(700)), (201, None)]
    wanted = sorted(tuple(r) for r in repeats.remove_repeats(docs(spark, rows)).collect())
    assert [(r[1], r[2]) for r in wanted[:40]] == [(900, 900)] * 40 and all(r[2] >= 350 for r in wanted[40:50]) and wanted[50][2] == 0
    for hot, salts in ((10**9, 3), (1, 64), (5, 7)):
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "SALTS", salts)
        assert sorted(tuple(r) for r in repeats.remove_repeats(docs(spark, rows)).collect()) == wanted


def test_repeats_leave_no_table(spark, monkeypatch):
    """The table of texts is dropped and its files are deleted when a step fails, too."""

    def fails(texts):
        raise RuntimeError("stopped")

    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    with monkeypatch.context() as patch:
        patch.setattr(repeats, "repeated_spans", fails)
        with pytest.raises(RuntimeError, match="stopped"):
            repeats.remove_repeats(docs(spark, [(1, "x")]))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("repeats_")]
    assert not [f for f in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before if f.startswith("texts")]


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


# --- op5 -----------------------------------------------------------------------


def test_caps_against_plain(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(60, 16))
    near = base[np.arange(40) % 20] + 0.05 * draw.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    rows += [(200, rows[0][1]), (201, [2 * x for x in rows[0][1]]), (202, None), (203, [0.0] * 16), (204, [None] + [1.0] * 15), (205, [float("nan")] + [1.0] * 15), (206, [float("inf")] + [1.0] * 15), (207, []), (208, [1.0, 2.0])]
    # norms that over- and underflow
    rows += [(190, [1e200] + [0.0] * 15), (191, [1e250] + [0.0] * 15), (192, [0.0, 1e-200] + [0.0] * 14), (193, [0.0, 5e-200] + [0.0] * 14)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "rep": F.lit(2)})
    good = [(i, np.array(v) / max(v, key=abs) / np.linalg.norm(np.array(v) / max(v, key=abs)) * np.sign(max(v, key=abs))) for i, v in rows if i < 202]
    links = {i: {j for j, w in good if j != i and v @ w >= 0.95} for i, v in good}
    got = {r.vec_id: r for r in caps.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    assert {i: got[i].n_links for i in got} == {i: len(links.get(i, ())) for i, _ in rows}
    for i in got:
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (got[i].component_id, got[i].kept) == (min(seen), min(seen) == i)


def test_caps_recall_at_the_threshold():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.normal(size=x.shape)
    y -= x * (x * y).sum(axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = caps.decode_filters(x), caps.decode_filters(y)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a, b)]) > 0.98


def at_the_threshold(size, pairs):
    draw = np.random.default_rng(100 + size)
    x, y = draw.normal(size=(2, pairs, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= x * (x * y).sum(axis=1, keepdims=True)
    return x, 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


@pytest.mark.parametrize("size", [2, 4, 5, 8, 16, 64])
def test_caps_miss_no_pair(size):
    a, b = (caps.list_filters(v) for v in at_the_threshold(size, 10000))
    assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist()))


def test_caps_recall_in_clusters():
    """Crowds around a few centres, and pairs in them at 0.95, 0.96 and 0.98."""
    draw = np.random.default_rng(9)
    centre = draw.normal(size=(5, 64))[draw.integers(0, 5, 3000)]
    x = centre / np.linalg.norm(centre, axis=1, keepdims=True) + 0.05 * draw.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cosine in (0.95, 0.96, 0.98):
        y = draw.normal(size=x.shape)
        y -= x * (x * y).sum(axis=1, keepdims=True)
        y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        a, b = caps.list_filters(x).tolist(), caps.list_filters(y).tolist()
        assert np.mean([not set(p).isdisjoint(q) for p, q in zip(a, b)]) >= 0.999, cosine


def test_caps_in_few_dimensions(spark):
    sizes = [1, 2, 4, 5, 8]
    rows = [(1000 * d + i, v.tolist()) for d in sizes[1:] for i, v in enumerate(np.concatenate(at_the_threshold(d, 60)) * 3)] + [(1, [2.0]), (2, [5.0]), (3, [-1.0])]
    got = {r.vec_id: r.n_links for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9499).collect()}
    for d in sizes:
        own = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if len(v) == d]
        assert {i: got[i] for i, _ in own} == {i: sum(j != i and v @ w >= 0.9499 for j, w in own) for i, v in own}


def clusters(seed, sizes, spread):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(len(sizes), 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return np.concatenate([c + spread * draw.normal(size=(n, 64)) / 8 for c, n in zip(centres, sizes)])


@pytest.mark.parametrize(("few", "block"), [(64, 1024), (8, 32), (2, 16)])
def test_caps_in_crowds_against_plain(spark, monkeypatch, few, block):
    """Clusters whose filters are fuller than ``FEW`` (in one block or many), with copies: each link counts once."""
    monkeypatch.setattr(caps, "FEW", few)
    monkeypatch.setattr(caps, "BLOCK", block)
    v = clusters(4, [160, 90, 30, 5, 1, 1], 0.24)
    v = np.concatenate([v, v[:7], v[:1], 3 * v[200:203]])
    units = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = units @ units.T >= 0.95
    assert 0.2 < linked[:160, :160].mean() < 0.9
    np.fill_diagonal(linked, False)
    least = np.arange(len(v))
    while True:
        after = np.minimum(least, np.where(linked, least[None, :], len(v)).min(axis=1))
        if (after == least).all():
            break
        least = after
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.near_duplicates(rows).collect()}
    assert got == {i: (int(linked[i].sum()), int(least[i]), bool(least[i] == i)) for i in range(len(v))}


def test_caps_blocks_give_no_pairs():
    """A block's result is a row for each linked member, however many links there are."""
    v = clusters(5, [300], 0.1)
    lists = [[7]] * 200 + [[3, 7]] * 100
    rows = pa.table({"rep": np.arange(300), "i": np.arange(300) % 2, "copies": np.ones(300, dtype=np.int64), "embedding": pa.array(v.tolist()), "crowded": pa.array(lists, pa.list_(pa.int64()))})
    key = [pa.scalar(x) for x in (7, 64, 0, 0)]
    out = caps._block_links(0.95)(key, rows).to_pydict()
    assert len(out["rep"]) == 300 and set(out["root"]) == {0}
    # the last hundred share filter 3 as well, under which their links count
    assert out["linked"] == [299] * 200 + [200] * 100
    key[3] = pa.scalar(1)
    assert caps._block_links(0.95)(key, rows).to_pydict()["linked"] == [150] * 200 + [100] * 100


def test_caps_grow_with_the_table():
    """More vectors, more directions; the codes together still miss next to no pair."""
    wide, codes = caps.code_shape(64, total=10_000_000)
    assert wide**4 > 50 * 10_000_000 and wide > caps.code_shape(64, total=1000)[0] == caps.CODES
    assert caps.missed_by_code(64, wide=wide) ** codes <= caps.MISSES
    assert caps.code_shape(16, total=10**12)[0] < 128 and caps.code_shape(4, total=10**9)[1] == 0
    a, b = (caps.list_filters(v, total=10_000_000) for v in at_the_threshold(64, 3000))
    assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4} | {i: 100 for i in range(101, 141)}


# --- op6 -----------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = langid.pieces_of(PIECES)
    logp = np.log(pieces.start / pieces.start.sum())[:, None]
    ranks = bpe.load_ranks(PIECES)
    number = {p: i for i, p in enumerate(sorted(ranks, key=ranks.__getitem__))}

    def total(raw):
        ways = [1.0] + [0.0] * len(raw)
        for end in range(1, len(raw) + 1):
            for start in range(end):
                if raw[start:end] in number:
                    ways[end] += ways[start] * np.exp(logp[number[raw[start:end]], 0])
        return np.log(ways[-1])

    words = ["the", "a", "été", "straße", "nothing", "the", "information", "responsibility", "antidisestablishmentarianism" * 3]
    assert np.allclose(langid.forward(PIECES, words, logp)[:, 0], [total(b" " + w.encode()) for w in words])
    # the expected uses cover every byte of every word
    counts = langid.expected_counts(PIECES, words, np.ones(len(words)), logp[:, 0])
    sizes = np.array([len(p) for p in sorted(ranks, key=ranks.__getitem__)])
    assert np.isclose((counts * sizes).sum(), sum(len(w.encode()) + 1 for w in words))


def test_forward_sums_of_words_beyond_a_double():
    """Words about the lengths where sums are rescaled, and of thousands of letters, against sums of logarithms."""
    pieces = langid.pieces_of(PIECES)
    names = sorted((r := bpe.load_ranks(PIECES)), key=r.__getitem__)
    number = {p: i for i, p in enumerate(names)}
    rare = np.where(np.array([len(p) for p in names]) == 1, -40.0, -5.0)
    logp = np.column_stack([np.log(pieces.start / pieces.start.sum()), rare])

    def total(raw, k):
        sums = [0.0] + [-np.inf] * len(raw)
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - len(pieces.by_length)), end):
                if raw[start:end] in number:
                    sums[end] = np.logaddexp(sums[end], sums[start] + logp[number[raw[start:end]], k])
        return sums[-1]

    words = [("information" * 300)[:n] for n in (1, 6, 7, 8, 9, 14, 15, 16, 17, 40, 700, 3000)] + ["q" * 900, "\u4e00" * 300]
    wanted = [[total(b" " + w.encode(), k) for k in (0, 1)] for w in words]
    assert np.allclose(langid.forward(PIECES, words, logp), wanted, rtol=1e-12, atol=1e-9)


def test_language_id(spark):
    said = {"en": "the quick house and the garden with water", "de": "das schnelle haus und der garten mit wasser"}
    rows = [(i, said[k], k) for i in range(20) for k in said] + [(50, None, "en"), (51, "12 !", "de"), (52, "der garten", None), (53, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.predict(df, langid.learn(df, PIECES)).where("doc_id >= 50 or lang = 'en'").collect()}
    assert [got[i].lang_pred for i in (0, 50, 51, 52, 53)] == ["en", "und", "und", "de", "und"]
    assert got[50].score == 0 and 0.9 < got[52].score <= 1
    none = langid.learn(df.limit(0), PIECES)
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_language_id_held_out(spark):
    ends = {"en": "ing ed ly tion the".split(), "de": "ung heit lich ver sch".split(), "fr": "eau eux tion oir é".split()}

    def said(seed, k):
        draw = random.Random(seed)
        return " ".join(draw.choice("abdeilmnorst") + draw.choice("aeiou") + draw.choice(ends[k]) for _ in range(1 + seed % 30))

    rows = [(i, said(i, k), k) for i, k in enumerate(list(ends) * 80)]
    long = " ".join(said(i, "de") for i in range(2000))
    rows += [(1000, long, "de"), (1001, rows[1][1], "de"), (1001, rows[1][1], "de"), (None, rows[0][1], "en"), (1002, "日本語の文章", None), (1003, "xkqjz wvbnx qqzx", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", langid.held_out(F.col("doc_id")))
    got = langid.predict(df, langid.learn(df.where(~F.col("held_out")), PIECES)).collect()
    assert len(got) == len(rows)
    tested = [r.lang_pred == r.lang for r in got if r.held_out and r.lang]
    assert len(tested) > 40 and np.mean(tested) > 0.95
    told = {r.doc_id: r for r in got}
    assert told[1000].lang_pred == "de" and told[1000].fit > 0 and min(r.fit for r in got if r.lang) > 0
    assert told[1002].fit < 0 and told[1003].fit < 0


# --- op7 -----------------------------------------------------------------------


def plain_near(rows, width, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    near = collections.defaultdict(set)
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i != j and a and b and 100 * len(a & b) >= percent * len(a | b):
                near[i].add(j)
    out = []
    for i, a in sets:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        low = None if i is None else min(seen)
        out.append((i, len(a), low, i is None or low == i))
    return collections.Counter(out)


@pytest.mark.parametrize("few", [2, 24])
def test_minhash_against_plain(spark, few, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    draw = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "a b"), (7, "a b c"), (8, "a b c"), (None, "a b c"), (8, "a b c")]
    for g in range(6):
        words = prose(g, 120).split()
        for c in range(8):
            other = list(words)
            for _ in range(draw.randint(0, 6)):
                other[draw.randrange(len(other))] = f"w{draw.random()}"
            rows.append((100 + 10 * g + c, " ".join(other)))
    rows += [(900, prose(0, 5000)), (901, prose(0, 5000).upper()), (8, prose(2, 120))]
    df = docs(spark, rows).withColumns({"rep": F.lit(1), "bands": F.lit("clash")})
    got = minhash.near_duplicates(df, 3, 85).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == plain_near(rows, 3, 85)


def test_minhash_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


# --- op8 -----------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body class="no-sidebar"><header>Site</header><nav><a href=/>Home</a></nav>
<!-- <p>not</p> --><div class="cookie notice">We use cookies</div><article><h1>A &amp; B</h1><p>One <b>bo</b>ld&nbsp;word<br>more<p>Second &lt;p&gt; paragraph, long enough to read.
<form><input value=x>Sign up</form><aside>Related</aside></article><div id="comments"><p>Nice article, really well written, thanks.</p></div><footer>&copy; Me</footer></body>"""


def test_main_text():
    assert html.main_text(PAGE, html.DEFAULT_WEIGHTS) == "A & B One bold word more Second <p> paragraph, long enough to read."
    assert html.main_text(None, html.DEFAULT_WEIGHTS) == html.main_text("", html.DEFAULT_WEIGHTS) == ""
    plain = "<body><div><a href=1>x</a> <a href=2>y</a></div><p>" + "A sentence of words, and one more. " * 8 + "</p><div class=footer>c</div>"
    assert html.main_text(plain, html.DEFAULT_WEIGHTS).startswith("A sentence")


def test_markup_does_not_drop_content_for_good():
    said = "A long sentence of many plain words, which goes on and on, as prose does. " * 6
    text = said.strip()
    for page in (
        f'<div class="content no-sidebar"><article><p>{said}</article></div>',
        f'<article class="post comments-open"><p>{said}</article>',
        f'<article class="post widget"><p>{said}</article>',
        f'<div class="sidebar layout"><main><p>{said}</main></div>',
        f'<div class="search"><div class="content"><p>{said}</div></div>',
        f"<form><p>{said}</form>",
        # the looks outweigh the markup
        f'<div class="widget"><p>{said}</div>',
        f"<main><form><p>{said}</form></main>",
    ):
        assert html.main_text(f"<body>{page}</body>", html.DEFAULT_WEIGHTS) == text, page
    assert html.main_text(f"<body><article><p>Short one.</article><div><p>{said}</div></body>", html.DEFAULT_WEIGHTS) == f"Short one. {text}"
    links = "<a href=1>One</a> <a href=2>Two</a>"
    assert html.main_text(f"<body><article><p>{said}</p><ul><li>{links}</ul></article></body>", html.DEFAULT_WEIGHTS) == text
    for page in (f'<div style="display:none"><article><p>{said}</article></div>', "<footer><div class=content>Made by me</div></footer>", "<div id=comments><article class=comment><p>Nice one.</article></div>"):
        assert html.main_text(f"<body>{page}<article><p>{said}</article></body>", html.DEFAULT_WEIGHTS) == text, page


def test_extract_keeps_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<article><p>cut off <b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"c0": F.lit(1), "text": F.lit("clash")})
    got = html.extract(df, html.learn(df)).collect()
    assert len(got) == 4 and {r.n_chars for r in got if r.page_id == 1} == {len("A & B One bold word more Second <p> paragraph, long enough to read.")}
    assert html.extract(df.limit(0), html.learn(df.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_cut_is_minimal(seed):
    draw = random.Random(seed)
    n = draw.randint(1, 8)
    source, sink = [draw.randint(0, 6) for _ in range(n)], [draw.randint(0, 6) for _ in range(n)]
    edges = [(i, j, draw.randint(0, 4)) for i in range(n) for j in range(i) if draw.random() < 0.6]

    def cost(kept):
        return sum(0 if k else s for k, s in zip(kept, source)) + sum(t if k else 0 for k, t in zip(kept, sink)) + sum(c for a, b, c in edges if kept[a] != kept[b])

    best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
    assert abs(cost(html.minimum_cut(source, sink, edges)) - best) < 1e-6


# --- op9 -----------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "<p>" + prose(1, 60) + "</p>"
    rows = [(3, "http://a b", long), (1, None, long), (2, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "ü", "<p>é" + long), (None, "n", long), (None, "n", "only" * 50)] + [(10 + i, "u", prose(i, 80)) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"file": F.lit("clash"), "refers_to": F.lit(1)})
    folder = warc.archive(df)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got if r.page_id is not None}
    assert kinds[1] == ("response", None) and kinds[3] == ("revisit", 1) and kinds[2] == kinds[4] == ("response", None)
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id is None) == [("response", None), ("revisit", 1)]
    whole = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert all(whole[i] == (h or "") for i, _, h in rows if i in whole and i is not None)
    digest = {i: hashlib.sha256((h or "").encode()).hexdigest() for i, _, h in rows if i is not None}
    assert all(r.payload_digest == digest[r.page_id] for r in got if r.page_id is not None)
    none = new_path(spark, "warc")
    warc.write(warc.with_revisits(df.limit(0)), none, b"")
    assert warc.read(spark, none).count() == 0


# --- op10 ----------------------------------------------------------------------


@pytest.mark.parametrize("rows_broadcast", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination_against_plain(spark, monkeypatch, rows_broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows_broadcast)
    items = [(i, prose(100 + i, 10 + 3 * i)) for i in range(10)] + [(20, "two words"), (21, None), (22, ""), (None, prose(1, 20)), (3, prose(103, 19))]
    rows = [(i, prose(i, 200) + " " + items[i][1].upper() + ", " + prose(50 + i, 2000)) for i in range(10)]
    rows += [(30, " ".join(items[5][1].split()[2:])), (31, " ".join(items[5][1].split()[8:])), (32, "here are Two, words!"), (33, None), (34, ""), (None, items[4][1]), (2, rows[2][1])]
    got = decontaminate.contained(docs(spark, rows).withColumn("words", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))).collect()

    def cut(t, n):
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}, len(w)

    wanted = set()
    for j, t in items:
        n = min(5, cut(t, 1)[1])
        for i, d in rows:
            if j is not None and i is not None and n:
                own, common = cut(t, n)[0], cut(t, n)[0] & cut(d, n)[0]
                if len(common) >= 0.8 * len(own):
                    wanted.add((i, j, len(common), len(own)))
    assert {(r.doc_id, r.item_id, r.n_common, r.n_item) for r in got} == wanted and len(got) == len(wanted)


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(docs(spark, [(1, "x")]), none).count() == 0
    assert decontaminate.contained(docs(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0

"""Filter audit, quality classifier and phrase mining against plain versions."""

import glob
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import audit, html, phrases, quality, queries, warc
from shutterlake.llm.common import new_path

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string"
LABEL = "doc_id long, quality int, toxic int"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_collocations"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = queries.QUERIES[name](spark, DATA)
    wanted = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert wanted and sorted(map(tuple, got.collect())) == sorted(wanted)


# ---------------------------------------------------------------- filter audit


def plain_audit(docs, labels):
    """The contract row by row."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    counts = defaultdict(Counter)
    parts = {lang or "" for *_, lang in docs}
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            for step in range(1, 6):
                counts[part, order, step]["kept"] += 0
        for i, text, lang in docs:
            t = text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
            fails += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and least[t] < i)
            place = next((k for k, f in enumerate(order, 1) if f in fails), 6)
            for step, f in enumerate(order, 1):
                c = counts[lang or "", order, step]
                c["kept"] += place > step
                c["removed"] += place == step
                c["redundant"] += f in fails and place < step
                c["unique_fails"] += fails == f
                c["good_lost"] += place == step and i in good
                c["toxic_lost"] += place == step and i in toxic
    share = Counter()
    for (part, order, step), c in counts.items():
        share[part, order[step - 1]] += c["removed"]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return sorted((part, order, step, *(c[n] for n in names), share[part, order[step - 1]]) for (part, order, step), c in counts.items())


def test_audit_equals_plain(spark):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "  \t\n", "one two", long, long.upper(), long + " $", "same " * 400, "Ä b c", long + " |"]
    docs = [(rng.choice([None, *range(12)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(10), 3, 4]]
    # columns whose names clash with those made inside
    table = spark.createDataFrame(docs, DOC).withColumns({"bits": F.lit("x"), "id": F.lit(1), "digest": F.lit(2), "part": F.lit("p"), "good": F.lit(True)}).repartition(5)
    got = audit.interactions(table, spark.createDataFrame(labels, LABEL).withColumn("first", F.lit(1)))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.select(columns).collect())) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    assert audit.interactions(spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)).count() == 0


def test_audit_orders_are_all(spark):
    rows = audit.orders(spark).collect()
    assert {r["filter_order"] for r in rows} == set(map("".join, permutations("ABCDE"))) and len(rows) == 120
    assert all([audit.FILTERS[f] for f in r["filter_order"]] == r["masks"] for r in rows)


# ---------------------------------------------------------- quality classifier


def plain_bag(text):
    """Counts of a text's features, each worked out alone."""
    mask, out = (1 << 64) - 1, Counter([quality.EVERY])
    factor, mix = int(quality._FACTOR), int(quality._MIX)

    def bucket(value, kind):
        x = ((value + kind) & mask) * mix & mask
        x = ((x ^ (x >> 29)) * mix & mask) >> int(quality._SHIFT)
        return max(x, 1)

    hashes = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        hashes.append(sum((ord(c) + 1) * pow(factor, i, 1 << 64) for i, c in enumerate(word)) & mask)
        edged = f" {word} "
        for long in quality.GRAMS:
            for i in range(len(edged) - long + 1):
                value = 0
                for c in edged[i : i + long]:
                    value = (value * factor + ord(c)) & mask
                out[bucket(value, long)] += 1
    out.update(bucket(h, 1) for h in hashes)
    out.update(bucket((b - a) & mask, 2) for a, b in zip(hashes, hashes[1:], strict=False))
    return out


def test_features_equal_plain(monkeypatch):
    rng = random.Random(5)
    texts = ["", " ", "a", "\tab  cd\n", "Größe 日本語 🙂x", "x" * 300, *("".join(rng.choice("ab é\n日 ") for _ in range(rng.randint(0, 90))) for _ in range(40))]
    for cut in (1 << 20, 16, 1):  # long texts in pieces give the same
        monkeypatch.setattr(quality, "SLICE", cut)
        table = np.random.default_rng(1).normal(size=quality.BUCKETS)
        total, count = quality.sums(pa.array(texts), table)
        for text, (buckets, shares), t, n in zip(texts, quality.bags(pa.array(texts)), total, count, strict=True):
            want = plain_bag(text)
            size = sum(want.values())
            assert dict(zip(buckets.tolist(), np.rint(shares * size).astype(int).tolist(), strict=True)) == dict(want)
            assert n == size and t == pytest.approx(sum(table[b] * k for b, k in want.items()))


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    vectors, out, shares = rng.normal(size=(5, quality.SIZE)), rng.normal(size=(2, quality.SIZE)), rng.dirichlet(np.ones(5))
    for label in (0, 1):
        _, by_vector, by_out = quality.gradients(vectors, out, shares, label)
        for array, gradient in ((vectors, by_vector), (out, by_out)):
            for i, j in ((0, 0), (1, 3), (array.shape[0] - 1, quality.SIZE - 1)):
                array[i, j] += 1e-6
                up = quality.gradients(vectors, out, shares, label)[0]
                array[i, j] -= 2e-6
                down = quality.gradients(vectors, out, shares, label)[0]
                array[i, j] += 1e-6
                assert gradient[i, j] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_quality_hard_rows(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs = []
    for i in range(80):
        words = [word() for _ in range(60)]
        docs.append((i, " ".join(words) if i % 3 else " ".join(w.upper() + "!!" for w in words), "en"))
    docs += [(None, "a b", None), (90, None, "en"), (91, "", "en"), (92, "word " * 400_000, "en"), (5, docs[5][1], "en")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 1), (61, None, 1), (3, 0, 0)]
    table = spark.createDataFrame(docs, DOC).withColumns({"score": F.lit("old"), "label": F.lit(1), "c0": F.lit(2)})
    model = quality.learn(table.select("doc_id", "text"), spark.createDataFrame(labels, LABEL))
    got = quality.score(table, model)
    assert got.columns == ["doc_id", "lang", "label", "c0", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= quality.LEAST) for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and 60 <= r["doc_id"] < 80]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 19
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[90] == by_id[91]
    assert quality.score(spark.createDataFrame([], DOC), model).count() == 0


def test_quality_without_labels(spark):
    model = quality.learn(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], LABEL))
    assert [r["score"] for r in quality.score(spark.createDataFrame([(1, "a b", "en")], DOC), model).collect()] == [0.5]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op11_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    right = [r["predicted"] == r["quality"] for r in got]
    assert len(right) > 50 and sum(right) >= 0.95 * len(right)


# --------------------------------------------------------------- phrase mining


def plain_phrases(docs, least=10, most=2000):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            if len(phrase) == 2 and any(100 * g >= 50 * a for longer, g in f.items() if len(longer) == 3 and g >= least and phrase in (longer[:2], longer[1:])):
                continue
            score, k = min((10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase)))
            rows.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def _rows(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def _texts(rng, many):
    words = ["the", "The", "of", "new", "york", "city", "Éa", "日", "x", "a b", "in", "und"]
    between = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?"]
    return ["".join(rng.choice(words) + rng.choice(between) for _ in range(rng.randint(0, 60))) for _ in range(many)]


def test_phrases_equal_plain(spark):
    rng = random.Random(11)
    docs = [(i % 50, t, rng.choice(["en", "en", "en", None, "de", ""])) for i, t in enumerate(_texts(rng, 160))] + [(None, None, "en"), (1, "", None), (2, " ., ", "fr")] * 2
    table = spark.createDataFrame(docs, DOC).withColumns({"word": F.lit(1), "block": F.lit(2), "n": F.lit(3), "f": F.lit(4)}).repartition(6)
    want = plain_phrases(docs)
    assert len(want) > 50 and _rows(phrases.collocations(table)) == want
    assert _rows(phrases.collocations(table, least=3, most=7)) == plain_phrases(docs, 3, 7)


def test_phrases_in_small_blocks(spark, monkeypatch):
    """Long texts cut at pieces, many ranges, stretches and merges give the same."""
    rng = random.Random(13)
    texts = _texts(rng, 30)
    blocks = list(phrases._cut(pa.array(["ab, cd", "x" * 50 + ". yz", ""])))
    assert pa.concat_arrays(blocks).to_pylist() == ["ab, cd", "x" * 50 + ". yz", ""]
    monkeypatch.setattr(phrases, "BLOCK", 64)
    parts = [b.to_pylist() for b in phrases._cut(pa.array(["ab, cd", "no end " * 20, "x, " * 60]))]
    assert [p[0] for p in parts][:2] == ["ab, cd", "no end " * 20] and "".join(p[0] for p in parts[2:]) == "x, " * 60
    assert all(p[0].endswith((",", " ")) and len(p[0]) <= 64 for p in parts[2:])
    monkeypatch.setattr(phrases, "STARTS", 5)
    ids, codes = np.array([4, 9, 1 << 40]), np.array([0, 1, -1, 2, 2, 2, 2, 0, 1, 1, 0, 1, 2, -1, 0], dtype=np.int32)
    got = Counter()
    for keys, n in phrases._keys(ids, codes):
        for key, k in zip(keys.tolist(), n.tolist(), strict=True):
            got[tuple(np.frombuffer(key.ljust(24, b"\0"), dtype=">i8").tolist())] += k
    want = Counter()
    for i in range(len(codes)):
        for k in (2, 3):
            run = codes[i : i + k]
            if len(run) == k and (run >= 0).all():
                want[(*ids[run].tolist(), *[0] * (3 - k))] += 1
    assert got == want
    monkeypatch.undo()
    one = [(1, ", ".join(texts), "en")]
    assert _rows(phrases.collocations(spark.createDataFrame(one, DOC), least=2)) == plain_phrases(one, 2)


def test_radix_sort_and_run_lengths():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 1 << 62, 40)[rng.integers(0, 40, (3000, 3))]
    ids[::3, 2] = 0
    keys = ids.astype(">i8").view(np.uint8).reshape(-1, 24)
    got, counts = phrases.sorted_counts(keys, np.ones(3000, dtype=np.int64))
    want = Counter(map(bytes, keys))
    assert [bytes(k) for k in got] == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]
    assert len(phrases.sorted_counts(keys[:0], counts[:0])[0]) == 0


def test_phrase_scores_are_exact(spark):
    rows = spark.createDataFrame([(3_000_000_000_000, 3_000_000_000_001, 3_000_000_000_000)], "a long, l long, r long")
    assert rows.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * 3 * 10**12 // (3 * 10**12 + 1)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOC)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], DOC)).count() == 0


# ------------------------------------------------------------ HTML extraction

SAID = "This is a long paragraph of the article, with commas, and it goes on for a while."


@pytest.mark.parametrize("page, text", [
    (f"<head><title>t</title><header>H</header><article><p>{SAID}</p></article>", SAID),
    (f"<head><meta x><p>First. {SAID}</p><header>Menu</header><p>{SAID}</p>", f"First. {SAID} {SAID}"),
    ("İ" * 40 + f"<script>x</script><article><p>{SAID}</p><p>Second. {SAID}</p></article>", f"{SAID} Second. {SAID}"),
    (f"<article><p title=don't>{SAID}</p><p>It's here. {SAID}</p></article>", f"{SAID} It's here. {SAID}"),
    (f"<article><p title = 'a > b' data-x=\"c > d\">{SAID}</p></article>", SAID),
    (f"<article><p>{SAID}</p><script>if (a</scripted>b) x</SCRIPT ><p>After. {SAID}</p></article>", f"{SAID} After. {SAID}"),
    (f"<article><p>{SAID}</p></article><footer>F</footer>", SAID),
    (f"<article><p>{SAID}</p></article><div class='comments'><p>{SAID} {SAID} {SAID}</p></div>", SAID),
])
@pytest.mark.parametrize("fitted", [False, True])
def test_html_loses_no_article_text(page, text, fitted):
    weights = np.array([-3.0, 1.6, -6.0, 1.5, 0.5, 2.0, -0.5]) if fitted else html.DEFAULT_WEIGHTS
    assert html.main_text(page, weights) == text


def test_html_of_very_long_and_deep_pages():
    import time

    for page in ("<article>" + "".join(f"<p>Number {i}, {'and more. ' * (i % 7)}</p>" for i in range(40_000)) + "</article>", "<body>" + "".join(f"<div>Number {i}, {'and more. ' * (i % 5)}" for i in range(40_000))):
        began = time.perf_counter()
        assert "Number 39996, and more." in html.main_text(page, html.DEFAULT_WEIGHTS)
        assert time.perf_counter() - began < 10


def test_minimum_cut_against_every_labelling():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 9)
        source, sink = ([rng.choice([0.0, 0.5, 1.0, rng.random()]) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rng.random()) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda kept: sum(sink[i] if kept[i] else source[i] for i in range(n)) + sum(c for a, b, c in edges if kept[a] != kept[b])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html.minimum_cut(source, sink, edges)) == pytest.approx(best)


# ------------------------------------------------------------------------ WARC


def test_warc_read_in_stretches(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, f"u{i}", "".join(rng.choice("abcdef <>") for _ in range(rng.choice([0, 50, 300, 200_000])))) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    sampled = warc.build_dictionary(df)
    assert len(sampled) <= warc.DICTIONARY_BYTES
    folder = new_path(spark, "warc")
    warc.write(warc.with_revisits(df), folder, sampled)
    whole = {r["page_id"]: r for r in warc.read(spark, folder).collect()}
    bare = warc.read(spark, folder, payloads=False)
    assert "payload" not in bare.columns and bare.where("not intact").count() == 0 and bare.count() == len(rows)
    for i, _, text in rows:
        r = whole[i]
        assert r["payload_bytes"] == len(text) and (r["record_type"] == "revisit" or r["payload"] == text)


def test_warc_stretches_are_bounded(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(warc, "READ_BYTES", 100)
    lengths = [10, 90, 1, 250, 40, 60, 5]
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    part = pd.DataFrame({"offset": offsets, "length": lengths}).sample(frac=1, random_state=1)
    got = list(warc._stretches(part))
    assert [list(s["length"]) for s in got] == [[10, 90], [1], [250], [40, 60], [5]]

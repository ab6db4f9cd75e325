import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumidisc.llm import decontamination, jaccard_join, language, licenses, ngram_model, packing, pii, quality, tokens, toxicity
from lumidisc.llm import kernels as k
from lumidisc.llm.common import first_by_hash, fold
from lumidisc.llm.components import components, roots
from tests_llm_fixtures import WORD, components_by_force, lowered

public_tokenizers = pytest.importorskip("public_tokenizers")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# kernels
def test_words_are_those_of_the_pattern():
    r = random.Random(3)
    texts = ["".join(r.choice("abÉé \t\n\x0b\x1c1") for _ in range(r.randint(0, 30))) for _ in range(300)]
    t = k.texts(pa.array([*texts, None]))
    w = k.words(t)
    got = [t.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for text in texts for x in WORD.findall(text)]
    same = collections.defaultdict(set)
    for word, h in zip(got, w.hash.tolist(), strict=True):
        same[lowered(word)].add(h)
    assert all(len(v) == 1 for v in same.values()) and len({h for v in same.values() for h in v}) == len(same)


def test_long_words_and_sliced_columns():
    column = pa.array(["x", "a" * (3 << 20) + " b", "b"])[1:]
    w = k.words(k.texts(column))
    assert list(np.diff(w.off)) == [2, 1] and w.hash[1] == w.hash[2]


# 1
def test_lm_base_scores_are_exact(documents, corpus):
    tiny = ngram_model.Settings(heavy=16)  # most tokens go through the join
    counted = ngram_model.count(documents.where(fold(7) != 2), tiny)
    got = by_id(ngram_model.score(documents, counted, fold(7) == 2, tiny))
    words = {i: [*WORD.findall(lowered(t)), None] for i, t in corpus}
    counts = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(corpus)
    for i, ws in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["score"] < 0


def test_lm_filter_returns_quantised_counts():
    s = ngram_model.Settings()
    keys = k.mix(np.arange(5000, dtype=np.uint64))
    counts = np.arange(5000) % 300 + 1
    bits, least = ngram_model.segment(keys, counts, 1 << 24, s)
    m = ngram_model.Model(bits, np.zeros(1, np.uint64), np.array([len(bits) * 8], np.uint64), np.array([least]), keys[:0], counts[:0], 1, 1, s)
    assert (ngram_model.lookup(m, keys) >= ngram_model.quantised(counts, s.base)).all()  # no false negatives
    assert (ngram_model.lookup(m, keys) == ngram_model.quantised(counts, s.base)).mean() > 0.95
    assert (ngram_model.lookup(m, k.mix(np.arange(10_000, 30_000, dtype=np.uint64))) > 0).mean() < 0.03
    small, least = ngram_model.segment(keys, counts, 4096, s)
    assert len(small) <= 512 and least > 1


def test_lm_filter_beyond_a_broadcast_stays_whole(documents):
    small = ngram_model.Settings(max_filter_bytes=64, bucket_bytes=20_000)  # segments are joined, not pruned
    results = []
    for s in (ngram_model.Settings(), small):
        counted = ngram_model.count(documents.where(fold(7) != 2), s)
        results.append(by_id(ngram_model.score(documents, counted, fold(7) == 2, s)))
        assert ngram_model.is_sent(counted, s) == (s is not small)
        assert {r["least"] for r in counted.select("least").collect()} == {1}
    assert results[0].keys() == results[1].keys()
    for i, r in results[0].items():
        for c in ("n_tokens", "n_known", "base_score", "score"):
            assert results[1][i][c] == pytest.approx(r[c])


def test_lm_key_lists_are_a_round_trip():
    r = np.random.default_rng(33)
    for n, top in ((0, 1), (1, 1 << 48), (5, 1 << 48), (5000, 1 << 48), (5000, 1 << 40), (3, 1 << 20)):
        keys = np.unique(r.integers(0, top, n).astype(np.uint64)) << np.uint64(16)
        assert np.array_equal(ngram_model.pairs_of(ngram_model.pair_list(keys), len(keys)), keys)
        keys = k.mix(keys)
        keys.sort()
        assert np.array_equal(ngram_model.tokens_of(ngram_model.token_list(keys), len(keys)), keys)


def lm_by_force(corpus, s):
    """Exact counts, quantised, and the formula."""
    words = {i: [None, *WORD.findall(lowered(t)), None] for i, t in corpus}
    learned = [ws for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    single = collections.Counter(w for ws in learned for w in ws[1:])
    pair = collections.Counter(p for ws in learned for p in zip(ws, ws[1:]))
    n, v = sum(single.values()), len(single)
    kept = {c: float(ngram_model.middle(ngram_model.quantised(np.array([c]), s.base), s.base)[0]) for c in {*single.values(), *pair.values()}} | {0: 0.0}
    out = {}
    for i, ws in words.items():
        total = 0.0
        for a, b in zip(ws, ws[1:]):
            ca, cb = kept[single[a]], kept[single[b]]
            total += math.log10((min(kept[pair[a, b]], ca, cb) + s.kappa * (cb + 1) / (n + v + 1)) / (ca + s.kappa))
        out[i] = total
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_lm_scores_are_those_of_the_formula_on_any_partitioning(documents, corpus, whole):
    """With so many bits that no probe is wrong; then with the usual number, which may be wrong, but always alike."""
    sure = ngram_model.Settings(bits_per_entry=120, probes=20, max_filter_bytes=64 << 20 if whole else 0, bucket_bytes=30_000)
    counted = ngram_model.count(documents.where(fold(7) != 2), sure)
    got = by_id(ngram_model.score(documents, counted, fold(7) == 2, sure))
    want = lm_by_force(corpus, sure)
    assert {i: r["score"] for i, r in got.items()} == {i: pytest.approx(x) for i, x in want.items()}
    usual = ngram_model.Settings(max_filter_bytes=64 << 20 if whole else 0, bucket_bytes=30_000)
    results = []
    for n in (1, 3, 40):
        docs = documents.repartition(n)
        results.append({i: tuple(r) for i, r in by_id(ngram_model.score(docs, ngram_model.count(docs.where(fold(7) != 2), usual), fold(7) == 2, usual)).items()})
    for other in results[1:]:
        assert other.keys() == results[0].keys() and all(x == pytest.approx(results[0][i], nan_ok=True) for i, x in other.items())
    assert np.mean([abs(results[0][i][-1] - x) < 1e-6 for i, x in want.items()]) > 0.5


def test_lm_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b a"), (None, "a b a"), (5, "a b"), (5, "a b"), (5, "c"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    s = ngram_model.Settings(max_filter_bytes=0)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["held_out"]) for r in ngram_model.score(docs, ngram_model.count(docs.where(F.col("doc_id").isNotNull()), s), F.col("doc_id") == 6, s).collect())
    assert got == [("5", 2, 2, False), ("5", 3, 3, False), ("5", 3, 3, False), ("6", 1, 1, True), ("None", 4, 4, None), ("None", 4, 4, None)]


def test_lm_nothing_to_learn_from(documents, empty):
    assert ngram_model.score(documents, ngram_model.count(empty), fold(7) == 2).count() == documents.count()
    assert ngram_model.score(empty, ngram_model.count(documents), fold(7) == 2).count() == 0


# 2
def test_license_lines(spark):
    rows = [(1, "x\nLICENSED under the apache license version 2.0!\ny"), (1, "all rights reserved"), (2, "Released under the MIT License"), (3, None), (4, ""), (5, "the the the"), (None, "All rights reserved.")]
    got = {(r["doc_id"], r["license"]): r["n_lines"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, "Apache-2.0"): 1, (1, "proprietary"): 1, (2, "MIT"): 1, (None, "proprietary"): 1}


def test_license_statements_in_longer_lines_wrapped_and_full_texts(spark):
    full = licenses.full_texts()
    rows = [
        (1, "x y\nLicensed under the Apache License,\nVersion 2.0. More."),
        (2, "This project is licensed under the MIT License. Read on"),
        (3, "Copyright 2020 Acme Inc. All rights reserved. Twice: all rights\nreserved"),
        (4, "Copyright (c) 2021 Acme\n\n" + full["MIT"] + "\nmore words"),
        (5, " ".join(full["MIT-grant"].split())),
        (6, full["GPL-3.0"]),
        (7, full["Apache-2.0"].replace("Licensor", "Giver")),
        (8, "no such thing in the software or the license of conditions"),
        (9, "All rights reserved.\nAll rights reserved. And more."),
        (None, full["BSD-2-Clause"] + "\n" + full["BSD-2-Clause"]),
    ]
    got = {(r["doc_id"], r["license"]): r["n_lines"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # the text of 7 has a line that is the short statement, and the text before it
    want = {(1, "Apache-2.0"): 1, (2, "MIT"): 1, (3, "proprietary"): 2, (4, "MIT"): 1, (5, "MIT-grant"): 1, (6, "GPL-3.0"): 1, (7, "Apache-2.0"): 2, (9, "proprietary"): 2, (None, "BSD-2-Clause"): 2}
    assert {x: got.get(x) for x in want} == want and not {x for x in got if x[0] == 8}


def test_license_rows_that_repeat_or_share_an_id_each_count(spark):
    """The SQL gives the same for these, as they are lines."""
    import duckdb

    r, m = "All rights reserved.", "Released under the MIT License"
    rows = [(1, r), (1, r), (1, m), (None, r), (None, m), (None, m), (2, None), (3, "x " * 50_000 + "\n" + r), (4, "y" * 200_000)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, license string, n_lines int")
    got = sorted((str(x["doc_id"]), x["license"], x["n_lines"]) for x in licenses.scan(df).collect())
    assert got == [("1", "MIT", 1), ("1", "proprietary", 2), ("3", "proprietary", 1), ("None", "MIT", 2), ("None", "proprietary", 1)]
    with duckdb.connect() as db:
        db.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
        assert sorted((str(i), name, n) for i, name, n, _ in db.sql(licenses.oracle_sql()).fetchall()) == got
    wrapped = "so all rights\nreserved. And"
    twice = spark.createDataFrame([(1, wrapped), (1, wrapped), (1, wrapped + " on")], "doc_id bigint, text string")
    assert [(x["license"], x["n_lines"]) for x in licenses.scan(twice).collect()] == [("proprietary", 3)]
    assert licenses.scan(df, {"none": ""}).count() == 0


def test_license_anchors_lose_nothing():
    for text in [*licenses.TEMPLATES.values(), *licenses.full_texts().values()]:
        grams = licenses.bigrams_of(text)
        words = set(licenses.anchors([grams], 0.8))
        assert sum(not words & set(g.split()) for g in grams) < len(grams) * 0.8 / 1.2


def test_license_size_bounds_lose_nothing():
    for n in range(1, 40):
        for m in range(1, 80):
            if 2 * min(n, m) / (n + m) >= 0.8:
                assert m in licenses.size_bounds(n, 0.8)


# 3
def test_toxicity_learns_words(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        toxic = i % 4 == 0
        words = [f"w{r.randint(0, 300)}" for _ in range(40)]
        if toxic:
            words[r.randrange(40)] = r.choice(["Vile!", "rotten"])
        rows.append((i, " ".join(words), int(toxic)))
    rows += [(600, None, 0), (601, "", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = by_id(toxicity.score(df, toxicity.train(df, df.select("doc_id", "toxic"), fold(4) != 2)))
    kept = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in kept]) > 0.97
    assert len(got) == 602 and all(0 <= r["score"] <= 1 for r in got.values())
    clean = toxicity.clean(df, toxicity.train(df, df.select("doc_id", "toxic"), F.lit(True)))
    assert clean.columns == df.columns and clean.count() < 500
    one_class = toxicity.train(df, df.where("toxic = 0").select("doc_id", "toxic"), F.lit(True))
    assert {r["predicted"] for r in toxicity.score(df, one_class).collect()} == {0}


def test_toxicity_labels_without_documents_and_of_one_class(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, None)], "doc_id bigint, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, toxic int")
    for rows, want in (([(8, 1), (9, 0)], 0), ([(1, 0), (9, 1)], 0), ([(1, 1), (9, 0)], 1)):
        model = toxicity.train(df, labels(rows), F.lit(True))
        got = toxicity.score(df, model).collect()
        assert [r["predicted"] for r in got] == [want] * 3 and all(abs(r["score"] - want) < 1e-6 for r in got)
        assert toxicity.clean(df, model).count() == 3 * (1 - want)


def test_ftrl_equals_a_plain_implementation():
    """Per coordinate, in dictionaries."""
    r = random.Random(31)
    s = toxicity.Settings(bits=8, epochs=2)
    rows = [np.unique(np.array([r.randrange(256) for _ in range(20)], np.uint32)) for _ in range(80)]
    y = np.array([float(5 in x or 9 in x) for x in rows])
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    l1 = s.l1 * math.sqrt(len(rows))

    def weight(i):
        penalty = 0 if i == "bias" else l1
        if abs(z[i]) <= penalty:
            return 0.0
        return (math.copysign(penalty, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for x, label in zip(rows, y, strict=True):
            at = [*x.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    model = toxicity.ftrl(rows, y, float(y.mean()), s)
    assert dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True)) == {i: pytest.approx(weight(i), rel=1e-4) for i in range(256) if weight(i)}
    assert model.bias == pytest.approx(weight("bias"))


# 4
def test_decontamination_finds_edited_items(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(4000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(30)) for i in range(40)] + [(40, "tiny one"), (41, None), (42, "")]
    docs, truth = [], set()
    for d in range(200):
        body = text(80).split()
        if d % 2:
            item = items[d % 40][1].split()
            for _ in range(d % 5):
                item[r.randrange(30)] = r.choice(vocabulary)
            body[40:40] = [w.upper() if d % 3 == 0 else w for w in item]
        docs.append((d, " \n".join(body)))
    docs += [(200, None), (201, ""), (202, "a tiny  ONE here")]
    s = decontamination.Settings(block_bytes=3000)
    normal = {i: decontamination.normal(t) for i, t in items}
    for d, t in docs:
        for i, item in normal.items():
            if item and len(item) > 20 and decontamination.infix_distance(item, decontamination.normal(t))[0] <= int(s.max_edits * len(item)):
                truth.add((d, i))
    truth.add((202, 40))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.find(df, bench, s).collect()}
    assert got <= truth and len(got) >= 0.98 * len(truth) and len(truth) > 90
    kept = {x["doc_id"] for x in decontamination.clean(df, bench, s).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontamination.find(df, bench.limit(0)).count() == 0 and decontamination.find(df.limit(0), bench).count() == 0


def test_decontamination_by_turns_in_passes_and_exactly(spark):
    """Blocks by turns, passes one after the other, and exact search of what walks don't reach: all pairs within the edits, and no others."""
    r = random.Random(31)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(9 + 3 * (i % 8))) for i in range(48)]
    docs = [(d, f"{text(20)} {decontamination.edited(items[d % 48][1].encode(), d % 4 / 20, r).decode()} {text(20)}") for d in range(144)] + [(d, text(50)) for d in range(144, 170)]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    truth = {(d, i) for d, t in docs for i, item in items if decontamination.infix_distance(decontamination.normal(item), decontamination.normal(t))[0] <= int(0.2 * len(item))}
    for s in (decontamination.Settings(), decontamination.Settings(block_bytes=1500, run_bytes=2000), decontamination.Settings(block_bytes=800, pass_bytes=2500, run_bytes=1)):
        found = decontamination.find(df, bench, s)
        got = collections.Counter((x["doc_id"], x["item_id"]) for x in found.collect())
        assert set(got) <= truth and len(got) >= 0.98 * len(truth) and max(got.values()) == 1 and len(truth) >= 144
        assert sorted(x["doc_id"] for x in decontamination.clean(df, bench, s).collect()) == sorted({d for d, _ in docs} - {d for d, _ in got})
    exact = decontamination.Settings(most_walks=1, block_bytes=1500)  # no recall is met by one walk
    assert set(decontamination.planned(bench, exact)[1].values()) == {decontamination.WHOLE_WORDS, decontamination.EXACT}
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.find(df, bench, exact).collect()} == truth


def test_decontamination_reads_documents_once_for_each_pass(spark):
    bench = spark.createDataFrame([(i, f"w{i} x{i} y{i} z{i} " * 5) for i in range(40)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "w1 x1")], "doc_id bigint, text string")
    for most, wanted in ((1 << 20, 1), (1600, 2)):
        blocks = list(decontamination.passes(bench, decontamination.Settings(block_bytes=400, pass_bytes=most)))
        assert len(blocks) >= wanted and sum(map(len, blocks)) > 4
        plan = decontamination.clean(docs, bench, decontamination.Settings(block_bytes=400, pass_bytes=most))._jdf.queryExecution().analyzed().toString()
        assert plan.count("MapInArrow") == len(blocks)


def test_decontamination_recall_at_character_edits():
    """Random edits of 15 and 20 % of the characters, in short and long items; those too short for walks are found always."""
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(4000)]
    for n, least in ((4, 1.0), (18, 0.95), (45, 0.98)):
        items = [" ".join(r.choice(words) for _ in range(n)).encode() for _ in range(100)]
        found = decontamination.Finder(list(enumerate(items)), decontamination.Settings())
        for share in (0.15, 0.2):
            texts = []
            for item in items:
                b = bytearray(item)
                for _ in range(int(share * len(item))):
                    b[r.randrange(len(b))] = r.choice(b"abcdefghiklmnoprstu")
                texts.append(b"before it " + bytes(b) + b" after it")
            got = {(d, i) for d, i, *_ in found.find(texts)}
            assert sum((d, d) in got for d in range(100)) >= 100 * least, (n, share)


def test_decontamination_recall_from_4_to_60_words_and_without_spaces():
    """Against all pairs by exact edit distance."""
    r = random.Random(22)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    kana = [chr(c) for c in [*range(0x3042, 0x3090), *range(0x4E00, 0x4F00)]]
    make = {n: (lambda n=n: " ".join(r.choice(words) for _ in range(n))) for n in (4, 6, 9, 12, 25, 60)} | {0: lambda: "".join(r.choice(kana) for _ in range(60)), -1: lambda: "".join(r.choice("abcdefgh0123456789") for _ in range(150))}
    for kind, text in make.items():
        items = [text() for _ in range(60)]
        finder = decontamination.Finder([(i, decontamination.normal(t)) for i, t in enumerate(items)], decontamination.Settings())
        for share in (0, 0.05, 0.1, 0.2):
            space = " " if kind > 0 else ""
            texts = [decontamination.normal(text() + space + decontamination.edited(t.encode(), share, r).decode() + space + text()) for t in items]
            n, ends = len(texts), np.cumsum([len(x) for x in texts])  # all pairs; these distances are tested against single ones below
            edits, _ = decontamination.infix_distances(finder.items, np.tile(np.arange(n), n), np.frombuffer(b"".join(texts), np.uint8), np.repeat(ends - [len(x) for x in texts], n), np.repeat(ends, n))
            truth = {(d, i) for d, i in zip(*(x.tolist() for x in np.nonzero(edits.reshape(n, n) <= finder.room[None])), strict=True)}
            got = {(d, i) for d, i, *_ in finder.find(texts)}
            assert got <= truth and len(got) >= (0.95 if share else 1) * len(truth) and len(truth) >= 60 * (share < 0.2), (kind, share, len(got), len(truth))


def test_decontamination_of_repeated_tied_long_and_odd_rows(spark):
    item = " ".join(f"w{i}x{i * 7 % 11}" for i in range(30))
    docs = [(1, f"a {item} b"), (1, f"a {item} b"), (None, item), (2, f"{item} and again {item}"), (3, "filler text here " * 60_000 + item), (4, None), (5, "z" * 400_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, item.upper()), (None, "")], "item_id bigint, text string")
    got = collections.Counter(tuple(x) for x in decontamination.find(df, bench).collect())
    n = len(item)
    want = collections.Counter()
    for i in (7, 7, 8):
        want.update([(1, i, 0, n, 1, 30), (1, i, 0, n, 1, 30), (None, i, 0, n, 0, 29), (2, i, 0, n, 0, 29), (3, i, 0, n, 180_000, 180_029)])
    assert got == want
    assert sorted(r["doc_id"] for r in decontamination.clean(df, bench).collect()) == [4, 5]


def test_infix_distances_are_those_of_single_stretches():
    r = random.Random(23)
    patterns = [bytes(r.choice(b"abc") for _ in range(n)) for n in (1, 5, 63, 64, 65, 128, 200, 300)]
    text = bytes(r.choice(b"abc") for _ in range(5000))
    which, low = (np.array([r.randrange(m) for _ in range(600)]) for m in (len(patterns), 4000))
    high = low + np.array([r.randint(1, 500) for _ in range(600)])
    edits, end = decontamination.infix_distances(patterns, which, np.frombuffer(text, np.uint8), low, high)
    assert [(e, z) for e, z in zip(edits.tolist(), end.tolist(), strict=True)] == [decontamination.infix_distance(patterns[w], text[a:b]) for w, a, b in zip(which, low, high, strict=True)]


def test_infix_distance_is_that_of_the_table():
    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            now = [i]
            for j, x in enumerate(t, 1):
                now.append(min(row[j - 1] + (c != x), row[j] + 1, now[-1] + 1))
            row = now
        return min(row)

    r = random.Random(4)
    for _ in range(300):
        p, t = (bytes(r.choice(b"abc") for _ in range(r.randint(1, n))) for n in (90, 120))
        assert decontamination.infix_distance(p, t)[0] == slow(p, t)


# 5
def test_language(spark):
    r = random.Random(5)
    words = {"en": ["the", "and", "house", "with", "that"], "de": ["und", "der", "haus", "mit", "dass"], "fr": ["le", "et", "maison", "avec", "que"]}
    rows = [(i, " ".join(r.choice(words[lang]) + r.choice(["", "a", "en"]) for _ in range(30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 100)]
    rows += [(300, None, "en"), (301, "", "en"), (302, "123 !?", "en"), (303, "日本", None), (304, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = by_id(language.predict(df, language.train(df, fold(3) != 1)))
    kept = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in kept]) > 0.97
    assert [got[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3 and got[303]["lang_pred"] in words and got[304]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language.predict(df, language.train(df.where("lang = 'xx'"), F.lit(True)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_language_learns_every_language_and_null_ids_are_predicted(spark):
    r = random.Random(32)
    rows = [(i, " ".join(f"l{i % 300}x{r.randrange(5)}" for _ in range(20)), f"lang{i % 300}") for i in range(900)] + [(None, "l7x1 l7x2", "lang7"), (5, "l5x1", "lang5")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(df, F.lit(True))
    assert len(model.languages) == 300
    got = language.predict(df, model).collect()
    assert len(got) == len(rows) and {x["lang_pred"] for x in got if x["doc_id"] is None} <= set(model.languages)


# 6
def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.sub("[^0-9]", "", m[0])][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in out)


def test_pii_base_spans_are_those_of_the_patterns():
    r = random.Random(6)
    for _ in range(20_000):
        text = "".join(r.choice("a1 2.@+-(5)9x_é:/") for _ in range(r.randint(1, 40)))
        assert pii.joined([s for s in pii.find_spans(text) if s[0] < 4]) == base_spans(text)
    for _ in range(3000):
        text = "".join(r.choice("0123456789 -") for _ in range(40))
        assert pii.joined([s for s in pii.find_spans(text) if s[0] < 4]) == base_spans(text)


def added_spans(text):
    """Place by place: a cue in any case that doesn't begin inside a word, then what stands behind it."""
    out, ends = [], {"account": 0, "secret": 0}
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    cues = [(c, "account") for c in pii.ACCOUNT_CUES] + [(c, "secret") for c in pii.SECRET_CUES]
    for end in range(1, len(text) + 1):
        for cue, kind in sorted(cues, key=lambda x: -len(x[0])):
            begin = end - len(cue)
            if begin < 0 or low[begin:end] != cue or begin > 0 and text[begin - 1].isalnum():
                continue
            if kind == "secret":
                m = re.compile(r"\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/.-]{20,}=*)").match(text, end)
                if m and m.start(1) >= ends[kind] and any(c in "0123456789" for c in m[1]) and re.search("[a-zA-Z]", m[1]):
                    out.append((kind, *m.span(1)))
                    ends[kind] = m.end(1)
                continue
            m = re.compile(r"[\s:#.=]{1,4}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])").match(text, end)
            if not m or m.start(1) < ends[kind]:
                continue
            words = m[1].split(" ")
            if cue == "iban":
                value = next((" ".join(words[:n]) for n in range(len(words), 0, -1) if pii.iban(" ".join(words[:n]))), "")
            else:
                value = words[0] if sum(c.isdigit() for c in words[0]) >= 6 else ""
            if value:
                out.append((kind, m.start(1), m.start(1) + len(value)))
                ends[kind] = m.start(1) + len(value)
    return sorted(out)


def test_pii_added_spans_are_those_of_a_plain_search():
    r = random.Random(35)
    parts = ["token", "Api_Key", "SECRET", "account No", "IBAN", "iban", "Ssn", "passport number", "=", ":", " ", "  ", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "123456789", "ab12cd34ef56gh78ij90kl", "x" * 25, "A1", "'", "#", ". "]
    seen = 0
    for _ in range(6000):
        text = "".join(r.choice(parts[:8]) + r.choice(parts[8:12]) + r.choice(parts[12:]) + r.choice(parts[10:12]) if r.random() < 0.5 else r.choice(parts) for _ in range(r.randint(1, 6)))
        got = [(pii.KINDS[k], a, b) for k, a, b in pii.find_spans(text) if pii.KINDS[k] in ("account", "secret")]
        assert sorted(got) == added_spans(text), text
        seen += len(got)
    assert seen > 1000


def test_pii_case_folding_keeps_places():
    odd = [chr(c) for c in range(128, 0x110000) if len(chr(c).lower()) != 1 or chr(c).lower().isascii()]
    assert all(pii._ODD.fullmatch(c) for c in odd)
    for text in ("ToKEN É İ", "to\u212aen K", "plain"):
        assert len(pii.folded(text)) == len(text)
    assert not pii.find_spans("to\u212aen = ab12cd34ef56gh78ij90kl")


def test_pii_columns(spark):
    rows = [(1, "mail a@b.co or é x@y.z, 10.0.0.1, 4111 1111 1111 1111, +1 (202) 555-0143"), (2, None), (3, ""), (4, "IBAN: GB82 WEST 1234 5698 7654 32 token = \"0123456789abcdef0123456789\" http://me:pw@host.org/x"), (None, "a@b.co")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_id(pii.find(df))
    assert [got[1][f"n_{x}"] for x in ("email", "ip", "card", "phone")] == [2, 1, 1, 1]
    assert got[1]["base_sha256"] == hashlib.sha256(base_spans(rows[0][1]).encode()).hexdigest()
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[3]["spans"] == ""
    assert {s.split(":")[0] for s in got[4]["spans"].split(",")} == {"account", "secret", "url", "email"} or {s.split(":")[0] for s in got[4]["spans"].split(",")} == {"account", "secret", "url"}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[1] == "mail [EMAIL] or é [EMAIL], [IP], [CARD], [PHONE]" and clean[2] is None and clean[None] == "[EMAIL]"


# 7
def test_packing_is_a_round_trip(documents, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(documents, path).collect()
    library = packing.WordEncoder(path).library
    pieces, used = collections.defaultdict(dict), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in corpus:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert sorted(pieces[i]) == list(range(-(-len(ids) // 4096)))
        for n, r in pieces[i].items():
            part = ids[n * 4096 : (n + 1) * 4096]
            assert (r["start"], r["length"], r["ids_crc32"]) == (n * 4096, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_takes_few_sequences_on_any_partitioning(spark):
    """Within 1 % of the least possible, also where each partition has pieces of one size."""
    r = random.Random(30)
    words = ["the", "of", "a", "and"]
    sizes = [2600 if i % 3 == 0 else r.randint(1, 1500) for i in range(600)]
    rows = [(i, " ".join(words[(i + j) % 4] for j in range(n))) for i, n in enumerate(sorted(sizes))]
    path = public_tokenizers.path("word_bpe_49k.json")
    for n in (1, 16, 211):
        out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).repartitionByRange(n, "doc_id"), path).collect()
        total = sum(x["length"] for x in out)
        assert len({x["sequence_id"] for x in out}) <= 1.01 * math.ceil(total / 4096) + 1, n
        assert len(out) == 600
        used = collections.defaultdict(list)
        for x in out:
            used[x["sequence_id"]].append((x["offset"], x["length"]))
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 4096


def test_packing_spreads_repeated_rows(spark):
    rows = [(1, "the of a and " * 50)] * 3000 + [(None, None)] * 1000
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), public_tokenizers.path("word_bpe_49k.json"), packing.Settings(group=200)).cache()
    groups = collections.Counter(x["sequence_id"] >> 32 for x in out.collect())
    assert len(groups) == 20 and sum(groups.values()) == 4000 and max(groups.values()) < 300
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces")).where("n > 4096 or places <> pieces").count() == 0


def test_word_encoder_keeps_no_long_words():
    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "ab " + "x" * 5000 + " ab " + "y" * 65
    assert e.ids(text) == np.array(e.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert set(e.cache) == {"ab"}


def test_packing_heeds_every_capacity():
    r = np.random.default_rng(7)
    lengths = r.integers(1, 1000, 3000)
    for rule in ("norm", "dot"):
        for s in (packing.Settings(rule=rule), packing.Settings(rule=rule, documents=5), packing.Settings(rule=rule, attention=1_500_000)):
            sequence, offset, n = packing.pack_lengths(lengths, s)
            for x in range(n):
                own = lengths[sequence == x]
                assert own.sum() <= s.tokens and len(own) <= s.documents and (own**2).sum() <= s.attention
        assert packing.pack_lengths(lengths, packing.Settings(rule=rule))[2] <= math.ceil(lengths.sum() / 4096) + 1


def test_word_encoder_equals_the_library():
    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), words=50)
    texts = ["It's DON'T we'll 'S''s ''' a\xa0b  <|endoftext|> x", "Ünï ÇÀ 12345 ½ ²³ ﬁ Σας İ", "", "  ", "a'b'c''d'll're 'tis", "日本語 é é \x1c z", "«»–—…"]
    r = random.Random(8)
    texts += ["".join(r.choice("abcABC' \n1É.,!<|>") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert e.ids(t) == np.array(e.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


# 8
def test_jaccard_components(documents, corpus, empty):
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(jaccard_join.join_components(documents)).items()}
    assert got == components_by_force(corpus)
    assert jaccard_join.join_components(empty).count() == 0


def test_jaccard_borderline_groups(spark):
    """Chains and groups whose members link to some, but not all; one large group of near copies."""
    r = random.Random(9)
    rows, n = [], 0
    for size in (5, 6, 8, 9, 12, 16, 25, 40, 80, 200):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(size + 4)]
        for step in range(14):
            rows.append((n, " ".join(words)))
            n += 1
            for _ in range(1 if size < 60 else 3):
                words[r.randrange(len(words))] = f"w{r.randint(0, 10**6)}"
            if step % 3 == 0:
                words.append(f"w{r.randint(0, 10**6)}")
    base = [f"v{i}" for i in range(150)]
    for _ in range(60):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(150)] = f"w{r.randint(0, 10**6)}"
        rows.append((n, " ".join(words)))
        n += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = components_by_force(rows)
    for part_bytes in (16 << 20, 20_000, 500):  # whole components in one bucket or several; components dealt by signature
        got = {i: (x["n_shingles"], x["component_id"]) for i, x in by_id(jaccard_join.join_components(df, part_entries=5000, part_bytes=part_bytes)).items()}
        assert got == want


def test_lists_of_keys_are_made_by_sorting():
    """They equal what NumPy gives, and don't take the hash table of np.unique, which made op1 fail its budget."""
    import inspect

    r = np.random.default_rng(12)
    for n in (0, 1, 5, 20_000):
        keys = r.integers(0, max(1, n // 3) + 1, n).astype(np.uint64)
        known, counts = np.unique(keys, return_counts=True)
        assert np.array_equal(ngram_model.distinct_of(keys), known)
        for got in (ngram_model.occurrences(keys), ngram_model.summed(keys, np.ones(n, np.int64))):
            assert np.array_equal(got[0], known) and np.array_equal(got[1], counts)
        assert np.array_equal(ngram_model.ranks(known, keys), np.searchsorted(known, keys))
    assert "unique" not in inspect.getsource(ngram_model.asked)


def test_signatures_lose_no_link():
    r = np.random.default_rng(10)
    found = jaccard_join.schemes(400)
    plan = jaccard_join.Plan(found, [0] * (len(found) + 1), 5)
    for _ in range(400):
        n = int(r.integers(4, 300))
        a = k.mix(r.integers(0, 1 << 62, n).astype(np.uint64))
        d = int(r.integers(0, max(1, 2 * n // 9) + 1))
        cut = int(r.integers(0, d + 1))
        b = np.concatenate((a[cut:], k.mix(r.integers(0, 1 << 62, d - cut).astype(np.uint64))))
        a, b = np.sort(a), np.sort(b)
        differ = len(np.setxor1d(a, b))
        if not len(b) or differ == 0 or differ > (len(a) + len(b)) // 9:
            continue
        hit = False
        for s in set(plan.of(len(a))) & set(plan.of(len(b))):
            (x, px), (y, py) = jaccard_join.signatures(a, s), jaccard_join.signatures(b, s)
            assert np.unpackbits(np.frombuffer(jaccard_join.sketch(a, s.sketch), np.uint8) ^ np.frombuffer(jaccard_join.sketch(b, s.sketch), np.uint8)).sum() <= differ
            hit |= bool(set(x[px]) & set(y)) or bool(set(y[py]) & set(x))
        assert hit


def near_copies(n, edits, seed):
    """Shingle sets of copies of one text of 200 words, each with words replaced."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 40, 204)
    sets = []
    for _ in range(n):
        words = base.copy()
        words[r.choice(204, edits, False)] = r.integers(0, 1 << 40, edits)
        sets.append(np.sort(k.windows(k.mix(words.astype(np.uint64)), np.array([0, 204]), 5)[0]))
    return sets


def part_forest(sets, whole):
    s = next(x for x in jaccard_join.schemes(400) if x.top >= len(sets[0]))
    keys, probes = zip(*(jaccard_join.signatures(x, s) for x in sets), strict=True)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in keys])
    sizes = np.array([len(x) for x in sets])
    contents = jaccard_join.WholeSets(sizes, np.concatenate(sets)) if whole else jaccard_join.Sets(sizes, np.stack([np.frombuffer(jaccard_join.sketch(x, s.sketch), np.uint8) for x in sets]))
    return jaccard_join.spanning_links(np.concatenate(keys), np.concatenate(probes), of, contents, np.arange(len(sets)))


def test_part_forests_span_all_links():
    sets = [x for edits in (2, 3, 4) for x in near_copies(60, edits, edits)] + near_copies(60, 3, 2)
    label = {i: i for i in range(len(sets))}
    for a in range(len(sets)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((label[a], label[b]))
                label = {i: x if c == y else c for i, c in label.items()}
    from lumidisc.llm.components import roots

    links = part_forest(sets, True)
    got = dict(enumerate(range(len(sets)))) | dict(zip(*(x.tolist() for x in roots(links[:, 0], links[:, 1])), strict=True))
    assert got == label and 1 < len(set(label.values())) < len(sets)
    maybe = part_forest(sets, False)
    joined = dict(zip(*(x.tolist() for x in roots(maybe[:, 0], maybe[:, 1])), strict=True))
    assert all(joined[a] == joined[b] for a, b in links.tolist()) and len(maybe) < len(sets)


@pytest.mark.parametrize("whole", [False, True])
def test_passes_over_a_part_connect_what_one_pass_does(whole):
    from lumidisc.llm.components import roots

    sets = [x for edits in (2, 3, 4) for x in near_copies(60, edits, edits)]
    s = next(x for x in jaccard_join.schemes(400) if x.top >= len(sets[0]))
    keys, probes = zip(*(jaccard_join.signatures(x, s) for x in sets), strict=True)
    packed = np.concatenate(keys) & jaccard_join._KEY_MASK | np.concatenate(probes).astype(np.uint64) << jaccard_join._KEY_BITS
    packed = packed.view(np.uint8).reshape(-1, 8)[:, :5]
    of = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in keys])
    sizes = np.array([len(x) for x in sets])
    contents = jaccard_join.WholeSets(sizes, np.concatenate(sets)) if whole else jaccard_join.Sets(sizes, np.stack([np.frombuffer(jaccard_join.sketch(x, s.sketch), np.uint8) for x in sets]))
    labels = np.arange(len(sets))
    labels[5] = 3  # connected already
    found = [jaccard_join.links_by_passes(packed, of, contents, labels, most) for most in (len(packed), 1000, 1)]
    one, some, many = (tuple(x.tolist() for x in roots(np.append(f[:, 0], 3), np.append(f[:, 1], 5))) for f in found)
    assert len(found[0]) and one == some == many
    assert all(len(f) < len(sets) for f in found)  # a forest


def test_a_set_meets_hardly_more_parts_in_a_table_of_twelve_times_the_rows(spark):
    met = []
    for n in (250_000, 3_000_000):
        profile = spark.range(n).selectExpr("id AS doc_id", "60 + id % 400 AS n_shingles")
        plan = jaccard_join.make_plan(profile, 5, 1_000_000, parts_wanted=jaccard_join.PARTS)
        parts = np.diff(plan.first)
        met.append(np.mean([sum(parts[s.number] * (1 - (1 - 1 / parts[s.number]) ** jaccard_join.entries_of(s, x)) for s in plan.of(x)) for x in range(60, 460)]))
        assert jaccard_join.PARTS <= parts.sum()
    assert met[1] < 2 * met[0]  # parts of a million entries each: 7.5 times


def test_long_unrelated_sets_are_no_candidates(spark):
    """Long texts that share a passage: of fixed sketches all were candidates of each other, in one component whose whole sets filled the disk."""
    r = random.Random(13)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = [f"w{r.randint(0, 10**7)}" for _ in range(2200 + 60 * i)]
        words[500:560] = passage
        rows.append((i, " ".join(words)))
    words = rows[20][1].split()
    words[7] = "edit"
    rows.append((40, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    plan = jaccard_join.make_plan(jaccard_join.profiles(df, 5), 5, 10_000)
    nodes = {jaccard_join.node_of(x)[0] for x in jaccard_join.shingles(k.texts(pa.array([rows[20][1], rows[40][1]])), 5)}
    assert {frozenset(p) for p in jaccard_join.forests(df, plan, whole=False).collect()} == {frozenset(nodes)}
    assert all(s.sketch >= 3 * s.differences for s in jaccard_join.schemes(1_000_000))


def test_large_components_are_copied_a_few_times(spark):
    """A scheme with ten times the bytes of a part: by entries each set lay in over a thousand parts, whole."""
    r = random.Random(14)
    base = [f"v{i}" for i in range(4000)]
    rows = []
    for i in range(24):
        words = list(base) if i < 20 else [f"{w}x{i}" for w in base]
        words[r.randrange(4000)] = f"edit{i}"
        words[100 * i] = f"edit{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("label", F.col("doc_id"))
    profile = jaccard_join.profiles(df, 5).cache()
    nodes = {r["node"]: r["doc_id"] for r in profile.collect()}
    plan = jaccard_join.make_plan(profile, 5, 1_000_000, 8 * 4000 * 24 // 10)
    copies = jaccard_join.indexed(df, plan, True).agg(F.sum(F.octet_length("nodes")) / 8).first()[0]
    assert 24 < copies <= 24 * 2 * 20
    links = [(nodes[a], nodes[b]) for a, b in jaccard_join.forests(df, plan, whole=True).collect()]
    ids, least = roots(*(np.array(x) for x in zip(*links, strict=True)))
    assert ids.tolist() == list(range(20)) and not least.any()


@pytest.mark.parametrize("whole", [False, True])
def test_part_forests_of_near_copies_take_linear_memory(whole):
    import tracemalloc

    for edits, sizes in ((3, (1000, 5000)), (6, (150, 600))):  # most pairs link; none does, and all are tried
        peaks = []
        for n in sizes:
            sets = near_copies(n, edits, n)
            tracemalloc.start()
            assert len(part_forest(sets, whole)) == (n - 1 if edits == 3 else 0) or not whole
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert peaks[1] < 7 * peaks[0], peaks


def test_components(spark):
    r = random.Random(11)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    label = {}
    for a, b in edges:
        for x in (a, b):
            label.setdefault(x, x)
        if label[a] != label[b]:
            x, y = sorted((label[a], label[b]))
            label = {i: x if c == y else c for i, c in label.items()}
    for one_task in (10**6, 10):
        got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint"), one_task).collect()}
        alone = {i for i in label if i not in got}
        assert {i: got.get(i, i) for i in label} == label and all(a == b for a, b in edges if a in alone)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 9
def test_quality_counts(documents, corpus):
    got = by_id(quality.judge(documents, None))
    for i, text in corpus:
        w = WORD.findall(text or "")
        three = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n = collections.Counter(three)
        covered = {j + d for j, x in enumerate(three) if n[x] > 1 for d in range(3)}
        lines = (text or "").split("\n")
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(covered))
        assert r["n_dup_lines"] == sum(bool(WORD.search(x)) and x in lines[:j] for j, x in enumerate(lines))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r["kept"] == (not r["base_failed"])


def test_quality_model(spark):
    r = random.Random(12)
    good = lambda: " ".join(r.choice(["lake", "river", "stone", "under", "moving"]) + str(r.randint(0, 99)) for _ in range(80))
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), int(i % 3 > 0)) for i in range(300)] + [(300, "a\na\n\n\na b", 1), (301, None, 0), (302, "# x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.train(df, df.where("doc_id % 2 = 0").select("doc_id", "quality"))
    got = by_id(quality.judge(df, model))
    assert np.mean([got[i]["kept"] == bool(i % 3) for i in range(1, 300, 2)]) > 0.97
    assert got[300]["n_dup_lines"] == 1 and got[301]["n_words"] == 0 and not got[301]["kept"]
    assert quality.train(df, df.where("quality = 1").select("doc_id", "quality")) is None


# 10
def test_token_counts_equal_the_library(documents, corpus):
    path = public_tokenizers.path("piece_bpe_32k.model")
    e = tokens.encoder(path)
    assert e.stable
    got = by_id(tokens.count_tokens(documents, path, chunk=2000, overlap=20))
    for i, text in corpus:
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (len(e.ids([text or ""])[0]), len((text or "").encode()))
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 4096)


def test_texts_without_spaces_are_not_encoded_whole(monkeypatch):
    e = tokens.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(34)
    text = "".join(chr(r.randrange(0x4E00, 0x5E00)) for _ in range(30_000))
    want, longest, ids = len(e.ids([text])[0]), [], e.ids
    monkeypatch.setattr(e, "ids", lambda texts: longest.append(max(map(len, texts))) or ids(texts))
    assert e.count(text, 2000, 64) == want and max(longest) < 4200


def test_token_resynchronisation_widens():
    e = tokens.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("x" * 5000 + " " + "y z" * 2000, "日本 語" * 3000, "a" * 9000, "  " * 3000 + "b", " \n" * 3000, "<s> </s> <unk> <0x41> " * 400, "▁a ▁" * 900):
        for chunk, overlap in ((500, 1), (1000, 20), (4096, 64)):
            assert e.count(text, chunk, overlap) == len(e.ids([text])[0])


def test_samples_are_the_smallest_hashes(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 100 = 0 THEN 'rare' WHEN id % 7 = 0 THEN 'few' ELSE 'most' END AS kind").withColumn("h", F.xxhash64("doc_id"))
    rows = df.collect()
    for n in (1, 50, 1000):
        got = {(r["kind"], r["rank"], r["doc_id"]) for r in first_by_hash(df.drop("h"), "kind", n).collect()}
        want = set()
        for kind in ("rare", "few", "most"):
            own = sorted((r["h"], r["doc_id"]) for r in rows if r["kind"] == kind)[:n]
            want |= {(kind, i + 1, x) for i, (_, x) in enumerate(own)}
        assert got == want
    assert first_by_hash(df.limit(0), "kind", 5).count() == 0


def test_model_scores_are_those_of_a_plain_sum(documents, corpus, spark):
    """Text by text, in Python, from the features of each text alone."""
    alone = lambda text: k.texts(pa.array([text or ""]))
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    toxic, good, lang = toxicity.train(documents, labels, F.lit(True)), quality.train(documents, labels), language.train(documents, F.lit(True))
    got = [by_id(x) for x in (toxicity.score(documents, toxic), quality.judge(documents, good), language.predict(documents, lang))]
    weights = dict(zip(toxic.slots.tolist(), toxic.weights.tolist(), strict=True))
    for i, text in corpus:
        slots = {x for part, _ in toxicity.slots(alone(text), toxic.bits) for x in part.tolist()}
        assert got[0][i]["score"] == pytest.approx(1 / (1 + math.exp(-toxic.bias - sum(weights.get(x, 0) for x in slots))), abs=1e-6)
        t = alone(text)
        rows = [x for part, _ in quality.features(t, k.words(t, lower=False), good.settings.bits) for x in part.tolist()]
        z = good.slope * (good.settings.scale * sum(float(good.weights[x]) for x in rows) / max(1, len(rows)) + good.bias) + good.shift
        assert got[1][i]["p_good"] == pytest.approx(1 / (1 + math.exp(-min(35, max(-35, z)))), abs=1e-5)
        rows = [x for part, _ in language.features(t, lang.settings) for x in part.tolist()]
        logits = [(sum(float(lang.table[x, n]) for x in rows) / max(1, len(rows)) + float(lang.bias[n])) / lang.temperature for n in range(len(lang.languages))]
        top = max(logits)
        p = [math.exp(x - top) / sum(math.exp(y - top) for y in logits) for x in logits]
        if any(c.isalpha() for c in text or ""):
            assert got[2][i]["lang_pred"] == lang.languages[p.index(max(p))] and got[2][i]["score"] == pytest.approx(max(p), abs=1e-5)
        else:
            assert (got[2][i]["lang_pred"], got[2][i]["score"]) == ("und", 0.0)


def test_null_ids_repeated_rows_and_odd_texts_everywhere(spark):
    """A row in, a row out; equal rows give equal results; names that clash are left alone."""
    texts = [None, "", " \n\t", "one", "z" * 300_000, "日本語の文章です。" * 3000, "word " * 60_000, "\x00 \u2028 é", "a\n" * 20_000]
    rows = [(i if i % 3 else None, t, "en", 1, 1, 0.5, True) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words int, toxic int, score double, kept boolean")
    path = public_tokenizers.path
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 1), (5, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    s = ngram_model.Settings(max_filter_bytes=0)
    results = {
        "lm": ngram_model.score(df, ngram_model.count(df, s), F.lit(False), s),
        "toxicity": toxicity.score(df, toxicity.train(df, labels, F.lit(True))),
        "language": language.predict(df, language.train(df, F.lit(True))),
        "pii": pii.find(df),
        "quality": quality.judge(df, quality.train(df, labels)),
        "tokens": tokens.count_tokens(df, path("piece_bpe_32k.model")),
        "packing": packing.pack(df, path("word_bpe_49k.json")).where("piece = 0").drop("sequence_id", "offset"),
    }
    for name, out in results.items():
        got = collections.Counter(tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in out.collect())
        assert sum(got.values()) == len(rows) and all(n % 2 == 0 for n in got.values()), name
    assert toxicity.clean(df, toxicity.train(df, labels, F.lit(True))).columns == df.columns
    assert pii.redact(df).count() == len(rows)
    with_id = jaccard_join.join_components(df)
    assert sorted(r["doc_id"] for r in with_id.collect()) == [i for i in range(len(texts)) if i % 3]
    assert licenses.scan(df).count() == 0


def test_empty_tables(empty, spark):
    model = toxicity.train(empty, spark.createDataFrame([], "doc_id bigint, toxic int"), fold(4) != 2)
    assert toxicity.score(empty, model).count() == 0
    assert language.predict(empty, language.train(empty, fold(3) != 1)).count() == 0
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert quality.judge(empty, None).count() == 0
    assert tokens.count_tokens(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert licenses.scan(empty).count() == 0

"""Nearest neighbours, tokenizer alignment and source divergence against brute force, with odd rows."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests_llm_fixtures import prose

from lumidisc.llm import alignment, divergence, language, licenses, neighbours

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def nearest_by_force(rows, mod, k=5):
    width = max(len(v) for _, v in rows)
    by = {i: list(v) + [0.0] * (width - len(v)) for i, v in rows}
    ids = np.array(sorted(by))
    x, out = np.array([by[i] for i in ids], float), []
    for i in ids[ids % mod == 0]:
        score = (x * by[i]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((np.array([by[i]]) ** 2).sum(1)))
        out += [(int(i), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate([j for j in np.lexsort((ids, -score)) if ids[j] != i][:k])]
    return out


def searched(df, mod, **settings):
    return sorted(tuple(r) for r in neighbours.search(df, F.col("vec_id") % mod == 0, neighbours.Settings(**settings)).collect())


VECTORS = "vec_id bigint, embedding array<double>, label string, score double, rank int, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.5, 3, 1) for i, v in rows], VECTORS)


def test_neighbours_of_odd_vectors(spark):
    """A frequent vector, its multiples, repeated rows, short vectors and unusable ones, in several cells and blocks."""
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(i, [2.0, 4.0, 6.0]) for i in range(100, 105)] + [(7, [1.0, 2.0, 3.0])] * 50 + [(450, [5.0]), (460, [5.0, 0.0])]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(200, 400)]
    bad = [(500, None), (501, []), (502, [0.0, 0.0]), (503, [1.0, None]), (504, [float("nan"), 1.0]), (505, [float("inf"), 1.0]), (None, [1.0, 2.0])]
    want = nearest_by_force(rows, 10)
    # calibrated to find all
    assert searched(frame(spark, rows + bad), 10, cell_recall=1.0, leaf_recall=1.0) == want
    assert searched(frame(spark, rows + bad), 10, cell_rows=20, least_sample=4, block_rows=16, leaf_rows=4, cell_recall=1.0, leaf_recall=1.0, calibration=1000) == want


def test_neighbours_few_and_none(spark):
    assert searched(frame(spark, []), 50) == []
    assert searched(frame(spark, [(0, [1.0])]), 50) == []
    assert [x[:3] for x in searched(frame(spark, [(0, [1.0]), (50, [2.0, 1.0])]), 50)] == [(0, 1, 50), (50, 1, 0)]
    assert searched(frame(spark, [(50, [1e-200, 2e-200]), (51, [1e200, 2e200])]), 50) == [(50, 1, 51, pytest.approx(1.0))]


def test_an_id_with_two_vectors_is_one_row(spark):
    got = searched(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]), 50)
    assert [x[0] for x in got] == [0, 0] and {x[2] for x in got} == {1, 2}


def test_neighbours_recall_and_scores(spark):
    """Gaussian vectors, the hardest case, and one cluster that holds a third of all rows."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x[::3] = x[0] + 0.05 * x[::3]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    want = nearest_by_force(rows, 50)
    got = searched(frame(spark, rows), 50, cell_rows=200, block_rows=300)
    found, exact = ({(q, v): s for q, _, v, s in y} for y in (got, want))
    both = found.keys() & exact.keys()
    assert len(got) == len(want) and len(both) >= 0.95 * len(want)
    assert all(found[key] == exact[key] for key in both)
    far = searched(frame(spark, rows), 50, cell_rows=200, cell_recall=0.5, leaf_recall=0.5)
    assert len({(q, v) for q, _, v, _ in far} & exact.keys()) < len(both)  # visits are what recall is bought with


def test_best_bins_come_in_the_order_of_the_queue():
    x = neighbours.unit(np.random.default_rng(2).normal(size=(300, 8)))
    tree, place = neighbours.grow(x, 10, neighbours.Settings())
    assert np.bincount(place).max() <= 10 and len(np.bincount(place)) == tree.leaves
    for row, near in zip(neighbours.visits(tree, x[:20], tree.leaves), x[:20] @ tree.centres.T, strict=True):
        assert sorted(row) == list(range(tree.leaves))
        left = [float(near[c]) for c in tree.children[0]]
        assert tree.leaf[tree.children[0][int(np.argmax(left))]] in (-1, row[0])
    assert (neighbours.visits(tree, x, 1)[:, 0] == neighbours.descend(tree, x)).all()


def aligned_by_force(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp, p = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.pair(A, B)
    tok.encode_special_tokens = True
    count, found = collections.Counter(), []
    for i, text in rows:
        groups, mine, other, ends = [], [], [], [0, 0]
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(p.a.bytes[t] for t in a) != raw or b"".join(p.b.bytes[t] for t in b) != raw:
            a, b = [], []
        left, right = iter(a), iter(b)
        for _ in range(len(a) + len(b)):
            if ends[0] <= ends[1]:
                mine.append(next(left))
                ends[0] += len(p.a.bytes[mine[-1]])
            else:
                other.append(next(right))
                ends[1] += len(p.b.bytes[other[-1]])
            if ends[0] == ends[1]:
                groups.append((mine, other))
                mine, other = [], []
        links = collections.Counter((x, y) for g, h in groups for x in g for y in h)
        count.update(links.keys())
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    best = collections.Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = [(i, a, b, g, sum(m.values()), sum(n for k, n in m.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in m.items()), sha) for i, a, b, g, m, sha in found]
    return sorted(rows, key=repr), count


ODD = [(1001, "aﬁb １２ <|endoftext|> <s> 😀😀"), (1002, "日本" * 300), (1003, "x" * 3000), (1004, "\n\n  \t " * 200), (None, "a b"), (1005, " "), (1006, "\u0000\u007f ok"), (1006, "\u0000\u007f ok")]


def test_alignment_against_plain_loops(spark, documents, corpus):
    rows = [(i, t if t is None or len(t) < 50_000 else t[:50_000]) for i, t in corpus] + ODD
    docs = spark.createDataFrame([(i, t, 1, "a", "b") for i, t in rows], "doc_id bigint, text string, a int, block string, own string").repartition(5)
    want, count = aligned_by_force(rows)
    for s in (alignment.Settings(), alignment.Settings(block_bytes=20_000, part_bytes=1 << 13, links=50, counts=100)):
        assert sorted((tuple(r) for r in alignment.align(docs, A, B, s).collect()), key=repr) == want
    assert {(r["a"], r["b"]): r["n_docs"] for r in alignment.pair_counts(docs, A, B).collect()} == dict(count)


def test_alignment_of_nothing(spark, empty):
    assert alignment.align(empty, A, B).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in alignment.align(none, A, B).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_byte_vocabulary_by_merges_and_by_the_library_are_the_same():
    p = alignment.ByteEncoder(A)
    texts = [" " + prose(3, 400), " I'll 12 $$ 日本 é\n\n  x", " <|endoftext|>", " " + "ab" * 5000]
    fast = [p.ids(t).tolist() for t in texts]
    p.fast = None
    assert fast == [p.ids(t).tolist() for t in texts]


def audited(df, **settings):
    return sorted(tuple(r) for r in divergence.audit(df, divergence.Settings(**settings)).collect())


def test_divergence_against_sql(spark):
    rows = [(i, f"{prose(i % 9, 30)} Foo É é_x {'bar ' * (i % 3)}", ("en", "fr")[i % 2], f"s{i % 7}") for i in range(200)]
    rows += [(i, "hot words " + prose(i, 20), "en", "s0") for i in range(200, 320)]
    rows += [(900, None, None, None), (901, "", "xx", "s"), (902, " ab", "xx", "t"), (903, "", "en", "none"), (904, "é" * 10, "zz", None), (904, "é" * 10, "zz", None), (None, "a\u0000b" * 20_000, "en", "s1")]
    df = spark.createDataFrame([(*r, "term", 1.5, 7, 1) for r in rows], "doc_id bigint, text string, lang string, source string, part string, value double, rank int, chunk int").repartition(4)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang", "source").toPandas())
    want = sorted(con.sql(divergence.ORACLE_SQL).fetchall())
    assert audited(df) == want and {x[2] for x in want} == {"pair", "term"}
    assert audited(df, chunk_rows=50, span=1, least_block=2, entries=100, piece_bytes=20) == want


def test_divergence_of_nothing(spark, documents):
    assert audited(documents.limit(0)) == []


def test_probabilities_of_large_counts_are_exact(spark):
    rows = [(10**15, 4 * 10**15, 10**6), (0, 0, 1), (7, 10**15 + 1, 3), (10**12 + 1, 10**12 + 1, 10**9)]
    want = [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in rows]
    df = spark.createDataFrame(rows, "n bigint, total bigint, v bigint").select(divergence.probability(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    assert [r["p"] for r in df.collect()] == want
    assert [int(divergence.probabilities(np.array([n]), np.array([total]), v)[0]) for n, total, v in rows] == want


def test_a_language_with_few_ids_is_learned(spark):
    """298 rows of one language with an id each, and very many rows of another under two ids: both are learned, of an id one row."""
    rows = [(i, f"der die das und nicht {prose(i, 12)} ung schaft", "de") for i in range(298)]
    rows += [(1000 + i % 2, f"the and of with this {prose(i % 50, 12)} ing tion", "en") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language.train(docs, F.lit(True))
    assert model.languages == ("de", "en")


def windows_by_force(rows, templates, t=0.8):
    """Every window of every text against every template; greedy, as the operator's text says."""
    split = lambda text: re.sub(r"[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    known = {name: licenses.bigrams_of(x) for name, x in templates.items()}
    dice = lambda own, g: 2 * len(own & set(g)) / (len(own) + len(g))
    found = collections.Counter()
    best = {}
    for i, text in rows:
        taken, at = [], 0
        for line in (text or "").split("\n"):
            w = split(line)
            if w == [""]:
                continue
            own = {" ".join(w[j : j + 2]) for j in range(max(1, len(w) - 1))}
            # the query's lines are of the same templates
            name, d = max(((n, dice(own, g)) for n, g in sorted(known.items()) if len(own) in licenses.size_bounds(len(g), t)), key=lambda x: x[1], default=("", 0))
            if d >= t:
                taken.append((at, at + len(w) - 1))
                found[i, name] += 1
                best[i, name] = max(best.get((i, name), 0), d)
            at += len(w)
        w = split(text or "")
        grams = [" ".join(w[j : j + 2]) for j in range(len(w) - 1)]
        out = []
        for name, g in known.items():
            for a in range(len(grams)):
                for z in range(a + 1, min(len(grams), a + licenses.size_bounds(len(g), t)[-1]) + 1):
                    own = set(grams[a:z])
                    if dice(own, g) >= t:
                        out.append((-len(own & set(g)), -dice(own, g), name, a, z))
        for _, d, name, a, z in sorted(out):
            if not any(a <= y and x <= z for x, y in taken):
                taken.append((a, z))
                found[i, name] += 1
                best[i, name] = max(best.get((i, name), 0), -d)
    return sorted((i, n, c, best[i, n]) for (i, n), c in found.items())


def test_license_windows_against_every_window(spark):
    """Statements with words put in, left out and changed, within prose, wrapped, twice in a text and beside lines that count."""
    r, rows = random.Random(4), []
    for i, (_, text) in enumerate(sorted(licenses.TEMPLATES.items()) * 5):
        w = text.split()
        for _ in range(i % 4):
            at = r.randrange(len(w))
            w[at : at + r.choice((0, 1))] = r.choice(([], ["very"], ["quite", "so"]))
        body = " ".join(w)
        middle = body.replace(" ", "\n", 2) if i % 3 == 0 else body
        rows.append((i, f"{prose(i, 9)} {middle} {prose(i + 1, 7)}" + (f"\n{text}\n" if i % 5 == 0 else "") + (f" {body}" if i % 7 == 0 else "")))
    rows += [(900, "all rights all rights reserved reserved all rights"), (901, "reserved"), (902, "rights reserved all rights reserved all rights reserved")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["license"], r["n_lines"], r["dice"]) for r in licenses.scan(df, licenses.TEMPLATES).collect())
    want = windows_by_force(rows, licenses.TEMPLATES)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])


def test_one_word_put_into_a_statement(spark):
    w = "Licensed under the Apache License, Version 2.0.".split()
    rows = [(i, f"{prose(i, 8)} {' '.join([*w[:i], 'the very', *w[i:]][: i + 1] + w[i:])} {prose(i + 9, 8)}") for i in range(1, 7)]
    rows = [(i, t.replace("the very", "extra")) for i, t in rows]
    got = {r["doc_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r["license"] == "Apache-2.0"}
    assert got == {i for i, n, _, _ in windows_by_force(rows, licenses.TEMPLATES) if n == "Apache-2.0"} and len(got) >= 5

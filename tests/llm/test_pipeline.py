"""The pipeline against a brute-force version of each stage, on a small corpus with planted cases."""

import collections
import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lumidisc.llm import decontamination, packing, pii, toxicity
from lumidisc.llm.common import fold
from tests_llm_fixtures import components_by_force, prose

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, r = str(tmp_path_factory.mktemp("tables")), random.Random(20)
    items = [(i, prose(7000 + i, 25)) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        words = prose(i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            words[r.randrange(60)] = r.choice(["rotten", "vile"])
        if i % 40 == 3:
            words[30:30] = items[i % 5][1].split()
        if i % 30 == 7:
            words.insert(9, f"me{i}@mail.example.com")
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    for i in range(400, 430):  # copies, exact and near
        words = rows[11 + i % 3][1].split()
        if i % 2:
            words[r.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words), "en", "s", 0))
    rows += [(430, None, None, None, None), (431, "", "en", "s", 0), (None, "no id here", "en", "s", 0), (432, "no id here", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages_have_the_given_order_and_columns(spark, tables):
    folder, _, _ = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "pii", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_whole_texts_are_not_shuffled_for_a_few_copies(spark, tables):
    folder, _, _ = tables
    kept = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_run_equals_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), fold(4) != 2)
    rejected = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert sum(i % 5 == 0 for i in rejected if i is not None and i < 400) >= 72 and all(i % 5 == 0 or i >= 400 for i in rejected if i is not None)
    left = [r for r in rows if r[0] not in rejected]
    component = components_by_force([(r[0], r[1]) for r in left if r[0] is not None])
    left = [r for r in left if r[0] is None or component[r[0]][1] == r[0]]
    normal = [decontamination.normal(t) for _, t in items]
    left = [r for r in left if not any(decontamination.infix_distance(n, decontamination.normal(r[1]))[0] <= int(0.2 * len(n)) for n in normal)]
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, text, *_ in left:
        ids = encoder.ids(pii.redacted(text) if text else "") + np.array([1], "<u4").tobytes()
        want[i, len(ids) // 4, zlib.crc32(ids)] += 1
    packed = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in packed) == want
    from lumidisc.llm.common import shared_folder

    assert not [f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("corpus-")]
    assert len(want) < len(rows) - 100 and (None, 4) in {(i, n) for i, n, _ in want} and 430 in {i for i, _, _ in want}


def folders(spark):
    from lumidisc.llm.common import shared_folder

    return [f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("corpus-")]


def test_a_failed_stage_leaves_no_folder(spark, tables, monkeypatch):
    def breaks(spark, docs, sf_dir):
        raise RuntimeError("broken stage")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("pii", corpus_pipeline.redact_personal_data), ("broken", breaks), corpus_pipeline.STAGES[-1]])
    with pytest.raises(RuntimeError, match="broken stage"):
        corpus_pipeline.run(spark, tables[0])
    assert not folders(spark)


def test_run_with_odd_rows(spark, tables, tmp_path):
    folder, rows, items = tables
    extra = "component_id bigint, score double, predicted int, piece int, length bigint, part int, key string, spans string"
    long = prose(900, 60_000)
    odd = [(i, prose(500 + i, 80), "en", "s", 0) for i in range(30)]
    odd += [odd[3], odd[3], (50, long, None, None, None), (51, items[0][1] + " " + prose(901, 60), "en", "s", 0), (51, prose(902, 60), "en", "s", 0)]
    odd += [(None, None, None, None, None), (None, odd[4][1], None, None, None)]
    spark.createDataFrame([(*r, 7, 0.5, 1, 3, 9, 2, "k", "x") for r in odd], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + extra).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    labels.withColumn("toxic", labels["toxic"] * 0).write.parquet(f"{tmp_path}/labels.parquet")  # nothing is toxic here
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    n_tokens = lambda text: len(encoder.ids(pii.redacted(text) if text else "")) // 4 + 1
    want = collections.Counter()
    for i, text, *_ in odd:
        if (i, text) != odd[33][:2]:  # it holds an item; the other row of its id doesn't
            want[i] += n_tokens(text)
    got = collections.Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == want and sum(r["doc_id"] == 50 for r in packed) == -(-n_tokens(long) // 4096) > 5
    filled = collections.defaultdict(list)
    for r in packed:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in filled.values():
        ends = [a + n for a, n in sorted(pieces)]
        assert ends[-1] <= 4096 and [a for a, _ in sorted(pieces)] == [0, *ends[:-1]]


def test_run_on_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0 and not folders(spark)

import pytest
from tests_llm_fixtures import prose


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with nulls, empty and very long texts, ties, exact and near copies."""
    rows = [(i, prose(i, 20 + 7 * i % 90)) for i in range(60)]
    base = prose(999, 120).split()
    for i in range(60, 75):
        words = list(base)
        for k in range(i % 4):
            words[(17 * i + 31 * k) % 120] = f"new{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(75, rows[3][1]), (76, rows[3][1].upper()), (77, None), (78, ""), (79, " \t\n"), (80, "one"), (81, "one"), (82, "two words"), (83, prose(5, 30_000)), (84, "É é   x")]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """With further columns whose names clash with what operators make."""
    rows = [(i, t, ("en", "fr", None)[i % 3], f"src{i % 4}", len(t or ""), "x", 0.5) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, score double").cache()


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)

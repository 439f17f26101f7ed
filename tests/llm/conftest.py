import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_bitmap string, mix string, revisit string"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    en = ["the", "of", "and", "thing", "other", "with", "ship", "hat", "rest", "then"] + [f"w{i}" for i in range(400)]
    fr = ["le", "des", "é", "où", "avec", "être", "château"] + [f"ç{i}" for i in range(400)]
    rows = []
    for i in range(120):
        lang, words = ("en", en) if i % 3 else ("fr", fr)
        rows.append((i, "\n".join(sentence(rng, rng.randrange(5, 60), words) for _ in range(rng.randrange(1, 6))), lang, f"s{i % 4}", 0, "x", "y", "z"))
    shared = sentence(rng, 90, en)
    line = "  This line stands in many Documents.\t"
    for i in range(120, 140):
        rows.append((i, f"{sentence(rng, 30, en)}\n{line}\n{shared}\n{sentence(rng, 20, en)}\n{line.upper()}", "en", "s1", 0, None, None, None))
    base = sentence(rng, 300, en).split()
    for i in range(140, 150):
        w = list(base)
        w[i % 300] = "changed"
        rows.append((i, " ".join(w), "en", None, 0, None, None, None))
    rows += [(150, " ".join(base), "en", "s0", 0, None, None, None), (151, " ".join(base), "en", "s0", 0, None, None, None)]
    rows += [(152, None, None, None, None, None, None, None), (153, "", "en", "s2", 0, None, None, None), (154, " \n\t", None, "s2", 0, None, None, None), (155, "12 34 !!", "en", "s2", 0, None, None, None)]
    rows += [(None, "no id here, but some words", "en", "s3", 0, None, None, None), (156, "twice the same row", "en", "s3", 0, None, None, None), (156, "twice the same row", "en", "s3", 0, None, None, None), (157, "one id", "en", "s3", 0, None, None, None), (157, "one id, two texts " + line, "en", "s3", 0, None, None, None)]
    rows += [(158, sentence(rng, 20_000, en), "en", "s0", 0, None, None, None), (159, "a " * 3000, "en", "s0", 0, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

"""The pipeline's stages on the odd rows: columns, decisions, and packing of what is left."""

from collections import Counter


def test_stages(spark, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dup", "mix", "packing"]
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    d = docs.select(*cols)
    seen = [d]
    for name, stage in p.STAGES:
        d = stage(spark, d, "").cache()
        if name != "packing":
            assert d.columns == cols
        seen.append(d)
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert ids[0] - ids[1] == {152, 153, 154, 155}  # no letter, no language
    assert ids[1] == ids[2]
    assert {140} == ids[3] & set(range(140, 152))
    copies = Counter(r.doc_id for r in seen[4].select("doc_id").collect())
    assert max(copies.values()) <= 6  # three, for each of the rows that stand twice
    assert {r.doc_id for r in seen[5].select("doc_id").collect()} == ids[4]


def test_run_and_empty(spark, docs, empty, tmp_path):
    import corpus_pipeline as p

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    empty.select(*cols).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0

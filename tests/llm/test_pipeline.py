"""The stages against plain Python on a small corpus, and the registered queries' columns."""

from tests.llm import fixtures as fx


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from granary.llm.queries import tokenizer_file
    from granary.llm.pieces import codec

    rows = [(abs(r[0]) + 1000 * (r[0] < 0), r[1], "en", r[3] or "s9", len(r[1] or "")) for r in fx.documents(160)]
    toxic = [(5000 + i, f"vileword grimword and {i} more words of this text {'vileword ' * 3}", "en", "s0", 10) for i in range(40)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows + toxic, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 1, 1) for r in toxic], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mix_sources", "pieces"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    clean, distinct, near, mixed, coded = seen
    for d in seen[:4]:
        assert d.columns == schema.replace(" bigint", "").replace(" string", "").split(", ")
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows}
    last = {}
    for r in rows:
        last[r[1] or ""] = max(last.get(r[1] or "", -1), r[0])
    assert {r.doc_id for r in distinct.collect()} == set(last.values())
    text = {r[0]: r[1] for r in rows}
    want = {i for i, (_, c, _) in fx.components([(i, text[i]) for i in last.values()]).items() if c == i}
    assert {r.doc_id for r in near.collect()} == want
    assert {r.doc_id for r in mixed.collect()} <= want and mixed.count() == coded.count()
    c = codec(tokenizer_file())
    assert all(r.exact and c.decode(r.ids) == (text[r.doc_id] or "") for r in coded.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == coded.count()


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)

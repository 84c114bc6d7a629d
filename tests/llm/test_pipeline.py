import random

import corpus_pipeline
from lodestone.llm import near_dedup


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(["the", "and", "tion", "ing", "er"], k=3))
    texts = [" ".join(word() for _ in range(60)) for _ in range(90)]
    for i in range(0, 90, 5):
        texts[i] = " ".join([*texts[i].split(), *rng.choices(["vile", "nasty"], k=3), word()])
    texts += [None, "12345 !!", texts[1], texts[2] + " password=abcdefgh1"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 5 == 0 and i < 90)) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sizes = d, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == d.columns, name
        sizes.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert {90, 91} & sizes[0] == set() and len(sizes[0]) == 92
    assert len(sizes[0] - sizes[1]) >= 12 and all(i % 5 == 0 for i in sizes[0] - sizes[1])
    assert 92 not in sizes[2] and sizes[3] == sizes[2]
    assert not docs.where("text like '%password=%'").count()
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == sizes[2]
    assert near_dedup.classes(d.limit(0)).count() == 0


def test_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, label int, t string, th long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, rows in (("none", []), ("some", [(1, "the same words here", "en", "s", 19, 9, 0.5, 3, "x", 4)] * 2 + [(None, None, None, None, None, None, None, None, None, None)])):
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(folder))
            assert docs.schema.names == schema.replace(",", "").split()[::2]
        pieces = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in pieces} == ({1} if rows else set()) and len(pieces) == bool(rows)

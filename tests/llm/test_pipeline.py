"""The pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline


def corpus():
    r = random.Random(16)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 7)))
    text = lambda n: ".\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    rows = [(i, text(r.randint(3, 12))) for i in range(120)]
    copies = [(200 + i, rows[i][1]) for i in range(10)]
    near = [(300 + i, rows[20 + i][1] + "!") for i in range(10)]
    items = [(k, " ".join(word() for _ in range(25))) for k in range(5)]
    leaks = [(400 + k, f"{text(4)}\n{t}\n{text(4)}") for k, t in items]
    bad = [(500 + i, f"{text(3)} vile nasty {text(2)} nasty vile {text(1)} vile") for i in range(60)]
    labels = [(i, 0) for i, _ in rows] + [(i, 1) for i, _ in bad]
    return rows, copies, near, leaks, bad, items, labels


def test_planted(spark, tmp_path):
    rows, copies, near, leaks, bad, items, labels = corpus()
    every = [(i, t, "en", "s", len(t)) for i, t in rows + copies + near + leaks + bad]
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    schema = docs.schema
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in schema]
            found.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r["doc_id"] for r in docs.collect()}
    clean = {i for i, _ in rows}
    assert clean <= left
    assert not left & {i for i, _ in copies + near + leaks + bad}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == left


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

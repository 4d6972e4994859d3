import random

import corpus_pipeline as C
from tests.llm.conftest import words
from tests.llm.test_near_dedup import edited


def test_all_stages(spark, tmp_path):
    r = random.Random(6)
    leak = words(5000, 40)
    rows = [(i, words(i, r.randint(30, 120))) for i in range(300)]
    rows += [(1000 + i, words(i, 30) + " vilescum " + words(i + 7, 30)) for i in range(120)]  # toxic
    rows += [(2000 + i, rows[i][1]) for i in range(20)]  # copies
    rows += [(3000 + i, edited(i, rows[100 + i][1], 1)) for i in range(20) if len(rows[100 + i][1].split()) > 60]  # near copies
    near = len([x for x in rows if x[0] >= 3000])
    rows += [(4000 + i, words(7000 + i, 40) + " " + leak + " " + words(8000 + i, 9)) for i in range(10)]  # leaks
    rows += [(5000, None), (5001, "")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(1000 <= i < 2000)) for i, _ in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs.count()]
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(C.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(docs.count())
    ids = {x.doc_id for x in docs.collect()}
    assert ids == set(range(300)) | {5000}
    assert kept == [len(rows), len(rows) - 120, len(rows) - 120 - 21, len(rows) - 141 - near, 301, 301]
    assert {x.doc_id for x in C.run(spark, str(tmp_path)).collect()} == ids


def test_empty(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0

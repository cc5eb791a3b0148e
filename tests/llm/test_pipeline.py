import random

import corpus_pipeline
import __spark_entry__

from .conftest import words


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 25))) for i in range(3)]
    docs, labels = [], []
    for i in range(150):
        text = "\n".join(" ".join(words(rng, 40)) for _ in range(3))
        if i % 5 == 1:
            text = " ".join(w + "###" for w in text.split())
        if i == 10:
            text += "\n" + items[1][1]
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 5 != 1), 0))
    near = docs[2][1].split(" ")
    near[10] = "changed"
    docs += [(500, docs[0][1], "en", "s", 1), (501, " ".join(near), "en", "s", 1), (502, None, "en", None, None), (503, "", None, "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x.doc_id for x in left.select("doc_id").collect()}
    good = {i for i in range(150) if i % 5 != 1}
    assert good - {0} <= kept["quality_classifier"]
    assert not kept["quality_classifier"] & (set(range(150)) - good)
    assert 500 not in kept["line_dedup"]
    assert 10 not in kept["decontamination"]
    assert good - {10} <= kept["decontamination"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == kept["decontamination"]


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1

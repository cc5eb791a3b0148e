import random
import zlib

from ferrule.llm import quality

from .conftest import words


def corpus(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = words(rng, rng.randrange(20, 80))
        rows.append((i, " ".join(w) if good else " ".join(x + rng.choice(["###", "!!", "%%%"]) for x in w)))
        labels.append((i, int(good), 0))
    rows += [(n, None), (n + 1, ""), (None, "some words")]
    labels += [(n + 5, None, 0), (None, 1, 0), (0, labels[0][1], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(x[:2] for x in labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    held = [x for x in got if x.held_out]
    assert {x.doc_id for x in held} == {x.doc_id for x in got if x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2}
    known = [x for x in held if truth.get(x.doc_id) is not None]
    assert sum(x.predicted == truth[x.doc_id] for x in known) / len(known) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)


def test_held_out_labels_never_matter(spark):
    docs, labels, _ = corpus(spark, 120)
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted((x.doc_id or -1, x.score) for x in quality.classify(docs, labels).collect())
    assert a == sorted((x.doc_id or -1, x.score) for x in quality.classify(docs, turned).collect())


def test_few_or_no_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x.score for x in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(no_docs, none).count() == 0
    assert quality.kept(docs, none, 0.4).count() == docs.count()
    assert quality.kept(docs, none, 0.4).columns == docs.columns

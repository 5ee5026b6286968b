"""The corpus pipeline over the smallest driver tables, and planted cases."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from cilake.session import written

SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "stage")
        assert out.columns == docs.columns, name
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[4] and last.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_planted_cases(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0")
    clean = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars between 2000 and 6000").join(labels, "doc_id", "left_semi")
    rows = [tuple(r) for r in clean.limit(40).collect()]
    rng, planted = random.Random(11), []
    for k, (i, text, lang, source, n) in enumerate(rows):
        words = text.split(" ")
        near = [w.upper() if rng.random() < 0.3 and w.isascii() else w + " " for w in words]  # other letters and spaces, the same shingles
        rude = [w if rng.random() > 0.04 else rng.choice(["idiot", "moron", "trash", "worthless", "stupid"]) for w in words]
        planted += [(10_000 + k, text, lang, source, n), (20_000 + k, " ".join(near), lang, source, n), (30_000 + k, " ".join(rude), lang, source, n),
                    (40_000 + k, " ".join(words[:20] * 30), lang, source, n)]
    docs = spark.createDataFrame(rows + planted, clean.schema)
    for stage in (corpus_pipeline.good, corpus_pipeline.clean, corpus_pipeline.single):
        docs = written(stage(spark, docs, SF), "stage")
    left = {r.doc_id for r in docs.collect()}
    assert not [i for i in left if i >= 10_000]
    assert len(left) >= len(rows) - 2


def test_nulls_and_empty_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, None, "en", None, 0), (1, "", None, "s", None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()

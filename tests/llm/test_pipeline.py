"""Each stage keeps what it should and its columns; run() is the stages one after the other."""

from __future__ import annotations

import corpus_pipeline as P


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "secret_scans", "mixing", "packing"]
    kept = P.drop_toxic(spark, docs, sf_dir)
    assert kept.columns == columns and 0.8 * docs.count() < kept.count() <= docs.count()
    one = P.drop_near_duplicates(spark, docs, sf_dir)
    assert one.columns == columns and one.groupBy("text").count().where("count > 1 and length(text) > 0").count() == 0
    clean = P.redact_secrets(spark, one, sf_dir)
    assert clean.columns == columns and clean.count() == one.count()
    mixed = P.mix_sources(spark, clean, sf_dir)
    assert mixed.columns == columns and mixed.count() > 0
    packed = P.run(spark, sf_dir)
    assert packed.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns)

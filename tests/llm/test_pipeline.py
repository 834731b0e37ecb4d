"""The pipeline's stages, each against brute force on its own input."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_minhash import brute
from tests.llm.test_scans import brute_hits, brute_secrets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == columns
        if name == "quality":
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in after for i in good) > 0.97 * len(good) and sum(i in after for i, q in labels.items() if q == 0) < 10
        elif name == "near_duplicate":
            kept = {i for i, _, _, stays in brute([(i, r.text) for i, r in before.items()], 5, 80) if stays}
            assert set(after) == kept and len(kept) < len(before)
        elif name == "decontamination":
            likely = [i for i, r in before.items() if i not in after][:20] + list(after)[:60]
            for i in likely:
                n, hit, _ = brute_hits(before[i].text[:6000], items, 13) if len(before[i].text) <= 6000 else (0, 0, 0)
                if n:
                    assert (i in after) == (hit == 0 or 20 * hit < n)
        elif name == "secrets":
            assert set(after) == set(before) and not any(brute_secrets(r.text) for r in after.values())
            assert all(r.text == before[i].text for i, r in after.items() if not brute_secrets(before[i].text) and "[secret]" not in r.text)
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert all(np.frombuffer(r.ids, "<u4").tolist() == library.encode(before[i].text, add_special_tokens=False).ids and r.round_trip for i, r in after.items())
        before = after
    assert before


def odd_tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_hit string, Spans int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("a", "one two three four five six"), ("b", None), (None, "x")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_on_odd_rows(spark, tmp_path):
    long = "plain words that go on and on without an end. " * 5000
    rows = [(i, t, "en", None, None, "x", 1) for i, t in enumerate([None, "", "a", long, "Some sentence of words. " * 30, "password = hunter2hunter2", "\x00퟿ é"])]
    rows += [(4, "Some sentence of words. " * 30, None, "s", 1, None, None)] * 3 + [(None, "no id here at all", None, None, None, None, None)]
    docs = odd_tables(spark, tmp_path, rows)
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert after.count() <= docs.count()
        if name != "bpe":
            assert after.columns == docs.columns
            docs = after
    assert all(r.round_trip for r in after.collect())


def test_stages_on_empty_tables(spark, tmp_path):
    docs = odd_tables(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        assert after.count() == 0 and (name == "bpe" or after.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""The pipeline's stages on a small odd table: columns, effects, and what stays."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from anchorage.llm import mixing
from anchorage.session import materialize
from tests_llm_helpers import brute_components, brute_pii, brute_quality, corpus


@pytest.fixture(scope="module")
def stages(spark):
    texts = corpus(21, 90, 90)
    texts = [t + f" mail user{k}@mail{k % 7}.example.com and 10.0.{k}.7 now" if k % 9 == 0 else t for k, t in enumerate(texts)]
    texts += ["same words again " * 30, "", None, "x\n" * 50]
    rows = [(k, t, "en", f"s{k % 4}" if k % 11 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[0], rows[5], (None, texts[1], None, "s1", 3), (7, texts[2], "de", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, materialize(stage(spark, out[-1][1], ""), "test", name)))
    return dict(out)


def rows_of(df):
    return sorted((tuple((v is not None, v) for v in r) for r in df.collect()))


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "packing"]
    for name in [n for n, _ in corpus_pipeline.STAGES][:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_quality(stages):
    want = stages["documents"].collect()
    want = [r for r in want if brute_quality(r.text)[-1]]
    assert rows_of(stages["quality_rules"]) == sorted(tuple((v is not None, v) for v in r) for r in want)


def test_one_of_each_group(stages):
    before = [(r.doc_id, r.text) for r in stages["quality_rules"].collect()]
    least = brute_components(before, 5, 80)
    kept = [r.doc_id for r in stages["near_duplicates"].collect()]
    assert sorted(k for k in kept if k is not None) == sorted({c for c in least.values()})
    assert sum(k is None for k in kept) == sum(i is None for i, _ in before)


def test_personal_data_is_masked_and_the_rest_is_not(stages):
    before = {r.doc_id: r.text for r in stages["near_duplicates"].collect()}
    after = stages["personal_data"].collect()
    assert len(after) == stages["near_duplicates"].count()
    for r in after:
        assert brute_pii(r.text) == [] and r.n_chars == len(r.text)
        if not brute_pii(before[r.doc_id]) and not re.search("[0-9]", before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_mix_takes_whole_copies(stages):
    taken = mixing.mix_sources(stages["personal_data"])
    want = {(r.doc_id, r.size): r.taken for r in taken.collect()}
    got = stages["source_mix"].withColumn("size", mixing.size_of("text")).groupBy("doc_id", "size").agg(F.sum("size").alias("taken"))
    assert {(r.doc_id, r.size): r.taken for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_every_copy_is_packed(stages):
    packed = stages["packing"]
    assert packed.where("piece = 0").count() == stages["source_mix"].count()
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.where("n <> end OR n > 2048").count() == 0


def test_stages_hand_python_small_batches(spark, monkeypatch):
    def sizes(docs):
        return docs.mapInArrow(lambda source: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in source), "n long")

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(corpus_pipeline, "keep_good", sizes)
    try:
        got = [r.n for r in corpus_pipeline.quality_rules(spark, spark.range(0, 5000, 1, 1), "").collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(got) == 5000 and max(got) <= 1000


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []

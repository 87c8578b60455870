"""The pipeline's stages: what goes and what stays, against labels and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import DOCS
from tests.llm.test_pairs import brute, sets_of
from tests.llm.test_tokens import check_pieces
from vitrine.llm.common import tokenizer_path

SF2 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF2}/documents.parquet").cache(), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF2).cache())
        out[-1].count()
    return out


def test_stages_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "ngram_join", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    counts = [s.count() for s in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and len(set(counts)) == 4


@pytest.mark.parametrize(("at", "label", "goes"), [(1, "toxic", 1), (2, "quality", 0)])
def test_labelled_documents(spark, stages, at, label, goes):
    labels = spark.read.parquet(f"{SF2}/labels.parquet").select("doc_id", label)
    given = stages[at - 1].select("doc_id").join(labels, "doc_id").collect()
    left = {r.doc_id for r in stages[at].select("doc_id").collect()}
    assert np.mean([(r.doc_id in left) == (r[label] != goes) for r in given]) > 0.95


def test_one_of_each_group(stages):
    docs = stages[2].select("doc_id", "text").collect()
    want = {k for k, (_, first) in brute([d.doc_id for d in docs], sets_of([d.text for d in docs])).items() if k == first}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_packed_documents(stages):
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    check_pieces(stages[4].collect(), texts, Tokenizer.from_file(tokenizer_path()))


def test_run_is_the_stages(spark, stages):
    total = lambda df: df.agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert total(corpus_pipeline.queries()["pipeline"](spark, SF2)) == total(stages[4])


def test_odd_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, None, "en", None, None), (None, "some text", None, "s", 9), (2, "", "en", "s", 0), (3, "same words", "en", "s", 1), (4, "same words", "en", "s", 1)], DOCS)
    docs = docs.withColumns({"score": F.lit("mine"), "predicted": F.lit(7)})
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF2)
            assert frame.columns == docs.columns
        assert {r.score for r in frame.collect()} <= {"mine"}
        assert {r.doc_id for r in frame.collect()} in ({1, None, 2, 3}, set())
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF2).columns[:3] == ["doc_id", "start", "length"]

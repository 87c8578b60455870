"""Toxicity and quality classifiers: parts against plain versions, whole models by held-out accuracy."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from vitrine.llm import quality_classifier as quality, quality_rules, toxicity
from vitrine.llm.queries import queries

SF2 = "/root/testdata/sf0.01"


def plain_kernel(a, b):
    """Mean of the normalised kernels, by listing all subsequences."""
    def features(s, size):
        out = {}
        for places in itertools.combinations(range(len(s)), size):
            if all(s[p].isalpha() or s[p] == "^" for p in places):
                key = "".join(s[p] for p in places)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (places[-1] - places[0] + 1)
        return out

    total = 0
    for size in toxicity.LENGTHS:
        x, y = features(a, size), features(b, size)
        norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        total += sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0
    return total / len(toxicity.LENGTHS)


WORDS = ["^idiot", "^i.d.i.o.t", "^idxiot", "^banana", "^bandana", "^aaaa", "^tod", "^ab"]


def test_kernel_against_listing():
    got = toxicity.kernel(WORDS, WORDS[:5])
    want = [[plain_kernel(a, b) for b in WORDS[:5]] for a in WORDS]
    assert np.allclose(got, want, atol=1e-4)


def test_folded_margins_are_those_over_landmarks():
    marks = ["^idiot", "^loser", "^scum"]
    model = toxicity.Model(marks, np.array([0.7, -0.2, 0.4]), -0.3, 1.0, 0.0)
    found = ["idiot", "loses", "scxum", "i.d.i.o.t", "other", "a", ""]
    want = [max(toxicity.kernel([w], marks)[0] @ model.weights for w in toxicity.windows(u)) - 0.3 if len(u) >= 3 else -0.3 for u in found]
    assert np.allclose(toxicity.Folded(model).margins(found), want, atol=1e-4)


def test_gapped_and_spelt_out_words_reach_their_landmark():
    near = toxicity.kernel(["^idiot", "^i.d.i.o.t", "^idiiot", "^window"], ["^idiot"])[:, 0]
    assert near[0] > 0.99 and near[1] > 0.8 and near[2] > 0.6 and near[3] < 0.2
    assert toxicity.spelt_out("you i d i o t") == ["idiot"] and toxicity.spelt_out("a b word") == []


def test_windows_cover_long_units():
    unit = "".join(chr(97 + i % 26) for i in range(100))
    joined = toxicity.windows(unit)
    assert all(len(w) <= toxicity.WINDOW + 1 for w in joined)
    assert {unit[i:i + 7] for i in range(94)} <= {w[i:i + 7] for w in joined for i in range(len(w))}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}


@pytest.mark.parametrize(("name", "label", "least"), [("op5_toxicity", "toxic", 0.5), ("op10_quality_classifier", "quality", 0.3)])
def test_held_out_accuracy(spark, labels, name, label, least):
    rows = queries()[name](spark, SF2).collect()
    assert len(rows) == spark.read.parquet(f"{SF2}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= least)
    judged = [(r.predicted, labels[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 30 and np.mean([p == y for p, y in judged]) > 0.9


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows_and_labels(spark, make_docs, module, label):
    docs = make_docs(ODD + ["you idiot there", "fine words here"] * 6).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        model = module.fit_documents(docs, given)
        rows = module.score(docs, model).collect()
        assert len(rows) == docs.count() and len({round(r.score, 9) for r in rows}) == 1  # nothing to learn from
    taught = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 2 == 1)) for i in range(15, 27)], "doc_id long, quality int, toxic int")
    model = module.fit_documents(docs, taught)
    rows = {r.doc_id: r for r in module.score(docs, model).collect()}
    assert rows[12].score == rows[13].score and all(0 <= r.score <= 1 for r in rows.values())
    assert module.score(docs.limit(0), model).count() == 0


def test_indicators_of_long_texts_and_ratios():
    text = "Word word. " * 300
    found = quality.Indicators()
    whole = found.of(text)
    at, quality._AT_ONCE = quality._AT_ONCE, 64
    try:
        assert np.array_equal(whole, found.of(text))
    finally:
        quality._AT_ONCE = at
    ratios = quality.log_count_ratios([np.array([1, 2]), np.array([2, 3])], np.array([1, 0]))
    assert ratios[1] > 0 > ratios[3] and abs(ratios[2]) < 1e-9


def test_dual_descent_meets_the_optimum_conditions():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(120)]
    values = np.zeros(quality.SIZE)
    values[:40] = rng.normal(size=40)
    y = np.where([values[r].sum() + 0.3 * rng.normal() > 0 for r in rows], 1.0, -1.0)
    w, bias = quality.dual_coordinate_descent(rows, values, y, passes=2000, enough=1e-10)
    scaled = np.zeros((120, 41))
    for i, r in enumerate(rows):
        scaled[i, r] = values[r] / np.linalg.norm(values[r])
    scaled[:, 40] = 1
    w1 = np.append(w[:40], bias)
    primal = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (scaled @ v)).sum()
    assert all(primal(w1) <= primal(w1 + 0.01 * rng.normal(size=41)) + 1e-6 for _ in range(200))


def test_held_out_labels_are_not_read(spark):
    """Turning round every label of the held-out fold changes nothing that quality scores are made from."""
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert turned.exceptAll(labels).count() > 0
    one, other = (quality.fit_documents(docs, x) for x in (labels, turned))
    assert np.array_equal(one.weights, other.weights) and (one.bias, one.slope, one.shift) == (other.bias, other.slope, other.shift)
    rules = [quality_rules.apply_rules(docs, x)[1] for x in (labels, turned)]
    assert rules[0] == rules[1]

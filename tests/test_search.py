"""The search that fits many models in one pass: parts against plain versions, the whole against Spark's own models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.ml import search, sentiment, words

WORDS = [f"w{i:02d}" for i in range(40)]


@pytest.fixture(scope="module")
def rows(spark):
    """Texts whose words lean towards their label, an amount and a category that do so too, and rows without a text."""
    draw = random.Random(4)
    out = []
    for i in range(400):
        label = i % 3 > 0
        lean = WORDS[:25] if label else WORDS[15:]
        text = " ".join(draw.choice(lean) for _ in range(draw.randint(0 if i % 50 else 0, 25)))
        out.append((i, text, float(label), i % 5, draw.gauss(3.0 * label, 4.0), draw.choice("abc" if label else "bcd"), int(draw.random() < 0.3 + 0.2 * label)))
    return spark.createDataFrame(out, "doc long, review_text string, label double, fold int, amount double, kind string, flag int").cache()


def plain_terms(text):
    w = [x for x in text.split() if len(x) > 1]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_features(rows, fold, size, least=7):
    """One row of numbers a document, as the fold's own pipeline gives it: categories, amount, flag, terms in their order of frequency."""
    inside = [r for r in rows if r.fold != fold]
    listed = [plain_terms(r.review_text) for r in inside]
    df, tf = {}, {}
    for terms in listed:
        for t in terms:
            tf[t] = tf.get(t, 0) + 1
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    kept = sorted((t for t in df if least <= df[t] <= 0.8 * len(inside)), key=lambda t: (-tf[t], t))[:size]
    kinds = sorted({r.kind for r in inside})[1:]
    low, mid, high = np.percentile([r.amount for r in inside], [25, 50, 75])
    out = []
    for r in rows:
        terms = plain_terms(r.review_text)
        x = np.array([terms.count(t) * (math.log((1 + len(inside)) / (1 + df[t])) + 1) for t in kept])
        x = x / (np.sqrt((x * x).sum()) or 1.0)
        out.append([*[float(r.kind == k) for k in kinds], (r.amount - mid) / (high - low), float(r.flag), *x])
    return np.array(out), kinds, kept


@pytest.fixture(scope="module")
def packed(rows):
    prepared = search.prepare(rows, 5, 60, ["kind"], ["amount"], ["flag"])
    blocks = search.blocks(rows, prepared)
    yield prepared, blocks
    blocks.unpersist()


@pytest.mark.parametrize(("fold", "size"), [(0, 60), (3, 20)])
def test_features_are_those_of_the_folds_pipeline(rows, packed, fold, size):
    prepared, blocks = packed
    local = rows.collect()
    want, kinds, kept = plain_features(local, fold, size)
    used = prepared.used(fold, size)
    names = [*[v for _, v in prepared.categories], "amount", "flag", *prepared.terms]
    assert [n for n, u in zip(names, used, strict=True) if u][:len(kinds)] == kinds
    order = [names.index(n) for n in [*kinds, "amount", "flag", *kept]]
    got = []
    for line in blocks.collect():
        block = search._unpacked(line.asDict())
        got += [(f, y, *x) for f, y, x in zip(block["fold"], block["label"], search.matrix(block, prepared, fold, size)[:, order], strict=True)]
        assert not search.matrix(block, prepared, fold, size)[:, ~used].any()
    as_rows = lambda lines: np.array(sorted([f, y, *np.round(x, 9)] for f, y, x in lines))
    assert np.allclose(as_rows((g[0], g[1], g[2:]) for g in got), as_rows((r.fold, r.label, x) for r, x in zip(local, want, strict=True)))


def test_logistic_models_of_a_pass_reach_their_minima(rows, packed):
    prepared, blocks = packed
    sizes = search.class_sizes(blocks, 5)
    assert sizes.sum() == 400
    models = [{"fold": f, "max_features": s, "C": c, "max_iter": 500, "class_weight": w} for f, s, c, w in ((0, 60, 1.0, None), (0, 60, 8.0, "balanced"), (2, 20, 0.05, None))]
    found = search.logistic_weights(blocks, prepared, models, sizes)
    local = rows.collect()
    for m, w in zip(models, found, strict=True):
        x, kinds, kept = plain_features(local, m["fold"], m["max_features"])
        inside = np.array([r.fold != m["fold"] for r in local])
        y = np.array([1.0 if r.label else -1.0 for r in local])[inside]
        names = [*[v for _, v in prepared.categories], "amount", "flag", *prepared.terms]
        b = w[[names.index(n) for n in [*kinds, "amount", "flag", *kept]]]
        weight = np.ones(len(y)) if m["class_weight"] is None else np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
        pull = -y * weight / (1 + np.exp(y * (x[inside] @ b + w[-1])))
        gradient = np.append(x[inside].T @ pull + b / m["C"], pull.sum()) / weight.sum()
        assert np.abs(gradient).max() < 2e-4
        assert np.abs(np.delete(w[:-1], [names.index(n) for n in [*kinds, "amount", "flag", *kept]])).max() == 0


def test_an_iteration_limit_stops_a_fit(packed):
    prepared, blocks = packed
    model = {"fold": 0, "max_features": 60, "C": 10.0, "class_weight": None}
    short, full = search.logistic_weights(blocks, prepared, [model | {"max_iter": 1}, model | {"max_iter": 500}], search.class_sizes(blocks, 5))
    assert 0 < np.abs(short).sum() < np.abs(full).sum()


def test_bayes_counts_are_those_of_a_plain_model(rows, packed):
    prepared, blocks = packed
    local = rows.collect()
    moments = search.class_moments(blocks, prepared, [(f, 60) for f in range(5)])
    models = [{"fold": f, "max_features": 60, "var_smoothing": v} for v in (1e-9, 1e-3) for f in range(5)]
    cells = search._judged_bayes(blocks, prepared, models, moments)
    for m, got in zip(models, cells, strict=True):
        x, *_ = plain_features(local, m["fold"], 60)
        inside, label = np.array([r.fold != m["fold"] for r in local]), np.array([int(r.label) for r in local])
        chance = []
        for c in (0, 1):
            part = x[inside & (label == c)]
            v = part.var(0) + m["var_smoothing"] * x[inside].var(0).max()
            chance.append(-0.5 * (np.log(2 * np.pi * v) + (x[~inside] - part.mean(0)) ** 2 / v).sum(1) + math.log(len(part) / inside.sum()))
        want = np.zeros((2, 2))
        np.add.at(want, (label[~inside], (chance[1] > chance[0]).astype(int)), 1)
        assert np.array_equal(got, want)


def test_folds_hold_nothing_of_their_own_rows(rows):
    """A term and a category that one fold alone has are no feature where that fold is held out."""
    odd = rows.withColumns({"review_text": F.when(F.col("fold") == 1, F.lit("secret word of one fold")).otherwise(F.col("review_text")), "kind": F.when(F.col("fold") == 1, F.lit("aa")).otherwise(F.col("kind"))})
    prepared = search.prepare(odd, 5, 60, ["kind"], ["amount"], ["flag"])
    names = [v for _, v in prepared.categories], prepared.terms
    assert "secret" in names[1] and "aa" in names[0]
    for fold in range(5):
        used = prepared.used(fold, 60)
        assert used[prepared.narrow + names[1].index("secret")] == (fold != 1) and (fold != 1 or not used[names[0].index("aa")])


def test_sampler_finds_the_better_region():
    space = {"x": search.Range(1e-3, 1e3, log=True), "n": search.Range(500, 2500, step=500), "k": ("good", "bad", None), "y": search.Range(0.0, 1.0)}
    score = lambda p: -abs(math.log(p["x"]) - 2) - abs(p["n"] - 1500) / 500 + (p["k"] == "good") - abs(p["y"] - 0.3)
    guided, drawn = [], []
    for seed in range(8):
        sampler = search.Parzen(space, seed)
        for _ in range(12):
            for p in sampler.ask(5):
                assert 1e-3 <= p["x"] <= 1e3 and p["n"] in range(500, 2501, 500) and p["k"] in space["k"] and 0 <= p["y"] <= 1
                sampler.tell(p, score(p))
        scores = [s for s, _ in sampler.scored]
        drawn.append(np.mean(scores[:10]))
        guided.append(np.mean(scores[-20:]))
    assert np.mean(guided) > np.mean(drawn) + 1
    assert search.Parzen(space, 3).ask(4) == search.Parzen(space, 3).ask(4)


def test_scores():
    assert search.macro_f1(np.array([[3, 1], [1, 3]])) == 0.75 and search.macro_f1(np.array([[4, 0], [2, 0]])) == pytest.approx(0.4)
    assert search.macro_f1(np.zeros((2, 2))) == 0.0
    assert search.objective([0.5, 0.7]) == pytest.approx(0.55) and search.objective([0.5, math.nan]) == 0.0


def test_many_parts_are_added_on_the_cluster(rows, monkeypatch):
    prepared = search.prepare(rows, 5, 10)
    blocks = search.blocks(rows.repartition(30), prepared).repartition(30)
    monkeypatch.setattr(search, "FEW_PARTS", 4)
    assert search.class_sizes(blocks, 5).sum() == 400


def test_search_of_both_models(rows):
    spaces = {"logistic": sentiment.LOGISTIC | sentiment.FEATURES, "naive_bayes": sentiment.BAYES | sentiment.FEATURES}
    got = sentiment.search(rows, spaces, trials=12, at_once=4, categories=["kind"], amounts=["amount"], flags=["flag"]).collect()
    assert [r.model for r in got].count("logistic") == [r.model for r in got].count("naive_bayes") == 12
    assert all(len(r.scores) == 5 and r.objective == pytest.approx(np.mean(r.scores) - 0.5 * np.std(r.scores)) for r in got)
    assert [r.objective for r in got] == sorted((r.objective for r in got), reverse=True) and got[0].objective > 0.8
    assert all((r.C is None) == (r.model == "naive_bayes") and (r.var_smoothing is None) == (r.model == "logistic") for r in got)


def test_search_agrees_with_sparks_model(rows):
    """The score of one setting on one fold is that of Spark's own logistic regression over the library's own vectors."""
    prepared = search.prepare(rows, 5, words.VOCABULARY)
    blocks = search.blocks(rows, prepared)
    model = {"fold": 0, "max_features": words.VOCABULARY, "C": 1.0, "max_iter": 1000, "class_weight": None}
    cells = search._judged_logistic(blocks, prepared, [model], search.logistic_weights(blocks, prepared, [model], search.class_sizes(blocks, 5)))
    fitted = sentiment.train(rows.filter("fold <> 0"), {"C": 1.0})
    want = {(int(r.label), int(r.prediction)): r.n for r in sentiment.confusion(fitted.transform(rows.filter("fold = 0"))).collect()}
    assert sum(abs(cells[0, y, p] - want.get((y, p), 0)) for y in (0, 1) for p in (0, 1)) <= 2
    blocks.unpersist()


def _hard(prepared):
    return [{"fold": f, "max_features": s, "C": c, "max_iter": 1000, "class_weight": w} for f in range(5) for s, c, w in ((60, 10.0, None), (20, 3.0, "balanced"))]


def test_fits_take_few_passes(packed, monkeypatch):
    """Plain quasi-Newton steps take several times as many passes over the rows to the same gradient."""
    prepared, blocks = packed
    sizes, asked = search.class_sizes(blocks, 5), []
    summed = search.summed
    monkeypatch.setattr(search, "summed", lambda packed, work, length: asked.append(length) or summed(packed, work, length))
    search.logistic_weights(blocks, prepared, _hard(prepared), sizes)
    assert len(asked) <= 17


def test_a_shape_that_misleads_is_given_up(packed):
    """A shape decides how a fit gets to its minimum, not where that is, nor whether columns take part that the fold does not have."""
    prepared, blocks = packed
    sizes, models = search.class_sizes(blocks, 5), _hard(prepared)
    wrong = np.linalg.qr(np.random.default_rng(3).normal(size=(prepared.columns + 1, 4)))[0]
    misled = {s: search.Shape(wrong, np.array([50.0, 1e-3, 1e-9, 1e-9])) for s in (20, 60)}
    for m, a, b in zip(models, search.logistic_weights(blocks, prepared, models, sizes), search.logistic_weights(blocks, prepared, models, sizes, misled), strict=True):
        used = np.append(prepared.used(m["fold"], m["max_features"]), True)
        assert not a[~used].any() and not b[~used].any()
        assert np.linalg.norm(a - b) < 0.1 * np.linalg.norm(a)


def test_a_shape_is_that_of_the_features(packed, monkeypatch):
    """Over all rows and directions, it solves as the matrix of their products does."""
    prepared, blocks = packed
    some = search._some(blocks, 400.0)
    assert sum(len(b["label"]) for b in some) == 400
    picked = search._some(blocks, 400.0, 50)
    assert 50 <= sum(len(b["label"]) for b in picked) <= 50 + blocks.rdd.getNumPartitions()
    monkeypatch.setattr(search, "_FLAT", 0.0)
    shape = search.shape_of(some, prepared, 60, rank=10_000)
    weights = np.max([search._weights(prepared, f, 60) for f in range(5)], axis=0)[:, None]
    x = np.concatenate([np.concatenate([np.mean([search._narrow(b, prepared, f) for f in range(5)], axis=0),
                                        search._counts(b, prepared) * weights.T / search._all_lengths(search._counts(b, prepared), weights), np.ones((len(b["label"]), 1))], 1) for b in some])
    gradient = np.random.default_rng(1).normal(size=x.shape[1])
    assert np.allclose(shape.solved(gradient, 0.01), np.linalg.solve(0.25 * x.T @ x / 400 + 0.01 * np.eye(x.shape[1]), gradient), rtol=1e-6)


def test_moments_are_those_of_the_features(packed):
    prepared, blocks = packed
    found = search.class_moments(blocks, prepared, [(1, 60), (1, 20)])
    lines = [search._unpacked(r.asDict()) for r in blocks.collect()]
    for size in (60, 20):
        x, fold, label = (np.concatenate(v) for v in zip(*[(search.matrix(b, prepared, 1, size), b["fold"], b["label"]) for b in lines]))
        for c in (0, 1):
            part = x[(fold != 1) & (label == c)]
            assert np.allclose(found[1, size][c], [np.full(x.shape[1], len(part)), part.sum(0), (part * part).sum(0)])


def test_content_words_are_made_once(spark, tmp_path):
    """Not in a filter below the join with the labels as well, where they would be made of every text."""
    from vitrine.catalog import learning, roles

    numbered = spark.range(30).withColumnRenamed("id", "doc_id")
    numbered.select("doc_id", F.lit("Os clientes chegaram").alias("text"), F.lit("pt").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    numbered.filter("doc_id < 9").select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(20).selectExpr("id AS o_orderkey", "id AS o_custkey", "DATE '2020-01-01' AS o_orderdate", "'F' AS o_orderstatus", "10.0D AS o_totalprice", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20).selectExpr("id AS l_orderkey", "DATE '2020-02-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = learning._reviewed_orders(roles.Market(spark, str(tmp_path)))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("array_join") == 1
    assert rows.count() == 9

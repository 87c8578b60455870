"""Work that must not grow faster than the rows: no sort of all values, no pass twice, no task with a whole group."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.ml import language, search, sentiment, words
from vitrine.operators import neighbours, ordered


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_sort_no_values_and_send_spans_to_them(spark):
    """a list among the counts had all values sorted, and values were sent to one task a column."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    plan = _plan(ordered.exact_quantiles(df, ["v"], (0.25, 0.5)))
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "ObjectHashAggregate" not in plan


def test_neighbours_are_met_in_blocks(spark):
    """no row is made for a pair of query and donor; queries of all kinds of gaps get the nearest by plain search."""
    rng = np.random.default_rng(3)
    points = np.where(rng.random((200, 4)) < 0.2, np.nan, rng.integers(0, 6, (200, 4)) / 5.0)
    donors = np.unique(rng.integers(0, 6, (150, 4)) / 5.0, axis=0)
    copies = rng.integers(1, 4, len(donors))
    best = neighbours._met(points, np.full(200, np.inf), donors, copies, [0, 2], 3)
    got = {}
    for q, t, apart, value, n in zip(*best):
        got.setdefault((q, t), []).append((apart, value, -n))
    for q, p in enumerate(points):
        for t, at in enumerate([0, 2]):
            shared = ~np.isnan(p)
            if shared[at] or not shared.any():
                assert (q, t) not in got
                continue
            apart = np.round(np.sqrt(((p - donors)[:, shared] ** 2).sum(1) * 4 / shared.sum()), 12)
            want = sorted(zip(apart, donors[:, at], -copies))[:3]
            assert [(pytest.approx(a), v, n) for a, v, n in want] == got[q, t]


def test_terms_are_counted_once_and_in_tables_of_any_size(spark, monkeypatch):
    """the texts were read again for the number of documents."""
    monkeypatch.setattr(words, "_LINES", 3)
    texts = ["um dois um dois a", "dois três", "", "Über_x naïve 9 um", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, review_text string")
    got = {r["term"]: (r["use"], r["doc"]) for r in words.tallied(df).groupBy("term").agg(F.sum("use").alias("use"), F.sum("doc").alias("doc")).collect()}
    listed = [r["t"] for r in df.filter("review_text IS NOT NULL").select(words.terms("review_text").alias("t")).collect()]
    want = {t: (sum(x.count(t) for x in listed), sum(t in x for x in listed)) for x in listed for t in x}
    assert got == want | {None: (0, 4)}
    learnt = words.vocabulary(df, min_docs=1, max_share=1.0)
    assert "MapInArrow" not in _plan(learnt)  # the counts were written once
    assert {r["term"]: r["idf"] for r in learnt.collect()}["um"] == pytest.approx(math.log(5 / 3) + 1)


def _term_counts(rows):
    want = {}
    for doc, text in rows:
        w = [x for x in (text or "").split() if len(x) > 1]
        for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
            want[doc, t] = want.get((doc, t), 0) + 1
    return want


@pytest.mark.parametrize("lines", [2, 200_000])
def test_terms_of_single_rows_are_counted_without_meeting(spark, monkeypatch, lines):
    """m05: every line of document and term was held in a table of the task and shuffled."""
    monkeypatch.setattr(words, "_LINES", lines)
    rows = [(1, "um dois um dois a"), (2, "dois três"), (3, ""), (4, None), (5, "a"), (None, "um um")]
    got = words.term_counts(spark.createDataFrame(rows, "id int, review_text string"), "id")
    assert "Exchange" not in _plan(got) and "Aggregate" not in _plan(got)
    assert {(r["id"], r["term"]): r["tf"] for r in got.collect()} == _term_counts(rows)
    assert got.dtypes == [("id", "int"), ("term", "string"), ("tf", "bigint")]


def test_terms_of_documents_with_several_rows_are_added_up(spark):
    rows = [("x", "um dois"), ("y", "um"), ("x", "dois um dois"), (None, "um"), (None, "um dois"), ("z", None), ("z", ""), ("w", None), ("v", "três um"), ("v", "três um")]
    got = words.term_counts(spark.createDataFrame(rows, "id string, review_text string"), "id").collect()
    assert {(r["id"], r["term"]): r["tf"] for r in got} == _term_counts(rows) and len(got) == len(_term_counts(rows))
    none = words.term_counts(spark.createDataFrame([], "id string, review_text string"), "id")
    assert none.collect() == []


def _plain_vocabulary(texts, min_docs, max_share, size):
    listed = [[t for t in _term_counts([(0, x)]) for _ in range(_term_counts([(0, x)])[t])] for x in texts if x is not None]
    use, docs = {}, {}
    for terms in listed:
        for _, t in terms:
            use[t] = use.get(t, 0) + 1
        for _, t in set(terms):
            docs[t] = docs.get(t, 0) + 1
    kept = sorted((t for t in use if min_docs <= docs[t] <= max_share * len(listed)), key=lambda t: (-use[t], t))[:size]
    return [(t, docs[t], use[t], pytest.approx(math.log((1 + len(listed)) / (1 + docs[t])) + 1)) for t in kept]


@pytest.mark.parametrize("known", [0, 8])
def test_a_vocabulary_is_that_of_all_terms(spark, monkeypatch, known):
    """m06: ties, words over the share bound, too few words for the size, NULL and empty texts, no text at all; with and without chosen pairs."""
    monkeypatch.setattr(words, "_KNOWN", known)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, 30) if x < 40) for _ in range(60)] + [None, "", "w1 w1 w1 w1", "a", "um dois", "um dois"]
    df = spark.createDataFrame([(t,) for t in texts], "review_text string").repartition(3)
    for bounds in ({"min_docs": 3, "max_share": 0.8, "size": 12}, {"min_docs": 1, "max_share": 0.3, "size": 5}, {"min_docs": 2, "max_share": 1.0, "size": 500}, {"min_docs": 2, "max_share": 1.0, "size": 1}):
        assert [tuple(r) for r in words.vocabulary(df, **bounds).collect()] == _plain_vocabulary(texts, **bounds)
    assert words.vocabulary(df.filter("false")).collect() == []
    assert words.vocabulary(df.filter("review_text IS NULL")).collect() == []


def test_pairs_that_no_vocabulary_can_hold_are_not_counted(spark, monkeypatch):
    """m06: every pair of neighbours was counted, sent to the JVM, held there and shuffled."""
    met, plain = [], words.tallied

    def seen(*args, **kwargs):
        out = plain(*args, **kwargs)
        met.extend(r["term"] for r in out.collect())
        return out

    monkeypatch.setattr(words, "tallied", seen)
    df = spark.createDataFrame([(f"um dois raro{i} um dois",) for i in range(5)], "review_text string")
    assert [r["term"] for r in words.vocabulary(df, min_docs=2, max_share=1.0).collect()] == ["dois", "um", "um dois"]
    assert {t for t in met if t} == {"um", "dois", "um dois", *[f"raro{i}" for i in range(5)]}


def test_a_split_reads_its_rows_once(spark):
    """F8, F11, F13, F15, F16: the rows of a split were computed anew for its sample, its places and its totals."""
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            seen.add(1)
            yield r

    rows = spark.createDataFrame(spark.range(100).rdd.mapPartitions(counted).map(lambda r: (r[0], float(r[0] % 2))), "id long, label double")
    marked = sentiment.split(rows, "id")
    assert seen.value == 100
    assert marked.filter("is_test").count() == 20


def test_trigrams_in_tasks_are_those_of_the_expression(spark, monkeypatch):
    """trigrams were made by an expression, one by one, and all texts read twice."""
    texts = ["Olá, mundo! 123", "", None, "a", "é" * 5, "𝒳y z", "abc abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select("id", language._letters(F.col("text")).alias("l"), language.trigrams(F.col("text")).alias("g")).orderBy("id").collect()
    want = [(r["id"], zlib.crc32(g.encode()) % 64) for r in rows for g in r["g"] or []]
    for table in (language._TABLE, 8):
        monkeypatch.setattr(language, "_TABLE", table)
        owner, bucket = language.hashed([r["l"] for r in rows], 64)
        assert list(zip(owner.tolist(), bucket.tolist())) == want


def test_one_matrix_of_counts_serves_all_folds():
    """a dense matrix was built for every fold and vocabulary size in each pass."""
    r = np.random.default_rng(1)
    p = search.Prepared([("c", "x"), ("c", "y")], ["a"], ["f"], [f"t{i}" for i in range(40)], np.array([[0, 1], [0, 1], [0, 0]], bool), r.random((3, 1)), 1 + r.random((3, 1)),
                        np.stack([r.permutation(40) for _ in range(3)]), 1 + r.random((3, 40)), 3)
    lens = r.integers(0, 9, 60)
    at = np.concatenate([np.sort(r.choice(40, k, False)) for k in lens]).astype(np.int32)
    block = {"fold": r.integers(0, 3, 60).astype(np.int32), "label": r.integers(0, 2, 60).astype(float), "narrow": r.random((60, 4)).ravel(), "ends": np.cumsum([0, *lens]),
             "at": at, "count": r.integers(1, 4, len(at)).astype(float)}
    for f in range(3):
        whole = search.matrix(block, p, f, 20)
        parts = [search._narrow(block, p, f), search._counts(block, p) * search._weights(p, f, 20) / search._lengths(block, p, f, 20)[:, None]]
        assert np.allclose(whole, np.concatenate(parts, 1))
        assert np.allclose(search.matrix(search._of_fold(block, f), p, f, 20), whole[block["fold"] == f])


def _dealt(donors, leaves):
    """A tree over donors with its boxes, the leaves that hold any, and their donors."""
    tree = neighbours.split(donors, leaves)
    leaf, shape = tree.leaf_of(donors), (tree.leaves, donors.shape[1])
    tree.low, tree.high, tree.gone = np.full(shape, np.nan), np.full(shape, np.nan), np.zeros(shape, bool)
    tree.rows = np.bincount(leaf, minlength=tree.leaves)
    for x in np.flatnonzero(tree.rows):
        here = donors[leaf == x]
        tree.low[x], tree.high[x], tree.gone[x] = here.min(0), here.max(0), np.isnan(here).all(0)
    filled = np.flatnonzero(tree.rows)
    return tree, filled, [donors[leaf == x] for x in filled]


def test_leaves_do_not_mix_donors_with_and_without_a_coordinate():
    rng = np.random.default_rng(8)
    donors = rng.random((4000, 4))
    donors[::7, 1:3], donors[::11, 3] = np.nan, np.nan
    tree, _, each = _dealt(donors, 64)
    assert tree.leaves == 64 and all((np.isnan(d).any(0) == np.isnan(d).all(0)).all() for d in each)
    assert tree.bounds(np.array([[0.5, np.nan, np.nan, np.nan]]), targets=[1])[0][tree.gone[:, 1]].min() == np.inf


@pytest.mark.parametrize("known", [False, True])
def test_queries_meet_few_donors_and_miss_none(monkeypatch, known):
    """Blocks of queries met every leaf that one of them could need, a first chunk in whole."""
    rng = np.random.default_rng(9)
    donors = rng.random((6000, 4)).round(2)
    donors[::7, 1:3], donors[::11, 3] = np.nan, np.nan
    donors = donors[~np.isnan(donors).all(1)]
    points = rng.random((500, 4)).round(2)
    points[:, 3] = np.nan
    points[::3, 1] = np.nan
    points[7] = np.nan
    tree, leaves, each = _dealt(donors, 128)
    ones, k, at = np.ones(len(donors), np.int64), 3, [1, 3]
    want = neighbours._first(neighbours._met(points, np.full(500, np.inf), donors, ones, at, k), k)[0]
    reach = np.full(500, np.inf)
    if known:
        reach[:] = 0.0
        np.maximum.at(reach, want[0], want[2])
    met, pairs = neighbours._met, []
    monkeypatch.setattr(neighbours, "_met", lambda p, r, d, *rest: pairs.append(len(p) * len(d)) or met(p, r, d, *rest))
    got = neighbours._led(points, reach, tree, leaves, each, [np.ones(len(d), np.int64) for d in each], at, k)
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))
    assert sum(pairs) < 0.25 * 500 * len(donors)


def test_slices_are_as_many_as_visitors_need(spark, monkeypatch):
    """Donors were copied for every slice of all queries, also where few queries came."""
    rng = np.random.default_rng(10)
    values = [(i, float(x), None if i % 5 == 0 else float(y)) for i, (x, y) in enumerate(rng.random((400, 2)).round(2))]
    df = spark.createDataFrame(values, "id int, a double, t double").withColumn("_query", F.col("id").cast("string"))
    monkeypatch.setattr(neighbours, "PART_ROWS", 20)
    monkeypatch.setattr(neighbours, "SLICE_ROWS", 10)
    donors = df.filter("t IS NOT NULL").groupBy("a", "t").agg(F.count(F.lit(1)).alias("_copies")).cache()
    copies, repartition = [], type(df).repartition

    def counted(self, *how):
        if "_slice" in self.columns and "_copies" in self.columns:
            copies.append(self.count())
        return repartition(self, *how)

    monkeypatch.setattr(type(df), "repartition", counted)
    got = neighbours.nearest(df.filter("t IS NULL"), donors, ["a", "t"], ["t"], 2, 10).groupBy("_asked").agg(F.min(F.struct("distance", "value")).alias("b")).collect()
    assert copies[0] <= 2 * donors.count()  # eighty queries are eight slices
    held = [(r["a"], r["t"]) for r in donors.collect()]
    for r in got:
        x = values[int(r["_asked"])][1]
        assert (r["b"]["distance"], r["b"]["value"]) == pytest.approx(min((round(abs(x - a) * math.sqrt(2), 12), t) for a, t in held), abs=1e-9)
    assert len(got) == 80

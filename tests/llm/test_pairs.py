"""The n-gram join against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from vitrine.llm import near_vectors, ngram_join
from vitrine.llm.grouping import components
from vitrine.llm.queries import queries

SF2 = "/root/testdata/sf0.01"


def sets_of(texts, words=5):
    out = []
    for t in texts:
        w = (t or "").split()
        k = min(words, len(w))
        out.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    return out


def brute(keys, sets, least=0.8):
    """key -> (links, smallest key of the class), from all pairs."""
    n, parent = len(keys), list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i in range(n):
        for j in {j for x in sets[i] for j in where[x] if j > i}:
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least_of = {}
    for i in range(n):
        least_of[find(i)] = min(least_of.get(find(i), keys[i]), keys[i])
    return {keys[i]: (links[i], least_of[find(i)]) for i in range(n)}


def check(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_links, r.class_id) == want[r.doc_id] and r.kept == (r.doc_id == r.class_id)


def test_join_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text").collect()
    check(queries()["op7_ngram_join"](spark, SF2).collect(), brute([d.doc_id for d in docs], sets_of([d.text for d in docs])))


def test_join_of_a_large_group_and_odd_texts(spark, make_docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    base = [rng.choice(words) for _ in range(90)]
    texts = list(ODD)
    for _ in range(150):  # near copies of one text, some nearer than others
        copy = base[:]
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(90)] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 40 + [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)] + ["a b c", "a b c", "a b"]
    docs = make_docs(texts).withColumns({"root": F.lit("clash"), "block": F.lit(1)})
    rows = ngram_join.similar_documents(docs, block=16).collect()
    check(rows, brute(list(range(len(texts))), sets_of(texts)))
    assert ngram_join.similar_documents(docs.limit(0)).count() == 0


def test_join_with_null_and_repeated_keys(spark, make_docs):
    rows = ngram_join.similar_documents(make_docs([(None, "same words here"), (7, "same words here"), (7, "same words here"), (None, "other words"), (None, None)])).collect()
    found = sorted((r.doc_id or -1, r.n_links, r.class_id or -1) for r in rows)
    assert found == [(-1, 0, -1), (-1, 0, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7)]


def test_prefixes_are_as_long_as_the_recall_allows():
    length = ngram_join.prefix_length()
    chance = lambda k: 1 - (1 - 0.8 ** k) ** ngram_join.TREES
    assert chance(length) >= ngram_join.RECALL > chance(length + 1)
    with pytest.raises(ValueError):
        ngram_join.prefix_length(0.1, 2)


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    factors, shifts = ngram_join._permutations(512)
    common, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (600, 200, 200))
    x, y = (ngram_join.signature(np.concatenate([common, own]), factors, shifts) for own in (a, b))
    assert abs((x == y).mean() - 0.6) < 0.08


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{200 + i: 200 for i in range(7)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, least=0.93):
    """key -> (links, smallest key reached) for rows (key, vector, label) with distinct keys."""
    def unit(v):
        if v is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            return None
        x = np.array(v, float)
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v, _ in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2]
            if same and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, (k, _, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), k), k)
    return {k: (links[i], first[find(i)]) for i, (k, _, _) in enumerate(rows)}


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def check_vectors(found, want):
    assert len(found) == len(want)
    for r in found:
        assert (r.n_links, r.component_id) == want[r.vec_id] and r.kept == (r.vec_id == r.component_id), r


def test_vectors_with_groups_of_any_size(spark):
    rng = np.random.default_rng(8)
    vectors, centre = [], rng.normal(size=(4, 24))
    for size, c in zip((60, 12, 3, 2), centre, strict=True):
        vectors += [c + rng.normal(size=24) * 0.22 for _ in range(size)]
    vectors += list(rng.normal(size=(150, 24)))
    rows = [(int(k), [float(np.float32(x)) for x in v], int(k % 7 == 0)) for k, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    found = near_vectors.near_duplicates(vector_frame(spark, rows).withColumns({"node": F.lit("clash"), "root": F.lit(3)})).collect()
    check_vectors(found, brute_vectors(rows))


def test_vectors_of_the_given_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check_vectors(queries()["op2_embedding_dedup"](spark, "/root/testdata/sf0.001").collect(), brute_vectors(rows))


def test_odd_vectors(spark):
    one = [1.0, 0.0, 0.5]
    rows = [
        (1, one, 1), (2, one, 1), (3, [2.0, 0.0, 1.0], 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1),
        (9, [1.0, None, 0.5], 1), (10, [float("nan"), 0.0, 1.0], 1), (11, [float("inf"), 0.0, 1.0], 1), (12, [1.0, 0.0], 1), (13, [3e38, 0.0, 1.5e38], 1),
        (14, [1e-38, 0.0, 5e-39], 1),
    ]
    check_vectors(near_vectors.near_duplicates(vector_frame(spark, rows)).collect(), brute_vectors(rows))
    twice = near_vectors.near_duplicates(vector_frame(spark, [(1, one, 1), (1, one, 1), (None, one, 1), (None, None, None)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in twice) == [(0, 0, 0), (0, 0, 0), (1, 1, 1), (1, 1, 1)]
    assert near_vectors.near_duplicates(vector_frame(spark, [])).count() == 0


def test_rounds_find_neighbours_of_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=30) + rng.normal(size=(40, 30)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, bytes(v.tobytes())) for i, v in enumerate(x)], "node long, v binary")
    ring = spark.createDataFrame([(i, (i + 1) % 40, float(x[i] @ x[(i + 1) % 40]), True) for i in range(40)], "a long, b long, near double, fresh boolean")
    now = near_vectors.lists(ring, 6)
    for _ in range(6):
        now = near_vectors.lists(now.withColumn("fresh", F.lit(False)).unionAll(near_vectors.descend(now, nodes, 3, 6, 0.0).withColumn("fresh", F.lit(True))), 6)
    alike = x @ x.T
    np.fill_diagonal(alike, -1)
    best = {(i, int(j)) for i in range(40) for j in np.argsort(-alike[i])[:6]}
    assert len(best & {(r.a, r.b) for r in now.collect()}) / len(best) > 0.9


def test_audit_counts_found_and_lists_missing(spark):
    x = np.eye(3)[[0, 0, 1]] + 1e-3 * np.arange(9).reshape(3, 3)
    nodes = spark.createDataFrame([(i, "k", bytes((v / np.linalg.norm(v)).tobytes())) for i, v in enumerate(x)], "node long, kin string, v binary")
    linked = spark.createDataFrame([(0, 0), (1, 0)], "node long, root long")
    for roots, want in ((linked, (2, 0)), (linked.limit(0), (0, 2))):
        assert near_vectors.audit(nodes, roots, 3, 0.9).agg(F.sum("found"), F.count("a")).first() == want


@pytest.fixture
def without_audit(monkeypatch):
    """What the search finds by itself: the audit picks nobody."""
    real = near_vectors.audit
    monkeypatch.setattr(near_vectors, "audit", lambda *args, **more: real(*args, most=0, **more))


def test_clumps_that_fill_their_lists_are_joined(spark, without_audit):
    rng = np.random.default_rng(11)
    vectors = list(rng.normal(size=(300, 64)))
    for _ in range(6):  # two clumps of 20, closer inside than across
        one, away = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        for centre in (one, np.cos(0.33) * one + np.sin(0.33) * away):
            vectors += [centre + rng.normal(size=64) * 0.006 for _ in range(20)]
    rows = [(int(k), [float(np.float32(x)) for x in v], 1) for k, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    check_vectors(near_vectors.near_duplicates(vector_frame(spark, rows)).collect(), brute_vectors(rows))


def test_isolated_pairs_of_a_larger_table_are_found(spark, without_audit):
    rng = np.random.default_rng(12)
    one, other = rng.normal(size=(2, 10_000, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (one * other).sum(1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    pairs = spark.createDataFrame(pa.table({
        "vec_id": np.arange(20_000), "embedding": list(np.concatenate([one, 0.931 * one + math.sqrt(1 - 0.931 ** 2) * other])), "label": np.ones(20_000, np.int32)}))
    found = near_vectors.near_duplicates(pairs).filter("n_links = 1 and component_id = pmod(vec_id, 10000)").count()
    assert found >= 0.998 * 20_000


def test_a_crowd_does_not_hide_lost_pairs(spark):
    x = np.concatenate([np.ones((300, 1)) * np.eye(8)[0] + 1e-3 * np.random.default_rng(2).random((300, 8)), np.eye(8)[[1, 1, 2, 2]] + 1e-3 * np.arange(32).reshape(4, 8)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, "k", bytes(v.tobytes())) for i, v in enumerate(x)], "node long, kin string, v binary")
    roots = spark.createDataFrame([(i, 0) for i in range(300)] + [(300, 300), (301, 300)], "node long, root long")
    seen = near_vectors.audit(nodes, roots, 304, 0.93)
    assert seen.agg(F.sum("found"), F.count("a")).first() == (300 * 299 + 2, 2)
    assert near_vectors.recall_of(seen) == 0.5

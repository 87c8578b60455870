"""Merkle manifest and importance resampling, against plain versions and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import compare, duck
from tests.llm.conftest import DOCS, ODD
from vitrine.llm import merkle, resampling
from vitrine.llm.queries import oracles, queries

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("folder", [SF, SF2])
@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_importance_resampling"])
def test_same_rows_as_sql(spark, folder, name):
    assert compare(queries()[name](spark, folder), duck(folder), oracles()[name]) == ""


# ---------------------------------------------------------------- manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    framed = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)]
    return sha(*framed)


def plain_tree(nodes, fan_out=8):
    """The root of a list of digests, and for each its siblings from below, as (before, after)."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fan_out, len(nodes))) for i in range(0, len(nodes), fan_out)]
        for run in runs:
            for i in run:
                for leaf in under[i]:
                    paths[leaf].append(("".join(nodes[k] for k in run if k < i), "".join(nodes[k] for k in run if k > i)))
        nodes, under = [sha(*[nodes[i] for i in run]) for run in runs], [[leaf for i in run for leaf in under[i]] for run in runs]
    return (nodes or [None])[0], paths


def plain_proofs(rows):
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = defaultdict(list)
    for r in rows:
        hit = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 0
        leaf = plain_leaf(r, r.text)
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf, plain_leaf(r, lower(r.text)) if hit else leaf, r.doc_id))
    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in ordered}
    root, upper = plain_tree([trees[g][0] for g in ordered])
    out = []
    for g, above in zip(ordered, upper, strict=True):
        for (_, _, leaf, changed, doc_id), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            node = changed
            for before, after in path + above:
                node = sha(before, node, after)
            out.append((doc_id, leaf, trees[g][0], root, sha(*[b + a for b, a in path + above]), node, node == root))
    return Counter(out)


def proofs_of(docs):
    return Counter(tuple(r) for r in merkle.document_proofs(docs).collect())


def test_proofs_of_odd_documents(spark, make_docs):
    texts = [(i % 40 if i % 7 else None, t) for i, t in enumerate(ODD * 6)] + [(3, "Again"), (3, "Again"), (5, "ABC"), (5, "abc")]
    docs = make_docs(texts)
    docs = docs.withColumn("lang", F.expr("CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' WHEN doc_id = 2 THEN 'ü' WHEN doc_id % 2 = 0 THEN 'z' ELSE 'en' END"))
    docs = docs.withColumns({"n_chars": F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")), "leaf": F.lit(1), "_at": F.lit(2), "root": F.lit("x"), "path": F.lit(0)}).cache()
    assert proofs_of(docs) == plain_proofs(docs.collect())


@pytest.mark.parametrize("size", [0, 1, 2, 7, 8, 9, 64, 65, 73, 513])
def test_proofs_by_size(spark, size):
    rows = [(i, f"Text {i}", "en" if i else "de", None, i) for i in range(size)]
    docs = spark.createDataFrame(rows, DOCS)
    assert proofs_of(docs) == plain_proofs(docs.collect())


def test_many_groups_and_another_fan_out(spark):
    rows = spark.range(700).select(F.sha2(F.col("id").cast("string"), 256).alias("leaf"), (F.col("id") % 90).cast("string").alias("part"), "id")
    manifest = merkle.build(rows, "leaf", [F.col("id").asc()], "part", fan_out=3)
    found = merkle.prove(manifest).withColumn("back", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert len(found) == 700 and all(r.back == r.root for r in found)
    parts = sorted({str(i % 90) for i in range(700)})
    tops = [plain_tree([sha(str(i)) for i in range(700) if str(i % 90) == p], 3)[0] for p in parts]
    assert {r.root for r in found} == {plain_tree(tops, 3)[0]} == {manifest.root().first()[0]}


def test_single_requests_and_the_store(spark):
    rows = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.when(F.col("id") > 0, "a").alias("part"), "id")
    manifest = merkle.build(rows, "leaf", [F.col("id").asc()], "part")
    whole = {r.id: r for r in merkle.prove(manifest).collect()}
    asked = manifest.groups.leaves.filter("id IN (0, 1, 500, 999)")
    some = merkle.prove(manifest, asked.unionByName(asked.filter("id = 500"))).collect()
    assert sorted(r.id for r in some) == [0, 1, 500, 500, 999] and all(r == whole[r.id] for r in some)
    store = {r.digest: r.children for r in manifest.records().collect()}
    assert all(sha(*children) == digest for digest, children in store.items())
    todo, leaves = [manifest.root().first()[0]], set()
    while todo:
        node = todo.pop()
        todo += store.get(node, [])
        leaves |= {node} - set(store)
    assert leaves == {sha(str(i)) for i in range(1000)}


def test_equal_leaves_share_records(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(sha("x"))).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"), F.lit("a").alias("part"), "id")
    manifest = merkle.build(rows, "leaf", [F.col("leaf").asc()], "part")
    found = merkle.prove(manifest).withColumn("back", merkle.folded(F.col("leaf"), F.col("path")))
    assert found.count() == 3000 and found.filter("back = root").count() == 3000


def test_names_of_the_operator_are_refused(spark):
    with pytest.raises(ValueError, match="clash"):
        merkle.build(spark.range(1).select(F.lit("x").alias("leaf"), F.lit("a").alias("part"), F.col("id").alias("_at")), "leaf", [F.col("leaf")], "part")


# ---------------------------------------------------------------- resampling

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_grams(text, longest):
    w = plain_words(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resampled(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    code = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(code(g) for r in rows for g in plain_grams(r.text, longest))
    t = Counter(code(g) for x in target for g in plain_grams(x, longest))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for r in rows:
        grams = plain_grams(r.text, longest)
        weight = sum(gain(code(g)) for g in grams)
        h = int(sha(f"2024:{'' if r.doc_id is None else r.doc_id}")[:8], 16)
        out.append([r.doc_id, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(r.text))])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    place = {id(x): i for i, x in enumerate(fit[: len(fit) * percent // 100], 1)}
    return Counter((*x[:4], place.get(id(x))) for x in out)


def drawn_rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 101, 50), (2, 7, 100)])
def test_resampling_of_odd_documents(spark, make_docs, longest, buckets, percent):
    rng = random.Random(3)
    made = [(i, " ".join(rng.choice(["Tea", "cup", "ÄÖ", "x9", "rare%d" % i]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    docs = make_docs([(1000 + i, t) for i, t in enumerate(ODD)] + made + [(7, "same " * 30)] * 3 + [(None, "no id " * 15)])
    docs = docs.withColumns({"rank": F.lit(1), "weight": F.lit("w"), "_words": F.lit(0)}).cache()
    target = spark.createDataFrame([("tea cup tea",), (None,), ("",)], "text string")
    got = resampling.resampled(docs, target, longest=longest, buckets=buckets, percent=percent)
    assert drawn_rows(got) == plain_resampled(docs.collect(), ["tea cup tea"], longest, buckets, percent=percent)


def test_empty_tables(spark, make_docs):
    docs, none = make_docs(["one two three " * 10]), spark.createDataFrame([], "text string")
    assert resampling.resampled(docs.limit(0), none).count() == 0
    assert drawn_rows(resampling.resampled(docs, none)) == plain_resampled(docs.collect(), [])


@pytest.mark.parametrize(("spread", "finish"), [(3, 0), (100_000, 16)])
def test_cutoff_is_exact(spark, spread, finish):
    rng = random.Random(spread)
    keys = [(rng.randint(-spread, spread), rng.randint(0, 500)) for _ in range(3000)]
    # one partition holds half of all keys, some none
    df = spark.createDataFrame(keys, "score long, id long").withColumn("p", F.when(F.col("id") < 250, 0).otherwise(F.col("id"))).repartition(12, "p").select("score", "id").cache()
    best = sorted(keys, key=lambda k: (-k[0], k[1]))
    for take in (1, 299, 3000):
        assert resampling.cutoff(df, take, finish) == best[take - 1]
    assert resampling.cutoff(df, 3001, finish) is None and resampling.cutoff(df, 0, finish) is None


def test_each_round_discards_a_quarter(spark, monkeypatch):
    keys = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("score"), "id").repartition(16).cache()
    sizes, once = [], resampling._round

    def watched(*args):
        lines = once(*args)
        sizes.append([sum(r[n] for r in lines) for n in ("over_n", "under_n", "same_n")])
        return lines

    monkeypatch.setattr(resampling, "_round", watched)
    resampling.cutoff(keys, 2000, 0)
    assert len(sizes) > 3
    for over, under, same in sizes[1:]:
        assert max(over, under) <= 0.75 * (over + under + same) + 16


def test_sql_reads_only_its_tables():
    assert set(duckdb.get_table_names(oracles()["op11_merkle_manifest"])) == {"documents"}
    assert set(duckdb.get_table_names(oracles()["op12_importance_resampling"])) == {"documents", "benchmark"}

"""Quality rules, language identification and sharding."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from vitrine.llm import langid, quality_rules, sharding
from vitrine.llm.queries import queries

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    repeated = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def check_base(rows, texts):
    for r in rows:
        n, *rest = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest), r.doc_id
        assert r.base_failed == (n < 10 or 100 * rest[-1] > 20 * n)
        assert not (r.base_failed and r.kept)


def test_rules_over_the_given_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    rows = queries()["op1_quality_rules"](spark, SF2).collect()
    assert len(rows) == len(texts)
    check_base(rows, texts)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    judged = [(r.kept, quality[r.doc_id]) for r in rows if not r.base_failed and r.doc_id in quality and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([k == (q == 1) for k, q in judged]) > 0.95


def test_rules_on_odd_texts(spark, make_docs):
    texts = ODD + ["one two three four five six seven eight nine ten"] + ["a b c d e x a b c d e y\nq r s t\nq r s t\n \nz " * 2]
    docs = make_docs(texts).withColumn("kept", F.lit(5))
    labels = spark.createDataFrame([(0, None, 0), (None, 1, 0), (15, 1, 0), (15, 0, 0)], "doc_id long, quality int, toxic int")
    judged, rules = quality_rules.apply_rules(docs, labels)
    check_base(judged.collect(), dict(enumerate(texts)))
    assert len(rules) == 1 and rules[0].keep
    assert quality_rules.apply_rules(docs.limit(0), labels)[0].count() == 0


def test_covering_finds_a_planted_list():
    rng = np.random.default_rng(1)
    values = rng.random((3000, 3))
    bad = (values[:, 0] > 0.8) | (values[:, 1] <= 0.1) & (values[:, 2] > 0.5)
    rules = quality_rules.learn_rules(values, bad, ["words", "word_length", "upper_share"])
    left, said = np.ones(3000, bool), np.zeros(3000, bool)
    for rule in rules[:-1]:
        hit = left & quality_rules._met(values, [(["words", "word_length", "upper_share"].index(f), s, t) for f, s, t in rule.conditions])
        said |= hit
        left &= ~hit
    assert (said == bad).mean() > 0.99 and len(rules) <= 6


def test_verdict_is_the_first_rule_met(spark):
    rules = [quality_rules.Rule((("words", ">", 5.0),), False, 0, 0), quality_rules.Rule((("words", ">", 2.0),), True, 0, 0), quality_rules.Rule((), False, 0, 0)]
    rows = spark.createDataFrame([(1,), (3,), (9,)], "n_words long").select("n_words", quality_rules.verdict(rules).alias("v")).collect()
    assert {r.n_words: r.v for r in rows} == {1: False, 3: True, 9: False}


def test_language_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    rows = queries()["op4_language_id"](spark, SF2).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.95


def test_language_of_odd_texts(spark, make_docs):
    docs = make_docs(ODD).withColumn("score", F.lit("clash"))
    model = langid.fit(["the cat and the dog", "a cat with the hat"] * 3 + ["le chat et le chien", "un chat avec le roi"] * 3, ["en"] * 6 + ["fr"] * 6)
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, text in enumerate(ODD):
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in text or "")), text
    assert rows[12].lang_pred == rows[13].lang_pred == "en"
    nothing = langid.fit_documents(make_docs(["some text"], lang=None))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_far_texts_are_not_accepted():
    model = langid.fit(["the cat and the dog sat on the mat", "a cat with the hat and the rat"] * 4, ["en"] * 8)
    names, _, accepted = model.predict(["the cat and the rat", "zqx kvj wwz qqk"])
    assert names == ["en", "en"] and accepted.tolist() == [True, False]


def test_long_texts_count_all_their_grams():
    from vitrine.llm import features

    text = "abc déf " * 400
    whole = features.count_grams([text], (1, 2, 3), 10)
    at, features._AT_ONCE = features._AT_ONCE, 100
    try:
        assert np.array_equal(whole, features.count_grams([text], (1, 2, 3), 10))
    finally:
        features._AT_ONCE = at
    assert whole.sum() == 3 * len(text) - 3


@pytest.fixture(scope="module")
def shards(spark):
    return queries()["op8_sharding"](spark, SF2).collect()


def test_shards_of_the_given_table(spark, shards):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    assert len(shards) == len(texts)
    slots = defaultdict(list)
    for r in shards:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert min(map(len, slots.values())) > 0.7 * 125
    assert 0.06 < np.mean([r.grown_shard == 8 for r in shards]) < 0.17


def plain_descent(key, tree, path=""):
    """Region, rack and shard of a key, one level after the other."""
    weight = lambda n: sum(map(weight, n.values())) if isinstance(n, dict) else n
    while isinstance(tree, dict):
        draws = []
        for name, child in tree.items():
            if weight(child) > 0:
                first = xxhash.xxh64_intdigest(key.encode(), 42)
                u = ((xxhash.xxh64_intdigest(f"{path}/{name}".encode(), first) >> 11) + 0.5) / 2**53
                draws.append((-math.log(u) / weight(child), name))
        best = min(d for d, _ in draws)
        name = next(n for d, n in draws if d == best)
        tree, path = tree[name], f"{path}/{name}"
    return name


OLD = {"r0": {"a": {0: 1.0, 1: 1.0}, "b": {2: 2.0}}, "r1": {"c": {3: 1.0, 4: 3.0}, "d": {5: 4.0, 6: 0.0}}, "r2": {"e": {7: 1.0}}}


def test_every_level_decides_as_in_a_plain_descent(spark):
    keys = spark.range(3000)
    for tree in (OLD, sharding.even_tree(8), sharding.even_tree(9), sharding.even_tree(1)):
        got = keys.select("id", sharding.shard_of(F.col("id"), tree).alias("s")).collect()
        assert all(r.s == plain_descent(str(r.id), tree) for r in got)
    # a flat choice among the leaves would differ
    flat = {s: w for racks in OLD.values() for rack in racks.values() for s, w in rack.items()}
    assert any(plain_descent(str(i), OLD) != plain_descent(str(i), flat) for i in range(100))


def test_shards_get_their_share(spark):
    count = Counter(r.s for r in spark.range(26000).select(sharding.shard_of(F.col("id"), OLD).alias("s")).collect())
    assert all(abs(count[s] / 26000 - w / 13) < 0.02 for s, w in {0: 1, 1: 1, 2: 2, 3: 1, 4: 3, 5: 4, 6: 0, 7: 1}.items())


WHERE = {s: (region, rack) for region, racks in OLD.items() for rack, shards in racks.items() for s in shards}


@pytest.mark.parametrize(("region", "rack", "shard", "weight"), [("r1", "c", 4, 6.0), ("r1", "d", 6, 2.0), ("r0", "b", 2, 5.0), ("r0", "a", 1, 0.25), ("r2", "e", 7, 0.0)])
def test_movement_stays_in_changed_subtrees(spark, region, rack, shard, weight):
    """On each level keys move only to the node that grew, or only from the one that shrank; nothing moves between untouched nodes."""
    new = {**OLD, region: {**OLD[region], rack: {**OLD[region][rack], shard: weight}}}
    grows = weight > OLD[region][rack][shard]
    rows = spark.range(15000).select(sharding.shard_of(F.col("id"), OLD).alias("a"), sharding.shard_of(F.col("id"), new).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved
    for a, b in moved:
        here, there = (b, a) if grows else (a, b)
        assert WHERE[here][0] == region
        if WHERE[there][0] == region:
            assert WHERE[here][1] == rack
            if WHERE[there][1] == rack:
                assert here == shard


def test_shards_of_odd_rows(spark, make_docs):
    docs = make_docs([(None, "a"), (None, None), (3, ""), (3, ""), (4, "x")])
    docs = docs.withColumns({c: F.lit(f"clash {c}") for c in ("shard", "_at", "_shard", "_part", "_row", "_before", "at", "part", "row", "known", "order", "before", "n")})
    out = sharding.place(docs, sharding.even_tree(2), parts=4)
    rows, slots = out.collect(), defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r["_at"] == "clash _at" and r["at"] == "clash at" and r["row"] == "clash row"
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["shard", "grown_shard", "slot"]
    assert len(rows) == 5 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.place(docs.limit(0), sharding.even_tree(2)).count() == 0


def test_rows_of_one_key_are_spread(spark):
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").alias("size"))
    out = sharding.place(docs, sharding.even_tree(8))
    assert [r.slot for r in out.orderBy("slot").collect()] == list(range(4000)) and out.select("shard").distinct().count() == 1
    parts = docs.select(F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id"), "doc_id", "size"), F.lit(sharding.PARTS)).alias("p")).distinct().count()
    assert parts > 1000


def test_a_small_sample_gives_the_verdicts_of_all_rows(spark):
    """One in seven is poor; of the rows of 100 words four fifths are, too few to reject them, but over nine tenths in a balanced sample."""
    rng = np.random.default_rng(6)
    poor = np.arange(7000) % 7 == 0
    long, marked = np.where(poor, rng.random(7000) < 0.7, rng.random(7000) < 0.03), poor & (rng.random(7000) < 0.3)
    words = np.where(long, 100, 50)
    rows = [(i, int(words[i]), int(words[i]) * 5, *[0] * 5, 20 if marked[i] else 0, 1, 40, 0, False) for i in range(7000)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_lines", "n_distinct", "n_same"]
    measured = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean")
    labels = spark.createDataFrame([(i, int(not poor[i])) for i in range(7000)], "doc_id long, quality int")
    whole, sampled = (quality_rules.fit_rules(measured, labels, per_class=n) for n in (20_000, 300))
    said = measured.select("n_words", quality_rules.verdict(whole).alias("a"), quality_rules.verdict(sampled).alias("b"))
    assert said.filter("a != b").count() == 0 and said.filter("not a").count() > 0

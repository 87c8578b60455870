"""Token counts, packing and byte-pair encoding against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from vitrine.llm import bpe, packing, token_counts as counting
from vitrine.llm.common import tokenizer_path
from vitrine.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_counts_of_the_given_table(spark, library):
    texts = texts_of(spark)
    rows = queries()["op6_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)


def test_counts_of_odd_texts(spark, make_docs, library):
    docs = make_docs(ODD).withColumn("n_tokens", F.lit("clash"))
    rows = counting.token_counts(docs).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(library.encode(t or "").ids) for t in ODD]
    assert counting.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_with_other_vocabularies(spark, make_docs, name):
    path = tokenizer_path(name)
    rows = counting.token_counts(make_docs(ODD), path).orderBy("doc_id").collect()
    if name.endswith(".json"):
        want = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in ODD]
    else:
        import sentencepiece

        want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for t in ODD]
    assert [r.n_tokens for r in rows] == want


def test_splitting_does_not_change_counts(library):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("aeiounst'.,é1 \n") for _ in range(rng.randint(1, 12))) for _ in range(4000))
    assert len(counting.safe_pieces(text, 500)) > 20
    assert "".join(counting.safe_pieces(text, 500)) == text
    assert counting.count_texts([text, None, text], tokenizer_path(), 500) == [len(library.encode(text).ids), 0, len(library.encode(text).ids)]


def check_pieces(rows, texts, library, capacity=2048):
    """Every id in exactly one piece, pieces gapless in their sequences, digests of the right ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = np.array([*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / (len(by_sequence) * capacity)


def test_packing_of_the_given_table(spark, library):
    assert check_pieces(queries()["op3_packing"](spark, SF).collect(), texts_of(spark), library) > 0.98


def test_packing_of_odd_texts(spark, make_docs, library):
    docs = make_docs(ODD).repartition(40).withColumn("sequence_id", F.lit("clash"))
    packed = packing.pack(docs, open_windows=2).cache()
    check_pieces(packed.collect(), dict(enumerate(ODD)), library)
    for r in packed.collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert packing.pack(docs.limit(0)).count() == 0


def test_packer_keeps_its_bound_and_fills_best_fit():
    packer = packing.Packer(10, 2, 3)
    assert list(packer.add(1, 0, np.arange(6), 6)) == [] and list(packer.add(2, 0, np.arange(7), 7)) == []
    assert list(packer.add(3, 0, np.arange(3), 3)) == []  # room 4 and 3: goes where 3 are left
    (closed,) = packer.add(4, 0, np.arange(9), 9)  # fits nowhere: the full window leaves, 9 fit an empty one
    assert [p[0] for p in closed] == [2, 3]
    (closed,) = packer.add(5, 0, np.arange(8), 8)  # fullest has room 1, too little to cut
    assert [p[0] for p in closed] == [4]


def test_round_trip_of_the_given_table(spark, library):
    texts = texts_of(spark)
    rows = queries()["op9_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_of_odd_texts(spark, make_docs, library):
    docs = make_docs(ODD)
    ids = bpe.encoded(docs)
    assert [r.ids for r in ids.orderBy("doc_id").collect()] == [library.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert [r.decoded for r in bpe.decoded(ids).orderBy("doc_id").collect()] == [t or "" for t in ODD]
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_encoder_agrees_on_random_strings(library):
    rng = random.Random(5)
    letters = [*map(chr, range(32, 127)), *"\n\t  éñß漢🙂\x85\xa0’", "<|endoftext|>", " the", "ing", "'ll", "   "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(600)]
    texts += ["".join(rng.choice("abet ") for _ in range(150)) for _ in range(200)] + ["ab" * 400, "".join(rng.choice("etaoinsh") for _ in range(3000))]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(100)]
    made = bpe.encoder(tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in made.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_decoding_of_any_ids(library):
    ids = random.Random(7).choices(range(50257), k=3000)
    assert bpe.encoder(tokenizer_path()).vocabulary.decode(np.array(ids)).decode(errors="replace") == library.decode(ids, skip_special_tokens=False)


def test_the_faster_library_gives_the_same_ids(library):
    """Every code point in several surroundings, odd texts, long runs, and random strings."""
    fast = counting.encoder(tokenizer_path())
    texts = ["".join(f"a{c}a 1{c}1 {c}  {c}." for c in map(chr, range(at, at + 64)) if not 0xD800 <= ord(c) <= 0xDFFF) for at in range(0, 0x110000, 64)]
    texts += [*(t or "" for t in ODD), "\n" * 9000 + "a", " " * 9000, "ab" * 9000, "1" * 9000, "!" * 9000]
    rng = random.Random(9)
    letters = [*map(chr, range(32, 127)), *"\n\t\r  éñß漢🙂\x85\xa0’", "<|endoftext|>", "<|endof", " the", "'ll", "   "]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(2000)]
    for text, made in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert fast(text).tolist() == made.ids, repr(text[:80])


@pytest.mark.parametrize("run", [" ", "\n"])
def test_very_long_runs_of_white_space(spark, make_docs, library, run):
    texts = ["one" + run * 2_000_000 + "two three", "short"]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    docs = make_docs(texts)
    assert [r.n_tokens for r in counting.token_counts(docs).orderBy("doc_id").collect()] == want
    check_pieces(packing.pack(docs).collect(), dict(enumerate(texts)), library)

"""Language by profile and dictionary forms."""

import pytest
from pyspark.sql import functions as F

from vitrine.functions import rules
from vitrine.ml import language, lemma, words

LEMMAS = {
    # plurals
    "produtos": "produto", "opções": "opção", "informações": "informação", "animais": "animal", "papéis": "papel", "lençóis": "lençol", "azuis": "azul", "flores": "flor", "luzes": "luz",
    "homens": "homem", "vezes": "vez", "pães": "pão", "caminhões": "caminhão", "mês": "mês", "meses": "mês",
    # verbs
    "chegou": "chegar", "comprei": "comprar", "comprado": "comprar", "entregue": "entregue", "recebeu": "receber", "recebendo": "receber", "partiu": "partir", "partindo": "partir",
    "gostamos": "gostar", "vendemos": "vender", "pedimos": "pedir", "compraria": "comprar", "venderão": "vender", "fez": "fazer", "veio": "vir",
    # adjectives, adverbs, short and unknown words
    "gostosas": "gostoso", "ativas": "ativo", "boas": "bom", "rapidamente": "rapidamente", "mais": "mais", "gás": "gás", "ou": "ou", "eu": "eu", "xyz": "xyz", "": "",
}


@pytest.mark.parametrize("word", LEMMAS)
def test_lemma_cases(lemmas, word):
    assert lemmas[word] == LEMMAS[word]


@pytest.fixture(scope="module")
def lemmas(spark):
    df = spark.createDataFrame([(w,) for w in LEMMAS], "w string")
    return dict(df.select("w", lemma.lemma(F.col("w"))).collect())


def test_rule_table_is_well_formed():
    endings = [e for e, _, _ in lemma.ENDINGS]
    assert len(endings) == len(set(endings)) and all(least >= 1 for _, _, least in lemma.ENDINGS)


def test_content_words(spark):
    df = spark.createDataFrame([("Os produtos NÃO chegaram, e eu gostei da cor!",), ("",), (None,), ("o a e",)], "t string")
    got = [r[0] for r in df.select(words.content_words("t")).collect()]
    assert got == ["produto não chegar gostar cor", "", None, ""]


@pytest.fixture(scope="module")
def profile(spark):
    rows = [("the quick brown fox and the dog are in the house", "en"), ("le chien et le chat sont dans la maison avec nous", "fr"),
            ("der hund und die katze sind in dem haus", "de"), ("no language here", None), (None, "en"), ("12 34", "xx")]
    return language.learn(spark.createDataFrame(rows, "text string, lang string"), buckets=512)


def test_profile_tells_languages(spark, profile):
    texts = [(0, "THE HOUSE, and the brown dog"), (1, "la maison et le chat"), (2, "die katze und das haus"), (3, "123 !?"), (4, ""), (5, None), (6, "the dog " * 20_000)]
    df = spark.createDataFrame(texts, "i int, text string")
    told = dict(language.with_language(df, profile, as_name="guess").select("i", "guess").collect())
    assert told == {0: "en", 1: "fr", 2: "de", 3: None, 4: None, 5: None, 6: "en"}
    assert set(profile.tables) == {"de", "en", "fr"} and all(len(t) == 512 for t in profile.tables.values())
    passed = language.with_language(df, profile).select("i", rules.passes_language_gate(F.col("language"), F.col("text"), "fr")).collect()
    assert dict(passed) == {0: False, 1: True, 2: False, 3: True, 4: False, 5: None, 6: False}


def test_no_labelled_text_tells_nothing(spark):
    df = spark.createDataFrame([("some text", None)], "text string, lang string")
    assert language.with_language(df, language.learn(df)).first()["language"] is None


def test_scores_are_sums_over_trigrams(spark, profile):
    text = "the chat"
    padded = f" {text} "
    import zlib
    places = [zlib.crc32(padded[i:i + 3].encode()) % 512 for i in range(len(padded) - 2)]
    want = {name: sum(table[p] for p in places) for name, table in profile.tables.items()}
    df = spark.createDataFrame([(text,)], "text string")
    placed = F.transform(language.trigrams(F.col("text")), lambda g: language.bucket_of(g, 512))
    got = {r.language: r.score for r in df.select(F.inline(profile.scores(placed))).collect()}
    assert got == want

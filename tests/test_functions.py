"""Column functions on literal edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitrine.functions import dates, numbers, rules, text


def one(spark, column, **values):
    """Value of a column expression over a single literal row."""
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items()) or "x int"
    row = tuple(v for v, _ in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]


def test_every_review_artefact_is_repaired(spark):
    pairs = text.REVIEW_VOWELS + text.REVIEW_CAPITALS + [(e, "") for e in text.REVIEW_EMOJI] + [(c, "") for c in text.REVIEW_PUNCTUATION + text.REVIEW_ODD_MARKS]
    rows = spark.createDataFrame([(f"x{old}y", f"x{new}y".lower()) for old, new in pairs], "raw string, wanted string")
    wrong = rows.withColumn("got", text.repair_review(F.col("raw"))).filter("not (got <=> wanted)").collect()
    assert wrong == []


@pytest.mark.parametrize("raw, wanted", [
    (None, None), ("   ", None), ("", None), ("Muito Bom-demais!!", "muito bom demais"), ("A  B   c", "a b c"), ("linha\num", "linha\num"), ("...", None),
])
def test_review_edges(spark, raw, wanted):
    assert one(spark, text.repair_review(F.col("t")), t=(raw, "string")) == wanted


@pytest.mark.parametrize("raw, wanted", [
    ("sao paulo sp", "sao paulo"), ("Sao Paulo / SP", "sao paulo"), ("sao paulo/sp", "sao paulo"), ("SBC", "sao bernardo do campo"), ("scao jose do rio pardo", "sao jose do rio pardo"),
    ("santa barbara d oeste", "santa barbara d'oeste"), ("mogi mogi", "mogi"), ("a@b.c", None), ("rua 12", None), ("x", None), (None, None), ("ribeirao preto", "ribeirao preto"),
    ("são  josé", "são josé"), ("sÃ£o lourenÃ§o", "são lourenço"), ("curitiba-pr", "curitiba"),
])
def test_seller_cities(spark, raw, wanted):
    got = spark.createDataFrame([(raw,)], "c string").withColumn("t", text.tidy_seller_city(F.col("c"))).select(text.judged_seller_city(F.col("t")).alias("o")).first()["o"]
    assert got == wanted


@pytest.mark.parametrize("raw, state, plain, spaced", [
    ("são paulo", "SP", "saopaulo", "sao paulo"), ("brasilia sp", "SP", "brasiliasp", "brasilia"), ("sp", "SP", None, None), ("...santos", "SP", "santos", "santos"),
    ("monte - distrito", "MG", "monte", "monte"), ("ã­ba", "MG", "iba", "iba"), ("unknown", "MG", None, None), ("olho d%26apos%3b agua", "RN", "olhod'agua", "olho d'agua"),
])
def test_geo_cities(spark, raw, state, plain, spaced):
    raw = raw.replace("ã­", "ã­")
    for keep, wanted in ((False, plain), (True, spaced)):
        rows = spark.createDataFrame([(raw, state)], "c string, s string").withColumn("t", text.tidy_geo_city(F.col("c"), keep))
        assert rows.select(text.judged_geo_city(F.col("t"), F.col("s")).alias("o")).first()["o"] == wanted


@pytest.mark.parametrize("raw, wanted", [("two words", 2), ("a b c", 3), ("  a\n b  ", 2), ("   ", 0), (None, None)])
def test_word_count(spark, raw, wanted):
    assert one(spark, text.word_count(F.col("t")), t=(raw, "string")) == wanted


def test_model_text(spark):
    assert one(spark, text.clean_for_model(F.col("t")), t=("  Você VIU http://x.y/z? Ótimo, bom!! àâêôü ", "string")) == "voc viu ótimo bom"


def test_model_text_of_every_character(spark):
    """f10, m06: each character was tried against every range and named class of a set, one after another."""
    out = F.regexp_replace(F.lower("t"), f"(?:http|www)[^{text.WHITE}]+", "")
    out = F.regexp_replace(out, f"[^a-z0-9{text.WHITE} áéíóúãõçñ]+", "")
    wanted = F.trim(F.regexp_replace(out, f"[{text.WHITE}]+", " "))
    c = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    around = F.concat(c, F.lit("á b"), c, F.lit("C "), c, F.lit(" http:"), c, F.lit("9"), c, c, F.lit("-www."), c)
    codes = spark.range(0x110000).filter("id < 55296 or id > 57343").select(around.alias("t"))
    assert codes.filter(~text.clean_for_model(F.col("t")).eqNullSafe(wanted)).count() == 0
    odd = [None, "", " ", "\u00a0", "http", "HTTP://a b", "a\u2003\u3000b", " \t ", "a \x1c", "wwww www", "…a…", "\u1680", "x" * 5000 + "!" * 5000 + " " * 5000]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    assert rows.filter(~text.clean_for_model(F.col("t")).eqNullSafe(wanted)).count() == 0


def test_model_text_leaves_its_sets_at_the_table(spark):
    """Ranges and named classes stand behind the letters listed one by one, not before them."""
    plan = spark.createDataFrame([("x",)], "t string").select(text.clean_for_model(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "[^a-z" not in plan and f"[{text.WHITE}" not in plan


def test_padding_keeps_long_text(spark):
    assert one(spark, text.zero_padded(F.col("t")), t=("12", "string")) == "00012"
    assert one(spark, text.zero_padded(F.col("t")), t=("1234567", "string")) == "1234567"


def test_slug_and_alias(spark):
    assert one(spark, text.slug(F.col("t")), t=(" Top Seller State (Revenue) ", "string")) == "top_seller_state_revenue"
    assert one(spark, text.alias_matches(F.col("t"), ["top seller state (revenue)"]), t=("Top Seller State (Revenue)", "string"))


def test_dates(spark):
    assert one(spark, dates.date_key(F.col("d")), d=(dt.date(2018, 3, 9), "date")) == 20180309
    assert one(spark, dates.key_to_date(F.col("k")), k=(20180309, "int")) == dt.date(2018, 3, 9)
    assert one(spark, dates.key_to_date(F.col("k")), k=(20181399, "int")) is None
    assert one(spark, dates.parsed_moment(F.col("t")), t=("no day", "string")) is None
    assert one(spark, dates.iso_text(F.col("d")), d=(None, "date")) == ""


@pytest.mark.parametrize("raw, wanted", [("True", True), ("false", False), ("1", True), ("0", False), ("", None), ("yes", None), (None, None)])
def test_flags(spark, raw, wanted):
    assert one(spark, numbers.safe_flag(F.col("t")), t=(raw, "string")) is wanted


def test_safe_int_refuses_decimals(spark):
    assert one(spark, numbers.safe_int(F.col("t")), t=("10.0", "string")) is None


@pytest.mark.parametrize("value, plain, signed", [(12.0, "12%", "+12%"), (-3.25, "-3.3%", "-3.3%"), (0.5, "0.5%", "+0.5%"), (None, "—", "—")])
def test_percent_text(spark, value, plain, signed):
    assert one(spark, numbers.percent_text(F.col("v")), v=(value, "double")) == plain
    assert one(spark, numbers.signed_percent_text(F.col("v")), v=(value, "double")) == signed


def test_currency_and_score(spark):
    assert one(spark, numbers.currency_text(F.col("v")), v=(1234567.891, "double")) == "R$ 1,234,567.89"
    assert one(spark, numbers.score_text(F.col("v")), v=(4.0, "double")) == "4.00 / 5"
    assert one(spark, numbers.parsed_percent(F.col("t")), t=(" 12.5% ", "string")) == 12.5


def test_zero_divisor(spark):
    assert one(spark, numbers.ratio(F.col("a"), F.col("b")), a=(1, "int"), b=(0, "int")) is None


@pytest.mark.parametrize("given, wanted", [("High late rate", "negative"), ("Healthy", "positive"), ("Strong but high", "positive"), ("plain", "neutral"), (None, "neutral")])
def test_tone(spark, given, wanted):
    assert one(spark, rules.tone_of(F.col("t")), t=(given, "string")) == wanted


def test_late_flag(spark):
    stamp = dt.datetime(2018, 1, 2)
    assert one(spark, rules.late_flag(F.col("a"), F.col("b")), a=(None, "timestamp_ntz"), b=(stamp, "timestamp_ntz")) is None
    assert one(spark, rules.late_flag(F.col("a"), F.col("b")), a=(stamp, "timestamp_ntz"), b=(stamp, "timestamp_ntz")) is False
    assert one(spark, rules.late_flag(F.col("a"), F.col("b")), a=(stamp, "timestamp_ntz"), b=(None, "timestamp_ntz")) is False


@pytest.mark.parametrize("message, wanted", [("Who founded it?", "platform_info"), ("show the top sellers", "sql"), ("hello", "general"), ("superb", "general"), ("about vitrine and revenue", "platform_info")])
def test_intents(spark, message, wanted):
    assert one(spark, rules.intent_of(F.col("t")), t=(message, "string")) == wanted


def test_first_present(spark):
    df = spark.range(1).withColumn("b", F.lit(1))
    assert rules.first_present(df, ["a", "b"]) == "b"
    with pytest.raises(KeyError):
        rules.first_present(df, ["z"])

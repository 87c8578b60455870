"""Text repair and normalisation as native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from string import ascii_lowercase, digits

from pyspark.sql import Column, functions as F

NBSP = "\u00a0"

# Three-fold mis-decoded lower-case letters in review text.
REVIEW_VOWELS = [
    ("├â┬ú", "ã"), ("├â┬⌐", "é"), ("├â┬í", "á"), ("├â┬│", "ó"), ("├â┬º", "ç"), ("├â┬▒", "ñ"),
    ("├â┬¬", "ê"), ("├â┬¡", "í"), ("├â┬║", "ú"), ("├â┬╡", "õ"), ("├â┬á", "à"), ("├â┬ó", "ô"),
]
# Mis-decoded upper-case letters in review text.
REVIEW_CAPITALS = [
    ("├â╞Æ", "Ã"), ("├âΓÇ£", "Ó"), ("├âΓÇÖ", "Ó"), ("├âΓÇ░", "É"), ("├âΓÇí", "Ç"), ("├âΓÇ¥", "Ô"), ("├âΓÇÜ", "Ã"),
]
# Punctuation dropped from review text (a hyphen becomes a space).
REVIEW_PUNCTUATION = ".,!?;:\"()"
# What is left of mis-decoded emoji.
REVIEW_EMOJI = ["├░┼╕", "╦£", "γç", "┬å", "┬ì", "┬╝", "┬╜", "┬╗"]
# Smart quotes, eth, y-diaeresis, small tilde.
REVIEW_ODD_MARKS = "‘’“”ðÿ˜"

# Mis-decoded letters in city names. City text is lower-cased first and
# matching ignores case, so the patterns are lower case too.
CITY_LETTERS = [
    ("ã¡", "á"), ("ã©", "é"), ("ã\u00ad", "í"), ("ã³", "ó"), ("ãº", "ú"), ("ã£", "ã"), ("ãµ", "õ"),
    ("ã§", "ç"), ("ãª", "ê"), ("ã¢", "â"), ("ã´", "ô"), ("ã¼", "ü"), ("âº", "º"), ("%26apos%3b", "'"),
]
# Accents dropped from geolocation city names.
CITY_ACCENTS = ("áàãâéêíóôõ", "aaaaeeiooo")
# Marks dropped from geolocation city names, the space among them.
GEO_MARKS_FIRST = ",*()"
GEO_DISTRICT = " - distrito"
GEO_MARKS_LAST = "ðÿ˜¤—"
# City names that carry no information.
GEO_JUNK = ["", "unknown", "cidade", "geolocation_city"]
GEO_STATE_ONLY = ["sp", "rj", "mg", "es", "ba", "pr", "sc", "rs"]

# State suffixes dropped from seller city names, in this order.
SELLER_SUFFIXES = ["/sp", "/ sp", "- sp", " sp", "/mg", "/ mg", " minas gerais", "/pr", "/ pr", "-pr"]
# Accepted seller city names and their misspellings.
SELLER_CITY_TYPOS = {
    "sao paulo": ["sao pauo", "sao paluo", "sao pauol"],
    "sao bernardo do campo": ["sao bernardo do capo", "sbc", "ao bernardo do campo"],
    "ribeirao preto": ["riberao preto", "riberao pretp", "robeirao preto"],
    "sao jose do rio pardo": ["scao jose do rio pardo"],
    "sao jose do rio preto": ["s jose do rio preto", "sao jose do rio pret"],
    "florianopolis": ["floranopolis"],
}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once per row.

    The optimizer may inline a projected column wherever it is used, in a filter pushed
    below the projection too; inside a per-element lambda that would compute it anew for
    each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def swap_all(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements applied one after another."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, text)


def drop_all(text: Column, parts: Iterable[str]) -> Column:
    return swap_all(text, [(part, "") for part in parts])


def drop_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def underscores_to_spaces(text: Column) -> Column:
    return F.translate(text, "_", " ")


def hyphens_to_spaces(text: Column) -> Column:
    return F.translate(text, "-", " ")


def repair_review(text: Column) -> Column:
    """Undo mis-decoding, drop punctuation and artefacts, lower, trim; blank becomes NULL."""
    out = F.translate(F.coalesce(text, F.lit("")), NBSP, " ")
    out = swap_all(out, REVIEW_VOWELS)
    out = swap_all(out, REVIEW_CAPITALS)
    out = F.translate(out, "-" + REVIEW_PUNCTUATION, " ")
    out = drop_all(out, REVIEW_EMOJI)
    out = drop_chars(out, REVIEW_ODD_MARKS)
    return blank_to_null(F.trim(F.lower(single_spaced(out))))


def tidy_geo_city(city: Column, keep_spaces: bool = False) -> Column:
    """Undo mis-decoding, accents and marks of a lower-cased geolocation city name.

    Spaces are dropped along with the other marks, as the fixed values say;
    ``keep_spaces`` gives the variant in which they survive.
    """
    out = swap_all(city, CITY_LETTERS)
    out = F.translate(out, *CITY_ACCENTS)
    out = F.translate(out, "_" + GEO_MARKS_FIRST, " ")
    out = F.replace(out, F.lit(GEO_DISTRICT), F.lit(""))
    out = drop_chars(out, GEO_MARKS_LAST if keep_spaces else GEO_MARKS_LAST + " ")
    return F.trim(single_spaced(F.replace(out, F.lit("' "), F.lit("'"))))


def judged_geo_city(tidy: Column, state: Column) -> Column:
    """NULL for names that say nothing, no trailing state code, no leading dots.

    ``tidy`` should be a column of its own: it is referred to many times.
    """
    suffix = F.concat(F.lit(" "), F.lower(state))
    shorter = F.length(tidy) - F.length(state)
    return (
        F.when(tidy.isin(GEO_JUNK + GEO_STATE_ONLY), F.lit(None).cast("string"))
        .when(tidy.endswith(suffix) & (shorter >= 3), F.trim(F.left(tidy, shorter - 1)))
        .when(tidy.startswith("..."), F.replace(tidy, F.lit("..."), F.lit("")))
        .otherwise(tidy)
    )


def tidy_seller_city(city: Column) -> Column:
    """Lower-cased seller city name without mis-decoding, state suffixes and marks."""
    out = swap_all(F.lower(F.trim(city)), CITY_LETTERS)
    out = F.trim(drop_all(out, SELLER_SUFFIXES))
    return F.trim(single_spaced(F.translate(out, "_/\\.,*", "   ")))


def judged_seller_city(tidy: Column) -> Column:
    """Accepted spelling; a doubled word counts once; e-mails, numbers and stubs become NULL.

    ``tidy`` should be a column of its own: it is referred to many times.
    """
    first = F.substring_index(tidy, " ", 1)
    single = F.when(tidy == F.concat(first, F.lit(" "), first), first).otherwise(tidy)
    typo_map = F.create_map(
        *[F.lit(x) for good, bad in SELLER_CITY_TYPOS.items() for typo in bad for x in (typo, good)]
    )
    return (
        F.when(single.contains("@") | single.rlike("[0-9]") | (F.length(single) < 2), F.lit(None).cast("string"))
        .when(single.like("santa barbara d%oeste"), F.lit("santa barbara d'oeste"))
        .otherwise(F.coalesce(F.try_element_at(typo_map, single), single))
    )


def undo_date_mangling(text: Column) -> Column:
    """Stock ranges a spreadsheet turned into dates."""
    # Mangled range and original range.
    return F.when(text == "5-Jan", "1-5").when(text == "20-May", "5-20").otherwise(text)


def zero_padded(text: Column, width: int = 5) -> Column:
    """Left-pad with zeros; longer text stays whole."""
    text = text.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def slug(text: Column) -> Column:
    """Lower-case key with every other run of characters as one underscore."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


def alias_matches(name: Column, aliases: Iterable[str]) -> Column:
    import re

    keys = [re.sub("[^a-z0-9]+", "_", alias.lower()).strip("_") for alias in aliases]
    return slug(name).isin(keys)


#: Every whitespace character, as the inside of a character class.
WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


# A regular expression looks single characters below U+0100 up in one table, but tries the ranges and named classes of a set one by one
# on each character. The sets below hold what WHITE holds, in the shape that most characters leave after the table.
_NEAR_WHITE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
_FAR_WHITE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WHITE_NO_SPACE = rf"[\x{{1680}}-\x{{3000}}&&[{_FAR_WHITE}]]{_NEAR_WHITE}"
# The model's alphabet.
_ALPHABET = ascii_lowercase + digits + "áéíóúãõçñ"


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for blank text."""
    bare = F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{WHITE}]+")))


def has_words(text: Column, least: int) -> Column:
    """Whether there are at least so many words; the match ends with the last one needed."""
    return text.rlike(f"[{WHITE}]+".join([f"[^{WHITE}]+"] * least))


def clean_for_model(text: Column) -> Column:
    """Lower, drop links, keep the model's alphabet, collapse whitespace."""
    # Link pattern.
    out = F.regexp_replace(F.lower(text), f"(?:http|www)[^{WHITE}]+", "")
    out = F.regexp_replace(out, f"[[^{_ALPHABET} {_NEAR_WHITE}]&&[^{_FAR_WHITE}]]+", "")
    # A single plain space already is what a run of whitespace becomes, so only others are replaced.
    return F.btrim(F.regexp_replace(out, f" [{_WHITE_NO_SPACE} ]+|[{_WHITE_NO_SPACE}][{_WHITE_NO_SPACE} ]*", " "))


def is_valid_request(text: Column, shortest: int = 10, longest: int = 1000) -> Column:
    """Length and non-blank rule for text sent in for scoring."""
    return F.coalesce(F.length(text).between(shortest, longest) & (F.btrim(text) != ""), F.lit(False))

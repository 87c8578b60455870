"""Content words of Portuguese texts in their dictionary form: closed word classes go, endings are rewritten.

Nouns, adjectives, verbs and adverbs are open classes; what is left out instead are the closed ones, which can be listed. A word is looked
up among the exceptions first; else the longest ending of the rule table decides whose stem is long enough.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import groupby

from pyspark.sql import Column, functions as F

#: Articles, pronouns, prepositions, conjunctions and auxiliary verbs.
CLOSED_CLASSES = tuple((
    "o a os as um uma uns umas ao aos à às do da dos das no na nos nas num numa dum duma pelo pela pelos pelas "
    "eu tu ele ela nós vós eles elas você vocês me te se lhe lhes lo la los las vos mim ti si comigo contigo consigo conosco "
    "meu minha meus minhas teu tua teus tuas seu sua seus suas nosso nossa nossos nossas dele dela deles delas "
    "este esta estes estas esse essa esses essas aquele aquela aqueles aquelas isto isso aquilo deste desta desse dessa disto disso neste nesta nesse nessa nisso "
    "que quem qual quais cujo cuja quanto quantos onde quando como algum alguma alguns algumas nenhum nenhuma todo toda todos todas outro outra outros outras cada "
    "de em por para com sem sob sobre entre até desde contra perante após ante per "
    "e ou mas nem pois porém porque portanto contudo todavia embora conforme enquanto logo caso "
    "ser estar ter haver sou és é somos são era eram fui foi fomos foram seja sejam estou está estamos estão estava estavam tenho tem temos têm tinha tinham há havia").split())

#: Words whose dictionary form no ending tells.
EXCEPTIONS: dict[str, str] = {
    "veio": "vir", "vieram": "vir", "vem": "vir", "fez": "fazer", "fizeram": "fazer", "feito": "fazer", "faz": "fazer", "vai": "ir", "vão": "ir", "vou": "ir",
    "disse": "dizer", "diz": "dizer", "dito": "dizer", "deu": "dar", "deram": "dar", "quis": "querer", "quer": "querer", "pôde": "poder", "pode": "poder", "podem": "poder",
    "soube": "saber", "trouxe": "trazer", "viu": "ver", "visto": "ver", "pôs": "pôr", "posto": "pôr", "meses": "mês", "boa": "bom", "boas": "bom", "bons": "bom",
    "má": "mau", "más": "mau", "mais": "mais", "menos": "menos", "depois": "depois", "antes": "antes", "demais": "demais", "jamais": "jamais", "atrás": "atrás", "através": "através",
    "três": "três", "dois": "dois", "seis": "seis", "duas": "dois", "ônibus": "ônibus", "lápis": "lápis", "simples": "simples", "vezes": "vez", "país": "país", "países": "país",
    "mãos": "mão", "irmãos": "irmão", "pães": "pão", "não": "não", "então": "então", "muito": "muito", "muita": "muito", "muitos": "muito", "muitas": "muito",
}

#: Ending, what takes its place, and how many letters must stand before it.
ENDINGS: tuple[tuple[str, str, int], ...] = (
    ("mente", "mente", 2),
    # plurals
    ("ções", "ção", 1), ("sões", "são", 1), ("ões", "ão", 2), ("ães", "ão", 2), ("ais", "al", 2), ("éis", "el", 2), ("eis", "el", 3), ("óis", "ol", 2), ("uis", "ul", 2),
    ("res", "r", 3), ("zes", "z", 2), ("ns", "m", 1), ("s", "", 3),
    # forms of adjectives
    ("osa", "oso", 2), ("osas", "oso", 2), ("osos", "oso", 2), ("iva", "ivo", 2), ("ivas", "ivo", 2), ("ivos", "ivo", 2),
    # verbs in -ar
    ("ando", "ar", 2), ("ado", "ar", 3), ("ada", "ar", 3), ("ados", "ar", 3), ("adas", "ar", 3), ("aram", "ar", 2), ("ava", "ar", 2), ("avam", "ar", 2), ("ou", "ar", 2), ("ei", "ar", 2),
    ("ará", "ar", 2), ("arão", "ar", 2), ("aria", "ar", 3), ("ariam", "ar", 2), ("asse", "ar", 3), ("assem", "ar", 2), ("amos", "ar", 2),
    # verbs in -er
    ("endo", "er", 2), ("eram", "er", 2), ("eu", "er", 2), ("erá", "er", 2), ("erão", "er", 2), ("eria", "er", 3), ("eriam", "er", 2), ("esse", "er", 3), ("essem", "er", 2), ("emos", "er", 2),
    # verbs in -ir
    ("indo", "ir", 2), ("ido", "ir", 3), ("ida", "ir", 3), ("idos", "ir", 3), ("idas", "ir", 3), ("iram", "ir", 2), ("iu", "ir", 2), ("irá", "ir", 2), ("irão", "ir", 2), ("iria", "ir", 3),
    ("iriam", "ir", 2), ("isse", "ir", 3), ("issem", "ir", 2), ("imos", "ir", 2),
)


def _table(pairs: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def lemma(word: Column, exceptions: Mapping[str, str] = EXCEPTIONS, endings: Sequence[tuple[str, str, int]] = ENDINGS) -> Column:
    """Dictionary form of a word in lower case; the word itself where nothing applies.

    Endings of one length are one set, so a word is compared with a set a length, and rules are looked up only where it is in the set.
    """
    size, out = F.char_length(word), word
    by_length = groupby(sorted(endings, key=lambda e: len(e[0])), key=lambda e: len(e[0]))
    for length, rules in [(n, list(r)) for n, r in by_length]:
        ending, stem = F.right(word, F.lit(length)), size - length
        fires = (stem >= 1) & ending.isin([e for e, _, _ in rules]) & (stem >= F.try_element_at(_table({e: least for e, _, least in rules}), ending))
        put = F.try_element_at(_table({e: put for e, put, _ in rules}), ending)
        out = F.when(fires, F.concat(F.left(word, stem), put)).otherwise(out)
    return F.when(word.isin(list(exceptions)), F.try_element_at(_table(exceptions), word)).otherwise(out)

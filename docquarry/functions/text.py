"""Analyzers: text to terms, as column expressions. The English stemmer alone needs Python, once for each distinct term of a batch."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.errors import UserError

_TOKEN = r"[\p{L}\p{N}_]+(?:['.’][\p{L}\p{N}_]+)*+"  # possessive: a loop, where long texts would overflow the stack
_PY_TOKEN = re.compile(r"\w+(?:['.’]\w+)*")
ENGLISH_STOPS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: Language (code and name) -> name of a stop list; None: letters only.
LANGUAGES: dict[str, str | None] = {
    "generic": None, "en": "english", "da": "danish", "nl": "dutch", "fi": "finnish", "fr": "french", "de": "german", "hu": "hungarian", "it": "italian", "no": "norwegian",
    "pt": "portuguese", "br": "portuguese", "ru": "russian", "es": "spanish", "sv": "swedish", "tr": "turkish",
    **dict.fromkeys("ar bg bn ca ckb cz el et eu fa ga gl hi hy id lt lv pl ps ro sr ua".split()),
}
_NAMES = {
    "english": "en", "danish": "da", "dutch": "nl", "finnish": "fi", "french": "fr", "german": "de", "hungarian": "hu", "italian": "it", "norwegian": "no", "portuguese": "pt",
    "brazilian": "br", "russian": "ru", "spanish": "es", "swedish": "sv", "turkish": "tr", "arabic": "ar", "bulgarian": "bg", "bengali": "bn", "catalan": "ca", "sorani": "ckb",
    "czech": "cz", "greek": "el", "estonian": "et", "basque": "eu", "persian": "fa", "irish": "ga", "galician": "gl", "hindi": "hi", "armenian": "hy", "indonesian": "id",
    "lithuanian": "lt", "latvian": "lv", "polish": "pl", "romanian": "ro", "serbian": "sr", "ukrainian": "ua", "chinese": "zh", "japanese": "jp", "korean": "kr", "thai": "th",
}
_BIGRAMS = ("zh", "jp", "kr")


def language(name: str) -> str:
    code = _NAMES.get(name.lower(), name.lower())
    if code not in LANGUAGES and code not in _BIGRAMS:
        raise UserError(f"no analyzer for {name!r}" + (" (it needs a word segmenter)" if code == "th" else ""))
    return code


def stop_words(code: str) -> list[str]:
    if code == "en":
        return list(ENGLISH_STOPS)
    if LANGUAGES.get(code):
        from pyspark.ml.feature import StopWordsRemover

        return [w.lower() for w in StopWordsRemover.loadDefaultStopWords(LANGUAGES[code])]
    return []


def _region(word: str) -> str:
    """The pattern of vowels and consonants, runs merged."""
    out = ""
    for i, c in enumerate(word):
        v = c in "aeiou" or (c == "y" and i > 0 and out[-1:] == "c")
        k = "v" if v else "c"
        out += k
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _region(word)))


def porter(w: str) -> str:
    """Porter's stemmer of English words."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    vowel = lambda s: "v" in _region(s)
    cvc = lambda s: len(s) > 2 and _region(s)[-3:] == "cvc" and s[-1] not in "wxy"
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _region(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    steps = (
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
        ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
    )
    for table in (steps, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))):
        for end, put in table:
            if w.endswith(end):
                w = w[: -len(end)] + put if _measure(w[: -len(end)]) > 0 else w
                break
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


#: Light stemmers: signs to replace, then steps, of each of which the first rule that fits applies. Rules say what is kept of a word.
_PLAIN = ("àáâäèéêëìíîïòóôöùúûü", "aaaaeeeeiiiioooouuuu")
STEMMERS: dict[str, tuple[tuple[str, str], tuple[tuple[tuple[str, str], ...], ...]]] = {
    "de": (("äàáâöòóôïìíîüùúû", "aaaaooooiiiiuuuu"), (
        (("^(.{3,})ern$", "$1"), ("^(.{3,})e[mnrs]$", "$1"), ("^(.{3,})e$", "$1"), ("^(.{2,}[bdfghklmnt])s$", "$1")),
        (("^(.{3,})est$", "$1"), ("^(.{3,})e[rn]$", "$1"), ("^(.{2,}[bdfghklmnt])st$", "$1")),
    )),
    "es": (_PLAIN, ((("^(?=.{5})(.*)[oae]$", "$1"), ("^(?=.{5})(.*es)es$", "$1"), ("^(?=.{5})(.*)ces$", "$1z"), ("^(?=.{5})(.*)[oae]s$", "$1")),)),
    "it": (_PLAIN, ((("^(?=.{6})(.*?)(?:[ih]?e|[hi]?i|i?a|i?o)$", "$1"),),)),
    "fr": (("", ""), ((("^(?=.{6})(.*)aux$", "$1al"), ("^(?=.{6})(.*)x$", "$1"), (r"^(?=.{6})(.+?)([^0-9_'’.])\2?é?e?r?s?$", "$1$2")),)),
    "sv": (("", ""), (
        (("^(.{4,})s$", "$1"),),
        (
            ("^(.{3,})(?:elser|heten)$", "$1"), ("^(.{3,})(?:arne|erna|ande|else|aste|orna|aren)$", "$1"), ("^(.{3,})(?:are|ast|het)$", "$1"),
            ("^(.{3,})(?:ar|er|or|en|at|te|et)$", "$1"), ("^(.{3,})[taen]$", "$1"),
        ),
    )),
}


def _light(word: Column, code: str) -> Column:
    """A word's stem, in column expressions."""
    (old, new), steps = STEMMERS[code]
    out = F.translate(word, old, new) if old else word
    for rules in steps:
        c = out
        for pattern, kept in reversed(rules):
            c = F.when(out.rlike(pattern), F.regexp_replace(out, pattern, kept)).otherwise(c)
        out = c
    return out


def light_stem(word: str, code: str) -> str:
    """The same, on the driver."""
    (old, new), steps = STEMMERS[code]
    word = word.translate(str.maketrans(old, new))
    for rules in steps:
        for pattern, kept in rules:
            if re.search(pattern, word):
                word = re.sub(pattern, kept.replace("$", "\\"), word)
                break
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_lists(terms: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def stem(w: str) -> str:
        if (s := known.get(w)) is None:
            s = known[w] = porter(w)
        return s

    return terms.map(lambda a: None if a is None else [stem(w) for w in a])


def analyze(text: Column, analyzer: str = "generic") -> Column:
    """Terms of a text in order; an empty list for a null text."""
    code = language(analyzer)
    t = F.lower(F.coalesce(text, F.lit("")))
    if code in _BIGRAMS:
        runs = F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        pair = lambda r: F.when(F.char_length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
        return F.flatten(F.transform(runs, pair))
    terms = F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0))
    if code == "generic":
        return terms
    if code == "en":
        terms = F.transform(terms, lambda x: F.regexp_replace(x, "['’]s$", ""))
    stops = stop_words(code)
    if stops:
        terms = F.filter(terms, lambda x: ~x.isin(stops))
    if code in STEMMERS:
        return F.transform(terms, lambda x: _light(x, code))
    return _stem_lists(terms) if code == "en" else terms


def analyze_query(text: str, analyzer: str = "generic") -> list[str]:
    """The same analysis of one query string, on the driver."""
    code = language(analyzer)
    t = text.lower()
    if code in _BIGRAMS:
        return [g for r in re.findall(r"[^\W_]+", t) for g in ([r] if len(r) < 2 else [r[i : i + 2] for i in range(len(r) - 1)])]
    terms = _PY_TOKEN.findall(t)
    if code == "en":
        terms = [re.sub("['’]s$", "", x) for x in terms]
    stops = set(stop_words(code))
    terms = [x for x in terms if x not in stops]
    if code in STEMMERS:
        return [light_stem(x, code) for x in terms]
    return [porter(x) for x in terms] if code == "en" else terms


def word_ngrams(terms: Column, least: int, most: int) -> Column:
    """All word n-grams, by size, then position."""
    def of(n: int) -> Column:
        return F.when(F.size(terms) >= n, F.transform(F.sequence(F.lit(1), F.size(terms) - n + 1), lambda i: F.array_join(F.slice(terms, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(n) for n in range(least, most + 1)]))

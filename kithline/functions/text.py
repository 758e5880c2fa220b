"""Normalisation of names and addresses as column expressions.

Latin letters are folded by translate(); only text in other scripts needs Python
(fold_any), and only where the caller expects such text.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# One short form for each word, on both sides of a pair.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
    "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
    "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
    "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "tennessee": "tn",
    "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "wisconsin": "wi",
    "wyoming": "wy",
}
ABBREVIATIONS = {
    "street": "st", "saint": "st", "road": "rd", "avenue": "ave", "av": "ave", "drive": "dr",
    "boulevard": "blvd", "bd": "blvd", "bld": "blvd", "lane": "ln", "court": "ct", "place": "pl",
    "square": "sq", "highway": "hwy", "parkway": "pkwy", "circle": "cir", "terrace": "ter",
    "trail": "trl", "suite": "ste", "apartment": "apt", "floor": "fl", "building": "bldg",
    "north": "n", "south": "s", "east": "e", "west": "w", "rue": "r", "route": "rte",
    "chemin": "ch", "allee": "all", "impasse": "imp", "nagar": "ngr", "marg": "mg",
    "private": "pvt", "limited": "ltd", "corporation": "corp", "incorporated": "inc",
    "company": "co", "cie": "co", "and": "&", "et": "&",
}
ADDRESS_FILLERS = ("no", "number", "door", "h", "house", "hno", "flat", "unit", "near", "opp", "po", "box", "cdp")
ALIAS_MARKERS = r"\b(?:doing business as|d/?b/?a|formerly(?: known as)?|f/?k/?a|a/?k/?a|trading as|t/a)\b|\|"
DOMAIN_START = r"^\s*(?:www\.)?([a-z0-9\-]+)\.(?:com|in|net|org|co|fr|io|biz|us|info)\b"
#: Abbreviations win where a word is in both.
TOKEN_MAP = US_STATES | ABBREVIATIONS
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O"), ("đ", "d"), ("ł", "l"), ("Ł", "L"))


def _latin() -> tuple[str, str]:
    """Accented Latin letters and the plain letters under them, from their decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if b.isascii() and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """ASCII letters for Latin ones, lower case."""
    out = F.translate(c, *_latin())
    for given, same in LIGATURES:
        out = F.replace(out, F.lit(given), F.lit(same))
    return F.lower(out)


def _fold_word(s: str) -> str:
    out = []
    for ch in unicodedata.normalize("NFKD", s):
        if ch.isascii():
            out.append(ch)
        elif not unicodedata.combining(ch):
            d = unicodedata.digit(ch, None)
            name = unicodedata.name(ch, "").split()
            out.append(str(d) if d is not None else name[-1].lower() if "LETTER" in name else " ")
    return "".join(out)


def fold_any(c: Column) -> Column:
    """ASCII for any script: decompositions, digits by value, other letters by the last word of their Unicode name."""

    def folded(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: x if x is None or x.isascii() else _fold_word(x)).str.lower()

    import pandas as pd

    folded.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(folded, "string")(c)


def strip_zeros(t: Column) -> Column:
    return F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0"))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def norm_tokens(c: Column, drop: tuple[str, ...] = ()) -> Column:
    """Canonical tokens of a text, in order with repeats; words to drop are compared after mapping."""
    words = F.split(F.regexp_replace(F.replace(fold(c), F.lit("&"), F.lit(" & ")), "[^a-z0-9&]+", " "), " ")
    words = F.filter(words, lambda t: t != "")
    words = F.transform(words, lambda t: F.when(t.rlike("^[0-9]+$"), strip_zeros(t)).otherwise(t))
    words = F.transform(words, lambda t: F.coalesce(F.try_element_at(_map(TOKEN_MAP), t), t))
    return F.filter(words, lambda t: ~t.isin(*drop)) if drop else words


def normalized(c: Column, drop: tuple[str, ...] = ()) -> Column:
    return F.array_join(norm_tokens(c, drop), " ")


def alias(name: Column) -> Column:
    """What follows the last alias marker, if more than one part is not blank; else empty."""
    parts = F.filter(F.split(fold(name), ALIAS_MARKERS), lambda p: F.trim(p) != "")
    return F.when(F.size(parts) > 1, normalized(F.element_at(parts, -1))).otherwise("")


def is_domain(name: Column) -> Column:
    return fold(name).rlike(DOMAIN_START).cast("int")


def numbers(address: Column) -> Column:
    """Sorted distinct digit runs of the raw text without leading zeros, joined by blanks."""
    runs = F.transform(F.regexp_extract_all(address, F.lit(r"(?U)(\d+)"), F.lit(1)), strip_zeros)
    return F.array_join(F.array_sort(F.array_distinct(runs)), " ")


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def words(c: Column) -> Column:
    """The blank-separated words; none for an empty text."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def trigrams(c: Column) -> Column:
    """Character 3-grams; none for shorter texts."""
    return F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def tagged(tag: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(tag), t))


def record_tokens(core: Column, alt: Column, sq: Column, addr: Column, nums: Column) -> Column:
    """The bag of tokens that candidates are searched by."""
    return F.concat(
        tagged("n_", words(core)), tagged("n_", words(alt)), tagged("c_", trigrams(F.concat(F.lit("#"), sq, F.lit("#")))),
        tagged("a_", words(addr)), tagged("d_", words(nums)),
    )


def word_trigrams(c: Column) -> Column:
    """3-grams inside blank-padded words; shorter padded words stand for themselves."""
    padded = F.transform(words(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(trigrams(w))))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)

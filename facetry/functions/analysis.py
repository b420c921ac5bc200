"""Tokenisers as column expressions: text to an array of terms, evaluated in the JVM.

`standard` lower-cases, folds accented Latin letters to ASCII and takes runs of letters and digits; a run goes on over . - / , _ if
the part after it holds a digit. There are no stop words. A null text has no terms.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+(?:[.\-/,_][\p{L}\p{N}]*\p{N}[\p{L}\p{N}]*)*"


def _fold_table() -> tuple[str, str]:
    """Letters with a one-letter ASCII base and that base."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha():
            source.append(chr(code))
            target.append(base.lower())
    extra = {"ø": "o", "đ": "d", "ł": "l", "ı": "i", "ħ": "h", "ŧ": "t"}
    return "".join([*source, *extra]), "".join([*target, *extra.values()])


FOLD_FROM, FOLD_TO = _fold_table()
#: Letters that fold to two.
LONG_FOLDS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"))


def fold(text: Column) -> Column:
    """Lower case without accents. A letter followed by a combining accent isn't composed first."""
    out = F.translate(F.lower(text), FOLD_FROM, FOLD_TO)
    for a, b in LONG_FOLDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def word_pattern(word: str) -> str | None:
    """A regular expression that finds every text of which `fold` holds the word, and few others: raw texts need no folding first.

    Any character beyond ASCII may stand for any letter, and for two that one folds to. None for a word in which such pairs overlap.
    """
    other = r"\x{80}-\x{10FFFF}"
    pairs = [i for i in range(len(word) - 1) if word[i : i + 2] in {two for _, two in LONG_FOLDS}]
    if any(b - a == 1 for a, b in zip(pairs, pairs[1:], strict=False)):
        return None

    def letter(c: str) -> str:
        if not c.isascii():
            return f"[{other}]"
        return f"[{c.lower()}{c.upper()}{other}]" if c.isalpha() else f"[{re.escape(c)}{other}]"

    out, i = "", 0
    while i < len(word):
        if i in pairs:
            out += f"(?:{letter(word[i])}{letter(word[i + 1])}|[{other}])"
            i += 2
        else:
            out += letter(word[i])
            i += 1
    return out


def _empty() -> Column:
    return F.array().cast("array<string>")


def standard(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0)), _empty())


def whitespace(text: Column) -> Column:
    return F.coalesce(F.filter(F.split(text, r"\s+"), lambda t: t != ""), _empty())


def keyword(text: Column) -> Column:
    return F.when(text.isNull(), _empty()).otherwise(F.array(text))


def dutch(text: Column) -> Column:
    """Standard terms and, behind each, its Dutch stem where that differs."""
    from facetry.functions.stemming import dutch_tokens

    return F.transform(dutch_tokens(standard(text)), lambda t: t.term)


ANALYZERS = {"dutch": dutch, "standard": standard, "whitespace": whitespace, "keyword": keyword}


def positions(values: Column, analyzer=standard, gap: int = 0) -> Column:
    """Array of (term, pos) of a multi-valued field; between two values lie `gap` places that no phrase crosses."""
    start = F.struct(F.array().cast("array<struct<term:string,pos:int>>").alias("out"), F.lit(0).alias("next"))

    def add(acc: Column, value: Column) -> Column:
        tokens = analyzer(value)
        placed = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), (acc.next + i).cast("int").alias("pos")))
        return F.struct(F.concat(acc.out, placed).alias("out"), (acc.next + F.size(tokens) + F.lit(gap)).cast("int").alias("next"))

    return F.aggregate(F.coalesce(values, _empty()), start, add, lambda acc: acc.out)


def word_ngrams(word: Column, n: int) -> Column:
    """Character n-grams of one word, wrapped in $."""
    wrapped = F.concat(F.lit("$"), word, F.lit("$"))
    count = F.char_length(wrapped) - (n - 1)
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(wrapped, i, F.lit(n)))).otherwise(_empty())


def ngrams(text: Column, n: int) -> Column:
    """Character n-grams of all words, each wrapped in $; accents stay."""
    words = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), _empty())
    return F.flatten(F.transform(words, lambda w: word_ngrams(w, n)))


def shingles(tokens: Column, least: int, most: int) -> Column:
    """Single words and word n-grams of `least` to `most` words, by place and then length."""
    sizes = sorted({1, *range(least, most + 1)})

    def all_of(tok: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            each = [F.when(i + k <= F.size(tok), F.array_join(F.slice(tok, i + 1, k), " ")) for k in sizes]
            return F.filter(F.array(*each), lambda s: s.isNotNull())

        return F.flatten(F.transform(tok, at))

    return once(tokens, all_of)


def term_vector(tokens: Column) -> Column:
    """Map of each term to its number of occurrences."""
    return once(tokens, lambda tok: F.map_from_arrays(F.array_distinct(tok), F.transform(F.array_distinct(tok), lambda t: F.size(F.filter(tok, lambda x: x == t)))))


def once(value: Column, use) -> Column:
    """use(value), the value being computed once a row however often it is used, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def phrase_count(tokens: Column, terms: list[str]) -> Column:
    """How often the terms stand side by side in this order."""
    n = len(terms)
    if not n:
        return F.lit(0)
    wanted = F.array(*map(F.lit, terms))

    def count(tok: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tok) - n + 1, F.lit(1)))
        return F.when(F.size(tok) >= n, F.size(F.filter(starts, lambda i: F.slice(tok, i, n) == wanted))).otherwise(0)

    return once(tokens, count)


def placed_phrase_count(placed: Column, terms: list[str]) -> Column:
    """How often the terms stand at places one after the other; `placed` is an array of (term, pos), several terms may share a place."""
    if not terms:
        return F.lit(0)

    def starts(i: int, term: str) -> Column:
        return F.transform(F.filter(placed, lambda x: x.term == term), lambda x: x.pos - i)

    both = starts(0, terms[0])
    for i, term in enumerate(terms[1:], 1):
        both = F.array_intersect(both, starts(i, term))
    return F.size(both)


def haversine(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Metres on a sphere of the mean Earth radius."""
    a = F.pow(F.sin(F.radians(lat - to_lat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(to_lat))) * F.pow(F.sin(F.radians(lon - to_lon) / 2), 2)
    return F.lit(2 * 6371008.7714) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))

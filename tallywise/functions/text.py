"""Tokens and n-grams of descriptions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from tallywise.constants import TOKEN_PATTERN


def plain_letter(char: str) -> str:
    """The character without its marks, by compatibility decomposition."""
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


# every letter of the basic plane that is one plain letter with marks
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x2000)) if c.isalpha() and len(plain_letter(c)) == 1 and plain_letter(c) != c)
PLAIN = "".join(map(plain_letter, ACCENTED))


def words(text: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def word_ngrams(text: Column) -> Column:
    """Tokens and pairs of neighbouring tokens, within the row."""
    def with_pairs(toks: Column) -> Column:
        follow = F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0)))
        heads = F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0)))
        return F.concat(toks, F.zip_with(heads, follow, lambda a, b: F.concat(a, F.lit(" "), b)))

    # as the variable of a function the tokens are found once, not once for every use of them
    return F.transform(F.array(words(text)), with_pairs)[0]


def fold_accents(text: Column) -> Column:
    """Letters without their marks, whether the marks are part of the letter or follow it."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}+", "")


def padded_words(text: Column) -> Column:
    """White-space tokens, lower-case and folded, with one space on each side."""
    parts = F.split(fold_accents(F.lower(text)), r"\s+")
    return F.transform(F.filter(parts, lambda p: p != ""),
                       lambda p: F.concat(F.lit(" "), p, F.lit(" ")))


def char_ngrams(word: Column, smallest: int = 1, largest: int = 3) -> Column:
    """All character n-grams of one padded word.

    A word shorter than n is counted once, which for ``largest`` up to three
    never differs from the plain windows because padding gives three characters.
    """
    def windows(n: int) -> Column:
        last = F.greatest(F.length(word) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(word, i, F.lit(n)))

    return F.concat(*[windows(n) for n in range(smallest, largest + 1)])


def normal_description(c: Column) -> Column:
    """Stripped text; a missing description stays missing."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")

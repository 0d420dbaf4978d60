"""Text expressions: word and sentence splitting, tags, syllables.  All run inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

# A word of ASCII letters, digits and inner apostrophes that no other letter, digit or underscore touches.
WORD = r"(?<![\p{L}\p{N}_])[a-zA-Z0-9](?:[a-zA-Z0-9']*[a-zA-Z0-9])?(?![\p{L}\p{N}_])"
ANY_WORD = r"[\p{L}\p{N}_]+"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])"
PHRASE = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?![\p{L}\p{N}_])"
YEAR = r"(?<![\p{L}\p{N}_])(?:1[89][0-9]{2}|20[0-2][0-9])(?![\p{L}\p{N}_])"
ACRONYM = r"(?<![\p{L}\p{N}_])[A-Z]{2,6}(?![\p{L}\p{N}_])"


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_array(text: Column) -> Column:
    return find_all(text, WORD)


def sentence_array(text: Column, longer_than: int = 10) -> Column:
    """Trimmed sentences longer than ``longer_than`` characters, in order."""
    parts = F.transform(F.split(text, SENTENCE_BREAK), strip)
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def ngram_array(tokens: Column, n: int) -> Column:
    """All n-grams of a token array, built inside the row: no self-join and no window."""
    last = F.size(tokens) - n
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                    lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " ")),
    ).otherwise(F.array().cast("array<string>"))


def ends_with_any(word: Column, suffixes: list[str]) -> Column:
    return word.rlike("(?:" + "|".join(suffixes) + r")\z")


def tag(word: Column) -> Column:
    """Word class by lists, then suffixes, then shape; the first rule that holds wins."""
    w = F.lower(word)
    out = None
    for name, words in L.TAG_WORDS:
        out = F.when(w.isin(words), name) if out is None else out.when(w.isin(words), name)
    return (
        out.when(w.endswith("ly") & (F.length(w) > 4), "ADV")
        .when(ends_with_any(w, L.VERB_SUFFIXES), "VERB")
        .when(ends_with_any(w, L.NOUN_SUFFIXES), "NOUN")
        .when(ends_with_any(w, L.ADJECTIVE_SUFFIXES), "ADJ")
        .when(word.rlike("^[A-Z]") & (F.length(word) > 1), "PROPN")
        .when(w.rlike(r"^[0-9]+\z"), "NUM")
        .otherwise("NOUN")
    )


def syllables(word: Column) -> Column:
    """Vowel groups, minus a silent final e, at least one."""
    w = F.lower(word)
    silent = w.endswith("e") & ~w.endswith("le")
    return F.greatest(F.size(find_all(w, "[aeiouy]+")) - F.when(silent, 1).otherwise(0), F.lit(1))

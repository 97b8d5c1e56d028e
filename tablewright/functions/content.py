"""Columns that say what kind of text a text is: readability, kind of content, personal data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablewright.functions import text as X

#: A word, a sentence's end, and what a syllable has one of.
WORD, SENTENCE_END, VOWELS = r"[A-Za-zÀ-ɏ]+", "[.!?]+", "[aeiouyAEIOUYàáâäåæèéêëìíîïòóôöøùúûüÿ]+"

# The weights of Flesch's reading ease.
EASE, PER_SENTENCE, PER_WORD = 206.835, 1.015, 84.6

#: What a text with personal data or a secret holds, by kind. Each match takes a bounded number of steps.
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-][A-Za-z0-9.-]{0,250}\.[A-Za-z]{2}",
    "phone": r"(?:\+|00)[1-9][0-9 ().-]{7,14}[0-9]|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "ip_address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "card": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}",
    "secret": r"AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
}


def personal(text: Column, kind: str) -> Column:
    """Whether a text holds personal data of a kind; null for null."""
    return text.rlike(PERSONAL[kind])


def readability(text: Column) -> Column:
    """Struct of words, sentences, syllables and ease (Flesch; higher reads easier, null without a word); a text has one sentence at least, a word one syllable."""
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    sentences = F.greatest(F.regexp_count(text, F.lit(SENTENCE_END)).cast("long"), F.lit(1))
    syllables = F.greatest(F.regexp_count(text, F.lit(VOWELS)).cast("long"), words)
    per_sentence, per_word = F.try_divide(words.cast("double"), sentences.cast("double")), F.try_divide(syllables.cast("double"), words.cast("double"))
    ease = F.when(words > 0, EASE - PER_SENTENCE * per_sentence - PER_WORD * per_word)
    return F.when(text.isNotNull(), F.struct(words.alias("words"), sentences.alias("sentences"), syllables.alias("syllables"), ease.alias("ease")))


def kind_of(text: Column) -> Column:
    """``html``, ``log``, ``code`` or ``text``, the first that fits; ``empty`` for null and blank texts."""
    blank = text.isNull() | ~text.rlike(r"\S")
    return F.when(blank, "empty").when(X.is_html(text), "html").when(X.is_log(text), "log").when(X.is_code(text), "code").otherwise("text")

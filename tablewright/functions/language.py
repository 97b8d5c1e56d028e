"""Deterministic language detection by frequent words, as columns; another detector can be plugged in by the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

UNKNOWN = "unknown"

# Frequent words by language; of equal scores the language named first wins.
FREQUENT = {
    "en": "the of and to in that it is was for with as be on by from this are or an".split(),
    "fr": "le la les de des et un une en que qui dans pour pas sur au avec ce il du".split(),
    "de": "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch".split(),
    "es": "el la los las de y que en un una por con para su del se al lo no es".split(),
}


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}_]+")


def detected(text: Column, frequent: dict[str, list[str]] = FREQUENT) -> Column:
    """The language whose frequent words occur most; ``unknown`` for null and where none occurs."""

    def hits(known: list[str]):
        return lambda found: F.size(F.filter(found, lambda w: w.isin(known)))

    # Arrays of one element, so that the words, and then their counts, are made once and used by name.
    counting = [hits(known) for known in frequent.values()]
    counts = F.transform(F.array(words(text)), lambda found: F.array(*[count(found) for count in counting]))
    names = F.array(*map(F.lit, frequent))

    def choice(n: Column) -> Column:
        return F.when(F.array_max(n) > 0, F.get(names, F.array_position(n, F.array_max(n)).cast("int") - 1)).otherwise(UNKNOWN)

    return F.get(F.transform(counts, choice), F.lit(0))


Detector = Callable[[Column], Column]

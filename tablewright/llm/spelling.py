"""Groups of spelling variants: words one inserted, deleted or replaced character apart, each led to its commonest neighbour.

Neighbours are found without pairs. A word of n characters is in n wildcard groups (its characters but one, and where that one stood); two words of a group differ by one replaced
character, and share no other group. A group keeps its members' characters, its size and its two commonest words, so each member learns how many neighbours it has there and which is the
commonest: the first, or the second for the first itself. A group has no more members than the alphabet has letters, so none is large, whatever the corpus. Words that differ by an insertion
meet where a word's deletions join the vocabulary: the shorter word counts the longer ones and keeps the commonest, a partial aggregate, and the longer one does likewise. Counts and best neighbours of
both kinds are then added up by word. All shuffles carry rows in proportion to the letters of the vocabulary.

A word's form is its commonest neighbour (of equals the first in code-point order) if that is at least ``factor`` times as common. Counts grow along forms, so they end after
log(most common / least count) / log(factor) steps at most; roots are found by doubling the step, a join for each doubling.

Null and empty texts have no words; a text of any length is read whole; repeated documents count as often as they occur, so words and counts depend on all rows but not on their order. A
null document id takes part as the empty text in the hash of ``dented``. Other columns of the documents are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import cut

#: Letters of a run. Its lower case, below, concerns A-Z only.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2


def dented(run: Column, id_: Column, every: int = 97) -> Column:
    """``run`` without one of its characters, if ``every`` divides the CRC-32 of id and run; the same for the same document and run."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, text: str = "text", id_: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least_length`` characters that occur ``least_count`` times or more. Runs that are too short to be words even whole are never made rows."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.col(id_).alias("id"), F.explode(runs).alias("run"))
    words = rows.select(dented(F.col("run"), F.col("id")).alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _best(n: Column, word: Column) -> Column:
    """What the commonest word, first in code-point order of equals, has least of."""
    return F.struct((-n).alias("less"), word.alias("word"))


def by_replacement(words: DataFrame) -> DataFrame:
    """(word, near, best): for each wildcard group of a word its neighbours there, and their best; groups of one word are left out."""
    places = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("at"))
    head, tail = F.substring("word", F.lit(1), F.col("at") - 1), F.substring("word", F.col("at") + 1, F.char_length("word"))
    keyed = places.select("at", head.alias("prefix"), tail.alias("suffix"), (-F.col("n")).alias("less"), F.substring("word", F.col("at"), F.lit(1)).alias("letter"))
    # As many members as the alphabet has letters at most. Equal but for a letter, words sort as their letters do.
    groups = keyed.groupBy("at", "prefix", "suffix").agg(F.array_sort(F.collect_list(F.struct("less", "letter"))).alias("members")).filter(F.size("members") > 1)
    whole = lambda letter: F.concat("prefix", letter, "suffix")
    kept = groups.select(
        "prefix",
        "suffix",
        (F.size("members") - 1).cast("long").alias("near"),
        F.get("members", F.lit(0)).alias("top"),
        F.get("members", F.lit(1)).alias("second"),
        F.col("members.letter").alias("letters"),
    )
    each = kept.select("*", F.explode("letters").alias("letter"))
    other = F.when(F.col("letter") == F.col("top.letter"), F.col("second")).otherwise(F.col("top"))
    return each.select(whole(F.col("letter")).alias("word"), "near", F.struct(other["less"].alias("less"), whole(other["letter"]).alias("word")).alias("best"))


def by_deletion(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, near, best) of neighbours that are one character shorter or longer, from the deletions that are words; a row for each side of each."""
    longer = words.filter(F.char_length("word") > least_length)
    places = F.sequence(F.lit(1), F.char_length("word"))
    gone = F.transform(places, lambda at: F.concat(F.substring(F.col("word"), F.lit(1), at - 1), F.substring(F.col("word"), at + 1, F.char_length("word"))))
    made = longer.select("word", "n", F.explode(F.array_distinct(gone)).alias("short"))
    met = made.join(words.select(F.col("word").alias("short"), F.col("n").alias("short_n")), "short")
    sides = F.array(
        F.struct(F.col("word"), _best(F.col("short_n"), F.col("short")).alias("best")),
        F.struct(F.col("short").alias("word"), _best(F.col("n"), F.col("word")).alias("best")),
    )
    return met.select(F.inline(sides)).select("word", F.lit(1).cast("long").alias("near"), "best")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): number of neighbours and the best one as (less, word), null where there is none."""
    found = by_replacement(words).unionByName(by_deletion(words)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return words.join(found, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def roots(forms: DataFrame, doublings: int) -> DataFrame:
    """(word, root) of ``forms`` (word, form), in which no word's way comes back: the end of each way. Each round joins the ends reached so far to those of their ends."""
    reached = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(doublings):
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = cut(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return reached


def variants(docs: DataFrame, text: str = "text", id_: str = "doc_id", factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the corpus."""
    words = cut(vocabulary(docs, text, id_))
    near = neighbours(words)
    best_n = -F.col("best.less")
    leads = F.coalesce(best_n >= factor * F.col("n"), F.lit(False))
    led = cut(near.select("word", "n", "n_near", F.when(leads, F.col("best.word")).alias("form"), F.when(leads, best_n).alias("form_n")))
    longest = math.log(max(1, (words.agg(F.max("n")).first()[0] or 1) / LEAST_COUNT), factor)
    ends = roots(led.filter(F.col("form").isNotNull()), math.ceil(math.log2(longest + 1)))
    return led.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))

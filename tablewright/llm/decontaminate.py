r"""Benchmark decontamination by word n-grams, in DataFrame functions only.

Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z is lower-cased. A window is ``n`` consecutive words of a benchmark item; an item
of fewer words, but not none, is one window. The benchmark's different windows are a hash set, which is broadcast; each window of a document, of
every length that the benchmark has, is looked up by its hash as the texts are read, and a hit is verified word by word where it stands. No text
is shuffled: only hits and one short row for each document go on. A set beyond ``broadcast_bytes`` is broadcast in slices of that size, with
a pass over the texts for each.

Which items a window belongs to is kept apart and joined to the different windows that a document holds, so a passage that a thousand
items share is no larger in the set than any other.

Defined cases: null texts have no words; documents with equal id and equal text have equal results, and each row stays; rows with a null id
are judged like others; items with equal text count each, those with equal id once, those with a null id hit but aren't named; no hits leave
the digest of the empty string; empty tables give an empty or a clean result; other columns are ignored (or kept, by ``clean``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import cut, private

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, and is in none, where capitals are not lower-cased.
ASIDE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Most bytes of benchmark windows that are sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Most slices of that size; a benchmark beyond them (64 GB) is an error.
MOST_SLICES = 1000


def normal(text: Column) -> Column:
    """Words with one space after each; empty where there is none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.ltrim(F.regexp_replace(F.concat(low, F.lit(" ")), BETWEEN, " "))


def word_count(words: Column) -> Column:
    return (F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))).cast("long")


def _word_list(text: Column) -> Column:
    return F.split(F.rtrim(normal(text)), " ")


def windows(benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(window, hash, size, words): each different window; and (window, item): the ids of the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _word_list(F.col("text")).alias("w"))
    items = items.filter((F.size("w") > 1) | (F.element_at("w", 1) != ""))
    size = F.least(F.size("w"), F.lit(n))
    each = items.select("item", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda k: F.slice("w", k, size))).alias("words"))
    # A window's name are 128 bits of it: sure enough to tell the windows of a benchmark apart.
    named = each.withColumn("window", F.md5(F.array_join("words", " ")))
    named = cut(named.dropDuplicates(["window", "item"]))
    found = named.dropDuplicates(["window"]).select("window", "size", "words")
    hashed = _hashed(found, "words", list(range(1, n + 1)), "hashes")
    hashed = hashed.select("window", F.get(F.element_at("hashes", F.col("size")), F.lit(0)).alias("hash"), "size", "words")
    return hashed, named.filter("item is not null").select("window", "item")


def _hashed(rows: DataFrame, words: str, sizes: list[int], into: str) -> DataFrame:
    """``rows`` with an array that has, for each of ``sizes``, the hashes of all windows of so many of ``words``, in order.

    Hashes of 1, 2, 4, ... words come from two of half as many, those of other numbers from these; so a window takes a few steps, not one for each word.
    """
    powers = {1: private("h1")}
    out = rows.withColumn(powers[1], F.transform(words, lambda w: F.xxhash64(w)))

    def joined(left, a: int, right, b: int):
        """Hashes of a + b words from those of a and of b."""
        n = F.greatest(F.size(words) - (a + b - 1), F.lit(0))
        return F.zip_with(F.slice(left, 1, n), F.slice(right, a + 1, n), lambda x, y: F.xxhash64(x, y))

    while 2 * max(powers) <= max(sizes):
        half = max(powers)
        powers[2 * half] = private(f"h{2 * half}")
        out = out.withColumn(powers[2 * half], joined(F.col(powers[half]), half, F.col(powers[half]), half))
    made = []
    for size in sizes:
        parts = [k for k in sorted(powers, reverse=True) if size & k]
        whole, done = F.col(powers[parts[0]]), parts[0]
        for k in parts[1:]:
            whole, done = joined(whole, done, F.col(powers[k]), k), done + k
        made.append(whole)
    return out.withColumn(into, F.array(*made)).drop(*powers.values())


def _met(docs: DataFrame, found: DataFrame, sizes: list[int], heads: bool) -> DataFrame:
    """(doc_id, text_hash, n_words, place, size, window) of each window of ``found`` that a document holds; a place of -1 for each row of ``docs``, if ``heads``."""
    words, text_hash, hashes, at, hash_ = (private(x) for x in ("words", "hash", "hashes", "at", "window_hash"))
    # Each step is a column before the next one is, or it would be made anew wherever that names it.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias(text_hash), normal(F.col("text")).alias(words))
    rows = rows.select("doc_id", text_hash, word_count(F.col(words)).alias("n_words"), F.split(F.rtrim(words), " ").alias(words))
    rows = _hashed(rows, words, sizes, hashes) if sizes else rows.withColumn(hashes, F.array().cast("array<array<bigint>>"))
    # The hashes of all sizes in one array; before them, null stands for the row itself.
    rows = rows.withColumn(hashes, F.concat(F.array(F.lit(None).cast("long")), F.flatten(hashes)))
    # What is exploded is a plain column, so the words beside it are not copied for each hash; no array is empty, but a plain explode would have
    # the optimizer ask for that below, and make all of this twice.
    rows = rows.select("doc_id", F.col(text_hash).alias("text_hash"), "n_words", words, F.posexplode_outer(hashes).alias(at, hash_))
    found = found.select(F.col("hash").alias(hash_), "size", F.col("words").alias("of"), "window")
    met = rows.join(F.broadcast(found), hash_, "left" if heads else "inner")
    before, place = F.lit(1), F.lit(-1)  # of each size, how many hashes stand before its first
    for size in sizes:
        place = F.when(F.col("size") == size, F.col(at) - before).otherwise(place)
        before = before + F.greatest(F.size(words) - (size - 1), F.lit(0))
    met = met.filter((F.col(at) == 0) | F.col("window").isNotNull())
    met = met.withColumn("place", place.cast("long"))
    same = (F.col("place") >= 0) & (F.slice(words, F.greatest(F.col("place").cast("int"), F.lit(0)) + 1, F.coalesce("size", F.lit(0))) == F.col("of"))
    return met.filter((F.col(at) == 0) | same).select("doc_id", "text_hash", "n_words", "place", "size", "window")


def _hits(docs: DataFrame, benchmark: DataFrame, n: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """What ``_met`` finds, heads included, and the items by window."""
    found, items = windows(benchmark, n)
    found = cut(found)
    # 32 digits of the name, hash, size, and for each word its bytes and a pointer and length.
    weight = F.lit(96) + F.aggregate("words", F.lit(0), lambda t, w: t + F.octet_length(w) + 16)
    sizes, weighed = found.agg(F.collect_set("size"), F.sum(weight.cast("long"))).first()
    slices = max(1, -(-(weighed or 0) // max(1, broadcast_bytes)))
    parts = [found if slices == 1 else found.filter(F.pmod("hash", F.lit(slices)) == k) for k in range(min(slices, MOST_SLICES))]
    if slices > MOST_SLICES:
        raise ValueError(f"the benchmark's windows take {weighed} bytes, {MOST_SLICES} slices of {broadcast_bytes} at most are broadcast")
    return cut(reduce(DataFrame.unionByName, [_met(docs, part, sorted(sizes), k == 0) for k, part in enumerate(parts)])), items


def judged(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, spans, items) for each row of ``docs``; spans holds (start, size) of hit words in order, items the ids of items with occurring windows."""
    met, of = _hits(docs, benchmark, n, broadcast_bytes)
    base = met.filter("place < 0").select("doc_id", "text_hash", "n_words")
    hits = met.filter("place >= 0")
    spans = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct(F.col("place").alias("start"), "size"))).alias("spans"))
    named = hits.select("doc_id", "text_hash", "window").distinct().join(of, "window").groupBy("doc_id", "text_hash").agg(F.collect_set("item").alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["to"], s["start"] + s["size"]).alias("to"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["start"] + s["size"] - F.greatest(a["to"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    spans = spans.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), covered.alias("n_hit"), "spans")
    named = named.select(F.col("doc_id").alias("d2"), F.col("text_hash").alias("h2"), "items")
    joined = base.join(spans, base["doc_id"].eqNullSafe(spans["d"]) & base["text_hash"].eqNullSafe(spans["h"]), "left")
    joined = joined.join(named, base["doc_id"].eqNullSafe(named["d2"]) & base["text_hash"].eqNullSafe(named["h2"]), "left")
    empty = F.array().cast("array<struct<start:bigint,size:int>>")
    return joined.select(
        base["doc_id"],
        base["text_hash"],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", empty).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    return judged(docs, benchmark, n).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _marked(docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, Column, bool]:
    """What was hit, how to join it to ``docs``, and whether it is small enough to be broadcast."""
    found = judged(docs, benchmark, n).filter("n_hit > 0").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("spans"))
    found = cut(found.dropDuplicates(["d", "h"]))
    weight = found.agg(F.coalesce(F.sum(F.lit(40) + 16 * F.size("spans")), F.lit(0))).first()[0]
    on = docs["doc_id"].cast("long").eqNullSafe(found["d"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(found["h"])
    return found, on, weight <= BROADCAST_BYTES


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no window of ``benchmark``."""
    found, on, small = _marked(docs, benchmark, n)
    return docs.join(F.broadcast(found) if small else found, on, "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """All rows of ``docs``; from their texts the words inside windows of ``benchmark`` are gone, each with what stands between it and the word before."""
    found, on, small = _marked(docs, benchmark, n)
    spans = private("spans")
    marked = found.withColumnRenamed("spans", spans)
    joined = docs.join(F.broadcast(marked) if small else marked, on, "left")
    text = docs["text"].cast("string")
    parts = F.regexp_extract_all(text, F.lit(f"[{ASIDE}]*[^{ASIDE}]+"), F.lit(0))
    rest = F.regexp_extract(text, rf"(?<![{ASIDE}])[{ASIDE}]*+\z", 0)

    def stays(_, k):
        return ~F.exists(F.col(spans), lambda s: (s["start"] <= k) & (k < s["start"] + s["size"]))

    shorter = F.concat(F.array_join(F.filter(parts, stays), ""), rest)
    return joined.select(*[F.when(F.col(spans).isNotNull(), shorter).otherwise(docs["text"]).alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns])

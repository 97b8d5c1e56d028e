"""Registered queries on what corpora have in common and what their texts are like."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import personal, profiles
from tablewright.operators import drift, expressions, nonsense, overlap, profile, quality, semantic
from tablewright.plans.registry import documents, registered, table
from tablewright.sources.adapters import spread

# Overlap of two corpora: documents of even and of odd id.


def _halves(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.filter(F.col("doc_id") % 2 == 0), docs.filter(F.col("doc_id") % 2 == 1)


def _shingles_sql(name: str, of: str, id_: str, text: str) -> str:
    return (
        rf"{name}_w AS (SELECT {id_} AS id, list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {of}), "
        f"{name} AS (SELECT id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(list_slice(w, k, k + 4), ' ')))) AS s FROM {name}_w WHERE len(w) > 0)"
    )


_PAIRS_SQL = (
    "WITH "
    + _shingles_sql("s", "documents", "doc_id", "text")
    + ", c AS (SELECT id % 2 AS side, s, min(id) AS id, count(*) AS copies FROM s GROUP BY 1, 2), x AS (SELECT side, id, copies, len(s) AS n, unnest(s) AS g FROM c), "
    "p AS (SELECT a.id AS id_a, b.id AS id_b, a.copies AS copies_a, b.copies AS copies_b, a.n + b.n - count(*) AS either, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.side = 0 AND b.side = 1 GROUP BY 1, 2, 3, 4, a.n, b.n), "
    "near AS (SELECT *, shared / either AS jaccard FROM p WHERE shared / either >= 0.8) "
)


@registered(_PAIRS_SQL + "SELECT id_a, id_b, copies_a, copies_b, shared, round(jaccard, 9) AS jaccard FROM near")
def overlap_pairs(spark, sf_dir):
    """Classes of even documents and of odd ones that are near-equal, as pairs of their smallest ids."""
    found = overlap.similar_classes(*_halves(spark, sf_dir), "text", "doc_id")
    return found.select("id_a", "id_b", "copies_a", "copies_b", "shared", F.round("jaccard", 9).alias("jaccard"))


@registered(
    _PAIRS_SQL + ", l AS (SELECT id_a, sum(copies_b) AS links, max(jaccard) AS best FROM near GROUP BY 1), m AS (SELECT s.id, c.id AS class_id FROM s JOIN c ON c.side = 0 AND c.s = s.s WHERE s.id % 2 = 0) "
    "SELECT d.doc_id AS id, class_id, CAST(coalesce(links, 0) AS BIGINT) AS links, round(best, 9) AS best FROM documents d LEFT JOIN m ON m.id = d.doc_id LEFT JOIN l ON l.id_a = m.class_id WHERE d.doc_id % 2 = 0"
)
def overlap_links(spark, sf_dir):
    """Each even document with its class and the number of odd documents that are near-equal."""
    found = overlap.links_of_texts(*_halves(spark, sf_dir), "text", "doc_id")
    return found.withColumn("best", F.round("best", 9))


_COUNTS_SQL = "SELECT count(*) FILTER (a) AS in_a, count(*) FILTER (b) AS in_b, count(*) FILTER (a AND b) AS in_both FROM (SELECT bool_or(a) AS a, bool_or(b) AS b FROM x GROUP BY g)"
_HALVES_SQL = "WITH " + _shingles_sql("s", "documents", "doc_id", "text") + ", x AS (SELECT id % 2 = 0 AS a, id % 2 = 1 AS b, unnest(s) AS g FROM s) "


@registered(_HALVES_SQL + _COUNTS_SQL)
def overlap_shingles(spark, sf_dir):
    return overlap.shared_shingles(*_halves(spark, sf_dir), "text")


@registered(_HALVES_SQL + f", n AS ({_COUNTS_SQL}) SELECT *, true AS near_a, true AS near_b, true AS near_both FROM n")
def overlap_sketched(spark, sf_dir):
    """Exact numbers, and whether those from theta sketches differ by less than four standard deviations."""
    a, b = _halves(spark, sf_dir)
    both = overlap.shared_shingles(a, b, "text").crossJoin(F.broadcast(overlap.estimated(overlap.sketch(a, "text"), overlap.sketch(b, "text")).toDF("ea", "eb", "eboth", "either")))  # one row each
    most = 4 * F.col("either") / 2 ** (overlap.LG_ENTRIES / 2)
    return both.select("in_a", "in_b", "in_both", *[(F.abs(F.col(f"e{x}") - F.col(f"in_{x}")) <= most).alias(f"near_{x}") for x in ("a", "b", "both")])


@registered(
    "WITH " + _shingles_sql("s", "documents", "doc_id", "text") + ", " + _shingles_sql("t", "pages", "page_id", "regexp_replace(html, '<[^>]*>', ' ', 'g')")
    + ", x AS (SELECT true AS a, false AS b, unnest(s) AS g FROM s UNION ALL SELECT false, true, unnest(s) FROM t) " + _COUNTS_SQL
)
def overlap_of_pages(spark, sf_dir):
    """Shingles that documents and the texts of pages share."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text")))
    return overlap.shared_shingles(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), pages, "text")


# Semantic duplicates


_GROUPS_SQL = (
    "near AS (SELECT a.id AS u, b.id AS v FROM e a JOIN e b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.95), "
    "r AS (SELECT id, id AS root FROM e UNION SELECT near.v, root FROM r JOIN near ON near.u = r.id AND root < near.v), "
    "g AS (SELECT id, min(root) AS group_id FROM r GROUP BY 1) "
    "SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS rows FROM g"
)


@registered("WITH RECURSIVE e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), " + _GROUPS_SQL)
def semantic_groups(spark, sf_dir):
    """Groups of embeddings at a cosine of 0.95 or more."""
    return semantic.groups(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


_DRIFTED = "(10 + c * (id % 7)) * x / 10 + 0.03 * c * sin(id * 1.7 + i * (2 + c))"


@registered(
    "WITH RECURSIVE e AS (SELECT c * 1000000 + vec_id AS id, list_transform(embedding, lambda x, i: " + _DRIFTED.replace("id", "vec_id") + ") AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding, unnest(range(0, 4)) AS c FROM embeddings)), "
    + _GROUPS_SQL
)
def semantic_groups_of_variants(spark, sf_dir):
    """Each embedding with three versions of it, scaled and drifting further away: what is grouped depends on how far."""
    of, c = F.col("vec_id"), F.col("c")
    each = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"))
    drifted = F.transform("embedding", lambda x, k: (10 + c * (of % 7)) * x.cast("double") / 10 + 0.03 * c * F.sin(of * 1.7 + (k + 1) * (2 + c)))
    return semantic.groups(each.select((c * 1000000 + of).alias("id"), drifted.alias("v")), "id", "v")


# Languages by profiles, learned from the stated languages of two documents in three

_GRAMS_SQL = (
    r"WITH c AS (SELECT doc_id, lang, list_filter(string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) || ' ', ''), lambda x: x <> '') AS c FROM documents), "
    "g AS (SELECT doc_id, lang, unnest(list_transform(list_filter(range(1, len(c) - 1), lambda k: c[k + 1] <> ' '), lambda k: c[k] || c[k + 1] || c[k + 2])) AS gram FROM c), "
    "p AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS rank FROM g WHERE doc_id % 3 <> 1 AND lang IS NOT NULL GROUP BY lang, gram QUALIFY rank <= 300), "
    "t AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) AS rank FROM g GROUP BY doc_id, gram QUALIFY rank <= 300), "
    "s AS (SELECT doc_id, p.lang, sum(300 - abs(p.rank - t.rank)) AS w FROM t JOIN p ON t.gram = p.gram GROUP BY 1, 2), "
    "b AS (SELECT doc_id, lang FROM s WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, lang) = 1), "
    "f AS (SELECT d.doc_id, d.lang AS stated, coalesce(b.lang, 'unknown') AS found, d.doc_id % 3 = 1 AS held_out FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id) "
)


def _learned(spark, sf_dir):
    return profiles.learned(spread(table(spark, sf_dir, "documents").filter("doc_id % 3 <> 1").select("text", "lang")), "text", "lang")


def _by_profile(spark, sf_dir):
    found = profiles.detector(_learned(spark, sf_dir))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return docs.select("doc_id", F.col("lang").alias("stated"), found(F.col("text")).alias("found"), (F.col("doc_id") % 3 == 1).alias("held_out"))


@registered(_GRAMS_SQL + "SELECT lang, gram, CAST(rank AS INTEGER) AS rank FROM p")
def lang_profiles(spark, sf_dir):
    return _learned(spark, sf_dir)


@registered(_GRAMS_SQL + "SELECT * FROM f")
def lang_by_profile(spark, sf_dir):
    return _by_profile(spark, sf_dir)


@registered(_GRAMS_SQL + "SELECT stated, count(*) AS n, count(*) FILTER (stated = found) AS right FROM f WHERE held_out GROUP BY stated")
def lang_profile_accuracy(spark, sf_dir):
    """Held-out documents by stated language, and how many are found to be in it."""
    found = _by_profile(spark, sf_dir).filter("held_out")
    return found.groupBy("stated").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stated") == F.col("found")).alias("right"))


@registered(_GRAMS_SQL + "SELECT found AS lang, count(*) AS n FROM f GROUP BY 1")
def lang_dist_by_profile(spark, sf_dir):
    """The quality report's count of languages with a learned detector."""
    return quality.language_counts(documents(spark, sf_dir), detector=profiles.detector(_learned(spark, sf_dir)))


# Nonsense: perplexity of letters


def _pairs_sql(name: str, text: str) -> str:
    return (
        rf"{name}_c AS (SELECT doc_id, list_filter(string_split(' ' || trim(regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}]+', ' ', 'g')) || ' ', ''), lambda x: x <> '') AS c FROM documents), "
        f"{name} AS (SELECT doc_id, unnest(list_transform(range(1, len(c)), lambda k: c[k])) AS a, unnest(list_transform(range(1, len(c)), lambda k: c[k + 1])) AS b FROM {name}_c WHERE len(c) > 2)"
    )


_MODEL_SQL = (
    "WITH "
    + _pairs_sql("x", "text")
    + ", s AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), l AS (SELECT a, sum(n) AS al FROM s GROUP BY 1 ORDER BY al DESC, a LIMIT 256), v AS (SELECT count(*) AS v FROM l), "
    "k AS (SELECT s.* FROM s WHERE a IN (SELECT a FROM l) AND b IN (SELECT a FROM l)), t AS (SELECT l.a, coalesce(sum(n), 0) + any_value(v) + 1 AS total FROM l LEFT JOIN k USING (a), v GROUP BY 1), "
    "m AS (SELECT t.a, k.b, ln((n + 1) / total) AS lp FROM k JOIN t USING (a)) "
)


def _scores_sql(name: str, of: str) -> str:
    return f"{name} AS (SELECT doc_id, exp(-avg(coalesce(m.lp, -ln(t.total), -ln(v + 1)))) AS p FROM {of} y LEFT JOIN m ON m.a = y.a AND m.b = y.b LEFT JOIN t ON t.a = y.a, v GROUP BY 1)"


@registered(_MODEL_SQL + ", " + _scores_sql("p", "x") + " SELECT d.doc_id, round(p, 6) AS perplexity FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id")
def text_perplexity(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = nonsense.perplexity(nonsense.transitions(docs, "text"))
    return docs.select("doc_id", F.round(of(F.col("text")), 6).alias("perplexity"))


@registered(
    _MODEL_SQL + ", " + _pairs_sql("z", "reverse(text)") + ", " + _scores_sql("p", "x") + ", " + _scores_sql("q", "z")
    + " SELECT count(*) AS texts, count(*) FILTER (round(q.p, 6) > round(p.p, 6)) AS told FROM p JOIN q USING (doc_id)"
)
def nonsense_told(spark, sf_dir):
    """How many texts, read backwards, surprise more than as they are."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = nonsense.perplexity(nonsense.transitions(docs, "text"))
    both = docs.select(F.round(of(F.col("text")), 6).alias("p"), F.round(of(F.reverse("text")), 6).alias("q"))
    return both.agg(F.count("p").alias("texts"), F.count_if(F.col("q") > F.col("p")).alias("told"))


# Drift: distributions of one period against those of the one before

_KS_SQL = (
    ", t AS (SELECT period, sum(n) AS total FROM c GROUP BY 1), p AS (SELECT period, total, lag(period) OVER o AS before, lag(total) OVER o AS total_before FROM t WINDOW o AS (ORDER BY period)), "
    "b AS (SELECT p.period, before, v, sum(CASE WHEN c.period = p.period THEN n ELSE 0 END) AS a, sum(CASE WHEN c.period = before THEN n ELSE 0 END) AS b FROM p JOIN c ON c.period = p.period OR c.period = before WHERE before IS NOT NULL GROUP BY 1, 2, 3), "
    "r AS (SELECT period, before, sum(a) OVER o AS a, sum(b) OVER o AS b FROM b WINDOW o AS (PARTITION BY period, before ORDER BY v)), "
    "k AS (SELECT r.period, r.before, CAST(any_value(total) AS BIGINT) AS rows, CAST(any_value(total_before) AS BIGINT) AS rows_before, max(abs(a / total - b / total_before)) AS ks FROM r JOIN p ON r.period = p.period GROUP BY 1, 2) "
)
_DAYS_SQL = "WITH c AS (SELECT date_trunc('day', ts) AS period, value AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2)" + _KS_SQL


def _by_day(spark, sf_dir):
    return table(spark, sf_dir, "events").select("ts", "value"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"), F.col("value")


@registered(_DAYS_SQL + "SELECT period, before, rows, rows_before, round(ks, 9) AS ks FROM k")
def drift_of_events(spark, sf_dir):
    """Kolmogorov-Smirnov distance of each day's values from the day's before."""
    return drift.ks(drift.counts(*_by_day(spark, sf_dir))).withColumn("ks", F.round("ks", 9))


@registered(_DAYS_SQL + "SELECT period, round(ks, 9) AS ks, true AS near FROM k")
def drift_sketched(spark, sf_dir):
    """The exact distance, and whether the one from merged sketches of hours is within the error that they state."""
    df, day, value = _by_day(spark, sf_dir)
    hours = drift.sketches(df, F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"), value)
    days = drift.merged(hours, F.date_trunc("day", F.col("period")).cast("timestamp_ntz"))
    both = drift.ks(drift.counts(df, day, value)).select("period", "ks").join(drift.ks_of_sketches(days).select("period", F.col("ks").alias("about")), "period")
    return both.select("period", F.round("ks", 9).alias("ks"), (F.abs(F.col("ks") - F.col("about")) <= 2 * drift.KLL_ERROR + 1 / 200).alias("near"))


_LENGTH_EDGES = (10, 30, 100, 200, 300, 500, 1000, 2000)


@registered(
    r"WITH c AS (SELECT source AS period, len(regexp_extract_all(text, '\S+'))::DOUBLE AS v, count(*) AS n FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2)" + _KS_SQL
    + f", e AS (SELECT unnest(range(0, {len(_LENGTH_EDGES) + 1})) AS bin), n AS (SELECT period, len(list_filter({list(_LENGTH_EDGES)}, lambda e: e < v)) AS bin, sum(n) AS n FROM c GROUP BY 1, 2), "
    "s AS (SELECT t.period, e.bin, greatest(coalesce(n.n, 0) / t.total, 0.0001::DOUBLE) AS p FROM t CROSS JOIN e LEFT JOIN n ON n.period = t.period AND n.bin = e.bin), "
    "i AS (SELECT x.period, sum((x.p - y.p) * ln(x.p / y.p)) AS psi FROM p JOIN s x ON x.period = p.period JOIN s y ON y.period = p.before AND y.bin = x.bin GROUP BY 1) "
    "SELECT k.period, before, rows, rows_before, round(ks, 9) AS ks, round(psi, 9) AS psi FROM k JOIN i ON i.period = k.period"
)
def drift_of_lengths(spark, sf_dir):
    """Token counts of each source's documents, as if a version of one dataset, against the source's before it by name: distance and stability index."""
    counted = drift.counts(documents(spark, sf_dir).filter(F.col("text").isNotNull()), F.col("source"), F.col("token_count"))
    made = drift.ks(counted).join(drift.psi(counted, list(_LENGTH_EDGES)), ["period", "before"])
    return made.select("period", "before", "rows", "rows_before", F.round("ks", 9).alias("ks"), F.round("psi", 9).alias("psi"))


# Personal data, verified; texts get a number that may be a card's, an account and an address, most of them not genuine

_INJECTED_SQL = (
    "(SELECT doc_id, text || ' 4' || lpad(CAST(doc_id * 7919 AS VARCHAR), 15, '3') || '; DE' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || ' 3704 0044 0532 0130 00, at ' || (doc_id % 400) || '.0.' || (doc_id % 7) || '.1, version 1.2.3.' || (doc_id % 9) AS text FROM documents)"
)
_DIGITS_SQL = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN_SQL = f"list_sum(list_transform(range(1, len({_DIGITS_SQL}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(reverse({_DIGITS_SQL})[k] AS INTEGER) WHEN CAST(reverse({_DIGITS_SQL})[k] AS INTEGER) > 4 THEN CAST(reverse({_DIGITS_SQL})[k] AS INTEGER) * 2 - 9 ELSE CAST(reverse({_DIGITS_SQL})[k] AS INTEGER) * 2 END)) % 10 = 0"
_IBAN_LENGTH_SQL = "CASE " + " ".join(f"WHEN left(x, 2) = '{c}' THEN {n}" for c, n in personal.IBAN_LENGTHS.items()) + " END"
_COMPACT_SQL = f"left(replace(x, ' ', ''), {_IBAN_LENGTH_SQL})"
_GENUINE_SQL = {
    "email": r"regexp_matches(x, '\.[A-Za-z]{2,24}$')",
    "card": f"regexp_matches(x, '{personal.CARD}') AND len({_DIGITS_SQL}) BETWEEN 13 AND 19 AND {_DIGITS_SQL} <> repeat(left({_DIGITS_SQL}, 1), len({_DIGITS_SQL})) AND {_LUHN_SQL}",
    "iban": f"regexp_matches(x, '^[A-Z]{{2}}[0-9]{{2}}') AND coalesce(len(replace(x, ' ', '')) >= {_IBAN_LENGTH_SQL}, false) AND "
    f"list_reduce(list_transform(string_split(substr({_COMPACT_SQL}, 5) || left({_COMPACT_SQL}, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END), lambda t, v: (t * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
    "ip_address": r"lower(regexp_extract(x, '^([A-Za-z]*)', 1)) NOT IN (" + ", ".join(f"'{w}'" for w in personal.VERSION_WORDS) + r") AND regexp_matches(x, '(^|[^0-9])(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$') "
    r"AND list_max(list_transform(string_split(regexp_extract(x, '([0-9][0-9.]*)$', 1), '.'), lambda p: coalesce(TRY_CAST(p AS INTEGER), 999))) <= 255 AND len(string_split(regexp_extract(x, '([0-9][0-9.]*)$', 1), '.')) = 4",
    "phone": f"CASE WHEN left(x, 1) = '+' THEN len({_DIGITS_SQL}) BETWEEN 8 AND 15 ELSE len({_DIGITS_SQL}) = 10 AND regexp_matches(x, '^\\(?[0-9]{{3}}\\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}$') END",
}


def _found_sql(of: str) -> str:
    lists = ", ".join(f"list_filter(regexp_extract_all(text, '{personal.CANDIDATES[k]}'), lambda x: {sql}) AS {k}" for k, sql in _GENUINE_SQL.items())
    each = " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (len({k}) > 0) AS texts, CAST(coalesce(sum(len({k})), 0) AS BIGINT) AS matches FROM f" for k in _GENUINE_SQL)
    return f"WITH f AS (SELECT {lists} FROM {of}) {each}"


def _found(docs):
    lists = docs.select(*[F.size(personal.matches(F.col("text"), k)).cast("long").alias(k) for k in personal.CANDIDATES])
    sums = lists.agg(*[F.struct(F.lit(k).alias("kind"), F.count_if(F.col(k) > 0).alias("texts"), F.coalesce(F.sum(k), F.lit(0)).alias("matches")).alias(k) for k in personal.CANDIDATES])
    return sums.select(F.inline(F.array(*personal.CANDIDATES)))


@registered(_found_sql("documents"))
def personal_verified(spark, sf_dir):
    """Verified personal data by kind: documents that hold some, and matches."""
    return _found(spread(table(spark, sf_dir, "documents").select("text")))


@registered(_found_sql(_INJECTED_SQL))
def personal_verified_injected(spark, sf_dir):
    """The same with a number, an account and an address put behind each text, genuine for some ids only."""
    docs, id_ = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), F.col("doc_id")
    text = lambda x: x.cast("string")
    more = [F.lit(" 4"), F.lpad(text(id_ * 7919), 15, "3"), F.lit("; DE"), F.lpad(text(id_ % 100), 2, "0"), F.lit(" 3704 0044 0532 0130 00, at "), text(id_ % 400), F.lit(".0."), text(id_ % 7), F.lit(".1, version 1.2.3."), text(id_ % 9)]
    return _found(docs.select(F.concat("text", *more).alias("text")))


# Requests over chosen rows and derived columns


@registered(
    "SELECT count(*) AS row_count, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, max(l_shipdate) AS max_l_shipdate FROM lineitem "
    "WHERE l_quantity >= 10 AND (l_returnflag IN ('A', 'R') OR NOT l_linestatus = 'O') AND l_shipdate < TIMESTAMP '1998-01-01' AND l_tax IS NOT NULL"
)
def agg_where(spark, sf_dir):
    """Aggregates over rows that a request's condition chooses, one of a derived column."""
    c, v = (lambda name: {"column": name}), (lambda value: {"value": value})
    op = lambda name, *args: {"op": name, "args": list(args)}
    net = [{"name": "net", "expression": op("*", c("l_extendedprice"), op("-", v(1), c("l_discount")))}]
    condition = op(
        "and",
        op(">=", c("l_quantity"), v(10)),
        op("or", op("in", c("l_returnflag"), v("A"), v("R")), op("not", op("=", c("l_linestatus"), v("O")))),
        op("<", c("l_shipdate"), v("1998-01-01")),
        op("not", op("is_null", c("l_tax"))),
    )
    rows = expressions.where(expressions.derived(table(spark, sf_dir, "lineitem"), net), condition)
    made = profile.aggregate(rows, [{"op": "row_count"}, {"op": "sum", "column": "net"}, {"op": "max", "column": "l_shipdate"}])
    return made.withColumn("sum_net", F.round("sum_net", 2))

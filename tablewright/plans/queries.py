"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions import content, language, repetition, scoring, text as X
from tablewright.operators import histogram, profile, quality, sampling, states, tokens
from tablewright.plans import corpus_queries  # noqa: F401  it registers its own
from tablewright.plans.registry import ORACLES, QUERIES, Query, documents, registered, table
from tablewright.sources import sinks
from tablewright.sources.adapters import spread
from tablewright.streaming.watch import trend

_TOKENS = r"len(regexp_extract_all(text, '\S+'))"

# Aggregates


def _agg(name: str, of: str, operations: list[dict], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: profile.aggregate(table(spark, sf_dir, of), operations)
    ORACLES[name] = sql


_agg("agg_row_count", "lineitem", [{"op": "row_count"}], "SELECT count(*) AS row_count FROM lineitem")
_agg(
    "agg_sum",
    "lineitem",
    [{"op": "sum", "column": c} for c in ("l_linenumber", "l_quantity", "l_extendedprice")],
    "SELECT CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber, sum(l_quantity) AS sum_l_quantity, sum(l_extendedprice) AS sum_l_extendedprice FROM lineitem",
)
_agg(
    "agg_mean",
    "orders",
    [{"op": "mean", "column": c} for c in ("o_totalprice", "o_custkey")],
    "SELECT avg(o_totalprice) AS mean_o_totalprice, avg(o_custkey) AS mean_o_custkey FROM orders",
)
_agg(
    "agg_min",
    "lineitem",
    [{"op": "min", "column": c} for c in ("l_discount", "l_returnflag", "l_shipdate", "l_partkey")],
    "SELECT min(l_discount) + 0.0 AS min_l_discount, min(l_returnflag) AS min_l_returnflag, min(l_shipdate) AS min_l_shipdate, min(l_partkey) AS min_l_partkey FROM lineitem",
)
_agg(
    "agg_max",
    "events",
    [{"op": "max", "column": c} for c in ("ts", "value", "event_type", "user_id")],
    "SELECT max(ts) AS max_ts, max(value) AS max_value, max(event_type) AS max_event_type, max(user_id) AS max_user_id FROM events",
)
_agg(
    "agg_distinct_count",
    "lineitem",
    [{"op": "distinct_count", "column": c} for c in ("l_partkey", "l_returnflag", "l_quantity")],
    "SELECT count(DISTINCT l_partkey) AS distinct_count_l_partkey, count(DISTINCT l_returnflag) AS distinct_count_l_returnflag, count(DISTINCT l_quantity) AS distinct_count_l_quantity FROM lineitem",
)
_agg(
    "agg_multi_one_pass",
    "customer",
    [{"op": "row_count"}, *({"op": op, "column": "c_acctbal"} for op in ("sum", "mean", "min", "max", "distinct_count")), {"op": "distinct_count", "column": "c_mktsegment"}],
    "SELECT count(*) AS row_count, sum(c_acctbal) AS sum_c_acctbal, avg(c_acctbal) AS mean_c_acctbal, min(c_acctbal) AS min_c_acctbal, max(c_acctbal) AS max_c_acctbal, "
    "count(DISTINCT c_acctbal) AS distinct_count_c_acctbal, count(DISTINCT c_mktsegment) AS distinct_count_c_mktsegment FROM customer",
)


@registered(
    "WITH e AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS u, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS t, CAST(NULL AS DOUBLE) AS v FROM events) "
    "SELECT count(DISTINCT u) + max(CASE WHEN u IS NULL THEN 1 ELSE 0 END) AS distinct_count_u, CAST(sum(u) AS BIGINT) AS sum_u, "
    "count(DISTINCT t) + max(CASE WHEN t IS NULL THEN 1 ELSE 0 END) AS distinct_count_t, coalesce(sum(v), 0) AS sum_v, avg(v) AS mean_v FROM e"
)
def agg_with_nulls(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("u"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("t"),
        F.lit(None).cast("double").alias("v"),
    )
    wanted = [("distinct_count", "u"), ("sum", "u"), ("distinct_count", "t"), ("sum", "v"), ("mean", "v")]
    return profile.aggregate(e, [{"op": o, "column": c} for o, c in wanted])


# Profiles


@registered(
    "WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang FROM documents) "
    "SELECT 'doc_id' AS \"column\", count(*) - count(doc_id) AS nulls FROM d UNION ALL SELECT 'text', count(*) - count(text) FROM d UNION ALL SELECT 'lang', count(*) - count(lang) FROM d"
)
def null_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"))
    return profile.null_counts(d)


@registered(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count, count(*) AS rows, round(count(DISTINCT {c}) / count(*), 9) AS share FROM documents"
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    )
)
def unique_counts(spark, sf_dir):
    return profile.unique_counts(table(spark, sf_dir, "documents")).withColumn("share", F.round("share", 9))


@registered("SELECT count(*) - count(DISTINCT doc_id) AS duplicates FROM documents")
def duplicate_ids(spark, sf_dir):
    return profile.duplicates(documents(spark, sf_dir), "id")


@registered("SELECT count(*) - count(DISTINCT text) AS duplicates FROM documents")
def duplicate_texts(spark, sf_dir):
    return profile.duplicates(documents(spark, sf_dir), "text")


# Tokens


@registered(f"SELECT min({_TOKENS}) AS min_tokens, max({_TOKENS}) AS max_tokens FROM documents")
def token_min_max(spark, sf_dir):
    return tokens.outliers(documents(spark, sf_dir)).select("min_tokens", "max_tokens")


_P99 = f"WITH t AS (SELECT {_TOKENS} AS tok FROM documents), r AS (SELECT tok, row_number() OVER (ORDER BY tok) AS i, count(*) OVER () AS n FROM t), p AS (SELECT tok AS p99 FROM r WHERE i = floor((n - 1) * 0.99 + 0.5) + 1) "


@registered(_P99 + "SELECT p99 AS p99_tokens, (SELECT count(*) FROM t WHERE tok > p99) AS above_p99 FROM p")
def token_p99_nearest(spark, sf_dir):
    return tokens.nearest_quantile(documents(spark, sf_dir))


@registered(f"SELECT count(*) FILTER ({_TOKENS} < 5) AS too_short, count(*) FILTER ({_TOKENS} > 10000) AS too_long FROM documents")
def token_too_short_long(spark, sf_dir):
    return tokens.outliers(documents(spark, sf_dir)).select("too_short", "too_long")


@registered(f"{_P99}SELECT CAST(doc_id AS VARCHAR) AS id, {_TOKENS} AS token_count FROM documents, p WHERE {_TOKENS} > p99")
def token_outlier_rows(spark, sf_dir):
    return tokens.outlier_rows(documents(spark, sf_dir)).select("id", "token_count")


# Texts

_CODE_SQL = "regexp_matches(text, '" + "|".join(f"({p})" for p in X.CODE).replace("'", "''") + "')"
_TEXT_SQL = {
    "enc_replacement": ("replacement_char", "CAST(coalesce(sum(len(regexp_extract_all(text, chr(65533)))), 0) AS BIGINT)"),
    "enc_mojibake": ("mojibake", "CAST(coalesce(sum(len(regexp_extract_all(text, '[ÃÂ][ -~]'))), 0) AS BIGINT)"),
    "enc_control": ("control_chars", r"CAST(coalesce(sum(len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]'))), 0) AS BIGINT)"),
    "html_like": ("html_like", "count(*) FILTER (regexp_matches(text, '<[^>]+>'))"),
    "code_like": ("code_like", f"count(*) FILTER ({_CODE_SQL})"),
    "log_like": ("log_like", r"count(*) FILTER (regexp_matches(text, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}'))"),
    "non_alpha_ratio": ("non_alpha_ratio", "round(coalesce(avg(len(regexp_replace(text, '[A-Za-zÆØÅæøå]', '', 'g')) / nullif(length(text), 0)), 0), 9)"),
}
#: Appended to some texts, as the given ones have no damage, markup or log lines.
_MARKER = " a�b� Ã x Â~ Ã¦ \x01\x02 <b>x</b> 2024-01-01 00:00:00 function (x)"
_MARKER_SQL = "' a' || chr(65533) || 'b' || chr(65533) || ' Ã x Â~ Ã¦ ' || chr(1) || chr(2) || ' <b>x</b> 2024-01-01 00:00:00 function (x)'"
_SOURCES_SQL = {
    "": "documents",
    "_injected": f"(SELECT CASE WHEN doc_id % 7 = 0 THEN text || {_MARKER_SQL} WHEN doc_id % 11 = 0 THEN NULL ELSE text END AS text FROM documents) AS d",
    "_pages": "(SELECT html AS text FROM pages) AS p",
}


def _texts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    if kind == "_pages":
        return spread(table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    if kind == "_injected":
        marked = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(_MARKER))).when(F.col("doc_id") % 11 != 0, F.col("text"))
        return docs.select(marked.alias("text"))
    return docs.select("text")


def _text_query(kind: str, column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _texts(spark, sf_dir, kind).agg(*quality.text_measures(F.col("text"))).select(column)
        return made.withColumn(column, F.round(column, 9)) if column == "non_alpha_ratio" else made

    return run


for _kind, _from in _SOURCES_SQL.items():
    for _name, (_column, _sql) in _TEXT_SQL.items():
        if _kind != "_pages" or _name in ("html_like", "code_like"):
            QUERIES[_name + _kind] = _text_query(_kind, _column)
            ORACLES[_name + _kind] = f"SELECT {_sql} AS {_column} FROM {_from}"

_LONG_SQL = "(SELECT CASE WHEN doc_id % 50 = 0 THEN repeat('a', 20000) || ' { = (' || text WHEN doc_id % 50 = 1 THEN repeat('f(', 10000) || '{' ELSE text END AS text FROM documents) AS d"


@registered(f"SELECT count(*) FILTER ({_CODE_SQL}) AS code_like, count(*) FILTER (regexp_matches(text, '<[^>]+>')) AS html_like FROM {_LONG_SQL}")
def code_like_long(spark, sf_dir):
    """Some texts begin with, or are, long runs of letters and of open brackets."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    long = F.when(F.col("doc_id") % 50 == 0, F.concat(F.repeat(F.lit("a"), 20000), F.lit(" { = ("), "text")).when(F.col("doc_id") % 50 == 1, F.concat(F.repeat(F.lit("f("), 10000), F.lit("{"))).otherwise(F.col("text"))
    return docs.select(long.alias("text")).agg(F.count_if(X.is_code(F.col("text"))).alias("code_like"), F.count_if(X.is_html(F.col("text"))).alias("html_like"))


# Kinds of content


@registered("SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {k}" for k, p in content.PERSONAL.items()) + ", count(*) FILTER (" + " OR ".join(f"regexp_matches(text, '{p}')" for p in content.PERSONAL.values()) + ") AS any_kind FROM documents")
def personal_data(spark, sf_dir):
    """Documents that hold personal data or secrets, by kind."""
    docs = spread(table(spark, sf_dir, "documents").select("text"))
    flags = {k: F.coalesce(content.personal(F.col("text"), k), F.lit(False)) for k in content.PERSONAL}
    marked = docs.select(*[f.alias(k) for k, f in flags.items()])
    return marked.agg(*[F.count_if(k).alias(k) for k in flags], F.count_if(F.greatest(*flags)).alias("any_kind"))


@registered(
    f"WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '{content.WORD}')) AS words, greatest(len(regexp_extract_all(text, '{content.SENTENCE_END}')), 1) AS sentences, len(regexp_extract_all(text, '{content.VOWELS}')) AS v FROM documents) "
    f"SELECT doc_id, words, sentences, greatest(v, words) AS syllables, CASE WHEN words > 0 THEN {content.EASE}::DOUBLE - {content.PER_SENTENCE}::DOUBLE * (words::DOUBLE / sentences) - {content.PER_WORD}::DOUBLE * (greatest(v, words)::DOUBLE / words) END AS ease FROM c"
)
def readability(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", content.readability(F.col("text")).alias("r")).select("doc_id", "r.words", "r.sentences", "r.syllables", "r.ease")


@registered(
    "SELECT CASE WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN 'empty' WHEN regexp_matches(text, '<[^>]+>') THEN 'html' WHEN regexp_matches(text, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN 'log' "
    f"WHEN {_CODE_SQL} THEN 'code' ELSE 'text' END AS kind, count(*) AS n FROM {_SOURCES_SQL['_injected']} GROUP BY 1"
)
def content_kinds(spark, sf_dir):
    return _texts(spark, sf_dir, "_injected").groupBy(content.kind_of(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# Repetition

_W = r"[\p{L}\p{N}_]"
_REPEATS_SQL = (
    r"WITH t AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS x FROM documents)), "
    "l AS (SELECT doc_id, lower(w) AS a, lower(lead(w, 1) OVER o) AS b, lower(lead(w, 2) OVER o) AS c, lower(lead(w, 3) OVER o) AS d, lower(lead(w, 4) OVER o) AS e FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)), "
    f"r AS (SELECT DISTINCT doc_id FROM l WHERE b <> '' AND b = c AND c = d AND regexp_full_match(b, '{_W}+') AND regexp_extract(a, '({_W}+)$', 1) = b AND regexp_extract(e, '^({_W}+)', 1) = b) "
)


@registered(_REPEATS_SQL + "SELECT CAST(doc_id AS VARCHAR) AS id FROM r")
def repetition_flag(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.filter(repetition.repeats(F.col("text"))).select("id")


@registered("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 9 = 0")
def repetition_injected(spark, sf_dir):
    """Words repeated 5,000 times, put beside texts of one word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("x "), F.repeat(F.lit("again "), 5000), F.lit("y"))).otherwise("again").alias("text"))
    return docs.filter(repetition.repeats(F.col("text"))).select(F.col("doc_id").cast("string").alias("id"))


def _wilson_sql(n: str, k: str, total: str) -> str:
    """SQL expressions for the estimate, from names of columns that exist and are not zero."""
    p, zz = f"({k} / {n})", "(1.96 * 1.96)"
    middle = f"(({p} + {zz} / (2 * {n})) / (1 + {zz} / {n}))"
    reach = f"(1.96 * sqrt(({p} * (1 - {p}) + {zz} / (4 * {n})) / {n}) / (1 + {zz} / {n}))"
    low, high = f"greatest(0.0, {middle} - {reach})", f"least(1.0, {middle} + {reach})"
    return (
        f"CAST({n} AS BIGINT) AS sample_n, CAST({k} AS BIGINT) AS sample_count, round({p}, 9) AS sample_prop, round({low}, 9) AS lower, round({high}, 9) AS upper, "
        f"CAST(round_even({p} * {total}, 0) AS BIGINT) AS estimate_total, CAST(round_even({low} * {total}, 0) AS BIGINT) AS ci_low, CAST(round_even({high} * {total}, 0) AS BIGINT) AS ci_high"
    )


def _rounded_estimate(df: DataFrame) -> DataFrame:
    e = df.select("repetition_estimate.*")
    return e.withColumns({c: F.round(c, 9) for c in ("sample_prop", "lower", "upper")})


@registered(_REPEATS_SQL + ", n AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM r)::DOUBLE AS k) SELECT " + _wilson_sql("n", "k", "n") + " FROM n")
def repetition_wilson(spark, sf_dir):
    """Exact: every document is looked at, so the sample is the table."""
    whole = documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(repetition.repeats(F.col("text"))).alias("k"))
    return _rounded_estimate(whole.select(repetition.wilson(F.col("k"), F.col("n"), F.col("n")).alias("repetition_estimate")))


# Languages

_LISTS_SQL = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in language.FREQUENT.items()}
_LANG_SQL = (
    r"WITH w AS (SELECT doc_id, lang AS stated, regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+') AS w FROM documents), "
    "s AS (SELECT doc_id, stated, " + ", ".join(f"len(list_filter(w, lambda x: list_contains({v}, x))) AS {k}" for k, v in _LISTS_SQL.items()) + " FROM w), "
    "g AS (SELECT doc_id, stated, CASE WHEN greatest(en, fr, de, es) = 0 THEN 'unknown' WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr' "
    "WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS lang FROM s) "
)


@registered(_LANG_SQL + "SELECT lang, count(*) AS n FROM g GROUP BY lang")
def lang_dist(spark, sf_dir):
    return quality.language_counts(documents(spark, sf_dir))


@registered(_LANG_SQL + ", c AS (SELECT count(*) AS n FROM g GROUP BY lang), t AS (SELECT sum(n) AS t, count(*) AS k FROM c) SELECT round(-sum(n / t * log2(n / t)) / log2(max(k)), 9) AS entropy_ratio FROM c, t")
def lang_entropy(spark, sf_dir):
    counts = quality.language_counts(documents(spark, sf_dir)).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    return counts.select(F.round(scoring.entropy_ratio(F.col("m")), 9).alias("entropy_ratio"))


@registered(_LANG_SQL + "SELECT doc_id, stated, lang AS found FROM g WHERE lang <> stated")
def lang_mismatch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("stated"), language.detected(F.col("text")).alias("found"))
    return docs.filter(F.col("found") != F.col("stated"))


# Score, grade, insights


def _tier_sql(name: str, rate: str, otherwise: str = "0") -> str:
    return "(CASE " + " ".join(f"WHEN {rate} > {least} THEN {penalty}" for least, penalty in scoring.TIERS[name]) + f" ELSE {otherwise} END)"


_MEASURES_SQL = (
    _LANG_SQL
    + ", "
    + _REPEATS_SQL.removeprefix("WITH ")
    + ", "
    + _P99.removeprefix("WITH ").replace("t AS (", "k AS (", 1).replace("FROM t)", "FROM k)").replace(", r AS (", ", q AS (").replace("FROM r WHERE", "FROM q WHERE")
    + f", m AS (SELECT count(*)::DOUBLE AS total_rows, count(*) - count(DISTINCT doc_id) AS duplicate_ids, count(*) - count(DISTINCT text) AS duplicate_texts, "
    + ", ".join(f"{sql} AS {column}" for column, sql in _TEXT_SQL.values())
    + f", count(*) FILTER ({_TOKENS} < 5) AS too_short, count(*) FILTER ({_TOKENS} > 10000) AS too_long, (SELECT count(*) FROM k, p WHERE tok > p99) AS above_p99, (SELECT count(*) FROM r) AS repetition, "
    "(SELECT -sum(n / t * log2(n / t)) / log2(max(k)) FROM (SELECT count(*) AS n FROM g GROUP BY lang), (SELECT count(*) AS t, count(DISTINCT lang) AS k FROM g)) AS entropy, (SELECT count(DISTINCT lang) FROM g) AS langs "
    "FROM documents)"
)
# No column of the canonical corpus but added and created lacks values, and those lack all: two columns at the full tier.
_PENALTIES_SQL = (
    _MEASURES_SQL
    + ", e AS (SELECT *, (replacement_char + mojibake + control_chars) AS damage FROM m), z AS (SELECT *, "
    + ", ".join(
        f"{sql} AS penalty_{name}"
        for name, sql in {
            "duplicates": _tier_sql("duplicates", "((duplicate_ids + duplicate_texts) / total_rows)"),
            "missing": f"CAST(least(25.0, 2 * {_tier_sql('missing', '1.0')}) AS DOUBLE)",
            "encoding": _tier_sql("encoding", "(damage / total_rows)", "CASE WHEN damage > 0 THEN least(damage / 10.0, 8.0) ELSE 0 END"),
            "outliers": _tier_sql("above_p99", "(above_p99 / total_rows)") + " + " + _tier_sql("length", "((too_short + too_long) / total_rows)"),
            "non_alpha": _tier_sql("non_alpha", "non_alpha_ratio"),
            "repetition": _tier_sql("repetition", "(repetition / total_rows)"),
            "markup": _tier_sql("markup", "((html_like + code_like + log_like) / total_rows)"),
            "language": _tier_sql("language", "coalesce(entropy, 0)"),
        }.items()
    )
    + " FROM e)"
)
_PENALTY_NAMES = ("duplicates", "missing", "encoding", "outliers", "non_alpha", "repetition", "markup", "language")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report of all documents, none of it from a sample."""
    return quality.report(documents(spark, sf_dir), sample_rows=None)


@registered(_PENALTIES_SQL + " SELECT " + ", ".join(f"CAST(penalty_{n} AS DOUBLE) AS penalty_{n}" for n in _PENALTY_NAMES) + " FROM z")
def quality_penalties(spark, sf_dir):
    return _report(spark, sf_dir).select(*[f"penalty_{n}" for n in _PENALTY_NAMES])


_SCORE_SQL = "CAST(greatest(0, 100 - (" + " + ".join(f"penalty_{n}" for n in _PENALTY_NAMES) + ")) AS DOUBLE)"
_GRADE_SQL = "CASE " + " ".join(f"WHEN score >= {least} THEN '{name}'" for least, name in scoring.GRADES) + f" ELSE '{scoring.LOWEST_GRADE}' END"


@registered(_PENALTIES_SQL + f", f AS (SELECT {_SCORE_SQL} AS score FROM z) SELECT round(score, 1) AS score, {_GRADE_SQL} AS grade FROM f")
def quality_score_grade(spark, sf_dir):
    return _report(spark, sf_dir).select("score", "grade")


@registered(
    _MEASURES_SQL
    + " SELECT array_to_string(list_filter([CASE WHEN (duplicate_ids + duplicate_texts) / total_rows > 0.01 THEN 'Drop repeated rows' END, 'Fill or collect the missing values', "
    "CASE WHEN (replacement_char + mojibake + control_chars) / total_rows > 0.05 THEN 'Decode the source texts again' END, CASE WHEN non_alpha_ratio > 0.3 THEN 'Inspect and clean the texts' END, "
    "CASE WHEN repetition / total_rows > 0.02 THEN 'Look through repetitive texts' END, CASE WHEN langs > 2 THEN 'Split or filter by language' END], lambda x: x IS NOT NULL), '; ') AS recommendations FROM m"
)
def quality_insights(spark, sf_dir):
    made = _report(spark, sf_dir).select("recommendations")
    return made.select(F.array_join("recommendations", "; ").alias("recommendations"))


_REPORT_SQL = (
    _MEASURES_SQL
    + " SELECT CAST(total_rows AS BIGINT) AS row_count, duplicate_ids, duplicate_texts, replacement_char, mojibake, control_chars, html_like, code_like, log_like, non_alpha_ratio, too_short, too_long, above_p99, repetition, langs FROM m"
)


def _shown(made: DataFrame) -> DataFrame:
    plain = "duplicate_ids duplicate_texts replacement_char mojibake control_chars html_like code_like log_like".split()
    ends = "too_short too_long above_p99 repetition".split()
    return made.select(F.col("total_rows").alias("row_count"), *plain, F.round("non_alpha_ratio", 9).alias("non_alpha_ratio"), *ends, F.size("lang_dist").cast("long").alias("langs"))


@registered(_REPORT_SQL)
def quality_report(spark, sf_dir):
    return _shown(_report(spark, sf_dir))


@registered(_REPORT_SQL)
def quality_report_of_states(spark, sf_dir):
    """The same report, merged from the states that each source's documents have."""
    docs = documents(spark, sf_dir)
    made = states.report(states.counts(docs, F.col("source")), states.keys(docs, F.col("source"), ["id", "text"]), docs.columns)
    return _shown(made)


@registered(
    _MEASURES_SQL
    + " SELECT array_to_string(list_filter([CASE WHEN (duplicate_ids + duplicate_texts) / total_rows > 0.01 THEN 'Duplicated ids or texts (' || printf('%.1f', 100.0 * (duplicate_ids + duplicate_texts) / total_rows) || '%)' END, 'A column lacks many values (100.0%)', "
    "CASE WHEN (replacement_char + mojibake + control_chars) / total_rows > 0.05 THEN 'Encoding damage, occurrences per row (' || printf('%.1f', 100.0 * (replacement_char + mojibake + control_chars) / total_rows) || '%)' END, "
    "CASE WHEN non_alpha_ratio > 0.3 THEN 'Many characters are no letters (' || printf('%.1f', 100.0 * non_alpha_ratio) || '%)' END, CASE WHEN repetition / total_rows > 0.02 THEN 'Texts that repeat one word (' || printf('%.1f', 100.0 * repetition / total_rows) || '%)' END, "
    "CASE WHEN langs > 2 THEN langs || ' languages are mixed' END], lambda x: x IS NOT NULL), '; ') AS issues, "
    "array_to_string(list_filter([CASE WHEN duplicate_ids + duplicate_texts = 0 THEN 'No duplicates' END, CASE WHEN non_alpha_ratio < 0.1 THEN 'Texts are mostly letters' END, CASE WHEN langs = 1 THEN 'One language throughout' END], lambda x: x IS NOT NULL), '; ') AS strengths FROM m"
)
def quality_issues(spark, sf_dir):
    return _report(spark, sf_dir).select(F.array_join("issues", "; ").alias("issues"), F.array_join("strengths", "; ").alias("strengths"))


# Histograms

_EDGES_SQL = "(SELECT list_transform(range(0, 50), lambda k: CASE WHEN k = 0 THEN lo WHEN k = 49 THEN hi ELSE pow(2, log2(lo) + (log2(hi) - log2(lo)) * k / 49) END) AS e FROM (SELECT min(x) AS lo, max(x) AS hi FROM v))"


@registered(
    "WITH v AS (SELECT l_extendedprice AS x FROM lineitem), e AS " + _EDGES_SQL + ", b AS (SELECT len(list_filter(e, lambda y: y < x)) AS bin, any_value(e) AS e, count(*) AS n FROM v, e GROUP BY 1) "
    "SELECT CAST(bin AS INTEGER) AS bin, round(CASE WHEN bin = 0 THEN 1 ELSE e[bin] END, 4) AS bin_left, round(e[bin + 1], 4) AS bin_right, n AS count FROM b"
)
def hist_log2(spark, sf_dir):
    made = histogram.log2_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return made.select("bin", F.round("bin_left", 4).alias("bin_left"), F.round("bin_right", 4).alias("bin_right"), "count")


@registered(
    f"WITH v AS (SELECT {_TOKENS}::DOUBLE AS x FROM documents), e AS " + _EDGES_SQL + ", b AS (SELECT len(list_filter(e, lambda y: y < x)) AS bin, any_value(e) AS e, count(*) AS n FROM v, e GROUP BY 1) "
    "SELECT CAST(bin AS INTEGER) AS bin, round(sqrt(CASE WHEN bin = 0 THEN 1 ELSE e[bin] END * e[bin + 1]), 4) AS bin_center, n AS count FROM b"
)
def hist_log2_tokens(spark, sf_dir):
    return histogram.log2_histogram(documents(spark, sf_dir)).select("bin", F.round("bin_center", 4).alias("bin_center"), "count")


@registered(
    "WITH v AS (SELECT c_acctbal AS x FROM customer), m AS (SELECT min(x) AS lo, (max(x) - min(x)) / 20 AS w FROM v) "
    "SELECT CAST(least(floor((x - lo) / w), 19) AS INTEGER) AS bin, round(min(lo) + least(floor((x - lo) / w), 19) * min(w), 4) AS bin_left, round(min(lo) + (least(floor((x - lo) / w), 19) + 1) * min(w), 4) AS bin_right, count(*) AS count FROM v, m GROUP BY least(floor((x - lo) / w), 19)"
)
def hist_linear(spark, sf_dir):
    made = histogram.linear_histogram(table(spark, sf_dir, "customer"), "c_acctbal")
    return made.select("bin", F.round("bin_left", 4).alias("bin_left"), F.round("bin_right", 4).alias("bin_right"), "count")


@registered(
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) "
    "SELECT count(*) AS count, min(o_totalprice) AS min, min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1)) AS low_whisker, round(min(q1), 6) AS q1, round(min(median), 6) AS median, round(min(q3), 6) AS q3, "
    "max(o_totalprice) FILTER (o_totalprice <= q3 + 1.5 * (q3 - q1)) AS high_whisker, max(o_totalprice) AS max FROM orders, q"
)
def box_stats(spark, sf_dir):
    made = histogram.box_stats(table(spark, sf_dir, "orders"), "o_totalprice")
    return made.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


# Samples, previews, trends


@registered()
def preview_random5(spark, sf_dir):
    return sampling.preview(documents(spark, sf_dir))


@registered("SELECT least(count(*), 5) AS rows, 0 AS unlike FROM documents")
def preview_rows_are_those_of_the_table(spark, sf_dir):
    """How many rows a preview has, and how many of them differ from the document of their id in any field."""
    shown = sampling.preview(documents(spark, sf_dir)).alias("p")
    whole = documents(spark, sf_dir).alias("d")
    same = (F.col("p.text") == F.col("d.text")) & (F.col("p.source") == F.col("d.source")) & (F.col("p.token_count") == F.col("d.token_count"))
    joined = whole.join(F.broadcast(shown), "id", "right")  # five rows
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(same, F.lit(False))).alias("unlike"))


@registered('SELECT \'{"r_regionkey":\' || r_regionkey || \',"r_name":"\' || r_name || \'"}\' AS json FROM region')
def rows_as_json(spark, sf_dir):
    return sinks.as_json(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@registered("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id || ', ' || coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END, 'None') END AS created FROM events")
def created_as_text(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    span = F.struct(F.col("user_id").alias("start"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("end"))
    made = e.select("event_id", F.when(F.col("event_id") % 3 != 0, span).alias("created"))
    return made.select("event_id", sampling.created_text(made.schema["created"].dataType).alias("created"))


@registered("SELECT least(count(*), 100) AS rows FROM orders")
def sample_exact_n(spark, sf_dir):
    return sampling.exact_sample(table(spark, sf_dir, "orders"), 100, seed=1).distinct().agg(F.count(F.lit(1)).alias("rows"))


@registered(f"SELECT CAST(doc_id AS VARCHAR) AS id, {_TOKENS} AS token_count FROM documents ORDER BY token_count DESC, id LIMIT 20")
def longest_texts(spark, sf_dir):
    return sampling.extremes(documents(spark, sf_dir).select("id", "token_count"), 20)


@registered(f"SELECT CAST(doc_id AS VARCHAR) AS id, {_TOKENS} AS token_count FROM documents ORDER BY token_count, id LIMIT 20")
def shortest_texts(spark, sf_dir):
    return sampling.extremes(documents(spark, sf_dir).select("id", "token_count"), 20, longest=False)


@registered("SELECT date_trunc('day', ts) AS start, count(*) AS rows, round(sum(value), 6) AS total FROM events GROUP BY 1")
def event_trend(spark, sf_dir):
    return trend(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""The text-quality report: every measure of a corpus in one row, then score, grade and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions import aggregates as A, language, repetition, scoring, text as X
from tablewright.operators import tokens
from tablewright.operators.sampling import SAMPLE_ROWS, exact_sample
from tablewright.plans.errors import BadRequest


def text_measures(text: Column) -> list[Column]:
    """Aggregates over texts: occurrences of damage, rows of each likeness, mean share of non-letters."""
    return [
        X.occurrences(text, X.REPLACEMENT).alias("replacement_char"),
        X.occurrences(text, X.MOJIBAKE).alias("mojibake"),
        X.occurrences(text, X.CONTROL).alias("control_chars"),
        F.count_if(X.is_html(text)).alias("html_like"),
        F.count_if(X.is_code(text)).alias("code_like"),
        F.count_if(X.is_log(text)).alias("log_like"),
        F.coalesce(F.avg(X.non_alpha_ratio(text)), F.lit(0.0)).alias("non_alpha_ratio"),
    ]


def _text_sums(text: Column) -> list[Column]:
    """``text_measures`` in a form that can be added up: the mean as its sum and number."""
    ratio = X.non_alpha_ratio(text)
    return [*text_measures(text)[:-1], F.sum(ratio).alias("ratio"), F.count(ratio).alias("ratios")]


def language_counts(df: DataFrame, text: str = "text", detector: language.Detector = language.detected) -> DataFrame:
    """(lang, n) by detected language, most first, ties by name."""
    found = df.groupBy(detector(F.col(text)).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), "lang")


def measures(
    df: DataFrame,
    text: str = "text",
    token_count: str = "token_count",
    id_: str = "id",
    sample_rows: int | None = SAMPLE_ROWS,
    seed: int = 0,
    detector: language.Detector = language.detected,
) -> DataFrame:
    """One row with all measures that the score reads.

    One job passes over the whole table: it groups all counts and text measures by token length (and language), so that the quantile of the lengths comes
    from the few groups. Another counts distinct ids and text digests. With ``sample_rows`` a third looks for repetition and languages in a
    sample of so many rows (the whole table, if it is no larger); with None the first job does so in every row. Each gives one row; those are put side by side.
    """
    _demand(df, text, token_count)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    copies = [((A.row_count() - A.distinct_count(c, kinds[c])) if c in kinds else F.lit(0).cast("long")).alias(n) for c, n in ((id_, "duplicate_ids"), (text, "duplicate_texts"))]
    found = detector if sample_rows is None else None
    whole = summed(counted(df, text, token_count, found), df.columns, by_language=sample_rows is None)
    if sample_rows is not None:
        # The sample is told apart by its text and id; other columns need not be read.
        sample = exact_sample(df.select(*[c for c in (id_, text) if c in kinds]), sample_rows, seed)
        by_lang = sample.groupBy(detector(F.col(text)).alias("lang")).agg(F.count(F.lit(1)).alias("n"), _repeated(text))
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "lang")))
        pairs = F.transform(ordered, lambda x: F.struct(x["lang"], -x["less"]))
        third = by_lang.agg(F.map_from_entries(pairs).alias("lang_dist"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(k) for c, k in (("n", "sample_n"), ("sample_count", "sample_count"))])
        whole = whole.crossJoin(F.broadcast(third))  # one row each
    return with_copies(whole, df.agg(*copies))


def _demand(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise BadRequest(f"the report needs a column {name}")


def _repeated(text: str) -> Column:
    return F.count_if(repetition.repeats(F.col(text))).alias("sample_count")


def counted(df: DataFrame, text: str, token_count: str, detector: language.Detector | None, *by: Column) -> DataFrame:
    """All that adds up, by token length (``v``), language (if there is a detector) and ``by``: rows ``n``, nulls of each column, text measures, repetition."""
    keys = [*by, F.col(token_count).alias("v"), *([] if detector is None else [detector(F.col(text)).alias("lang")])]
    nulls = F.array(*[A.null_count(f"`{c}`") for c in df.columns]).alias("nulls")
    measured = _text_sums(F.col(text)) + ([] if detector is None else [_repeated(text)])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), nulls, *measured)


def summed(groups: DataFrame, columns: list[str], by_language: bool = True) -> DataFrame:
    """One row of the measures that ``counted`` groups hold; ``columns`` names what their ``nulls`` count."""
    groups = tokens.upto_counts(groups)
    names = [c for c in groups.columns if c not in ("v", "lang", "n", "nulls", "upto", "all", "ratio", "ratios")]
    sums = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in names]
    lines = [F.coalesce(F.sum(F.col("nulls")[k]), F.lit(0).cast("long")) for k in range(len(columns))]
    wide = [
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_rows"),
        F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*lines)).alias("missing"),
        F.coalesce(F.try_divide(F.sum("ratio"), F.sum("ratios")), F.lit(0.0)).alias("non_alpha_ratio"),
        F.coalesce(F.min("v"), F.lit(0)).cast("long").alias("min_tokens"),
        F.coalesce(F.max("v"), F.lit(0)).cast("long").alias("max_tokens"),
        F.coalesce(F.sum(F.when(F.col("v") < tokens.SHORT, F.col("n"))), F.lit(0).cast("long")).alias("too_short"),
        F.coalesce(F.sum(F.when(F.col("v") > tokens.LONG, F.col("n"))), F.lit(0).cast("long")).alias("too_long"),
        *tokens.nearest_of_counts(),
    ]
    if not by_language:
        return groups.agg(*wide, *sums)
    # All groups of a language, added up: few numbers, as are the groups.
    found = F.array_sort(F.array_distinct(F.collect_list("lang")))
    of = F.collect_list(F.struct("lang", "n"))
    zero = F.lit(0).cast("long")
    totals = F.transform(found, lambda x: F.struct((-F.aggregate(F.filter(of, lambda y: y["lang"] == x), zero, lambda t, y: t + y["n"])).alias("less"), x.alias("lang")))
    langs = F.map_from_entries(F.transform(F.array_sort(totals), lambda x: F.struct(x["lang"], -x["less"])))
    return groups.agg(*wide, *sums, langs.alias("lang_dist")).withColumn("sample_n", F.col("total_rows"))


def with_copies(whole: DataFrame, copies: DataFrame) -> DataFrame:
    """The measures, from a row of ``summed`` and one of duplicate ids and texts."""
    whole = whole.crossJoin(F.broadcast(copies))  # one row each
    estimate = repetition.wilson(F.col("sample_count"), F.col("sample_n"), F.col("total_rows"))
    return whole.withColumn("repetition_estimate", estimate).withColumn("repetition", F.col("repetition_estimate.estimate_total")).drop("sample_n", "sample_count")


def report(df: DataFrame, **options) -> DataFrame:
    """``measures`` with penalties, score, grade and insights."""
    return scoring.insights(scoring.scored(measures(df, **options)))

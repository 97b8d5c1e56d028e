"""Quality score, grade and insights as columns over a one-row frame of measures.

Columns read: total_rows, duplicate_ids, duplicate_texts, missing (map), replacement_char, mojibake, control_chars, above_p99,
too_short, too_long, non_alpha_ratio, repetition, html_like, code_like, log_like, lang_dist (map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Penalties by rate; of the tiers that the rate exceeds, the first counts.
TIERS = {
    "duplicates": ((0.05, 30.0), (0.01, 15.0), (0.0, 5.0)),
    "missing": ((0.20, 20.0), (0.10, 10.0), (0.01, 3.0)),
    "encoding": ((0.10, 20.0), (0.05, 10.0)),
    "above_p99": ((0.05, 15.0), (0.02, 8.0), (0.0, 3.0)),
    "length": ((0.05, 10.0), (0.0, 5.0)),
    "non_alpha": ((0.70, 20.0), (0.50, 15.0), (0.30, 8.0), (0.20, 3.0)),
    "repetition": ((0.10, 15.0), (0.05, 10.0), (0.02, 5.0), (0.0, 2.0)),
    "markup": ((0.20, 15.0), (0.10, 10.0), (0.05, 5.0), (0.0, 2.0)),
    "language": ((0.8, 8.0), (0.6, 5.0), (0.4, 3.0)),
}
# Most that missing values cost; the slope and the most of rare encoding damage.
MISSING_MOST = 25.0
ENCODING_PER, ENCODING_MOST = 10.0, 8.0
# Grades by least score.
GRADES = ((90.0, "Excellent"), (80.0, "Good"), (65.0, "Fair"), (40.0, "Poor"))
LOWEST_GRADE = "Needs Attention"


def tier(name: str, rate: Column, otherwise: Column | None = None) -> Column:
    out = F.lit(0.0) if otherwise is None else otherwise
    for least, penalty in reversed(TIERS[name]):
        out = F.when(rate > least, F.lit(penalty)).otherwise(out)
    return out


def per_row(count: Column) -> Column:
    return F.coalesce(F.try_divide(count.cast("double"), F.col("total_rows").cast("double")), F.lit(0.0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def encoding_total() -> Column:
    return F.col("replacement_char") + F.col("mojibake") + F.col("control_chars")


def entropy_ratio(counts: Column) -> Column:
    """Entropy of a map of counts over its greatest possible value; null for fewer than two entries."""
    values = F.transform(F.map_values(counts), lambda v: v.cast("double"))
    whole = _sum(values)
    bits = F.transform(values, lambda v: F.when(v > 0, -F.try_divide(v, whole) * F.log2(F.try_divide(v, whole))).otherwise(0.0))
    return F.when(F.size(values) > 1, F.try_divide(_sum(bits), F.log2(F.size(values).cast("double"))))


def penalties() -> dict[str, Column]:
    rare = F.when(encoding_total() > 0, F.least(encoding_total() / F.lit(ENCODING_PER), F.lit(ENCODING_MOST))).otherwise(0.0)
    missing = _sum(F.transform(F.map_values("missing"), lambda n: tier("missing", per_row(n))))
    return {
        "duplicates": tier("duplicates", per_row(F.col("duplicate_ids") + F.col("duplicate_texts"))),
        "missing": F.least(missing, F.lit(MISSING_MOST)),
        "encoding": tier("encoding", per_row(encoding_total()), rare),
        "outliers": tier("above_p99", per_row(F.col("above_p99"))) + tier("length", per_row(F.col("too_short") + F.col("too_long"))),
        "non_alpha": tier("non_alpha", F.col("non_alpha_ratio")),
        "repetition": tier("repetition", per_row(F.col("repetition"))),
        "markup": tier("markup", per_row(F.col("html_like") + F.col("code_like") + F.col("log_like"))),
        "language": tier("language", F.coalesce(entropy_ratio(F.col("lang_dist")), F.lit(0.0))),
    }


def grade_of(score: Column) -> Column:
    out = F.lit(LOWEST_GRADE)
    for least, name in reversed(GRADES):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def scored(measures: DataFrame) -> DataFrame:
    """``measures`` with penalty_* columns, score (one decimal) and grade (of the score before rounding)."""
    out = measures.withColumns({f"penalty_{k}": c for k, c in penalties().items()})
    names = [f"penalty_{k}" for k in penalties()]
    raw = F.greatest(F.lit(0.0), F.lit(100.0) - sum((F.col(n) for n in names), F.lit(0.0)))
    raw = F.when(F.col("total_rows") == 0, 0.0).otherwise(raw)
    return out.withColumn("score", raw).withColumns({"grade": grade_of(F.col("score")), "score": F.bround("score", 1)})


def insights(measures: DataFrame) -> DataFrame:
    """``measures`` with arrays of issues, strengths and recommendations."""
    dup = per_row(F.col("duplicate_ids") + F.col("duplicate_texts"))
    gaps = F.coalesce(F.array_max(F.transform(F.map_values("missing"), per_row)), F.lit(0.0))
    damage, repeated = per_row(encoding_total()), per_row(F.col("repetition"))
    alpha, langs = F.col("non_alpha_ratio"), F.size("lang_dist")
    full = F.col("total_rows") > 0

    def percent(text: str, rate: Column) -> Column:
        return F.format_string(text + " (%.1f%%)", rate * 100)

    issues = [
        (~full, F.lit("The table has no rows")),
        (full & (dup > 0.01), percent("Duplicated ids or texts", dup)),
        (full & (gaps > 0.10), percent("A column lacks many values", gaps)),
        (full & (damage > 0.05), percent("Encoding damage, occurrences per row", damage)),
        (full & (alpha > 0.30), percent("Many characters are no letters", alpha)),
        (full & (repeated > 0.02), percent("Texts that repeat one word", repeated)),
        (full & (langs > 2), F.format_string("%d languages are mixed", langs)),
    ]
    advice = [
        (full & (dup > 0.01), "Drop repeated rows"),
        (full & (gaps > 0.10), "Fill or collect the missing values"),
        (full & (damage > 0.05), "Decode the source texts again"),
        (full & (alpha > 0.30), "Inspect and clean the texts"),
        (full & (repeated > 0.02), "Look through repetitive texts"),
        (full & (langs > 2), "Split or filter by language"),
    ]
    strengths = [
        (full & (dup == 0), "No duplicates"),
        (full & (gaps == 0), "No missing values"),
        (full & (alpha < 0.10), "Texts are mostly letters"),
        (full & (langs == 1), "One language throughout"),
    ]

    def chosen(pairs) -> Column:
        return F.array_compact(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs]))

    return measures.withColumns({"issues": chosen(issues), "strengths": chosen(strengths), "recommendations": chosen(advice)})

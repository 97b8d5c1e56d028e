import pytest

from tablewright.functions import scoring

CLEAN = {
    "total_rows": 1000, "duplicate_ids": 0, "duplicate_texts": 0, "missing": {"id": 0, "text": 0}, "replacement_char": 0, "mojibake": 0, "control_chars": 0, "above_p99": 0,
    "too_short": 0, "too_long": 0, "non_alpha_ratio": 0.0, "repetition": 0, "html_like": 0, "code_like": 0, "log_like": 0, "lang_dist": {"en": 1000},
}
KIND = (
    "total_rows long, duplicate_ids long, duplicate_texts long, missing map<string,long>, replacement_char long, mojibake long, control_chars long, above_p99 long, "
    "too_short long, too_long long, non_alpha_ratio double, repetition long, html_like long, code_like long, log_like long, lang_dist map<string,long>"
)
CASES = [
    ({}, 100.0, "Excellent"),
    ({"total_rows": 0}, 0.0, "Needs Attention"),
    *[({"duplicate_texts": n}, s, None) for n, s in ((1, 95), (10, 95), (11, 85), (50, 85), (51, 70))],
    *[({"missing": {"a": n, "b": 0}}, s, None) for n, s in ((10, 100), (11, 97), (101, 90), (201, 80))],
    ({"missing": {"a": 201, "b": 201}}, 75.0, "Fair"),
    *[({"mojibake": n}, s, None) for n, s in ((1, 99.9), (50, 95), (51, 90), (101, 80))],
    ({"control_chars": 90, "total_rows": 10_000}, 92.0, "Excellent"),
    ({"above_p99": 10}, 97.0, None),
    *[({"too_short": n}, s, None) for n, s in ((50, 95), (51, 90))],
    *[({"non_alpha_ratio": x}, s, None) for x, s in ((0.20, 100), (0.21, 97), (0.31, 92), (0.51, 85), (0.71, 80))],
    *[({"repetition": n}, s, None) for n, s in ((1, 98), (21, 95), (51, 90), (101, 85))],
    *[({"html_like": n}, s, None) for n, s in ((1, 98), (51, 95), (101, 90), (201, 85))],
    *[({"lang_dist": d}, s, None) for d, s in (({"a": 500, "b": 500}, 92), ({"a": 900, "b": 100}, 97), ({"a": 950, "b": 50}, 100), ({}, 100))],
    ({"duplicate_ids": 900, "missing": {"a": 999, "b": 999}, "mojibake": 999, "above_p99": 999, "too_short": 999, "non_alpha_ratio": 0.9}, 0.0, "Needs Attention"),
]


def test_score_of_each_tier(spark):
    rows = [tuple((CLEAN | change).values()) for change, _, _ in CASES]
    got = [r for r in scoring.scored(spark.createDataFrame(rows, KIND).coalesce(1)).collect()]
    for row, (change, score, grade) in zip(got, CASES):
        assert row.score == pytest.approx(score), change
        assert grade is None or row.grade == grade


def test_insights(spark):
    rows = [CLEAN, CLEAN | {"total_rows": 0}, CLEAN | {"duplicate_ids": 20, "missing": {"a": 101}, "mojibake": 51, "non_alpha_ratio": 0.4, "repetition": 21, "lang_dist": {"a": 1, "b": 1, "c": 1}}]
    got = scoring.insights(spark.createDataFrame([tuple(r.values()) for r in rows], KIND).coalesce(1)).collect()
    assert (len(got[0].issues), len(got[0].strengths), len(got[0].recommendations)) == (0, 4, 0)
    assert (len(got[1].issues), len(got[1].strengths)) == (1, 0)
    assert (len(got[2].issues), len(got[2].strengths), len(got[2].recommendations)) == (6, 0, 6)
    assert "2.0%" in got[2].issues[0]

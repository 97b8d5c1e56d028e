import math
import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from tablewright.operators import drift

SCHEMA = "day int, x double, period string, n long"


def plain_ks(a, b):
    a, b = sorted(a), sorted(b)
    return max(abs(bisect_right(a, x) / len(a) - bisect_right(b, x) / len(b)) for x in {*a, *b})


def plain_psi(a, b, edges, floor=1e-4):
    shares = []
    for values in (a, b):
        n = [0] * (len(edges) + 1)
        for x in values:
            n[bisect_left(edges, x)] += 1
        shares.append([max(k / len(values), floor) for k in n])
    return sum((p - q) * math.log(p / q) for p, q in zip(*shares))


def made(seed=1):
    rng = random.Random(seed)
    rows = []
    for day in (1, 2, 3, 5, 8):
        rows += [(day, round(rng.gauss(day / 4, 1), rng.choice([0, 2]))) for _ in range(rng.choice([1, 50, 400]))]
    rows += [(3, math.inf), (3, -math.inf), (2, 0.0), (2, -0.0), (6, None), (6, math.nan), (None, 1.0)]
    return rows, {d: [0.0 if x == 0 else x for k, x in rows if k == d and x is not None and not math.isnan(x)] for d in (1, 2, 3, 5, 8)}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)


def test_distances_equal_plain_python(spark):
    rows, by_day = made()
    counted, days, edges = drift.counts(frame(spark, rows), F.col("day"), F.col("x")), sorted(by_day), [-1.0, 0.0, 0.5, 2.0]
    want = {(b, a): (len(by_day[b]), len(by_day[a]), plain_ks(by_day[b], by_day[a])) for a, b in zip(days, days[1:])}
    found = {(r.period, r.before): (r.rows, r.rows_before, r.ks) for r in drift.ks(counted).collect()}
    assert found.keys() == want.keys()
    for k in want:
        assert found[k] == pytest.approx(want[k])
    index = {(r.period, r.before): r.psi for r in drift.psi(counted, edges).collect()}
    assert index == {k: pytest.approx(plain_psi(by_day[k[0]], by_day[k[1]], edges)) for k in want}


def test_sketches_are_within_their_error_and_merge(spark):
    rng = random.Random(2)
    rows = [(day, rng.gauss(0.1 * day, 1 + 0.05 * day)) for day in range(8) for _ in range(5000)]
    df = frame(spark, rows).repartition(4)
    weeks = drift.merged(drift.sketches(df, F.col("day"), F.col("x")), F.floor(F.col("period") / 2))
    assert {r.period: r.n for r in weeks.collect()} == dict.fromkeys(range(4), 10_000)
    found = {r.period: r.ks for r in drift.ks_of_sketches(weeks).collect()}
    of = lambda k: [x for day, x in rows if day // 2 == k]
    for k in range(1, 4):
        assert abs(found[k] - plain_ks(of(k), of(k - 1))) <= 2 * drift.KLL_ERROR + 1 / 200


def test_few_periods(spark):
    for rows in ([], [(1, 2.0)], [(1, None)]):
        counted = drift.counts(frame(spark, rows), F.col("day"), F.col("x"))
        assert drift.ks(counted).count() == drift.psi(counted, [1.0]).count() == 0
    same = drift.counts(frame(spark, [(1, 2.0), (2, 2.0)]), F.col("day"), F.col("x"))
    assert drift.ks(same).first().ks == 0 and drift.psi(same, [1.0]).first().psi == 0

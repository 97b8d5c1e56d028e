import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import semantic
from tablewright.operators.components import components


def plain_components(edges):
    root = {}
    for e in edges:
        for x in e:
            root.setdefault(x, x)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    n = list(range(300))
    rng.shuffle(n)
    edges = {
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5)],
        "path": list(zip(n, n[1:])) * 2,
        "star": [(7, k) for k in range(200)] + [(k, 900 + k) for k in range(50)],
        "none": [],
    }[kind]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert dict(map(tuple, found)) == want and len(found) == len(want)


def plain_groups(rows, least):
    """[(id, group, size)] by comparing all with all."""
    unit = []
    for _, v in rows:
        sound = bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if sound else None
        unit.append(None if x is None else x / np.sqrt((x * x).sum()))
    edges = [(k, k) for k in range(len(rows))]
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                edges.append((a, b))
    root, members = plain_components(edges), {}
    for k, r in root.items():
        members.setdefault(r, []).append(rows[k][0])
    return sorted(((rows[k][0], min((i for i in members[r] if i is not None), default=None), len(members[r])) for k, r in root.items()), key=str)


def vectors(seed, n=150, dim=12):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.standard_normal((n // 5, dim))
    for k in range(n):
        near = centres[rng.integers(len(centres))] + rng.standard_normal(dim) * rng.choice([0.02, 0.15, 0.3])
        rows.append((k, (near * rng.choice([0.1, 1, 50])).tolist()))
    rows += [(500, None), (501, []), (502, [0.0] * dim), (503, [math.nan] + [1.0] * (dim - 1)), (504, [math.inf] + [1.0] * (dim - 1)), (505, [None] + [1.0] * (dim - 1))]
    return rows + [rows[0], (3, rows[1][1]), (900, [1.0, 2.0]), (901, [2.0, 4.0]), (902, [-1.0, -2.0]), (None, rows[2][1])]


@pytest.mark.parametrize("part", [2000, 4])
def test_equals_brute_force(spark, part):
    rows = vectors(1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, e array<double>, key long, root string")
    found = sorted((tuple(r) for r in semantic.groups(df, "vec_id", "e", part=part).collect()), key=str)
    want = plain_groups(rows, 0.95)
    assert found == want and len({r[1] for r in want}) < len(want) - 20


def test_recall(spark):
    """Pairs of exactly the least similarity, the hardest, meet as often as said."""
    rng, dim, n = np.random.default_rng(2), 64, 1000
    a, other = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.sqrt((other * other).sum(1, keepdims=True))
    b = 0.9501 * a + math.sqrt(1 - 0.9501**2) * other
    rows = [(2 * k + s, x[k].tolist()) for k in range(n) for s, x in ((0, a), (1, b))]
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(4)
    for recall in (0.999, 0.9):
        found = semantic.groups(df, "id", "e", recall=recall)
        assert found.filter("id % 2 = 1 and group_id = id - 1").count() >= (recall - 0.03) * n


def test_shape():
    for n in (0, 1, 100, 10**5, 10**9):
        bits, tables = semantic.shape(n)
        meets = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - meets) ** tables >= 0.999 and n / 2**bits <= 100
    assert semantic.shape(1000, least=1.0)[1] == 1


def test_a_bucket_of_like_vectors_gives_a_forest(spark):
    n = 400
    df = spark.createDataFrame([(k, [1.0, k / 1e6]) for k in range(n)], "key long, vector array<double>")
    bits, tables = semantic.shape(n)
    edges = semantic.similar_edges(df, part=50)
    parts = math.ceil(n / 50)
    assert n - 1 <= edges.count() <= tables * n * (parts + 1)
    assert semantic.groups(df, "key", "vector").agg(F.min("rows"), F.max("group_id")).first()[:] == (n, 0)


def test_empty(spark):
    assert semantic.groups(spark.createDataFrame([], "id long, e array<float>"), "id", "e").count() == 0


@pytest.mark.parametrize("part", [semantic.PART, 2500])
def test_every_pair_at_the_least_similarity_is_found(spark, part):
    """3,000 pairs at a cosine of 0.9501, of which tables of planes lose some."""
    rng, dim, n = np.random.default_rng(5), 64, 3000
    a, other = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.sqrt((other * other).sum(1, keepdims=True))
    b = 0.9501 * a + math.sqrt(1 - 0.9501**2) * other
    rows = [(2 * k + s, x[k].tolist()) for k in range(n) for s, x in ((0, a), (1, b))]
    found = semantic.groups(spark.createDataFrame(rows, "id long, e array<double>").repartition(4), "id", "e", part=part)
    assert found.filter("id % 2 = 1 and group_id = id - 1 and rows = 2").count() == n


@pytest.mark.parametrize("two", [False, True])
@pytest.mark.parametrize("spread", [0.01, 0.05, 0.3])
def test_a_cell_of_several_tiles_connects_what_is_similar(two, spread):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((300 if spread > 0.1 else 3, 24))
    x = centres[rng.integers(len(centres), size=5000)] + spread * rng.standard_normal((5000, 24))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    own = np.sort(rng.integers(2, size=5000)) if two else np.zeros(5000, int)
    edges = semantic.forest_of_cell(x, own, 0.95)
    near = (x @ x.T >= 0.95) & ((own[:, None] != own[None]) if two else True)
    assert all(near[a, b] for a, b in edges) and len(edges) < 5000
    want = plain_components([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
    assert plain_components(edges) == want


def test_parts_are_sent_packed_to_cells_of_their_own(spark, monkeypatch):
    """A task for each cell and no sort, which would spill what is sent once more; edges between numbers, however keys are told."""
    monkeypatch.setattr(semantic, "HELD", 2000, raising=False)
    rows = vectors(3)
    kept = [(k, v) for k, (i, v) in enumerate(rows) if i is not None and v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    kept = list({tuple(v): (k, v) for k, v in kept}.values())
    for kind in ("double", "float"):
        df = spark.createDataFrame(kept, f"key long, vector array<{kind}>").repartition(3)
        made = semantic.similar_edges(df, part=20)
        plan, parts = made._jdf.queryExecution().executedPlan().toString(), -(-len(kept) // 20)
        assert re.findall(r"direct_shuffle_partition_id\(cell#\d+\), (\d+)\)", plan) == [str(parts * (parts + 1) // 2)] and "Sort" not in plan
        assert dict(made.dtypes) == {"u": "bigint", "v": "bigint"}
        unit = np.array([v for _, v in kept], np.float32 if kind == "float" else float).astype(float)
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        near = np.argwhere(np.triu(unit @ unit.T >= 0.95, 1))
        want = plain_components([(kept[a][0], kept[b][0]) for a, b in near])
        assert {frozenset(x for x in g if g[x] == r) for g in [plain_components([tuple(e) for e in made.collect()])] for r in set(g.values())} == {frozenset(x for x in want if want[x] == r) for r in set(want.values())}
        assert len(near) > 20
